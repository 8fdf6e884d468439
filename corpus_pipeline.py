"""A training-corpus pipeline of five operators, each stage over all that its predecessor kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeflow.llm import stages
from cladeflow.llm.common import stored_alone

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("exact_dedup", stages.exact_dedup),
    ("near_dedup", stages.near_dedup),
    ("secret_scan", stages.secret_scan),
    ("best_fit_packing", stages.best_fit_packing),
]

#: The perplexity model, the forest and the tokenizer cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written as Parquet and read again, and then what the stage stored on the way is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored_alone(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023, called at once
    return STAGES[-1][1](spark, docs, sf_dir)
