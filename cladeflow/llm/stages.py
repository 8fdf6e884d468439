"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of docs, extra ones included. An empty table gives an
empty result. What nulls, empty texts, ties and repeated rows do is stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, MapType, VariantType

from cladeflow.llm import exact_dedup as exact
from cladeflow.llm import near_dedup as near
from cladeflow.llm import packing, quality, secrets
from cladeflow.llm.common import SPACE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the perplexity bands reject go.

    Every row is judged by itself: null and empty texts have no words and go; a null lang is a
    language of its own; rows that repeat are judged alike, so all or none of them stay.
    """
    return quality.keep_good(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """One row for each (doc_id, text), as row and key: the first by its other columns where rows repeat with others.

    The row travels as one struct, so that no column of docs can clash with those added here.
    """
    order = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))))
    rows = docs.select(F.struct("*").alias("row"), key(F.col("doc_id"), F.col("text")).alias("key"), order.alias("order"))
    return rows.groupBy("key").agg(F.min_by("row", "order").alias("row"))


def key(doc_id: Column, text: Column) -> Column:
    """What rows with one doc_id and text share; a null doc_id is unlike any id, a null text is empty."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("none")), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, one document stays: the longest, then the smallest doc_id.

    Null and empty texts equal one another. A row without doc_id stays only where no row of
    its group is as long and has one, and then once. Rows that repeat a doc_id within a group
    become one, the longest of them, then the first by text and other columns.
    """
    bare = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{SPACE}+", "").cast("binary"), 256)
    own_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none"))
    kept = exact.exact_dedup(docs).filter("kept").select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text_sha256").alias("key"))
    hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))))
    order = F.struct((-F.length(F.coalesce(F.col("text"), F.lit("")))).alias("short"), F.coalesce(F.col("text"), F.lit("")).alias("text"), hashed.alias("rest"))
    rows = docs.select(F.struct("*").alias("row"), F.concat_ws(":", own_id, bare).alias("key"), order.alias("order"))
    # One exchange by key serves the choice of a row and the join.
    return rows.groupBy("key").agg(F.min_by("row", "order").alias("row")).join(kept, "key", "left_semi").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by five-word shingles and a similarity of 0.8, the smallest doc_id stays.

    Null, empty and blank texts are near nothing and stay. A row without doc_id goes if a
    document with one has the same shingles, and otherwise stays, as it can stand for no group.
    Rows that repeat doc_id and text become one; rows that repeat a doc_id with other texts
    are different documents, of which those of one group stay together.
    """
    kept = near.near_rows(docs, key(F.col("doc_id"), F.col("text"))).filter("kept").select("key")
    return _keyed(docs).join(kept.distinct(), "key", "left_semi").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars, where it is a column of whole numbers, follows it.

    All rows stay; a null text stays null, with its n_chars; an n_chars of any other type is
    left as it is.
    """
    masked = docs.withColumn("text", secrets.redacted(secrets.train(docs), F.col("text")))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    if isinstance(kind, IntegralType):
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes; a null or empty text is the end id alone, rows that repeat are packed each."""
    return packing.best_fit_packing(docs)
