"""Split counting on a stream of trees, and event rates in time windows.

Counts of splits are sums, so a stream of trees needs no state of its own: trees are cut
where they arrive and the running aggregation keeps one row for each split. A table kept in
batches adds each micro-batch's facts to what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeflow.operators import splits

KEYS = ["family", "n_leaves", "clade", "other", "size", "left", "right", "left_size", "right_size"]


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (family, newick) rows from JSON lines files that appear in a folder."""
    return spark.readStream.schema("family string, newick string, weight double").json(path)


def running_facts(trees: DataFrame) -> DataFrame:
    """Running counts of splits and branch lengths; for output modes update and complete."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in trees.columns else F.lit(1.0)
    rows = trees.select(F.col("family").cast("string").alias("family"), "newick", weight.alias("weight")).mapInPandas(splits._facts, splits.FACTS)
    return rows.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt"), F.sum("bl").alias("bl"))


def keep_facts(trees: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add each micro-batch's facts to a Parquet table, once: a batch that is run again replaces its own folder."""

    def add(batch: DataFrame, epoch: int) -> None:
        splits.split_facts(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return trees.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts kept so far, all batches added up."""
    return spark.read.parquet(path).groupBy(*KEYS).agg(F.sum("cnt").alias("cnt"), F.sum("bl").alias("bl"))


def windowed_events(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in tumbling windows, late ones dropped after the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "kind").agg(F.count(F.lit(1)).alias("n"))
