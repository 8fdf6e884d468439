"""What the text operators share: input columns, scratch tables, hot keys and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]"
#: A key that holds more than this share of the rows is hot; at most its inverse of such keys exist.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep what one Arrow batch holds small, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="cladeflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for scope in _scopes:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


def stored_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns as a scratch table; all other scratch tables written on the way are removed, as nothing reads them any more."""
    _scopes.append([])
    try:
        out = scratch_table(make(), name)
    finally:
        written = _scopes.pop()
    spark = out.sparkSession
    for path in written[:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return out


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a null text as the empty one; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shares(total: int, each: int) -> int:
    return max(1, ceil(total / each))


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with one row per key.

    Keys of over HOT_SHARE of all rows, 1000 at most, are broadcast; the others meet in a
    shuffle whose largest key is under that share.
    """
    limit = total * HOT_SHARE
    hot = groups.filter(F.col(size) > limit)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= limit), key)
    return few.unionByName(rest)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of doc_id as text, mod divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def in_chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in a row, cut into lists of so many bytes, but for one longer text: what numpy holds at once stays small."""
    part: list[bytes] = []
    size = 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


_stores: dict[str, dict] = {}


def worker_store(name: str) -> dict:
    """What a worker keeps between tasks under a name. Asking for one store empties all others, so only one operator's words stay in memory."""
    for other, store in _stores.items():
        if other != name:
            store.clear()
    return _stores.setdefault(name, {})


_M = np.uint64(0xBF58476D1CE4E5B9)
_N = np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied to each element."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * _N
    return x ^ (x >> np.uint64(31))
