"""Exact deduplication against a minimal perfect hash of historical digests.

Texts are equal when they are identical without white space. History is reduced to one
row per digest; each shard of those digests becomes one index row: a minimal perfect
hash, full digests by slot, and the winner and size of each group. Arriving digests,
also one row each, are looked up in the shard's slot and compared byte by byte; members
join the historical group, the others form groups of their own.

Defined cases: a null text is empty; empty texts equal one another; of equal texts the
longest in code points stays, then the smallest doc_id, a null doc_id last; rows that
repeat a doc_id within a group share its decision and all count in group_size; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import SPACE, join_by_group, remainder, scratch_table, shares, texts
from cladeflow.llm.perfect_hash import PerfectHash, words

#: Distinct digests that one shard of the index is meant to hold.
SHARD_ROWS = 50_000
GROUP = "digest binary, n_rows long, best_len int, best_id long"
INDEX = "shard int, slots int, mph binary, digests binary, n_rows binary, best_len binary, best_id binary, no_id binary"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the text) and the digest of the text without white space."""
    t = texts(docs)
    bare = F.regexp_replace("text", f"{SPACE}+", "")
    return t.select("doc_id", F.length("text").alias("n_chars"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: number of rows and the row that stays, combined before the shuffle."""
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), best.alias("best")).select("digest", "n_rows", (-F.col("best.short")).alias("best_len"), F.col("best.id").alias("best_id"))


def _sharded(groups: DataFrame, n_shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int"))


def _build(group: pa.Table) -> pa.Table:
    found = group["digest"].to_pylist()
    keys = words(found)
    mph = PerfectHash.build(keys)
    slot = mph.index(keys)
    order = np.argsort(slot)
    ids = group["best_id"].combine_chunks()

    def by_slot(values: np.ndarray, kind: str) -> bytes:
        return values.astype(kind)[order].tobytes()

    row = {
        "shard": [group["shard"][0].as_py()],
        "slots": [len(found)],
        "mph": [mph.dump()],
        "digests": [keys[order].tobytes()],
        "n_rows": [by_slot(group["n_rows"].to_numpy(), "<i8")],
        "best_len": [by_slot(group["best_len"].to_numpy(), "<i4")],
        "best_id": [by_slot(ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8")],
        "no_id": [by_slot(ids.is_null().to_numpy(zero_copy_only=False), "?")],
    }
    return pa.table(row).cast(pa.schema([("shard", pa.int32()), ("slots", pa.int32()), *((k, pa.binary()) for k in list(row)[2:])]))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard of the distinct historical digests (columns of ``grouped``)."""
    return _sharded(history, n_shards).groupBy("shard").applyInArrow(_build, INDEX)


def _resolve(index: pa.Table, arrived: pa.Table) -> pa.Table:
    n_new = arrived.num_rows
    new = {k: arrived[k].to_pylist() for k in ("digest", "n_rows", "best_len", "best_id")}
    found, sizes, lens, ids = [], [], [], []
    hit = np.zeros(n_new, dtype=bool)
    if index.num_rows:
        row = index.to_pylist()[0]
        slots = np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
        sizes = np.frombuffer(row["n_rows"], dtype="<i8").tolist()
        lens = np.frombuffer(row["best_len"], dtype="<i4").tolist()
        ids = [None if x else y for x, y in zip(np.frombuffer(row["no_id"], dtype="?").tolist(), np.frombuffer(row["best_id"], dtype="<i8").tolist())]
        found = [row["digests"][i : i + 32] for i in range(0, 32 * len(slots), 32)]
        if n_new:
            keys = words(new["digest"])
            at = PerfectHash.load(row["mph"]).index(keys)
            hit = (at >= 0) & (slots[at] == keys).all(axis=1)
            for i in np.flatnonzero(hit).tolist():
                s = int(at[i])
                sizes[s] += new["n_rows"][i]
                old = (-lens[s], ids[s] is None, ids[s] or 0)
                if (-new["best_len"][i], new["best_id"][i] is None, new["best_id"][i] or 0) < old:
                    lens[s], ids[s] = new["best_len"][i], new["best_id"][i]
    for i in np.flatnonzero(~hit).tolist():
        found.append(new["digest"][i])
        sizes.append(new["n_rows"][i])
        lens.append(new["best_len"][i])
        ids.append(new["best_id"][i])
    return pa.table({"digest": pa.array(found, pa.binary()), "n_rows": pa.array(sizes, pa.int64()), "best_len": pa.array(lens, pa.int32()), "best_id": pa.array(ids, pa.int64())})


def resolve(index: DataFrame, arrivals: DataFrame, n_shards: int) -> DataFrame:
    """Historical groups with the arrivals that belong to them, and groups of the other arrivals."""
    return index.groupBy("shard").cogroup(_sharded(arrivals, n_shards).groupBy("shard")).applyInArrow(_resolve, GROUP)


def exact_dedup(docs: DataFrame, n_history: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Rows whose crc32(doc_id) is divisible by n_history are the history, the others arrive.
    """
    rows = scratch_table(digests(docs), "digests")
    total = rows.count()
    n_shards = shares(total, SHARD_ROWS)
    old = remainder(F.col("doc_id"), n_history) == 0
    index = scratch_table(build_index(grouped(rows.filter(old)), n_shards), "digest-index")
    groups = scratch_table(resolve(index, grouped(rows.filter(~old)), n_shards), "digest-groups")
    joined = join_by_group(rows, groups, "digest", "n_rows", total)
    return joined.select(
        "doc_id", F.col("best_id").alias("keep_id"), F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("best_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
