"""Importance resampling towards a target distribution by hashed n-grams, with Gumbel top-k draws.

Runs of 1 to n words are hashed into buckets; a bucket's gain is the log ratio of its smoothed
shares in the target and in the documents, and a document's weight the mean gain of its
features. Texts of over CHUNK_BYTES are cut into chunks at word boundaries and dealt out, so a
few very long ones don't hold up a task: a chunk owns the features that start in it and
carries the next n - 1 words, which complete its last ones. Counts and gains of a text's chunks
are summed by document. The model is one number per bucket, whatever the corpus.

Draws are without replacement in proportion to exp(weight / 1000): the largest sums of weight
and a Gumbel number that a hash of the id gives. Ranks come from range partitions of the scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import bounded_batches, scratch_table, texts

#: Bytes of a chunk, but for the word at its end and the words it carries.
CHUNK_BYTES = 1 << 15
#: Features whose buckets a task holds at once, but for those of one chunk.
HELD_FEATURES = 1 << 20
#: A-Z in lower case; all that is in no word as a blank. Bytes from 128 on belong to letters.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_WORD, _BREAK = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
WEIGHED = "doc_id long, n_words long, n_features long, gain long"


def features(text: bytes, carried: bytes, n: int) -> tuple[int, list[list[int]]]:
    """The number of words of a chunk, and the crc32 of the runs of 1 to n words that start in it, by width."""
    words = text.translate(_FOLD).split()
    own = len(words)
    words += carried.translate(_FOLD).split()
    runs = list(map(crc32, words))
    out = [runs[:own]]
    for k in range(1, n):
        runs = list(map(crc32, words[k:], map(crc32, repeat(b" "), runs)))
        out.append(runs[:own])
    return own, out


def cut(text: bytes, size: int, n: int) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a text, each with the words it carries from the next ones."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + size)
        end = found.start() if found else len(text)
        last = end
        for m in islice(_WORD.finditer(text, end), n - 1):
            last = m.end()
        yield text[at:end], text[end:last]
        at = end


def _cut(size: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(i) for i in range(3))):
                for k, (own, carried) in enumerate(cut(text.as_py(), size, n)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row.as_py(), pa.int64()), (doc.as_py(), pa.int64()), (k, pa.int32()), (own, pa.binary()), (carried, pa.binary()))], ["row", "doc_id", "chunk", "text", "carried"])

    return run


def chunks(docs: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows row, doc_id, text, carried (binary): the whole texts of up to size bytes, and the chunks of longer ones, dealt out."""
    bounded_batches(docs.sparkSession)
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    short = rows.filter(F.octet_length("text") <= size).withColumn("carried", F.lit(b""))
    long = rows.filter(F.octet_length("text") > size).mapInArrow(_cut(size, n), "row long, doc_id long, chunk int, text binary, carried binary").repartition("row", "chunk").drop("chunk")
    return short, long


def _histogram(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        held: list[list[int]] = []
        size = 0
        for batch in batches:
            for text, carried in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features(text, carried, n)[1]
                held += found
                size += sum(map(len, found))
                if size >= HELD_FEATURES:
                    counts += np.bincount(np.fromiter(chain.from_iterable(held), np.uint32) % buckets, minlength=buckets)
                    held, size = [], 0
        counts += np.bincount(np.fromiter(chain.from_iterable(held), np.uint32) % buckets, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, n: int, buckets: int, size: int) -> np.ndarray:
    """Features of all texts by bucket: one number for each of the buckets, added up in tasks, then over tasks."""
    short, long = chunks(docs, n, size)
    rows = short.select("text", "carried").unionByName(long.select("text", "carried"))
    out = np.zeros(buckets, np.int64)
    for bucket, count in rows.mapInArrow(_histogram(n, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = count
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, rounded down."""
    all_t, all_s = float(target.sum()) + len(target), float(source.sum()) + len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for t, s in zip(target.tolist(), source.tolist())], np.int64)


def _weigh(n: int, gain: np.ndarray, extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, carried in zip(batch.column("text").to_pylist(), batch.column("carried").to_pylist()):
                own, found = features(text, carried, n)
                codes = np.fromiter(chain.from_iterable(found), np.uint32)
                out.append((own, len(codes), int(gain[codes % len(gain)].sum())))
            made = [pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))]
            kept = ["row", "doc_id"] if extra else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "n_words", "n_features", "gain"])

    return run


def weights(docs: DataFrame, gain: np.ndarray, n: int, size: int) -> DataFrame:
    """doc_id, n_words, n_features and the sum of gains of every row of docs."""
    short, long = chunks(docs, n, size)
    of_chunks = long.mapInArrow(_weigh(n, gain, True), f"row long, {WEIGHED}")
    of_long = of_chunks.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain"))).drop("row")
    return short.mapInArrow(_weigh(n, gain, False), WEIGHED).unionByName(of_long)


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7, size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (all long); rank is null where a row isn't drawn.

    target needs a column text. Defined cases: null texts are empty; a document without words
    has no features and weight 0; rows that repeat a doc_id, or have none (hashed as the empty
    text), are rows of their own, and equal scores go by doc_id, null first, then by features
    and weight; rows that equal in all of these are interchangeable. Words are never cut, so a
    chunk is as long as its longest word; other columns are ignored; an empty table gives an
    empty result, an empty target weighs by the documents alone.
    """
    of_target = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets, size)
    weighed = weights(docs, gains(of_target, bucket_counts(docs, n, buckets, size)), n, size)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0).cast("long")
    scored = scratch_table(weighed.withColumn("weight", weight).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel).alias("score")), "scored")
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    able, place = F.col("n_words") >= least_words, F.monotonically_increasing_id()
    placed = scored.filter(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place)
    placed = scratch_table(placed.select("doc_id", "n_features", "weight", "score", F.shiftright("_at", 33).cast("int").alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("at")), "placed")
    before, total = [], 0
    for part, count in sorted(placed.groupBy("part").count().collect()):  # one row per task that placed rows
        before.append((part, total))
        total += count
    offsets = docs.sparkSession.createDataFrame(before, "part int, offset long")
    rank = F.col("offset") + F.col("at") + 1
    drawn = placed.join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= percent * total // 100, rank).alias("rank"))
    return drawn.unionByName(scored.filter(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
