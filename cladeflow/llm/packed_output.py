"""Packed token-id matrices: whole sequences, segment bounds and position resets as binary.

Documents are cut and placed as in ``packing``; the pieces of a sequence then meet in one
row, which holds the sequence's ids, padded, its cumulative segment lengths and the places
where positions start again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import scratch_table
from cladeflow.llm.packing import id_bytes, pieces, place
from cladeflow.llm.tokens import vocabulary_path

ROWS = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, id_bytes int, input_ids binary"


def _assemble(size: int, pad_id: int, wide: int):
    pad = int(pad_id).to_bytes(wide, "little")
    lists = pa.list_(pa.int32())
    kinds = {"sequence_id": pa.int64(), "n_tokens": pa.int32(), "n_segments": pa.int32(), "doc_ids": pa.list_(pa.int64()), "pieces": lists, "cu_seqlens": lists, "position_resets": lists, "id_bytes": pa.int32(), "input_ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1)
            bounds, flat = parts.offsets.to_pylist(), parts.values
            offset, length, doc, piece, ids = (flat.field(k).to_pylist() for k in range(5))
            rows = []
            for k, sequence in enumerate(batch.column(0).to_pylist()):
                own = sorted(range(bounds[k], bounds[k + 1]), key=offset.__getitem__)
                starts = [offset[i] for i in own]
                n = starts[-1] + length[own[-1]]
                rows.append((sequence, n, len(own), [doc[i] for i in own], [piece[i] for i in own], [*starts, n], starts, wide, b"".join([ids[i] for i in own]) + pad * (size - n)))
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))

    return run


def packed_sequences(docs: DataFrame, size: int = 2048, end_id: int = 0, pad_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per sequence.

    input_ids holds size little-endian unsigned ids of id_bytes bytes, 2 where the vocabulary
    allows and else 4, padded with pad_id after n_tokens; segment k is a piece of doc_ids[k] and takes the places cu_seqlens[k] to
    cu_seqlens[k + 1]; positions start from 0 at each of position_resets. Defined cases are
    those of ``best_fit_packing``.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    if id_bytes(path, end_id) != id_bytes(path, end_id, pad_id):
        raise ValueError("pad_id needs more bytes than the vocabulary")
    cut = scratch_table(pieces(docs, size, end_id, path, keep_ids=True), "id-pieces")
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    # A sequence holds at most size pieces, so its list is bounded.
    met = place(cut, size).groupBy("sequence_id").agg(F.collect_list(part).alias("parts"))
    return met.mapInArrow(_assemble(size, pad_id, id_bytes(path, end_id)), ROWS)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the sequences as Parquet files, one binary matrix row each."""
    packed_sequences(docs, **options).write.mode("errorifexists").parquet(path)


def unpack(sequences: DataFrame) -> DataFrame:
    """The pieces of packed sequences again: doc_id, piece and its ids as binary, id_bytes each."""
    one = F.posexplode(F.arrays_zip("doc_ids", "pieces")).alias("k", "part")
    s = sequences.select("input_ids", "id_bytes", "cu_seqlens", one)
    lo, hi = F.element_at("cu_seqlens", F.col("k") + 1), F.element_at("cu_seqlens", F.col("k") + 2)
    return s.select(F.col("part.doc_ids").alias("doc_id"), F.col("part.pieces").alias("piece"), F.substring(F.col("input_ids"), F.col("id_bytes") * lo + 1, F.col("id_bytes") * (hi - lo)).alias("ids"))
