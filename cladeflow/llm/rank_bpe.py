"""Byte-level BPE by the tiktoken library with a local rank file, and decoding to raw bytes.

A text of over PART_CHARS characters is cut into parts at safe boundaries, so that neither the
pattern's engine nor a list of ids has to hold all of it. A boundary is safe where the pattern
ends a match whatever stands around: before white space that follows anything else, and
between a letter or digit and a sign. The pattern looks ahead past white space alone, and a
part never ends with it, so parts have the matches of the whole text. Where a text has no safe
boundary for long, as in a run of one letter or of blanks, its matches are found one by one and
given to the library's merges singly; the library's own matching fails on such runs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import bounded_batches, texts, worker_store
from cladeflow.llm.tokens import vocabulary_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a part, but for what follows up to the next safe boundary.
PART_CHARS = 1 << 16
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Unicode's White_Space characters.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: ASCII signs, and those of Chinese and Japanese text, that stand between words.
_SIGNS = "!-/:-@\\[-`{-~\\u3001-\\u3003\\u3008-\\u3011\\uff01-\\uff0f\\uff1a-\\uff20"
SAFE = f"(?<=[^{_WS}])(?=[{_WS}])|(?<=[\\p{{L}}\\p{{N}}])(?=[{_SIGNS}])"


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankCoder:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.safe = regex.compile(SAFE)
        self.match = regex.compile(pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]"))

    def parts(self, text: str, size: int = PART_CHARS) -> Iterator[str]:
        """The text in parts of about size characters that end at safe boundaries."""
        at = 0
        while len(text) - at > size:
            found = self.safe.search(text, at + size)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def ids(self, part: str, size: int = PART_CHARS) -> np.ndarray:
        """The ids of a part as unsigned 32-bit integers."""
        if len(part) <= 2 * size:
            return self.coder.encode_to_numpy(part, disallowed_special=())
        single = self.coder._core_bpe.encode_single_piece
        return np.fromiter(chain.from_iterable(single(m.group().encode()) for m in self.match.finditer(part)), np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; they need not be whole characters."""
        return self.coder.decode_bytes(ids)


def rank_coder(path: str, pattern: str) -> RankCoder:
    """One coder for each worker process, rank file and pattern."""
    loaded = worker_store("rank_coder")
    if (path, pattern) not in loaded:
        loaded[path, pattern] = RankCoder(path, pattern)
    return loaded[path, pattern]


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(path, pattern)
        for batch in batches:
            sizes, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                size, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
                for part in coder.parts(text):
                    ids = coder.ids(part)
                    size += len(ids)
                    ids_sha.update(ids.astype("<u4").tobytes())
                    text_sha.update(coder.decode(ids.tolist()))
                sizes.append(size)
                of_ids.append(ids_sha.hexdigest())
                of_text.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(path, pattern)
        for batch in batches:
            ids = [np.concatenate([coder.ids(p) for p in coder.parts(t)]).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(path, pattern)
        for batch in batches:
            got = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["doc_id", "decoded"])

    return run


def rank_ids(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs; a null text is empty and has no ids."""
    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(_encode(path or vocabulary_path(RANKS), pattern or default_pattern()), "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of every row of doc_id, ids: the inverse of rank_ids. Ids cut anywhere decode to raw bytes; null ids to null."""
    bounded_batches(coded.sparkSession)
    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decode(path or vocabulary_path(RANKS), pattern or default_pattern()), "doc_id long, decoded binary")


def rank_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs.

    Defined cases: a null text is empty and has no ids; strings of special tokens are ordinary
    text; rows that repeat a doc_id, or have none, are coded each; other columns are ignored; an
    empty table gives an empty result. A text of any length is coded part by part in one task.
    """
    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(_digests(path or vocabulary_path(RANKS), pattern or default_pattern()), CODED)
