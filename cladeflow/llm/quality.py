"""Quality rules: repetition and length, then bands of n-gram perplexity for each language.

The language model is a modified Kneser-Ney model over characters, folded to an alphabet of
64 symbols: its 4-grams are counted by Spark over all documents that pass the plain rules
and have few symbols, and number 64 ** 4 at most, whatever the corpus. Counts, discounts and
continuation counts give one array of sorted n-gram codes, with their probabilities, and one
of back-off weights for each order; a text's n-grams are found in them by binary search.

For each language, the median and the quartiles of the log perplexity of those same documents,
in steps of 0.001, give an upper and a lower band; a document outside is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import bounded_batches, in_chunks, scratch_table, worker_store

ORDER, BITS = 4, 6
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents with more symbols than this percentage of their words don't count as language.
MAX_SYMBOL_PERCENT = 10
#: Widths of the bands, in standard deviations as the quartiles give them; and the least deviation that is assumed, in log10 per byte, which short texts of a very uniform language need.
UPPER, LOWER, LEAST_SPREAD = 8.0, 8.0, 0.012
SYMBOLS = b"#*$%&|<>"
RULES = "doc_id long, language string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, language_like boolean"


def alphabet() -> np.ndarray:
    """The symbol of each UTF-8 byte: 0 white space, 1 to 26 letters without case, 27 digits, then signs and higher bytes in shared classes."""
    of = np.full(256, 31, dtype=np.uint32)
    of[[32, *range(9, 14)]] = 0
    for k in range(26):
        of[[65 + k, 97 + k]] = 1 + k
    of[48:58] = 27
    for k, signs in enumerate((b".,;:!?", b"'\"()-", SYMBOLS)):
        of[list(signs)] = 28 + k
    of[128:] = 32 + np.arange(128) % 32
    return of


_OF = alphabet()


def repeats(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    code = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    v = len(index) + 1
    first = code[:-2] * v + code[1:-1]
    if v > 2_000_000:  # three numbers would not fit in 64 bits
        first = np.unique(first, return_inverse=True)[1]
    _, at, n_of = np.unique(first * v + code[2:], return_inverse=True, return_counts=True)
    twice = n_of[at] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    data = b"".join(words)
    chars = len(data) if data.isascii() else len(data.decode())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats(words)


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(t) for t in batch.column(2).to_pylist()]
        cols = [np.array(x, dtype=np.int64) for x in zip(*rows)] if rows else [np.empty(0, dtype=np.int64)] * 5
        failed = (cols[0] < MIN_WORDS) | (100 * cols[4] > MAX_REPEAT_PERCENT * cols[0])
        plain = ~failed & (100 * cols[2] <= MAX_SYMBOL_PERCENT * cols[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols), pa.array(failed), pa.array(plain)], [f.split()[0] for f in RULES.split(", ")])


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram codes of all texts in a row, and how many each has; a text is led by white space."""
    lead = b" " * (ORDER - 1)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    s = _OF[np.frombuffer(lead + lead.join(texts) if texts else b"", dtype=np.uint8)]
    if not sizes.sum():
        return np.empty(0, dtype=np.uint32), sizes
    g = np.zeros(len(s) - ORDER + 1, dtype=np.uint32)
    for k in range(ORDER):
        g = (g << np.uint32(BITS)) | s[k : len(s) - ORDER + 1 + k]
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    keep = np.zeros(len(s) + 1, dtype=np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + sizes, -1)
    return g[np.cumsum(keep[: len(g)]) > 0], sizes


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    parts = [empty]
    for batch in batches:
        for texts in in_chunks([t for t in batch.column(0).to_pylist() if t]):
            parts.append(np.unique(codes(texts)[0], return_counts=True))
            if len(parts) > 16:
                parts = [merged(parts)]
    keys, n = merged(parts)
    for at in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000].astype(np.int64)), pa.array(n[at : at + 50_000])], ["gram", "n"])


@dataclass
class KneserNey:
    """Sorted codes of each order with the log10 probability of seen n-grams and of their back-off weights."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]

    def score(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each ORDER-gram code."""
        out = np.zeros(len(g))
        left = np.arange(len(g))
        for order in range(ORDER, 1, -1):
            here = g[left] & np.uint32((1 << (BITS * order)) - 1)
            at, hit = _find(self.grams[order - 1], here)
            out[left[hit]] += self.logs[order - 1][at[hit]]
            left, here = left[~hit], here[~hit]
            if not len(left):
                return out
            at, known = _find(self.contexts[order - 1], here >> np.uint32(BITS))
            out[left[known]] += self.backoffs[order - 1][at[known]]
        out[left] += self.logs[0][g[left] & np.uint32((1 << BITS) - 1)]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def kneser_ney(grams: np.ndarray, n: np.ndarray) -> KneserNey:
    """Modified Kneser-Ney with three discounts an order; lower orders count distinct left neighbours."""
    found, logs, contexts, backoffs = [], [], [], []
    counts = {ORDER: (grams.astype(np.uint32), n.astype(float))}
    for order in range(ORDER - 1, 0, -1):
        longer = counts[order + 1][0]
        keys, left = np.unique(longer & np.uint32((1 << (BITS * order)) - 1), return_counts=True)
        counts[order] = (keys, left.astype(float))
    size = 1 << BITS
    low = np.full(size, 0.0)
    keys, c = counts[1]
    low[keys] = c
    probs = {1: (low + 1) / (low.sum() + size)}
    found.append(np.arange(size, dtype=np.uint32))
    logs.append(np.log10(probs[1]))
    contexts.append(np.empty(0, dtype=np.uint32))
    backoffs.append(np.empty(0))
    below = probs[1]
    for order in range(2, ORDER + 1):
        keys, c = counts[order]
        n1, n2, n3, n4 = (float((c == k).sum()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = np.array([0.0, *(min(max(x, 0.1), k - 0.05) for x, k in zip(raw, (1, 2, 3)))])
        cut = d[np.minimum(c, 3).astype(int)]
        context, at = np.unique(keys >> np.uint32(BITS), return_inverse=True)
        total = np.bincount(at, weights=c, minlength=len(context))
        weight = np.bincount(at, weights=cut, minlength=len(context)) / np.maximum(total, 1e-300)
        shorter = keys & np.uint32((1 << (BITS * (order - 1))) - 1)
        lower = below[shorter] if order == 2 else below[np.searchsorted(counts[order - 1][0], shorter)]
        p = (c - cut) / total[at] + weight[at] * lower if len(keys) else np.empty(0)
        found.append(keys)
        logs.append(np.log10(p))
        contexts.append(context)
        backoffs.append(np.log10(weight))
        below = p
    return KneserNey(found, logs, contexts, backoffs)


def _scored(model: KneserNey):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts in in_chunks(batch.column(1).to_pylist()):
                g, sizes = codes(texts)
                steps = [model.score(g[at : at + (1 << 20)]) for at in range(0, len(g), 1 << 20)]
                sums = np.concatenate([[0.0], np.cumsum(np.concatenate(steps))] if steps else [[0.0]])
                ends = np.cumsum(sizes)
                out.append((sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(-np.concatenate(out) if out else np.empty(0))], ["row", "log_perplexity"])

    return run


def quality(docs: DataFrame, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """doc_id, the counts of ``measures``, base_failed, log_perplexity, band limits and kept of every row of docs.

    base_failed: fewer than 50 words, or over half of them in repeated windows. kept: not
    base_failed and log10 perplexity per UTF-8 byte within the bands of the document's lang.

    Defined cases: a null text has no words; a null lang is a language of its own; a language
    without documents that set bands keeps all that passes the rules; rows that repeat a
    doc_id are judged each; an empty table gives an empty result; other columns are ignored.
    """
    rows, model = fit_model(docs)
    scored = scratch_table(rows.mapInArrow(_both(model), RULES + ", log_perplexity double"), "quality")
    out = join_bands(scored, bands_of(scored, upper, lower))
    return out.withColumn("kept", inside_bands()).drop("language", "language_like")


def fit_model(docs: DataFrame) -> tuple[DataFrame, KneserNey]:
    """doc_id, language and text of docs, and the model of its language-like documents."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(), text)
    judged = rows.mapInArrow(_judge, JUDGED)
    got = scratch_table(judged.groupBy("gram").agg(F.sum("n").alias("n")), "grams").toArrow()  # 64 ** ORDER rows at most
    order = np.argsort(got["gram"].to_numpy())
    return rows, kneser_ney(got["gram"].to_numpy()[order], got["n"].to_numpy()[order])


def language() -> Column:
    return F.coalesce(F.col("lang"), F.lit("")).alias("language")


def bands_of(scored: DataFrame, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """upper_band and lower_band of each language."""
    # Rounded values are few, so exact quartiles need little memory and don't depend on the order of rows.
    quartiles = F.expr("percentile(round(log_perplexity, 3), array(0.25, 0.5, 0.75))")
    bands = scored.filter("language_like").groupBy("language").agg(quartiles.alias("_q"))
    middle, spread = F.col("_q")[1], F.greatest((F.col("_q")[2] - F.col("_q")[0]) / 1.349, F.lit(LEAST_SPREAD))
    return bands.select("language", (middle + upper * spread).alias("upper_band"), (middle - lower * spread).alias("lower_band"))


def inside_bands() -> Column:
    return ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band")), F.lit(True))


def judge(model: KneserNey, text: Column) -> Column:
    """A struct of base_failed, language_like and log_perplexity for a text column."""
    both = _both(model)

    @F.arrow_udf("base_failed boolean, language_like boolean, log_perplexity double")
    def verdict(texts: pa.Array) -> pa.Array:
        data = texts.fill_null(b"")
        nothing = pa.nulls(len(data), pa.int64())
        got = next(both(iter([pa.RecordBatch.from_arrays([nothing, nothing, data], ["doc_id", "language", "text"])])))
        names = ["base_failed", "language_like", "log_perplexity"]
        return pa.StructArray.from_arrays([got.column(n) for n in names], names=names)

    return verdict(text.cast("binary"))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the documents that ``quality`` rejects, all columns as they were."""
    _, model = fit_model(docs)
    # The row travels as one struct, so that no column of docs can clash with those added here.
    judged = docs.select(F.struct("*").alias("row"), language(), judge(model, F.col("text")).alias("judged"))
    judged = scratch_table(judged, "judged").select("row", "language", "judged.*")
    rated = join_bands(judged, bands_of(judged))
    return rated.filter(inside_bands()).select("row.*")


def join_bands(scored: DataFrame, bands: DataFrame, key: str = "language") -> DataFrame:
    """One row of bands per language meets its documents; broadcast while they are few."""
    bands = scratch_table(bands, "bands")
    small = bands.limit(10_001).count() <= 10_000
    return scored.join(F.broadcast(bands) if small else bands, key, "left")


JUDGED = "gram long, n long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of the documents that are language-like."""
    worker_store("quality")

    def plain() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(2).to_pylist():
                n_words, _, n_symbols, _, n_repeat = measures(text)
                if n_words >= MIN_WORDS and 100 * n_repeat <= MAX_REPEAT_PERCENT * n_words and 100 * n_symbols <= MAX_SYMBOL_PERCENT * n_words:
                    keep.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary())], ["text"])

    yield from _grams(plain())


def _both(model: KneserNey):
    score = _scored(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("quality")
        for batch in batches:
            ruled = next(_rules(iter([batch])))
            scored = next(score(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["row", "text"])])))
            yield pa.RecordBatch.from_arrays([*ruled.columns, scored.column(1)], [*ruled.schema.names, "log_perplexity"])

    return run
