"""Language of documents and of spans within them: script ranges, then Viterbi over words.

Spark counts the letter trigrams of each language, folded to 64 symbols, over all learning
documents, and the letters that a language writes in each script. A word's score for a
language is the sum of its trigrams' log probabilities; languages that hardly use the word's
script are no candidates for it. Viterbi, with a penalty for each switch, labels the words; the
language of the most letters is the document's. Where no stretch of words favours another
language by more than the penalty, the best single label is the Viterbi path, so the
recursion runs only over texts that may be mixed.

Defined cases: ``und`` for a null text or one without a letter, and for all if nothing was
learned; ties go to the first language in order; a null doc_id counts as the empty text in
the split; rows that repeat a doc_id are judged each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import bounded_batches, in_chunks, remainder, scratch_table, worker_store
from cladeflow.llm.quality import BITS, alphabet, merged

#: Penalty, in natural logarithm, of a switch; smoothing count of a trigram; share of letters below which a script is foreign.
SWITCH, SMOOTH, FOREIGN = 18.0, 0.5, 0.005
#: What a word of a foreign script costs a language.
BARRED = 60.0
#: Counts that a task holds at once, of all languages together; beyond it they go to the shuffle.
HELD_CELLS = 4_000_000
N_GRAMS = 1 << (3 * BITS)
SPANS = "array<struct<first_word:int,n_words:int,lang:string>>"
_OF = alphabet()
_LETTER = re.compile(rb"[A-Za-z]")
#: Script ranges by the lead byte of UTF-8: 0 none, 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian and Hebrew, 5 Arabic, 6 Indic and Thai, 7 Georgian and others, 8 kana, 9 Han, 10 Hangul.
N_SCRIPTS = 11


def scripts() -> np.ndarray:
    of = np.zeros(256, dtype=np.uint8)
    for k in range(26):
        of[[65 + k, 97 + k]] = 1
    for first, last, script in ((0xC3, 0xC9, 1), (0xCD, 0xCF, 2), (0xD0, 0xD3, 3), (0xD4, 0xD7, 4), (0xD8, 0xDB, 5), (0xE0, 0xE0, 6), (0xE1, 0xE1, 7), (0xE3, 0xE3, 8), (0xE4, 0xE9, 9), (0xEA, 0xED, 10)):
        of[first : last + 1] = script
    return of


_SCRIPT = scripts()


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with two blanks before each and one after the last; where each text starts."""
    data = np.frombuffer(b"  " + b"  ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    return data, np.cumsum(sizes) - sizes + 2


def trigrams(data: np.ndarray) -> np.ndarray:
    """The code of the trigram that ends at each byte, from the third on."""
    s = _OF[data]
    return (s[:-2] << np.uint32(2 * BITS)) | (s[1:-1] << np.uint32(BITS)) | s[2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_store("language_id")
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for part in in_chunks(texts):
                data, _ = joined(part)
                g = trigrams(data)
                keys, n = np.unique(g[(g & np.uint32(4095)) != 0], return_counts=True)  # not within white space
                script = np.bincount(_SCRIPT[data], minlength=N_SCRIPTS)
                used = np.flatnonzero(script)
                own = parts.setdefault(lang, [])
                own.append((np.append(keys.astype(np.int64), used + N_GRAMS), np.append(n, script[used])))
                held += len(keys)
                if len(own) > 16:
                    parts[lang] = [merged(own)]
                if held > HELD_CELLS:
                    yield from _flush(parts)
                    parts, held = {}, 0
    yield from _flush(parts)


def _flush(parts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for lang, own in parts.items():
        at, n = merged(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n)], ["lang", "gram", "n"])


@dataclass
class LanguageModel:
    """langs in order; row[gram]: the row of logs that a trigram has, 0 if it was not seen; logs[row, lang]; barred[script, lang]: what a word of that script costs."""

    langs: list[str]
    row: np.ndarray
    logs: np.ndarray
    barred: np.ndarray


def learn(rows: DataFrame) -> LanguageModel:
    """rows: lang and text (binary) of the documents to learn from.

    The model has, for each language, one number for each trigram that any language uses: of
    the N_GRAMS possible ones, some thousands.
    """
    counts = scratch_table(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams").toArrow()
    names = counts["lang"].to_pylist()
    langs = sorted(set(names))
    of = {x: k for k, x in enumerate(langs)}
    at = np.fromiter((of[x] for x in names), dtype=np.int64, count=len(names))
    gram, n = counts["gram"].to_numpy(), counts["n"].to_numpy()
    used = np.unique(gram[gram < N_GRAMS])
    row = np.zeros(N_GRAMS, dtype=np.int32)
    row[used] = 1 + np.arange(len(used))
    logs, letters = np.full((len(used) + 1, len(langs)), SMOOTH, dtype=np.float32), np.zeros((N_SCRIPTS, len(langs)))
    of_gram = gram < N_GRAMS
    total = np.bincount(at[of_gram], weights=n[of_gram], minlength=len(langs))
    logs[row[gram[of_gram]], at[of_gram]] += n[of_gram]
    np.log(logs, out=logs)
    logs -= np.log(total + SMOOTH * N_GRAMS).astype(np.float32)
    letters[gram[~of_gram] - N_GRAMS, at[~of_gram]] = n[~of_gram]
    letters[0] = 0
    share = letters / np.maximum(letters.sum(0), 1)
    barred = np.where(share < FOREIGN, BARRED, 0.0)
    barred[barred.min(1, initial=0) > 0] = 0  # a script that no language uses leaves all of them
    barred[0] = 0
    return LanguageModel(langs, row, logs, barred)


def word_scores(model: LanguageModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores [word, lang] of all words of the texts in a row, bytes of each word, and where each text's words start, with the end."""
    data, starts = joined(texts)
    blank = _OF[data] == 0
    first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    last = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # the blank after a word
    sums = np.zeros((len(data) - 1, len(model.langs)))
    np.cumsum(model.logs[model.row[trigrams(data)]], axis=0, dtype=np.float64, out=sums[1:])
    score = sums[last - 1] - sums[first - 2]
    if data.max(initial=0) >= 0xCA:
        by = np.zeros((len(first), N_SCRIPTS))
        for script in range(1, N_SCRIPTS):
            n = np.concatenate([[0], np.cumsum(_SCRIPT[data] == script)])
            by[:, script] = n[last] - n[first]
        score -= model.barred[np.where(by.sum(1) > 0, by.argmax(1), 0)]
    return score, last - first, np.append(np.searchsorted(first, starts), len(first))


def viterbi(score: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best labels of words in a row, each switch costing the penalty; ties go to the first label and to staying."""
    n, k = score.shape
    back = np.zeros((n, k), dtype=np.int32)
    best = score[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        jump = best[top] - penalty > best
        back[t] = np.where(jump, top, stay)
        best = np.where(jump, best[top] - penalty, best) + score[t]
    out = np.empty(n, dtype=np.int32)
    out[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def labels(score: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The labels that ``viterbi`` gives, by the shortcut where it holds.

    A path of s > 0 switches has s + 1 stretches, 2 s at most, so where no stretch of another
    label gains half a penalty, no path gains what its switches cost.
    """
    top = int(score.sum(0).argmax())
    lead = np.cumsum(score - score[:, top : top + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(lead, axis=0), 0)
    low = np.vstack([np.zeros((1, score.shape[1])), low[:-1]])
    if (lead - low).max() < penalty / 2:
        return np.full(len(score), top, dtype=np.int32)
    return viterbi(score, penalty)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found: list[str] = []
            scores, spans = [], []
            for part in in_chunks(texts, 1 << 19):
                score, size, bounds = word_scores(model, part) if model.langs else (None, None, None)
                for k, text in enumerate(part):
                    if not model.langs or not has_letter(text):
                        found.append("und")
                        scores.append(0.0)
                        spans.append([])
                        continue
                    lo, hi = bounds[k], bounds[k + 1]
                    own = labels(score[lo:hi])
                    weight = np.bincount(own, weights=size[lo:hi], minlength=len(model.langs))
                    top = int(weight.argmax())
                    found.append(model.langs[top])
                    scores.append(float(weight[top] / weight.sum()))
                    turns = np.append(0, np.flatnonzero(np.diff(own)) + 1)
                    spans.append([{"first_word": int(a), "n_words": int(b - a), "lang": model.langs[own[a]]} for a, b in zip(turns, [*turns[1:], len(own)])])
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return run


def language_spans(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its share of the letters) and spans of every row of docs.

    Learns from rows with a lang whose crc32(doc_id) mod 4 is not 2.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = learn(rows.filter(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text"))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(model), f"doc_id long, held_out boolean, lang_pred string, score double, spans {SPANS}")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every row of docs."""
    return language_spans(docs).withColumn("n_spans", F.size("spans")).drop("spans")
