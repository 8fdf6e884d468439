"""Scores of the class model against the formulas of its docstring, word by word."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cladeflow.llm import class_lm
from tests.llm.conftest import corpus

ROWS = corpus()


@pytest.mark.parametrize("frequent", [5, 2048])
def test_scores_by_brute_force(docs, monkeypatch, frequent):
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    monkeypatch.setattr(class_lm, "ROUNDS", 0)  # the classes that the exchange starts from
    end = class_lm.END
    texts = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1, [*(t or "").encode().lower().split(), end]) for d, t, *_ in ROWS]
    count = Counter(w for _, held, words in texts if not held for w in words)

    blocks = class_lm.cut(docs)
    vocabulary = blocks.select("block", "words", "counts").mapInArrow(class_lm._word_rows, class_lm.WORD_ROWS).groupBy("word").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    m = class_lm.fit(blocks, vocabulary)
    assert all(m.core_n[u] == count[w] for w, u in m.core.items())
    near = blocks.select("block", "held", "sizes", "low", "high", "words", "counts").mapInArrow(class_lm._around(m), class_lm.WORD_ROWS + ", around binary").toArrow()
    assert not set(near["word"].to_pylist()) & set(m.core)
    of = {w: int(m.of[u]) for w, u in m.core.items()}
    for batch in class_lm._placed(m)(iter(near.to_batches())) if near.num_rows else ():
        of |= zip(near["word"].to_pylist(), (x >> 1 for x in batch.column("mark").to_pylist()))
    assert set(of) == {w for *_, words in texts for w in words} | {end}

    pairs, into, after, types = Counter(), Counter(), Counter(), Counter(of[w] for w in count)
    for _, held, words in texts:
        if not held:
            for b, w in zip([end, *words], words):
                pairs[of[b], of[w]] += 1
                into[of[w]] += 1
                after[of[b]] += 1
    follow = Counter(b for b, _ in pairs)
    spellings = np.bincount(m.of[len(m.core) :], minlength=class_lm.CLASSES)
    n = sum(into.values())

    def step(b, w):
        b, c = of[b], of[w]
        weight = class_lm.PRIOR + follow[b]
        prior = (into[c] + 0.5) / (n + 0.5 * class_lm.CLASSES)
        emit = (count[w] + 0.5) / (into[c] + 0.5 * (types[c] + spellings[c]))
        return math.log10((pairs[b, c] + weight * prior) / (after[b] + weight)) + math.log10(emit)

    want = sorted((-1 if d is None else d, round(sum(step(b, w) for b, w in zip([end, *words], words)), 6)) for d, _, words in texts)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 6)) for r in class_lm.class_lm(docs).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=2e-6)
