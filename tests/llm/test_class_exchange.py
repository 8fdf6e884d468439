"""The exchange over all words: gains, sweeps and numbers of words against plain recounting."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cladeflow.llm import class_lm
from tests.llm.conftest import corpus

END = class_lm.END


def _training(rows):
    return [[*(t or "").encode().lower().split(), END] for d, t, *_ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]


def _pairs(texts, of):
    cc = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
    for words in texts:
        for b, w in zip([END, *words], words):
            cc[of[b], of[w]] += 1
    return cc


@pytest.mark.parametrize("small", [1, 3, 16])
def test_gains_are_differences_of_likelihood(monkeypatch, small):
    monkeypatch.setattr(class_lm, "SMALL", small)
    rng = np.random.default_rng(1)
    names = [END, *(f"w{i}".encode() for i in range(12))]
    texts = [[names[i] for i in rng.integers(1, 13, 30)] + [END] for _ in range(8)]
    of = {w: int(rng.integers(5)) for w in names} | {END: 5}
    at = {w: i for i, w in enumerate(names)}
    counts = np.zeros((13, class_lm.CELLS), dtype=np.int64)
    for words in texts:
        for b, w in zip([END, *words], words):
            if b == w:
                counts[at[w], class_lm.SLOTS] += 1
            else:
                counts[at[w], of[b]] += 1
                counts[at[b], class_lm.CLASSES + of[w]] += 1
    cc = _pairs(texts, of)
    got = class_lm.gains(counts[1:], np.array([of[w] for w in names[1:]]), cc, class_lm.differences(cc))
    for i, w in enumerate(names[1:]):
        for k in range(8):
            change = class_lm.likelihood(_pairs(texts, of | {w: k})) - class_lm.likelihood(cc)
            assert got[i, k] - got[i, of[w]] == pytest.approx(change, abs=1e-8)


def _final(docs):
    joined, model, of, cc, values = class_lm.learn(docs)
    rows = joined.select("block", "ids", "own").collect()
    words = {r["block"]: r["words"] for r in class_lm.cut(docs).select("block", "words").collect()}
    numbers, classes = {}, {}
    for r in rows:
        ids, own = np.frombuffer(r["ids"], dtype="<i4"), np.frombuffer(r["own"], dtype=np.uint8)
        for w, i, k in zip(words[r["block"]], ids.tolist(), own.tolist()):
            if i >= 0:
                assert numbers.setdefault(bytes(w), i) == i
            assert classes.setdefault(bytes(w), int(of[i]) if i >= 0 else k) == (int(of[i]) if i >= 0 else k)
    return model, of, cc, values, numbers, classes


@pytest.mark.parametrize("fan", [2, 64])
def test_sweeps_of_a_corpus(docs, monkeypatch, fan):
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(class_lm, "FREQUENT", 5)
    monkeypatch.setattr(class_lm, "FAN", fan)
    texts = _training(corpus())
    count = Counter(w for words in texts for w in words)
    model, of, cc, values, numbers, classes = _final(docs)
    # Every word of two tokens or more has a number of its own, whichever of the small core took its place.
    assert {w for w, n in count.items() if n >= class_lm.LEAST} <= set(numbers)
    assert sorted(numbers.values()) == list(range(len(of)))
    assert values == sorted(values) and len(set(values)) == len(values) > 1
    assert (cc == _pairs(texts, classes)).all()
    assert values[-1] == pytest.approx(class_lm.likelihood(cc))
    assert [w for w, k in classes.items() if k == int(model.of[model.core[END]])] == [END]


def test_a_sweep_finds_the_best_class_of_each_word(docs, monkeypatch):
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(class_lm, "FREQUENT", 5)
    monkeypatch.setattr(class_lm, "ROUNDS", 0)
    texts = _training(corpus())
    joined, model, of, cc, _ = class_lm.learn(docs)
    end = int(model.of[model.core[END]])
    to = class_lm.sweep(joined, of, cc, end, joined.count())
    _, _, _, _, numbers, classes = _final(docs)
    near = defaultdict(Counter)
    for words in texts:
        for b, w in zip([END, *words], words):
            near[w][b, w] += 1
            near[b][b, w] += b != w

    def value(w, k):
        own = classes | {w: k}
        m = cc.copy()
        for (b, x), n in near[w].items():
            m[classes[b], classes[x]] -= n
            m[own[b], own[x]] += n
        return class_lm.likelihood(m)

    for w in sorted(numbers)[:40]:
        if w != END:
            all_ = [value(w, k) if k != end else -np.inf for k in range(class_lm.CLASSES)]
            assert all_[to[numbers[w]]] == pytest.approx(max(all_), abs=1e-6)


def test_least_count_doubles(docs, monkeypatch):
    monkeypatch.setattr(class_lm, "FREQUENT", 5)
    monkeypatch.setattr(class_lm, "MOST_WORDS", 20)
    count = Counter(w for words in _training(corpus()) for w in words)
    _, _, _, values, numbers, _ = _final(docs)
    assert values == sorted(values)
    least = next(2 << i for i in range(50) if sum(n >= 2 << i for n in count.values()) <= 20)
    assert {w for w, n in count.items() if n >= least} <= set(numbers) and len(numbers) <= 26


def test_rows_of_counts_grow_with_blocks_alone(docs, monkeypatch):
    """However many words there are, a block has at most MOST_SLICES rows of counts, and sweeps find the same classes."""
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(class_lm, "FREQUENT", 5)
    monkeypatch.setattr(class_lm, "ROUNDS", 0)
    joined, model, of, cc, _ = class_lm.learn(docs)
    end, n_blocks = int(model.of[model.core[END]]), joined.count()
    want = class_lm.sweep(joined, of, cc, end, n_blocks)
    for name, value in (("SLICE", 2), ("MOST_SLICES", 3), ("FAN", 2)):
        monkeypatch.setattr(class_lm, name, value)
    rows = joined.select(*class_lm.TOKENS).mapInArrow(class_lm._word_counts(of, end), "slice int, block long, counts binary")
    assert len(of) > 6 and rows.count() <= 3 * n_blocks
    assert (class_lm.sweep(joined, of, cc, end, n_blocks) == want).all()
