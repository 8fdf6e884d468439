"""Neighbours of words travel once for all sweeps of the exchange, whole and exact; words are cut as Python cuts them."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cladeflow.llm import class_lm
from tests.llm.conftest import corpus
from tests.llm.test_class_exchange import END, _training


def test_words_are_shuffled_once_for_all_sweeps(docs, monkeypatch):
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(class_lm, "FREQUENT", 5)
    calls = Counter()

    def counted(name, plain):
        def run(*a):
            calls[name] += 1
            return plain(*a)

        return run

    for name in ("_word_counts", "sweep"):
        monkeypatch.setattr(class_lm, name, counted(name, getattr(class_lm, name)))
    class_lm.learn(docs)
    assert calls["sweep"] > 1 and calls["_word_counts"] == 1


@pytest.mark.parametrize("fan, row_near", [(2, 5), (64, 1 << 17)])
def test_neighbours_by_recounting(docs, monkeypatch, fan, row_near):
    for name, value in (("BLOCK_BYTES", 4000), ("FREQUENT", 5), ("ROUNDS", 0), ("MOST_SLICES", 3), ("SLICE", 2), ("FAN", fan), ("ROW_NEAR", row_near)):
        monkeypatch.setattr(class_lm, name, value)
    joined, model, of, cc, _ = class_lm.learn(docs)
    end = int(model.of[model.core[END]])
    names = {r["block"]: r["words"] for r in class_lm.cut(docs).select("block", "words").collect()}
    code = {}
    for r in joined.select("block", "ids", "own").collect():
        for w, i, k in zip(names[r["block"]], np.frombuffer(r["ids"], dtype="<i4").tolist(), r["own"]):
            code[bytes(w)] = i + class_lm.CLASSES if i > 0 else k
    assert code[END] == end
    want = defaultdict(Counter)
    for words in _training(corpus()):
        for b, w in zip([END, *words], words):
            b, w = code[b], code[w]
            if w >= class_lm.CLASSES:
                want[w - class_lm.CLASSES][2 * b] += 1
            if b >= class_lm.CLASSES and b != w:
                want[b - class_lm.CLASSES][2 * w + 1] += 1
    near = class_lm.neighbours(joined, of, end, joined.count())
    got, met = {}, 0
    for r in near.collect():
        place, starts, codes, n = class_lm._near_of(bytes(r["counts"]))
        assert len(codes) <= row_near or len(place) == 1
        for i, w in enumerate((r["slice"] + place * class_lm.n_slices(len(of))).tolist()):
            part, met = slice(starts[i], starts[i + 1]), met + 1
            got[w] = Counter(dict(zip(codes[part].tolist(), n[part].tolist())))
    assert met == len(got) and got == want
    own = class_lm.count_pairs(near, class_lm._near_pairs([of, of]), 2)
    assert (own[0] == own[1]).all() and 0 < own[0].sum() <= cc.sum() and (own[0] <= cc).all()


@pytest.mark.parametrize("long", [0, 2, 64])
def test_row_sums(monkeypatch, long):
    monkeypatch.setattr(class_lm, "LONG", long)
    rng = np.random.default_rng(3)
    sizes = np.array([0, 5, 1, 0, 3, 70])
    starts = np.append(0, np.cumsum(sizes))
    table, index, weights = rng.random((9, 4)), rng.integers(0, 9, starts[-1]), rng.random(starts[-1])
    for w in (None, weights):
        want = [sum((table[index[i]] * (1 if w is None else w[i]) for i in range(a, b)), np.zeros(4)) for a, b in zip(starts[:-1], starts[1:])]
        assert np.allclose(class_lm.row_sums(table, index, starts, w), want)


@pytest.mark.parametrize("texts", [[b""], [b" \t", b""], [b"A b\x0ba", b"", b" \xff\xfe A\x1cB\x00 \xc3\x89 ", b"\xc2\xa0x\n\rY\x0c"]])
def test_words_of_a_block(texts):
    block = class_lm._Block()
    for i, text in enumerate(texts):
        block.add(i, False, text)
    words, codes, sizes = block.coded()
    words = words.to_pylist()
    want = [[*t.lower().split(), END] for t in texts]
    assert [words[c] for c in codes] == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
    assert len(set(words)) == len(words) and words[0] == END
    assert class_lm.units(pa.array(words, pa.binary()).slice(1), {END: 0}).tolist() == class_lm.units(words, {END: 0}).tolist()[1:]
