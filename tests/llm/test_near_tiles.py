"""Near-dedup where buckets are large, rows repeat and one text template holds many documents apart."""

import random

import pytest

from cladeflow.llm import near_dedup as near
from tests.llm.conftest import prose


def shingles(text, width):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width):
    """The least doc_id that links reach from each document."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    of = {d: d for d, _ in rows}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = root(d), root(e)
                of[max(a, b)] = min(a, b)
    return {d: root(d) for d in of}


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"w{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("tile", [4, 2048])
def test_template_with_many_members(spark, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE", tile)
    rng = random.Random(3)
    rows, k = [], 0
    for group in range(3):
        words = [f"{w}{group}{i % 7}" for i, w in enumerate(prose(rng, 90).split())]
        for _ in range(40):
            rows.append((k, edited(rng, words, rng.randint(0, 6))))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_dedup(docs, 5, 80).collect()}
    want = brute(rows, 5)
    assert got == want
    assert 3 < len(set(want.values())) < len(rows)


def test_rows_that_repeat_are_compared_once(spark):
    rng = random.Random(4)
    words = prose(rng, 100).split()
    texts = [" ".join(words), " ".join([*words[:-3], "x", "y", "z"])]
    docs = spark.createDataFrame([(k % 2, texts[k % 2]) for k in range(3000)], "doc_id long, text string")
    got = near.near_dedup(docs, 5, 80).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, True, 1500), (1, 0, False, 1500)]
