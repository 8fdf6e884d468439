"""Rank-file encoding, dominance counts and importance resampling against the library, brute force and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from cladeflow.llm import dominance, queries, rank_bpe, resample
from cladeflow.llm.tokens import vocabulary_path
from tests.llm.conftest import SCHEMA, corpus
from tests.llm.test_text_operators import key, run

ROWS = corpus()


# --- rank files ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return rank_bpe.RankCoder(vocabulary_path(rank_bpe.RANKS), rank_bpe.default_pattern())


def coded(coder, text):
    ids = coder.coder.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_digests_equal_the_library(docs, clashing, empty, coder):
    want = key([(r[0], *coded(coder, r[1] or "")) for r in ROWS])
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert run(rank_bpe.rank_digests(docs), columns) == want
    assert run(rank_bpe.rank_digests(clashing), columns) == want
    assert rank_bpe.rank_digests(empty).collect() == []


def test_ids_and_raw_bytes(docs, coder):
    ids = rank_bpe.rank_ids(docs)
    assert key([(r[0], tuple(r[1])) for r in ids.collect()]) == key([(r[0], tuple(coder.coder.encode_ordinary(r[1] or ""))) for r in ROWS])
    assert run(rank_bpe.decode_ids(ids), ["doc_id", "decoded"]) == key([(r[0], bytearray((r[1] or "").encode())) for r in ROWS])


def test_ids_cut_within_a_character_decode_to_raw_bytes(spark, coder):
    ids = coder.coder.encode_ordinary("\U0001f9ff")
    assert len(ids) > 1
    rows = spark.createDataFrame([(1, ids[:1]), (2, ids[1:]), (3, None)], "doc_id long, ids array<int>")
    got = {r[0]: r[1] for r in rank_bpe.decode_ids(rows).collect()}
    assert bytes(got[1] + got[2]).decode() == "\U0001f9ff" and got[3] is None
    with pytest.raises(UnicodeDecodeError):
        bytes(got[1]).decode()


ODD = ["it's a 'test' x'll 'S don't", "a1b2 c33,d.. e  \n\n f\x85g\xa0h\x1ci　j", "漢字。かな、test「x」 ok", " lead  and trail   ", "x'", "1's 2'll ' 's", "ééé!!!\n\n\n   a", "áb é!"]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_parts_have_the_matches_of_the_whole(coder, size):
    rng = np.random.default_rng(size)
    signs = list("ab1' \n.,;sté漢。　\x1c")
    for text in [*ODD, *("".join(rng.choice(signs, 40)) for _ in range(150))]:
        parts = list(coder.parts(text, size))
        assert "".join(parts) == text
        assert [m for p in parts for m in coder.match.findall(p)] == coder.match.findall(text)
        whole = coder.coder.encode_ordinary(text)
        assert [i for p in parts for i in coder.ids(p, 10**9).tolist()] == whole
        assert [i for p in parts for i in coder.ids(p, 0).tolist()] == whole


def test_long_runs(coder):
    for text in ("a" * 300_000, "x" + " " * 1_500_000 + "y", "\n" * 200_000, "%" * 300_000, "漢" * 200_000, "word " * 60_000):
        parts = list(coder.parts(text))
        ids = [coder.ids(p) for p in parts]
        assert b"".join(coder.decode(i.tolist()) for i in ids) == text.encode()
    # The merges of one long match are those of the library, which finds it by itself up to some length.
    assert coder.ids("b" * 150_000).tolist() == coder.coder.encode_ordinary("b" * 150_000)


# --- dominance -----------------------------------------------------------------------------


def brute_above(points):
    """Of (slot, level, weight): the counts of each, point by point."""
    out = []
    for slot, level, _ in points:
        if slot is None or level is None:
            out.append((None, None))
            continue
        found = [w for s, x, w in points if s is not None and x is not None and s <= slot and x > level]
        out.append((len(found), sum(w or 0 for w in found)))
    return out


def points_of(kind, n, rng):
    if kind == "one slot":
        pairs = [(5, int(x)) for x in rng.integers(-50, 50, n)]
    elif kind == "one level":
        pairs = [(int(x), 3) for x in rng.integers(-50, 50, n)]
    elif kind == "hot cell":
        pairs = [(int(rng.integers(0, 9)), int(rng.integers(0, 9))) if k % 3 else (4, 4) for k in range(n)]
    else:
        pairs = [(None if x > 47 else int(x), None if y > 47 else int(y)) for x, y in rng.integers(-50, 50, (n, 2))]
    return [(*p, None if k % 50 == 0 else k % 4) for k, p in enumerate(pairs)]


@pytest.mark.parametrize("kind", ["one slot", "one level", "hot cell", "spread"])
@pytest.mark.parametrize("cells", [1, 1 << 14])
def test_dominance_by_brute_force(spark, monkeypatch, kind, cells):
    monkeypatch.setattr(dominance, "SHARD_CELLS", cells)
    monkeypatch.setattr(dominance, "HOT_SHARE", 1 / 20)
    points = points_of(kind, 400, np.random.default_rng(cells))
    rows = [(k, *p, "x", "y") for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, s long, l long, weight int, n string, shard string")
    from pyspark.sql import functions as F

    got = {r["id"]: (r["n_above"], r["w_above"]) for r in dominance.dominance_counts(df, F.col("s"), F.col("l"), F.col("weight"), ["id"]).collect()}
    assert [got[k] for k in range(len(rows))] == brute_above(points)
    none = dominance.dominance_counts(df.limit(0), F.col("s"), F.col("l"), F.col("weight"), ["id"])
    assert none.columns == ["id", "slot", "level", "n_above", "w_above"] and none.collect() == []


def test_versions_of_the_tree_stay():
    rng = np.random.default_rng(0)
    tree, sums = dominance.PersistentTree(37, 400), [np.zeros((37, 2), np.int64)]
    for _ in range(20):
        at = np.sort(rng.choice(37, rng.integers(1, 20), replace=False))
        values = rng.integers(1, 9, (len(at), 2))
        tree.add(at, values)
        sums.append(sums[-1].copy())
        sums[-1][at] += values
    for version, flat in enumerate(sums):
        got = tree.above(np.full(37, version), np.arange(37))
        assert (got == [flat[k + 1 :].sum(axis=0) for k in range(37)]).all()


SALES = "sale_id long, total double, sold_at timestamp_ntz, slot string, n_rows int"


def sales_rows():
    rng, start = np.random.default_rng(3), datetime(1969, 12, 28)
    rows = [(k, float(np.round(rng.lognormal(4, 1), 2)), start + timedelta(seconds=int(rng.integers(0, 86400 * 9)), microseconds=int(rng.integers(0, 10**6))), "x", 1) for k in range(300)]
    rows += [rows[0], rows[0], (None, 5.0, start, None, None), (400, None, start, None, None), (401, 3.0, None, None, None), (402, float("nan"), start, None, None), (403, float("inf"), start, None, None), (404, -7.005, start, None, None), (405, 1e300, start, None, None), (406, 9.995, datetime(1969, 12, 31, 23, 59, 59, 999999), None, None), (407, 1e14 + 0.125, start, None, None)]
    return rows


def test_sales_in_any_zone(spark):
    rows = sales_rows()
    points = []
    for sale, total, at, *_ in rows:
        slot = None if at is None else math.floor(math.floor((at - datetime(1970, 1, 1)) / timedelta(seconds=1)) / 86400)
        level = None if total is None or not math.isfinite(total) or total > 1e30 else math.floor(math.floor(100 * total + 0.5) / 1000)
        points.append((slot, level, 1 + zlib.crc32(b"" if sale is None else str(sale).encode()) % 3))
    want = key([(r[0], p[0], p[1], *c) for r, p, c in zip(rows, points, brute_above(points))])
    zone = spark.conf.get("spark.sql.session.timeZone")
    for other in ("UTC", "Pacific/Auckland", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", other)
        try:
            df = spark.createDataFrame(rows, SALES)
            assert run(dominance.sales_above(df), ["sale_id", "slot", "level", "n_sales", "n_rows"]) == want
            instants = df.withColumn("sold_at", (df.sold_at.cast("string")).cast("timestamp"))
            if other == "UTC":
                assert run(dominance.sales_above(instants), ["sale_id", "slot", "level", "n_sales", "n_rows"]) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)


# --- resampling ----------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, n=2, buckets=10_000, least=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    of_docs, of_target = Counter(), Counter()
    for _, text, *_ in rows:
        of_docs.update(map(bucket, runs(text, n)[1]))
    for text in target:
        of_target.update(map(bucket, runs(text, n)[1]))
    big_s, big_t = sum(of_docs.values()), sum(of_target.values())
    gain = {b: math.floor(1000 * math.log((of_target[b] + 1) * (big_s + buckets) / ((of_docs[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for doc, text, *_ in rows:
        words, feats = runs(text, n)
        weight = sum(gain[bucket(f)] for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return key([(*r[:4], ranks.get(id(r))) for r in out])


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]
TARGET = ["A river of Stone, and the GARDEN house", None, "", "winter light winter light — über naïve 42", "the river"]


@pytest.mark.parametrize(("size", "n"), [(1 << 15, 2), (100, 2), (1, 2), (64, 3), (37, 1)])
def test_resample_by_brute_force(spark, docs, clashing, size, n):
    target = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TARGET)], "item_id int, text string, row string")
    want = brute_resample(ROWS, TARGET, n)
    assert run(resample.importance_resample(docs, target, n=n, size=size), COLUMNS) == want
    if n == 2 and size == 100:
        assert run(resample.importance_resample(clashing, target, size=size), COLUMNS) == want


def test_resample_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id int, text string")
    assert resample.importance_resample(empty, none).collect() == []
    assert run(resample.importance_resample(docs, none), COLUMNS) == brute_resample(ROWS, [])


def test_chunks_own_each_start_once():
    text = "É one,two  three_four five 66 seven—eight nine ten".encode()
    for size in range(1, 60):
        for n in (1, 2, 3):
            got = [Counter() for _ in range(n)]
            for own, carried in resample.cut(text, size, n):
                for k, found in enumerate(resample.features(own, carried, n)[1]):
                    got[k].update(found)
            assert got == [Counter(f) for f in resample.features(text, b"", n)[1]]


@pytest.mark.parametrize("name", ["op12_dominance_counts", "op13_importance_resample"])
def test_sql_agrees(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "sales"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    assert run(queries.queries()[name](spark, sf), found.columns) == key(found.fetchall())


def test_many_findings_are_masked_in_one_pass():
    import time

    from cladeflow.llm import secrets

    scanner = secrets.Scanner(None, None)
    text = b"key = 0123456789abcdef0123456789abcdef\n" * 200_000
    spans = [(39 * k + 6, 39 * k + 38, 1.0 if k % 2 else 0.0) for k in range(200_000)]
    began = time.perf_counter()
    got = scanner.redact(text, spans)
    assert time.perf_counter() - began < 2
    one = b"key = 0123456789abcdef0123456789abcdef\n"
    assert got == (one + b"key = " + secrets.MASK.encode() + b"\n") * 100_000
    assert scanner.redact(text, []) == text
