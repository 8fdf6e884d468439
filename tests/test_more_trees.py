"""Best and random trees by level, event trails, resumable chains, drawn orders, comparisons and group pruning."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow import api
from cladeflow.functions import newick, ranking
from cladeflow.functions.clade_table import observe
from cladeflow.functions.undated_model import Rates
from cladeflow.operators import ccp, event_tables, ordering, reconcile, splits, tree_levels
from cladeflow.sources import readers, writers

SPECIES = "((a:1,b:1)ab:1,(c:1,d:1)cd:1)r;"
SAMPLES = {
    "one": ["b_1;"], "two": ["(a_1:1,d_1:2);", "(a_1:2,d_1:2);"], "three": ["(a_1:1,(c_1:2,c_2:1):1);"],
    "five": ["((a_1:1,b_1:1):1,(c_1:2,(d_1:1,a_2:1):1):1);", "((a_1:1,b_1:1):1,(c_1:1,(d_1:1,a_2:1):1):1);", "((a_1:1,c_1:1):1,(b_1:1,(d_1:3,a_2:1):1):1);"],
    "nine": ["((((((((a_1,b_1),c_1),d_1),a_2),b_2),c_2),d_2),a_3);", "((((((((a_1,c_1),b_1),d_1),a_2),b_2),c_2),a_3),d_2);", "(((a_1,c_1),(b_1,d_1)),((a_2,b_2),((c_2,a_3),d_2)));"],
}


@pytest.fixture(scope="module")
def trees(spark):
    return readers.trees_from_strings(spark, SAMPLES)


@pytest.fixture(scope="module")
def facts(trees):
    return splits.split_facts(trees).cache(), splits.families(trees).cache()


def test_best_trees_by_level(facts):
    got = {r["family"]: r for r in tree_levels.best_trees(*facts).collect()}
    assert got.keys() == SAMPLES.keys()
    for name, sample in SAMPLES.items():
        table = observe([(t, 1.0) for t in sample])
        text, p = table.best_tree()
        assert math.exp(got[name]["log_p"]) == pytest.approx(p)
        own, kernel = newick.parse(got[name]["newick"]), newick.parse(text)
        assert sorted(own.leaf_names()) == sorted(kernel.leaf_names())
        if len(table.leaves) > 3:
            assert table.score(got[name]["newick"]) == pytest.approx(table.score(text)) == pytest.approx(math.log(p))
        if name == "five":
            assert newick.robinson_foulds(newick.unroot(own), newick.unroot(kernel)) == 0
            lengths = {x.name: x.length for x in own.leaves()}
            assert lengths == pytest.approx({x.name: x.length for x in kernel.leaves()}, abs=1e-5)


def chi_square(counts: Counter, p: dict) -> float:
    n = sum(counts.values())
    assert set(counts) <= set(p)
    return sum((counts[k] - n * q) ** 2 / (n * q) for k, q in p.items())


def test_random_trees_have_the_tables_shares(facts):
    n = 1500
    drawn = tree_levels.random_splits(*facts, n, seed=4).filter("family IN ('five', 'nine')").collect()
    by: dict[tuple, Counter] = {}
    for r in drawn:
        a, b = sorted(int.from_bytes(r[c], "big") for c in ("left", "right"))
        by.setdefault((r["family"], int.from_bytes(r["clade"], "big")), Counter())[a, b] += 1
    tested = 0
    for name in ("five", "nine"):
        table = observe([(t, 1.0) for t in SAMPLES[name]])
        total = sum(table.bips.values())
        roots: Counter = Counter()
        for g, c in table.bips.items():
            roots[tuple(sorted((g, table.full ^ g)))] += c / total
        assert sum(by[name, 0].values()) == n
        assert chi_square(by[name, 0], roots) < len(roots) + 6 * math.sqrt(2 * len(roots))
        for g, options in table.splits().items():
            counts = by.get((name, g), Counter())
            if sum(counts.values()) >= 50 and len(options) > 1:
                k = len(options) - 1
                assert chi_square(counts, {(a, b): table.p_dip(g, a, b) for a, b, _ in options}) < k + 6 * math.sqrt(2 * k)
                tested += 1
    assert tested >= 4


def test_random_trees_as_text(facts):
    a = {(r["family"], r["tree_no"]): r["newick"] for r in tree_levels.random_trees(*facts, 5, seed=1).collect()}
    b = {(r["family"], r["tree_no"]): r["newick"] for r in tree_levels.random_trees(facts[0].repartition(7), facts[1], 5, seed=1).collect()}
    assert a == b and len(a) == 25
    for (name, _), text in a.items():
        table = observe([(t, 1.0) for t in SAMPLES[name]])
        assert sorted(newick.parse(text).leaf_names()) == table.leaves
        assert len(table.leaves) < 4 or table.score(text) > -math.inf


def test_alias_slots_hold_all_probability(spark):
    rng = np.random.default_rng(0)
    import pandas as pd

    for n in (1, 2, 5, 40):
        p = rng.random(n) ** 3
        pdf = pd.DataFrame({"family": "f", "clade": b"x", "left": [bytes([k]) for k in range(n)], "right": [bytes([k + 100]) for k in range(n)], "p": p})
        t = tree_levels._alias(pdf)
        got = np.zeros(n)
        for r in t.itertuples():
            got[r.left[0]] += r.keep / n
            got[r.other_left[0]] += (1 - r.keep) / n
        assert got == pytest.approx(p / p.sum())


def test_trails_follow_lineages(spark, trees):
    tables = splits.tables(trees).cache()
    rates = Rates(delta=0.2, tau=0.2, lambda_=0.3)
    ev = reconcile.trail_events(tables, SPECIES, rates, n=8, seed=2)
    plain = reconcile.events(reconcile.samples(tables, SPECIES, rates, n=8, seed=2))
    key = lambda rows: sorted(tuple(r[c] for c in ("family", "sample_no", "kind", "branch", "other")) for r in rows)
    rows = ev.collect()
    assert key(rows) == key(plain.collect())
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault((r["family"], r["sample_no"], bytes(r["clade"])), []).append(r)
    for (name, _, clade), own in by.items():
        own.sort(key=lambda r: r["seq"])
        n = len(observe([(SAMPLES[name][0], 1.0)]).leaves)
        bits = int.from_bytes(clade, "big").bit_count()
        assert [r["seq"] for r in own] == list(range(len(own)))
        assert (own[0]["kind"] == "O") == (bits == n) and [r["kind"] for r in own].count("O") == (bits == n)
        assert (own[-1]["kind"] == "C") == (bits == 1) and own[-1]["kind"] in "CSDT"
    trails = {(r["family"], r["sample_no"], bytes(r["clade"])): r["trail"] for r in event_tables.clade_trails(ev).collect()}
    assert trails.keys() == by.keys()
    for k, own in by.items():
        assert trails[k] == " ".join(f"{r['kind']}@{r['branch']}" + (f"->{r['other']}" if r["other"] >= 0 else "") for r in own)


def test_chain_goes_on_where_it_stopped(spark, trees, tmp_path):
    tables = splits.tables(trees.filter("family IN ('two', 'five')")).cache()
    how = {"steps": 30, "burnin": 6, "thin": 4, "seed": 3}
    whole = sorted(map(tuple, reconcile.mcmc(tables, SPECIES, **how).collect()))
    path = str(tmp_path / "chain")
    half = reconcile.mcmc_blocks(tables, SPECIES, path, every=7, **{**how, "steps": 14}).collect()
    assert half and max(r["iteration"] for r in half) < 14
    # A block that was not finished is made anew.
    (tmp_path / "chain" / "from=7-14" / "_SUCCESS").unlink()
    assert sorted(map(tuple, reconcile.mcmc_blocks(tables, SPECIES, path, every=7, **how).collect())) == whole
    chain = reconcile.mcmc_blocks(tables, SPECIES, path, every=7, **how)
    drawn = reconcile.chain_samples(tables, chain, SPECIES, n=2).cache()
    assert drawn.count() == 2 * len(whole) and drawn.select("family", "sample_no").distinct().count() == drawn.count()
    assert {r["family"] for r in writers.consensus_texts(drawn).collect()} == {"two", "five"}
    n = drawn.filter("family = 'five'").count()
    assert event_tables.totals(reconcile.events(drawn.filter("family = 'five'")), n).first()["originations"] == 1


def test_drawn_orders_are_uniform(spark):
    species = "(((l1:1,l2:1)c:1,l3:2)b:1,((l4:1,l5:1)e:1.5,(l6:1,l7:1)f:0.5)d:0.5)a;"
    orders = ordering.draw_orders(spark, species, 1200, seed=5).collect()
    by: dict[int, list] = {}
    for r in sorted(orders, key=lambda r: r["place"]):
        by.setdefault(r["draw"], []).append(r["name"])
    counts = Counter("".join(x) for x in by.values())
    assert len(by) == 1200 and len(counts) == 20
    assert chi_square(counts, dict.fromkeys(counts, 1 / 20)) < 19 + 6 * math.sqrt(38)
    cons = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 2.0), ("d", "c", 0.5), ("e", "b", 4.0), ("x", "a", 9.0)], "older string, younger string, weight double")
    frame = spark.createDataFrame([(k, i, x) for k, o in by.items() for i, x in enumerate(o) if k < 50], "draw long, place int, name string")
    weights = {k: w for k, w in ordering.weights_of(cons).items() if "x" not in k}
    for r in ordering.order_values(cons, frame).collect():
        assert r["value"] == pytest.approx(ranking.violated(by[r["draw"]], weights))
    r = ranking.Ranking.of(species)
    given = r.by_depth()
    at = spark.createDataFrame(list(enumerate(given)), "place int, name string")
    for x in ordering.similarities(species, frame, at).collect():
        assert x["inversions"] == ranking.inversions(by[x["draw"]], given) and x["similarity"] == pytest.approx(ranking.similarity(r, by[x["draw"]], given))
    assert {r["value"] for r in ordering.order_values(cons.limit(0), frame).collect()} == {0.0}


def test_compare_cuts_each_tree_once(spark, trees):
    numbered = trees.filter("family IN ('three', 'five', 'nine')")
    one, two = numbered.filter("tree_no < 3").withColumn("weight", F.col("tree_no") * 1.5), numbered.filter("tree_no > 1")
    got = {(r["family"], r["sample"], r["tree_no"]): (r["log_p_one"], r["log_p_two"]) for r in ccp.compare(one, two).collect()}
    want = {}
    for name in ("three", "five", "nine"):
        s = SAMPLES[name]
        samples = {"one": [(t, 1.5 * (k + 1)) for k, t in enumerate(s) if k < 2], "two": [(t, 1.0) for k, t in enumerate(s) if k > 0]}
        tables = {k: observe(v) for k, v in samples.items() if v}
        for k in samples:
            for t, _ in samples[k]:
                want[name, k, s.index(t) + 1] = tuple(tables[x].score(t) if x in tables else -math.inf for x in ("one", "two"))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = ccp.compare(one.drop("weight"), two)._jdf.queryExecution().toString()
    assert plan.count("MapInPandas") == 0  # the splits are stored


def test_scores_from_nested_tables(spark, trees):
    tables = splits.tables(trees)
    back = splits.facts_of(tables).select(sorted(splits.split_facts(trees).columns)).collect()
    assert sorted(map(str, back)) == sorted(map(str, splits.split_facts(trees).select(sorted(splits.split_facts(trees).columns)).collect()))
    asked = [("five", 1, SAMPLES["five"][2]), ("five", 2, "((a_1,d_1),(c_1,(b_1,a_2)));"), ("five", 3, "((a_1,d_1),(c_1,(b_1,z_2)));"), ("five", 4, "(a_1,b_1);"), ("two", 5, "(d_1,a_1);"), ("one", 6, "b_1;"), ("nine", 7, SAMPLES["nine"][1]), ("none", 8, "(a,b);")]
    got = {r["tree_no"]: r["log_p"] for r in api.score(tables, spark.createDataFrame(asked, "family string, tree_no int, newick string")).collect()}
    want = {k: observe([(t, 1.0) for t in SAMPLES[f]]).score(text) for f, k, text in asked if f in SAMPLES}
    assert got == pytest.approx(want)


def test_groups_cut_each_tree_once(spark, trees, monkeypatch):
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "q"), (2, "c")], "group int, species string")
    rows = splits.keep_groups(trees.filter("family = 'five'"), groups).collect()
    assert Counter(r["group"] for r in rows) == {1: 3, 2: 3} and rows[0].asDict().keys() == {"group", "family", "tree_no", "newick"}
    assert {tuple(sorted(newick.parse(r["newick"]).leaf_names())) for r in rows} == {("a_1", "a_2", "b_1"), ("c_1",)}
    monkeypatch.setattr(splits, "MOST_GROUP_ROWS", 3)
    with pytest.raises(ValueError, match="over 3 rows"):
        splits.keep_groups(trees, groups)


def test_nexus_lines_in_many_splits(spark, tmp_path):
    lines = ["#NEXUS", "begin trees;", " translate", " 1 A_x,", " 2 B_y,", " 3 C_z;", *(f" tree gen.{k} = [&U] ((1:{k},2:1):1,3:1);" for k in range(1, 200)), "end;"]
    (tmp_path / "x.nex").write_text("\n".join(lines))
    (tmp_path / "y.nex").write_text("begin trees;\ntranslate 1 Q;\nUTREE t = (1:7,Z:1);\nend;\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.nexus_trees(spark, [str(tmp_path / f) for f in ("x.nex", "y.nex")], burnin=0, every=1).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {(r["family"], r["tree_no"]): newick.parse(r["newick"]) for r in rows}
    assert len(got) == 200 == len(rows)
    assert all([(x.name, x.length) for x in got["x.nex", k].leaves()] == [("A_x", float(k)), ("B_y", 1.0), ("C_z", 1.0)] for k in range(1, 200))
    assert got["y.nex", 1].leaf_names() == ["Q", "Z"]
