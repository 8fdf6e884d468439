"""Likelihoods level by level, gradients, joint fits, tree search, distributed line numbers and even dealing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import newick
from cladeflow.functions.clade_table import observe, rooted_topologies
from cladeflow.functions.quasi_newton import descend
from cladeflow.functions.species_tree import read_species_tree
from cladeflow.functions.undated_gradient import KINDS, gradient
from cladeflow.functions.undated_model import Rates, layout, likelihood, prepare
from cladeflow.operators import ccp, ordering, prefix, reconcile, scheduling, splits, undated_levels
from cladeflow.sources import readers

SPECIES = "(((a:1,b:1):1,c:2):1,(d:2,e:1):1);"
SAMPLES = {
    "one": ["b_1;"], "two": ["(a_1,d_1);", "(a_1:2,d_1);"], "three": ["(a_1,(c_1,c_2));"], "twins": ["((a_1,a_2),(c_1,d_1));", "((a_1,c_1),(a_2,d_1));"],
    "five": ["((a_1,b_1),(c_1,(d_1,e_1)));", "((a_1,b_1),(c_1,(d_1,e_1)));", "((a_1,c_1),(b_1,(d_1,e_1)));"],
    "wide": ["(" * 11 + "a_00" + "".join(f",{'abcde'[k % 5]}_{k:02d})" for k in range(1, 12)) + ";", "(" * 11 + "a_00" + "".join(f",{'abcde'[k % 5]}_{k:02d})" for k in [2, 1, *range(3, 12)]) + ";"],
}
OPTIONS = ({}, {"tau": 0.0}, {"any_recipient": True, "exact_correction": True}, {"seq_beta": 0.5, "missing": {"b": 0.3}, "scale_lengths": True}, {"by_date": True}, {"min_bip_count": 1.0})


@pytest.fixture(scope="module")
def facts(spark):
    trees = readers.trees_from_strings(spark, SAMPLES)
    return splits.split_facts(trees).cache(), splits.families(trees).cache()


def rates_of(rng, tree, **changes):
    own = {k: {e: float(x) for e, x in enumerate(np.exp(rng.normal(0, 0.4, tree.n)))} for k in KINDS}
    return Rates(**({"delta": 0.2, "tau": 0.3, "lambda_": 0.25, "multipliers": own} | changes))


@pytest.mark.parametrize("k", range(len(OPTIONS)))
def test_levels_equal_the_kernel(facts, k):
    rates = rates_of(np.random.default_rng(k), read_species_tree(SPECIES), **OPTIONS[k])
    want = dict(reconcile.loglik(splits.nest(*facts), SPECIES, rates).collect())
    got = dict(undated_levels.loglik(*facts, SPECIES, rates).collect())
    finite = {f for f in want if want[f] > -600}  # below, the kernel's 80-bit floor decides
    assert got.keys() == want.keys() and len(finite) >= 3
    assert {f: got[f] for f in finite} == pytest.approx({f: want[f] for f in finite}, abs=1e-8)


def test_levels_in_pieces(facts, monkeypatch):
    """A clade's splits in many batches and tasks give the same sums."""
    spark = facts[0].sparkSession
    monkeypatch.setattr(undated_levels, "BATCH_BYTES", 1000)
    want = dict(reconcile.loglik(splits.nest(*facts), SPECIES).collect())
    try:
        assert dict(undated_levels.loglik(*facts, SPECIES).collect()) == pytest.approx(want, abs=1e-8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_levels_name_unknown_species(facts):
    with pytest.raises(Exception, match="species not in the tree"):
        undated_levels.loglik(*facts, "((a:1,b:1):1,c:1);").collect()


@pytest.mark.parametrize("k", range(5))
def test_gradient_is_the_finite_difference(k):
    tree = read_species_tree(SPECIES)
    rates = rates_of(np.random.default_rng(k), tree, **OPTIONS[k])
    families = [layout(observe([(t, 1.0) for t in trees]), rates) for name, trees in SAMPLES.items() if name != "wide"]
    total = lambda r: sum(likelihood(f, prepare(tree, r)).log_likelihood for f in families)
    value, got = gradient(families, tree, rates)
    assert value == pytest.approx(total(rates))
    h = 1e-5
    for i, name in enumerate(("delta", "tau", "lambda_")):
        x = getattr(rates, name)
        if x:
            assert got["rates"][i] == pytest.approx((total(rates.of(**{name: x + h})) - total(rates.of(**{name: x - h}))) / (2 * h), abs=1e-6)
    for kind in KINDS:
        for e in range(tree.n):
            at = lambda d: total(rates.of(multipliers={**rates.multipliers, kind: {**rates.multipliers[kind], e: rates.multipliers[kind][e] + d}}))  # noqa: B023, E731
            assert got[kind][e] == pytest.approx((at(h) - at(-h)) / (2 * h), abs=1e-6)


def test_descent_finds_the_corner_and_the_valley():
    low, high = np.full(3, 1e-3), np.full(3, 100.0)
    valley = lambda x: (math.log(x[0] / 2) ** 2 + 10 * (math.log(x[1]) - math.log(x[0])) ** 2 + x[2], np.array([2 * math.log(x[0] / 2) / x[0] - 20 * math.log(x[1] / x[0]) / x[0], 20 * math.log(x[1] / x[0]) / x[1], 1.0]))
    x, value, _ = descend(lambda points: [valley(p) for p in points], np.array([50.0, 0.01, 3.0]), low, high)
    assert x == pytest.approx([2, 2, 1e-3], rel=1e-3) and value == pytest.approx(1e-3, abs=1e-6)


def test_joint_fit_beats_one_by_one(spark):
    rng = np.random.default_rng(5)
    names = "abcde"
    trees = {}
    for k in range(6):
        genes = [f"{names[i]}_{j}" for j, i in enumerate(sorted(rng.choice(5, 5)))]
        parts = list(genes)
        while len(parts) > 1:
            i, j = sorted(rng.choice(len(parts), 2, replace=False).tolist())
            b, a = parts.pop(j), parts.pop(i)
            parts.append(f"({a},{b})")
        trees[f"f{k}"] = [parts[0] + ";"]
    tables = splits.tables(readers.trees_from_strings(spark, trees)).cache()
    _, one_by_one = reconcile.fit_branchwise(tables, SPECIES, rounds=3)
    rates, joint = reconcile.fit_joint(tables, SPECIES, rounds=25)
    assert joint > one_by_one + 1.0
    assert joint == pytest.approx(reconcile.loglik(tables, SPECIES, rates).agg(F.sum("logl")).first()[0], abs=1e-6)


def test_search_finds_the_best_of_all_trees(spark, monkeypatch):
    names = list("abcdef")
    truth = "(((a:1,b:1):1,(c:1,d:1):1):1,(e:1,f:1):1);"
    gene = "(((a_1,b_1),(c_1,d_1)),(e_1,f_1));"
    trees = {"f0": [gene], "f1": [gene.replace("f_1", "b_2")], "f2": ["((a_1,b_1),((c_1,d_1),e_1));"], "f3": [gene, "(((a_1,b_1),c_1),(d_1,(e_1,f_1)));"]}
    tables = splits.tables(readers.trees_from_strings(spark, trees)).cache()
    rates, rows = Rates(), [r.asDict(recursive=True) for r in tables.collect()]
    families = [layout(splits.of_row(r), rates) for r in rows]
    total = lambda t: sum(likelihood(f, prepare(read_species_tree(t), rates)).log_likelihood for f in families)
    best = max(total(t) for t in rooted_topologies(names))
    jobs = []
    real = reconcile.loglik_trees
    monkeypatch.setattr(reconcile, "loglik_trees", lambda *a: jobs.append(len(a[1])) or real(*a))
    found, value = reconcile.search_species_tree(tables, "(((a:1,e:1):1,(c:1,f:1):1):1,(b:1,d:1):1);", rates, n_samples=3, tries=10)
    assert value == pytest.approx(best, abs=1e-6) and total(found) == pytest.approx(value, abs=1e-6)
    assert value >= total(truth) - 1e-9
    assert len(jobs) <= 14 and max(jobs) > 10  # all trees of a round in one job


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files cut into many splits, two of them of one name, with blank lines, windows line ends and no last line end."""
    text = {}
    for k, (folder, end) in enumerate((("x", "\n"), ("y", "\r\n"), ("z", "\n"))):
        lines = [f"(a_{k},b_{j:04d});" if j % 5 else ("" if j % 10 else "note") for j in range(1200)]
        (tmp_path / folder).mkdir()
        name = "same.trees" if k < 2 else "other.trees"
        (tmp_path / folder / name).write_bytes(end.join(lines).encode())
        text[folder] = lines
    paths = [str(tmp_path / f) for f in text]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = readers.numbered_lines(spark, paths)
        assert lines.select("path", "split").distinct().count() > 15
        got = sorted((r["path"].split("/")[-2], r["line_no"], r["line"]) for r in lines.collect())
        assert got == sorted((f, j, x) for f, ls in text.items() for j, x in enumerate(ls))
        of = F.regexp_extract("path", r"/(\w)/[^/]*$", 1)
        rows = readers.tree_samples(spark, paths, family=of, burnin=100, every=7).collect()
        want = {(f, j + 1, t) for f, ls in text.items() for j, t in enumerate(x for x in ls if "(" in x) if j + 1 > 100 and (j + 1) % 7 == 0}
        assert {(r["family"], r["tree_no"], r["newick"]) for r in rows} == want and len(rows) == len(want)
        # until counts over all files of a family, in their order.
        some = readers.tree_samples(spark, paths, family=F.lit("all"), burnin=900, every=3, until=40).collect()
        every = [(f, j + 1) for f in ("z", "x", "y") for j, t in enumerate(x for x in text[f] if "(" in x) if j + 1 > 900 and (j + 1) % 3 == 0]
        assert len(some) == 40 == len({(r["file"], r["newick"]) for r in some})
        names = {"z": "other.trees", "x": "same.trees", "y": "same.trees"}
        assert sorted((r["file"], r["tree_no"]) for r in some) == sorted((names[f], j) for f, j in every[:40])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 30)), k, None if k % 9 == 0 else float(rng.integers(0, 5))) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, k int, v double")
    got = {r["k"]: (r["before"], r["rank"]) for r in prefix.with_running(df, [F.desc("a"), F.col("k")], {"before": "v"}, "rank").collect()}
    total, want = 0.0, {}
    for n, (_, k, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1]))):
        want[k] = (total, n + 1)
        total += v or 0.0
    assert got == want
    assert prefix.with_running(df.limit(0), [F.col("a")], {"before": "v"}).collect() == []


@pytest.mark.parametrize(("n", "machines"), [(0, 3), (5, 8), (100, 8), (3000, 8), (100_000, 16)])
def test_even_dealing(spark, n, machines):
    t = spark.range(n).select(F.col("id").cast("string").alias("file"), F.when(F.col("id") % 50 != 49, F.exp(F.randn(3) * 1.5)).alias("time"))
    rows = t.collect()
    packed = scheduling.deal(spark.createDataFrame(rows, t.schema), machines)
    got = packed.collect()
    assert sorted(r["file"] for r in got) == sorted(r["file"] for r in rows)
    if n >= 3000:
        loads = np.array([r["load"] for r in scheduling.loads(packed).collect()])
        assert len(loads) == machines and np.abs(loads / loads.mean() - 1).max() < 0.01
    if n == 100:
        again = scheduling.deal(spark.createDataFrame(rows, t.schema).repartition(3), machines).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_light_cut_over_ranges(spark):
    rows = [("a", "b", 3.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "d", 2.0), ("d", "e", 3.0)]
    kept = ordering.cut_light(spark.createDataFrame(rows, "older string, younger string, weight double"), 0.3).collect()
    assert {(r[0], r[1]) for r in kept} == {("a", "b"), ("d", "e")}  # 1, 1 and 2 of 10 come before 30 %


def test_recompose_is_the_kernel(facts, spark):
    trees = readers.trees_from_strings(spark, {k: v for k, v in SAMPLES.items() if k in ("five", "twins", "wide")})
    got = {(r["family"], r["tree_no"], int.from_bytes(r["clade"], "big")): r["log_p"] for r in ccp.recompose(trees, *facts).collect()}
    want = {}
    for name in ("five", "twins", "wide"):
        t = observe([(x, 1.0) for x in SAMPLES[name]])
        for k, x in enumerate(SAMPLES[name]):
            want |= {(name, k + 1, g): math.log(p) for g, p in t.recompose(x).items()}
    assert got == pytest.approx(want, abs=1e-9)
    other = spark.createDataFrame([("five", 9, "((a_1,e_1),(c_1,(d_1,b_1)));")], "family string, tree_no int, newick string")
    assert any(r["log_p"] == float("-inf") for r in ccp.recompose(other, *facts).collect())
    assert newick.parse(SAMPLES["five"][0]).leaf_names()


def test_closure_by_doubling(spark):
    rng = np.random.default_rng(8)
    n = 90
    parent = [None, *(int(rng.integers(max(0, k - 3), k)) for k in range(1, n))]  # deep and narrow
    rows = spark.createDataFrame(list(enumerate(parent)), "name int, parent int")
    want = set()
    for k in range(n):
        at = k
        while at is not None:
            want.add((at, k))
            at = parent[at]
    got = [tuple(r) for r in ordering.closure(rows).select("above", "below").collect()]
    assert set(got) == want and len(got) == len(want)
    assert [tuple(r) for r in ordering.closure(spark.createDataFrame([("r", None)], "name string, parent string")).collect()] == [("r", "r")]
    with pytest.raises(ValueError, match="own ancestors"):
        ordering.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "name int, parent int"))
