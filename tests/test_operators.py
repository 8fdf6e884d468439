"""Spark operators: sources, sinks, tables, models, constraints, schedules and streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import newick, ranking, simulator
from cladeflow.functions.clade_table import observe
from cladeflow.functions.dated_model import DatedRates
from cladeflow.functions.species_tree import read_species_tree
from cladeflow.functions.undated_model import Rates
from cladeflow.operators import ccp, dated, event_tables, ordering, reconcile, scheduling, simulate, species, splits, tree_tools
from cladeflow.sources import posterior_text, readers, writers
from cladeflow.streaming import split_stream

SPECIES = "((a:1,b:1)ab:1,(c:1,d:1)cd:1)r;"
TREES = {"f1": ["((a_1:1,b_1:1):1,(c_1:1,d_1:1):1);", "((a_1:1,c_1:1):1,(b_1:1,d_1:1):1);", "((a_1:1,b_1:1):1,(c_1:1,d_1:1):1);"], "f2": ["(a_1:1,c_1:1);"], "f3": ["b_9;"]}


@pytest.fixture(scope="module")
def trees(spark):
    return readers.trees_from_strings(spark, TREES)


@pytest.fixture(scope="module")
def tables(spark, trees):
    return splits.tables(trees).cache()


def test_facts_equal_direct_observation(spark):
    rng = np.random.default_rng(0)
    names = [f"g{k:02d}" for k in range(70)]  # more leaves than a long has bits
    sample = [simulator.random_tree(names, rng) for _ in range(4)]
    got = splits.of_row(splits.tables(readers.trees_from_strings(spark, {"x": sample})).first().asDict(recursive=True))
    want = observe([(t, 1.0) for t in sample])
    assert (got.leaves, got.observations, got.bips, got.dips) == (want.leaves, want.observations, want.bips, want.dips)
    assert got.lengths == pytest.approx(want.lengths)


def test_one_exchange_serves_splits_and_clades(trees):
    plan = splits.bips(splits.split_facts(trees))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scores_counts_and_best(spark, trees, tables):
    t3 = trees.filter("family = 'f1'")
    facts, fams = splits.split_facts(t3), splits.families(t3)
    got = {r["tree_no"]: math.exp(r["log_p"]) for r in ccp.score_trees(t3, facts, fams).collect()}
    assert got == pytest.approx({1: 2 / 3, 2: 1 / 3, 3: 2 / 3})
    tops = {r["n_trees"]: (r["share"], math.exp(r["log_p"])) for r in ccp.scored_topologies(t3).collect()}
    assert tops == {2: (pytest.approx(2 / 3), pytest.approx(2 / 3)), 1: (pytest.approx(1 / 3), pytest.approx(1 / 3))}
    best = {r["family"]: r for r in ccp.best_trees(tables).collect()}
    assert best["f1"]["p"] == pytest.approx(2 / 3) and best["f3"]["newick"] == "b_9;"
    assert {r["family"]: r["n_trees"] for r in ccp.count_trees(tables).collect()}["f1"] == 10
    top = splits.topologies(t3).orderBy("n_trees").collect()
    assert [r["n_trees"] for r in top] == [1, 2]
    con = ccp.consensus(facts, fams).first()["newick"]
    assert newick.robinson_foulds(newick.parse(con), newick.parse("(a_1,(b_1,(c_1,d_1)));")) <= 1
    assert ccp.random_trees(tables.filter("family = 'f1'"), 5, seed=1).count() == 5
    sup = ccp.support(t3.filter("tree_no = 1"), t3).agg(F.min("support"), F.max("support")).first()
    assert sup[0] == pytest.approx(2 / 3) and sup[1] == pytest.approx(1.0)


def test_prune_and_keep(spark, trees):
    t3 = trees.filter("family = 'f1'")
    facts, fams = ccp.prune(splits.split_facts(t3), splits.families(t3), ["a", "b", "c"])
    assert fams.first()["leaves"] == ["a_1", "b_1", "c_1"] and facts.agg(F.sum("cnt")).first()[0] == 9 * 1.0
    assert splits.keep_leaves(trees, ["a", "b", "c"]).count() == 3
    groups = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "c")], "group string, species string")
    assert {r["group"] for r in splits.keep_groups(trees, groups).collect()} == {"g1", "g2"}
    assert {r["leaf"]: r["n"] for r in splits.leaf_census(trees).collect()} == {"a_1": 2, "b_1": 1, "c_1": 2, "d_1": 1, "b_9": 1}
    one = splits.split_facts(t3)
    assert splits.add(one, one).agg(F.sum("cnt")).first()[0] == 2 * one.agg(F.sum("cnt")).first()[0]


def test_likelihoods_match_the_kernel_and_ignore_partitions(spark, trees, tables):
    got = {r["family"]: r["logl"] for r in reconcile.loglik(reconcile.balanced(tables, 3), SPECIES).collect()}
    again = {r["family"]: r["logl"] for r in reconcile.loglik(tables.coalesce(1), SPECIES).collect()}
    assert got == again and set(got) == {"f1", "f2", "f3"} and all(map(math.isfinite, got.values()))
    o = reconcile.origination_loglik(tables, SPECIES).filter("family = 'f3'")
    assert o.count() == 7
    times = reconcile.timings(tables, SPECIES, repeats=2)
    assert {(r["file"], r["genes"], r["species"]) for r in times.collect()} == {("f1", 4, 4), ("f2", 2, 2), ("f3", 1, 1)}


def test_fit_beats_the_start(tables):
    start = {r["family"]: r["logl"] for r in reconcile.loglik(tables, SPECIES).collect()}
    for r in reconcile.fit(tables, SPECIES).collect():
        assert r["logl"] >= start[r["family"]] - 1e-9
    r = reconcile.fit(tables.filter("family = 'f1'"), SPECIES, fixed=("delta",), transfer_ratio=2.0).first()
    assert r["delta"] == 0.01 and r["tau"] == pytest.approx(0.02)


def test_global_and_branchwise_fit(tables):
    rates, value = reconcile.fit_global(tables, SPECIES, rounds=4)
    assert value >= reconcile.loglik(tables, SPECIES).agg(F.sum("logl")).first()[0] - 1e-9
    _, better = reconcile.fit_branchwise(tables, SPECIES, rates, rounds=1, kinds=("delta", "O"))
    assert better >= value - 1e-9


def test_samples_events_and_reports(spark, tables, tmp_path):
    sampled = reconcile.samples(tables, SPECIES, n=6, seed=3).cache()
    assert sampled.count() == 18
    assert sorted(map(tuple, reconcile.samples(tables.repartition(3), SPECIES, n=6, seed=3).select("family", "sample_no", "newick").collect())) == sorted(map(tuple, sampled.select("family", "sample_no", "newick").collect()))
    ev = reconcile.events(sampled)
    tot = {r["family"]: r for r in event_tables.totals(ev, 6).collect()}
    assert tot["f1"]["originations"] == 1 and tot["f3"]["originations"] == 1
    means = event_tables.branch_means(ev, 6)
    copies = means.filter("family = 'f1' AND branch < 4").agg(F.sum("copies")).first()[0]
    assert copies == pytest.approx(4.0)
    assert event_tables.presence(ev, 6).filter("presence > 1").isEmpty()
    assert event_tables.histogram(ev, 6).filter("abs(n0 + n1 + n2 + n3 + n4 + n5 + n6 + n7 + n8 + n9 - 1) > 1e-9").isEmpty()
    fits = reconcile.fit(tables, SPECIES)
    tree = read_species_tree(SPECIES)
    text = writers.report(fits, event_tables.totals(ev, 6), means, sampled, tree).filter("family = 'f1'").first()["text"]
    assert ">logl:" in text and "6 reconciled G-s:" in text
    path = tmp_path / "f1.rec"
    path.write_text(text)
    back = readers.reconciliation_files(spark, str(path)).first()
    assert len(back["reconciled"]) == 6 and back["species_tree"].startswith("((") and back["delta"] is not None
    clean = event_tables.leaf_labels(sampled.filter("family = 'f1'")).first()["newick"]
    assert sorted(newick.parse(clean).leaf_names()) == ["a_1", "b_1", "c_1", "d_1"]
    assert event_tables.trails(ev).count() > 0
    assert writers.transfer_list(event_tables.transfer_matrix(ev, 6), tree).columns == ["from", "to", "freq"]
    own = reconcile.samples(tables, SPECIES, rates=fits, n=2)
    assert own.count() == 6


def test_chain_and_dated(tables):
    chain = reconcile.mcmc(tables.filter("family = 'f1'"), SPECIES, steps=40, burnin=10, thin=5, seed=1)
    assert chain.count() == 6 and chain.filter("delta <= 0").isEmpty()
    one = tables.filter("family <> 'f3'")
    assert dated.loglik(one, SPECIES).filter("isnan(logl)").isEmpty()
    rec = dated.best_reconciliation(one, SPECIES).collect()
    assert all(sum(e["kind"] == "C" for e in r["events"]) == (4 if r["family"] == "f1" else 2) for r in rec)
    assert dated.samples(one, SPECIES, n=3).count() == 6
    assert dated.mcmc(tables.filter("family = 'f2'"), SPECIES, steps=12, burnin=2, thin=2).count() == 5
    assert dated.fit(tables.filter("family = 'f2'"), SPECIES).first()["logl"] > -50


def test_species_tree_search_improves(spark):
    sample = readers.trees_from_strings(spark, {f"f{k}": ["((a_1:1,b_1:1):1,(c_1:1,d_1:1):1);"] for k in range(3)})
    t = splits.tables(sample).cache()
    wrong = "((a:1,c:1):1,(b:1,d:1):1);"
    before = reconcile.loglik(t, wrong).agg(F.sum("logl")).first()[0]
    found, value = reconcile.search_species_tree(t, wrong, Rates(), n_samples=2, tries=4)
    assert value > before and sorted(newick.parse(found).leaf_names()) == list("abcd")
    assert sorted(newick.parse(reconcile.random_species_tree(list("abcd"))).leaf_names()) == list("abcd")


def test_readers(spark, tmp_path):
    (tmp_path / "one.trees").write_text("\n".join(f"(a_{k},b_{k});" for k in range(6)) + "\n\n")
    (tmp_path / "two.trees").write_text("# note\na_1:1;\n")
    got = readers.tree_samples(spark, str(tmp_path / "one.trees"), burnin=2, every=2)
    assert sorted(r["tree_no"] for r in got.collect()) == [4, 6]
    add = readers.tree_samples(spark, str(tmp_path / "one.trees"), burnin=2, every=2, mode="add", until=1)
    assert [r["tree_no"] for r in add.collect()] == [3]
    assert readers.tree_samples(spark, str(tmp_path / "two.trees"), burnin=5).first()["newick"] == "a_1:1;"
    (tmp_path / "x.nex").write_text("#NEXUS\nbegin trees;\n translate\n 1 A_x,\n 2 B_y,\n 3 C_z;\n tree gen.1 = [&U] ((1:1,2:1):1,3:1);\nend;\n")
    assert newick.parse(readers.nexus_trees(spark, str(tmp_path / "x.nex")).first()["newick"]).leaf_names() == ["A_x", "B_y", "C_z"]
    (tmp_path / "s.tree").write_text("(a,b);\nnote\n(c,d);\n")
    assert readers.species_tree(spark, str(tmp_path / "s.tree")) == "(a,b);" and readers.species_tree(spark, str(tmp_path / "s.tree"), last=True) == "(c,d);"
    (tmp_path / "m").write_text("a:0.5\nb:0.1\n")
    assert readers.fraction_missing(spark, str(tmp_path / "m")).count() == 2
    (tmp_path / "c").write_text("#family,older,younger,support\nf,x,y,2.5,0.1\nf,x,y,1,0.9\nf,None,z,1\nFRQ skip\np q 3\np q\n")
    c = {(r["older"], r["younger"]): r["weight"] for r in readers.constraints(spark, str(tmp_path / "c")).collect()}
    assert c == {("x", "y"): 3.5, ("root", "z"): 1.0, ("p", "q"): 4.0}
    far = {(r["older"], r["younger"]): r["weight"] for r in readers.constraints(spark, str(tmp_path / "c"), least_distance=0.5).collect()}
    assert far[("x", "y")] == 1.0
    (tmp_path / "t").write_text("1.5\t10\t4\t3\tf1\n2.5\t20\t5\t3\tf2\nbad\n")
    assert readers.runtimes(spark, str(tmp_path / "t")).agg(F.sum("time")).first()[0] == 4.0
    (tmp_path / "d").write_text("f1\t0\t1.5\nf2\t1\n")
    assert readers.distributed_list(spark, str(tmp_path / "d")).count() == 1
    assert readers.key_values(["delta=0.1", "seed:3", "file"]) == {"delta": "0.1", "seed": "3"}


def test_posterior_text_through_spark(spark, tables, tmp_path):
    writers.write_texts(writers.posterior_texts(tables.filter("family = 'f1'")), str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"]
    assert posterior_text.loads(got).count_trees() == 10
    assert readers.numbered_lines(spark, str(tmp_path / "out")).count() > 5


def test_constraints_and_ranking(spark):
    b = ordering.branch_table(spark, SPECIES)
    assert ordering.closure(b).count() == 7 + 4 + 4 + 2
    rec = spark.createDataFrame([("f", 0, "((a_1,b_1).T@ab->cd.ab,(c_1,(d_1,(e_1,g_1))).r);"), ("f", 1, "(a,b).T@ab->cd;")], "family string, sample_no int, newick string")
    moves = ordering.transfers(rec)
    assert [(r["donor"], r["recipient"]) for r in moves.collect()] == [("ab", "cd")]
    c = ordering.transfer_constraints(moves, b)
    assert [(r["older"], r["younger"], r["weight"]) for r in c.collect()] == [("r", "cd", 1.0)]
    rows = spark.createDataFrame([("ab", "cd", 3.0), ("cd", "ab", 1.0), ("ab", "a", 1.0), ("r", "ab", 1.0), ("a", "cd", 1.0), ("ab", "r", 1.0), ("ab", "ab", 1.0)], "older string, younger string, weight double")
    kinds = {(r["older"], r["younger"]): r["class"] for r in ordering.classify(rows, b).collect()}
    assert kinds == {("ab", "cd"): "informative", ("cd", "ab"): "informative", ("ab", "a"): "to_descendant", ("r", "ab"): "to_descendant", ("a", "cd"): "from_leaf", ("ab", "r"): "to_ancestor", ("ab", "ab"): "self"}
    assert {(r["older"], r["younger"]): r["weight"] for r in ordering.cancel(rows).filter("older = 'ab' AND younger = 'cd'").collect()} == {("ab", "cd"): 2.0}
    got = ordering.rank(SPECIES, rows, steps=300, chains=2)
    assert got["order"] == ["r", "ab", "cd"] and got["value"] == 1.0
    order = ordering.order_table(spark, got["order"])
    assert ordering.order_value(ordering.informative(rows, b), order).first()["violated"] == 1.0
    assert ordering.conflicting(ordering.informative(rows, b), order).count() == 1 and ordering.partial_order(ordering.informative(rows, b), order).count() == 1
    draws = ordering.random_orders(spark, SPECIES, rows, n=50)
    assert 0 < ordering.p_value(draws, 1.0).first()["p_value"] < 1
    s = ordering.supported(rows, 10, 0.15, b).first()
    assert (s["older"], s["support"], s["distance"]) == ("ab", pytest.approx(0.3), 2.0)
    assert ranking.violated(["r", "cd", "ab"], ordering.weights_of(rows)) >= 3.0
    # A copy of the lineage that speciated at r moved from ab to cd, and speciated there.
    deep = spark.createDataFrame([("f", "(((a_1,b_1).ab,(c_1,d_1).cd.T@ab->cd).r,(c_2,(d_2,a_2)));")], "family string, newick string")
    between = ordering.reconciliation_constraints(deep, b)
    assert {(r["older"], r["younger"]) for r in between.collect()} == {("r", "cd")}


def test_joint_search_and_dated_reports(spark):
    tables = splits.tables(readers.trees_from_strings(spark, {"f": ["((a_1,b_1),(c_1,d_1));"], "g": ["((a_1,c_1),b_1);"]}))
    before = reconcile.loglik(tables, SPECIES).agg(F.sum("logl")).first()[0]
    rates, value = reconcile.fit_joint(tables, SPECIES, rounds=6, kinds=("delta", "lambda"))
    assert value >= before - 1e-9 and len(rates.multipliers["delta"]) == 7
    assert value == pytest.approx(reconcile.loglik(tables, SPECIES, rates).agg(F.sum("logl")).first()[0], abs=1e-9)
    finite = DatedRates(population=40.0)
    assert dated.loglik(tables, SPECIES, finite).filter("logl < 0").count() == 2
    with pytest.raises(ValueError):
        dated.best_reconciliation(tables, SPECIES, finite)
    assert dated.samples(tables, SPECIES, finite, n=2).count() == 4
    start = DatedRates(delta=0.1, tau=0.1, lambda_=0.2)
    chain = dated.mcmc(tables, SPECIES, start, steps=20, burnin=5, thin=1)
    drawn = dated.mcmc_samples(tables, chain, SPECIES, start, n=3)
    assert drawn.count() == 3 * chain.filter("accepted").count() > 0
    fits = chain.groupBy("family").agg(F.max("logl").alias("logl"), *(F.first(c).alias(c) for c in ("delta", "tau", "lambda")))
    best = dated.best_reconciliation(tables, SPECIES, start)
    ev = best.select("family", F.lit(0).alias("sample_no"), F.explode("events").alias("e")).select("family", "sample_no", "e.kind", "e.branch", F.lit(-1).alias("other"))
    texts = {r["family"]: r["text"] for r in writers.dated_report(fits, best, event_tables.branch_means(ev, 1), read_species_tree(SPECIES)).collect()}
    assert set(texts) == {"f", "g"} and all("1 reconciled G-s" in t and "S_terminal_branch" in t for t in texts.values())
    sampled = reconcile.samples(tables, SPECIES, n=5)
    for text in (r["text"] for r in writers.consensus_texts(sampled).collect()):
        rule, least = text.split("\n")
        assert sorted(newick.parse(rule).leaf_names()) == sorted(newick.parse(least).leaf_names())


def test_schedules(spark):
    rng = np.random.default_rng(0)
    rows = [(float(t), 10, 5, int(s), f"f{k}") for k, (t, s) in enumerate(zip(rng.exponential(10, 200), rng.integers(1, 20, 200)))]
    times = spark.createDataFrame(rows, "time double, clades long, genes long, species long, file string")
    for policy in ("conservative", "aggressive", "all"):
        packed = scheduling.pack(times, 8, policy)
        loads = [r["load"] for r in scheduling.loads(packed).collect()]
        assert max(loads) - min(loads) <= max(r[0] for r in rows) and packed.count() <= 200
    assert scheduling.pack(times, 8, "all").count() == 200
    assert scheduling.pack(times, 8, "aggressive").count() <= 165
    even = scheduling.pack_list([("a", 3.0), ("b", 3.0), ("c", 2.0), ("d", 2.0), ("e", 2.0)], 2)
    loads = [sum(t for _, k, t in even if k == m) for m in (0, 1)]
    assert max(loads) == 6.0


def test_species_tables(spark):
    t = read_species_tree(SPECIES)
    b = species.branches(spark, t)
    assert b.count() == 7 and b.filter("is_leaf").count() == 4
    p = species.event_probabilities(b, 0.1, 0.1, 0.2).first()
    assert p["p_s"] + p["p_d"] + p["p_t"] + p["p_l"] == pytest.approx(1.0)
    m = spark.createDataFrame([("a", 0.3), ("x", 0.9)], "species string, fraction double")
    assert species.with_missing(b, m).agg(F.sum("fraction")).first()[0] == pytest.approx(0.3)
    assert species.slice_table(spark, t).count() >= 9
    assert species.taxa(spark, t).filter("label = 'a-d'").count() == 1
    leaves = spark.createDataFrame([("f", "a_1"), ("f", "zz_1")], "family string, leaf string")
    mapped, lost = species.genes_to_species(leaves, b)
    assert mapped.count() == 2 and [r["species"] for r in lost.collect()] == ["zz"]
    assert species.dated_ancestors(b).count() >= 2


def test_tree_tables_and_sql(spark, trees):
    n = tree_tools.nodes(trees.filter("family = 'f1' AND tree_no = 1"))
    assert n.count() == 7 and n.filter("is_leaf").count() == 4
    assert tree_tools.children(n).count() == 6
    ids = {r["name"]: r["node"] for r in n.filter("is_leaf").collect()}
    pairs = spark.createDataFrame([("f1", 1, ids["a_1"], ids["b_1"]), ("f1", 1, ids["a_1"], ids["c_1"])], "family string, tree_no long, a int, b int")
    got = {r["b"]: r["distance"] for r in tree_tools.last_common_ancestors(n, pairs).collect()}
    assert got == {ids["b_1"]: 2.0, ids["c_1"]: 4.0}
    row = trees.filter("family = 'f1' AND tree_no = 1").select(tree_tools.unrooted(F.col("newick")).alias("u"), tree_tools.without_leaf(F.col("newick"), "a_1").alias("w"), tree_tools.triplets(F.col("newick"), F.col("newick")).alias("t")).first()
    assert len(newick.parse(row["u"]).children) == 3 and len(newick.parse(row["w"]).leaves()) == 3 and row["t"]["same"] == row["t"]["total"] == 4
    tree_tools.register(spark)
    assert spark.sql("SELECT count(*) FROM newick_splits('((a,b),(c,d));')").first()[0] == 6
    assert spark.sql("SELECT count(*) FROM newick_nodes('((a,b),(c,d));')").first()[0] == 7


def test_simulation_is_seeded(spark):
    a = simulate.simulate(spark, 3, population=8, sampled=4)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, simulate.simulate(spark, 3, population=8, sampled=4).repartition(2).collect()))


def test_stream_of_trees(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "facts"
    src.mkdir()
    rows = [{"family": "f1", "newick": t, "weight": 1.0} for t in TREES["f1"]]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows[:2])))
    q = split_stream.keep_facts(split_stream.read_trees(spark, str(src)), str(out), str(tmp_path / "ck"))
    q.awaitTermination()
    (src / "2.json").write_text(json.dumps(rows[2]))
    split_stream.keep_facts(split_stream.read_trees(spark, str(src)), str(out), str(tmp_path / "ck")).awaitTermination()
    want = splits.split_facts(readers.trees_from_strings(spark, {"f1": TREES["f1"]}))
    key = lambda d: sorted((bytes(r["clade"]), bytes(r["left"] or b""), r["cnt"], r["bl"]) for r in d.collect())
    assert key(split_stream.stored_facts(spark, str(out))) == key(want)
    run = split_stream.running_facts(split_stream.read_trees(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("facts").option("checkpointLocation", str(tmp_path / "ck2")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("facts").agg(F.sum("cnt")).first()[0] == want.agg(F.sum("cnt")).first()[0]


def test_a_table_of_seeds_is_dealt_to_all_cores(spark):
    seeds = spark.range(0, 12, 1, 1)
    got = simulate.simulate(spark, 0, seeds=seeds)
    assert got.rdd.getNumPartitions() > 1
    keys = ["seed", "species_tree", "random_tree", "family", "gene_tree"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, simulate.simulate(spark, 12).select(keys).collect()))


def test_like_families_are_worked_out_once_and_dealt(spark):
    """Families with the same species and counts share a value; others, and large ones, have their own."""
    seen = []

    def value(row):
        seen.append(row["family"])
        return float(len(seen))

    fact = lambda cnt, left=None: {"clade": b"\x03", "left": left, "right": left, "cnt": cnt, "bl": 1.0}
    row = lambda family, leaves, facts, n=1.0: {"family": family, "leaves": leaves, "observations": n, "facts": facts}
    run = reconcile.once_for_like(value, Rates())
    rows = [row("f", ["a_1", "b_1"], [fact(1.0)]), row("g", ["a_2", "b_7"], [fact(1.0)]), row("h", ["b_1", "a_1"], [fact(1.0)]), row("i", ["a_1", "b_1"], [fact(2.0)])]
    rows += [row("j", ["a_1", "b_1"], [fact(1.0)], 2.0), row("k", ["a_1", "b_1"], [fact(1.0, b"\x01")]), *(row(k, ["a_1", "b_1"], [fact(1.0)] * 65) for k in "lm")]
    assert [run(r) for r in rows] == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    trees = spark.createDataFrame([(f"f{k}", 1, f"{'ab'[k % 2]}_{k};") for k in range(20)], "family string, tree_no int, newick string")
    got = dated.loglik(splits.tables(trees), "(a:1,b:1);")
    assert got.rdd.getNumPartitions() > 1
    by = {r["family"]: r["logl"] for r in got.collect()}
    assert len(by) == 20 and by["f0"] == by["f18"] and by["f1"] == by["f19"]


def test_splits_are_handed_on_in_pieces(spark, monkeypatch):
    """A batch's splits do not all lie in a worker's memory at once, and counts are the same."""
    import pandas as pd

    batch = pd.DataFrame({"family": ["f"] * 6 + ["g"] * 2, "newick": ["((a:1,b:1):1,c:1,d:1);", "((a:1,c:1):1,b:1,d:1);"] * 4, "weight": [1.0] * 8})

    def total(frames):
        rows = pd.concat(frames)
        return rows.fillna({"left": b"", "right": b""}).groupby(["family", "clade", "left", "right"])[["cnt", "bl"]].sum().to_dict()

    whole = list(splits._facts(iter([batch])))
    monkeypatch.setattr(splits, "HELD_SPLITS", 10)
    pieces = list(splits._facts(iter([batch])))
    assert len(whole) == 1 and len(pieces) > 4 and max(map(len, pieces)) < 40
    assert total(pieces) == total(whole)
    trees = spark.createDataFrame([("f", k, "((a:1,b:1):1,c:1,d:1);") for k in range(5)], "family string, tree_no long, newick string")
    assert ccp.tree_splits(trees).count() == 5 * ccp.tree_splits(trees.filter("tree_no = 0")).count()
