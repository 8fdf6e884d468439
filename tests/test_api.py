"""The programs end to end on small files."""

import math

import pytest

from cladeflow import api
from cladeflow.functions.undated_model import Rates
from cladeflow.operators import splits
from cladeflow.sources import readers

SPECIES = "((a:1,b:1)ab:1,(c:1,d:1)cd:1)r;"
SAMPLE = ["((a_1:1,b_1:1):1,(c_1:1,d_1:1):1);", "((a_1:1,c_1:1):1,(b_1:1,d_1:1):1);", "((a_1:1,b_1:1):1,(c_1:1,d_1:1):1);"]


def test_observe_save_load_and_score(spark, tmp_path):
    (tmp_path / "f.trees").write_text("\n".join(SAMPLE))
    tables = api.observe(spark, str(tmp_path / "f.trees"))
    api.save(tables, str(tmp_path / "out"))
    back = api.load(spark, str(tmp_path / "out" / "family=f.trees"))
    one, two = (splits.of_row(t.first().asDict(recursive=True)) for t in (tables, back))
    assert (one.leaves, one.bips, one.dips, one.observations) == (two.leaves, two.bips, two.dips, two.observations)
    assert one.lengths == pytest.approx(two.lengths)
    trees = readers.trees_from_strings(spark, {"f.trees": SAMPLE[:2]})
    got = {r["tree_no"]: math.exp(r["log_p"]) for r in api.score(tables, trees).collect()}
    assert got == pytest.approx({1: 2 / 3, 2: 1 / 3})
    more = splits.of_row(api.add(tables, trees, weight=2.0).first().asDict(recursive=True))
    assert more.observations == 7.0 and sum(more.dips.values()) == 6 * 7.0


def test_evaluate_resample_and_constraints(spark, tmp_path):
    trees = readers.trees_from_strings(spark, {"f1": SAMPLE[:1], "f2": ["(((a_1:1,c_1:1):1,b_1:1):1,d_1:1);"]})
    got = api.evaluate(spark, SPECIES, trees, Rates(delta=0.1, tau=0.2, lambda_=0.2), n_samples=4)
    assert got["fits"].count() == 2 and got["samples"].count() == 8 and got["report"].count() == 2
    for r in got["report"].collect():
        (tmp_path / r["family"]).write_text(r["text"])
    again = api.resample(spark, str(tmp_path), splits.tables(trees), 3)
    assert again.count() == 6
    found = api.constraints(got["samples"], spark, SPECIES, 4)
    assert {"family", "older", "younger", "weight", "support", "distance"} <= set(found.columns)


def test_em_keeps_rates_sensible(spark):
    trees = readers.trees_from_strings(spark, {f"f{k}": SAMPLE[:1] for k in range(3)})
    rates, last = api.em_rates(splits.tables(trees), SPECIES, rounds=2, n_samples=5)
    assert 0 < rates.delta < 1 and 0 < rates.tau < 10 and last.count() == 3


def test_command_line(spark, tmp_path):
    from cladeflow.__main__ import main

    (tmp_path / "f.trees").write_text("\n".join(SAMPLE))
    (tmp_path / "s.tree").write_text(SPECIES + "\n")
    at = lambda x: str(tmp_path / x)
    main(["observe", f"trees={at('f.trees')}", f"out={at('one')}"])
    one = at("one") + "/family=f.trees"
    main(["add", f"tables={one}", f"trees={at('f.trees')}", "weight=2", f"out={at('two')}"])
    two = [splits.of_row(r.asDict(recursive=True)).observations for r in api.load(spark, at("two") + "/*").collect()]
    assert sum(two) == 9.0
    main(["prune", f"tables={one}", "keep=a,b,c", f"out={at('three')}"])
    cut = api.load(spark, at("three") + "/*").first()
    assert sorted(cut["leaves"]) == ["a_1", "b_1", "c_1"]
    main(["constraints", f"species={at('s.tree')}", f"tables={one}", "samples=3", f"out={at('found')}"])
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_command_line_of_models(spark, tmp_path):
    from cladeflow.__main__ import main, model_rates

    (tmp_path / "f.trees").write_text("\n".join(SAMPLE))
    (tmp_path / "s.tree").write_text(SPECIES + "\n")
    (tmp_path / "missing").write_text("a:0.2\nb:0.1\n")
    (tmp_path / "keep").write_text("a\n\nc\nd\n")
    (tmp_path / "keep.tree").write_text("(a,(b,c));\n")
    at = lambda x: str(tmp_path / x)
    main(["observe", f"trees={at('f.trees')}", f"out={at('one')}"])
    one, s = f"tables={at('one')}/family=f.trees", f"species={at('s.tree')}"
    for name, leaves in (("keep", ["a_1", "c_1", "d_1"]), ("keep.tree", ["a_1", "b_1", "c_1"])):
        main(["prune", one, f"keep_file={at(name)}", f"out={at('cut-' + name)}"])
        assert sorted(api.load(spark, at("cut-" + name) + "/*").first()["leaves"]) == leaves
    model = ["delta=0.05", "tau=0.2", f"fraction_missing={at('missing')}", "O_R=2", "reldate=1", "beta=0.5", "rate_multiplier=delta,0,3;O,6,2"]
    o = readers.key_values(model)
    r = model_rates(spark, o)
    assert (r.delta, r.tau, r.lambda_, r.origin_root, r.by_date, r.seq_beta, r.missing, r.multipliers) == (0.05, 0.2, 0.1, 2.0, True, 0.5, {"a": 0.2, "b": 0.1}, {"delta": {0: 3.0}, "O": {6: 2.0}})
    with pytest.raises(SystemExit):
        model_rates(spark, {"rate_multiplier": "rho,0,3"})
    main(["fit", s, one, "samples=3", "seed=5", "fixed=tau,lambda", *model, f"out={at('fit')}"])
    fits = spark.read.parquet(at("fit") + "/fits").first()
    assert fits["tau"] == 0.2 and fits["lambda"] == 0.1 and fits["delta"] != 0.05
    assert spark.read.parquet(at("fit") + "/samples").count() == 3
    # The terms of the report belong to the model with its options.
    from cladeflow.functions.species_tree import read_species_tree
    from cladeflow.functions.undated_model import prepare

    b = prepare(read_species_tree(SPECIES), r.of(delta=fits["delta"]))
    assert {t["branch"]: t["extinction"] for t in spark.read.parquet(at("fit") + "/terms").collect()} == pytest.approx({e: float(x) for e, x in enumerate(b.extinct)})
    main(["fit", s, one, "samples=1", "DT=2", "MLOR=1", f"out={at('ratio')}"])
    got = spark.read.parquet(at("ratio") + "/fits").first()
    assert got["tau"] == pytest.approx(2 * got["delta"])
    main(["mcmc", s, one, "steps=20", "burnin=4", "sampling_rate=4", "every=8", "samples=2", f"out={at('chain')}"])
    assert spark.read.parquet(at("chain") + "/trace").count() == 4 and spark.read.parquet(at("chain") + "/samples").count() == 8
    assert spark.read.parquet(at("chain") + "/totals").first()["originations"] == pytest.approx(1.0)
    assert "a_1" in spark.read.parquet(at("chain") + "/consensus").first()["text"]
    for what, more in (("fit", []), ("best", []), ("samples", ["samples=2", "population=20"]), ("mcmc", ["steps=8", "burnin=2", "thin=2"])):
        main(["dated", s, one, f"what={what}", *more, f"out={at('dated-' + what)}"])
    assert [spark.read.parquet(at("dated-" + w)).count() for w in ("fit", "best", "samples", "mcmc")] == [1, 1, 2, 3]
    with pytest.raises(SystemExit):
        main(["dated", s, one, "what=dance", f"out={at('x')}"])
