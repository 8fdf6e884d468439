"""Log likelihoods and extinction worked out from the formulas in a separate script, and options of one line."""

import pytest

from cladeflow.functions import newick
from cladeflow.functions.clade_table import observe
from cladeflow.functions.species_tree import coalescent_lengths, read_species_tree
from cladeflow.functions.undated_model import Rates, layout, likelihood, prepare
from cladeflow.operators import tree_tools
from cladeflow.sources import readers

SPECIES = "((a:1,b:1),c:2);"


def logl(tree: str, rates: Rates) -> float:
    return likelihood(layout(observe([(tree, 1.0)]), rates), prepare(read_species_tree(SPECIES), rates)).log_likelihood


@pytest.mark.parametrize(("tree", "want"), [("a_1;", -1.54004585), ("(a_3,b_4);", -1.75707077), ("((a_3,b_3),c_3);", -2.04373949), ("c_2;", -1.53932683)])
def test_undated(tree, want):
    assert logl(tree, Rates(delta=0.01, tau=0.01, lambda_=0.1)) == pytest.approx(want, abs=1e-8)


def test_undated_variants():
    assert logl("((a_3,b_3),c_3);", Rates(missing={"a": 0.1})) == pytest.approx(-2.01631769, abs=1e-8)
    assert logl("((a_3,b_3),c_3);", Rates(origin_root=2)) == pytest.approx(-1.54313800, abs=1e-8)


def test_extinction():
    b = prepare(read_species_tree(SPECIES), Rates())
    assert b.extinct.astype(float) == pytest.approx([0.08942853, 0.08942853, 0.08943044, 0.09658672, 0.09716145], abs=1e-8)


def test_coalescent_heights():
    text = "s0"
    for k in range(1, 8):
        text = f"({text}:1,s{k}:{k})"
    h = sorted(coalescent_lengths(read_species_tree(text + ";")).heights())[8:]
    total = sum(1 / (8 - i) for i in range(7))
    assert h == pytest.approx([sum(1 / (8 - i) for i in range(k)) / total for k in range(1, 8)])


def test_regrafts():
    t = newick.parse("((a:1,b:1)x:1,(c:1,d:1)y:1)z;")
    assert newick.robinson_foulds(t, newick.graft(t, "a", "b")) == 0
    u = newick.parse("(((a:1,b:1)x:1,c:1)y:1,d:1)z;")
    assert newick.robinson_foulds(u, newick.graft(u, "c", "a")) == 1


def test_options_of_one_line(spark):
    assert readers.key_values(["delta=0.1", "tau:0.2", "out=a:b", "plain"]) == {"delta": "0.1", "tau": "0.2", "out": "a:b"}
    rows = spark.createDataFrame([("delta=0.1",), ("tau:0.2",), ("out=a:b",), ("plain",), (None,)], "value string")
    assert {(r["key"], r["value"]) for r in readers.options(rows).collect()} == {("delta", "0.1"), ("tau", "0.2"), ("out", "a:b")}


def test_node_tables_of_odd_trees(spark):
    trees = spark.createDataFrame([("f", 1, "((b:2,a:1)x:1,c:5);"), ("f", 2, "one;"), ("g", 1, "(q:1,(r:1,(t:3,s:1):1):2);")], "family string, tree_no int, newick string")
    t = tree_tools.taxa(tree_tools.nodes(trees)).cache()
    got = {(r["family"], r["tree_no"], r["label"]): (r["height"], r["is_leaf"]) for r in t.collect()}
    assert got["f", 1, "a-b"] == (2.0, False) and got["f", 1, "a-c"] == (5.0, False) and got["f", 2, "one"] == (0.0, True) and got["g", 1, "q-t"] == (6.0, False)
    assert {(r["family"], r["rank"]) for r in tree_tools.ranks(t).collect()} == {("f", 1), ("f", 2), ("g", 1), ("g", 2), ("g", 3)}
    name = {(r["family"], r["tree_no"], r["node"]): r["label"] for r in t.collect()}
    pairs = {(name[r["family"], r["tree_no"], r["node"]], name[r["family"], r["tree_no"], r["other"]]) for r in tree_tools.dated_pairs(t).collect()}
    assert pairs == {("a", "a-c"), ("b", "a-c"), ("r", "q-t"), ("s", "r-t"), ("t", "r-t"), ("s", "q-t"), ("t", "q-t"), ("s-t", "q-t")}


def test_taxa_of_trees_need_no_shuffle(spark):
    """The taxa of trees are those of their node tables, also with equal heights, lengths left out and forks of three."""
    texts = ["((b:2,a:1)x:1,c:5);", "one;", "(q:1,(r:1,(t:3,s:1):1):2);", "(c,b,a);", "(((a:1,b:1):1,c:2):1,(d:1,e:1):2,f);"]
    trees = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "family string, tree_no int, newick string")
    one = tree_tools.tree_taxa(trees)
    rows = lambda t: sorted(map(str, t.select("family", "tree_no", "node", "parent", "is_leaf", "leaves", "label", "height").collect()))
    assert rows(one) == rows(tree_tools.taxa(tree_tools.nodes(trees)))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert {(r["tree_no"], r["rank"], r["height"]) for r in tree_tools.ranked(one).collect() if r["tree_no"] == 2} == {(2, 1, 3.0), (2, 2, 4.0), (2, 3, 6.0)}


def test_node_rows_are_handed_on_in_pieces(spark, monkeypatch):
    """A batch's nodes do not all lie in a worker's memory at once."""
    monkeypatch.setattr(tree_tools, "HELD_ROWS", 4)
    monkeypatch.setattr(tree_tools, "HELD_NAMES", 4)
    trees = spark.createDataFrame([("f", k, "((b:2,a:1)x:1,c:5);") for k in range(7)], "family string, tree_no int, newick string")
    assert tree_tools.nodes(trees).count() == 35 and tree_tools.tree_taxa(trees).count() == 35


def test_topologies_by_their_clades(spark):
    t = spark.createDataFrame([("((a,b),c);",), ("(c,(b,a));",), ("((a,c),b);",)], "newick string")
    a, b, c = [r[0] for r in t.select(tree_tools.rooted_clades("newick")).collect()]
    assert a == b == "a;a b;a b c;b;c" and c != a
