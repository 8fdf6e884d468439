"""Functions without Spark: trees, clade tables, models. Fixed values are worked out by hand or by enumeration."""

import math
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeflow.functions import clade_math, finite_model, newick, parsimony, ranking, simulator
from cladeflow.functions.clade_table import CladeTable, observe, pack_mask, rooted_topologies, unpack_mask
from cladeflow.functions.dated_model import DatedRates
from cladeflow.functions.dated_model import likelihood as dated_likelihood
from cladeflow.functions.dated_model import prepare as dated_prepare
from cladeflow.functions.dated_model import trace
from cladeflow.functions.simplex import minimise
from cladeflow.functions.species_tree import coalescent_lengths, read_species_tree, slices
from cladeflow.functions.undated_model import Rates, layout, likelihood, prepare, sample, species_of
from cladeflow.sources.posterior_text import dumps, loads

THREE = "((a:1,b:1):1,c:2);"


def random_newick(names, rng):
    return simulator.random_tree(names, rng)


@settings(max_examples=40, deadline=None)
@given(st.integers(3, 12), st.integers(0, 10**6))
def test_newick_round_trip_and_splits(n, seed):
    names = [f"x{k}" for k in range(n)]
    text = random_newick(names, np.random.default_rng(seed))
    root = newick.parse(text)
    assert newick.write(root) == newick.write(newick.parse(newick.write(root)))
    index = {x: k for k, x in enumerate(sorted(names))}
    splits, lengths = newick.directed_splits(root, index)
    full = (1 << n) - 1
    assert len(lengths) == 2 * (2 * n - 3)
    assert len(splits) == 2 * (2 * n - 3) - n
    for g, a, b in splits:
        assert a & b == 0 and a | b == g and 0 < g < full
        assert full ^ g in lengths
    # Rooting doesn't matter.
    other, _ = newick.directed_splits(newick.reroot(root, names[1]), index)
    assert sorted(other) == sorted(splits)


def test_newick_parts():
    t = newick.parse("((a_1:1,'b c':2)0.9:0.5,c:3[&&NHX:S=x:D=Y])r;")
    assert t.leaf_names() == ["a_1", "b c", "c"] and t.label == "r" and t.children[0].label == "0.9"
    assert t.children[1].tags == {"S": "x", "D": "Y"}
    with pytest.raises(ValueError):
        newick.parse("((a,b);")
    assert newick.write(newick.prune(newick.parse("((a:1,b:1):1,(c:1,d:1):2);"), lambda x: x in "acd")) == "(a:2,(c:1,d:1):2);"
    assert newick.prune(newick.parse("(a,b);"), lambda x: False) is None
    assert newick.contract(newick.parse("((a:1,b:1)0.2:1,(c:1,d:1)0.9:1);"), 0.5).leaf_names() == ["a", "b", "c", "d"]
    assert len(newick.contract(newick.parse("((a:1,b:1)0.2:1,(c:1,d:1)0.9:1);"), 0.5).children) == 3
    s = newick.stretch(newick.parse("((a:1,b:2):1,c:1);"))
    assert {round(newick.distance(s, x), 9) for x in s.leaves()} == {3.0}
    g = newick.parse("(((a:1,b:1)x:1,c:2)y:1,d:3)z;")
    assert sorted(newick.graft(g, "a", "d").leaf_names()) == ["a", "b", "c", "d"]
    assert newick.robinson_foulds(g, newick.graft(g, "a", "d")) > 0
    assert newick.write(newick.graft(g, "x", "y")) == newick.write(g)
    assert len(newick.interchanges(g, "x")) == 2
    assert newick.triplets_shared(newick.parse("((a,b),c);"), newick.parse("((a,c),b);")) == (0, 1)
    lca = newick.common_ancestor([newick.find(g, "a"), newick.find(g, "c")])
    assert lca.label == "y" and newick.distance(newick.find(g, "a"), newick.find(g, "c")) == 4
    assert [n.label for n in newick.nodes_between(g, newick.find(g, "a"))] == ["x", "y"]


def test_deep_ladder_is_no_recursion_problem():
    text = "a0"
    for k in range(1, 3000):
        text = f"({text},a{k})"
    root = newick.parse(text + ";")
    assert len(root.leaves()) == 3000 and newick.write(root.copy()) == newick.write(root)


def test_tree_numbers():
    assert [clade_math.double_factorial(n) for n in (-1, 1, 3, 5, 7)] == [1, 1, 3, 15, 105]
    assert len(list(rooted_topologies(list("abcd")))) == clade_math.rooted_trees(4) == 15
    assert clade_math.bipartitions(5) == 15 and clade_math.trinomial(1, 2, 3) == 60 and clade_math.binomial(5, 2) == 10
    # Each unrooted tree of five leaves has two inner branches: clades of two leaves are shared out evenly.
    assert clade_math.trees_with_clade(5, 2) * 10 == 2 * clade_math.unrooted_trees(5)
    assert sum(clade_math.trees_with_split(5, a, b) > 0 for a, b in ((1, 1), (1, 2))) == 2


def brute_amalgamations(table: CladeTable) -> int:
    found = 0
    splits = {g: {(a, b) for a, b, _ in s} for g, s in table.splits().items()}
    for text in rooted_topologies(table.leaves):
        root = newick.parse(text)
        m = newick.masks(root, table.index)
        ok = True
        for n in root.preorder():
            if n.is_leaf:
                continue
            a, b = sorted(m[id(c)] for c in n.children)
            g = a | b
            ok &= (a in table.bips or b in table.bips) if g == table.full else (a, b) in splits.get(g, set())
        found += ok
    return found


def test_counts_scores_and_best_tree_by_enumeration():
    rng = np.random.default_rng(5)
    names = list("abcdef")
    trees = [(random_newick(names, rng), 1.0) for _ in range(6)]
    table = observe(trees)
    assert table.observations == 6
    for g, parts in table.splits().items():
        assert sum(n for _, _, n in parts) == table.bips[g]
        assert table.full ^ g in table.bips or g.bit_count() == table.n - 1
    assert table.count_trees() == brute_amalgamations(table)
    # Probabilities of all unrooted trees sum to at most one, and the best is found.
    total, best = 0.0, 0.0
    seen = set()
    for text in rooted_topologies(names):
        key = tuple(sorted(s[0] for s in newick.directed_splits(newick.parse(text), table.index)[0]))
        if key in seen:
            continue
        seen.add(key)
        p = math.exp(table.score(text))
        total, best = total + p, max(best, p)
    assert len(seen) == 105 and total == pytest.approx(1.0)
    tree, p = table.best_tree()
    assert p == pytest.approx(best) and math.exp(table.score(tree)) == pytest.approx(best)
    # The score doesn't depend on where a tree is read from.
    one = table.recompose(trees[0][0])
    values = {round(one[g] * one[table.full ^ g] * table.p_bip(g), 12) for g in one if table.full ^ g in one}
    assert len(values) == 1 and values.pop() == pytest.approx(math.exp(table.score(trees[0][0])))


def test_single_tree_counts_all_its_rootings():
    rng = np.random.default_rng(1)
    table = observe([(random_newick([f"g{k}" for k in range(20)], rng), 1.0)])
    assert table.count_trees() == 2 * 20 - 3 and table.best_tree()[1] == pytest.approx(1)
    assert table.clade_share(random_newick(table.leaves, rng)) < 1


def test_priors_make_unseen_splits_possible():
    t = observe([("((a,b),(c,(d,e)));", 1.0)], alpha=1.0, beta=1.0)
    other = "((a,c),(b,(d,e)));"
    assert math.isfinite(t.score(other)) and t.score(other) < t.score("((a,b),(c,(d,e)));")
    plain = observe([("((a,b),(c,(d,e)));", 1.0)])
    assert plain.score(other) == -math.inf


def test_random_trees_follow_the_table():
    rng = np.random.default_rng(2)
    t = observe([("((a,b),(c,d));", 3.0), ("((a,c),(b,d));", 1.0)])
    n = sum(math.exp(t.score(t.random_tree(rng))) == pytest.approx(0.75) for _ in range(400))
    assert 250 < n < 350


def test_restrict_equals_observing_pruned_trees():
    rng = np.random.default_rng(3)
    names = [f"s{k}_g" for k in range(8)]
    trees = [random_newick(names, rng) for _ in range(5)]
    keep = set(names[:5])
    cut = observe([(t, 1.0) for t in trees]).restrict(keep)
    direct = observe([(newick.write(newick.prune(newick.parse(t), keep.__contains__)), 1.0) for t in trees])
    assert cut.leaves == direct.leaves and set(cut.bips) == set(direct.bips)


def test_text_form_round_trip():
    t = observe([("((a:1,b:2):1,(c:1,d:1):3);", 2.0), ("((a:1,c:2):1,(b:1,d:1):3);", 1.0)])
    u = loads(dumps(t))
    assert (u.leaves, u.observations, u.bips, u.dips) == (t.leaves, t.observations, t.bips, t.dips)
    assert u.lengths == pytest.approx(t.lengths)


@given(st.integers(1, 2**70 - 1))
def test_masks_pack(x):
    assert unpack_mask(pack_mask(x, 70)) == x


#: log likelihoods at delta 0.01, tau 0.01, lambda 0.1 on ((a:1,b:1),c:2), from the formulas by hand.
UNDATED = {"a_1;": -1.5400458537, "c_2;": -1.5393268273, "(a_3,b_4);": -1.7570707683, "((a_3,b_3),c_3);": -2.0437394945}


@pytest.mark.parametrize("tree,value", UNDATED.items())
def test_undated_values(tree, value):
    r = Rates()
    got = likelihood(layout(observe([(tree, 1.0)]), r), prepare(read_species_tree(THREE), r)).log_likelihood
    assert got == pytest.approx(value, abs=1e-8)


def test_undated_options():
    s = read_species_tree(THREE)
    t = observe([("((a_3,b_3),c_3);", 1.0)])
    value = lambda r: likelihood(layout(t, r), prepare(s, r)).log_likelihood
    assert value(Rates(origin_root=2)) == pytest.approx(-1.5431380046, abs=1e-8)
    assert value(Rates(missing={"a": 0.1})) == pytest.approx(-2.0163176858, abs=1e-8)
    assert prepare(s, Rates()).extinct.astype(float) == pytest.approx([0.0894285269, 0.0894285269, 0.0894304359, 0.0965867215, 0.0971614512], abs=1e-9)
    assert value(Rates(tau=0.0)) == pytest.approx(value(Rates(tau=1e-12)), abs=1e-6)
    assert value(Rates(any_recipient=True)) != value(Rates())
    only = Rates(multipliers={"O": {0: -1.0}})
    assert value(only) < value(Rates())
    with pytest.raises(ValueError):
        likelihood(layout(observe([("((x_3,b_3),c_3);", 1.0)]), Rates()), prepare(s, Rates()))
    assert species_of("A-b_1@x") == "A-b" and species_of("g_Homo_sapiens", field_=-1) == "Homo_sapiens"


def test_samples_have_what_a_reconciliation_needs():
    s = read_species_tree("((a:1,b:1),(c:1,d:1));")
    r = Rates(delta=0.2, tau=0.2, lambda_=0.2)
    fit = likelihood(layout(observe([("(((a_1,c_1),b_1),d_1);", 1.0)]), r), prepare(s, r))
    moved = 0
    for k in range(50):
        text, events = sample(fit, np.random.default_rng(k))
        assert sorted(x.split(".")[0] for x in newick.parse(text).leaf_names()) == ["a_1", "b_1", "c_1", "d_1"]
        kinds = [e[0] for e in events]
        assert kinds.count("O") == 1 and kinds.count("C") == 4
        moved += "T" in kinds
    assert moved
    assert sample(fit, np.random.default_rng(7)) == sample(fit, np.random.default_rng(7))


def test_large_family_does_not_underflow():
    names = [f"s{k:03d}" for k in range(60)]
    rng = np.random.default_rng(4)
    s = read_species_tree(random_newick(names, rng))
    genes = random_newick([f"{x}_1" for x in names], rng)
    r = Rates()
    assert math.isfinite(likelihood(layout(observe([(genes, 1.0)]), r), prepare(s, r)).log_likelihood)


def test_finite_model_by_hand():
    """One step of the recursion at a time for two genes, and births and deaths alone against their closed form."""
    s, dt = read_species_tree("(a:1,b:1);"), 0.5
    r = DatedRates(delta=0.1, tau=0.3, lambda_=0.2, sigma=2.0, step=dt, least_steps=2, stem=1.0, population=5.0)
    clock = finite_model.prepare(s, r)
    assert [p.time for p in clock.points] == pytest.approx([0, 0.5, 1.0, 1.5])
    fam = layout(observe([("(a_1,b_1);", 1.0)]), Rates())
    got = finite_model.likelihood(fam, clock).log_likelihood
    # q[gene][place]: genes a, b and both; places a, b, the root branch and the others.
    q = {g: dict.fromkeys("abro", 0.0) for g in ("A", "B", "AB")}
    q["A"]["a"] = q["B"]["b"] = 1.0
    total, places = 0.0, 0
    column = {"a": 0, "b": 1, "r": 2, "o": 3}
    for k, pt in enumerate(clock.points):
        ex, stay = (lambda x: clock.extinct[k][column[x]]), (lambda x: clock.stay[k][column[x]])
        alive = "ab" if k < 2 else "r"
        if k == 2:
            for g in q:
                q[g]["r"] = q[g]["a"] * ex("b") + q[g]["b"] * ex("a")
            q["AB"]["r"] += q["A"]["a"] * q["B"]["b"] + q["A"]["b"] * q["B"]["a"]
        total += sum(q["AB"][x] for x in alive) + q["AB"]["o"]
        places += len(alive) + 1
        new = {g: dict.fromkeys("abro", 0.0) for g in q}
        for g in q:
            for x in alive:
                new[g][x] = stay(x) * q[g][x] + r.sigma * dt * ex(x) * q[g]["o"]
            new[g]["o"] = stay("o") * q[g]["o"] + sum(0.3 / 5 * dt * ex("o") * q[g][x] for x in alive)
        for x in alive:
            apart = q["A"][x] * q["B"]["o"] + q["A"]["o"] * q["B"][x]
            new["AB"][x] += 2 * r.delta * dt * q["A"][x] * q["B"][x] + r.sigma * dt * apart
            new["AB"]["o"] += 0.3 / 5 * dt * apart
        new["AB"]["o"] += 2 * r.sigma * dt * q["A"]["o"] * q["B"]["o"]
        q = new
    assert got == pytest.approx(math.log(total / places), abs=1e-9)
    d, l = 0.4, 0.1
    alone = finite_model.prepare(s, DatedRates(delta=d, tau=0.0, lambda_=l, sigma=0.0, step=0.1, stem=1.0, population=10.0))
    x = math.exp(l - d)
    assert alone.extinct[10][0] == pytest.approx(l * (1 - x) / (d - l * x), abs=1e-9)
    assert np.prod(alone.stay[:10, 0]) == pytest.approx((d - l) ** 2 * x / (d - l * x) ** 2, abs=1e-9)
    # Extinction of unsampled species is the propagator's integral: the derivative by the start value.
    assert np.all(clock.stay[0, [0, 1, 3]] < 1) and np.all(clock.extinct[1, [0, 1, 3]] > 0)
    with pytest.raises(ValueError):
        finite_model.prepare(s, DatedRates(population=2.0))


def test_finite_population_holds_missing_genes():
    s = read_species_tree(THREE)
    r = DatedRates(delta=0.1, tau=0.2, lambda_=0.2, population=50.0)
    fam = layout(observe([("((a_1,b_1),c_1);", 1.0)]), Rates())
    seen, part = (finite_model.likelihood(fam, finite_model.prepare(s, r, m)).log_likelihood for m in (None, {"a": 0.5}))
    assert math.isfinite(seen) and part != seen
    clock = finite_model.prepare(s, r, {"a": 0.5})
    assert clock.extinct[0][0] == 0.5 and clock.extinct[0][-1] == 1.0


@settings(max_examples=20, deadline=None)
@given(st.integers(4, 6), st.integers(0, 10**6))
def test_parsimony_against_all_trees(n, seed):
    """Changes by trying all states of inner nodes, and the search's tree against every topology."""
    rng = np.random.default_rng(seed)
    clades = {int(g): float(rng.integers(1, 9)) for g in rng.integers(1, 2**n - 1, 6)}
    states, weights = parsimony.characters(clades, n)
    tree, cost = parsimony.search(states, weights)

    def by_states(t):
        total = 0.0
        for c, w in enumerate(weights):
            least = n * n
            for inner in product((1, 2), repeat=len(t) - n):
                own = [*states[:, c].tolist(), *inner]
                least = min(least, sum(own[a] != own[b] for a in range(len(t)) for b in t[a] if a < b))
            total += w * least
        return total

    assert cost == pytest.approx(by_states(tree))
    every = [[[n], [n], [n], *([] for _ in range(n - 3)), [0, 1, 2]]]
    for leaf in range(3, n):
        every = [parsimony._insert(t, leaf, a, b) for t in every for a, b in parsimony._edges(t, n)]
    costs = [parsimony.changes(t, states, weights) for t in every]
    assert len(every) == {4: 3, 5: 15, 6: 105}[n]
    assert min(costs) - 1e-9 <= cost
    # No exchange of the found tree is better, and where the characters fit one tree it is found.
    assert all(parsimony.changes(t, states, weights) >= cost - 1e-9 for a, b in parsimony._edges(tree, n, inner=True) for t in parsimony._exchanges(tree, a, b))
    if min(costs) == pytest.approx(weights.sum()):
        assert cost == pytest.approx(min(costs))


def test_parsimony_finds_the_only_tree():
    text = "(((a,b),c),((d,e),(f,g)));"
    leaves = list("abcdefg")
    splits_, _ = newick.directed_splits(newick.parse(text), {x: k for k, x in enumerate(leaves)})
    root, cost = parsimony.consensus(leaves, {s[0]: 1.0 for s in splits_})
    index = {x: k for k, x in enumerate(leaves)}
    assert {s[0] for s in newick.directed_splits(root, index)[0]} == {s[0] for s in splits_} and cost == 4.0
    assert parsimony.consensus(["a"], {})[0].leaf_names() == ["a"] and sorted(parsimony.consensus(["a", "b"], {1: 1.0})[0].leaf_names()) == ["a", "b"]


def test_dated_model_prefers_the_tree_that_agrees():
    s = read_species_tree("(((a:1,b:1):1,c:2):1,(d:1.5,e:1.5):1.5);")
    r = DatedRates(0.01, 0.05, 0.1)
    clock = dated_prepare(s, r)
    same = observe([("(((a_1,b_1),c_1),(d_1,e_1));", 1.0)])
    other = observe([("(((a_1,d_1),c_1),(b_1,e_1));", 1.0)])
    fits = [dated_likelihood(layout(t, Rates()), clock, keep=True) for t in (same, other)]
    assert fits[0].log_likelihood > fits[1].log_likelihood
    best = dated_likelihood(layout(same, Rates()), clock, maximise=True, keep=True)
    assert best.log_likelihood < fits[0].log_likelihood
    text, events = trace(best)
    kinds = [e[0] for e in events]
    assert kinds.count("S") == 4 and kinds.count("D") == 0 and kinds.count("T") == 0 and kinds.count("C") == 5
    _, events = trace(dated_likelihood(layout(other, Rates()), clock, maximise=True, keep=True))
    assert sum(e[0] == "T" for e in events) >= 1
    _, events = trace(fits[1], np.random.default_rng(0))
    assert sum(e[0] == "C" for e in events) == 5
    assert 0 <= clock.extinct.min() and clock.extinct.max() < 1


def test_species_tree_numbers_ages_and_slices():
    s = read_species_tree("((b:1,a:1)x:1,c:2)r;")
    assert s.names == ["a", "b", "c"] and s.parent.tolist() == [3, 3, 4, 4, -1]
    anc = s.ancestors()
    assert anc[0].tolist() == [True, False, False, True, True]
    assert s.ages()[3:].tolist() == pytest.approx([0.5, 1.0])
    parts = slices(s)
    assert [sorted(p[2]) for p in parts] == [[0, 1, 2], [2, 3], [4]]
    c = coalescent_lengths(s)
    assert c.heights()[c.root] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        read_species_tree("(a,b,c);")


def test_simplex_finds_a_minimum():
    f = lambda xs: [float((np.log(x / np.array([0.3, 2.0])) ** 2).sum()) for x in xs]
    x, v, _ = minimise(f, np.array([0.01, 0.01]), np.full(2, 1e-6), np.full(2, 100.0))
    assert x == pytest.approx([0.3, 2.0], rel=0.02) and v < 1e-3


RANKED = "(((l1:1,l2:1)c:1,l3:2)b:1,((l4:1,l5:1)e:1.5,(l6:1,l7:1)f:0.5)d:0.5)a;"


def all_orders(r):
    from itertools import permutations

    return [list(p) for p in permutations(r.inner) if r.valid(list(p))]


def test_ranking_against_all_orders():
    r = ranking.Ranking.of(RANKED)
    rng = np.random.default_rng(0)
    orders = all_orders(r)
    for _ in range(5):
        weights = {(a, b): float(rng.integers(1, 9)) for a, b in product(r.inner, r.inner) if a != b and rng.random() < 0.4}
        best = min(ranking.violated(o, weights) for o in orders)
        for order in (ranking.greedy(r, weights), ranking.mixing(r, weights), r.by_depth()):
            assert r.valid(order)
        found, value = ranking.local_search(r, weights, r.by_depth(), 4000)
        assert r.valid(found) and value == pytest.approx(best)
    far = max(ranking.inversions(a, b) for a in orders for b in orders)
    assert ranking.inversions(*ranking.extremes(r)) == far
    assert ranking.similarity(r, orders[0], orders[0]) == 1
    assert ranking.displacement(["a", "b"], ["b", "a"]) == 2
    assert all(r.valid(ranking.random_order(r, rng)) for _ in range(20))
    assert newick.parse(ranking.ranked_tree(r, r.by_depth())).leaf_names() == ["l1", "l2", "l3", "l4", "l5", "l6", "l7"]


def test_merge_is_the_cheapest_interleaving():
    from itertools import combinations

    rng = np.random.default_rng(1)
    one, two = list("abc"), list("xyz")
    weights = {(p, q): float(rng.integers(0, 5)) for p in one + two for q in one + two if p != q}
    cross = {k: v for k, v in weights.items() if (k[0] in one) != (k[1] in one)}

    def orders():
        for at in combinations(range(6), 3):
            a, b = iter(one), iter(two)
            yield [next(a) if k in at else next(b) for k in range(6)]

    assert ranking.violated(ranking.merge(one, two, weights), cross) == min(ranking.violated(o, cross) for o in orders())


def test_simulated_histories_are_ultrametric():
    rng = np.random.default_rng(3)
    h = simulator.moran(12, rng)
    t = newick.parse(simulator.species_tree(h, [0, 3, 5, 7]))
    assert sorted(t.leaf_names()) == ["S0", "S3", "S5", "S7"]
    assert len({round(newick.distance(t, x), 6) for x in t.leaves()}) == 1
    for g in simulator.gene_trees(h, [0, 3, 5, 7], rng, 0.2, 0.2, 0.2, omega=1.0):
        q = newick.parse(g.newick)
        assert len(q.leaves()) == g.n_genes
        assert len({round(newick.distance(q, x), 6) for x in q.leaves()}) == 1


def test_labels_run_from_the_youngest_to_the_oldest():
    """Read from its end, each event of a label is on the branch where the one before it left the gene."""
    s = read_species_tree("(((a:1,b:1)ab:1,(c:1,d:1)cd:1)abcd:1,(e:1,f:1)ef:2)r;")
    table = observe([("(((a_1,b_1),(c_1,e_1)),(f_1,d_1));", 1.0)])
    rates = Rates(delta=0.1, tau=0.6, lambda_=0.8)
    fit = likelihood(layout(table, rates), prepare(s, rates))
    parent = {s.branch_name(e): s.branch_name(int(s.parent[e])) for e in range(s.n) if s.parent[e] >= 0}
    longest = 0
    for k in range(300):
        text, _ = sample(fit, np.random.default_rng(k))
        for n in newick.parse(text).preorder():
            own = [x for x in (n.name[n.name.find(".") :] if n.is_leaf and "." in n.name else n.label).split(".") if x][::-1]
            longest = max(longest, len(own))
            for one, two in zip(own, own[1:]):
                at = two.split("@")[1].split("->")[0] if "@" in two else two
                assert at == one.split("->")[1] if "->" in one else parent[at] == one, (own, text)
    assert longest >= 3


def test_small_draws_are_those_of_the_generator():
    a, b = np.random.default_rng(5), np.random.default_rng(5)
    draw = simulator.small_draws(b)
    for k in range(3000):
        n = (1, 2, 3, 20, 2**31 + 1, 3 * 2**30)[k % 6]
        assert int(a.integers(n)) == draw(n)
        if k % 4 == 0:
            assert a.standard_exponential() == b.standard_exponential() and a.random() == b.random()
