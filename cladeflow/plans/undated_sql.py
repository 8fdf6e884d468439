"""SQL of the undated model over ladder families and the tree of all nations, written out level by level.

The tree of nations: leaves 1 to 25 by region and key; inner branches 26 to 45 are the ladders
within regions, 46 to 49 join the regions in a row. Lists hold a number for each branch.
"""

from __future__ import annotations

from cladeflow.plans.ladder import LADDER_SQL

N, LEAVES = 49, 25


def _shape() -> tuple[list[int], list[int], list[list[int]]]:
    left, right = [], []
    for r in range(5):
        for k in range(4):
            left.append(r * 5 + 1 if k == 0 else LEAVES + r * 4 + k)
            right.append(r * 5 + 2 + k)
    for u in range(1, 5):
        left.append(LEAVES + 4 if u == 1 else 44 + u)
        right.append(LEAVES + u * 4 + 4)
    parent = {c: LEAVES + 1 + k for k, pair in enumerate(zip(left, right)) for c in pair}
    above = []
    for e in range(1, N + 1):
        path = [e]
        while path[-1] in parent:
            path.append(parent[path[-1]])
        above.append(path)
    return left, right, above


def _climb(own: str, step: str) -> str:
    return f"list_reduce(range({LEAVES + 1}, {N + 1}), lambda acc, b: list_append(acc, {own}[b] + {step}), {own}[1:{LEAVES}])"


def extinction_ctes(delta: float = 0.01, tau: float = 0.01, lambda_: float = 0.1, any_recipient: bool = False, missing: str = "0.0") -> str:
    """missing: the fraction of genes missing of leaf i. Tables k (rates and the tree's shape), nl (name of each leaf, names below each branch) and x (extinction)."""
    left, right, above = _shape()
    anc = "[" + ", ".join("CAST([] AS INTEGER[])" if any_recipient else str(a) for a in above) + "]"
    total = f"(1 + {delta!r}::DOUBLE + {tau!r}::DOUBLE + {lambda_!r}::DOUBLE)"
    meets = "" if tau < 1e-10 else " + e[i] * (mean - {fix}[i]) / norm[i]"
    up = _climb("own", "ps * acc[lf[b - 25]] * acc[rg[b - 25]]")
    each = lambda body: f"list_transform(range(1, {N + 1}), lambda i: {body})"
    out = f"""k AS (SELECT *, list_transform(anc, lambda a: ({N} - len(a)) / pt) AS norm FROM (SELECT {delta!r}::DOUBLE / {total} AS pd, {tau!r}::DOUBLE / {total} AS pt, {lambda_!r}::DOUBLE / {total} AS pl, 1 / {total} AS ps, {left} AS lf, {right} AS rg, {anc} AS anc)),
nl AS (SELECT list_reduce(range({LEAVES + 1}, {N + 1}), lambda acc, b: list_append(acc, list_sort(list_concat(acc[lf[b - 25]], acc[rg[b - 25]]))), names) AS below
 FROM k, (SELECT list(['s' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')] ORDER BY n_regionkey, n_nationkey) AS names FROM nation)),
x0 AS (SELECT k.* EXCLUDE (own), {_climb("own", "ps * acc[lf[b - 25]] * acc[rg[b - 25]]")} AS e FROM (SELECT *, {each("pl")} AS own FROM k) k)"""
    for s in (1, 2, 3):
        out += f""",
x{s} AS (SELECT * EXCLUDE (own, fix), fix, {up} AS e FROM (SELECT * EXCLUDE (e), {each("pl + pd * e[i] * e[i]" + meets.format(fix="fix"))} AS own FROM
 (SELECT *, list_sum(e) AS mean, {each("coalesce(list_sum(list_transform(anc[i], lambda a: e[a])), 0)")} AS fix FROM (SELECT * {"EXCLUDE (mean, fix)" if s > 1 else ""} FROM x{s - 1}))))"""
    out += f""",
x AS (SELECT *, list_sum(e) AS mean_e FROM (SELECT * EXCLUDE (own), {up} AS e FROM (SELECT * EXCLUDE (e), list_concat(list_transform(range(1, {LEAVES + 1}), lambda i: (1 - {missing}) * e[i] + {missing}), {each("pl + pd * e[i] * e[i]" + meets.format(fix="fix"))}[{LEAVES + 1}:]) AS own FROM (SELECT * EXCLUDE (mean), list_sum(e) AS mean FROM x3))))"""
    return out


def undated_ctes(delta: float = 0.01, tau: float = 0.01, lambda_: float = 0.1, any_recipient: bool = False, missing: str = "0.0") -> str:
    """All tables up to root (fam, q4): the values of each family's root on each branch after four sweeps."""
    moves = tau >= 1e-10
    each = lambda body: f"list_transform(range(1, {N + 1}), lambda i: {body})"
    met = " + (x{s}[i] * (list_sum(y{s}) - y{s}[i] * len(anc[i])) + y{s}[i] * (list_sum(x{s}) - x{s}[i] * len(anc[i]))) / norm[i]" if moves else ""
    split = "p * (pd * x{s}[i] * y{s}[i]" + met + " + CASE WHEN i > 25 THEN ps * (x{s}[lf[i - 25]] * y{s}[rg[i - 25]] + x{s}[rg[i - 25]] * y{s}[lf[i - 25]]) ELSE 0 END)"
    up = _climb("v", "ps * (acc[lf[b - 25]] * e[rg[b - 25]] + acc[rg[b - 25]] * e[lf[b - 25]])")

    def settle(table: str, to: str) -> str:
        """Four sweeps over the lists b1 to b4 of a table."""
        rows = f"SELECT fam, g, b1, b2, b3, b4, x.* FROM {table}, x"
        for s in (1, 2, 3, 4):
            old = f"q{s - 1}"
            lost = f"b{s}[i]" if s == 1 else f"b{s}[i] + {old}[i] * 2 * pd * e[i]" + (f" + {old}[i] * (mean_e - fix[i]) / norm[i] + (list_sum({old}) - {old}[i] * len(anc[i])) / norm[i] * e[i]" if moves else "")
            rows = f"SELECT * EXCLUDE (v), {up} AS q{s} FROM (SELECT *, {each(lost)} AS v FROM ({rows}))"
        return f"{to} AS (SELECT fam, g, q1, q2, q3, q4 FROM ({rows}))"

    out = f"""{LADDER_SQL}, {extinction_ctes(delta, tau, lambda_, any_recipient, missing)},
l1 AS (SELECT DISTINCT fam, CAST(pow(2, c) AS BIGINT) AS g, {", ".join(f"{each('CASE WHEN i = CAST(fam AS INT) * 5 + c + 1 THEN ps ELSE 0 END')} AS b{s}" for s in (1, 2, 3, 4))} FROM s, k, (SELECT unnest(range(5)) AS c)),
{settle("l1", "v1")}"""
    pairs = "SELECT DISTINCT fam, CAST(31 AS BIGINT) AS g, least(g, 31 - g) AS gp, greatest(g, 31 - g) AS gpp, CASE WHEN size IN (1, 4) THEN 1.0 ELSE cnt / observations END AS p FROM bip CROSS JOIN o"
    for size in (2, 3, 4, 5):
        rows = pairs if size == 5 else f"SELECT fam, g, gp, gpp, p FROM ccp WHERE bit_count(g) = {size}"
        before = " UNION ALL ".join(f"SELECT * FROM v{j}" for j in range(1, size))
        sums = ", ".join(f"{each(f'list_sum(list_transform(c{s}, lambda c: c[i]))')} AS b{s}" for s in (1, 2, 3, 4))
        out += f""",
d{size} AS (SELECT d.fam, d.g, d.p, {", ".join(f"a.q{s} AS x{s}, b.q{s} AS y{s}" for s in (1, 2, 3, 4))} FROM ({rows}) d JOIN ({before}) a ON a.fam = d.fam AND a.g = d.gp JOIN ({before}) b ON b.fam = d.fam AND b.g = d.gpp),
l{size} AS (SELECT fam, g, {sums} FROM (SELECT fam, g, {", ".join(f"list(m{s}) AS c{s}" for s in (1, 2, 3, 4))} FROM (SELECT fam, g, {", ".join(f"{each(split.format(s=s))} AS m{s}" for s in (1, 2, 3, 4))} FROM d{size}, k) GROUP BY fam, g)),
{settle(f"l{size}", f"v{size}")}"""
    return out + ",\nroot AS (SELECT fam, q4 FROM v5)"


def loglik_sql(origin_root: float = 1.0, **rates) -> str:
    top = f"list_sum(q4) + {origin_root - 1!r} * q4[{N}]"
    norm = f"ln({N - 1 + origin_root!r}::DOUBLE) - ln({N}::DOUBLE)"
    return f"WITH {undated_ctes(**rates)} SELECT fam AS family, round(ln({top}) - ln(list_sum(list_transform(e, lambda z: 1 - z))) - ({norm}), 6) AS logl FROM root, x"
