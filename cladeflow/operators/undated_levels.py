"""The undated likelihood level by level: clades of one size at a time, joined with their splits.

A clade's values depend on those of smaller clades alone, so one job a size serves all families:
splits of that size meet the values of both parts, each task adds up what it has of a clade,
and the sums of a clade meet where its own recursion over the species tree is run. A clade is
a row, so a family may be larger than any task; nothing is gathered by family. A row holds the
values of every sweep of the fixed-point iteration, scaled by the logarithm of the largest.
``reconcile.loglik`` computes the same with a family a row, which is faster for small families.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.species_tree import read_species_tree
from cladeflow.functions.undated_model import Branches, Rates, prepare
from cladeflow.operators import ccp, splits
from cladeflow.operators.stored import shared_path, stored

#: values: sweep by sweep, a value for each branch; the true ones are exp(scale) times as large.
VALUES = "family string, clade binary, scale double, `values` array<double>"
#: Bytes of an Arrow batch, as a row holds a few numbers for each branch and sweep.
BATCH_BYTES = 64 << 20
LEAST = 1e-300


class Steps:
    """What the recursion needs of the branches, in double precision."""

    def __init__(self, b: Branches):
        real = lambda x: np.asarray(x, dtype=np.float64)
        tree = b.tree
        self.sweeps, self.n, self.n_leaves = b.rates.sweeps, tree.n, tree.n_leaves
        self.left, self.right = tree.left, tree.right
        self.pd, self.ps, self.norm, self.weight, self.extinct, self.origin = map(real, (b.pd, b.ps, b.norm, b.weight, b.extinct, b.origin))
        self.blocked = real(b.blocked)
        self.own_blocked = self.blocked @ self.weight
        self.moves, self.exact = not b.no_transfer, b.rates.exact_correction
        self.gone = real((b.mean_extinct - b.correction) / b.norm) * self.moves

    def moved(self, q: np.ndarray) -> np.ndarray:
        """What a transfer from each branch meets: values elsewhere, over the donor's norm. q: any axes, then branches."""
        fix = (q * self.weight) @ self.blocked.T if self.exact else q * self.own_blocked
        return ((q @ self.weight)[..., None] - fix) / self.norm

    def split(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The value of splits into clades with values x and y (splits, sweeps, branches)."""
        out = self.pd * x * y
        if self.moves:
            out += x * self.moved(y) + y * self.moved(x)
        inner = np.arange(self.n_leaves, self.n)
        f, g = self.left[inner], self.right[inner]
        out[..., inner] += self.ps[inner] * (x[..., f] * y[..., g] + x[..., g] * y[..., f])
        return out

    def settle(self, base: np.ndarray) -> np.ndarray:
        """Clades' values from what their splits give (clades, sweeps, branches): losses, and transfers followed by loss, by sweeps."""
        out, old = np.empty_like(base), np.zeros((len(base), self.n))
        for s in range(self.sweeps):
            value = base[:, s] + old * (2 * self.pd * self.extinct + self.gone)
            if self.moves:
                value += self.moved(old) * self.extinct
            value[:, : self.n_leaves] = np.maximum(value[:, : self.n_leaves], LEAST)
            for k in range(self.n_leaves, self.n):
                f, g = self.left[k], self.right[k]
                value[:, k] = np.maximum(value[:, k] + self.ps[k] * (value[:, f] * self.extinct[g] + value[:, g] * self.extinct[f]), LEAST)
            out[:, s] = old = value
        return out


def _array(column: pa.ChunkedArray | pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, *shape)


def _lists(x: np.ndarray) -> pa.Array:
    flat = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))


def _scaled(scale: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values with a largest one of 1 in each row."""
    top = x.reshape(len(x), -1).max(axis=1, initial=0.0)
    top = np.where(top > 0, top, 1.0)
    return scale + np.log(top), x / top[:, None, None]


def _sums(keys: list[tuple], scale: np.ndarray, x: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Rows of equal keys added up."""
    place: dict[tuple, int] = {}
    of = np.array([place.setdefault(k, len(place)) for k in keys], dtype=np.int64)
    top = np.full(len(place), -np.inf)
    np.maximum.at(top, of, scale)
    out = np.zeros((len(place), *x.shape[1:]))
    np.add.at(out, of, x * np.exp(scale - top[of])[:, None, None])
    return list(place), top, out


def _batch(keys: list[tuple], scale: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    family, clade = zip(*keys) if keys else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(family, pa.string()), pa.array(clade, pa.binary()), pa.array(scale, pa.float64()), _lists(x)], ["family", "clade", "scale", "values"])


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(batch.column("family").to_pylist(), batch.column("clade").to_pylist()))


def _of_splits(steps: Steps):
    """Rows family, clade, p and the values of both parts: each batch's sums by clade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (steps.sweeps, steps.n)
        for batch in batches:
            if batch.num_rows:
                x, y = (_array(batch.column(c), shape) for c in ("x", "y"))
                each = steps.split(x, y) * np.asarray(batch.column("p"))[:, None, None]
                scale = np.asarray(batch.column("x_scale")) + np.asarray(batch.column("y_scale"))
                keys, scale, x = _sums(_keys(batch), scale, each)
                yield _batch(keys, *_scaled(scale, x))

    return run


def _settled(steps: Steps):
    """Sums sorted by clade: those of a clade added up as they come, then its own recursion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (steps.sweeps, steps.n)
        held: tuple[list, np.ndarray, np.ndarray] | None = None

        def done(keys, scale, x):
            return _batch(keys, *_scaled(scale, steps.settle(x)))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, scale, x = _keys(batch), np.asarray(batch.column("scale")), _array(batch.column("values"), shape)
            if held is not None:  # the clade that the batch before ended with may go on
                keys, scale, x = held[0] + keys, np.concatenate([held[1], scale]), np.concatenate([held[2], x])
            keys, scale, x = _sums(keys, scale, x)
            held = keys[-1:], scale[-1:], x[-1:]
            if len(keys) > 1:
                yield done(keys[:-1], scale[:-1], x[:-1])
        if held is not None:
            yield done(*held)

    return run


def leaf_clades(fams: DataFrame) -> DataFrame:
    """family, n_leaves, clade, gene: the clade of each leaf, as bytes."""
    one = fams.select("family", "n_leaves", F.posexplode("leaves").alias("k", "gene"))
    after = F.floor(F.col("k") / 8).cast("int")
    before = F.ceil(F.col("n_leaves") / 8).cast("int") - 1 - after
    digit = F.lpad(F.hex(F.expr("shiftleft(1, k % 8)")), 2, "0")
    return one.select("family", "n_leaves", F.unhex(F.concat(F.repeat(F.lit("00"), before), digit, F.repeat(F.lit("00"), after))).alias("clade"), "gene")


def level_splits(facts: DataFrame, fams: DataFrame, rates: Rates) -> DataFrame:
    """family, size, clade, left, right, p: every split with its probability, and for the root (all leaves) every pair of complements."""
    low = F.lit(rates.min_bip_count)
    counts = splits.bips(facts).select("family", "clade", F.coalesce("cnt", F.lit(0.0)).alias("n"))
    power = lambda p: F.pow(p, F.lit(rates.seq_beta)) if rates.seq_beta != 1 else p
    inner = ccp.split_probabilities(facts, fams).select("family", "size", "clade", "left", "right", F.when(F.col("clade_cnt") <= low, 0.0).otherwise(power(F.col("p_dip"))).alias("p"))
    seen = ccp.clade_probabilities(facts, fams).filter("cnt > 0")
    pairs = seen.groupBy("family", "n_leaves", F.least("clade", "other").alias("left"), F.greatest("clade", "other").alias("right")).agg(F.max("p_bip").alias("p"))
    if rates.min_bip_count >= 0:
        most = pairs.join(counts.withColumnsRenamed({"clade": "left", "n": "_a"}), ["family", "left"], "left").join(counts.withColumnsRenamed({"clade": "right", "n": "_b"}), ["family", "right"], "left")
        dropped = (F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))) <= low) & (F.col("n_leaves") >= 4)
        pairs = most.withColumn("p", F.when(dropped, 0.0).otherwise(F.col("p")))
    root = F.unhex(F.concat(F.lpad(F.hex(F.expr("shiftleft(1, (n_leaves - 1) % 8 + 1) - 1")), 2, "0"), F.repeat(F.lit("ff"), F.ceil(F.col("n_leaves") / 8).cast("int") - 1)))
    return inner.unionByName(pairs.select("family", F.col("n_leaves").alias("size"), root.alias("clade"), "left", "right", power(F.col("p")).alias("p")))


def clade_values(facts: DataFrame, fams: DataFrame, species: str, rates: Rates | None = None) -> tuple[DataFrame, Branches]:
    """family, n_leaves, clade, scale, values of every clade, the root's among them, and the branches' probabilities."""
    rates, spark = rates or Rates(), facts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    tree = read_species_tree(species)
    b = prepare(tree, rates)
    steps, path = Steps(b), shared_path(spark, "clade-values")
    fams, facts = stored(fams.select("family", "n_leaves", "leaves", "observations"), "families"), stored(facts, "facts")
    every = stored(level_splits(facts, fams, rates).repartition("family", "clade"), "splits")
    # The branches are a species tree's: its leaves by name are a list of bounded size.
    parts = F.split("gene", "[" + "".join("\\" + c for c in rates.separators) + "]+")
    name = F.array_join(F.slice(parts, 2, 1 << 20), "_") if rates.species_field == -1 else F.get(parts, F.lit(rates.species_field))
    place = F.try_element_at(F.create_map(*(F.lit(x) for k, s in enumerate(tree.names) for x in (s, k))), name)
    known = F.when(place.isNotNull(), place).otherwise(F.raise_error(F.concat(F.lit("species not in the tree: "), F.coalesce(name, F.lit("none")))).cast("int"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("at"))
            base = np.zeros((len(at), steps.sweeps, steps.n))
            base[np.arange(len(at)), :, at] = steps.ps[at][:, None]
            yield _batch(_keys(batch), *_scaled(np.zeros(len(at)), steps.settle(base)))

    leaf_clades(fams).select("family", "clade", known.alias("at")).mapInArrow(leaves, VALUES).write.parquet(f"{path}/size=1")
    done = [1]
    for size in sorted(r[0] for r in every.select("size").distinct().collect()):  # sizes are at most the leaves of a family
        values = spark.read.schema(VALUES).parquet(*(f"{path}/size={k}" for k in done))
        side = lambda c, v: values.select("family", F.col("clade").alias(c), F.col("scale").alias(f"{v}_scale"), F.col("values").alias(v))  # noqa: E731, B023
        met = every.filter(F.col("size") == size).join(side("left", "x"), ["family", "left"]).join(side("right", "y"), ["family", "right"])
        sums = met.select("family", "clade", "p", "x", "x_scale", "y", "y_scale").mapInArrow(_of_splits(steps), VALUES)
        sums.repartition("family", "clade").sortWithinPartitions("family", "clade").mapInArrow(_settled(steps), VALUES).write.parquet(f"{path}/size={size}")
        done.append(size)
    values = spark.read.schema(VALUES).parquet(*(f"{path}/size={k}" for k in done))
    return fams.select("family", "n_leaves").join(values, "family"), b


def origination_loglik(facts: DataFrame, fams: DataFrame, species: str, rates: Rates | None = None) -> DataFrame:
    """family, branch, branch_name, value, logl: of each family's root, the value on each branch (scaled), and the log likelihood of an origination there."""
    values, b = clade_values(facts, fams, species, rates)
    tree, origin = b.tree, [float(x) for x in b.origin]
    roots = values.filter(splits.clade_size(F.col("clade")) == F.col("n_leaves"))
    last = F.slice("values", b.rates.sweeps * tree.n - tree.n + 1, tree.n)
    one = roots.select("family", "scale", F.posexplode(last).alias("branch", "q"))
    weight = F.get(F.array(*map(F.lit, origin)), F.col("branch"))
    name = F.get(F.array(*(F.lit(tree.branch_name(e)) for e in range(tree.n))), F.col("branch"))
    value = F.log("q") + F.col("scale") + F.log(weight) - F.log(F.lit(sum(origin)))
    return one.select("family", "branch", name.alias("branch_name"), "scale", (F.col("q") * weight).alias("value"), value.alias("logl"))


def loglik(facts: DataFrame, fams: DataFrame, species: str, rates: Rates | None = None) -> DataFrame:
    """family, logl: the log likelihood of each family, as ``reconcile.loglik`` gives it."""
    rates = rates or Rates()
    b = prepare(read_species_tree(species), rates)
    shift = float(-np.log((1 - b.extinct).sum()) - np.log(b.origin.sum()) + np.log(b.tree.n))
    terms = origination_loglik(facts, fams, species, rates)
    return terms.groupBy("family").agg((F.log(F.sum("value")) + F.first("scale") + F.lit(shift)).alias("logl"))
