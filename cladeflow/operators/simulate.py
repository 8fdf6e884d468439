"""Simulation at scale: a seed a row, each simulated where it lies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions import simulator

SIMULATED = "seed long, species_tree string, random_tree string, family string, gene_tree string, n_genes int, duplications int, transfers int, losses int"

#: Rows that a task holds before it hands them on; one seed's are held at once.
HELD_ROWS = 1000

#: Runs along one species history before giving up.
TRIES = 10_000


def simulate(spark: SparkSession, n_seeds: int, population: int = 20, sampled: int = 6, delta: float = 0.1, tau: float = 0.1, lambda_: float = 0.2, omega: float = 0.0, least_trees: int = 1, seed: int = 0, start: float = 2.0, seeds: DataFrame | None = None) -> DataFrame:
    """For each seed a species tree, a random tree on its leaves, and at least so many gene trees of surviving families.

    Seeds are 0 to n_seeds - 1, or the column id of a table of seeds.
    """

    def one(k: int) -> list[tuple]:
        rng = np.random.default_rng([seed, k])
        history = simulator.moran(population, rng, start)
        chosen = sorted(rng.choice(population, sampled, replace=False).tolist())
        tree = simulator.species_tree(history, chosen)
        other = simulator.random_tree([f"S{x}" for x in chosen], rng)
        out: list[tuple] = []
        for _ in range(TRIES):
            for g in simulator.gene_trees(history, chosen, rng, delta, tau, lambda_, omega):
                out.append((k, tree, other, f"{k}-{len(out)}", g.newick, g.n_genes, g.duplications, g.transfers, g.losses))
            if len(out) >= least_trees:
                return out
        raise ValueError(f"{TRIES} runs along the history of seed {k} gave {len(out)} gene trees of {least_trees}")

    names = [c.split()[0] for c in SIMULATED.split(", ")]

    def run(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for k in pdf["id"].tolist():
                rows += one(k)
                if len(rows) >= HELD_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    # Seeds are few bytes but dear, and a table of them would be read as one task for its bytes.
    tasks = spark.sparkContext.defaultParallelism * 4
    given = seeds.select(F.col("id").cast("long").alias("id")).repartition(tasks) if seeds is not None else spark.range(0, n_seeds, 1, min(n_seeds, tasks))
    return given.mapInPandas(run, SIMULATED)
