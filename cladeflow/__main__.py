"""python -m cladeflow PROGRAM key=value...: run one program on files and write its tables.

observe trees= out= [burnin= every= until=]
add tables= trees= out= [weight= burnin= every= until=]
prune tables= keep=a,b,c|keep_file=(names, one a line, or a tree) out=
count tables=   best tables=   score tables= trees=   leaves trees=
fit species= tables= out= [samples= seed= MODEL fixed=delta,tau,lambda DT= MLOR=1]
evaluate species= trees= out= [samples= seed= MODEL]
mcmc species= tables= out= [steps= burnin= sampling_rate= samples= seed= every= MODEL]
dated species= tables= out= [what=fit|best|samples|mcmc samples= steps= burnin= thin= seed= delta= tau= lambda= sigma= population= step= free_sigma=1]
resample reports= tables= out= [samples=]
constraints species= tables= out= [samples= least=]
rank species= constraints=   pack times= out= [cpus= policy=]   simulate seeds= out=

MODEL: delta= tau= lambda= O_R= beta= separators= species_field= fraction_missing=(file of
species:fraction) reldate=1 S_branch_lengths=1 rate_multiplier=kind,branch,value;...
Programs that fit or sample write a folder for each table.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from cladeflow import api
from cladeflow.functions import newick
from cladeflow.functions.dated_model import DatedRates
from cladeflow.functions.undated_model import Rates
from cladeflow.operators import ccp, dated, reconcile, splits
from cladeflow.sources import readers, writers


def model_rates(spark: SparkSession, o: dict[str, str]) -> Rates:
    """The rates and options of the undated model that the command line gives."""
    r = Rates()
    kinds: dict[str, dict[int, float]] = {}
    for part in filter(None, o.get("rate_multiplier", "").split(";")):
        kind, branch, value = part.split(",")
        kinds.setdefault(kind, {})[int(branch)] = float(value)
    unknown = kinds.keys() - {"delta", "tau_to", "tau_from", "lambda", "O"}
    if unknown:
        raise SystemExit(f"no such kinds of multipliers: {sorted(unknown)}")
    missing = {x["species"]: x["fraction"] for x in readers.fraction_missing(spark, o["fraction_missing"]).collect()} if "fraction_missing" in o else {}  # a line for each species
    number = lambda k, default: float(o.get(k, default))
    return r.of(
        delta=number("delta", r.delta), tau=number("tau", r.tau), lambda_=number("lambda", r.lambda_), origin_root=number("O_R", r.origin_root), seq_beta=number("beta", r.seq_beta), separators=o.get("separators", r.separators),
        species_field=int(o.get("species_field", r.species_field)), by_date=o.get("reldate", "0") == "1", scale_lengths=o.get("S_branch_lengths", "0") == "1", missing=missing, multipliers=kinds,
    )


def kept_species(spark: SparkSession, o: dict[str, str]) -> list[str]:
    """The species to keep: a list, the lines of a file, or the leaves of the tree in it."""
    if "keep" in o:
        return o["keep"].split(",")
    lines = [r["line"].strip() for r in readers.numbered_lines(spark, o["keep_file"]).orderBy("line_no").collect()]  # a list of species
    trees = [x for x in lines if "(" in x]
    return newick.parse(trees[0]).leaf_names() if trees else [x for x in lines if x]


def run_dated(tables, species: str, o: dict[str, str]):
    """The table that the dated program is asked for."""
    what = o.get("what", "fit")
    base = DatedRates(delta=0.01, tau=0.01, lambda_=0.1) if what in ("fit", "mcmc") else DatedRates()  # where searches start
    number = lambda k, default: type(default)(o.get(k, default))
    rates = base.of(delta=number("delta", base.delta), tau=number("tau", base.tau), lambda_=number("lambda", base.lambda_), sigma=number("sigma", base.sigma), population=number("population", base.population), step=number("step", base.step))
    seed = number("seed", 0)
    if what == "fit":
        return dated.fit(tables, species, rates, o.get("free_sigma") == "1")
    if what == "best":
        return dated.best_reconciliation(tables, species, rates)
    if what == "samples":
        return dated.samples(tables, species, rates, number("samples", 100), seed)
    if what == "mcmc":
        return dated.mcmc(tables, species, rates, number("steps", 200), number("burnin", 50), number("thin", 10), seed)
    raise SystemExit(f"dated does not know {what}")


def main(args: list[str]) -> None:
    if not args or args[0] in ("-h", "--help"):
        print(__doc__)
        return
    program, o = args[0], readers.key_values(args[1:])
    spark = SparkSession.builder.appName(f"cladeflow {program}").getOrCreate()
    number = lambda k, default: type(default)(o.get(k, default))
    species = readers.species_tree(spark, o["species"]) if "species" in o else ""
    tables = api.load(spark, o["tables"]) if "tables" in o else None
    trees = readers.tree_samples(spark, o["trees"], burnin=number("burnin", 0), every=number("every", 1), until=number("until", -1)) if "trees" in o else None
    if program == "observe":
        api.save(api.observe(spark, o["trees"], number("burnin", 0), number("every", 1), number("until", -1)), o["out"])
    elif program == "count":
        api.count_trees(tables).show(truncate=False)
    elif program == "best":
        api.best_trees(tables).show(truncate=False)
    elif program == "score":
        api.score(tables, trees).show(truncate=False)
    elif program == "add":
        more = readers.tree_samples(spark, o["trees"], burnin=number("burnin", 0), every=number("every", 1), until=number("until", -1), mode="add")
        api.save(api.add(tables, more, number("weight", 1.0)), o["out"])
    elif program == "prune":
        facts, fams = ccp.prune(splits.facts_of(tables), tables.drop("facts"), kept_species(spark, o))
        api.save(splits.nest(facts.select("family", "clade", "left", "right", "cnt", "bl"), fams), o["out"])
    elif program == "resample":
        api.resample(spark, o["reports"], tables, number("samples", 100)).write.parquet(o["out"])
    elif program == "constraints":
        n = number("samples", 100)
        sampled = reconcile.samples(tables, species, api.fit_undated(tables, species), n)
        writers.constraint_lines(api.constraints(sampled, spark, species, n, number("least", 0.05))).write.text(o["out"])
    elif program == "leaves":
        api.leaf_census(trees).show(truncate=False)
    elif program in ("fit", "evaluate"):
        rates, n, seed = model_rates(spark, o), number("samples", 100), number("seed", 0)
        if program == "fit":
            named = {"lambda": "lambda_"}
            fixed = tuple(named.get(k, k) for k in filter(None, o.get("fixed", "").split(",")))
            ratio = float(o["DT"]) if "DT" in o else None
            fits = api.fit_undated(tables, species, rates, fixed, ratio, o.get("MLOR") == "1")
            got = api.reconcile_all(tables, species, fits, n, seed, rates)
        else:
            got = api.reconcile_all(splits.tables(trees), species, rates, n, seed)
        for name, df in got.items():
            df.write.parquet(f"{o['out']}/{name}")
    elif program == "mcmc":
        rates, seed, steps = model_rates(spark, o), number("seed", 0), number("steps", 1000)
        chain = reconcile.mcmc_blocks(tables, species, f"{o['out']}/blocks", rates, steps, number("every", 100), number("burnin", 100), number("sampling_rate", 10), seed)
        for name, df in api.chain_report(tables, chain, species, rates, number("samples", 1), seed).items():
            df.write.parquet(f"{o['out']}/{name}")
    elif program == "dated":
        run_dated(tables, species, o).write.parquet(o["out"])
    elif program == "simulate":
        api.simulate_trees(spark, number("seeds", 1)).write.parquet(o["out"])
    elif program == "rank":
        got = api.rank(species, readers.constraints(spark, o["constraints"]))
        print(got["tree"], got["value"], got["heuristics"], sep="\n")
    elif program == "pack":
        api.pack(readers.runtimes(spark, o["times"]), number("cpus", 64), o.get("policy", "conservative")).write.csv(o["out"], sep="\t")
    else:
        raise SystemExit(f"no program {program}\n{__doc__}")


if __name__ == "__main__":
    main(sys.argv[1:])
