"""The tagged text form of a clade table.

Sections, each led by a line with its tag: constructor string; observations; counts of
clades; sums of branch lengths; counts of splits; highest clade id; leaf numbers from 1;
and the leaves of each clade after a colon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.clade_table import CladeTable

# The tags of the format.
TAGS = ("#constructor_string", "#observations", "#Bip_counts", "#Bip_bls", "#Dip_counts", "#last_leafset_id", "#leaf-id", "#set-id", "#END")


def loads(text: str) -> CladeTable:
    """Read one table; leaves and clades are numbered anew, by name and leaf set."""
    part: dict[str, list[list[str]]] = {t: [] for t in TAGS}
    now = None
    for line in text.splitlines():
        if line.strip() in part:
            now = part[line.strip()]
        elif line.strip() and now is not None:
            now.append(line.split())
    given = {int(k): name for name, k in part["#leaf-id"]}
    leaves = sorted(given.values())
    place = {name: k for k, name in enumerate(leaves)}
    mask = {int(r[0]): sum(1 << place[given[int(x)]] for x in r[1:] if x != ":" and int(x)) for r in part["#set-id"]}
    mask = {k: m for k, m in mask.items() if m}
    dips: dict[tuple[int, int, int], float] = {}
    for g, a, b, n in part["#Dip_counts"]:
        a, b = sorted((mask[int(a)], mask[int(b)]))
        dips[mask[int(g)], a, b] = float(n)
    bips = {mask[int(g)]: float(n) for g, n in part["#Bip_counts"]}
    lengths = {mask[int(g)]: float(n) for g, n in part["#Bip_bls"] if int(g) in mask}
    return CladeTable(leaves, float(part["#observations"][0][0]), bips, dips, lengths)


def dumps(table: CladeTable, constructor: str | None = None) -> str:
    """Write one table; clades get ids in their order, leaves first, from 1."""
    ids = {g: k + 1 for k, g in enumerate(table.order())}
    num = lambda x: f"{x:.12g}"
    out = [TAGS[0], constructor or ",".join(table.leaves), TAGS[1], num(table.observations), TAGS[2]]
    out += [f"{ids[g]}\t{num(table.bips[g])}" for g in sorted(table.bips, key=ids.get)]
    out += [TAGS[3], *(f"{ids[g]}\t{num(table.lengths[g])}" for g in sorted(table.lengths, key=ids.get) if g in ids)]
    rows = sorted((ids[g], *sorted((ids[a], ids[b])), n) for (g, a, b), n in table.dips.items())
    out += [TAGS[4], *(f"{g}\t{a}\t{b}\t{num(n)}" for g, a, b, n in rows), TAGS[5], str(len(ids)), TAGS[6]]
    out += [f"{name}\t{k + 1}" for k, name in enumerate(table.leaves)]
    out += [TAGS[7], *(f"{k}\t:\t" + "\t".join(str(i + 1) for i in range(table.n) if g >> i & 1) for g, k in ids.items()), TAGS[8]]
    return "\n".join(out) + "\n"


def read_posteriors(spark: SparkSession, path: str) -> DataFrame:
    """(family, text) of the tables in the files under path, one file each; the family is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("family"))
    return files.select("family", "text")
