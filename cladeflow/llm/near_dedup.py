"""MinHash near-deduplication: banded universal-hash minima, full-set checks, star components.

A document's set holds its distinct word shingles. Documents with equal sets form a
class, and only classes are compared. Each class gets 128 minima of universal hashes; 32
bands of 4 minima give buckets. At the similarity 0.8 a pair shares no bucket once in 2e7.

Pairs come from the buckets without emitting all pairs of a bucket: first every class is
paired with one member of each of its buckets, chosen by another order in each band;
links that hold join components. What is left in a bucket, classes outside its largest
component, is then held against the bucket's members of other components: both sides are
packed into parts of bounded size, each part of one side meets each of the other as one row,
which compares minima as matrices, and classes with a near one go on to a second such pass
with their full sets. So no link that could join two components is passed over. A pair whose
minima agree in fewer than 77 of 128 places is left (at the similarity 0.8, once in 1.3e7);
all others are decided on their full sets.

Defined cases: a null text is empty; an empty set is linked with nothing; a row with a null
doc_id shares the component of equal sets, is in none (null, and kept) where no row with an
id has its set, and never links others; rows that repeat a doc_id are judged each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import HOT_SHARE, bounded_batches, join_by_group, mix, scratch_table, texts, worker_store
from cladeflow.llm.components import components

BANDS, ROWS = 32, 4
N_MINIMA = BANDS * ROWS
#: Of N_MINIMA, those that must agree for a pair to be checked on full sets.
MIN_AGREE = 77
#: Classes, and bytes of them, on each side of a tile, in the mean.
TILE, TILE_BYTES = 2048, 8 << 20
#: Classes whose sets are fetched by broadcasting their ids; more of them are fetched by a shuffle join.
BROADCAST_ROWS = 1_000_000
#: Words whose hashes a worker keeps; beyond it the store starts anew.
CACHE_WORDS = 400_000
SEED = 7
_P = np.uint64(0x9E3779B185EBCA87)


class WordHashes(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def word_hashes() -> WordHashes:
    """The worker's own, a bounded number."""
    hashes = worker_store("word_hashes").setdefault("hashes", WordHashes())
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    return hashes


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), dtype=np.uint64, count=n)
    with np.errstate(over="ignore"):
        if n < width:
            x = np.array([n], dtype=np.uint64)
            for one in h:
                x = mix(x * _P + one)
            return x
        x = h[: n - width + 1].copy()
        for k in range(1, width):
            x = x * _P + h[k : n - width + 1 + k]
        return np.unique(mix(x))


def hash_family(n: int = N_MINIMA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, size=n, dtype=np.uint64)[:, None]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each hash a * x + b."""
    best = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(best, (shingles[None, at : at + 512] * a + b).min(axis=1), out=best)
    return (mix(best) >> np.uint64(48)).astype("<u2")


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_family()
        for batch in batches:
            sizes, highs, lows, signs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                sizes.append(len(s))
                highs.append((key >> 64) - (1 << 63))
                lows.append((key & ((1 << 64) - 1)) - (1 << 63))
                signs.append(minima(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (sizes, highs, lows)), pa.array(signs, pa.binary())], ["doc_id", "key", "n_shingles", "k1", "k2", "minima"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            cids, sets = [], []
            for cid, k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if cid in done:
                    continue
                data = shingle_set(text, width).tobytes()
                key = xxhash.xxh3_128_intdigest(data)
                if (key >> 64) - (1 << 63) == k1 and (key & ((1 << 64) - 1)) - (1 << 63) == k2:
                    done.add(cid)
                    cids.append(cid)
                    sets.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, N_MINIMA) for i in (2, 3))
        agree = (x == y).sum(axis=1)
        keep = pa.array(agree >= MIN_AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(agree[agree >= MIN_AGREE].astype(np.int32))], ["u", "v", "agree"])


def _near_in_tile(few: dict[str, np.ndarray], every: dict[str, np.ndarray], band: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each left-over class of a tile, the places of other components' classes that are near it by size and minima.

    A pair that shares several buckets is seen in the one of its first band alone.
    """
    comp, n, sign = every["comp"], every["n_shingles"], every["minima"]
    for i in range(len(few["cid"])):
        own = few["n_shingles"][i]
        able = np.flatnonzero((comp != few["comp"][i]) & (100 * np.minimum(n, own) >= percent * np.maximum(n, own)))
        if not len(able):
            continue
        same = sign[able] == few["minima"][i]
        near = same.sum(axis=1) >= MIN_AGREE
        near[near] = same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        if near.any():
            yield i, able[near]


#: What a tile holds of a class; a second pass adds its set.
CLASS = ("cid", "comp", "n_shingles", "minima")
NEAR = "bucket long, band int, side int, cid long, comp long, n_shingles long, minima binary"


def _side(part: pa.StructArray) -> dict:
    """The classes of one side of a tile as arrays; sets, if there are any, as a list."""
    own = {c: part.field(c) for c in CLASS}
    out = {c: own[c].to_numpy() for c in CLASS[:3]} | {"minima": np.frombuffer(b"".join(own["minima"].to_pylist()), dtype="<u2").reshape(-1, N_MINIMA)}
    if part.type.get_field_index("shingles") >= 0:
        out["sets"] = [np.frombuffer(x, dtype=np.uint64) for x in part.field("shingles").to_pylist()]
    return out


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.StructArray, pa.StructArray]]:
    """bucket, band and both sides of each tile, which is one row."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values, batch.column(3)[k].values


def _tile_near(percent: int):
    """The classes of a tile that have a near one of another component on the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, band, few, every in _tile_rows(batches):
            hit = [np.zeros(len(few), dtype=bool), np.zeros(len(every), dtype=bool)]
            for i, able in _near_in_tile(_side(few), _side(every), band, percent):
                hit[0][i] = True
                hit[1][able] = True
            for side, part in enumerate((few, every)):
                if n := int(hit[side].sum()):
                    kept = part.filter(pa.array(hit[side]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket] * n, pa.int64()), pa.array([band] * n, pa.int32()), pa.array([side] * n, pa.int32()), *(kept.field(c) for c in CLASS)], [f.split()[0] for f in NEAR.split(", ")]
                    )

    return run


def similar_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _tile_links(percent: int):
    """Links between components found in a tile on full sets, one for each two components that they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, band, few, every in _tile_rows(batches):
            few, every = _side(few), _side(every)
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while c in joined:
                    c = joined[c]
                return c

            u, v = [], []
            for i, able in _near_in_tile(few, every, band, percent):
                for j in able.tolist():
                    a, b = root(int(few["comp"][i])), root(int(every["comp"][j]))
                    if a != b and similar_enough(few["sets"][i], every["sets"][j], percent):
                        joined[max(a, b)] = min(a, b)
                        u.append(int(few["cid"][i]))
                        v.append(int(every["cid"][j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep.append(similar_enough(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return run


class _Linker:
    """Checks pairs of classes and keeps the components that the links so far make."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.sets: list[DataFrame] = []
        self.stars: DataFrame | None = None

    def labelled(self, rows: DataFrame, key: str, label: str) -> DataFrame:
        if self.stars is None:
            return rows.withColumn(label, F.col(key))
        stars = self.stars.select(F.col("u").alias(key), F.col("v").alias("_least"))
        return rows.join(stars, key, "left").withColumn(label, F.coalesce("_least", key)).drop("_least")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        return self.labelled(self.labelled(pairs, "u", "_cu"), "v", "_cv").filter("_cu != _cv").drop("_cu", "_cv")

    def similar(self, pairs: DataFrame) -> DataFrame:
        x, y = (self.classes.select(F.col("cid").alias(end), F.col("minima").alias(f"_{k}"), F.col("n_shingles").alias(f"_n{k}")) for end, k in (("u", "x"), ("v", "y")))
        met = pairs.select("u", "v").join(x, "u").join(y, "v")
        met = met.filter(100 * F.least("_nx", "_ny") >= self.percent * F.greatest("_nx", "_ny"))
        return met.select("u", "v", "_x", "_y").mapInArrow(_agreeing, "u long, v long, agree int")

    def prepare(self, wanted: DataFrame) -> None:
        """Store the sets of the classes (cid) that have none yet."""
        wanted = wanted.select("cid").distinct()
        for have in self.sets:
            wanted = wanted.join(have.select("cid"), "cid", "left_anti")
        wanted = scratch_table(wanted, "wanted")
        n = wanted.count()
        if not n:
            return
        first = self.classes.join(wanted, "cid", "left_semi").select("cid", "k1", "k2", F.col("first_id").alias("doc_id"))
        if n <= BROADCAST_ROWS:
            first = F.broadcast(first)
        rows = texts(self.docs).join(first, "doc_id").select("cid", "k1", "k2", F.col("text").cast("binary").alias("text"))
        # A doc_id may come many times with one text; its set is then needed once.
        self.sets.append(scratch_table(rows.mapInArrow(_sets(self.width), "cid long, shingles binary").dropDuplicates(["cid"]), "sets"))

    def check(self, pairs: DataFrame) -> None:
        """Decide stored pairs on full sets and join components by the links found."""
        self.prepare(pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid"))))
        if not self.sets:
            return
        sets = reduce(DataFrame.unionByName, self.sets)
        x, y = (sets.select(F.col("cid").alias(end), F.col("shingles").alias(name)) for end, name in (("v", "_y"), ("u", "_x")))
        met = pairs.select("u", "v").join(x, "v").join(y, "u").select("u", "v", "_x", "_y")
        self.found(met.mapInArrow(_linked(self.percent), "u long, v long"))

    def found(self, links: DataFrame) -> None:
        found = scratch_table(links, "near-links")
        if found.isEmpty():
            return
        known = [found] if self.stars is None else [found, self.stars]
        self.stars = components(reduce(DataFrame.unionByName, known))


def _tiles(rows: DataFrame, *more: str) -> DataFrame:
    """bucket, band, few and every: tiles that hold each class of side 0 against each of side 1 of its bucket.

    A side is first packed into parts of about TILE classes and TILE_BYTES bytes, dealt by
    hash, a part being one row; only parts, never classes, are then repeated for the parts of
    the other side. So rows grow with the classes, and a bucket of up to TILE of them is one tile.
    """
    own = F.struct(*CLASS, *more)
    size = reduce(lambda x, y: x + y, (F.length(c) for c in more), F.lit(2 * N_MINIMA))
    n_parts = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum(size) / TILE_BYTES)).cast("long")
    parts = rows.groupBy("bucket").pivot("side", [0, 1]).agg(n_parts.alias("parts"), F.count(F.lit(1)).alias("n")).withColumnsRenamed({"0_parts": "n_few", "1_parts": "n_every", "1_n": "n"})
    parts = parts.filter("n_few > 0 AND n_every > 0").select("bucket", "n_few", "n_every", "n")
    dealt = join_by_group(rows, parts, "bucket", "n", rows.count()).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(SEED)), F.when(F.col("side") == 0, F.col("n_few")).otherwise(F.col("n_every"))))
    # The exchange is by part, so no task holds a whole large bucket.
    dealt = dealt.repartition("bucket", "side", "part")
    packed = dealt.groupBy("bucket", "band", "side", "part", "n_few", "n_every").agg(F.collect_list(own).alias("classes"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = packed.filter("side = 0").select("bucket", "band", F.col("part").alias("i"), upto("n_every").alias("j"), F.col("classes").alias("few"))
    every = packed.filter("side = 1").select("bucket", "band", upto("n_few").alias("i"), F.col("part").alias("j"), F.col("classes").alias("every"))
    return few.join(every.hint("merge"), ["bucket", "band", "i", "j"]).select("bucket", "band", "few", "every")


def _sides(members: DataFrame, linker: _Linker) -> DataFrame:
    """Classes of buckets with several components: on side 0 those outside the bucket's largest component, on side 1 all."""
    rows = scratch_table(linker.labelled(members, "cid", "comp"), "labelled")
    parts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("n_comps"), F.sum("n").alias("n")).filter("n_comps > 1")
    sign = linker.classes.select("cid", "minima", "n_shingles")
    met = join_by_group(rows, scratch_table(mixed.select("bucket", F.col("most.comp").alias("main"), "n"), "mixed"), "bucket", "n", rows.count()).join(sign, "cid")
    both = F.when(F.col("comp") != F.col("main"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    return met.select("bucket", "band", F.explode(both).alias("side"), *CLASS)


def _left_over(members: DataFrame, linker: _Linker) -> None:
    """Compare what is left over in each bucket with its other components, and join those that a link connects.

    Minima decide which classes are near another at all; only their sets are fetched, once
    for each bucket, and only links leave the second pass.
    """
    rows = scratch_table(_sides(members, linker), "sides")
    near = _tiles(rows).mapInArrow(_tile_near(linker.percent), NEAR).dropDuplicates(["bucket", "side", "cid"])
    near = scratch_table(near, "tile-near")
    linker.prepare(near)
    if linker.sets:
        sets = reduce(DataFrame.unionByName, linker.sets)
        whole = scratch_table(near.join(sets, "cid"), "tile-sets")
        linker.found(_tiles(whole, "shingles").mapInArrow(_tile_links(linker.percent), "u long, v long"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    width: words of a shingle; percent: the least similarity of a link.
    """
    return near_rows(docs, F.lit(None).cast("string"), width, percent).drop("key")


def near_rows(docs: DataFrame, key: Column, width: int = 5, percent: int = 80) -> DataFrame:
    """The columns of ``near_dedup`` and key, a string column of docs by which rows can be told apart."""
    bounded_batches(docs.sparkSession)
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), key.alias("key"))
    rows = scratch_table(t.mapInArrow(_features(width), "doc_id long, key string, n_shingles long, k1 long, k2 long, minima binary"), "minhash")
    firsts = rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    own = rows.join(firsts, ["k1", "k2", "doc_id"]).dropDuplicates(["k1", "k2", "doc_id"])
    classes = scratch_table(own.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", F.col("doc_id").alias("first_id"), "n_shingles", "minima"), "classes")

    masks = F.array(*(F.lit(int(m)) for m in np.random.default_rng(SEED + 1).integers(0, 2**62, size=BANDS)))
    cut = F.substring("minima", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    banded = classes.select("cid", "minima", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("cid", "band", F.xxhash64("band", cut).alias("bucket"))
    mask = F.element_at(masks, F.col("band") + 1)
    chosen = banded.groupBy("bucket").agg(F.min(F.col("cid").bitwiseXOR(mask)).alias("least"), F.min("band").alias("_band"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    chosen = chosen.select("bucket", F.col("least").bitwiseXOR(F.element_at(masks, F.col("_band") + 1)).alias("rep"))
    members = scratch_table(banded.join(chosen, "bucket").select("bucket", "band", "cid", "rep"), "buckets")

    linker = _Linker(docs, classes, width, percent)
    pair = members.filter("cid != rep").select(F.least("cid", "rep").alias("u"), F.greatest("cid", "rep").alias("v")).distinct()
    stars = scratch_table(pair, "star-pairs")
    alike = scratch_table(linker.similar(stars), "star-alike")
    # First one pair for each class, the most alike; most of the others then lie within a component.
    best = alike.groupBy("v").agg(F.max(F.struct("agree", "u")).alias("b")).select(F.col("b.u").alias("u"), "v")
    linker.check(scratch_table(best, "best-pairs"))
    linker.check(scratch_table(linker.apart(alike.join(best, ["u", "v"], "left_anti")), "other-pairs"))

    _left_over(members.select("bucket", "band", "cid"), linker)

    named = linker.labelled(classes.select("cid", "k1", "k2", "first_id"), "cid", "comp")
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    ids = named.join(least, "comp").select("k1", "k2", "component_id")
    sizes = rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    groups = scratch_table(ids.join(sizes, ["k1", "k2"]), "near-groups")
    return _joined(rows.select("doc_id", "key", "n_shingles", "k1", "k2"), groups, total)


def _joined(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Each row with its class's component: large classes, a bounded number, are broadcast."""
    limit = total * HOT_SHARE
    groups = groups.select("k1", "k2", "component_id", "_n")
    hot = F.broadcast(groups.filter(F.col("_n") > limit).select("k1", "k2", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot")))
    first = rows.join(hot, ["k1", "k2"], "left")
    some = first.filter("_is_hot").withColumn("component_id", F.col("_hot"))
    cold = groups.filter(F.col("_n") <= limit).select("k1", "k2", "component_id")
    rest = first.filter("_is_hot IS NULL").join(cold, ["k1", "k2"], "left")
    every = some.select("doc_id", "key", "n_shingles", "component_id").unionByName(rest.select("doc_id", "key", "n_shingles", "component_id"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return every.select("doc_id", "key", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
