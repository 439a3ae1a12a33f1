"""MinHash near-duplicate classes with sequential Bayesian verification.

1. Every document becomes its set of word shingles. Documents with equal sets form one class at once (a plain
   aggregate), and only the smallest doc_id of each class goes on.
2. Each set has ROWS * BANDS minimum hashes. Documents that agree on a whole band are candidates.
3. First each document is compared with the smallest doc_id of each of its buckets, which costs at most BANDS pairs a
   document. Links found join components.
4. In buckets that still hold more than one component, members outside the bucket's largest component are compared with
   all others, in tiles of BLOCK by BLOCK members, so that no task gets a whole bucket. Members of the largest component
   never meet each other, so a few strays in a bucket of many copies cost no more than one copy of each member. In a tile,
   pairs of one component are left out, and a pair counts only in the first band it shares. A tile gives a spanning
   forest of the links it found, never all of them.
5. A candidate pair is verified in sequence: the signatures are compared BATCH values at a time, and the pair is pruned
   as soon as the posterior probability of reaching the threshold, from a uniform prior, is below MISS. Pairs that
   survive are compared exactly, on their full sets.

A pair at the threshold of 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, about 4e-7.

Null or empty texts have no shingles and link with nothing. Rows that share a doc_id are one node of the graph; their
links are joined. A row without doc_id is kept, gets no component and links with nothing.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WordHashes, free_name, join_counted, map_rows, mix, odd_constants, signed, slices, window_hashes, without, words_of, written

ROWS, BANDS, BATCH, BLOCK, MISS = 4, 28, 16, 512, 1e-6
SALTS = 32
BROADCAST_IDS = 1_000_000
SEEDS = odd_constants(ROWS * BANDS, 99)
BAND_SEEDS = odd_constants(BANDS, 98)


def shingles(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than width make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(window_hashes(h, min(width, len(words))))


def signature(values: np.ndarray) -> np.ndarray:
    """ROWS * BANDS minimum hashes of 32 bits; the set must not be empty."""
    low = np.full(len(SEEDS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(values), 256):  # products of a block stay in the cache
        np.minimum(low, (values[a : a + 256, None] * SEEDS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = BAND_SEEDS.copy()
    for j in range(ROWS):
        key = mix(key + rows[:, j] * np.uint64(0x9E3779B97F4A7C15))
    return key


def _beta_tail(matches: int, tries: int, at: float) -> float:
    """P(similarity >= at) after so many matches, from a uniform prior: a binomial sum."""
    n = tries + 1
    return sum(comb(n, k) * at**k * (1 - at) ** (n - k) for k in range(matches + 1))


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch end, the fewest matches with which a pair stays."""
    out = []
    for tries in range(BATCH, ROWS * BANDS + 1, BATCH):
        out.append(next(m for m in range(tries + 1) if _beta_tail(m, tries, threshold) >= miss))
    return out


def passes(a: np.ndarray, b: np.ndarray, least: list[int]) -> bool:
    same = 0
    for k, need in enumerate(least):
        same += int(np.count_nonzero(a[k * BATCH : (k + 1) * BATCH] == b[k * BATCH : (k + 1) * BATCH]))
        if same < need:
            return False
    return True


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, band keys (null if the set is empty)."""

    def make():
        hashes = WordHashes()

        def run(rows):
            out = {"doc_id": rows["doc_id"], "n_shingles": [], "f1": [], "f2": [], "bands": []}
            for text in rows["text"]:
                s = shingles(words_of(text, lower=True), hashes, width)
                out["n_shingles"].append(len(s))
                with np.errstate(over="ignore"):
                    out["f1"].append(int(signed(np.array([mix(s).sum(dtype=np.uint64)]))[0]))
                    out["f2"].append(int(signed(np.array([mix(s ^ SEEDS[0]).sum(dtype=np.uint64)]))[0]))
                out["bands"].append(signed(band_keys(signature(s))) if len(s) else None)
            return out

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def payloads(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, sig, items (the set) of the documents with these ids, as binary."""
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = docs.select("doc_id", "text").join(near, "doc_id", "left_semi")

    def make():
        hashes = WordHashes()

        def run(rows):
            sets = [shingles(words_of(t, lower=True), hashes, width) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "sig": [signature(s).tobytes() if len(s) else b"" for s in sets], "items": [s.tobytes() for s in sets]}

        return run

    return map_rows(chosen, make, "doc_id long, sig binary, items binary").where("length(items) > 0")


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _link_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=to_arrow_schema(LINKS))


def hub_links(pairs: DataFrame, load: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (hub, doc_id). Rows of a hub are dealt over SALTS streams that each start with the hub's own row."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    hubs = salted.select("hub", "salt").distinct().join(load.withColumnRenamed("doc_id", "hub"), "hub").select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("doc_id"), "sig", "items")
    members = salted.join(load, "doc_id").select("hub", "salt", F.lit(1).alias("role"), "doc_id", "sig", "items")
    least = least_matches(percent / 100)

    def run(batches):
        hub, at = [], None
        for batch in batches:
            for piece in slices([batch], 5):
                a, b = [], []
                for h, s, role, doc, sig, items in zip(*(c.to_pylist() for c in piece.columns)):
                    if (h, s) != at:
                        hub, at = [], (h, s)
                    mine = (np.frombuffer(sig, np.uint32), np.frombuffer(items, np.uint64))
                    if role == 0:
                        hub.append(mine)
                    elif any(passes(x, mine[0], least) and linked(y, mine[1], percent) for x, y in hub):
                        a.append(h)
                        b.append(doc)
                yield _link_batch(a, b)

    both = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return both.mapInArrow(run, LINKS)


def tiles(members: DataFrame) -> DataFrame:
    """key, i, j, own, doc_id, comp: the tiles (i <= j) of each member; members has key, doc_id, comp.

    The blocks of a bucket are those of all but its largest component, then, from `few` on, those of the largest. Tiles
    pair a block of the former with any block. A bucket of one block is one tile.
    """
    of = members.groupBy("key", "comp").agg(F.count("doc_id").alias("n"))
    top = of.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    rest = F.when(F.col("all") > BLOCK, F.ceil(F.col("top.n") / BLOCK)).otherwise(0).cast("int")
    top = top.select("key", F.col("top.comp").alias("major"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("few"), rest.alias("rest"))
    stray = (F.col("rest") == 0) | (F.col("comp") != F.col("major"))
    place = F.xxhash64("doc_id")
    own = F.when(stray, F.pmod(place, F.col("few").cast("long"))).otherwise(F.col("few") + F.pmod(place, F.col("rest").cast("long"))).cast("int")
    last = F.when(stray, F.col("few") + F.col("rest") - 1).otherwise(F.col("few") - 1)
    dealt = members.join(top, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "comp")


def tile_links(members: DataFrame, load: DataFrame, percent: int) -> DataFrame:
    """Links between different components within buckets; members has key, doc_id and comp."""
    dealt = tiles(members).join(load, "doc_id").select("key", "i", "j", "own", "doc_id", "comp", "sig", "items")
    least = least_matches(percent / 100)
    schema = to_arrow_schema(LINKS)

    def tile(group: pa.Table) -> pa.Table:
        own, doc, comp = (group.column(c).to_numpy() for c in ("own", "doc_id", "comp"))
        i, j, key = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("key")[0].as_py()
        sigs = np.stack([np.frombuffer(x, np.uint32) for x in group.column("sig").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        bands = np.stack([signed(band_keys(s)) for s in sigs])
        band = int(np.argmax((bands == key).all(axis=0)))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        a, b = [], []
        for x in left.tolist():
            ys = right[(right > x)] if i == j else right
            ys = ys[comp[ys] != comp[x]]
            if band and len(ys):
                ys = ys[~(bands[ys, :band] == bands[x, :band]).any(axis=1)]
            same = np.zeros(len(ys), np.int64)
            for k, need in enumerate(least):
                if not len(ys):
                    break
                same = same + np.count_nonzero(sigs[ys, k * BATCH : (k + 1) * BATCH] == sigs[x, k * BATCH : (k + 1) * BATCH], axis=1)
                ys, same = ys[same >= need], same[same >= need]
            for y in ys[np.argsort(-same, kind="stable")].tolist():
                if (p := find(int(comp[x]))) != (q := find(int(comp[y]))) and linked(sets[x], sets[y], percent):
                    root[p] = q
                    a.append(int(doc[x]))
                    b.append(int(doc[y]))
        return pa.Table.from_batches([_link_batch(a, b)], schema=schema)

    return dealt.groupBy("key", "i", "j").applyInArrow(tile, LINKS)


def components(links: DataFrame) -> DataFrame:
    """doc_id, comp (the smallest id reachable) of all ids in links (a, b).

    Rounds of large-star and small-star moves; each is written to the shared folder, and the work ends when a round
    gives the links of the one before, which an anti join tells. Stars get short fast, so the rounds grow with the logarithm of the longest chain.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n = edges.count()
    while n:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, most, edges = edges, n, written(small, "links")
        n = edges.count()
        if n == most and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "doc_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; component_id is the smallest doc_id reachable by links."""
    told = written(described(docs, width), "sets")
    filled = told.where("doc_id is not null and n_shingles > 0")
    least = F.min(F.struct("doc_id", "bands"))
    classes = written(filled.groupBy("f1", "f2").agg(least.alias("r"), F.count("doc_id").alias("n")).select("f1", "f2", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands"), "n"), "classes")
    keys = classes.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most"), F.count("key").alias("n")).where("hub < most")
    members = written(join_counted(keys, written(buckets.select("key", "hub", "n"), "hubs"), ["key"]).select("key", "doc_id", "hub"), "buckets")
    load = written(payloads(docs, members.select("doc_id").distinct(), width), "payloads")
    first = written(hub_links(members.where("doc_id <> hub").select("hub", "doc_id").distinct(), load, percent), "links")
    comp = components(first)
    labelled = members.select("key", "doc_id").join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    second = tile_links(labelled.join(mixed, "key"), load, percent)
    # Rows of one id with several sets belong together. Copies need no links: they take the component of their class.
    several = filled.groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo < hi").select("doc_id")
    same_id = filled.join(several, "doc_id", "left_semi").join(classes, ["f1", "f2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    whole = components(first.unionByName(written(second, "links")).unionByName(same_id)).withColumnRenamed("doc_id", "rep")
    homes = written(classes.select("f1", "f2", "rep", "n").join(whole, "rep", "left").select("f1", "f2", F.coalesce("comp", "rep").alias("component_id"), "n"), "homes")
    own = join_counted(filled.select("doc_id", "n_shingles", "f1", "f2"), homes, ["f1", "f2"]).select("doc_id", "n_shingles", "component_id")
    bare = told.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(bare).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for near duplicates: of each class the row with the least doc_id stays (null last, then the first in the table).

    Rows count by themselves, so that repeated rows, rows that share a doc_id and rows without one are compared like any others.
    """
    row = free_name(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width, percent)
    later = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(row), "component_id"), "later")
    members = later.unionByName(later.select(F.col("component_id").alias(row), "component_id").distinct()).join(rows.select(row, "doc_id"), row)
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), F.col("doc_id"), F.col(row).alias("at"))).alias("m")).select("component_id", "m.at")
    return without(rows, members.join(stays, "component_id").where(F.col(row) != F.col("at")), row).select(*docs.columns)


def op10(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)
