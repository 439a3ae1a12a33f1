"""Shared helpers of the text operators: Arrow maps, word hashing, shared folders, fixed-size bitmaps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_CHARS = 4_000_000
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
OWN_DIR = "spark.factweave.sharedDir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session may go without; it gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="factweave-")
        spark.conf.set(OWN_DIR, at)
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that this process has written to the shared folder after the first `since`, but for the last `keep`, once no result that reads them is needed."""
    jvm = spark.sparkContext._jvm
    gone = _written[since : len(_written) - keep]
    _written[since : len(_written) - keep] = []
    for at in gone:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remember(spark: SparkSession, path: str, gone: bool = False) -> None:
    """Counts a folder in the shared folder among the tables that drop_written() deletes, or deletes it now."""
    _written.append(path)
    if gone:
        drop_written(spark, len(_written) - 1)


def tables_written() -> int:
    return len(_written)


HOT_SHARE = 1000


def join_counted(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a written table `one` of unique keys and n, how many of the rows have them.

    Keys with more than 1 / HOT_SHARE of the rows, of which there are fewer than HOT_SHARE, are joined by broadcast; the
    others are shuffled, where none is large.
    """
    total = one.agg(F.sum("n")).first()[0] or 0
    hot = one.where(F.col("n") > total // HOT_SHARE + HOT_SHARE)
    one = one.drop("n")
    if hot.isEmpty():
        return rows.join(one, keys)
    few = F.broadcast(hot.drop("n"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one, keys))


def slices(batches: Iterable[pa.RecordBatch], text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with a bounded number of bytes of text (or a single row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size.astype(np.int64)) // SLICE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            for c in range(a, b, 512):
                yield batch.slice(c, min(512, b - c))


def small_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches of the session to BATCH_BYTES, so that workers need little memory whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Maps slices of rows; make() runs once a task and gives the function from columns to columns. Column 1 is the text."""
    small_batches(df.sparkSession)
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for piece in slices(batches):
            got = f({name: piece.column(i).to_pylist() for i, name in enumerate(piece.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in arrow], schema=arrow)
        # Workers live on between tasks; what they have freed goes back to the machine.
        del f
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; lower: A-Z become a-z, nothing else changes."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


class WordHashes(dict):
    """64-bit hashes of words that agree on all machines; what is kept is bounded."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_sums(h: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """What window_hashes() mixes: the sum of each window's hashes, each times the constant of its place."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, c in enumerate(odd_constants(width, seed)):
        total += h[j : j + n] * c
    return total


def window_hashes(h: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """A hash of each window of so many words, from hashes of the words; none if there are fewer words."""
    return mix(window_sums(h, width, seed))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fold(column: str, parts: int) -> Column:
    """crc32 of the column as text, modulo parts; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """About `most` rows at most of each value of group (few values), picked by a hash of the key, the same at each run; weight says how many rows each stands for."""
    count = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    if not count:
        return df.withColumn("weight", F.lit(1.0))
    share = F.create_map(*[F.lit(x) for g, n in count.items() for x in (g, min(1.0, most / n))])[F.col(group)]
    return df.withColumn("weight", share).where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) < F.col("weight") * (1 << 30)).withColumn("weight", 1 / F.col("weight"))


def labelled_sample(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int) -> DataFrame:
    """(doc_id, text, quality, weight) of about per_class rows at most of each class, the bounded sample that models are fitted on.

    Repeated labels count once; a doc_id with both labels counts for neither.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & keep)
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    return docs.select("doc_id", "text").join(F.broadcast(bounded_sample(chosen, "doc_id", "quality", per_class)), "doc_id")


BITMAP_BITS = 1 << 24


def bitmap_of(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed size (2 MB) of the hashes, for filters with false positives only.

    Only its words come to the driver: their number has the bound bits / 32 at any size of the input.
    """
    at = f"pmod(`{column}`, {bits}L)"
    rows = hashes.selectExpr(f"shiftright({at}, 5) AS w", f"shiftleft(1L, cast({at} % 32 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 32, np.uint32)
    got = rows.toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint32)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(len(bitmap) * 32 - 1)
    return (bitmap[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


MOST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those gone; rows without key stay. The keys are broadcast only if they are few."""
    gone = written(gone.select(key).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_IDS else gone, key, "left_anti").select(*docs.columns)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, whose text gets a true from make()'s function; nothing is shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for piece in slices(batches, at):
            yield piece.filter(pa.array(np.asarray(f(piece.column(at).to_pylist()), bool)))

    return docs.mapInArrow(run, docs.schema)
