"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, in integers throughout.

A component x counts as floor(4096 * x), vectors are cut into equal consecutive parts, and each part has a codebook of its
own. Codebooks start as the parts of the first kept vectors and take `rounds` rounds of assignment and averaging; the driver
holds the codebooks and sees one sum for each part, entry and dimension, whatever the number of vectors.

The nearest entry is found by partial distances: dimensions go in descending variance over the codebook's entries, and an
entry is dropped for a vector as soon as its integer distance so far strictly exceeds the vector's best complete distance.
Entries with equal distance thus stay to the end, where the lower index wins.

Rows whose vector is null, or holds null or non-finite components, are left out, and so are rows whose length isn't that of
the vector with the least vec_id among those whose length is a multiple of the number of parts (empty ones never are).
Components beyond -32768 and 32768 count as these, so that all distances fit 64 bits; label sums that don't are null. Rows
that share a vec_id, repeated ones too, count one by one, the lesser vector first; rows without vec_id come last as seeds.
With fewer vectors than entries the codebooks are as short. Empty tables give no rows; further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, small_batches, table, written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE, LARGEST = 4096, 1 << 27
FEW_LABELS = 100_000


class Codebooks:
    """entries[part, entry, position], and for each part its dimensions in descending variance over the entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = entries.shape[1]
        exact = entries.astype(object)
        spread = n * (exact**2).sum(axis=1) - exact.sum(axis=1) ** 2 if n else exact.sum(axis=1)
        self.order = np.array([sorted(range(entries.shape[2]), key=lambda j: (-row[j], j)) for row in spread], int).reshape(len(entries), -1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part of each row of x."""
        parts, n, width = self.entries.shape
        code, error = np.zeros((len(x), parts), np.uint8 if n <= 256 else np.int64), np.zeros((len(x), parts), np.int64)
        for p in range(parts):
            at = self.order[p]
            code[:, p], error[:, p] = partial_distances(np.ascontiguousarray(x[:, p * width + at].T), self.entries[p][:, at])
        return code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def partial_distances(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of book for each column of x, the lower one of equals, with its squared distance; dimensions come in x's order.

    The first complete distance is that of the entry nearest in the first dimension. Masks then keep, entry by entry and
    dimension by dimension, the columns whose distance so far doesn't exceed their best.
    """
    first = np.abs(x[0][:, None] - book[:, 0]).argmin(axis=1)
    code, best = first.copy(), ((x - book[first].T) ** 2).sum(axis=0)
    for e, entry in enumerate(book):
        open_ = np.flatnonzero(first != e)
        so_far = (x[0, open_] - entry[0]) ** 2
        for values, middle in zip(x[1:], entry[1:]):
            live = so_far <= best[open_]
            open_, so_far = open_[live], so_far[live]
            so_far += (values[open_] - middle) ** 2
        won = (so_far < best[open_]) | (so_far == best[open_]) & (e < code[open_])
        code[open_[won]], best[open_[won]] = e, so_far[won]
    return code, best


def kept(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """The rows that take part."""
    e = F.col("embedding")
    sound = vectors.where(F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.size(e) > 0) & (F.size(e) % parts == 0))
    first = sound.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size(e)).first()
    return sound.where(F.size(e) == first[0]) if first else sound.where(F.lit(False))


def integers(column: pa.Array) -> np.ndarray:
    """floor(4096 * x) of a column of lists of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), -1)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from all of the rows that kept() gives."""
    spark = rows.sparkSession
    small_batches(spark)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow().column(0).combine_chunks()
    if not len(seeds):
        return Codebooks(np.zeros((parts, 0, 1), np.int64))
    start = integers(seeds)
    books = Codebooks(start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy())
    _, n, width = books.entries.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            count, total = np.zeros(parts * n, np.int64), np.zeros((parts * n, width), np.int64)
            for batch in batches:
                x = integers(batch.column(0))
                at = (books.nearest(x)[0] + np.arange(parts) * n).ravel()
                count += np.bincount(at, minlength=len(count))
                np.add.at(total, at, x.reshape(-1, width))
            cell = np.repeat(count > 0, width).nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count[cell // width]), pa.array(total.ravel()[cell])], names=["cell", "n", "total"])

        sums = rows.select("embedding").mapInArrow(run, "cell long, n long, total long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        fresh = books.entries.copy()
        for cell, count, total in sums.collect():
            fresh.ravel()[cell] = int(total) // count
        books = Codebooks(fresh)
        shared.unpersist()
    return books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part; more with over 256 entries) and error of each row that kept() gives."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(books.entries.shape[1] - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = shared.value.nearest(integers(batch.column(2)))
            hexed = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hexed, pa.string()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    types = dict(rows.dtypes)
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def with_label_error(codes: DataFrame) -> DataFrame:
    """The rows of encoded() with label_error, the error summed over equal labels, nulls together.

    Sums of few labels are broadcast; of many, only those of labels that hold a large share of the rows.
    """
    keys = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label"), F.col("label").isNull().alias("_none")]
    codes = written(codes.select("*", *keys), "codes")
    sums = written(codes.groupBy("_label", "_none").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-sums")
    few = sums.count() <= FEW_LABELS
    joined = codes.join(F.broadcast(sums.drop("n")), ["_label", "_none"]) if few else join_counted(codes, sums, ["_label", "_none"])
    return joined.drop("_label", "_none")


def op12(spark, sf_dir) -> DataFrame:
    rows = kept(table(spark, sf_dir, "embeddings"))
    books = fit(rows)
    out = with_label_error(encoded(rows, books))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same in SQL: one pair of tables a round, all distances of all entries."""

    def nearest(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (SELECT vec_id, part, CAST(min(dist * 64 + entry) % 64 AS BIGINT) AS entry, CAST(min(dist * 64 + entry) // 64 AS BIGINT) AS dist FROM (
    SELECT p.vec_id, p.part, b.entry, CAST(sum((p.v - b.v) * (p.v - b.v)) AS HUGEINT) AS dist FROM points p JOIN book{k} b ON p.part = b.part AND p.pos = b.pos GROUP BY ALL) d GROUP BY vec_id, part)"""

    def averaged(k: int) -> str:
        return f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT part, entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (
        SELECT p.part, a.entry, p.pos, sum(p.v) AS s, count(*) AS n FROM points p JOIN near{k} a ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY ALL) t) m
    ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""

    steps = [x for k in range(rounds) for x in (nearest(k), averaged(k))] + [nearest(rounds)]
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS width FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
    FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept) x),
book0 AS MATERIALIZED (SELECT p.part, s.entry, p.pos, p.v FROM points p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) s ON p.vec_id = s.vec_id WHERE s.entry < {ENTRIES}),
{", ".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM kept k JOIN codes c ON k.vec_id = c.vec_id"""


SQL12 = _sql()
