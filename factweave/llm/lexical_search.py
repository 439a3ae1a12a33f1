"""Ranked lexical search over sharded postings: the exact best documents of each item, most blocks unread.

A shard is what one task has read: its documents in the order of doc_id, and for each term the places of the documents that
hold it with the occurrences. Shards carry their own terms and are written once; nothing is shuffled to build them. Terms that
no item has are counted for the documents' lengths and not kept.

Postings of a term in a shard are cut into blocks of varying length. Dynamic programming finds the boundaries that minimise
the error of the bounds, which is the sum over postings of the block's largest score less the posting's own, plus a fixed
price for each block; blocks hold at most LONGEST postings.

An item's search in a shard lays the blocks of all its terms side by side. Between two boundaries no block begins or ends, so
the block maxima that cover a stretch bound every score in it: the pivot test of block-max WAND, made for all stretches at
once. Stretches whose bound can't reach the item's threshold are skipped with the blocks that lie in nothing else; the others
are scored exactly in falling order of bound, a few at a time, each time with the threshold that the best found so far set.
A shard gives at most `top` documents an item, and the item's best come from these.

Thresholds start from the scores in a few shards: what is the top-th best there can't be less over all. This changes no
result, only how much is skipped. Items are searched in blocks whose terms are few enough for one broadcast.

Null texts and texts without terms count for nothing. Rows that share a doc_id, repeated ones too, are documents of their own;
rows without doc_id come last among equals. Rows that share an item_id (or have none) are one item with the terms of all.
Items without terms, or whose terms no document holds, get no rows; nor does an empty table. Further columns play no part.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_rows, slices, small_batches, table, written

TOP = 50
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 500_000
MOST_TERMS = 200_000
LONGEST, PRICE = 128, 4
LISTS = 2048
FIRST_DOCS = 128
PRIMING = 16
PIECE = 1 << 20
LOWER = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms, a piece of the text at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of all texts of an item."""

    def make():
        def run(rows):
            each = [sorted({w.decode("utf-8", "surrogatepass") for ws in terms_of(t) for w in ws}) for t in rows["text"]]
            return {"item_id": rows["item_id"], "terms": each}

        return run

    each = map_rows(items.select("item_id", "text"), make, f"item_id {dict(items.dtypes)['item_id']}, terms array<string>")
    return each.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


SHARD = "shard string, n_docs long, n_terms long, doc_ids array<bigint>, lengths array<bigint>, terms array<string>, ends array<bigint>, places array<int>, counts array<bigint>"


class _Shard:
    """Postings of one shard as they come in."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.docs, self.lengths, self.parts = [], [], []
        self.total = self.postings = 0

    def add(self, doc_id: int | None, n: int, found: dict[bytes, int]) -> None:
        self.total += n
        self.docs.append(doc_id)
        self.lengths.append(n)
        if found:
            known = self.terms
            self.parts.append((len(self.docs) - 1, np.array([known.setdefault(w, len(known)) for w in found], np.int32), np.fromiter(found.values(), np.int64, len(found))))
            self.postings += len(found)

    def row(self) -> pa.RecordBatch:
        """The shard's row: documents by doc_id, postings by term and then by document. Documents that hold no kept term are counted and go."""
        n_docs = len(self.docs)
        owner = np.repeat(np.array([p[0] for p in self.parts], np.int64), [len(p[1]) for p in self.parts])
        term = np.concatenate([p[1] for p in self.parts] or [np.empty(0, np.int32)])
        count = np.concatenate([p[2] for p in self.parts] or [np.empty(0, np.int64)])
        holds = sorted({p[0] for p in self.parts}, key=lambda k: (self.docs[k] is None, self.docs[k] or 0))
        place = np.zeros(n_docs, np.int32)
        place[np.array(holds, np.int64)] = np.arange(len(holds))
        names = sorted(self.terms)
        rank = np.zeros(len(names), np.int32)
        rank[np.array([self.terms[w] for w in names], np.int64)] = np.arange(len(names))
        place, term = place[owner], rank[term]
        order = np.lexsort((place, term))
        ends = np.cumsum(np.bincount(term, minlength=len(names)))
        row = {
            "shard": [uuid.uuid4().hex], "n_docs": [n_docs], "n_terms": [self.total], "doc_ids": [[self.docs[k] for k in holds]], "lengths": [[self.lengths[k] for k in holds]],
            "terms": [[w.decode("utf-8", "surrogatepass") for w in names]], "ends": [ends], "places": [place[order]], "counts": [count[order]],
        }
        return pa.RecordBatch.from_pydict(row, schema=_SHARD)


_LONGS = pa.list_(pa.int64())
_SHARD = pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", _LONGS), ("lengths", _LONGS), ("terms", pa.list_(pa.string())), ("ends", _LONGS), ("places", pa.list_(pa.int32())), ("counts", _LONGS)])


def shards(docs: DataFrame, terms: set[str], postings: int = SHARD_POSTINGS) -> DataFrame:
    """A row for each shard: its documents and the postings of those terms. A task's documents go to one shard, or to several of bounded size."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(t.encode("utf-8", "surrogatepass") for t in terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shard = shared.value, _Shard()
        for piece in slices(batches):
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                n, found = 0, Counter()
                for words in terms_of(text):
                    n += len(words)
                    found.update(words)
                if n:
                    shard.add(doc_id, n, {w: c for w, c in found.items() if w in wanted})
                if shard.postings >= postings or len(shard.docs) >= SHARD_DOCS:
                    yield shard.row()
                    shard = _Shard()
        if shard.docs:
            yield shard.row()

    return docs.select("doc_id", "text").mapInArrow(run, SHARD)


def block_ends(scores: np.ndarray, ends: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """Ends of the blocks of all lists: for each list, whose postings' scores stand one after the other, the cut of least cost.

    A block costs the sum over its postings of its largest score less theirs, and `price` times the list's largest score.
    """
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    some = np.flatnonzero(ends > starts)
    some = some[np.argsort(starts[some] - ends[some], kind="stable")]
    length = np.zeros(len(scores), np.int64)
    for k in range(0, len(some), LISTS):
        part = some[k : k + LISTS]
        cut_lists(scores, starts[part], (ends - starts)[part], longest, price, length)
    found, at, low = [np.empty(0, np.int64)], ends[some].astype(np.int64), starts[some]
    while len(at):
        found.append(at)
        at = at - length[at - 1]
        at, low = at[at > low], low[at > low]
    return np.sort(np.concatenate(found))


def cut_lists(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int, price: float, length: np.ndarray) -> None:
    """Sets length[i] to that of the last block of the best cut that ends with posting i, for lists in falling order of size.

    cost[i] = price + min over j of cost[j] + largest(j..i) * (i - j), one posting of each list a step. The last `longest`
    values of j lie in rings of slots, each with the largest score since j.
    """
    ring = min(longest, int(sizes[0]))
    cost, largest = np.full((len(sizes), ring), np.inf), np.zeros((len(sizes), ring))
    fee, last, slot = price * np.array([scores[s : s + n].max() for s, n in zip(starts, sizes)], float), np.zeros(len(sizes)), np.arange(ring)
    for i in range(int(sizes[0])):
        alive = int(np.searchsorted(-sizes, -i))
        cost, largest, last = cost[:alive], largest[:alive], last[:alive]
        now = i % ring
        cost[:, now], largest[:, now] = last, 0
        np.maximum(largest, scores[starts[:alive] + i][:, None], out=largest)
        spans = (now - slot) % ring + 1
        total = cost + largest * spans
        best = total.argmin(axis=1)
        last = total[np.arange(alive), best] + fee[:alive]
        length[starts[:alive] + i] = spans[best]


class Searcher:
    """A shard with its scores, blocks and their maxima."""

    def __init__(self, row: dict, weights: dict[str, int], n_docs: int, n_terms: int):
        self.docs = row["doc_ids"]
        self.places, self.ends, self.terms = row["places"], row["ends"], {t: k for k, t in enumerate(row["terms"])}
        lengths = row["lengths"]
        exact = lengths if not len(lengths) or int(lengths.max()) * 50 * n_docs < 1 << 63 else lengths.astype(object)
        m = (50 + (50 * exact * n_docs) // n_terms).astype(np.int64)
        counts = row["counts"]
        w = np.repeat(np.array([weights.get(t, 0) for t in row["terms"]], np.int64), np.diff(self.ends, prepend=0))
        self.scores = w * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[self.places]))
        self.block_end = block_ends(self.scores, self.ends)
        self.block_start = np.concatenate([[0], self.block_end])[:-1].astype(np.int64)
        self.largest = np.maximum.reduceat(self.scores, self.block_start) if len(self.scores) else self.scores
        self.first, self.last = self.places[self.block_start].astype(np.int64), self.places[self.block_end - 1].astype(np.int64)
        self.blocks_to = np.searchsorted(self.block_end, self.ends, side="right")

    def best(self, terms: list[str], top: int = TOP, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the `top` best documents with a score of `least` or more, best first, the lower place of equals first."""
        known = [k for t in terms if (k := self.terms.get(t)) is not None]
        none = np.empty(0, np.int64)
        if not known:
            return none, none
        blocks = np.concatenate([np.arange(self.blocks_to[k - 1] if k else 0, self.blocks_to[k]) for k in known])
        first, last, largest = self.first[blocks], self.last[blocks], self.largest[blocks]
        edge, at = np.unique(np.concatenate([first, last + 1]), return_inverse=True)
        change = np.zeros(len(edge), np.int64)
        np.add.at(change, at, np.concatenate([largest, -largest]))
        bound, size = np.cumsum(change)[:-1], np.diff(edge)
        order = np.argsort(-bound, kind="stable")
        done, step = 0, FIRST_DOCS
        kept, kept_scores = none, none
        reach = np.cumsum(size[order])
        while done < len(order):
            fit = int(np.searchsorted(-bound[order], -max(least, 1), side="right"))
            to = min(fit, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + step)) + 1)
            if to <= done:
                break
            places, scores = self.scored(blocks, first, last, edge, order[done:to])
            places, scores = np.concatenate([kept, places]), np.concatenate([kept_scores, scores])
            pick = np.lexsort((places, -scores))[:top]
            kept, kept_scores = places[pick], scores[pick]
            if len(kept) == top:
                least = max(least, int(kept_scores[-1]))
            done, step = to, step * 2
        take = kept_scores >= max(least, 1)
        return kept[take], kept_scores[take]

    def scored(self, blocks: np.ndarray, first: np.ndarray, last: np.ndarray, edge: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the documents in those stretches; only blocks that reach into one are read."""
        live = np.zeros(int(edge[-1]) - int(edge[0]) + 1, np.int64)
        np.add.at(live, edge[stretches] - edge[0], 1)
        np.add.at(live, edge[stretches + 1] - edge[0], -1)
        live = np.cumsum(live)[:-1]
        before = np.concatenate([[0], np.cumsum(live)])
        read = blocks[before[last + 1 - edge[0]] > before[first - edge[0]]]
        size = self.block_end[read] - self.block_start[read]
        at = np.repeat(self.block_start[read] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = self.places[at] - edge[0]
        inside = live[place] > 0
        place = place[inside]
        total = np.zeros(len(live), np.int64)
        np.add.at(total, place, self.scores[at[inside]])
        found = np.flatnonzero(total)
        return found + edge[0], total[found]


def arrays(batch: pa.RecordBatch, k: int) -> dict:
    """Row k of a batch of shards, its numbers as numpy arrays."""
    out = {}
    for name in ("lengths", "ends", "places", "counts"):
        out[name] = batch.column(name)[k].values.to_numpy(zero_copy_only=False)
    return out | {"doc_ids": batch.column("doc_ids")[k].values, "terms": batch.column("terms")[k].as_py()}


def searched(index: DataFrame, items: list[tuple[object, list[str]]], weights: dict[str, int], n_docs: int, n_terms: int, top: int, least: dict[object, int], kind: str) -> DataFrame:
    """(item_id, doc_id, score): each shard's best documents of each item with a score of least[item_id] or more."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights, least))
    schema = T._parse_datatype_string(f"item_id {kind}, doc_id long, score long")
    item_type = to_arrow_schema(schema)[0].type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, least = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = Searcher(arrays(batch, k), weights, n_docs, n_terms)
                for item, terms in items:
                    places, scores = one.best(terms, top, least.get(item, 1))
                    if len(places):
                        ids = pa.array([item] * len(places), item_type)
                        yield pa.RecordBatch.from_arrays([ids, one.docs.take(pa.array(places)), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return index.select("doc_ids", "lengths", "terms", "ends", "places", "counts").mapInArrow(run, schema)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best of each item."""
    by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item, ranks from 1, equal scores by doc_id."""
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    asked = written(item_terms(items), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-total // most_terms))
    out = []
    for part in range(parts):
        block = [(r[0], r[1]) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()]
        terms = {t for _, ts in block for t in ts}
        index = written(shards(docs, terms), "shards")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs or not terms:
            continue
        sizes = F.transform("ends", lambda e, i: F.struct(F.element_at("terms", (i + 1).cast("int")).alias("term"), (e - F.when(i > 0, F.element_at("ends", F.greatest(i, F.lit(1)).cast("int"))).otherwise(0)).alias("n")))
        df = dict(index.select(F.inline(sizes)).groupBy("term").agg(F.sum("n")).collect())
        weights = {t: weight(n_docs, n) for t, n in df.items()}
        ways = max(1, index.count() // PRIMING)
        some = ranked(searched(index.where(F.pmod(F.xxhash64("shard"), F.lit(ways)) == 0), block, weights, n_docs, n_terms, top, {}, kind), top)
        least = dict(some.where(F.col("rank") == top).select("item_id", "score").collect())
        out.append(ranked(searched(index, block, weights, n_docs, n_terms, top, least, kind), top))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def op13(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL13 = r"""WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT a.item_id, t.doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * w.docs + 2 AS DOUBLE) / (2 * d.df + 1))) AS BIGINT) * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * l.n * w.docs) // w.total)))) AS BIGINT) AS score
    FROM asked a JOIN tf t ON a.term = t.term JOIN df d ON d.term = t.term JOIN lengths l ON l.doc_id = t.doc_id CROSS JOIN whole w GROUP BY a.item_id, t.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) x WHERE rank <= 50"""
