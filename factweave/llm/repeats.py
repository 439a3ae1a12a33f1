"""Exact removal of long repeated byte strings by prefix-free parsing.

A rolling hash of TRIGGER bytes is taken at each position. A position is a trigger if its hash is the (leftmost)
minimum among all positions of some string of LENGTH bytes, so each such string holds a trigger and no phrase between
triggers is longer than the string. Every string of LENGTH bytes belongs to its own minimum; equal strings hold it at
equal offsets, so they can only meet at triggers with equal bytes.

* Dictionary: the distinct phrases, each the trigger's bytes with all the context that strings of this trigger can
  touch, and each with its first place in corpus order (doc_id, position).
* Parse: the triggers of all documents in corpus order. An occurrence that is not the first of its phrase is covered
  whole: each of its strings starts earlier, at the phrase's first place.
* Suffix array of the dictionary: the suffixes of phrases whose trigger stands in several phrases, sorted by their bytes.
  A phrase reaches LENGTH bytes past each string that starts in it, so that neighbours in this order that agree on
  LENGTH bytes are one class, and what follows in the parse decides nothing but corpus order.
* Combined: a class stands at all places of its phrases in the parse; all but the first in corpus order are covered.

Suffixes are sorted where equal ones meet. Phrases of a trigger with up to FEW of them go to one task, whose share of the
suffix array is sorted there; suffixes of triggers with more phrases are dealt and grouped by Spark, so that no task gets
all phrases of a common trigger; of these, only strings whose hash occurs twice are shuffled whole. Strings are compared by
their bytes; phrases by 128 bits of hashes of trigger and context.

Documents are read three times and never shuffled for the search: what is shuffled is the triggers' hashes, then the
places whose trigger repeats (found through a bitmap of fixed size that lets no repeat pass unseen), then the phrases
or suffixes that may agree in part. Keys with more than a thousandth of the rows are joined by broadcast, the others by
shuffle.

Null and empty texts have no bytes. A row without doc_id has no place in the order; it is kept whole. Rows that share a
doc_id and a text are the same place, so neither comes earlier; both keep what only they hold. Rows that share a doc_id and
differ in text are documents of which neither comes earlier: what they hold is covered by smaller doc_ids and by their own
earlier starts, and covers greater doc_ids. All strings of such rows are compared one by one with each other and with those
strings of the other rows that a bitmap of fixed size lets pass, by 128 bits of hashes; that shuffles 40 bytes for each byte
of such rows and nothing where there are none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, join_counted, map_rows, mix, signed, small_batches, written

LENGTH, TRIGGER = 100, 40
CHUNK = 1 << 18
FEW, SORTED = 4000, 4096
BITS = 1 << 26
DOC_BITS = 1 << 24
_TABLES = [np.random.default_rng(s).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (3, 4)]
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


class Rolling:
    """Hashes of any substrings of one text from prefix sums of byte values times powers, modulo 2 ** 64."""

    _power: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def powers(cls, n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls._power) < 2:
            cls._power.append((np.ones(1, np.uint64), np.ones(1, np.uint64)))
        if len(cls._power[which][0]) < n:
            base = _BASE[which]
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                x = np.full(max(n, 1 << 16), b, np.uint64)
                x[0] = 1
                both.append(np.cumprod(x))
            cls._power[which] = (both[0], both[1])
        return cls._power[which]

    def __init__(self, data: np.ndarray, which: int):
        p, self.inv = self.powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * p[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inv[begin] + (end - begin).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Spread hashes of all windows."""
        n = len(self.sums) - width
        h = (self.sums[width:] - self.sums[:n]) * self.inv[:n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(31))


class Parts:
    """Texts, or parts of long ones, side by side in one array. Parts of a text overlap so that the starts of its strings tile it."""

    def __init__(self) -> None:
        self.bytes: list[np.ndarray] = []
        self.row: list[int] = []
        self.offset: list[int] = []
        self.size = 0

    def add(self, row: int, offset: int, part: np.ndarray) -> None:
        self.bytes.append(part)
        self.row.append(row)
        self.offset.append(offset)
        self.size += len(part)

    def scan(self, length: int, trigger: int, wide: bool) -> dict[str, np.ndarray]:
        """row, at, k, first, last of all triggers (at, first and last within the text) and, with wide, the phrase hash v and where its context lies in data."""
        data = np.concatenate(self.bytes)
        size = np.array([len(b) for b in self.bytes])
        end = np.cumsum(size)
        begin = end - size
        h = Rolling(data, 0).windows(trigger)
        span = length - trigger + 1
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        step, n = 1, len(low)
        while step < span:  # minima of growing powers of two, then of the span
            move = min(step, span - step)
            low = np.minimum(low[: n - move], low[move:])
            n -= move
            step += move
        # Strings that reach into the next part don't count.
        count = np.maximum(size - length + 1, 0)
        part = np.repeat(np.arange(len(size)), count)
        start = np.arange(count.sum()) + np.repeat(begin - np.append(0, np.cumsum(count)[:-1]), count)
        at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (part[1:] != part[:-1]))) if len(at) else np.empty(0, np.int64)
        first, last = start[head], start[np.append(head[1:], len(at)) - 1] if len(at) else start[head]
        part, at = part[head], at[head]
        move = np.array(self.offset, np.int64)[part] - begin[part]
        out = {"row": np.array(self.row, np.int64)[part], "k": h[at], "at": at + move, "first": first + move, "last": last + move}
        if wide:
            reach = length - trigger
            a, b = np.maximum(at - reach, begin[part]), np.minimum(at + length, end[part])
            shape = ((at - a) * 4096 + (b - at)).astype(np.uint64) * np.uint64(1 << 24) + ((at - first) * 4096 + (last - first)).astype(np.uint64)
            out |= {"v": Rolling(data, 1).of(a, b) + mix(shape), "a": a, "b": b, "left": at - a, "data": data, "move": move}
        return out


def scans(texts: list, length: int, trigger: int, wide: bool = True):
    """Scans of bounded size that together hold all the texts."""
    parts = Parts()
    for row, text in enumerate(texts):
        data = _bytes(text)
        for a in range(0, max(len(data) - length + 1, 0), CHUNK):
            parts.add(row, a, data[a : a + CHUNK + length - 1])
            if parts.size >= CHUNK:
                yield parts.scan(length, trigger, wide)
                parts = Parts()
    if parts.size:
        yield parts.scan(length, trigger, wide)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


PLACES = "k long, v long, doc_id long, at int, first int, last int"


def repeated_triggers(docs: DataFrame, length: int, trigger: int) -> DataFrame:
    """Trigger hashes that occur at two places or more."""

    def make():
        def run(rows):
            keys = [x["k"] for x in scans(rows["text"], length, trigger, wide=False)]
            k, n = np.unique(np.concatenate(keys) if keys else np.empty(0, np.uint64), return_counts=True)
            return {"k": signed(k), "n": np.minimum(n, 2).astype(np.int32)}

        return run

    rows = map_rows(docs.where("doc_id is not null").select("doc_id", "text"), make, "k long, n int")
    return rows.groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").select("k")


def places(docs: DataFrame, seen: np.ndarray, length: int, trigger: int) -> DataFrame:
    """Places of repeated triggers: the first of each phrase in a slice of rows, and, with k null, covered starts.

    What a slice can settle by itself, an occurrence after another of the same phrase, needs no shuffle: runs of such
    occurrences come as one row with their first and last start.
    """
    bits = docs.sparkSession.sparkContext.broadcast(seen)

    def make():
        def run(rows):
            docs_of = np.array(rows["doc_id"], np.int64)
            cols = [tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))]
            for x in scans(rows["text"], length, trigger):
                hit = in_bitmap(bits.value, x["k"])
                cols.append((x["k"][hit], x["v"][hit], docs_of[x["row"][hit]], x["at"][hit], x["first"][hit], x["last"][hit]))
            k, v, doc, at, first, last = (np.concatenate(x) for x in zip(*cols))
            turn = np.lexsort((at, doc, v, k))
            k, v, doc, at, first, last = (x[turn] for x in (k, v, doc, at, first, last))
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.empty(0, np.int64)
            head = new | ((doc == doc[lead]) & (at == at[lead]))
            d, a, b = doc[~head], first[~head], last[~head]
            turn = np.lexsort((b, a, d))
            d, a, b = d[turn], a[turn], b[turn]
            if len(d):
                begins = np.ones(len(d), bool)
                begins[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1] + 1)
                s = np.flatnonzero(begins)
                d, a, b = d[s], a[s], b[np.append(s[1:], len(b)) - 1]
            no = [None] * len(d)
            none = np.zeros(len(d), np.int64)
            return {
                "k": signed(k[head]).tolist() + no, "v": signed(v[head]).tolist() + no, "doc_id": np.append(doc[head], d), "at": np.append(at[head], none).astype(np.int32),
                "first": np.append(first[head], a).astype(np.int32), "last": np.append(last[head], b).astype(np.int32),
            }

        return run

    return map_rows(docs.where("doc_id is not null").select("doc_id", "text"), make, PLACES)


MEETINGS = "k long, context binary, left_size int, first int, last int, string binary, doc_id long, at int"


def strings_at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The strings of `length` bytes at these places, as fixed-size byte strings that numpy sorts by their bytes."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts]).view(f"S{length}")[:, 0]


def suffix_order(strings: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings by bytes, then corpus order; whether each in that order is at the first place of its class)."""
    turn = np.lexsort((at, doc))
    turn = turn[np.argsort(strings[turn], kind="stable")]
    s, d, a = strings[turn], doc[turn], at[turn]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else np.empty(0, np.int64)
    return turn, new | ((d == d[lead]) & (a == a[lead]))


def meetings(docs: DataFrame, few: np.ndarray, many: np.ndarray, seen: np.ndarray, length: int, trigger: int) -> DataFrame:
    """For places in the bitmap few: k, context, and the strings' range. For places in many: their strings, the first of
    each in a slice; what comes later in the slice is covered and has neither context nor string."""
    context = docs.sparkSession.sparkContext
    few_, many_, repeats = context.broadcast(few), context.broadcast(many), context.broadcast(seen)

    def make():
        def run(rows):
            out = {c: [] for c in ("k", "context", "left_size", "first", "last", "string", "doc_id", "at")}
            docs_of = np.array(rows["doc_id"], np.int64)
            cols = []
            for x in scans(rows["text"], length, trigger):
                doc = docs_of[x["row"]]
                hit = np.flatnonzero(in_bitmap(repeats.value, x["k"]))
                place = place_hash(doc[hit], x["at"][hit])
                data = x["data"].tobytes()
                own = hit[in_bitmap(few_.value, place)]
                out["k"] += signed(x["k"][own]).tolist()
                out["context"] += [data[a:b] for a, b in zip(x["a"][own].tolist(), x["b"][own].tolist())]
                for c, name in (("left_size", "left"), ("first", "first"), ("last", "last"), ("at", "at")):
                    out[c] += x[name][own].tolist()
                out["doc_id"] += doc[own].tolist()
                own = hit[in_bitmap(many_.value, place)]
                if len(own):
                    size = x["last"][own] - x["first"][own] + 1
                    start = np.repeat(x["first"][own] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                    cols.append((strings_at(x["data"], start - np.repeat(x["move"][own], size), length), np.repeat(doc[own], size), start))
            out["string"] = [None] * len(out["k"])
            if cols:
                string, doc, at = (np.concatenate(c) for c in zip(*cols))
                turn, first = suffix_order(string, doc, at)
                head = np.empty(len(turn), bool)
                head[turn] = first
                raw = string.tobytes()  # in the order of the text, where each string repeats most of the one before and takes little space
                out["string"] += [raw[i * length : (i + 1) * length] if h else None for i, h in enumerate(head.tolist())]
                out["doc_id"] += doc.tolist()
                out["at"] += at.tolist()
                for c in ("k", "context", "left_size", "first", "last"):
                    out[c] += [None] * len(doc)
            return out

        return run

    return map_rows(docs.where("doc_id is not null").select("doc_id", "text"), make, MEETINGS)


def agreeing(phrases: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, first, last) of covered starts among phrases (doc_id, at, context, left size, first, last), by the suffix array of their contexts."""
    doc, at, left, first, last = (np.array([p[i] for p in phrases], np.int64) for i in (0, 1, 3, 4, 5))
    data = np.frombuffer(b"".join([p[2] for p in phrases]), np.uint8)
    begin = np.append(0, np.cumsum([len(p[2]) for p in phrases])[:-1])
    size = last - first + 1
    start = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    doc = np.repeat(doc, size)
    turn, head = suffix_order(strings_at(data, start + np.repeat(begin + left - at, size), length), doc, start)
    doc, start = doc[turn[~head]], start[turn[~head]]
    turn = np.lexsort((start, doc))
    doc, start = doc[turn], start[turn]
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))) if len(doc) else np.empty(0, np.int64)
    return doc[cut], start[cut], start[np.append(cut[1:], len(doc)) - 1] if len(doc) else start


def compared(rows: DataFrame, length: int) -> DataFrame:
    """Covered starts among the few phrases of each trigger, read in a stream sorted by trigger.

    Only the first place of each phrase is held, and triggers are sorted together up to SORTED phrases. A trigger that
    turns out to have more than FEW phrases came through the bitmap by chance; its strings are dealt by Spark, so it is
    left out here. So a task holds SORTED + FEW contexts at most.
    """
    few, most = FEW, SORTED
    schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches):
        trigger, group, held = None, {}, []

        def found() -> pa.RecordBatch:
            got = agreeing(held, length) if held else [np.empty(0, np.int64)] * 3
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c).cast(x.type) for c, x in zip(got, schema)], schema=schema)

        for batch in batches:
            for k, doc, at, context, left, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if k != trigger:
                    if 1 < len(group) <= few:
                        held.extend(group.values())
                        if len(held) >= most:
                            yield found()
                    trigger, group = k, {}
                phrase = (context, left, at - first, last - at)
                mine = (doc, at, context, left, first, last)
                if phrase in group:
                    group[phrase] = min(group[phrase], mine)
                elif len(group) <= few:
                    group[phrase] = mine
        if 1 < len(group) <= few:
            held.extend(group.values())
        yield found()

    return rows.select("k", "doc_id", "at", "context", "left_size", "first", "last").repartition("k").sortWithinPartitions("k").mapInArrow(run, "doc_id long, first int, last int")


def place_hash(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    base = mix(doc.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return mix(base + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bitmap_of_places(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(place_hash(b.column(0).to_numpy(), b.column(1).to_numpy())))], names=["h"])

    return bitmap_of(rows.select("doc_id", "at").mapInArrow(run, "h long"), "h", bits)


def covered_starts(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(doc_id, first, last): ranges of starts whose string also starts earlier."""
    again = written(repeated_triggers(docs, length, trigger), "triggers")
    seen = bitmap_of(again, "k", BITS)
    found = written(places(docs, seen, length, trigger), "places")
    heads = found.where("k is not null")
    phrases = written(heads.groupBy("k", "v").agg(F.min("doc_id").alias("pd"), F.min_by("at", "doc_id").alias("pa"), F.count("at").alias("n")), "phrases")
    first = phrases.where("n > 1")
    later = join_counted(heads, first, ["k", "v"]).where("doc_id <> pd or at <> pa").select("doc_id", "first", "last")
    number = phrases.groupBy("k").agg(F.count("v").alias("number")).where("number > 1")
    origin = written(phrases.join(number, "k").select(F.col("pd").alias("doc_id"), F.col("pa").alias("at"), (F.col("number") <= FEW).alias("few")), "origins")
    met = written(meetings(docs, _bitmap_of_places(origin.where("few")), _bitmap_of_places(origin.where("not few")), seen, length, trigger), "meetings")
    near = compared(met.where("k is not null"), length)
    strings = met.where("k is null and string is not null").select("string", "doc_id", F.col("at").alias("first"), F.col("at").alias("last"))
    strings = twice(strings)
    classes = strings.groupBy("string").agg(F.min(F.struct("doc_id", "first")).alias("p"), F.max(F.struct("doc_id", "first")).alias("q"), F.count("first").alias("n")).where("p < q")
    classes = written(classes.select("string", F.col("p.doc_id").alias("pd"), F.col("p.first").alias("pa"), "n"), "classes")
    single = join_counted(strings, classes, ["string"]).where("doc_id <> pd or first <> pa").select("doc_id", "first", "last")
    inside = met.where("k is null and string is null").select("doc_id", F.col("at").alias("first"), F.col("at").alias("last"))
    return found.where("k is null").select("doc_id", "first", "last").unionByName(later).unionByName(near).unionByName(single).unionByName(inside)


def twice(strings: DataFrame) -> DataFrame:
    """The strings without most of those that occur once, found through a bitmap of fixed size of the hashes that occur twice."""
    hashed = strings.withColumn("h", F.xxhash64("string"))
    seen = strings.sparkSession.sparkContext.broadcast(bitmap_of(hashed.groupBy("h").agg(F.count("h").alias("n")).where("n > 1"), "h", DOC_BITS))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(seen.value, b.column(4).to_numpy()))).select(["string", "doc_id", "first", "last"])

    small_batches(strings.sparkSession)
    return hashed.mapInArrow(run, "string binary, doc_id long, first int, last int")


def shared_ids(docs: DataFrame) -> DataFrame:
    """The ids that have several texts."""
    texts = F.struct(F.xxhash64("text"), F.length("text"))
    return written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(texts).alias("lo"), F.max(texts).alias("hi")).where("lo <> hi").select("doc_id"), "several")


STRINGS = "doc_id long, own long, start long, h long, g long"


def all_strings(docs: DataFrame, length: int, seen: np.ndarray | None = None) -> DataFrame:
    """doc_id, own, start and two hashes of each string of the rows (doc_id, text, own); with seen, of those whose h is in that bitmap."""
    bits = docs.sparkSession.sparkContext.broadcast(seen)

    def make():
        def run(rows):
            out = {c: [np.empty(0, np.int64)] for c in ("doc_id", "own", "start", "h", "g")}
            for doc, text, own in zip(rows["doc_id"], rows["text"], rows["own"]):
                data = _bytes(text)
                for a in range(0, max(len(data) - length + 1, 0), CHUNK):
                    part = data[a : a + CHUNK + length - 1]
                    h = Rolling(part, 0).windows(length)
                    hit = np.arange(len(h)) if bits.value is None else np.flatnonzero(in_bitmap(bits.value, h))
                    out["h"].append(signed(h[hit]))
                    out["g"].append(signed(Rolling(part, 1).windows(length)[hit]))
                    out["start"].append(a + hit)
                    out["doc_id"].append(np.full(len(hit), doc, np.int64))
                    out["own"].append(np.full(len(hit), own, np.int64))
            return {c: np.concatenate(v) for c, v in out.items()}

        return run

    return map_rows(docs.select("doc_id", "text", "own"), make, STRINGS)


def string_by_string(shared: DataFrame, others: DataFrame, length: int) -> DataFrame:
    """(doc_id, own, first, last): covered starts that the shared rows hold, or that they cover in the others, where own is 0."""
    mine = written(all_strings(shared, length), "shared-strings")
    rows = mine.unionByName(all_strings(others, length, bitmap_of(mine, "h", BITS)))
    classes = rows.groupBy("h", "g").agg(F.min("doc_id").alias("pd"), F.max("doc_id").alias("qd"), F.count("*").alias("n")).where("pd < qd").drop("qd")
    cross = join_counted(rows, written(classes, "shared-classes"), ["h", "g"]).where("doc_id > pd")
    twice_in = mine.groupBy("h", "g", "doc_id", "own").agg(F.min("start").alias("begin"), F.count("*").alias("n")).where("n > 1")
    again = join_counted(mine, written(twice_in, "shared-again"), ["h", "g", "doc_id", "own"]).where("start > begin")
    starts = cross.select("doc_id", "own", "start").union(again.select("doc_id", "own", "start")).distinct()
    chunk = Window.partitionBy("doc_id", "own", F.shiftright("start", 16)).orderBy("start")
    runs = starts.withColumn("run", F.col("start") - F.row_number().over(chunk)).groupBy("doc_id", "own", F.shiftright("start", 16), "run")
    return runs.agg(F.min("start").alias("first"), F.max("start").alias("last")).select("doc_id", "own", "first", "last")


def remove_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (the remaining bytes) and spans of every document."""
    docs = docs.select("doc_id", "text")
    several = shared_ids(docs)
    if several.isEmpty():
        return without_ranges(docs.withColumn("own", F.lit(0).cast("long")), covered_starts(docs, length, trigger).withColumn("own", F.lit(0).cast("long")), length, keep_text)
    other = docs.join(several, "doc_id", "left_anti").withColumn("own", F.lit(0).cast("long"))
    # 0 stands for rows whose doc_id says which they are.
    shared = docs.join(several, "doc_id").withColumn("own", F.expr("coalesce(nullif(xxhash64(coalesce(text, '')), 0L), 1L)"))
    ranges = covered_starts(other, length, trigger).withColumn("own", F.lit(0).cast("long")).unionByName(string_by_string(shared, other.where("doc_id is not null"), length))
    return without_ranges(other.unionByName(shared), ranges, length, keep_text)


def without_ranges(docs: DataFrame, starts: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """The rows (doc_id, text, own) without the bytes of strings that start in the ranges of starts (doc_id, own, first, last)."""
    ranges = starts.groupBy("doc_id", "own").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    ranges = written(ranges.select("doc_id", "own", F.col("starts.first").alias("a"), F.col("starts.last").alias("b")), "ranges")
    # Only documents that may lose bytes (by a bitmap of fixed size) are shuffled to meet their ranges.
    hit = docs.sparkSession.sparkContext.broadcast(_bitmap_of_places(ranges.select("doc_id", F.lit(0).alias("at")), DOC_BITS))

    def may_lose(ids: pa.Array) -> np.ndarray:
        doc = ids.fill_null(0).to_numpy()
        return in_bitmap(hit.value, place_hash(doc, np.zeros(len(doc), np.int64))) & ids.is_valid().to_numpy(zero_copy_only=False)

    def losing(batches):
        for b in batches:
            yield b.filter(pa.array(may_lose(b.column(0))))

    both = docs.select("doc_id", "text", "own").mapInArrow(losing, "doc_id long, text string, own long").join(ranges, ["doc_id", "own"], "left").select("doc_id", "text", "a", "b")
    extra = ", kept binary, spans array<struct<begin: long, end: long>>" if keep_text else ""

    def make(whole: bool = False):
        def run(rows):
            if whole:
                stay = ~may_lose(pa.array(rows["doc_id"], pa.int64()))
                rows = {c: [x for x, ok in zip(v, stay) if ok] for c, v in rows.items()}
                rows["a"] = rows["b"] = [None] * len(rows["doc_id"])
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")} | {"doc_id": rows["doc_id"]}
            for text, a, b in zip(rows["text"], rows["a"], rows["b"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = []
                if a:
                    a, b = np.array(a, np.int64), np.array(b, np.int64) + length
                    turn = np.argsort(a, kind="stable")
                    a, b = a[turn], np.maximum.accumulate(b[turn])
                    s = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                    runs = list(zip(a[s].tolist(), b[np.append(s[1:], len(a)) - 1].tolist()))
                kept, at = [], 0
                for x, y in runs:
                    kept.append(data[at:x])
                    at = y
                left = b"".join([*kept, data[at:]])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(left))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    out["kept"].append(left)
                    out["spans"].append([{"begin": x, "end": y} for x, y in runs])
            return out

        return run

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra
    return map_rows(both, make, schema).unionByName(map_rows(docs.select("doc_id", "text"), lambda: make(whole=True), schema))


def op9(spark, sf_dir) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
