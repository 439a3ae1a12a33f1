"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders; all else is a word in lower case without marks at its edges. Windows
of WIDTH tokens (whole items, if shorter) of texts and benchmark items meet by hash join, and as templates by equality.
Along one alignment of a text and an item, slots must be filled consistently: equal values of the item stand for equal
values in the text. So re-parameterised questions are caught, and texts that only share a pattern with other fillings
in each place are not. A document is contaminated by an item of which it holds LEAST of the windows, or a run of windows
that covers RUN consecutive words, however long the item is. Of an alignment that is not consistent the windows that stand
word for word remain: they count if a run of them covers RUN words.

Whether a word is a placeholder can depend on its place and case, so windows meet in three more forms: with the first token
as a word if only its neighbour or case made it a placeholder, with all capitalised words that are no known names as words
(so that languages that capitalise nouns keep their words), and with all tokens as words.

A window needs LITERALS tokens that are no placeholders (fewer in items that have none such). Items with fewer than
SHORTEST tokens are looked for whole and as words only, as templates of so few tokens are in any text. Texts first pass a
bitmap of fixed size of the items' window hashes, so only windows that may match are shuffled, however common an item is.

Null and empty texts and items, and items of marks alone, match nothing. Rows are searched one by one: rows without doc_id
and items without item_id each count for themselves and appear with a null id; of rows that share a doc_id (or item_id) the
one that holds most is reported.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, free_name, in_bitmap, map_rows, mix, odd_constants, signed, table, window_hashes, window_sums, without, words_of, written

WIDTH, LITERALS, SHORTEST, LEAST, RUN = 8, 4, 5, 0.5, 13
MOST_BROADCAST = 500_000
NUM, NAME, UNIT, ENDS, TITLE = 1, 2, 4, 8, 16
LOW = np.uint64(31)
SLOT_CODES = {NUM: 0x1F3A5C7E9B2D4F60, NAME: 0x2E4D6C8BAA09F7E0, UNIT: 0x3C5B7A9918D6E5C0}
SLOT_TEXT = {NUM: "<num>", NAME: "<name>", UNIT: "<unit>"}
NUMBER = re.compile(rb"[+\-]?[0-9][0-9.,:/]*(?:%|st|nd|rd|th)?")
JOINED = re.compile(rb"[+\-]?[0-9][0-9.,]*([A-Za-z]{1,4})")
EDGES = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%+-") + b"-"
# Number words, units and first names.
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(b"mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g kg mg lb lbs oz gram grams pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees c f k mph kmh kph w kw v a hz khz mhz ghz b kb mb gb tb bit bits byte bytes".split())
NAMES = frozenset(b"james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel lisa matthew nancy anthony betty mark sandra emily anna emma olivia liam noah ava sophia lucas mia alice bob carol peter paul maria jose juan carlos luis pierre marie hans anna klaus".split())


class Tokens(dict):
    """For a word: a hash of its canonical form with kinds in the low bits; what is kept is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        core = word.strip(EDGES)
        low = core.lower()
        kind = ENDS * (word[-1:] in b".!?:" or word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":"))
        plain = core.isalpha()
        if low in NUMBER_WORDS or not plain and (NUMBER.fullmatch(core) or (m := JOINED.fullmatch(core)) and m[1].lower() in UNITS):
            kind |= NUM
        elif low in NAMES:
            kind |= NAME
        elif low in UNITS:
            kind |= UNIT
        elif core[:1].isupper() and len(core) > 1 and core[1:].islower():
            kind |= TITLE
        h = self[word] = xxhash.xxh3_64_intdigest(low) & ~31 | kind
        return h


def canonical(words: list[bytes], cache: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of tokens, kind of the slot or 0, codes of tokens as words, whether only its place or case makes a token a slot, whether its case does)."""
    code = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    kind = (code & LOW).astype(np.int64)
    slot = np.where(kind & NUM, NUM, np.where(kind & NAME, NAME, 0))
    after = np.zeros(len(words), np.int64)
    after[1:] = kind[:-1]
    slot = np.where((kind & UNIT > 0) & (after & NUM > 0), UNIT, slot)
    inner = (kind & TITLE > 0) & (after & ENDS == 0)
    if len(words):
        inner[0] = False
    slot = np.where(inner, NAME, slot)
    plain = code & ~LOW
    out = plain.copy()
    for k, c in SLOT_CODES.items():
        out[slot == k] = np.uint64(c)
    return out, slot, plain, (slot == UNIT) | inner, inner


TEMPLATE, FIRST, STRICT, PLAIN = 0, 1, 2, 3


def _in_windows(mask: np.ndarray, width: int) -> np.ndarray:
    total = np.append(0, np.cumsum(mask))
    return total[width:] - total[:-width]


def forms(code: np.ndarray, plain: np.ndarray, loose: np.ndarray, inner: np.ndarray, slot: np.ndarray, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(form, hashes of the windows, places where that form differs from the ones before it)."""
    n = len(code) - width + 1
    if n <= 0:
        return []
    if width < SHORTEST:
        return [(PLAIN, window_hashes(plain, width), np.ones(n, bool))]
    slots, cased = _in_windows(slot > 0, width), _in_windows(inner, width)
    sums = window_sums(code, width)
    found = [(TEMPLATE, mix(sums), np.ones(n, bool))]
    if loose[:n].any():
        found.append((FIRST, mix(sums + (plain[:n] - code[:n]) * odd_constants(width, 7)[0]), loose[:n]))
    mixed = (cased > inner[:n]) & (slots > cased)
    if mixed.any():
        found.append((STRICT, window_hashes(np.where(inner, plain, code), width), mixed))
    if slots.any():
        found.append((PLAIN, window_hashes(plain, width), slots > loose[:n]))
    return found


def windows(rows_of: DataFrame, widths: list[int], bitmap: np.ndarray | None = None) -> DataFrame:
    """Windows of rows (row, text, id) in all forms whose hash is in the bitmap; with no bitmap, of items (whole if short).

    filled: what the slots of the template hold; for an item's window of words, what its slots would hold. counts: whether
    the window is one of those that coverage is counted by.
    """
    bits = None if bitmap is None else rows_of.sparkSession.sparkContext.broadcast(bitmap)
    kind = dict(rows_of.dtypes)["id"]

    def chosen(slot: np.ndarray, inner: np.ndarray, width: int) -> dict[int, np.ndarray]:
        """The places of an item where windows of each form are taken: those with enough words that are no slots."""
        least = min(LITERALS, width)
        wide, strict = (_in_windows(x, width) >= least for x in (slot == 0, (slot == 0) | inner))
        every = np.ones(len(strict), bool)
        as_words = strict if strict.any() else every
        as_slots = wide if wide.any() or strict.any() else every
        return {TEMPLATE: as_slots, FIRST: as_slots, STRICT: as_words, PLAIN: as_words, -1: as_slots if as_slots.any() else as_words}

    def make():
        cache = Tokens()

        def run(rows):
            out = {c: [] for c in ("id", "row", "at", "form", "h", "template", "filled", "n_tokens", "counts")}
            for own, row, text in zip(rows["id"], rows["row"], rows["text"]):
                words = words_of(text)
                if not words or bits is None and not any(w.strip(EDGES) for w in words):
                    continue
                code, slot, plain, loose, inner = canonical(words, cache)
                for width in widths if bits is not None else [min(WIDTH, len(words))]:
                    taken = None if bits is not None else chosen(slot, inner, width)
                    for form, h, own_form in forms(code, plain, loose, inner, slot, width):
                        if bits is not None:
                            at = np.flatnonzero(own_form & in_bitmap(bits.value, h))
                            if width < SHORTEST:
                                at = at[np.unique(h[at], return_index=True)[1]]
                        else:
                            at = np.flatnonzero(taken[form] & own_form)
                        for i in at.tolist():
                            as_word = {TEMPLATE: (), FIRST: (i,), STRICT: i + np.flatnonzero(inner[i : i + width]), PLAIN: range(i, i + width)}[form]
                            out["id"].append(own)
                            out["row"].append(row)
                            out["at"].append(i)
                            out["form"].append(form)
                            out["h"].append(int(signed(h[i : i + 1])[0]))
                            cut = [(slot[j], j in as_word, words[j].strip(EDGES).lower().decode("utf-8", "replace")) for j in range(i, i + width)]
                            out["template"].append(" ".join(w if plain_word or not k else SLOT_TEXT[k] for k, plain_word, w in cut))
                            out["filled"].append([f"{k}{w}" for k, plain_word, w in cut if k and (not plain_word or form == PLAIN and bits is None)])
                            out["n_tokens"].append(len(words))
                            out["counts"].append(taken is None or bool(taken[-1][i]))
            return out

        return run

    return map_rows(rows_of.select("row", "text", "id"), make, f"id {kind}, row long, at int, form int, h long, template string, filled array<string>, n_tokens int, counts boolean")


def run_words(places: Column) -> Column:
    """The most words that windows cover without a gap; places: structs (nth, item_at, width), nth counting the item's windows."""
    start = F.struct(F.lit(-1).alias("nth"), F.lit(-1).alias("at"), F.lit(-1).alias("first"), F.lit(0).alias("most"))

    def step(run, x):
        first = F.when((x["nth"] == run["nth"] + 1) & (x["item_at"] <= run["at"] + x["width"]) & (run["first"] >= 0), run["first"]).otherwise(x["item_at"])
        return F.struct(x["nth"].alias("nth"), x["item_at"].alias("at"), first.alias("first"), F.greatest(run["most"], x["item_at"] + x["width"] - first).alias("most"))

    return F.aggregate(F.array_sort(places), start, step, lambda run: run["most"])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage, run_words, changed_slots) of each document and item that it holds."""
    row = F.monotonically_increasing_id().alias("row")
    known = written(benchmark.select(F.col("item_id").alias("id"), "text").dropDuplicates().select("id", "text", row), "benchmark")
    items = written(windows(known, [WIDTH]), "items")
    widths = sorted(r[0] for r in items.select(F.least("n_tokens", F.lit(WIDTH))).distinct().collect())
    size = items.groupBy(F.col("row").alias("item_row")).agg(F.countDistinct(F.when(F.col("counts"), F.col("at"))).alias("n_windows"))
    nth = (F.dense_rank().over(Window.partitionBy("row").orderBy("at")) - 1).alias("nth")
    right = items.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("at").alias("item_at"), nth, F.least("n_tokens", F.lit(WIDTH)).alias("width"), F.col("form").alias("item_form"), "h", "template", F.col("filled").alias("meant"), F.col("counts").alias("own")).join(size, "item_row")
    if items.count() <= MOST_BROADCAST:
        right = F.broadcast(right)
    left = windows(docs.select(row, "text", F.col("doc_id").alias("id")), widths, bitmap_of(items, "h")).withColumnRenamed("id", "doc_id").drop("counts", "n_tokens")
    of = ["row", "doc_id", "item_row", "item_id", "n_windows"]
    met = left.join(right, ["h", "template"]).withColumn("filled", F.when(F.col("item_form") == PLAIN, F.col("meant")).otherwise(F.col("filled"))).select(*of, F.struct("nth", "item_at", "width", "own").alias("place"), (F.col("at") - F.col("item_at")).alias("shift"), F.arrays_zip("meant", "filled").alias("slots"))
    verbatim = F.when(F.forall("slots", lambda s: s["meant"] == s["filled"]), F.col("place"))
    lines = met.groupBy(*of, "shift").agg(F.collect_set("place").alias("places"), F.collect_set(verbatim).alias("verbatim"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.col("slots.meant")))
    changed = F.when(consistent, F.size(F.filter("slots", lambda s: s["meant"] != s["filled"]))).otherwise(0)
    lines = lines.select(*of, F.when(consistent, F.col("places")).otherwise(F.col("verbatim")).alias("places"), changed.alias("changed"), consistent.alias("consistent")).withColumn("run_words", run_words(F.col("places")))
    lines = lines.where(F.col("consistent") | (F.col("run_words") >= run))
    counted = F.array_distinct(F.flatten(F.collect_list(F.transform(F.filter("places", lambda p: p["own"]), lambda p: p["item_at"]))))
    held = lines.groupBy(*of).agg(F.size(counted).cast("long").alias("n_matched"), F.max("run_words").cast("long").alias("run_words"), F.max("changed").cast("long").alias("changed_slots"))
    held = held.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where((F.col("coverage") >= least) | (F.col("run_words") >= run))
    alone = [F.when(F.col("doc_id").isNull(), F.col("row")).alias("r"), F.when(F.col("item_id").isNull(), F.col("item_row")).alias("i")]
    most = F.max(F.struct("coverage", "run_words", "changed_slots", "n_matched", "n_windows")).alias("m")
    return held.groupBy("doc_id", "item_id", *alone).agg(most).select("doc_id", "item_id", "m.n_matched", "m.n_windows", "m.coverage", "m.run_words", "m.changed_slots")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no benchmark item. The text alone decides, so a row may lack a doc_id or share it."""
    name = free_name(docs, "text_key")
    key = F.sha2(F.col("text"), 256)
    held = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name))
    return without(docs.withColumn(name, key), held, name).select(*docs.columns)


def op8(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
