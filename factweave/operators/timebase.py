"""The time base of a project: core clock, tick period, counters that interrupts advance, and loops that wait for them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# The names that hold the core clock, in order, and how many accesses may write a counter.
CLOCK_NAMES, MOST_WRITES = ("SystemCoreClock", "SystemCoreClockUpdate"), 3
IDENTIFIER = r"([A-Za-z_]\w*)"
COLUMNS = ("kind", "name", "value", "unit", "expression", "function", "line", "basis", "confidence")


def _folded(text: Column, names: Column, texts: Column) -> Column:
    @F.pandas_udf("value double, basis string")
    def fold(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ts, ns, xs in parts:
            got = [S.fold_text(t, dict(zip(n, x))) if t is not None else (None, "unresolved") for t, n, x in zip(ts, ns, xs)]
            yield pd.DataFrame(got, columns=["value", "basis"]).astype({"value": "float64"})

    return fold(text, names, texts)


def folded(expressions: DataFrame, constants: DataFrame, hops: int = 4) -> DataFrame:
    """(id, text, value, basis) of constant expressions (id, text) with named constants (name, text).

    Each expression meets only the constants that it names, and those that these name, so many hops deep, by joins; the table
    of constants is never held whole.
    """
    known = constants.where("text is not null").groupBy("name").agg(F.min("text").alias("meaning"))
    names = lambda df, c: df.select("id", F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(1)))).alias("name"))
    front, levels = names(expressions, "text"), []
    for _ in range(hops):
        met = front.join(known, "name")
        levels.append(met)
        front = names(met, "meaning").distinct()
    pairs = reduce(DataFrame.unionByName, levels).distinct().groupBy("id").agg(F.collect_list(F.struct("name", "meaning")).alias("c"))
    none = F.array().cast("array<string>")
    got = expressions.select("id", "text").distinct().join(pairs, "id", "left")
    got = got.withColumn("f", _folded(F.col("text"), F.coalesce("c.name", none), F.coalesce("c.meaning", none)))
    return got.select("id", "text", "f.value", "f.basis")


def _row(**given: Column) -> list[Column]:
    types = dict(value="double", line="bigint")
    return [given.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS]


def core_clock(constants: DataFrame) -> DataFrame:
    """The clock in Hz that the first of CLOCK_NAMES among the constants gives: start-up code may change it, so confidence is medium."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(CLOCK_NAMES) for x in (n, i)]), F.col("name"))
    named = constants.where(F.col("name").isin(*CLOCK_NAMES)).groupBy("name").agg(F.min("text").alias("text"))
    first = named.agg(F.min_by(F.struct("name", "text"), rank).alias("m")).where("m is not null").select(F.col("m.name").alias("id"), F.col("m.name").alias("text"), F.col("m.text").alias("initial"))
    got = folded(first, constants).join(first.select("id", "initial"), "id")
    return got.select(*_row(kind=F.lit("core-clock"), name=F.col("id"), value=F.col("value"), unit=F.lit("hz"), expression=F.concat_ws(" = ", "id", "initial"), basis=F.lit("initializer"), confidence=F.lit("medium")))


def systick(calls: DataFrame, constants: DataFrame, declared_ms: float | None = None) -> DataFrame:
    """The tick period in ms of each call (function, callee, line, expression) that sets the reload value: reload over clock.

    Without any such call the declared period counts, if there is one.
    """
    at = F.struct("function", "callee", "line", "expression")
    got = folded(calls.select(at.alias("id"), F.col("expression").alias("text")), constants)
    clock = core_clock(constants).agg(F.max("value").alias("clock"))
    tick = F.round(F.col("value") / F.nullif("clock", F.lit(0.0)) * 1000, 6)
    found = got.join(F.broadcast(clock)).withColumn("tick", tick).select(*_row(
        kind=F.lit("systick"), name=F.col("id.callee"), value=F.col("tick"), unit=F.when(F.col("tick").isNotNull(), "ms"), expression=F.col("text"), function=F.col("id.function"), line=F.col("id.line"),
        basis=F.when(F.col("tick").isNotNull(), "expression").otherwise(F.col("basis")), confidence=F.when(F.col("tick").isNotNull(), "medium").otherwise("low"),
    ))
    if declared_ms is None:
        return found
    none = calls.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return found.unionByName(none.select(*_row(kind=F.lit("systick"), name=F.lit("tick_ms"), value=F.lit(declared_ms), unit=F.lit("ms"), expression=F.lit(f"tick_ms: {declared_ms}"), basis=F.lit("declared"), confidence=F.lit("low"))))


def counters(accesses: DataFrame, reached: DataFrame) -> DataFrame:
    """Variables that count time: up to MOST_WRITES writes, each a plain read_write in a function that interrupts reach, and a read in
    one that only other units reach.

    accesses: name, kind, via, function, line; reached: unit_kind, function. value counts the reads, function and line are those
    of the first write.
    """
    sides = reached.groupBy("function").agg(F.bool_or(F.col("unit_kind") == "isr").alias("in_isr"), F.bool_or(F.col("unit_kind") != "isr").alias("in_thread"))
    a = accesses.join(sides, "function", "left")
    in_isr, write, read = F.coalesce("in_isr", F.lit(False)), F.col("kind").isin("write", "read_write"), F.col("kind").isin("read", "read_write")
    plain = (F.col("kind") == "read_write") & (F.coalesce("via", F.lit("")) == "") & in_isr
    got = a.groupBy("name").agg(
        F.count_if(write).alias("writes"), F.count_if(write & ~plain).alias("odd"), F.count_if(read).alias("reads"), F.count_if(read & F.coalesce("in_thread", F.lit(False)) & ~in_isr).alias("outside"), F.min(F.when(write, F.struct("line", "function"))).alias("at")
    ).where(f"writes between 1 and {MOST_WRITES} and odd = 0 and outside > 0")
    return got.select(*_row(kind=F.lit("tick-counter"), name=F.col("name"), value=F.col("reads"), unit=F.lit("count"), expression=F.concat("name", F.lit("++")), function=F.col("at.function"), line=F.col("at.line"), basis=F.lit("derived"), confidence=F.lit("medium")))


def timeout_loops(loops: DataFrame, counted: DataFrame, accesses: DataFrame, constants: DataFrame) -> DataFrame:
    """Loops (function, line, condition) whose condition names a counter, or a function that reads one counter and touches nothing else.

    value is the constant on the right of the first comparison, in ticks. A named counter counts before a function.
    """
    own = counted.select("name")
    touched = accesses.groupBy("function").agg(F.count_distinct("name").alias("n"), F.min("name").alias("counter"), F.bool_or(F.col("kind") == "read").alias("reads"))
    readers = touched.where("n = 1 and reads").join(own.withColumnRenamed("name", "counter"), "counter", "left_semi").groupBy(F.element_at(F.split("function", ":"), -1).alias("word")).agg(F.min("counter").alias("counter"))
    words = loops.where("condition <> ''").select("function", "line", "condition", F.explode(F.array_distinct(F.regexp_extract_all("condition", F.lit(IDENTIFIER), F.lit(1)))).alias("word"))
    hits = words.join(own.select(F.col("name").alias("word"), F.lit(0).alias("rank"), F.col("name").alias("counter")).unionByName(readers.select("word", F.lit(1).alias("rank"), "counter")), "word")
    best = hits.groupBy("function", "line", "condition").agg(F.min(F.struct("rank", "counter")).alias("m"))
    right = F.nullif(F.regexp_extract("condition", r"(?:<=|<|>=|>)\s*([A-Za-z_]\w*|\d+)", 1), F.lit(""))
    bound = best.select("function", "line", "condition", F.col("m.counter").alias("counter"), F.struct("function", "line", "condition").alias("id"), right.alias("text"))
    value = folded(bound.where("text is not null").select("id", "text"), constants).select("id", "value")
    got = bound.join(value, "id", "left")
    return got.select(*_row(kind=F.lit("timeout-loop"), name=F.col("counter"), value=F.col("value"), unit=F.when(F.col("value").isNotNull(), "count"), expression=F.trim("condition"), function=F.col("function"), line=F.col("line"), basis=F.lit("derived"), confidence=F.lit("medium")))


def time_base(calls: DataFrame, accesses: DataFrame, reached: DataFrame, loops: DataFrame, constants: DataFrame, declared_ms: float | None = None) -> DataFrame:
    """All facts of the time base: (kind: core-clock | systick | tick-counter | timeout-loop, name, value, unit, expression, function, line, basis, confidence)."""
    counted = counters(accesses, reached)
    parts = [core_clock(constants), systick(calls, constants, declared_ms), counted, timeout_loops(loops, counted, accesses, constants)]
    return reduce(DataFrame.unionByName, parts)
