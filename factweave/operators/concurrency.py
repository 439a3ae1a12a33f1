"""Execution units, shared resources, conflicts, wake relations, data dependencies and run modes.

accesses is (resource, name, unit, unit_kind, function, path, line, kind, via, protected): accesses joined with the units that
reach their function. kind is read, write, read_write or address_taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut
from .joins import first_by
from .pairs import met_pairs

WRITES, READS = ("write", "read_write"), ("read", "read_write")
#: Access chains that start so go through a pointer; fields and indexes of the variable itself are direct.
INDIRECT = ("pointer-", "array-decay")
THREADS = ("task", "callback", "timer", "main")


def execution_units(registrations: DataFrame) -> DataFrame:
    """One unit for each kind and target (kind, target, rule, path, line, function): the first registration, framework rules
    before ast.*, and how often else it is registered; a repeated id gets #n."""
    rank = [F.col("rule").startswith("ast."), F.col("path"), F.col("line"), F.col("function")]
    w = Window.partitionBy("kind", "target").orderBy(*rank)
    first = registrations.withColumns({"r": F.row_number().over(w), "also": F.count(F.lit(1)).over(Window.partitionBy("kind", "target")) - 1}).where("r = 1")
    named = first.withColumn("name", F.regexp_extract("target", r"([^:]+)$", 1))
    twin = F.row_number().over(Window.partitionBy("kind", "name").orderBy("target"))
    return named.withColumn("n", twin).select(F.concat_ws(":", "kind", F.concat("name", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise(F.lit("")))).alias("unit"), "kind", "target", "rule", "function", "line", "also")


def domains(reached: DataFrame) -> DataFrame:
    """(function, domain): isr, task, callback, timer or main if only such units reach it, else mixed; reached is (unit_kind, function)."""
    kinds = reached.groupBy("function").agg(F.array_sort(F.collect_set("unit_kind")).alias("k"))
    return kinds.select("function", F.when(F.size("k") > 1, F.lit("mixed")).otherwise(F.element_at("k", 1)).alias("domain"))


def host_units(dispatchers: DataFrame, reached: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(callback, hosts, confidence): units (unit, function reached) whose code dispatches a callback (callback, function); one host high, several medium.

    With entries (unit, function) only innermost hosts count: one that reaches the entry of another host goes.
    """
    found = dispatchers.join(reached, "function").where("unit <> callback").select("callback", "unit").distinct()
    if entries is not None:
        # Which unit reaches the entry of which other is told for units, before callbacks come in.
        found = _cut(found)
        over = _cut(entries.select(F.col("unit").alias("other"), "function").distinct().join(reached, "function").where("unit <> other").select("unit", "other").distinct())
        outer = found.join(over, "unit").join(found.select("callback", F.col("unit").alias("other")), ["callback", "other"], "left_semi").select("callback", "unit").distinct()
        found = found.join(outer, ["callback", "unit"], "left_anti")
    got = found.groupBy("callback").agg(F.array_sort(F.collect_set("unit")).alias("h"))
    return got.select("callback", F.array_join("h", ",").alias("hosts"), F.when(F.size("h") == 1, "high").otherwise("medium").alias("confidence"))


def unit_summaries(accesses: DataFrame) -> DataFrame:
    """Per resource and unit: distinct kinds, distinct unprotected kinds, count."""
    return accesses.groupBy("resource", "unit", "unit_kind").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("protected"), F.col("kind")))), ",").alias("unprotected_kinds"), F.count(F.lit(1)).alias("access_count")
    )


def shared_resources(accesses: DataFrame) -> DataFrame:
    """Resources that two units or two files use: (resource, units, files, isr_units, access_count)."""
    return accesses.groupBy("resource").agg(
        F.count_distinct("unit").alias("units"), F.count_distinct("path").alias("files"), F.count_distinct(F.when(F.col("unit_kind") == "isr", F.col("unit"))).alias("isr_units"), F.count(F.lit(1)).alias("access_count")
    ).where("units > 1 or files > 1")


def conflicts(accesses: DataFrame, weak_units: DataFrame | None = None) -> DataFrame:
    """Interrupt side against thread side of each shared resource, from one aggregate for each side: (resource, pattern, confidence).

    An interrupt write with any unprotected thread access, else an unprotected thread write with any interrupt access.
    """
    write = F.col("kind").isin(*WRITES)
    direct = ~F.coalesce(F.col("via").rlike("^(" + "|".join(INDIRECT) + ")"), F.lit(False))
    free = ~F.col("protected")
    a = accesses if weak_units is None else accesses.join(weak_units.select("unit", F.lit(True).alias("weak")), "unit", "left")
    a = a.withColumn("weak", F.coalesce("weak", F.lit(False)) if weak_units is not None else F.lit(False))
    unit = a.groupBy("resource", "unit", "unit_kind").agg(
        F.bool_or(write).alias("w"), F.bool_or(write & direct).alias("dw"), F.bool_or(free).alias("u"), F.bool_or(free & write).alias("uw"), F.bool_or(free & direct).alias("ud"),
        F.bool_and(~free | (F.col("kind") == "address_taken")).alias("addr"), F.bool_or("weak").alias("weak"),
    )
    isr, other = F.col("unit_kind") == "isr", F.col("unit_kind").isin(*THREADS)
    side = unit.groupBy("resource").agg(
        F.bool_or(isr).alias("has_isr"), F.bool_or(isr & F.col("w")).alias("isr_w"), F.bool_or(isr & F.col("dw")).alias("isr_dw"), F.bool_or(other & F.col("u")).alias("oth_u"), F.bool_or(other & F.col("uw")).alias("oth_w"),
        F.bool_or(other & F.col("u") & F.col("ud")).alias("ud1"), F.bool_or(other & F.col("uw") & F.col("ud")).alias("ud2"), F.bool_and(~(other & F.col("u")) | F.col("addr")).alias("ad1"), F.bool_and(~(other & F.col("uw")) | F.col("addr")).alias("ad2"),
        F.bool_or(other & F.col("u") & F.col("weak")).alias("wk1"), F.bool_or(other & F.col("uw") & F.col("weak")).alias("wk2"),
    )
    first = F.col("isr_w") & F.col("oth_u")
    pattern = F.when(first, "isr-write/other-access").when(F.col("oth_w") & F.col("has_isr"), "other-write/isr-access")
    doubt = F.when(first, F.col("ad1") | ~F.col("isr_dw") | ~F.col("ud1") | F.col("wk1")).otherwise(F.col("ad2") | ~F.col("ud2") | F.col("wk2"))
    confidence = F.when(doubt, "low").when(F.col("isr_w") & F.col("oth_w"), "high").otherwise("medium")
    return side.withColumn("pattern", pattern).where("pattern is not null").select("resource", "pattern", confidence.alias("confidence"))


def wake_relations(accesses: DataFrame, conditions: DataFrame) -> DataFrame:
    """Flags that an interrupt writes and a task or callback reads in a condition (conditions: function, line): (resource, producers, consumers)."""
    plain = accesses.where("coalesce(via, '') = ''")
    made = plain.where((F.col("unit_kind") == "isr") & F.col("kind").isin(*WRITES)).groupBy("resource").agg(F.count_distinct("unit", "function", "line").alias("producers"))
    read = plain.where(F.col("unit_kind").isin("task", "callback") & F.col("kind").isin(*READS)).join(conditions.select("function", "line").distinct(), ["function", "line"], "left_semi")
    return made.join(read.groupBy("resource").agg(F.count_distinct("unit", "function", "line").alias("consumers")), "resource")


def data_dependencies(accesses: DataFrame, positions: DataFrame, scheduling: str) -> DataFrame:
    """Writer unit to reader unit over shared resources: (from_unit, to_unit, order, resource_count, writes, reads).

    Accesses are counted for each unit first, so that what meets is the units of a resource, not its accesses; pairs are
    counted where they are made and never shuffled. Callbacks with one host stand for it where accesses carries context and context_kind.
    positions: unit, place; places only need an order.
    """
    hosted = "context" in accesses.columns
    label = ["unit", "context", "context_kind"] if hosted else ["unit", "unit_kind"]
    context, kind = ("context", "context_kind") if hosted else ("unit", "unit_kind")
    per = accesses.groupBy("resource", *label).agg(F.count_if(F.col("kind").isin(*WRITES)).alias("writes"), F.count_if(F.col("kind").isin(*READS)).alias("reads"))
    per = _cut(per.join(positions.select(F.col("unit").alias(context), "place"), context, "left"))
    pairs = met_pairs(per.where("writes > 0"), per.where("reads > 0"), label, ["place"], ("writes", "reads"))
    got = pairs.where(f"a_unit <> b_unit and a_{context} <> b_{context}").withColumnsRenamed({"a_unit": "from_unit", "b_unit": "to_unit", f"a_{kind}": "from_kind", f"b_{kind}": "to_kind", "a_place": "from_place", "b_place": "to_place", "n": "resource_count", "left_sum": "writes", "right_sum": "reads"})
    tasks = (F.col("from_kind") == "task") & (F.col("to_kind") == "task")
    round_ = F.when(F.col("from_place").isNull() | F.col("to_place").isNull(), "unknown-order").when(F.col("from_place") < F.col("to_place"), "same-round").otherwise("next-round")
    task_order = round_ if scheduling == "cooperative" else F.lit("preemptive" if scheduling == "preemptive" else "unknown-order")
    order = F.when((F.col("from_kind") == "isr") | (F.col("to_kind") == "isr"), "async").when(tasks, task_order).when((F.col("from_kind") == "main") | (F.col("to_kind") == "main"), "main").otherwise("unknown-order")
    return got.select("from_unit", "to_unit", order.alias("order"), "resource_count", "writes", "reads")


def effective_contexts(units: DataFrame, hops: int = 4) -> DataFrame:
    """(unit, context, context_kind): callbacks and timers with one host run in its context, followed so many times; units is (unit, unit_kind, host; null unless there is just one)."""
    got = units.select("unit", F.col("unit").alias("context"), F.col("unit_kind").alias("context_kind"))
    step = units.select(F.col("unit").alias("context"), F.col("host"), F.col("unit_kind").alias("own"))
    kinds = units.select(F.col("unit").alias("host"), F.col("unit_kind").alias("host_kind"))
    for _ in range(hops):
        got = got.join(step, "context", "left").join(kinds, "host", "left")
        up = F.col("own").isin("callback", "timer") & F.col("host").isNotNull()
        got = got.select("unit", F.when(up, F.col("host")).otherwise(F.col("context")).alias("context"), F.when(up, F.coalesce("host_kind", F.split_part("host", F.lit(":"), F.lit(1)))).otherwise(F.col("context_kind")).alias("context_kind"))
    return got


def run_modes(units: DataFrame, loops: DataFrame, tick_ms: float = 1.0) -> DataFrame:
    """(unit, mode, confidence, period_ms) from the infinite loops that a unit's function holds or reaches.

    units: unit, function, analysed; loops: function, loop_id, infinite, blocking array<struct<kind, value, unit>>.
    event-driven if a loop waits, periodic if it only delays, busy-poll if it blocks nowhere, one-shot without an infinite
    loop. The period is the one literal delay; several different ones, or one that is not literal, give none.
    """
    inf = loops.where("infinite")
    first = first_by(inf, ["function"], F.col("loop_id"))
    got = units.join(first.select("function", "blocking"), "function", "left")
    has = F.col("blocking").isNotNull()
    kinds = F.transform("blocking", lambda b: b["kind"])
    delays = F.filter("blocking", lambda b: b["kind"] == "delay")
    factor = lambda b: F.when(b["unit"] == "tick", F.lit(tick_ms)).when(b["unit"] == "us", F.lit(0.001)).when(b["unit"] == "s", F.lit(1000.0)).otherwise(F.lit(1.0))
    values = F.array_distinct(F.transform(delays, lambda b: b["value"] * factor(b)))
    mode = F.when(~F.col("analysed"), "unknown").when(~has, "one-shot").when(F.array_contains(kinds, "wait"), "event-driven").when(F.array_contains(kinds, "delay"), "periodic").otherwise("busy-poll")
    confidence = F.when(~F.col("analysed"), "low").when(has & (F.size("blocking") > 0), "high").otherwise("medium")
    period = F.when((mode == "periodic") & (F.size(values) == 1) & ~F.exists(delays, lambda b: b["value"].isNull()), F.element_at(values, 1))
    return got.select("unit", mode.alias("mode"), confidence.alias("confidence"), period.alias("period_ms"))


def glyph_rows(accesses: DataFrame) -> DataFrame:
    """Matrix cells (resource, unit, glyph): w, r, rw or addr, of resources with two units, one of them an interrupt."""
    kept = shared_resources(accesses).where("units > 1 and isr_units > 0").select("resource")
    k = accesses.join(kept, "resource", "left_semi").groupBy("resource", "unit").agg(F.bool_or(F.col("kind").isin(*WRITES)).alias("w"), F.bool_or(F.col("kind").isin(*READS)).alias("r"))
    return k.select("resource", "unit", F.when(F.col("w") & F.col("r"), "rw").when(F.col("w"), "w").when(F.col("r"), "r").otherwise("addr").alias("glyph"))


def matrix_rows(accesses: DataFrame, wakes: DataFrame) -> DataFrame:
    """(resource, units, confidence, wake, rank): the rows of the matrix in order: high conflicts first, then medium, low and none, those
    without a wake relation (resource) before those with one, then more units, then by name.

    The rank counts rows in ranges of (confidence, wake) and ranks within each, so that no task sorts all of them.
    """
    rows = shared_resources(accesses).where("units > 1 and isr_units > 0").select("resource", "units")
    level = F.element_at(F.create_map(F.lit("high"), F.lit(3), F.lit("medium"), F.lit(2), F.lit("low"), F.lit(1)), F.col("confidence"))
    worst = conflicts(accesses).groupBy("resource").agg(F.max_by("confidence", level).alias("confidence"))
    got = rows.join(worst, "resource", "left").join(wakes.select("resource").distinct().withColumn("wake", F.lit(True)), "resource", "left").withColumn("wake", F.coalesce("wake", F.lit(False)))
    got = got.withColumn("band", (3 - F.coalesce(level, F.lit(0))) * 2 + F.col("wake").cast("int"))
    # Eight bands and the numbers of units that there are: few counts, which place all rows with so many units of a band.
    size = got.groupBy("band", "units").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("band", F.desc("units")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = got.join(F.broadcast(size.withColumn("before", before).drop("n")), ["band", "units"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("band", "units").orderBy("resource"))
    return placed.select("resource", "units", "confidence", "wake", rank.cast("bigint").alias("rank"))


def main_phases(accesses: DataFrame, main_unit: str, loops: DataFrame, reached: DataFrame) -> DataFrame:
    """The accesses with phase: run, or init for what the main unit does outside its endless loop.

    loops: function, line, end_line, body_calls (array of functions) of the main function's loop, a row or none; reached: root,
    node of what each function reaches, itself included. Inside are the lines of the loop and all that its calls reach.
    Without a loop all of main is initialisation.
    """
    inside = loops.select(F.explode("body_calls").alias("root")).join(reached, "root").select(F.col("node").alias("function")).distinct().withColumn("_in", F.lit(True))
    span = loops.select("function", F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    got = accesses.join(inside, "function", "left").join(F.broadcast(span), "function", "left")
    # Of the main function itself the lines decide, even if its loop calls it.
    in_loop = F.when(F.col("_a").isNotNull(), F.col("line").between(F.col("_a"), F.col("_b"))).otherwise(F.coalesce("_in", F.lit(False)))
    return got.withColumn("phase", F.when((F.col("unit") != main_unit) | in_loop, "run").otherwise("init")).drop("_in", "_a", "_b")


def run_map(accesses: DataFrame) -> DataFrame:
    """Per resource: owner (the writer with most writes, then the least), writers, flow, protection mismatch."""
    write, read = F.col("kind").isin(*WRITES), F.col("kind").isin(*READS)
    per = accesses.groupBy("resource", "unit", "unit_kind").agg(F.count_if(write).alias("w"), F.count_if(read).alias("r"), F.count_if(F.col("protected")).alias("p"), F.count_if(~F.col("protected")).alias("f"))
    isr = F.col("unit_kind") == "isr"
    agg = per.groupBy("resource").agg(
        F.min_by("unit", F.struct(-F.col("w"), F.col("unit"))).alias("owner"), F.count_if(F.col("w") > 0).alias("writers"), F.bool_or(isr & (F.col("w") > 0)).alias("iw"), F.bool_or(isr & (F.col("r") > 0)).alias("ir"),
        F.bool_or(~isr & (F.col("w") > 0)).alias("tw"), F.bool_or(~isr & (F.col("r") > 0)).alias("tr"), F.sum("p").alias("p"), F.sum("f").alias("f"), F.count("unit").alias("units"),
    )
    flow = F.when((F.col("iw") & F.col("tw")) | (F.col("iw") & F.col("ir") & F.col("tr")), "mixed").when(F.col("iw") & F.col("tr"), "isr->thread").when(F.col("tw") & F.col("ir"), "thread->isr").otherwise("one-side")
    return agg.where("units > 1").select("resource", "owner", "writers", flow.alias("flow"), (F.col("writers") > 1).alias("multi_writer"), ((F.col("p") > 0) & (F.col("f") > 0)).alias("protection_mismatch"))


def _sides(accesses: DataFrame) -> DataFrame:
    """Per resource and unit: whether it writes and reads, and does so without protection."""
    write, read, free = F.col("kind").isin(*WRITES), F.col("kind").isin(*READS), ~F.col("protected")
    return accesses.groupBy("resource", "unit", "unit_kind").agg(F.bool_or(write).alias("w"), F.bool_or(read).alias("r"), F.bool_or(write & free).alias("bw"), F.bool_or(read & free).alias("br"), F.bool_or(free).alias("open"))


def run_variables(accesses: DataFrame, atomicity: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per shared resource: owner (the one group that writes), writer_groups, flow, cross, pollution, mismatch and non_atomic.

    A callback with one host (unit, host) writes for its host. pollution: interrupts and threads both write; mismatch: across
    contexts, one side is protected throughout and the other is not; non_atomic: across contexts, a composite or wide type
    (resource, atomicity) that some unit uses without protection.
    """
    side = _sides(accesses).join(hosts, "unit", "left")
    isr = F.col("unit_kind") == "isr"
    got = side.groupBy("resource").agg(
        F.count("unit").alias("units"), F.collect_set(F.when(F.col("w"), F.coalesce("host", "unit"))).alias("groups"), F.bool_or(isr & F.col("w")).alias("iw"), F.bool_or(~isr & F.col("w")).alias("tw"), F.bool_or(isr & F.col("r")).alias("ir"), F.bool_or(~isr & F.col("r")).alias("tr"),
        F.bool_or(isr).alias("i"), F.bool_or(~isr).alias("t"), F.bool_or("w").alias("any_w"), F.bool_or("r").alias("any_r"), F.bool_or("bw").alias("bw"), F.bool_or("br").alias("br"), F.bool_or("open").alias("open"),
    ).where("units > 1")
    cross = F.col("i") & F.col("t")
    flow = F.when(F.col("iw") & F.col("tw"), "mixed").when(F.col("iw") & F.col("tr"), "isr->thread").when(F.col("iw"), "isr<->isr").when(F.col("ir"), "thread->isr").otherwise("thread<->thread")
    mismatch = cross & ((F.col("any_w") & ~F.col("bw") & F.col("br")) | (F.col("any_r") & ~F.col("br") & F.col("bw")))
    owner = F.when(F.size("groups") == 1, F.element_at("groups", 1)).when(F.size("groups") == 0, "none")
    loose = cross & F.col("open") & F.col("atomicity").isin("composite", "wide")
    return got.join(atomicity, "resource", "left").select("resource", owner.alias("owner"), F.size("groups").alias("writer_groups"), flow.alias("flow"), cross.alias("cross"), (F.col("iw") & F.col("tw")).alias("pollution"), mismatch.alias("mismatch"), F.coalesce(loose, F.lit(False)).alias("non_atomic"))


def worst_of_units(accesses: DataFrame, variables: DataFrame, conflicts_of: DataFrame) -> DataFrame:
    """(unit, worst): conflict, pollution (a thread that writes what interrupts write too), mismatch or shared, over the resources of run_variables()."""
    known = variables.select("resource", "pollution", "mismatch").join(conflicts_of.select("resource", F.lit(1).alias("c")).distinct(), "resource", "left")
    mine = _sides(accesses).join(known, "resource")
    rank = F.when(F.col("c").isNotNull(), 3).when(F.col("pollution") & F.col("w") & (F.col("unit_kind") != "isr"), 2).when(F.col("mismatch"), 1).otherwise(0)
    return mine.groupBy("unit").agg(F.max(rank).alias("r")).select("unit", F.element_at(F.array(*[F.lit(x) for x in ("shared", "mismatch", "pollution", "conflict")]), F.col("r") + 1).alias("worst"))


def dependency_resources(accesses: DataFrame) -> DataFrame:
    """(from_unit, to_unit, resources): the resources, by name, that one unit writes and another reads."""
    side = _cut(_sides(accesses).groupBy("resource", "unit").agg(F.bool_or("w").alias("w"), F.bool_or("r").alias("r")))
    pairs = met_pairs(side.where("w"), side.where("r"), ["unit"], [], listed=True)
    return pairs.where("a_unit <> b_unit").select(F.col("a_unit").alias("from_unit"), F.col("b_unit").alias("to_unit"), "resources")


def step_variables(steps: DataFrame, accesses: DataFrame, conflicts_of: DataFrame, wakes: DataFrame) -> DataFrame:
    """(step, resource, kinds, in_critical, conflict, wake, isr_writers): what the step's function touches. in_critical if all sites are.

    steps: step, function; accesses as above; conflicts_of and wakes: resource.
    """
    # Steps of the same functions touch the same, so that is told once for each set of functions and then dealt to its steps.
    of = steps.groupBy("step").agg(F.array_sort(F.collect_set("function")).alias("of"))
    sites = accesses.select("function", "resource", "kind", "protected").distinct()
    got = of.select("of").distinct().select("of", F.explode("of").alias("function")).join(sites, "function").groupBy("of", "resource").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.bool_and("protected").alias("in_critical"))
    isr = accesses.where((F.col("unit_kind") == "isr") & (F.col("kind") != "read")).groupBy("resource").agg(F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("isr_writers"))
    flag = lambda df, name: df.select("resource", F.lit(True).alias(name)).distinct()
    got = got.join(flag(conflicts_of, "conflict"), "resource", "left").join(flag(wakes, "wake"), "resource", "left").join(isr, "resource", "left")
    return of.join(got, "of").select("step", "resource", "kinds", "in_critical", F.coalesce("conflict", F.lit(False)).alias("conflict"), F.coalesce("wake", F.lit(False)).alias("wake"), F.coalesce("isr_writers", F.lit("")).alias("isr_writers"))
