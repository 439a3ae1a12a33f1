"""Aggregations and classifications of code facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graph import _cut
from .joins import first_by
from .pairs import met_pairs

MEASURES = ("includes", "calls", "bypass_calls", "type_only_includes", "types", "macros", "reads", "writes")


def fan(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours on each side, in one pass over both ends of each edge."""
    both = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("out")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(False).alias("out")))).alias("e")).select("e.*").distinct()
    return both.groupBy("node").agg(F.count_if(~F.col("out")).alias("fan_in"), F.count_if(F.col("out")).alias("fan_out"))


def hotspots(edges: DataFrame, most: int = 25) -> DataFrame:
    """The nodes with most neighbours: by total, fan-in, fan-out, then the least node."""
    got = fan(edges).withColumn("total", F.col("fan_in") + F.col("fan_out"))
    return got.orderBy(F.desc("total"), F.desc("fan_in"), F.desc("fan_out"), F.asc("node")).limit(most)


def risk(fan_in: Column, fan_out: Column, global_count: Column, cross: Column, in_cycle: Column, code: Column) -> Column:
    """0 to 100 from coupling, globals, cross-file globals, cycles and size."""
    parts = F.least(F.lit(40), 2 * (fan_in + fan_out)) + F.least(F.lit(20), 2 * global_count) + F.least(F.lit(20), 8 * cross) + F.when(in_cycle, 15).otherwise(0) + F.least(F.lit(5), F.floor(code / 400))
    return F.least(F.lit(100), parts).cast("bigint")


def coverage(on_disk: DataFrame, analysed: DataFrame, root: str) -> DataFrame:
    """(path, state, reason): analysed or excluded with why, of files on disk and files that were compiled."""
    both = on_disk.select("path", F.lit(True).alias("disk")).join(analysed.select("path", F.lit(True).alias("seen")), "path", "full_outer")
    reason = F.when(F.col("disk").isNotNull() & F.col("seen").isNotNull(), F.lit(None).cast("string")).when(~F.col("path").startswith(root), "outside-project-root").when(F.col("disk").isNull(), "missing-on-disk").otherwise("not-in-compile-database")
    return both.select("path", F.when(reason.isNull(), "analysed").otherwise("excluded").alias("state"), reason.alias("reason"))


def rollup_prefixes(files: DataFrame) -> DataFrame:
    """(prefix, on_disk, analysed, excluded) for each directory prefix of (path, analysed), the root included."""
    return files.select(F.explode(S.prefixes(F.col("path"))).alias("prefix"), "analysed").groupBy("prefix").agg(F.count(F.lit(1)).alias("on_disk"), F.count_if("analysed").alias("analysed"), F.count_if(~F.col("analysed")).alias("excluded"))


def coverage_of(files: DataFrame, focus: str) -> DataFrame:
    """(on_disk, analysed, ratio) for a focus glob; the ratio has 4 places, and is null if there is no file."""
    kept = files.where(F.col("path").rlike(S.glob_regex(focus, True)))
    return kept.agg(F.count(F.lit(1)).alias("on_disk"), F.count_if("analysed").alias("analysed")).withColumn("ratio", F.when(F.col("on_disk") > 0, F.bround((F.col("analysed") / F.col("on_disk")).cast("double"), 4)))


def merge_units(paths: DataFrame) -> DataFrame:
    """(unit, files): a source and a header of one directory and stem are one unit; other files are their own."""
    ext = S.suffix(F.col("path"))
    base = paths.select("path", F.concat_ws("/", F.nullif(S.directory(F.col("path")), F.lit(".")), S.stem(F.col("path"))).alias("base"), ext.isin(".c", ".cc", ".cpp", ".cxx").alias("src"), ext.isin(".h", ".hh", ".hpp", ".hxx").alias("hdr"))
    w = Window.partitionBy("base")
    both = F.max("src").over(w) & F.max("hdr").over(w)
    return base.withColumn("unit", F.when(both & (F.col("src") | F.col("hdr")), F.col("base")).otherwise(F.col("path"))).groupBy("unit").agg(F.count("path").alias("files"))


def edge_measures(tagged: DataFrame) -> DataFrame:
    """(source, target, eight measures) from rows (source, target, measure)."""
    return tagged.where("source <> target").groupBy("source", "target").agg(*[F.count_if(F.col("measure") == m).alias(m) for m in MEASURES])


def edge_weight() -> Column:
    """The weight that breaks ties in ordering: six of the eight measures."""
    return sum((F.col(m) for m in ("calls", "types", "macros", "reads", "writes")), F.col("includes"))


def dedup_edges(edges: DataFrame, *key: str) -> DataFrame:
    """One edge for each key, with the sorted union of its locations (line) and their number."""
    return edges.groupBy(*key).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    return first_by(rows, [key], F.desc(seq))


def first_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    return first_by(rows, [key], F.asc(seq))


def use_counts(uses: DataFrame, *key: str) -> DataFrame:
    """Uses for each key with the first location."""
    return uses.groupBy(*key).agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("line", "column")).alias("at")).select(*key, "uses", F.col("at.line").alias("line"), F.col("at.column").alias("column"))


def scheduling(rules: DataFrame) -> DataFrame:
    """(project, scheduling): unknown if no rule says, preemptive if any does, else the one kind."""
    return rules.groupBy("project").agg(F.when(F.bool_or(F.coalesce(F.col("scheduling") == "preemptive", F.lit(False))), "preemptive").otherwise(F.coalesce(F.min("scheduling"), F.lit("unknown"))).alias("scheduling"))


def duplicate_definitions(functions: DataFrame) -> DataFrame:
    return functions.groupBy("name").agg(F.count(F.lit(1)).alias("definitions")).where("definitions > 1")


def memory_by_module(objects: DataFrame, module: str) -> DataFrame:
    """(module, rom, ram) of (code, ro, rw, zi): rom = code + ro + rw, ram = rw + zi."""
    return objects.groupBy(F.col(module).alias("module")).agg(F.sum(F.col("code") + F.col("ro") + F.col("rw")).alias("rom"), F.sum(F.col("rw") + F.col("zi")).alias("ram"))


def interrupt_matrix(reached: DataFrame) -> DataFrame:
    """(isr, other, shared): how many functions an interrupt and another unit both reach; reached is (unit, unit_kind, function)."""
    rows = _cut(reached.select(F.col("function").alias("resource"), "unit", (F.col("unit_kind") == "isr").alias("isr")).distinct())
    pairs = met_pairs(rows.where("isr"), rows.where("not isr"), ["unit"], [])
    return pairs.select(F.col("a_unit").alias("isr"), F.col("b_unit").alias("other"), F.col("n").alias("shared"))


def stability(runs: DataFrame) -> DataFrame:
    """(node, stability) of clusterings (seed, node, cluster): how often its mates of the first seed stay with a node, on average, to
    three places; 1 for a node that is alone there.

    Counts of nodes by cluster of the first seed and cluster of each seed say it all: nodes never meet their mates.
    """
    first = runs.select(F.min("seed").alias("s"), F.count_distinct("seed").alias("seeds"))
    base = runs.join(F.broadcast(first), runs["seed"] == first["s"]).select("node", F.col("cluster").alias("home"), "seeds")
    both = base.join(runs, "node")
    cells = both.groupBy("home", "seed", "cluster").agg((F.count(F.lit(1)) - 1).alias("together"))
    mates = base.groupBy("home").agg((F.count(F.lit(1)) - 1).alias("mates"))
    kept = both.join(cells, ["home", "seed", "cluster"]).groupBy("node", "home", "seeds").agg(F.sum("together").alias("together"))
    share = F.when(F.col("mates") == 0, 1.0).otherwise(F.round(F.col("together") / (F.col("mates") * F.col("seeds")), 3))
    return kept.join(mates, "home").select("node", share.alias("stability"))


def directory_agreement(runs: DataFrame, directories: DataFrame) -> DataFrame:
    """(directory, files, main_cluster, in_main, ratio) of directories (node, directory): the cluster of the first seed that holds most of
    a directory's nodes, the least of equals. Nodes in no cluster count as -1."""
    first = runs.select(F.min("seed").alias("s"))
    base = runs.join(F.broadcast(first), runs["seed"] == first["s"]).select("node", "cluster")
    cells = directories.join(base, "node", "left").groupBy("directory", F.coalesce("cluster", F.lit(-1)).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    got = cells.groupBy("directory").agg(F.sum("n").alias("files"), F.min_by(F.struct("cluster", "n"), F.struct(-F.col("n"), "cluster")).alias("m"))
    return got.select("directory", "files", F.col("m.cluster").alias("main_cluster"), F.col("m.n").alias("in_main"), F.round(F.col("m.n") / F.col("files"), 3).alias("ratio"))


def loop_class(from_macro: Column, infinite: Column, in_main: Column, waits: Column, calls: Column, reads_shared: Column, reads_register: Column, bounded: Column) -> Column:
    """macro, main, inner-infinite, wait, busy-var, busy-hw, iter or busy-poll."""
    return F.when(from_macro, "macro").when(infinite & in_main, "main").when(infinite, "inner-infinite").when(waits, "wait").when(bounded, "iter").when((calls == 0) & reads_shared, "busy-var").when((calls == 0) & reads_register, "busy-hw").when(calls == 0, "busy-poll").otherwise("iter")


def tick_counters(accesses: DataFrame) -> DataFrame:
    """Variables that count time: up to three writes, all read_write and all in interrupts, and a read by a thread-only function.

    accesses: resource, kind, function, unit_kind.
    """
    writes = F.col("kind").isin("write", "read_write")
    isr_functions = accesses.where("unit_kind = 'isr'").select("function").distinct().withColumn("in_isr", F.lit(True))
    a = accesses.join(isr_functions, "function", "left")
    got = a.groupBy("resource").agg(
        F.count_if(writes).alias("writes"), F.count_if(writes & ((F.col("kind") != "read_write") | (F.col("unit_kind") != "isr"))).alias("odd"), F.count_if((F.col("kind") == "read") & F.col("in_isr").isNull()).alias("reads")
    )
    return got.where("writes between 1 and 3 and odd = 0 and reads > 0").select("resource", "writes", "reads")


def machine_confidence(states: DataFrame) -> DataFrame:
    """(machine, states, transitions, confidence) of (machine, state, is_enum, transitions): high if enum states change in the
    switch itself, medium if only some do; machines with fewer than two states or no transition are left out."""
    got = states.groupBy("machine").agg(F.count(F.lit(1)).alias("states"), F.sum("transitions").alias("transitions"), F.bool_and("is_enum").alias("enums"))
    return got.where("states > 1 and transitions > 0").select("machine", "states", "transitions", F.when(F.col("enums"), "high").otherwise("medium").alias("confidence"))


def merge_machines(machines: DataFrame) -> DataFrame:
    """One machine for each dispatch variable: the first with an end line gives it, the best confidence counts.

    machines: dispatch, machine, line, end_line, confidence.
    """
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    got = machines.groupBy("dispatch").agg(F.min_by("machine", F.struct(F.col("end_line").isNull(), F.col("line"), F.col("machine"))).alias("machine"), F.count(F.lit(1)).alias("parts"), F.max(rank).alias("r"))
    return got.select("dispatch", "machine", "parts", F.when(F.col("r") == 3, "high").when(F.col("r") == 2, "medium").otherwise("low").alias("confidence"))


def machine_edges(transitions: DataFrame, orders: DataFrame) -> DataFrame:
    """(machine, source, target, kind, times) of transitions (machine, source, target) between states of orders (machine, state, place,
    terminal): self stays, exit goes to a terminal state, next goes one place on, jump goes farther, back goes back."""
    edges = transitions.groupBy("machine", "source", "target").agg(F.count(F.lit(1)).alias("times"))
    a = orders.select("machine", F.col("state").alias("source"), F.col("place").alias("a"))
    b = orders.select("machine", F.col("state").alias("target"), F.col("place").alias("b"), "terminal")
    step = F.col("b") - F.col("a")
    kind = F.when(step == 0, "self").when(F.col("terminal"), "exit").when(step == 1, "next").when(step > 1, "jump").otherwise("back")
    return edges.join(a, ["machine", "source"]).join(b, ["machine", "target"]).select("machine", "source", "target", kind.alias("kind"), "times")


def machine_statistics(orders: DataFrame, edges: DataFrame) -> DataFrame:
    """(machine, total, next, jump, back, self, exit, verdict) of machines: dispatch without transitions, sequential if at least 60 % of
    them (rounded) go to the next state, mesh if more jump or go back than go on, else mixed."""
    kinds = ("next", "jump", "back", "self", "exit")
    count = edges.groupBy("machine").agg(F.sum("times").alias("total"), *[F.sum(F.when(F.col("kind") == k, F.col("times")).otherwise(0)).alias(k) for k in kinds])
    got = orders.select("machine").distinct().join(count, "machine", "left").fillna(0, ["total", *kinds])
    share = F.floor(F.col("next") * 100 / F.col("total") + 0.5)
    return got.withColumn("verdict", F.when(F.col("total") == 0, "dispatch").when(share >= 60, "sequential").when(F.col("back") + F.col("jump") > F.col("next"), "mesh").otherwise("mixed"))


def beat_segments(steps: DataFrame) -> DataFrame:
    """(unit, segment, steps, bound): steps (unit, place, is_wait, bound) cut at waits; a wait ends its segment."""
    w = Window.partitionBy("unit").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = steps.withColumn("segment", F.coalesce(F.sum(F.col("is_wait").cast("int")).over(w), F.lit(0)).cast("bigint"))
    return cut.groupBy("unit", "segment").agg(F.count(F.lit(1)).alias("steps"), F.sum("bound").alias("bound"))


def module_summary(edges: DataFrame, focus: Column) -> DataFrame:
    """(module, side, edges) of edges (source, target: modules): focus modules and those one edge away."""
    both = edges.where("source <> target").select(F.explode(F.array("source", "target")).alias("module"), "source", "target")
    inside = lambda c: F.coalesce(focus(F.col(c)), F.lit(False))
    kept = both.where(inside("source") | inside("target"))
    return kept.groupBy("module").agg(F.count(F.lit(1)).alias("edges")).select("module", F.when(inside("module"), "focus").otherwise("boundary").alias("side"), "edges")
