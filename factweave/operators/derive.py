"""Derivations between raw facts and views: entries, indirection, boot, rounds, image facts and small filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalars as S
from ..functions.conditions import condition_atoms
from . import graph as G
from .joins import first_by, in_spans


def live(edges: DataFrame) -> DataFrame:
    """Edges that no branch pruning has marked dead."""
    return edges.where("dead_branch is null")


def without_callback_pairs(dependencies: DataFrame) -> DataFrame:
    return dependencies.where("not (from_kind = 'callback' and to_kind = 'callback')")


def idle_exceptions(vectors: DataFrame, edges: DataFrame, accesses: DataFrame) -> DataFrame:
    """Kernel exceptions (vector < 0) whose handler neither calls nor touches anything."""
    return vectors.where("vector < 0").join(edges.select(F.col("source").alias("handler")).distinct(), "handler", "left_anti").join(accesses.select(F.col("function").alias("handler")).distinct(), "handler", "left_anti")


def entries(functions: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, symbol_id): main and reset entries; rule entries (function, superloop) only if there is no main and the name is
    defined once, superloops first in order."""
    plain = functions.select("symbol_id", F.when(F.col("name").isin("main", "app_main"), "main").when(F.col("name") == "Reset_Handler", "reset").alias("kind")).where("kind is not null")
    has_main = plain.where("kind = 'main'").agg((F.count("kind") > 0).alias("has_main"))
    once = functions.groupBy("name").agg(F.count("name").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1")
    ruled = rules.join(once, F.col("function") == F.col("name")).join(F.broadcast(has_main)).where("not has_main")
    return plain.select("kind", "symbol_id", F.lit(False).alias("superloop")).unionByName(ruled.select(F.lit("main").alias("kind"), "symbol_id", "superloop"))


def dispatch_edges(hosts: DataFrame) -> DataFrame:
    """May-call edges from the functions that dispatch a callback slot (dispatcher, callback) to the callback, each once, none to itself."""
    return hosts.where("dispatcher <> callback").select(F.col("dispatcher").alias("source"), F.col("callback").alias("target"), F.lit("dispatches").alias("relation")).distinct()


def nearest_blocking(calls: DataFrame, blocking: DataFrame, hops: int = 3) -> DataFrame:
    """(function, callee, kind, hops): the nearest blocking call a function reaches in so many calls: fewest hops, waits before delays, then line and name.

    blocking: function, callee, kind, line.
    """
    roots = calls.select(F.explode(F.array("source", "target")).alias("root")).union(blocking.select("function")).distinct().withColumn("node", F.col("root"))
    near = G.reach_within(calls, roots, hops)
    hit = near.join(blocking, near["node"] == blocking["function"]).select(F.col("root").alias("function"), "callee", "kind", "hops", "line")
    return first_by(hit, ["function"], F.col("hops"), F.col("kind") != "wait", F.col("line"), F.col("callee")).drop("line")


def infinite_in_callees(calls: DataFrame, loops: DataFrame, hops: int = 3) -> DataFrame:
    """(function, hops): functions that reach an infinite loop in a callee within so many calls."""
    roots = calls.select(F.col("source").alias("root")).distinct().withColumn("node", F.col("root"))
    near = G.reach_within(calls, roots, hops).where("hops > 0")
    return near.join(loops.where("infinite").select(F.col("function").alias("node")).distinct(), "node", "left_semi").groupBy(F.col("root").alias("function")).agg(F.min("hops").alias("hops"))


def indirect_bindings(assigns: DataFrame, tables: DataFrame, arguments: DataFrame, layout: DataFrame) -> DataFrame:
    """(callback, struct_type, field, form) of four forms of registration.

    assigns: callback, struct_type (null: a plain pointer), field; tables: callback, struct_type, index (initialiser rows,
    named through layout: struct_type, index, field); arguments: callback, callee_stores (struct_type and field that the callee
    stores its parameter in; null if none).
    """
    one = assigns.select("callback", "struct_type", "field", F.when(F.col("struct_type").isNull(), "pointer-assign").otherwise("struct-field-assign").alias("form"))
    two = tables.join(layout, ["struct_type", "index"]).select("callback", "struct_type", "field", F.lit("init-table").alias("form"))
    three = arguments.where("callee_stores is not null").select("callback", "callee_stores.struct_type", "callee_stores.field", F.lit("param-store").alias("form"))
    return one.unionByName(two).unionByName(three).distinct()


def callback_details(bindings: DataFrame) -> DataFrame:
    """(callback, form, fields): one row for each callback; param-store is the primary form if there is one, then the least name."""
    rank = F.when(F.col("form") == "param-store", 0).otherwise(1)
    return bindings.groupBy("callback").agg(F.min_by("form", F.struct(rank, F.col("form"))).alias("form"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def enabled_interrupts(sites: DataFrame, traced: DataFrame) -> DataFrame:
    """(site, irq, basis): the argument itself, or constants that callers give the parameter; without any, unresolved.

    sites: site, function, argument, is_parameter; traced: function, parameter, constant.
    """
    got = sites.join(traced.select("function", F.col("parameter").alias("argument"), "constant"), ["function", "argument"], "left")
    return got.select("site", F.when(~F.col("is_parameter"), F.col("argument")).otherwise(F.col("constant")).alias("irq"), F.when(~F.col("is_parameter"), "literal").when(F.col("constant").isNotNull(), "parameter").otherwise("unresolved").alias("basis")).distinct()


def inherit_modes(modes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Run modes where a one-shot callback with a single host takes its host's mode and period: (unit, mode, period_ms, inherited)."""
    up = modes.select(F.col("unit").alias("host"), F.col("mode").alias("host_mode"), F.col("period_ms").alias("host_period"))
    got = modes.join(hosts.select("unit", "host"), "unit", "left").join(up, "host", "left")
    take = (F.col("mode") == "one-shot") & F.col("host_mode").isNotNull()
    return got.select("unit", F.when(take, F.col("host_mode")).otherwise(F.col("mode")).alias("mode"), F.when(take, F.col("host_period")).otherwise(F.col("period_ms")).alias("period_ms"), take.alias("inherited"))


def image_totals(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count("object").alias("objects"), F.sum(F.expr("code + ro + rw")).cast("bigint").alias("rom"), F.sum(F.expr("rw + zi")).cast("bigint").alias("ram"))


def staleness(image: DataFrame, sources: DataFrame) -> DataFrame:
    """(newer, missing, unlinked): sources newer than the image, objects without a source, sources without an object.

    image: source_path, mtime (of the artifact); sources: path, mtime.
    """
    both = image.where("source_path is not null").select(F.col("source_path").alias("path"), F.col("mtime").alias("built")).distinct()
    newer = both.join(sources, "path").agg(F.count_if(F.col("mtime") > F.col("built")).alias("newer"))
    missing = image.agg(F.count_if(F.col("source_path").isNull()).alias("missing"))
    free = sources.join(both, "path", "left_anti").agg(F.count("path").alias("unlinked"))
    return newer.join(F.broadcast(missing)).join(F.broadcast(free))


def boot_tree(calls: DataFrame, installs: DataFrame, root: str, depth: int = 8) -> DataFrame:
    """(node, hops): functions that main reaches in so many calls and from which something is installed, itself or below."""
    start = calls.sparkSession.createDataFrame([(root, root)], "root string, node string")
    # A few calls deep, so large graphs of names are joined and not packed; from which goal a function is seen doesn't matter.
    down = G.reach(calls, start, depth, small=G.SMALL_GRAPH).select("node", "hops")
    goals = installs.select(F.lit(0).alias("root"), F.col("function").alias("node")).distinct()
    up = G.reach(calls.select(F.col("target").alias("source"), F.col("source").alias("target")), goals, depth, small=G.SMALL_GRAPH)
    return down.join(up.select("node").distinct(), "node", "left_semi")


def tree_children(calls: DataFrame, registrations: DataFrame, node: str | None = None) -> DataFrame:
    """(node, child, hop, line) of functions (or of one): calls, then what they register (an inferred schedule hop), each once at its first line."""
    a = calls.select(F.col("source").alias("node"), F.col("target").alias("child"), F.lit("call").alias("hop"), "line")
    b = registrations.select(F.col("function").alias("node"), F.col("target").alias("child"), F.lit("schedule").alias("hop"), "line")
    both = a.unionByName(b)
    return (both if node is None else both.where(F.col("node") == node)).groupBy("node", "child", "hop").agg(F.min("line").alias("line"))


def call_pairs(edges: DataFrame) -> DataFrame:
    """Calls and dispatches once for each (source, target, line), dispatches flagged."""
    return edges.where("relation in ('calls', 'dispatches')").groupBy("source", "target", "line").agg(F.bool_and(F.col("relation") == "dispatches").alias("dispatched"))


def exports(calls: DataFrame) -> DataFrame:
    """Functions (path, name) that other files call: calls is (source_path, target_path, target)."""
    return calls.where("source_path <> target_path").select(F.col("target_path").alias("path"), F.col("target").alias("name")).distinct()


def edge_detail(edges: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Edges of all measures between two sets of files, by measure: (measure, edges, lines; the first six)."""
    hit = edges.where(F.col("source").isin(*a) & F.col("target").isin(*b))
    w = Window.partitionBy("measure").orderBy("line", "source", "target")
    return hit.withColumn("r", F.row_number().over(w)).groupBy("measure").agg(F.count("r").alias("edges"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 6, F.col("line")))).cast("array<string>"), ",").alias("lines"))


def extern_declarations(declarations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Declarations (path, line, name) without a definition (path, name) in their file, the first for each name and file, bound by
    name to a single definition elsewhere; via_header tells declarations in headers."""
    free = declarations.join(definitions.select("path", "name").distinct(), ["path", "name"], "left_anti")
    first = free.groupBy("path", "name").agg(F.min("line").alias("line"))
    one = definitions.groupBy("name").agg(F.when(F.count_distinct("path") == 1, F.min("path")).alias("defined_in"))
    return first.join(one, "name", "left").select("path", "name", "line", "defined_in", F.col("path").rlike(r"\.h(h|pp|xx)?$").alias("via_header"))


def name_enums(enums: DataFrame, aliases: DataFrame) -> DataFrame:
    """Anonymous enums (file, end_line, name null) take the alias (file, line, alias) on their last line, or on the line before."""
    got = enums.join(aliases, "file").where("name is null and (line = end_line or line = end_line - 1)")
    best = first_by(got, ["file", "end_line"], F.desc("line"), F.col("alias")).select("file", "end_line", "alias")
    return enums.join(best, ["file", "end_line"], "left").select("file", "end_line", F.coalesce("name", "alias").alias("name"))


def task_priorities(tasks: DataFrame, initialisers: DataFrame) -> DataFrame:
    """(unit, text, basis): the priority argument, else the attribute field's initialiser: of the same file, else the only one.

    tasks: unit, path, argument, attribute; initialisers: attribute, path, text.
    """
    own = initialisers.select("attribute", "path", F.col("text").alias("own"))
    only = initialisers.groupBy("attribute").agg(F.when(F.count("text") == 1, F.min("text")).alias("only"))
    got = tasks.join(own, ["attribute", "path"], "left").join(only, "attribute", "left")
    text = F.coalesce("argument", "own", "only")
    return got.select("unit", text.alias("text"), F.when(F.col("argument").isNotNull(), "argument").when(text.isNotNull(), "attr-initializer").otherwise("unresolved").alias("basis"))


def machine_owners(machines: DataFrame, reached: DataFrame) -> DataFrame:
    """(machine, owners) of units that reach a machine's function."""
    return machines.join(reached, "function").groupBy("machine").agg(F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("owners"))


def machine_coupling(conditions: DataFrame, functions: DataFrame, homes: DataFrame) -> DataFrame:
    """(machine, other): a condition calls a function of a file that holds another machine. homes: machine, path."""
    called = conditions.select("machine", F.explode(F.regexp_extract_all("condition", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("name")).distinct()
    # What repeats goes before each join: names called, then files led to.
    files = called.join(functions.select("name", "path").distinct(), "name").select("machine", "path").distinct()
    return files.join(homes.select(F.col("machine").alias("other"), "path").distinct(), "path").where("machine <> other").select("machine", "other").distinct()


def machine_transitions(labels: DataFrame, writes: DataFrame, helpers: DataFrame) -> DataFrame:
    """(machine, source, target, via) of a switch: state writes inside a case, writes in helpers that a case calls, and writes outside.

    labels: machine, function, state, line, end_line; writes: function, line, target; helpers: function, line, callee.
    """
    inside = in_spans(writes.withColumnRenamed("line", "at"), labels, ["function"], "at", "line", "end_line")
    one = inside.select("machine", F.col("state").alias("source"), "target", F.lit("assignment").alias("via"))
    called = in_spans(helpers.withColumnRenamed("line", "at"), labels, ["function"], "at", "line", "end_line").select("machine", "state", "callee").distinct()
    two = called.join(writes.select(F.col("function").alias("callee"), "target").distinct(), "callee").select("machine", F.col("state").alias("source"), "target", F.concat(F.lit("call:"), "callee").alias("via"))
    span = labels.groupBy("machine", "function").agg(F.min("line").alias("lo"), F.max("end_line").alias("hi"))
    three = span.join(writes, "function").where("line < lo or line > hi").select("machine", F.lit(None).cast("string").alias("source"), "target", F.lit("outside-switch").alias("via"))
    return one.unionByName(two).unionByName(three).distinct()


def round_ranges(units: DataFrame, loops: DataFrame) -> DataFrame:
    """(unit, from_line, to_line, kind): a superloop's body, else the outermost infinite loop, else the function's body."""
    outer = first_by(loops.where("infinite"), ["function"], F.col("depth"), F.col("line"))
    got = units.join(outer.select("function", F.col("line").alias("a"), F.col("end_line").alias("b")), "function", "left")
    use = ~F.col("superloop") & F.col("a").isNotNull()
    return got.select("unit", F.when(use, F.col("a")).otherwise(F.col("line")).alias("from_line"), F.when(use, F.col("b")).otherwise(F.col("end_line")).alias("to_line"), F.when(F.col("superloop"), "superloop").when(use, "loop").otherwise("body").alias("kind"))


def round_columns(range_: DataFrame, loops: DataFrame, calls: DataFrame) -> DataFrame:
    """(unit, item, line, depth) inside each unit's round, in line order: loops with their nesting and the calls between them.

    range_: unit, function, from_line, to_line; loops: function, line, end_line, depth; calls: function, callee, line.
    """
    a = range_.join(loops, "function").where("line >= from_line and end_line <= to_line").select("unit", F.lit("loop").alias("item"), "line", F.col("depth").cast("int").alias("depth"))
    inner = calls.withColumnRenamed("line", "at")
    held = in_spans(inner.select("function", "at").distinct(), loops.select("function", F.col("line").alias("ll"), F.col("end_line").alias("le"), "depth"), ["function"], "at", "ll", "le").groupBy("function", "at").agg((F.max("depth") + 1).alias("depth"))
    b = in_spans(inner, range_.select("unit", "function", "from_line", "to_line"), ["function"], "at", "from_line", "to_line").join(held, ["function", "at"], "left")
    b = b.select("unit", F.concat(F.lit("call:"), "callee").alias("item"), F.col("at").alias("line"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth")).distinct()
    return a.unionByName(b)


def state_orders(transitions: DataFrame, labels: DataFrame, helpers: DataFrame | None = None) -> DataFrame:
    """(machine, state, place, terminal, via_helper, layer) of each state of machines with transitions (machine, source, target,
    line) and case labels (machine, state, line).

    States come depth first along the transitions, from those that nothing leads to, in the order of their labels; then those
    that nothing labelled follows; then targets without label. helpers (machine, state) are states whose case calls a function
    that sets the state variable. A state without transition is terminal, or leaves via its helper if it has one. layer is the
    longest way from states placed before; terminal states are one below all others.

    Machines are dealt by name and come to a task in order; it holds one machine, which has few states, at a time.
    """
    none = F.lit(None).cast("string")
    both = labels.select("machine", "state", none.alias("target"), "line", F.lit("label").alias("what")).unionByName(transitions.select("machine", F.col("source").alias("state"), "target", "line", F.lit("step").alias("what")))
    if helpers is not None:
        both = both.unionByName(helpers.select("machine", "state", none.alias("target"), F.lit(0).cast(dict(both.dtypes)["line"]).alias("line"), F.lit("helper").alias("what")))

    schema = T._parse_datatype_string(f"machine {dict(both.dtypes)['machine']}, state string, place int, terminal boolean, via_helper boolean, layer int")
    arrow = to_arrow_schema(schema)

    def ordered(machine, named: list[str], steps: list[tuple[str, str]], helped: set[str]) -> Iterator[tuple]:
        order = order_of_states(named, steps)
        known = set(order)
        still = known - {a for a, b in steps if b in known}
        layer = layers_of_states(order, still - helped, known - set(named), steps)
        for i, n in enumerate(order):
            yield machine, n, i, n in still and n not in helped, n in still and n in helped, layer[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Machines as they come, one after the other; a machine may go on in the next batch."""
        at, named, steps, helped, out = [], {}, {}, set(), []
        for batch in batches:
            for machine, state, target, what in zip(*(c.to_pylist() for c in batch.columns)):
                if at != [machine]:
                    if at:
                        out += ordered(*at, list(named), list(steps), helped)
                    at, named, steps, helped = [machine], {}, {}, set()
                if what == "label":
                    named[state] = None
                elif what == "step":
                    steps[state, target] = None
                else:
                    helped.add(state)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)] if out else [pa.array([], t.type) for t in arrow], schema=arrow)
            out = []
        if at:
            out = list(ordered(*at, list(named), list(steps), helped))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    dealt = both.repartition("machine").sortWithinPartitions("machine", "line", "state", "target")
    return dealt.select("machine", "state", "target", "what").mapInArrow(run, schema)


def order_of_states(named: list[str], steps: list[tuple[str, str]]) -> list[str]:
    """Three zones: what is walked through, in the order of the walk; labels that lead to no other label; targets without label."""
    after: dict[str, list[str]] = {n: [] for n in named}
    for a, b in steps:
        if a != b and a in after and b in after:
            after[a].append(b)
    entered = {b for bs in after.values() for b in bs}
    zone = {n: (1, i) for i, n in enumerate(named) if not after[n]}
    todo = [n for n in [*(n for n in named if n not in entered), *named] if after[n]][::-1]
    while todo:
        n = todo.pop()
        if n not in zone:
            zone[n] = (0, len(zone))
            todo.extend(reversed(after[n]))
    for i, (a, b) in enumerate(steps):
        if a in after:
            zone.setdefault(b, (2, i))
    return sorted(zone, key=zone.__getitem__)


def layers_of_states(order: list[str], ends: set[str], unlabelled: set[str], steps: list[tuple[str, str]]) -> list[int]:
    """The layer at each place: one below the lowest earlier place that leads there, or that stands just before if none does.

    Unlabelled states that nothing earlier leads to are in the first layer. Ends weigh nothing for others and go below all.
    """
    place = {n: i for i, n in enumerate(order)}
    above: list[set[int]] = [set() for _ in order]
    for a, b in steps:
        if a in place and b in place and place[a] < place[b]:
            above[place[b]].add(place[a])
    layer: list[int] = []
    for i, n in enumerate(order):
        held_by = above[i] or ({i - 1} if i and n not in unlabelled else set())
        layer.append(0 if n in ends else max((layer[j] + 1 for j in held_by), default=0))
    bottom = max((x for x, n in zip(layer, order) if n not in ends), default=0) + 1
    return [bottom if n in ends else x for x, n in zip(layer, order)]


def machine_nesting(machines: DataFrame, cases: DataFrame, calls: DataFrame, hops: int = 3) -> DataFrame:
    """(machine, parent, state, via, hops): the machine in one of whose cases a call leads to this machine's functions in the fewest hops.

    machines: machine, function; cases: machine, function, state, line, end_line; calls: source, target, line. Machines that share
    a function don't nest. Ties: the least parent, then the earliest case and call.
    """
    sites = in_spans(calls.select(F.col("source").alias("function"), F.col("target").alias("via"), F.col("line").alias("at")), cases, ["function"], "at", "line", "end_line")
    roots = sites.select(F.col("via").alias("root")).distinct().withColumn("node", F.col("root"))
    near = G.reach_within(calls, roots, hops).select(F.col("root").alias("via"), F.col("node").alias("function"), (F.col("hops") + 1).alias("hops"))
    hit = sites.select(F.col("machine").alias("parent"), "state", "line", "at", "via").join(near, "via").join(machines, "function").where("machine <> parent")
    other = machines.select(F.col("machine").alias("parent"), "function").join(machines, "function").select("machine", "parent").distinct()
    return first_by(hit.join(other, ["machine", "parent"], "left_anti"), ["machine"], F.col("hops"), F.col("parent"), F.col("line"), F.col("at"), F.col("via")).select("machine", "parent", "state", "via", "hops")


def state_panel(transitions: DataFrame, conditions: DataFrame) -> DataFrame:
    """(machine, state, number, target, atom, tag, text): the transitions (machine, source, target, line) of each state in line order, with
    the rows of their condition steps (machine, source, line, nth, text, kind: if | else | guard-<word>).

    if keeps its text, else negates it, a guard is tagged by its word.
    """
    w = Window.partitionBy("machine", "source").orderBy("line", "target")
    numbered = transitions.withColumn("number", F.row_number().over(w))
    got = numbered.join(conditions, ["machine", "source", "line"], "left")
    guard = F.col("kind").startswith("guard-")
    text = F.when(F.col("kind") == "else", S.negation(F.col("text"))).otherwise(F.col("text"))
    return got.select("machine", F.col("source").alias("state"), "number", "target", F.col("nth").alias("atom"), F.when(guard, F.substring("kind", 7, 40)).otherwise(F.col("kind")).alias("tag"), text.alias("text"))


def atom_rows(steps: DataFrame, *key: str) -> DataFrame:
    """(key, nth, tag, text): the atoms of condition steps (key, kind: if | else | guard-<word>, text), one row each.

    A step that must hold gives if rows, one that must not else rows with the opposite text, a guard rows with its word.
    From the second of several alternatives on the tag is or.
    """
    guard, holds = F.col("kind").startswith("guard-"), F.col("kind") == "if"
    split = steps.select(*key, "kind", F.posexplode(condition_atoms(F.col("text"), holds)).alias("nth", "atom"))
    word = F.when(guard, F.substring("kind", 7, 40)).when(holds, "if").otherwise("else")
    text = F.when(guard | holds, F.col("atom.text")).otherwise(S.negation(F.col("atom.text")))
    return split.select(*key, (F.col("nth") + 1).alias("nth"), F.when(F.col("atom.any_of") & (F.col("nth") > 0), "or").otherwise(word).alias("tag"), text.alias("text"))


def condition_steps(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place_id, nth, line, kind, text) of the if and else blocks (function, line, end_line, kind, text) around each place (place_id, function, line), in line order."""
    hit = in_spans(places.select("place_id", "function", F.col("line").alias("at")), blocks, ["function"], "at", "line", "end_line")
    return hit.withColumn("nth", F.row_number().over(Window.partitionBy("place_id").orderBy("line", F.desc("end_line"), "kind"))).select("place_id", "nth", "line", "kind", "text")


def external_symbols(calls: DataFrame, declarations: DataFrame, libraries: DataFrame) -> DataFrame:
    """(name, callers, declared_in, library, candidates) of called names without definition.

    calls: source, name; declarations: name, path, line; libraries: path of library files. Candidates are the libraries
    beside any header that declares the name; the one with the greatest version is picked.
    """
    callers = calls.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("callers"))
    sites = declarations.join(callers.select("name"), "name", "left_semi")
    declared = sites.groupBy("name").agg(F.count_distinct("path", "line").alias("declared_in"))
    beside = sites.select("name", S.directory(F.col("path")).alias("folder")).distinct().join(libraries.select(F.col("path").alias("library"), S.directory(F.col("path")).alias("folder")), "folder")
    file = F.regexp_extract("library", "[^/]*$", 0)
    picked = beside.groupBy("name").agg(F.max_by("library", F.struct(S.natural_key(F.lower(file)), F.col("library"))).alias("library"), F.count_distinct("library").alias("candidates"))
    return callers.join(declared, "name", "left").join(picked, "name", "left").select("name", "callers", F.coalesce("declared_in", F.lit(0)).cast("bigint").alias("declared_in"), "library", F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"))


def view_modules(files: DataFrame, depths: DataFrame, region: str = "") -> DataFrame:
    """(path, module, external, depth, rank) of files: the first two folders within the region, (root), ext:<two parts> outside it, lib:<file> for
    closed libraries. depth is the most of the module's folders (folder, depth); rank counts from the deepest.

    Each folder counts for its own prefixes, so modules meet folders by equality.
    """
    own = F.substring(F.col("path"), len(region) + 1, 4000)
    parts, all_parts = F.split(own, "/"), F.split("path", "/")
    inside = F.col("path").startswith(region)
    lib = F.col("path").startswith("lib:")
    module = F.when(lib, F.concat(F.lit("lib:"), F.regexp_extract("path", "[^/]*$", 0))).when(~inside, F.concat(F.lit("ext:"), F.array_join(F.slice(all_parts, 1, 2), "/"))).otherwise(S.module_of(own))
    root = region.rstrip("/") or "."
    folder = F.when(lib | ~inside, F.regexp_replace(module, "^(ext|lib):", "")).when(F.size(parts) == 1, F.lit(root)).otherwise(F.concat(F.lit(region), module))
    named = files.select("path", F.regexp_replace(module, "^lib:lib:", "lib:").alias("module"), (lib | ~inside).alias("external"), folder.alias("folder"), (F.size(parts) == 1).alias("is_root"))
    up = depths.select("depth", F.explode(F.filter(S.leading(F.col("folder")), lambda x: x != "")).alias("folder")).groupBy("folder").agg(F.max("depth").alias("below"))
    at = depths.groupBy("folder").agg(F.max("depth").alias("own"))
    most = depths.agg(F.max("depth").alias("most"))
    got = named.join(up, "folder", "left").join(at, "folder", "left").join(F.broadcast(most))
    depth = F.when(F.col("is_root") & ~F.col("external"), F.col("own")).otherwise(F.col("below"))
    return got.select("path", "module", "external", depth.alias("depth"), (F.col("most") - depth).alias("rank"))


def tick_of(facts: DataFrame) -> DataFrame:
    """(project, tick_ms): the value found in code, else the declared one."""
    rank = F.when(F.col("basis") == "code", 0).otherwise(1)
    return facts.where("tick_ms is not null").groupBy("project").agg(F.min_by("tick_ms", F.struct(rank, F.col("tick_ms"))).alias("tick_ms"))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with place, their number in the order (key, order): the rows of a key are numbered among themselves, after the count of all rows of lesser keys.

    Counts by key are dealt in ranges of keys; a running sum goes over each range, and one over the ranges, as many as partitions.
    """
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(key)
    size = G._cut(size.withColumn("_range", F.spark_partition_id()))
    lesser = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = size.groupBy("_range").agg(F.sum("n").alias("n")).select("_range", lesser(Window.orderBy("_range")).alias("_start"))
    before = size.withColumn("_before", lesser(Window.partitionBy("_range").orderBy(key))).join(F.broadcast(ranges), "_range").select(key, (F.col("_before") + F.col("_start")).alias("before"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(before, key).withColumn("place", (F.col("place") + F.col("before")).cast("bigint")).drop("before")


def ordered_merge(parts: list[DataFrame]) -> DataFrame:
    """Shards as one table in the order (unit_index, seq), whichever was done first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return numbered(out, "unit_index", "seq")


def theme_overview(themes: dict[str, DataFrame]) -> list[dict]:
    """(theme, available, reason, rows, fields) of each theme; an empty one is available, a missing one is not."""
    out = []
    for name, df in sorted(themes.items()):
        out.append({"theme": name, "available": df is not None, "reason": None if df is not None else "no facts of this kind", "rows": None if df is None else df.count(), "fields": [] if df is None else df.columns})
    return out
