"""Join operators of code facts. Interval joins always carry an equality key, so that they hash and then filter."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graph import _cut


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def nearest_definition(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """Binds (use_id, name, path) to one definition (symbol_id, name, def_path): the same file, then the longest shared
    path prefix, the shortest path, the greatest symbol id. In the same file the smallest id wins.

    Definitions are reduced to the best of each name and path prefix first, so that a use meets one row for each of its
    prefixes and never all definitions of a common name.
    """
    own = definitions.groupBy("name", F.col("def_path").alias("path")).agg(F.min("symbol_id").alias("own"))
    best = F.max(F.struct(-F.length("def_path"), F.col("symbol_id").alias("symbol_id"))).alias("b")
    of = definitions.select("name", "symbol_id", "def_path", F.explode(S.leading(F.col("def_path"))).alias("prefix")).groupBy("name", "prefix").agg(best)
    tries = uses.select("use_id", "name", F.posexplode(S.leading(F.col("path"))).alias("shared", "prefix"))
    near = tries.join(of, ["name", "prefix"]).groupBy("use_id").agg(F.max(F.struct("shared", F.col("b.symbol_id").alias("symbol_id"))).alias("m"))
    got = uses.join(own, ["name", "path"], "left").join(near, "use_id")
    same = F.col("own").isNotNull()
    return got.select("use_id", "name", F.coalesce("own", "m.symbol_id").alias("symbol_id"), same.alias("same_file"), F.when(same, F.size(F.split("path", "/"))).otherwise(F.col("m.shared")).alias("shared"))


def in_spans(points: DataFrame, spans: DataFrame, key: list[str], at: str, first: str, last: str) -> DataFrame:
    """Points joined with all spans that hold them, first and last included.

    A span goes to a level by the power of two above its length, where it touches two bins at most; a point looks into one
    bin of each level that its key has. So both sides meet by equality, near each other, and never all of a key.
    """
    level = F.length(F.bin(F.col(last) - F.col(first)))
    dealt = spans.where(F.col(first) <= F.col(last)).withColumn("_level", level)
    dealt = dealt.withColumn("_bin", F.explode(F.array_distinct(F.array(F.expr(f"shiftright(cast(`{first}` as bigint), _level)"), F.expr(f"shiftright(cast(`{last}` as bigint), _level)")))))
    levels = dealt.select(*key, "_level").distinct()
    tries = points.join(levels, key).withColumn("_bin", F.expr(f"shiftright(cast(`{at}` as bigint), _level)"))
    return tries.join(dealt, [*key, "_level", "_bin"]).where(F.col(at).between(F.col(first), F.col(last))).drop("_level", "_bin")


def enclosing(points: DataFrame, spans: DataFrame, *key: str) -> DataFrame:
    """For each point (key, point_id, line) the smallest span (key, span_id, line_from, line_to) that holds it; ties: the earliest start, then id."""
    hit = in_spans(points, spans, list(key), "line", "line_from", "line_to")
    least = F.min(F.struct((F.col("line_to") - F.col("line_from")).alias("size"), "line_from", "span_id")).alias("m")
    return hit.groupBy(*key, "point_id", "line").agg(least).select(*key, "point_id", "line", F.col("m.span_id").alias("span_id"))


def inside(points: DataFrame, spans: DataFrame, *key: str) -> DataFrame:
    """Points (key, point_id, line, column) with start <= (line, column) < stop of spans (key, span_id, begin_line, begin_column, end_line, end_column), each pair once."""
    at = F.struct("line", "column")
    near = in_spans(points, spans, list(key), "line", "begin_line", "end_line")
    return near.where((at >= F.struct(F.col("begin_line"), F.col("begin_column"))) & (at < F.struct(F.col("end_line"), F.col("end_column")))).select(*key, "point_id", "span_id")


def nesting(blocks: DataFrame, *key: str) -> DataFrame:
    """Blocks (key, block_id, line_from, line_to) with parent (nearest enclosing block) and depth (number of enclosing blocks).

    Blocks of a function nest. So of the blocks that start before another those that have not ended enclose it, which two
    running counts tell, and its parent is the last block before it that is one level up.
    """
    order = Window.partitionBy(*key).orderBy("line_from", F.desc("line_to"), "block_id")
    numbered = blocks.withColumn("nth", F.row_number().over(order) - 1)
    starts = numbered.select(*key, "block_id", "nth", F.col("line_from").alias("at"), F.lit(0).alias("ends"))
    stops = numbered.select(*key, F.lit(None).alias("block_id"), F.lit(None).cast("int").alias("nth"), F.col("line_to").alias("at"), F.lit(1).alias("ends"))
    before = Window.partitionBy(*key).orderBy("at", "ends").rowsBetween(Window.unboundedPreceding, -1)
    own = starts.unionByName(stops).withColumn("ended", F.coalesce(F.sum("ends").over(before), F.lit(0))).where("ends = 0").withColumn("depth", F.col("nth") - F.col("ended"))
    offer = own.select(*key, F.col("depth").alias("level"), "nth", F.col("block_id").alias("outer_id"), F.lit(None).alias("block_id"), "depth")
    ask = own.select(*key, (F.col("depth") - 1).alias("level"), "nth", F.lit(None).alias("outer_id"), "block_id", "depth")
    last = Window.partitionBy(*key, "level").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    got = offer.unionByName(ask).withColumn("parent", F.last("outer_id", True).over(last)).where("block_id is not null")
    return got.select(*key, "block_id", "parent", F.col("depth").cast("bigint").alias("depth"))


def hazard_over_yield(accesses: DataFrame, yields: DataFrame, *key: str) -> DataFrame:
    """Variables written before a yield and read after it with no write in between (two-sided as-of join).

    accesses: key, name, kind (read | write), line; yields: key, line. Gives key, name, yield_line, write_line, read_line.
    A read is the first after a yield if the yield lies between it and the read before, and after its last write: running
    maxima give that span for each read, and yields are looked up in it.
    """
    of = [*key, "name"]
    lines = accesses.groupBy(*of, "line").agg(F.bool_or(F.col("kind") == "write").alias("w"), F.bool_or(F.col("kind") == "read").alias("r"))
    past = Window.partitionBy(*of).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"wrote": F.max(F.when(F.col("w"), F.col("line"))).over(past), "seen": F.max(F.when(F.col("r"), F.col("line"))).over(past)})
    # A write on the yield's own line is neither before nor after it; then the one before that counts.
    with_past = lines.withColumn("wrote_before", F.max(F.when(F.col("w"), F.col("wrote"))).over(past))
    spans = with_past.where("r and not w and wrote is not null").select(*of, F.col("line").alias("read_line"), "wrote", "wrote_before", F.greatest("wrote", "seen").alias("low"), (F.col("line") - 1).alias("high"))
    hit = in_spans(yields.select(*key, F.col("line").alias("yield_line")).distinct(), spans, list(key), "yield_line", "low", "high")
    write = F.when(F.col("wrote") < F.col("yield_line"), F.col("wrote")).otherwise(F.col("wrote_before"))
    return hit.select(*of, "yield_line", write.alias("write_line"), "read_line").where("write_line is not null")


def slot_match(stores: DataFrame, calls: DataFrame) -> DataFrame:
    """Callback stores (callback, struct_type, field) to indirect calls (call_id, struct_type, field): by type and field; calls
    that match none so by field alone, flagged weak."""
    strong = calls.join(stores, ["struct_type", "field"]).select("call_id", "callback", F.lit(False).alias("weak_match"))
    rest = calls.join(strong.select("call_id").distinct(), "call_id", "left_anti").select("call_id", "field")
    weak = rest.join(stores.select("callback", "field"), "field").select("call_id", "callback", F.lit(True).alias("weak_match"))
    return strong.unionByName(weak).distinct()


def bind_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Argument i of a call (call_id, callee, args array) to parameter i of the callee (callee, position, parameter)."""
    placed = calls.select("call_id", "callee", F.posexplode("args").alias("position", "argument"))
    return placed.join(parameters, ["callee", "position"]).select("call_id", "callee", "position", "parameter", "argument")


def trace_constants(arguments: DataFrame, hops: int = 2) -> DataFrame:
    """Constants that reach a parameter through up to `hops` callers: arguments is (function, parameter, caller, argument, is_parameter)."""
    found = arguments.where(~F.col("is_parameter")).select("function", "parameter", F.col("argument").alias("constant"), F.lit(0).alias("hops"))
    open_ = arguments.where("is_parameter").select("function", "parameter", F.col("caller").alias("f"), F.col("argument").alias("p"))
    for hop in range(1, hops + 1):
        step = open_.join(arguments.select(F.col("function").alias("f"), F.col("parameter").alias("p"), "caller", "argument", "is_parameter"), ["f", "p"])
        found = found.unionByName(step.where(~F.col("is_parameter")).select("function", "parameter", F.col("argument").alias("constant"), F.lit(hop).alias("hops")))
        open_ = step.where("is_parameter").select("function", "parameter", F.col("caller").alias("f"), F.col("argument").alias("p"))
    return found.groupBy("function", "parameter", "constant").agg(F.min("hops").alias("hops"))


def majority(votes: DataFrame, key: str, choice: str) -> DataFrame:
    """(key, choice, votes, strict): the choice with most votes, null unless it has strictly more than any other."""
    count = votes.groupBy(key, choice).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(key)
    top = count.withColumn("most", F.max("votes").over(w)).where("votes = most")
    return top.groupBy(key).agg(F.when(F.count(choice) == 1, F.min(choice)).alias(choice), F.max("votes").alias("votes"), (F.count(choice) == 1).alias("strict"))


def object_sources(votes: DataFrame, objects: DataFrame, files: DataFrame) -> DataFrame:
    """(object, source_path, match): object files to sources by their functions' majority, else by a unique base name."""
    named = majority(votes, "object", "path").where("strict").select("object", F.col("path").alias("voted"))
    unique = files.groupBy(S.stem(F.col("path")).alias("base")).agg(F.when(F.count("path") == 1, F.min("path")).alias("only"))
    got = objects.join(named, "object", "left").withColumn("base", S.stem(F.col("object"))).join(unique, "base", "left")
    return got.select("object", F.coalesce("voted", "only").alias("source_path"), F.when(F.col("voted").isNotNull(), "functions").when(F.col("only").isNotNull(), "name").otherwise("none").alias("match"))


def longest_pattern(paths: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, module): the module (id, pattern) with the longest matching case-sensitive pattern, then the greatest id."""
    best = F.lit(None).cast("string")
    for module, pattern in sorted(patterns, key=lambda p: (len(p[1]), p[0])):
        best = F.when(F.col("path").rlike(S.glob_regex(pattern, False)), F.lit(module)).otherwise(best)
    return paths.select("path", best.alias("module"))


def match_rules(calls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(callee, rule_id) for rules (id, name pattern): exact names before patterns, then the least id."""
    best = F.lit(None).cast("string")
    for pattern, rule in sorted(((p, r) for r, p in rules), key=lambda x: ("*" in x[0] or "?" in x[0], x[1]), reverse=True):
        best = F.when(F.col("callee").rlike(S.name_regex(pattern)), F.lit(rule)).otherwise(best)
    return calls.withColumn("rule_id", best)


def resolve_names(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """uses (name, …) with definitions (name, path): project if one path defines it, ambiguous if several, else external."""
    one = definitions.groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("p"))
    return uses.join(one, "name", "left").select(*uses.columns, F.when(F.col("n") == 1, "project").when(F.col("n") > 1, "ambiguous").otherwise("external").alias("resolution"), F.when(F.col("n") == 1, F.col("p")).alias("defined_in"))


def variable_symbols(accesses: DataFrame, variables: DataFrame) -> DataFrame:
    """access (access_id, path, name) to a variable (symbol_id, var_path, name, is_static): file-level first, else the first non-static global."""
    own = accesses.join(variables.select("name", F.col("var_path").alias("path"), F.col("symbol_id").alias("own")), ["path", "name"], "left")
    shared = variables.where(~F.col("is_static")).groupBy("name").agg(F.min("symbol_id").alias("shared"))
    return own.join(shared, "name", "left").select("access_id", "name", F.coalesce("own", "shared").alias("symbol_id"))


def call_edges(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(source, target): unresolved callees stay as external:<name>."""
    known = definitions.groupBy("name").agg(F.min("symbol_id").alias("symbol_id"))
    return calls.join(known, "name", "left").select("source", F.coalesce("symbol_id", F.concat(F.lit("external:"), F.col("name"))).alias("target"))


def displaced_locations(edges: DataFrame) -> DataFrame:
    """Calls (source, target, relation, lines array) without the lines where the same pair takes an address; edges without lines go."""
    flat = edges.select("source", "target", "relation", F.explode("lines").alias("line"))
    taken = flat.where("relation = 'address_of'").select("source", "target", "line")
    kept = flat.where("relation = 'calls'").join(taken, ["source", "target", "line"], "left_anti").unionByName(flat.where("relation <> 'calls'"))
    return kept.groupBy("source", "target", "relation").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def text_only(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs found in text that the front end does not have."""
    return found.join(known.select("source", "target").distinct(), ["source", "target"], "left_anti").select("source", "target").distinct()


def bypasses(calls: DataFrame, includes: DataFrame) -> DataFrame:
    """Calls (source, target: files) whose source does not include the target's contract within three hops of includes (source, target)."""
    pairs = calls.where("source <> target").select("source", "target").distinct()
    return pairs.join(reached_pairs(pairs, includes), ["source", "target"], "left_anti")


def reached_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (source, target) with a way of three edges at most, met in the middle: one step from each end, then an edge or nothing between."""
    e = edges.select("source", "target").distinct()
    fore = pairs.join(e.select("source", F.col("target").alias("a")), "source").unionByName(pairs.withColumn("a", F.col("source")))
    back = fore.join(e.select(F.col("source").alias("b"), "target"), "target").unionByName(fore.withColumn("b", F.col("target"))).select("source", "target", "a", "b").distinct()
    linked = back.where("a <> b").join(e.select(F.col("source").alias("a"), F.col("target").alias("b")), ["a", "b"], "left_semi")
    return back.where("a = b").select("source", "target").union(linked.select("source", "target")).distinct()


def type_only_includes(includes: DataFrame, uses: DataFrame) -> DataFrame:
    """Includes without a call or reference between the same files."""
    return includes.join(uses.select("source", "target").distinct(), ["source", "target"], "left_anti").select("source", "target").distinct()


def enum_of_states(states: DataFrame, members: DataFrame) -> DataFrame:
    """(machine, enum, shared): the enum (enum, member, named) with most members among a machine's states; named ones first, then the least."""
    both = states.select("machine", F.col("state").alias("member")).distinct().join(members, "member").groupBy("machine", "enum", "named").agg(F.count("member").alias("shared"))
    return first_by(both, ["machine"], F.desc("shared"), F.desc("named"), F.col("enum")).select("machine", "enum", "shared")


def compare_roots(reached: DataFrame, a: Column, b: Column) -> DataFrame:
    """Nodes that two roots of (root, node) both reach."""
    return reached.where(F.col("root") == a).select("node").intersect(reached.where(F.col("root") == b).select("node"))


def interrupt_handlers(irqs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(irq, handler): X_IRQn to X_IRQHandler, then X_Handler; digits to the vector slot of that number."""
    base = F.regexp_replace("irq", "_IRQn$", "")
    names = irqs.where(~F.col("irq").rlike("^[0-9]+$")).select("irq", F.posexplode(F.array(*[F.concat(base, F.lit(end)) for end in ("_IRQHandler", "_Handler")])).alias("rank", "handler"))
    named = names.join(vectors.select("handler").distinct(), "handler").select("irq", "rank", "handler")
    slots = irqs.where(F.col("irq").rlike("^[0-9]+$")).withColumn("vector", F.col("irq").try_cast("int")).join(vectors, "vector").select("irq", F.lit(0).alias("rank"), "handler")
    return named.unionByName(slots).groupBy("irq").agg(F.min(F.struct("rank", "handler")).alias("m")).select("irq", "m.handler")


def control_targets(controls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(control_id, target): the argument's unique definition; without argument, the function itself."""
    one = definitions.groupBy("name").agg(F.when(F.count("symbol_id") == 1, F.min("symbol_id")).alias("only"))
    return controls.join(one, controls["argument"] == one["name"], "left").select("control_id", F.when(F.col("argument").isNull(), F.col("function")).otherwise(F.col("only")).alias("target"))


def pair_sections(calls: DataFrame) -> DataFrame:
    """Begin and end calls (function, line, what: begin | end) paired in source order, a nested begin skipped: (function, begin_line, end_line; null if unterminated).

    A begin opens a section if what came before it is no begin, and an end closes one if what came before it is no end.
    """
    w = Window.partitionBy("function").orderBy("line", "what")
    acts = calls.withColumn("past", F.coalesce(F.lag("what").over(w), F.lit("end"))).where("what <> past")
    return acts.withColumn("end_line", F.lead("line").over(w)).where("what = 'begin'").select("function", F.col("line").cast("bigint").alias("begin_line"), F.col("end_line").cast("bigint").alias("end_line"))


def argument_sections(statements: DataFrame, per_lock: bool = False) -> tuple[DataFrame, DataFrame]:
    """Critical sections by lock: ((function, rule, argument, begin_line, end_line: null if unterminated), (function, nested: begins left out)).

    statements: function, block, block_from, block_end, nth, line, what (begin | end), rule, argument. A begin is closed by the
    first later end of its rule and argument in its block (arguments are null for rules that don't match them), or lasts to
    the block's end. A begin inside a section that is open already opens none: inside any section of the function, or with
    per_lock inside one of its own rule and argument. Outer blocks come first, then places in order.
    """
    same = Window.partitionBy("function", "block", "rule", "argument").orderBy("nth")
    ends = F.when(F.col("what") == "end", F.struct("nth", "line"))
    begins = statements.withColumn("close", F.min(ends).over(same.rowsBetween(1, Window.unboundedFollowing))).where("what = 'begin'")
    begins = begins.select("function", "rule", "argument", "block_from", "block", "nth", "line", F.col("close.line").alias("end_line"), F.coalesce("close.line", F.col("block_end") + 1).alias("stop"))
    lock = ["function", "rule", "argument"] if per_lock else ["function"]
    types = dict(begins.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block_from", "block", "nth"])
        starts, stops, opened = [], [], []
        for line, stop in zip(rows["line"], rows["stop"]):
            # Sections that are open don't overlap, so the last that starts before decides.
            at = bisect_right(starts, line)
            inside = at > 0 and line < stops[at - 1]
            opened.append(not inside)
            if not inside:
                starts.insert(at, line)
                stops.insert(at, stop)
        return rows.assign(opened=opened)[["function", "rule", "argument", "line", "end_line", "opened"]].astype({"end_line": "Int64"})

    found = begins.groupBy(*lock).applyInPandas(run, f"function {types['function']}, rule {types['rule']}, argument {types['argument']}, line long, end_line long, opened boolean")
    nested = found.groupBy("function").agg(F.count_if(~F.col("opened")).alias("nested"))
    return found.where("opened").select("function", "rule", "argument", F.col("line").alias("begin_line"), "end_line"), nested


def unique_ids(paths: DataFrame) -> DataFrame:
    """(path, id, level): an id for each distinct path, its last part, or with a part from farther up before it where that is taken.

    Paths have precedence in their order: each gets the first of its names that no earlier path gets. The names are the last
    part, then the last part after each part above it in turn, then after the word module, and then with a hash of the path. All paths
    ask at once; a name goes to the earliest that asks, even if another had it, and who is refused asks for the next name, so
    there are as many rounds as the longest chain of refusals and never a loop over paths.
    """
    parts = F.transform(F.split("path", "/"), lambda x: F.replace(x, F.lit("-"), F.lit("_")))
    n = F.size("parts")
    base = F.when(F.element_at("parts", -1) == "", "module").otherwise(F.element_at("parts", -1))
    up = F.get("parts", n - 1 - F.col("level"))
    name = F.when(F.col("level") == 0, base).when(F.col("level") < n, F.concat_ws("_", up, base)).when(F.col("level") == n, F.concat(F.lit("module_"), base)).otherwise(F.concat_ws("_", F.lit("module"), base, F.expr("substring(sha1(path), 1, 8 * (level - size(parts)))")))
    state = _cut(paths.select("path").distinct().select("path", parts.alias("parts"), F.lit(0).alias("level")))
    while True:
        asked = state.withColumn("id", name)
        won = asked.groupBy("id").agg(F.min("path").alias("first"))
        told = _cut(asked.join(won, "id").withColumn("refused", F.col("path") != F.col("first")))
        if told.where("refused").isEmpty():
            return told.select("path", "id", "level")
        state = told.select("path", "parts", (F.col("level") + F.col("refused").cast("int")).alias("level"))


def wrapper_roles(calls: DataFrame) -> DataFrame:
    """(function, rule, what) of wrappers, from (function, rule, what: begin | end): a function that begins one rule it never ends, and ends none, or the reverse."""
    sides = calls.groupBy("function", "rule").agg(F.bool_or(F.col("what") == "begin").alias("b"), F.bool_or(F.col("what") == "end").alias("e")).where("b <> e")
    one = sides.groupBy("function").agg(F.count_if("b").alias("begins"), F.count_if("e").alias("ends"), F.min("rule").alias("rule"))
    return one.where("begins + ends = 1").select("function", "rule", F.when(F.col("begins") == 1, "begin").otherwise("end").alias("what"))


def wrapper_sections(calls: DataFrame, roles: DataFrame) -> DataFrame:
    """(function, rule, begin_line, end_line): calls (function, line, callee) of begin and end wrappers of a rule, paired in source order."""
    acts = calls.join(roles.select(F.col("function").alias("callee"), "rule", "what"), "callee").select(F.struct("function", "rule").alias("function"), "line", "what")
    return pair_sections(acts).select("function.function", "function.rule", "begin_line", "end_line")


def image_symbol_ids(symbols: DataFrame, sources: DataFrame, functions: DataFrame, variables: DataFrame) -> DataFrame:
    """(name, kind, object, source_path, symbol_id) of image symbols (name, kind, object): code is looked up among the functions of
    the object's source file, all else among its variables outside functions.

    sources: object, source_path; functions: path, name, symbol_id, in_header; variables: path, name, symbol_id, parent.
    """
    known = functions.where("not in_header").select(F.lit(True).alias("code"), "path", "name", "symbol_id").unionByName(variables.where("parent is null").select(F.lit(False).alias("code"), "path", "name", "symbol_id"))
    one = known.groupBy("code", F.col("path").alias("source_path"), "name").agg(F.max("symbol_id").alias("symbol_id"))
    got = symbols.join(sources, "object", "left").withColumn("code", F.col("kind") == "code")
    return got.join(one, ["code", "source_path", "name"], "left").select("name", "kind", "object", "source_path", "symbol_id")


def reference_edges(references: DataFrame, functions: DataFrame) -> DataFrame:
    """(source, target, lines): references (path, line, target) by the smallest function (path, symbol_id, line, end_line) that holds them, lines in order.

    References of one line share their owner, so each place is looked up once.
    """
    points = references.select("path", "line").distinct().withColumn("point_id", F.struct("path", "line"))
    owner = enclosing(points, functions.select("path", F.col("symbol_id").alias("span_id"), F.col("line").alias("line_from"), F.col("end_line").alias("line_to")), "path")
    return references.join(owner.select("path", "line", "span_id"), ["path", "line"]).groupBy(F.col("span_id").alias("source"), "target").agg(F.array_sort(F.collect_set("line")).alias("lines"))
