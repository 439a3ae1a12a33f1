"""Small cases of the fact operators with the rows that they give: inline facts, expected rows as SQL values."""

from pyspark.sql import functions as F

from factweave.functions import scalars as S
from factweave.operators import aggregates as A
from factweave.operators import concurrency as C
from factweave.operators import derive as D
from factweave.operators import graph as G
from factweave.operators import joins as J
from factweave.operators import ordering as O
from factweave.sources import projects as P
from factweave.sources import text_scans as X


CASES = {}


def query(name, sql):
    def add(f):
        CASES[name] = (f, sql)
        return f

    return add


@query("merged_units", "SELECT * FROM (VALUES ('src/app/led', 2), ('src/main.c', 1), ('src/app/x.h', 1), ('lib/led.h', 1)) t(unit, files)")
def merged_units(spark, d):
    return A.merge_units(spark.createDataFrame([("src/app/led.c",), ("src/app/led.h",), ("src/main.c",), ("src/app/x.h",), ("lib/led.h",)], "path string"))


@query("scheduling", "SELECT * FROM (VALUES ('a', 'preemptive'), ('b', 'cooperative'), ('c', 'unknown')) t(project, scheduling)")
def scheduling(spark, d):
    return A.scheduling(spark.createDataFrame([("a", "cooperative"), ("a", "preemptive"), ("b", "cooperative"), ("b", None), ("c", None)], "project string, scheduling string"))


@query("loop_bounds", "SELECT * FROM (VALUES (1, 10), (2, 4), (3, 5), (4, NULL), (5, 0), (6, 11)) t(id, most)")
def loop_bounds(spark, d):
    rows = [(1, 0, 10, "<", 1), (2, 0, 10, "<", 3), (3, 10, 0, ">", -2), (4, 0, 10, "<", -1), (5, 10, 0, "<", 1), (6, 0, 10, "<=", 1)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c string, s int")
    return df.select("id", S.loop_maximum(F.col("a"), F.col("b"), F.col("c"), F.col("s")).alias("most"))


@query("due_counts", "SELECT * FROM (VALUES ('control', 6, 0), ('logger', 2, 2), ('slow', 1, 1)) t(task, due, deferred)")
def due_counts(spark, d):
    return O.due_counts(spark.createDataFrame([("control", 1, 10), ("worker", 2, None), ("logger", 3, 40), ("slow", 4, 90)], "task string, rank int, period int"), 50)


@query("condition_stack", "SELECT * FROM (VALUES ('a.c', 1, 'A'), ('a.c', 2, 'A'), ('a.c', 3, 'A && defined(B)'), ('a.c', 4, 'A'), ('a.c', 5, '!(A)'), ('a.c', 6, '')) t(file, line, condition)")
def condition_stack(spark, d):
    text = ["#if A", "int x;", "#ifdef B", "#endif", "#else", "#endif"]
    return O.condition_stack(spark.createDataFrame([("a.c", i + 1, t) for i, t in enumerate(text)], "file string, line bigint, text string"))


@query("natural_pick", "SELECT * FROM (VALUES ('hal', 'lib-10.2.a'), ('rtos', 'k9.lib')) t(k, name)")
def natural_pick(spark, d):
    return O.natural_pick(spark.createDataFrame([("hal", "lib-9.11.a"), ("hal", "lib-10.2.a"), ("hal", "lib-2.30.a"), ("rtos", "k9.lib"), ("rtos", "k08.lib")], "k string, name string"), "k", "name")


SOURCES = [("src/main.c", '#include "app/led.h"\n#include <stdint.h>\n#define LED 1 /* pin */\n// #define NO 2\nint main(void) { led_init(&cb, (f)g); }\n'), ("src/app/led.c", '#include "led.h"\n  #  define A(x) x\n'), ("src/app/led.h", "")]


def sources(spark):
    return spark.createDataFrame(SOURCES, "path string, text string")


@query("include_directives", "SELECT * FROM (VALUES ('src/main.c', 1, 'app/led.h', true), ('src/main.c', 2, 'stdint.h', false), ('src/app/led.c', 1, 'led.h', true)) t(path, line, name, quoted)")
def include_directives(spark, d):
    return X.include_directives(sources(spark))


@query("resolved_includes", "SELECT * FROM (VALUES ('src/main.c', 'src/app/led.h'), ('src/app/led.c', 'src/app/led.h')) t(source, target)")
def resolved_includes(spark, d):
    t = sources(spark)
    return X.resolve_includes(X.include_directives(t), spark.createDataFrame([("src/main.c", 0, "inc"), ("src/app/led.c", 0, "src/app")], "path string, ordinal int, dir string"), t)


@query("macro_definitions", "SELECT * FROM (VALUES ('src/main.c', 3, 'LED'), ('src/app/led.c', 2, 'A')) t(path, line, name)")
def macro_definitions(spark, d):
    return X.macro_definitions(sources(spark))


@query("macro_tokens", "SELECT * FROM (VALUES ('a.c', 3, 5, 4), ('a.c', 5, 10, 2)) t(path, line, \"column\", length)")
def macro_tokens(spark, d):
    rows = [("a.c", 0, 0, 8, 4, "macro", 1), ("a.c", 1, 2, 4, 4, "macro", 0), ("a.c", 2, 2, 3, 3, "variable", 0), ("a.c", 3, 0, 6, 2, "macro", 0)]
    return X.macro_tokens(spark.createDataFrame(rows, "path string, seq int, line_step int, column_step int, length int, kind string, flags int"))


@query("text_edges", "SELECT * FROM (VALUES ('f', 'g', 'calls'), ('f', 'task_a', 'registers_task'), ('f', 'cb', 'address_of')) t(source, target, relation)")
def text_edges(spark, d):
    bodies = spark.createDataFrame([("f", 'g(1, h(2)); create("x", task_a, 3); if (x) set(&cb, (fn)local); // g2(cb)\n')], "function string, body string")
    functions = spark.createDataFrame([("f",), ("g",), ("task_a",), ("cb",), ("local",), ("g2",)], "name string")
    return X.text_edges(bodies, functions, [("creat*", "task", 1)], spark.createDataFrame([("f", "local")], "function string, name string"))


ASSEMBLY = "  AREA x\n__Vectors:\n  DCD __initial_sp ; stack\n  DCD Reset_Handler\n" + "  DCD 0\n" * 13 + "  DCD SysTick_Handler\n  DCD TIM_IRQHandler @ first\n  .section .text\n  DCD Later\n"


@query("vector_table", "SELECT * FROM (VALUES ('s.s', -15, 'Reset_Handler'), ('s.s', -1, 'SysTick_Handler'), ('s.s', 0, 'TIM_IRQHandler')) t(path, vector, handler)")
def vector_table(spark, d):
    return X.vector_entries(spark.createDataFrame([("s.s", ASSEMBLY)], "path string, text string"))


MAP = "Image Symbol Table\n    led_init   0x08000100   Thumb Code   24   led.o(.text)\n    g_ctx   0x20000000   Data   8   led.o(.bss)\nImage component sizes\n      800   12   64   16   32   900   led.o\n      400    0    0    0   24   100   gpio.o\n"


@query("map_symbols", "SELECT * FROM (VALUES ('led_init', '0x08000100', 'code', 24, 'led.o'), ('g_ctx', '0x20000000', 'data', 8, 'led.o')) t(name, address, kind, size_bytes, object)")
def map_symbols(spark, d):
    return X.map_symbols(spark.createDataFrame([("m", MAP)], "path string, text string"))


@query("map_components", "SELECT * FROM (VALUES ('led.o', 800, 12, 64, 16, 32, 900), ('gpio.o', 400, 0, 0, 0, 24, 100)) t(object, code, inline_data, ro, rw, zi, debug)")
def map_components(spark, d):
    return X.map_components(spark.createDataFrame([("m", MAP)], "path string, text string"))


COMMANDS = [("/w", "a.c", None, ["arm-none-eabi-gcc", "-I", "inc", "-Isrc", "-isystem", "sys", "-c", "a.c"], None), ("/w", "b.ino.cpp", "cc '-I my dir' -DX=1 b.ino", None, None)]


def commands(spark):
    return P.normal_commands(spark.createDataFrame(COMMANDS, P.COMMAND_FIELDS))


@query("include_dirs", "SELECT * FROM (VALUES ('a.c', 0, 'inc'), ('a.c', 1, 'src'), ('a.c', 2, 'sys'), ('b.ino', 0, ' my dir')) t(file, ordinal, dir)")
def include_dirs(spark, d):
    return P.include_dirs(commands(spark))


@query("local_commands", "SELECT * FROM (VALUES ('a.c', 'clang --target=arm-none-eabi -I inc -Isrc -isystem sys -c a.c'), ('b.ino', 'clang -I my dir -DX=1 b.ino')) t(file, line)")
def local_commands(spark, d):
    return P.local_commands(commands(spark)).select("file", F.array_join("arguments", " ").alias("line"))


@query("path_mapping", "SELECT * FROM (VALUES ('/build/x', 3)) t(prefix, n)")
def path_mapping(spark, d):
    return P.infer_mapping(spark.createDataFrame([("/build/x/src/a.c",), ("/build/x/src/b.c",), ("/build/x/lib/c.c",), ("/other/src/d.c",)], "path string"), ["src", "lib"])


@query("mapped_paths", "SELECT * FROM (VALUES ('/build/a.c', '/home/a.c'), ('/build/b.c', '/build/b.c'), ('/build/c.c', '/home/c.c')) t(path, mapped)")
def mapped_paths(spark, d):
    return P.map_paths(spark.createDataFrame([("/build/a.c",), ("/build/b.c",), ("/build/c.c",)], "path string"), "/build", "/home", spark.createDataFrame([("/home/a.c",), ("/build/b.c",)], "path string"))


@query("c_integer", "SELECT * FROM (VALUES ('10', 10), ('0x1F', 31), ('017', 15), ('0b101UL', 5), ('-0x10', -16), ('089', NULL), ('abc', NULL), ('0', 0), (' 7u ', 7), ('1.5', NULL)) t(text, value)")
def c_integer(spark, d):
    rows = ["10", "0x1F", "017", "0b101UL", "-0x10", "089", "abc", "0", " 7u ", "1.5"]
    return spark.createDataFrame([(r,) for r in rows], "text string").select("text", S.c_integer(F.col("text")).alias("value"))


@query("folded_constants", "SELECT * FROM (VALUES ('3', 3, 'literal'), ('tskIDLE + 2', 2, 'expression'), ('(MAX - 1)', 6, 'expression'), ('(prio_t) NORMAL', 24, 'symbol'), ('MY_PRIO', NULL, 'unresolved'), ('2*3+1', 7, 'expression'), ('ALIAS', 7, 'symbol')) t(text, value, basis)")
def folded_constants(spark, d):
    fold = S.fold_constants({"tskIDLE": "0", "MAX": "7", "NORMAL": "24", "ALIAS": "MAX"})
    rows = ["3", "tskIDLE + 2", "(MAX - 1)", "(prio_t) NORMAL", "MY_PRIO", "2*3+1", "ALIAS"]
    return spark.createDataFrame([(r,) for r in rows], "text string").select("text", fold("text").alias("f")).select("text", "f.value", "f.basis")


@query("negations", "SELECT * FROM (VALUES ('ready', '!ready'), ('!ready', 'ready'), ('a && b', '!(a && b)'), ('!f(x)', 'f(x)')) t(text, opposite)")
def negations(spark, d):
    return spark.createDataFrame([("ready",), ("!ready",), ("a && b",), ("!f(x)",)], "text string").select("text", S.negation(F.col("text")).alias("opposite"))


@query("atomicity", "SELECT * FROM (VALUES ('volatile uint8_t', 1, 'single-word'), ('uint64_t', 8, 'wide'), ('struct s', NULL, 'composite'), ('int[4]', NULL, 'composite'), ('char *', 4, 'single-word'), ('state_t', NULL, 'unknown'), ('long long', 8, 'wide'), ('unsigned int', 4, 'single-word')) t(type, width, atomicity)")
def atomicity(spark, d):
    rows = ["volatile uint8_t", "uint64_t", "struct s", "int[4]", "char *", "state_t", "long long", "unsigned int"]
    t = F.col("type")
    return spark.createDataFrame([(r,) for r in rows], "type string").select("type", S.width_bytes(t).alias("width"), S.atomicity(t).alias("atomicity"))


@query("rule_tables", "SELECT * FROM (VALUES ('rt.create', 'rt_create', 'task'), ('p.task_create.1', 'spawn', NULL)) t(rule_id, function, kind)")
def rule_tables(spark, d):
    profiles = [{"name": "p", "task_create": [{"id": "rt.create", "function": "rt_create", "entry_argument": 0, "kind": "task"}, {"function": "spawn"}]}]
    return P.rule_tables(spark, profiles)["task_create"].select("rule_id", "function", "kind")


@query("block_nesting", "SELECT * FROM (VALUES ('f', 1, NULL, 0), ('f', 2, 1, 1), ('f', 3, 2, 2), ('f', 4, 1, 1), ('g', 5, NULL, 0)) t(function, block_id, parent, depth)")
def block_nesting(spark, d):
    rows = [("f", 1, 1, 20), ("f", 2, 3, 9), ("f", 3, 5, 6), ("f", 4, 12, 15), ("g", 5, 1, 4)]
    return J.nesting(spark.createDataFrame(rows, "function string, block_id int, line_from int, line_to int"), "function")


@query("traced_constants", "SELECT * FROM (VALUES ('h', 'p', '7', 0), ('h', 'p', '5', 1), ('h', 'p', '4', 2), ('g', 'q', '5', 0), ('g', 'q', '4', 1), ('f', 'r', '4', 0), ('f', 'r', '1', 1), ('g', 'q', '1', 2), ('e', 's', '1', 0)) t(function, parameter, constant, hops)")
def traced_constants(spark, d):
    rows = [("h", "p", "g", "q", True), ("h", "p", "m", "7", False), ("g", "q", "f", "r", True), ("g", "q", "m", "5", False), ("f", "r", "m", "4", False), ("f", "r", "e", "s", True), ("e", "s", "m", "1", False)]
    return J.trace_constants(spark.createDataFrame(rows, "function string, parameter string, caller string, argument string, is_parameter boolean"))


@query("object_sources", "SELECT * FROM (VALUES ('led.o', 'src/led.c', 'functions'), ('gpio.o', 'src/gpio.c', 'name'), ('tie.o', NULL, 'none')) t(object, source_path, match)")
def object_sources(spark, d):
    votes = spark.createDataFrame([("led.o", "src/led.c"), ("led.o", "src/led.c"), ("led.o", "src/x.c"), ("tie.o", "a/tie.c"), ("tie.o", "b/tie.c")], "object string, path string")
    files = spark.createDataFrame([("src/led.c",), ("src/gpio.c",), ("a/tie.c",), ("b/tie.c",)], "path string")
    return J.object_sources(votes, spark.createDataFrame([("led.o",), ("gpio.o",), ("tie.o",)], "object string"), files)


@query("interrupt_handlers", "SELECT * FROM (VALUES ('TIM2_IRQn', 'TIM2_IRQHandler'), ('SysTick_IRQn', 'SysTick_Handler'), ('7', 'USART_IRQHandler')) t(irq, handler)")
def interrupt_handlers(spark, d):
    vectors = spark.createDataFrame([(2, "TIM2_IRQHandler"), (-1, "SysTick_Handler"), (7, "USART_IRQHandler"), (3, "TIM2_Handler")], "vector int, handler string")
    return J.interrupt_handlers(spark.createDataFrame([("TIM2_IRQn",), ("SysTick_IRQn",), ("7",), ("NONE_IRQn",)], "irq string"), vectors)


@query("critical_sections", "SELECT * FROM (VALUES ('f', 2, 9), ('f', 12, NULL), ('g', 4, 5)) t(function, begin_line, end_line)")
def critical_sections(spark, d):
    rows = [("f", 2, "begin"), ("f", 5, "begin"), ("f", 9, "end"), ("f", 10, "end"), ("f", 12, "begin"), ("g", 1, "end"), ("g", 4, "begin"), ("g", 5, "end")]
    return J.pair_sections(spark.createDataFrame(rows, "function string, line bigint, what string"))


@query("effective_contexts", "SELECT * FROM (VALUES ('task:a', 'task:a', 'task'), ('callback:b', 'task:a', 'task'), ('timer:c', 'task:a', 'task'), ('callback:d', 'callback:d', 'callback'), ('isr:e', 'isr:e', 'isr')) t(unit, context, context_kind)")
def effective_contexts(spark, d):
    rows = [("task:a", "task", None), ("callback:b", "callback", "task:a"), ("timer:c", "timer", "callback:b"), ("callback:d", "callback", None), ("isr:e", "isr", "task:a")]
    return C.effective_contexts(spark.createDataFrame(rows, "unit string, unit_kind string, host string"))


@query("run_modes", "SELECT * FROM (VALUES ('task:a', 'periodic', 'high', 50.0::DOUBLE), ('task:b', 'event-driven', 'high', NULL), ('main:main', 'busy-poll', 'medium', NULL), ('isr:x', 'one-shot', 'medium', NULL), ('task:c', 'periodic', 'high', NULL), ('task:d', 'unknown', 'low', NULL)) t(unit, mode, confidence, period_ms)")
def run_modes(spark, d):
    units = spark.createDataFrame([("task:a", "fa", True), ("task:b", "fb", True), ("main:main", "m", True), ("isr:x", "x", True), ("task:c", "fc", True), ("task:d", "fd", False)], "unit string, function string, analysed boolean")
    rows = [("fa", 1, True, [("delay", 0.05, "s")]), ("fb", 1, True, [("wait", None, None), ("delay", 5.0, "ms")]), ("m", 1, True, []), ("x", 1, False, []), ("fc", 1, True, [("delay", 1.0, "ms"), ("delay", 2.0, "tick")]), ("fd", 1, True, [])]
    return C.run_modes(units, spark.createDataFrame(rows, "function string, loop_id int, infinite boolean, blocking array<struct<kind: string, value: double, unit: string>>"))


@query(
    "pruned_calls",
    "SELECT * FROM (VALUES (2, 'g', 'h', 0, 2, 1), (4, 'h', 'k', 0, 9, 2)) t(site, caller, callee, param, wanted, round)",
)
def pruned_calls(spark, d):
    calls = spark.createDataFrame([(1, "main", "g"), (2, "g", "h"), (3, "g", "i"), (4, "h", "k"), (5, "main", "h")], "site int, caller string, callee string")
    arguments = spark.createDataFrame([(1, 0, 1), (2, 0, 9), (5, 0, 3), (3, 0, None)], "site int, position int, value int")
    guards = spark.createDataFrame([(2, 0, 2), (3, 0, 1), (4, 0, 9)], "site int, position int, equals int")
    return G.prune_branches(calls, arguments, guards, spark.createDataFrame([("main",)], "function string"))


@query("polling_order", "SELECT * FROM (VALUES ('p', 'task:a', 0), ('p', 'task:b', 1), ('p', 'task:c', 2)) t(project, unit, place)")
def polling_order(spark, d):
    calls = spark.createDataFrame([("p", "main", "init", 10)], "project string, source string, target string, line int")
    regs = spark.createDataFrame([("p", "init", "task:a", 20), ("p", "init", "task:b", 30), ("p", "main", "task:c", 11)], "project string, function string, unit string, line int")
    return G.polling_order(calls, regs, spark.createDataFrame([("p", "main")], "project string, function string"))


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


@query("entries", "SELECT * FROM (VALUES ('reset', 'r', false), ('main', 'l', true)) t(kind, symbol_id, superloop)")
def entries(spark, d):
    functions = rows(spark, "symbol_id string, name string", ("r", "Reset_Handler"), ("l", "loop"), ("s1", "setup"), ("s2", "setup"))
    return D.entries(functions, rows(spark, "function string, superloop boolean", ("loop", True), ("setup", False)))


@query("idle_exceptions", "SELECT * FROM (VALUES ('NMI_Handler', -14)) t(handler, vector)")
def idle_exceptions(spark, d):
    vectors = rows(spark, "handler string, vector int", ("NMI_Handler", -14), ("SysTick_Handler", -1), ("Hard", -13), ("TIM", 3))
    return D.idle_exceptions(vectors, rows(spark, "source string", ("Hard",)), rows(spark, "function string", ("SysTick_Handler",))).select("handler", "vector")


def bindings(spark):
    assigns = rows(spark, "callback string, struct_type string, field string", ("cb1", "dev", "on_rx"), ("cb2", None, "hook"), ("cb1", "dev", "on_rx"))
    tables = rows(spark, "callback string, struct_type string, index int", ("cb1", "dev", 1), ("cb3", "ops", 9))
    stores = "callback string, callee_stores struct<struct_type: string, field: string>"
    return D.indirect_bindings(assigns, tables, rows(spark, stores, ("cb1", ("bus", "cb")), ("cb4", None)), rows(spark, "struct_type string, index int, field string", ("dev", 1, "on_tx")))


@query("indirect_bindings", "SELECT * FROM (VALUES ('cb1', 'dev', 'on_rx', 'struct-field-assign'), ('cb2', NULL, 'hook', 'pointer-assign'), ('cb1', 'dev', 'on_tx', 'init-table'), ('cb1', 'bus', 'cb', 'param-store')) t(callback, struct_type, field, form)")
def indirect_bindings(spark, d):
    return bindings(spark)


@query("callback_details", "SELECT * FROM (VALUES ('cb1', 'param-store', 'cb,on_rx,on_tx'), ('cb2', 'pointer-assign', 'hook')) t(callback, form, fields)")
def callback_details(spark, d):
    return D.callback_details(bindings(spark))


@query("enabled_interrupts", "SELECT * FROM (VALUES (1, 'TIM2_IRQn', 'literal'), (2, '5', 'parameter'), (2, '7', 'parameter'), (3, NULL, 'unresolved')) t(site, irq, basis)")
def enabled_interrupts(spark, d):
    sites = rows(spark, "site int, function string, argument string, is_parameter boolean", (1, "f", "TIM2_IRQn", False), (2, "g", "n", True), (3, "h", "m", True))
    return D.enabled_interrupts(sites, rows(spark, "function string, parameter string, constant string", ("g", "n", "5"), ("g", "n", "7"), ("f", "n", "1")))


@query("inherited_modes", "SELECT * FROM (VALUES ('task:a', 'periodic', 50.0::DOUBLE, false), ('callback:b', 'periodic', 50.0, true), ('callback:c', 'one-shot', NULL, false)) t(unit, mode, period_ms, inherited)")
def inherited_modes(spark, d):
    modes = rows(spark, "unit string, mode string, period_ms double", ("task:a", "periodic", 50.0), ("callback:b", "one-shot", None), ("callback:c", "one-shot", None))
    return D.inherit_modes(modes, rows(spark, "unit string, host string", ("callback:b", "task:a")))


@query("image_staleness", "SELECT * FROM (VALUES (1, 1, 1)) t(newer, missing, unlinked)")
def image_staleness(spark, d):
    image = rows(spark, "source_path string, mtime bigint", ("a.c", 10), ("b.c", 10), (None, 10))
    return D.staleness(image, rows(spark, "path string, mtime bigint", ("a.c", 11), ("b.c", 9), ("z.c", 5)))


@query("boot_tree", "SELECT * FROM (VALUES ('main', 0), ('init', 1), ('bus', 2)) t(node, hops)")
def boot_tree(spark, d):
    calls = rows(spark, "source string, target string", ("main", "init"), ("init", "bus"), ("init", "log"), ("main", "idle"))
    return D.boot_tree(calls, rows(spark, "function string", ("bus",)), "main")


@query("tree_children", "SELECT * FROM (VALUES ('init', 'call', 4), ('task_a', 'schedule', 9)) t(child, hop, line)")
def tree_children(spark, d):
    calls = rows(spark, "source string, target string, line int", ("main", "init", 4), ("main", "init", 7), ("init", "x", 1))
    return D.tree_children(calls, rows(spark, "function string, target string, line int", ("main", "task_a", 9)), "main")


@query("edge_detail", "SELECT * FROM (VALUES ('calls', 7, '1,2,3,4,5,6'), ('includes', 1, '3')) t(measure, edges, lines)")
def edge_detail(spark, d):
    edges = [("a.c", "b.c", "calls", i) for i in range(1, 8)] + [("a.c", "b.h", "includes", 3), ("b.c", "a.c", "calls", 1)]
    return D.edge_detail(rows(spark, "source string, target string, measure string, line int", *edges), ["a.c"], ["b.c", "b.h"])


@query("extern_declarations", "SELECT * FROM (VALUES ('a.h', 'f', 2, 'f.c', true), ('a.c', 'g', 5, NULL, false)) t(path, name, line, defined_in, via_header)")
def extern_declarations(spark, d):
    decl = rows(spark, "path string, line int, name string", ("a.h", 9, "f"), ("a.h", 2, "f"), ("a.c", 5, "g"), ("f.c", 1, "f"))
    return D.extern_declarations(decl, rows(spark, "path string, name string", ("f.c", "f"), ("x.c", "g"), ("y.c", "g")))


@query("named_enums", "SELECT * FROM (VALUES ('a.h', 5, 'mode_t'), ('a.h', 9, 'color'), ('a.h', 20, NULL), ('b.h', 5, 'late_t')) t(file, end_line, name)")
def named_enums(spark, d):
    enums = rows(spark, "file string, end_line int, name string", ("a.h", 5, None), ("a.h", 9, "color"), ("a.h", 20, None), ("b.h", 5, None))
    return D.name_enums(enums, rows(spark, "file string, line int, alias string", ("a.h", 5, "mode_t"), ("a.h", 4, "old_t"), ("b.h", 4, "late_t"), ("a.h", 9, "no_t")))


@query("task_priorities", "SELECT * FROM (VALUES ('t1', '3', 'argument'), ('t2', '40', 'attr-initializer'), ('t3', '7', 'attr-initializer'), ('t4', NULL, 'unresolved')) t(unit, text, basis)")
def task_priorities(spark, d):
    tasks = rows(spark, "unit string, path string, argument string, attribute string", ("t1", "a.c", "3", "x"), ("t2", "a.c", None, "x"), ("t3", "z.c", None, "y"), ("t4", "z.c", None, "x"))
    return D.task_priorities(tasks, rows(spark, "attribute string, path string, text string", ("x", "a.c", "40"), ("x", "b.c", "41"), ("y", "q.c", "7")))


@query("machine_coupling", "SELECT * FROM (VALUES ('m1', 'm2')) t(machine, other)")
def machine_coupling(spark, d):
    conditions = rows(spark, "machine string, condition string", ("m1", "bus_ready() && own(3)"), ("m2", "x > 1"))
    functions = rows(spark, "name string, path string", ("bus_ready", "bus.c"), ("own", "led.c"))
    return D.machine_coupling(conditions, functions, rows(spark, "machine string, path string", ("m1", "led.c"), ("m2", "bus.c")))


@query("machine_transitions", "SELECT * FROM (VALUES ('m', 'OFF', 'ON', 'assignment'), ('m', 'ON', 'FAULT', 'call:fail'), ('m', NULL, 'OFF', 'outside-switch')) t(machine, source, target, via)")
def machine_transitions(spark, d):
    labels = rows(spark, "machine string, function string, state string, line int, end_line int", ("m", "step", "OFF", 10, 14), ("m", "step", "ON", 15, 19))
    writes = rows(spark, "function string, line int, target string", ("step", 12, "ON"), ("fail", 2, "FAULT"), ("step", 30, "OFF"))
    return D.machine_transitions(labels, writes, rows(spark, "function string, line int, callee string", ("step", 17, "fail")))


ROUND = "unit string, function string, line int, end_line int, superloop boolean"


def round_facts(spark):
    units = rows(spark, ROUND, ("main:loop", "loop", 1, 30, True), ("task:a", "fa", 40, 80, False), ("isr:x", "fx", 90, 95, False))
    loops = rows(spark, "function string, line int, end_line int, depth int, infinite boolean", ("loop", 5, 9, 0, True), ("fa", 45, 75, 0, True), ("fa", 50, 60, 1, True), ("fx", 91, 92, 0, False))
    return units, loops


@query("round_ranges", "SELECT * FROM (VALUES ('main:loop', 1, 30, 'superloop'), ('task:a', 45, 75, 'loop'), ('isr:x', 90, 95, 'body')) t(unit, from_line, to_line, kind)")
def round_ranges(spark, d):
    return D.round_ranges(*round_facts(spark))


@query("round_columns", "SELECT * FROM (VALUES ('main:loop', 'loop', 5, 0), ('task:a', 'loop', 45, 0), ('task:a', 'loop', 50, 1), ('isr:x', 'loop', 91, 0), ('task:a', 'call:put', 55, 2), ('task:a', 'call:get', 70, 1), ('isr:x', 'call:ack', 94, 0)) t(unit, item, line, depth)")
def round_columns(spark, d):
    units, loops = round_facts(spark)
    ranges = D.round_ranges(units, loops).join(units.select("unit", "function"), "unit")
    return D.round_columns(ranges, loops, rows(spark, "function string, callee string, line int", ("fa", "put", 55), ("fa", "get", 70), ("fa", "early", 41), ("fx", "ack", 94)))


@query("tick_of", "SELECT * FROM (VALUES ('a', 1.0::DOUBLE), ('b', 10.0)) t(project, tick_ms)")
def tick_of(spark, d):
    return D.tick_of(rows(spark, "project string, basis string, tick_ms double", ("a", "declared", 10.0), ("a", "code", 1.0), ("b", "declared", 10.0), ("b", "code", None)))
