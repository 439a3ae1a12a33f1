"""Constant expressions by joins, declared ticks and phases of the main unit."""

from factweave.functions import scalars as S
from factweave.operators import concurrency as C
from factweave.operators import timebase as B


def test_folding_meets_only_named_constants(spark):
    constants = {"A": "3", "B": "A", "C": "B + 1", "D": "C * C", "E": "D", "F": "E", "X": "Y", "Y": "X", "Z": "(uint32_t)0x10", "N": None}
    texts = ["A", "B * 2", "D", "E - 1", "F", "X", "Z / A", "missing", "7", "", None, "(A + B) * C", "N"]
    got = B.folded(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame(list(constants.items()), "name string, text string"))
    known = {k: v for k, v in constants.items() if v is not None}
    want = {}
    for i, t in enumerate(texts):
        value, basis = S.fold_text(t, known) if t is not None else (None, "unresolved")
        want[i] = (None if value is None else float(value), basis)
    assert {r["id"]: (r["value"], r["basis"]) for r in got.collect()} == want


def test_declared_tick_counts_only_without_calls(spark):
    calls = spark.createDataFrame([("f", "SysTick_Config", 3, "SystemCoreClock / 100")], "function string, callee string, line long, expression string")
    constants = spark.createDataFrame([("SystemCoreClockUpdate", "5"), ("SystemCoreClock", "8000000")], "name string, text string")
    got = [tuple(r) for r in B.systick(calls, constants, 1.0).select("name", "value", "unit", "basis").collect()]
    assert got == [("SysTick_Config", 10.0, "ms", "expression")]
    assert [tuple(r) for r in B.systick(calls.limit(0), constants, 1.0).select("name", "value", "unit", "basis").collect()] == [("tick_ms", 1.0, "ms", "declared")]
    assert [tuple(r) for r in B.systick(calls, constants.limit(0)).select("value", "basis", "confidence").collect()] == [(None, "unresolved", "low")]
    assert B.core_clock(constants.limit(0)).count() == 0 and B.core_clock(constants).first()["value"] == 8e6


def test_counters_and_loops_that_wait(spark):
    accesses = [("t", "read_write", None, "function:a.c:isr", 5), ("t", "read", None, "function:a.c:now", 9), ("u", "read_write", "field", "function:a.c:isr", 6), ("u", "read", None, "function:a.c:now2", 9), ("v", "read_write", "", "function:a.c:both", 1), ("v", "read", "", "function:a.c:both", 2)]
    accesses += [("w", "read_write", None, "function:a.c:isr", k) for k in range(4)] + [("w", "read", None, "function:a.c:main", 1)]
    reached = [("isr", "function:a.c:isr"), ("isr", "function:a.c:both"), ("task", "function:a.c:both"), ("task", "function:a.c:now"), ("main", "function:a.c:main"), ("task", "function:a.c:now2")]
    a, r = spark.createDataFrame(accesses, "name string, kind string, via string, function string, line long"), spark.createDataFrame(reached, "unit_kind string, function string")
    counted = B.counters(a, r)
    assert [(x["name"], x["value"], x["function"], x["line"]) for x in counted.collect()] == [("t", 2.0, "function:a.c:isr", 5)]
    loops = spark.createDataFrame([("f", 1, "now() - start < LIMIT"), ("f", 2, "t <= 10 && now()"), ("f", 3, "u < 3"), ("f", 4, ""), ("f", 5, "later > t")], "function string, line long, condition string")
    got = B.timeout_loops(loops, counted, a, spark.createDataFrame([("LIMIT", "2 * 50")], "name string, text string"))
    assert sorted((x["line"], x["name"], x["value"], x["unit"]) for x in got.collect()) == [(1, "t", 100.0, "count"), (2, "t", 10.0, "count"), (5, "t", None, None)]


def test_main_without_a_loop_only_initialises(spark):
    a = spark.createDataFrame([("r", "main:main", "main", 5), ("r", "main:main", "main", 50), ("r", "main:main", "helper", 1), ("r", "task:t", "helper", 1), ("r", "main:main", "setup", 2)], "resource string, unit string, function string, line long")
    loop = spark.createDataFrame([("main", 40, 60, ["step"])], "function string, line long, end_line long, body_calls array<string>")
    reached = spark.createDataFrame([("step", "step"), ("step", "helper"), ("step", "main"), ("other", "setup")], "root string, node string")
    phases = lambda loops: sorted((x["unit"], x["function"], x["line"], x["phase"]) for x in C.main_phases(a, "main:main", loops, reached).collect())
    assert phases(loop) == [("main:main", "helper", 1, "run"), ("main:main", "main", 5, "init"), ("main:main", "main", 50, "run"), ("main:main", "setup", 2, "init"), ("task:t", "helper", 1, "run")]
    assert [x[3] for x in phases(loop.limit(0))] == ["init"] * 4 + ["run"]
