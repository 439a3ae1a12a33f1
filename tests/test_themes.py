"""Themes of a small program, against values derived by hand from its source."""

import pytest

from factweave.operators import concurrency as C
from factweave.plans.themes import Views, blinky


@pytest.fixture(scope="module")
def facts(spark):
    return blinky(spark)


def test_conflicts(facts):
    got = {r["resource"]: (r["pattern"], r["confidence"]) for r in C.conflicts(facts["accesses"]).collect()}
    assert {k: v[1] for k, v in got.items()} == {"g_button_pressed": "high", "g_tick_ms": "medium", "s_level": "high", "s_ticks": "high"}
    assert all(v[0] == "isr-write/other-access" for v in got.values())


def test_dependencies(spark, facts):
    places = spark.createDataFrame([("task:led_task", 0), ("task:heartbeat_task", 1)], "unit string, place int")
    got = {(r["from_unit"], r["to_unit"]): r["order"] for r in C.data_dependencies(facts["accesses"], places, "cooperative").collect()}
    button, led, main, tick = "isr:BUTTON_IRQHandler", "task:led_task", "main:main", "isr:SysTick_Handler"
    assert got == {(button, led): "async", (button, main): "async", (led, main): "main", (tick, led): "async", (main, led): "main", (main, button): "async", (led, button): "async"}


def test_views(facts):
    v = Views(facts)
    assert [t["available"] for t in v.list_themes()] == [True] * 6
    assert {r["id"]: (r["mode"], r["period_ms"]) for r in v.theme("timing").collect()}["task:heartbeat_task"] == ("periodic", 50.0)
    assert {r["module"]: (r["ram"], r["rom"]) for r in v.theme("memory").collect()} == {"app": (48, 880), "hal": (24, 400)}
    assert {r["id"]: r["functions"] for r in v.theme("execution").collect()}["main:main"] == 6
    assert {r["id"] for r in v.theme("concurrency").collect()} == {f"variable:{x}" for x in ("g_button_pressed", "g_tick_ms", "s_ctx", "s_level", "s_ticks")}
    assert v.read("preemptive")["items"][0]["rank"] == 2
    assert v.read("memory", "0.ram") == {"value": 48} and v.read("memory", "9.ram")["error"] == "not-found"
    assert v.read_object("module:hal")["object"]["rom"] == 400 and v.read_object("x")["error"] == "not-found"
    assert "memory: 2 rows" in v.report()


def test_missing_is_not_empty(facts):
    v = Views({k: x for k, x in facts.items() if k != "objects"})
    assert v.theme("memory") is None and v.read("memory") == {"available": False}
    with pytest.raises(KeyError):
        v.theme("colour")
