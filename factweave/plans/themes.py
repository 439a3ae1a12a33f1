"""Six themed views over fact tables, and reads of them: pages, single objects by id, and an overview."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import concurrency as C
from ..operators import graph as G
from ..operators import ordering as O

THEMES = ("execution", "dependencies", "timing", "concurrency", "preemptive", "memory")


def execution(facts: dict[str, DataFrame]) -> DataFrame:
    """Units with their entry and how many functions they reach."""
    units = facts["units"]
    near = G.reach(facts["calls"], units.select(F.col("unit").alias("root"), F.col("function").alias("node")))
    return units.join(near.groupBy(F.col("root").alias("unit")).agg(F.count("node").alias("functions")), "unit", "left").select(F.col("unit").alias("id"), "unit_kind", "function", "functions")


def dependencies(facts: dict[str, DataFrame]) -> DataFrame:
    """Files with fan, depth, cycle flag and module."""
    e = facts["includes"]
    deep = G.depths(e)
    return A.fan(e).join(deep, "node").select(F.concat(F.lit("file:"), "node").alias("id"), F.col("node").alias("path"), S.module_of(F.col("node")).alias("module"), "fan_in", "fan_out", "depth", "in_cycle")


def timing(facts: dict[str, DataFrame]) -> DataFrame:
    """Run modes and periods of units; the loops of each are numbered by line."""
    modes = C.run_modes(facts["units"].withColumn("analysed", F.lit(True)), facts["loops"])
    return modes.select(F.col("unit").alias("id"), "mode", "confidence", "period_ms")


def concurrency(facts: dict[str, DataFrame]) -> DataFrame:
    """Shared resources with owner, flow and conflict."""
    a = facts["accesses"]
    return C.shared_resources(a).join(C.run_map(a), "resource", "left").join(C.conflicts(a), "resource", "left").select(F.concat(F.lit("variable:"), "resource").alias("id"), "units", "files", "access_count", "owner", "flow", "pattern", "confidence")


def preemptive(facts: dict[str, DataFrame]) -> DataFrame:
    """Tasks by dense priority rank with their period."""
    tasks = facts["units"].where("unit_kind = 'task'").withColumn("project", F.lit(0))
    ranked = O.priority_ranks(tasks, "project", "priority")
    return ranked.join(timing(facts).select(F.col("id").alias("unit"), "period_ms"), "unit", "left").select(F.col("unit").alias("id"), "priority", "rank", "period_ms")


def memory(facts: dict[str, DataFrame]) -> DataFrame:
    """ROM and RAM of modules, most RAM first."""
    return A.memory_by_module(facts["objects"], "module").select(F.concat(F.lit("module:"), "module").alias("id"), "module", "rom", "ram")


NEEDS = {"execution": ("units", "calls"), "dependencies": ("includes",), "timing": ("units", "loops"), "concurrency": ("accesses",), "preemptive": ("units", "loops"), "memory": ("objects",)}
BUILD = {"execution": execution, "dependencies": dependencies, "timing": timing, "concurrency": concurrency, "preemptive": preemptive, "memory": memory}


class Views:
    """Themes of one set of fact tables, built when first read and kept as tables in memory or on disk."""

    def __init__(self, facts: dict[str, DataFrame]):
        self.facts = facts
        self._kept: dict[str, DataFrame | None] = {}

    def theme(self, name: str) -> DataFrame | None:
        """A theme's rows; None if the facts it needs were not scanned, which is not the same as no rows."""
        if name not in BUILD:
            raise KeyError(f"no theme {name}; there are {', '.join(THEMES)}")
        if name not in self._kept:
            self._kept[name] = BUILD[name](self.facts).persist() if all(n in self.facts for n in NEEDS[name]) else None
        return self._kept[name]

    def list_themes(self) -> list[dict]:
        out = []
        for name in THEMES:
            df = self.theme(name)
            missing = [n for n in NEEDS[name] if n not in self.facts]
            out.append({"theme": name, "available": df is not None, "reason": f"no {', '.join(missing)}" if missing else None, "rows": None if df is None else df.count(), "fields": [] if df is None else df.columns})
        return out

    def read(self, theme: str, path: str = "", offset: int = 0, limit: int = O.PAGE) -> dict:
        """A page of a theme; path goes on into its items."""
        df = self.theme(theme)
        if df is None:
            return {"available": False}
        page = O.page(df, ["id"], offset, limit)
        if path and "items" in page:
            found, value = O.at_path(page["items"], path)
            return {"value": value} if found else {"error": "not-found", "path": path}
        return page

    def read_object(self, id_: str) -> dict:
        """The object of an id, from the first theme that has it."""
        for name in THEMES:
            df = self.theme(name)
            row = None if df is None else df.where(F.col("id") == id_).select(F.to_json(F.struct(*df.columns))).first()
            if row:
                return {"theme": name, "object": json.loads(row[0])}
        return {"error": "not-found", "id": id_}

    def report(self) -> str:
        """A short report in Markdown."""
        lines = ["# Code facts", ""]
        for t in self.list_themes():
            lines.append(f"* {t['theme']}: {t['rows']} rows" if t["available"] else f"* {t['theme']}: not available ({t['reason']})")
        return "\n".join(lines) + "\n"


def blinky(spark: SparkSession) -> dict[str, DataFrame]:
    """Facts of a small cooperative program, for tests and examples."""
    row = lambda schema, *values: spark.createDataFrame(list(values), schema)
    units = row("unit string, unit_kind string, function string, priority int", ("isr:SysTick_Handler", "isr", "SysTick_Handler", None), ("isr:BUTTON_IRQHandler", "isr", "BUTTON_IRQHandler", None), ("task:led_task", "task", "led_task", 2), ("task:heartbeat_task", "task", "heartbeat_task", 1), ("main:main", "main", "main", None))
    calls = row("source string, target string", ("main", "led_init"), ("led_init", "gpio_init"), ("led_init", "gpio_reset_all"), ("led_init", "events_wait_button"), ("led_task", "gpio_write"), ("BUTTON_IRQHandler", "gpio_write"), ("gpio_reset_all", "led_state"))
    includes = row("source string, target string", *[(a, b) for a, bs in {"main.c": ["app/led.h", "app/heartbeat.h"], "app/events.c": ["app/events.h", "hal/gpio.h"], "app/heartbeat.c": ["app/heartbeat.h"], "app/led.c": ["app/led.h", "hal/gpio.h", "app/events.h"], "hal/gpio.c": ["hal/gpio.h", "app/led.h"]}.items() for b in bs])
    loops = row("function string, loop_id int, infinite boolean, blocking array<struct<kind: string, value: double, unit: string>>", ("heartbeat_task", 1, True, [("delay", 50.0, "ms")]), ("gpio_reset_all", 1, False, []))
    used = {
        "SysTick_Handler": [("g_tick_ms", "read_write", 12, "")],
        "BUTTON_IRQHandler": [("g_button_pressed", "write", 17, "")],
        "events_wait_button": [("g_button_pressed", "read", 23, "")],
        "led_init": [("s_ctx", "write", 7, "field")],
        "led_state": [("s_ctx", "read", 9, "field")],
        "led_task": [("g_tick_ms", "read", 13, ""), ("g_button_pressed", "read", 14, ""), ("g_button_pressed", "write", 14, ""), ("s_ctx", "write", 14, "field"), ("s_ctx", "read", 15, "field")],
        "gpio_init": [("s_level", "write", 7, "index")],
        "gpio_write": [("s_level", "write", 8, "index"), ("s_ticks", "read_write", 8, "")],
        "gpio_reset_all": [("s_ticks", "write", 13, ""), ("s_level", "write", 14, "index")],
        "heartbeat_task": [("s_beats", "read_write", 14, "")],
    }
    flat = row("resource string, kind string, line int, via string, function string, path string, protected boolean", *[(*a, f, "src.c", False) for f, xs in used.items() for a in xs])
    near = G.reach(calls, units.select(F.col("unit").alias("root"), F.col("function").alias("node"))).select(F.col("root").alias("unit"), F.col("node").alias("function"))
    accesses = flat.join(near, "function").join(units.select("unit", "unit_kind"), "unit")
    objects = row("object string, module string, code bigint, ro bigint, rw bigint, zi bigint", ("led.o", "app", 800, 64, 16, 32), ("gpio.o", "hal", 400, 0, 0, 24))
    return {"units": units, "calls": calls, "includes": includes, "loops": loops, "accesses": accesses, "objects": objects}
