"""Each branch of a rule holds at least a hundredth of a query's rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.plans.registry import QUERIES

DATA = "/root/testdata/sf0.01"
CASES = {
    "slot_match": ("weak_match", {False, True}),
    "external_refs": ("split_part(target, ':', 1)", {"external", "function"}),
    "object_sources": ("match", {"functions", "name", "none"}),
    "enum_of_states": ("enum", None),
    "nearest_blocking": ("kind || hops", {f"{k}{n}" for k in ("wait", "delay") for n in range(4)}),
    "worst_of_units": ("worst", {"conflict", "pollution", "mismatch", "shared"}),
    "function_domains": ("domain", {"isr", "task", "callback", "timer", "main", "mixed"}),
    "execution_units": ("rule || if(also > 0, '+', '')", {"rtos.create", "rtos.create+", "ast.call", "ast.call+", "arduino.loop", "arduino.loop+"}),
    "host_units": ("confidence", {"high", "medium"}),
    "innermost_hosts": ("confidence", {"high", "medium"}),
    "fsm_machines": ("confidence", {"high", "medium"}),
    "merged_machines": ("confidence || if(parts > 1, '+', '')", {"high+", "medium+", "low+"}),
    "deduplicated_edges": ("contains(lines, ',')", {False, True}),
    "pruned_calls": ("wanted", None),
    "fsm_edges": ("kind", {"self", "exit", "next", "jump", "back"}),
    "fsm_statistics": ("verdict", {"dispatch", "sequential", "mesh", "mixed"}),
    "state_orders": ("if(terminal, 'end', if(via_helper, 'helper', 'on'))", {"end", "helper", "on"}),
    "condition_atoms": ("tag", {"if", "else", "or", "break"}),
    "document_functions": ("is_definition", {True, False}),
    "document_variables": ("concat(scope, '/', storage, if(is_aggregate, '/aggregate', ''))", {"local/static", "local/global", "static/static/aggregate", "global/global", "extern/extern"}),
    "round_chains": ("calls", {1, 2, 3, 4, 5, 6, 7}),
    "argument_sections": ("concat_ws('/', rule, argument)", {"lock/m0", "lock/m1", "disable"}),
    "time_base": ("concat_ws('/', kind, if(kind = 'systick', basis, null), if(value is null, 'open', null))", {"tick-counter", "timeout-loop", "timeout-loop/open"}),
    "matrix_rows": ("concat_ws('/', coalesce(confidence, 'none'), if(wake, 'wake', null))", {"high", "medium", "low", "none", "none/wake"}),
    "main_phases": ("phase", {"run", "init"}),
    "tree_order": ("kind", {"sink", "source", "tear"}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_each_branch_has_rows(spark, name):
    branch, want = CASES[name]
    count = Counter({r[0]: r[1] for r in QUERIES[name](spark, DATA).groupBy(F.expr(branch).alias("b")).count().collect()})
    large = {k for k, n in count.items() if n >= 0.01 * count.total()}
    assert large >= want if want else len(large) > 2, count


def test_all_measures_and_cycles(spark):
    own = F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string"), F.lit(".c"))
    found = QUERIES["variable_symbols"](spark, DATA).join(spark.read.parquet(f"{DATA}/events.parquet").withColumnRenamed("event_id", "access_id"), "access_id")
    assert all(n > 100 for _, n in found.groupBy(F.split_part("symbol_id", F.lit(":"), F.lit(2)) == own).count().collect()) and found.select(F.split_part("symbol_id", F.lit(":"), F.lit(2)) == own).distinct().count() == 2
    total = QUERIES["edge_measures"](spark, DATA).groupBy().sum().first()
    assert min(total) >= 0.01 * sum(total)
    assert QUERIES["unreached_cycles"](spark, DATA).count() > 1000
    base = {(r["kind"], r["basis"]) for r in QUERIES["time_base"](spark, DATA).select("kind", "basis").distinct().collect()}
    assert {("core-clock", "initializer"), ("systick", "expression"), ("systick", "unresolved")} <= base
    assert QUERIES["draft_module_ids"](spark, DATA).select("level").distinct().count() == 5
    assert QUERIES["pruned_calls"](spark, DATA).select("round").distinct().count() > 1
