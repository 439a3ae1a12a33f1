"""Grouping trees over units: folders or clusters, edges lifted to the level where they part, nested order and its replay.

A tree is a table (tree, leaf, path): for each leaf the nodes from the root "" down to itself. All that follows is joins and
arrays over paths. Only the order of one node's children needs a sequence, so a node of a tree is the largest group that a
task ever holds; nodes without edges between their children are ordered by a window.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G

ROOT = ""


def directory_paths(units: DataFrame, region: str = "", regroup: DataFrame | None = None) -> DataFrame:
    """(tree, leaf, path) of units (tree, unit), whose names are paths, by folders.

    The region's folder and those above it are always open, so what they hold hangs from the root itself. regroup (unit,
    folder) puts units into other folders than their own.
    """
    region = region.rstrip("/")
    folder = F.regexp_extract("unit", "^(.*)/[^/]*$", 1)
    if regroup is not None:
        units = units.join(regroup.select("unit", F.col("folder").alias("_put")), "unit", "left")
        folder = F.coalesce("_put", folder)
    parts = F.split(folder, "/")
    ups = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/")))
    shown = F.filter(ups, lambda d: ~F.lit(region + "/").startswith(F.concat(d, F.lit("/"))))
    return units.select("tree", F.col("unit").alias("leaf"), F.concat(F.array(F.lit(ROOT)), shown, F.array("unit")).alias("path"))


def cluster_paths(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(tree, leaf, path) of units by clusters: each hangs from the cluster that most of its members (tree, unit, place, member) are in.

    clusters: tree, member, cluster. Ties go to the cluster of the first member in place; units without any are in cl:none.
    """
    votes = members.join(clusters, ["tree", "member"]).groupBy("tree", "unit", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    won = votes.groupBy("tree", "unit").agg(F.max_by("cluster", F.struct("n", -F.col("first"))).alias("cluster"))
    name = F.concat(F.lit("cl:"), F.coalesce(F.col("cluster").cast("string"), F.lit("none")))
    return members.select("tree", "unit").distinct().join(won, ["tree", "unit"], "left").select("tree", F.col("unit").alias("leaf"), F.array(F.lit(ROOT), name, F.col("unit")).alias("path"))


def visible_rows(paths: DataFrame, open_: list[str] | None = None) -> DataFrame:
    """(tree, leaf, row, path): the row that shows each leaf, the first closed node on its way or the leaf; path ends with the row.

    open_: the groups that are open beside the root; None opens all.
    """
    if open_ is None:
        return paths.select("tree", "leaf", F.col("leaf").alias("row"), "path")
    opened = F.array(*[F.lit(x) for x in open_]).cast("array<string>")
    closed = F.filter(F.slice("path", 2, F.size("path")), lambda x: ~F.array_contains(opened, x))
    row = F.coalesce(F.get(closed, F.lit(0)), F.col("leaf"))
    return paths.select("tree", "leaf", row.alias("row"), F.slice("path", 1, F.array_position("path", row).cast("int")).alias("path"))


def _between(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Each edge (tree, source, target) with the rows a and b that show its ends, and their paths."""
    a = rows.select("tree", F.col("leaf").alias("source"), F.col("row").alias("a"), F.col("path").alias("a_path"))
    b = rows.select("tree", F.col("leaf").alias("target"), F.col("row").alias("b"), F.col("path").alias("b_path"))
    return edges.join(a, ["tree", "source"]).join(b, ["tree", "target"])


def row_edges(edges: DataFrame, rows: DataFrame, measures: tuple[str, ...] = ("weight",)) -> DataFrame:
    """(tree, source, target, measures, pairs, a_path, b_path) of edges (tree, source, target, measures) between the rows that show
    their leaves, summed; edges within a row have it as source and target."""
    got = _between(edges, rows).groupBy("tree", "a", "b").agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("pairs"), F.any_value("a_path").alias("a_path"), F.any_value("b_path").alias("b_path"))
    return got.withColumnsRenamed({"a": "source", "b": "target"})


def lifted(edges: DataFrame, measures: tuple[str, ...] = ("weight",)) -> DataFrame:
    """(tree, group, source, target, measures, pairs): edges between rows summed over the children of the node where their paths part.

    Two paths part at one node only, so each edge counts once.
    """
    differ = F.arrays_zip(F.col("a_path").alias("a"), F.col("b_path").alias("b"))
    at = F.array_position(F.transform(differ, lambda x: x["a"] != x["b"]), True)
    part = edges.where("source <> target").withColumn("at", at.cast("int"))
    kid = lambda c: F.element_at(c, F.col("at"))
    return part.groupBy("tree", F.element_at("a_path", F.col("at") - 1).alias("group"), kid("a_path").alias("source"), kid("b_path").alias("target")).agg(*[F.sum(m).alias(m) for m in measures], F.sum("pairs").alias("pairs"))


def children(rows: DataFrame) -> DataFrame:
    """(tree, group, child, depth, rows): each node of the shown tree below the root, with the rows under it."""
    steps = F.transform(F.sequence(F.lit(2), F.size("path")), lambda i: F.struct(F.element_at("path", i - 1).alias("group"), F.element_at("path", i).alias("child"), (i - 2).alias("depth")))
    shown = rows.groupBy("tree", "row").agg(F.any_value("path").alias("path"))
    return shown.select("tree", F.inline(steps)).groupBy("tree", "group", "child").agg(F.any_value("depth").alias("depth"), F.count(F.lit(1)).alias("rows"))


STEPS = "tree {tree}, group string, child string, kind string, step int, block int, base int"


def peeled(kids: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree, group, child, kind, step, block, base) of the children (tree, group, child) under edges (tree, group, source, target, weight).

    step counts the removals: sinks go to the bottom, sources to the top, and where a cycle is torn block says how many
    children are left. base is the place that follows, from 0.
    """
    busy = edges.select("tree", "group").distinct()
    w = Window.partitionBy("tree", "group").orderBy("child")
    # Without edges all are sinks, which fill the bottom upwards by name.
    idle = kids.join(busy, ["tree", "group"], "left_anti").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tree", "group"))).withColumn("step", F.row_number().over(w) - 1)
    idle = idle.select("tree", "group", "child", F.lit("sink").alias("kind"), F.col("step").cast("int").alias("step"), F.lit(None).cast("int").alias("block"), (F.col("n") - 1 - F.col("step")).cast("int").alias("base"))
    none = F.lit(None).cast("string")
    both = kids.join(busy, ["tree", "group"], "left_semi").select("tree", "group", F.col("child").alias("a"), none.alias("b"), F.lit(0.0).alias("weight"))
    both = both.unionByName(edges.select("tree", "group", F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").cast("double").alias("weight")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weights: dict[tuple, float] = defaultdict(float)
        for a, b, x in zip(rows["a"], rows["b"], rows["weight"]):
            if b is not None:
                weights[a, b] += x
        nodes = rows.loc[rows["b"].isna(), "a"].tolist()
        order, steps, _, _ = G.peel(nodes, dict(weights))
        place = {n: i for i, n in enumerate(order)}
        head = (rows["tree"].iloc[0], rows["group"].iloc[0])
        return pd.DataFrame([(*head, n, kind, i, len(nodes) - i if kind == "tear" else None, place[n]) for i, (kind, n) in enumerate(steps)], columns=["tree", "group", "child", "kind", "step", "block", "base"]).astype({"block": "Int32"})

    return both.groupBy("tree", "group").applyInPandas(run, STEPS.format(tree=dict(kids.dtypes)["tree"])).unionByName(idle)


def replayed(steps: DataFrame, k: int) -> DataFrame:
    """(tree, group, child, place, pending): the order after k removals: the top so far, what is left by name, the bottom so far."""
    done = F.col("step") < k
    zone = F.when(~done, 1).when(F.col("kind") == "sink", 2).otherwise(0)
    key = F.when(~done, 0).when(F.col("kind") == "sink", -F.col("step")).otherwise(F.col("step"))
    w = Window.partitionBy("tree", "group").orderBy(zone, key, "child")
    return steps.select("tree", "group", "child", (F.row_number().over(w) - 1).alias("place"), (~done).alias("pending"))


def tree_order(paths: DataFrame, edges: DataFrame, open_: list[str] | None = None, top: list[str] = (), bottom: list[str] = (), invert: list[tuple[str, str]] = ()) -> DataFrame:
    """(tree, group, child, depth, kind, step, block, place, first, last): the nested order of a tree's shown nodes.

    Within each group the children are peeled; those that top and bottom name stand first and last, in that order. Edges
    between rows that invert names as (source, target) count for nothing. place is that among the group's children, first
    and last are the rows under the child in the order of the whole tree, from 0.
    """
    rows = visible_rows(paths, open_)
    # Lifted as they are: rows of a large tree have nearly as many pairs as there are edges, groups have few.
    between = _between(edges, rows).select("tree", F.col("a").alias("source"), F.col("b").alias("target"), "weight", F.lit(1).alias("pairs"), "a_path", "b_path")
    for a, b in invert:
        between = between.where(~((F.col("source") == a) & (F.col("target") == b)))
    kids = children(rows)
    steps = peeled(kids.select("tree", "group", "child"), G._cut(lifted(between)))
    pins = F.create_map(*[F.lit(x) for i, n in enumerate(bottom) for x in (n, i + 1)], *[F.lit(x) for i, n in enumerate(top) for x in (n, i - len(top))]) if top or bottom else F.lit(None)
    pin = F.coalesce(pins[F.col("child")], F.lit(0)) if top or bottom else F.lit(0)
    w = Window.partitionBy("tree", "group").orderBy(pin, "base")
    own = kids.join(steps, ["tree", "group", "child"]).withColumn("place", (F.row_number().over(w) - 1).cast("int"))
    own = own.withColumn("before", F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = G._cut(own)
    # A node's first row is the sum, over the nodes on its path, of the rows of the siblings before them.
    nodes = rows.select("tree", F.explode(F.transform(F.sequence(F.lit(2), F.size("path")), lambda i: F.slice("path", 1, i))).alias("way")).distinct()
    nodes = nodes.select("tree", F.element_at("way", -1).alias("node"), F.explode(F.slice("way", 2, F.size("way"))).alias("child"))
    first = nodes.join(own.select("tree", "child", "before"), ["tree", "child"]).groupBy("tree", F.col("node").alias("child")).agg(F.sum("before").alias("first"))
    return own.join(first, ["tree", "child"]).select("tree", "group", "child", "depth", "kind", "step", "block", "place", "first", (F.col("first") + F.col("rows") - 1).alias("last"))


def feedback_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(tree, group, source, target, weight, back) of lifted edges: whether each goes against the order of its group."""
    a = order.select("tree", "group", F.col("child").alias("source"), F.col("place").alias("a"))
    b = order.select("tree", "group", F.col("child").alias("target"), F.col("place").alias("b"))
    return edges.join(a, ["tree", "group", "source"]).join(b, ["tree", "group", "target"]).select("tree", "group", "source", "target", "weight", (F.col("b") < F.col("a")).alias("back"))
