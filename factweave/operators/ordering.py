"""Window-like operators, paging, set operators and themed slices."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

PAGE, MOST_PAGE, MOST_BYTES = 50, 500, 60_000


def ordinals(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """A stable number of each row within its key, as in loop:<function>#n."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def priority_ranks(units: DataFrame, group: str, priority: str, low_first: bool = False) -> DataFrame:
    """Dense ranks, the same value the same rank, nulls last without a rank."""
    order = F.asc_nulls_last(priority) if low_first else F.desc_nulls_last(priority)
    return units.withColumn("rank", F.when(F.col(priority).isNotNull(), F.dense_rank().over(Window.partitionBy(group).orderBy(order))))


def running_label(lines: DataFrame, key: str, line: str, label: Column) -> DataFrame:
    """The last label at or before each line."""
    return lines.withColumn("label", F.last(label, True).over(Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)))


def case_ends(labels: DataFrame, key: str, line: str, stop: str) -> DataFrame:
    """A case ends before the next label, the last one with its switch."""
    return labels.withColumn("end_line", F.coalesce(F.lead(line).over(Window.partitionBy(key).orderBy(line)) - 1, F.col(stop)))


def due_counts(tasks: DataFrame, span: int) -> DataFrame:
    """(task, due, deferred) of (task, rank, period): due times in [0, span], and how many of them a higher rank (lower number) is due at too."""
    due = tasks.where("period > 0").select("task", "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(span).cast("bigint"), F.col("period").cast("bigint"))).alias("at"))
    # Only the best rank at each time matters, so times are joined with an aggregate and never with each other.
    best = due.groupBy("at").agg(F.min("rank").alias("best"))
    return due.join(best, "at").groupBy("task").agg(F.count("at").alias("due"), F.count_if(F.col("best") < F.col("rank")).alias("deferred"))


def first_touch(visits: DataFrame) -> DataFrame:
    """(root, module, place): modules in the order a root first meets them, by (depth, line)."""
    first = visits.groupBy("root", "module").agg(F.min(F.struct("depth", "line")).alias("at"))
    return first.select("root", "module", F.row_number().over(Window.partitionBy("root").orderBy("at", "module")).alias("place"))


def condition_stack(lines: DataFrame) -> DataFrame:
    """(file, line, condition): the conditions of open #if blocks at each line (file, line, text), joined by ' && '; grouped, as it needs a stack."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stack: list[list[str]] = []
        out = []
        for line, text in sorted(zip(rows["line"], rows["text"])):
            t = text.strip()
            word, _, rest = t[1:].strip().partition(" ") if t.startswith("#") else ("", "", "")
            rest = rest.strip()
            if word in ("if", "ifdef", "ifndef"):
                stack.append([{"if": rest, "ifdef": f"defined({rest})", "ifndef": f"!defined({rest})"}[word]])
            elif word == "elif" and stack:
                stack[-1] = [f"!({c})" if not c.startswith("!(") else c for c in stack[-1]] + [rest]
            elif word == "else" and stack:
                stack[-1] = [f"!({c})" if not c.startswith("!(") else c for c in stack[-1]]
            elif word == "endif" and stack:
                stack.pop()
            out.append((rows["file"].iloc[0], line, " && ".join(c for level in stack for c in level)))
        return pd.DataFrame(out, columns=["file", "line", "condition"])

    return lines.groupBy("file").applyInPandas(run, "file string, line bigint, condition string")


def capped(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """(key, shown, omitted): the first `most` distinct items as text, and how many are left out. Only so many are gathered."""
    w = Window.partitionBy(key)
    ranked = rows.select(key, item).distinct().withColumns({"r": F.row_number().over(w.orderBy(item)), "n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("r") <= most).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", F.col(item).cast("string").alias("v"))))["v"], ",").alias("shown"), F.greatest(F.max("n") - most, F.lit(0)).alias("omitted"))


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = PAGE) -> dict:
    """One page as a dict: items, total, and where more starts. Refuses instead of cutting if the page is too large."""
    limit = min(limit, MOST_PAGE)
    total = rows.count()
    items = [json.loads(r[0]) for r in rows.orderBy(*order).offset(offset).limit(limit).select(F.to_json(F.struct(*rows.columns))).collect()]
    size = len(json.dumps(items).encode())
    if size > MOST_BYTES:
        return {"error": "too-large", "bytes": size, "total": total, "hint": f"ask for at most {max(1, limit * MOST_BYTES // size)} rows"}
    rest = total - offset - len(items)
    return {"items": items, "total": total} | ({"more": {"offset": offset + len(items), "remaining": rest}} if rest > 0 else {})


def natural_pick(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The name of each key whose digit runs are greatest by value."""
    return rows.groupBy(key).agg(F.max_by(name, F.struct(S.natural_key(F.col(name)), F.col(name))).alias(name))


def id_index(*themes: DataFrame) -> DataFrame:
    """(id, theme, place) over (theme, place, id) tables: the first occurrence wins."""
    both = themes[0]
    for t in themes[1:]:
        both = both.unionByName(t)
    return both.groupBy("id").agg(F.min(F.struct("theme", "place")).alias("m")).select("id", "m.theme", "m.place")


def merged_references(shards: list[DataFrame]) -> DataFrame:
    """References of all shards, each (path, line, column) once."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["path", "line", "column"])


def project_partition(includes: DataFrame, symbols: DataFrame, calls: DataFrame, focus: str) -> dict[str, DataFrame]:
    """The tables of a focus glob with one hop of boundary files.

    includes (source, target: files), symbols (symbol_id, path), calls (source, target: symbols). Edges stay if one end is
    in focus; files at the other ends are the boundary.
    """
    rx = S.glob_regex(focus, True)
    kept = includes.where(F.col("source").rlike(rx) | F.col("target").rlike(rx))
    files = kept.select(F.explode(F.array("source", "target")).alias("path")).union(symbols.where(F.col("path").rlike(rx)).select("path")).distinct().withColumn("side", F.when(F.col("path").rlike(rx), "focus").otherwise("boundary"))
    own = symbols.join(files.where("side = 'focus'"), "path", "left_semi")
    a = calls.join(own.select(F.col("symbol_id").alias("source")), "source", "left_semi")
    b = calls.join(own.select(F.col("symbol_id").alias("target")), "target", "left_semi")
    return {"files": files, "includes": kept, "symbols": own, "calls": a.unionByName(b).distinct()}


def at_path(value, path: str):
    """(found, value) of a field path such as a.3.b in nested dicts and lists."""
    for part in path.split(".") if path else []:
        if isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        elif isinstance(value, dict) and part in value:
            value = value[part]
        else:
            return False, None
    return True, value


def find_functions(functions: DataFrame, text: str, region: str = "", most: int = 12) -> DataFrame:
    """The first functions, by name, path and id, that hold the text, in the region and not external."""
    return functions.where(F.col("name").contains(text) & F.col("path").startswith(region) & ~F.col("symbol_id").startswith("external:")).orderBy("name", "path", "symbol_id").limit(most)


def snapshot_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(id, change: added, removed or changed) of two snapshots, by stable id."""
    cols = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*cols).alias("a"), F.lit(True).alias("ha"))
    b = new.select(key, F.struct(*cols).alias("b"), F.lit(True).alias("hb"))
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")
