"""Symbols of documents from recorded outlines, and functions that headers define, opened as calls point to them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.graph import _cut
from ..operators.joins import in_spans

# Symbol kinds of the language server protocol.
FUNCTION_KINDS, VARIABLE_KIND = (6, 9, 12), 13
HEADER_SUFFIXES = (".h", ".hh", ".hpp", ".hxx")

_AT = "struct<line: int, character: int>"
_RANGE = f"struct<start: {_AT}, end: {_AT}>"
NODE = f"array<struct<name: string, detail: string, kind: int, range: {_RANGE}, selectionRange: {_RANGE}, children: string>>"


def outline(answers: DataFrame) -> DataFrame:
    """(path, way, kind, name, detail, line, column, begin_line, end_line, parent_function) of all symbols in the outlines (path, answer).

    An outline is JSON text, a tree of any depth. Each round reads one level and keeps what hangs below as text, so that no
    schema names the depth. way numbers the children on the way down; parent_function is the nearest function above. Lines
    and columns count from 1. An answer that isn't JSON has no symbols.
    """
    level = answers.select("path", F.array().cast("array<int>").alias("way"), F.lit(None).cast("string").alias("parent_function"), F.col("answer").alias("children"))
    levels = []
    while True:
        at = F.coalesce("s.selectionRange", "s.range")
        nodes = level.select("path", "way", "parent_function", F.posexplode(F.from_json("children", NODE)).alias("n", "s")).where("s is not null")
        zero = F.lit(0)
        nodes = nodes.select(
            "path", F.concat("way", F.array("n")).alias("way"), F.coalesce("s.kind", zero).alias("kind"), F.coalesce("s.name", F.lit("")).alias("name"), F.coalesce("s.detail", F.lit("")).alias("detail"), (F.coalesce(at["start"]["line"], zero) + 1).alias("line"),
            (F.coalesce(at["start"]["character"], zero) + 1).alias("column"), (F.coalesce("s.range.start.line", at["start"]["line"], zero) + 1).alias("begin_line"), (F.coalesce("s.range.end.line", at["start"]["line"], zero) + 1).alias("end_line"),
            "parent_function", "s.children",
        )
        nodes = _cut(nodes)
        if nodes.isEmpty():
            break
        levels.append(nodes.drop("children"))
        own = F.when(F.col("kind").isin(*FUNCTION_KINDS), S.symbol_id("function", F.col("path"), F.col("name"))).otherwise(F.col("parent_function"))
        level = nodes.where("children is not null").select("path", "way", own.alias("parent_function"), "children")
    return reduce(DataFrame.unionByName, levels) if levels else nodes.drop("children")


def numbered_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """(path, at, line_text): the lines of texts (path, text), from 1."""
    return texts.select("path", F.posexplode(F.split(text, "\n")).alias("n", "line_text")).select("path", (F.col("n") + 1).alias("at"), "line_text")


def document_functions(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(symbol_id, path, name, detail, line, column, end_line, is_definition): the functions among outline() symbols.

    What has a brace outside comments and strings in its range is a definition. Of equal ids the last in the file stays.
    """
    found = symbols.where(F.col("kind").isin(*FUNCTION_KINDS)).withColumn("symbol_id", S.symbol_id("function", F.col("path"), F.col("name")))
    masked = numbered_lines(texts.select("path", S.mask_comments("text").alias("text")))
    bodies = in_spans(masked.where(F.contains("line_text", F.lit("{"))).select("path", "at"), found.select("path", "way", "begin_line", "end_line"), ["path"], "at", "begin_line", "end_line")
    whole = found.join(bodies.select("path", "way").distinct().withColumn("is_definition", F.lit(True)), ["path", "way"], "left").withColumn("is_definition", F.coalesce("is_definition", F.lit(False)))
    row = F.struct("name", "detail", "line", "column", "end_line", "is_definition")
    return whole.groupBy("symbol_id", "path").agg(F.max_by(row, "way").alias("r")).select("symbol_id", "path", "r.*")


def document_variables(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(symbol_id, path, name, detail, line, column, scope, storage, parent_function, is_global, is_aggregate) of the variables among outline() symbols.

    storage is extern or static if the declaration's text, from its begin to the name's line, has that word, else global;
    inside a function scope is local. is_global: outside functions and not extern; is_aggregate: such a one with = and a brace
    outside comments and strings. Of equal ids the last in the file stays.
    """
    found = symbols.where(F.col("kind") == VARIABLE_KIND).withColumn("symbol_id", S.symbol_id("variable", F.col("path"), F.col("name")))
    word = lambda w: F.col("line_text").rlike(rf"\b{w}\b")
    said = numbered_lines(texts).where(word("extern") | word("static")).select("path", "at", word("extern").alias("extern"), word("static").alias("static"))
    said = in_spans(said, found.select("path", "way", "begin_line", "line"), ["path"], "at", "begin_line", "line").groupBy("path", "way").agg(F.bool_or("extern").alias("extern"), F.bool_or("static").alias("static"))
    signs = numbered_lines(texts.select("path", S.mask_comments("text").alias("text"))).select("path", "at", F.contains("line_text", F.lit("=")).alias("equals"), F.contains("line_text", F.lit("{")).alias("brace")).where("equals or brace")
    signs = in_spans(signs, found.select("path", "way", "begin_line", "end_line"), ["path"], "at", "begin_line", "end_line").groupBy("path", "way").agg(F.bool_or("equals").alias("equals"), F.bool_or("brace").alias("brace"))
    got = found.join(said, ["path", "way"], "left").join(signs, ["path", "way"], "left")
    storage = F.when(F.col("extern"), "extern").when(F.col("static"), "static").otherwise("global")
    outside = F.col("parent_function").isNull() & (storage != "extern")
    row = F.struct(
        "name", "detail", "line", "column", F.when(F.col("parent_function").isNotNull(), "local").otherwise(storage).alias("scope"), storage.alias("storage"), "parent_function", outside.alias("is_global"),
        (outside & F.coalesce(F.col("equals") & F.col("brace"), F.lit(False))).alias("is_aggregate"),
    )
    return got.groupBy("symbol_id", "path").agg(F.max_by(row, "way").alias("r")).select("symbol_id", "path", "r.*")


# Words that stand before a parenthesis and a brace without being functions.
NO_FUNCTIONS = frozenset("if for while switch return sizeof do else defined".split())
FOUND = "array<struct<name: string, line: int, end_line: int, calls: array<string>>>"


def defined_functions(text: str) -> list[dict]:
    """Functions with bodies in masked C text, each with the names its body calls; one pass over the braces."""
    out, depth, pending = [], 0, None
    line, paren, name = 1, 0, None
    for m in re.finditer(r"[{};()]|([A-Za-z_]\w*)(?=\s*\()|\n", text):
        c = m[0]
        if c == "\n":
            line += 1
        elif m[1]:
            if not depth and not paren:
                name = (c, line)
            elif depth and pending and c not in NO_FUNCTIONS:
                pending["calls"].append(c)
        elif c == "(":
            paren += 1
        elif c == ")":
            paren = max(0, paren - 1)
        elif c == ";" and not depth:
            name = None
        elif c == "{":
            if not depth and name and name[0] not in NO_FUNCTIONS:
                pending = {"name": name[0], "line": name[1], "calls": []}
            depth, paren = depth + 1, 0
        elif c == "}":
            depth = max(0, depth - 1)
            if not depth:
                if pending:
                    out.append(pending | {"end_line": line, "calls": list(dict.fromkeys(pending["calls"]))})
                pending = name = None
    return out


def functions_in(text: Column) -> Column:
    """An array of what defined_functions() finds in each masked text."""

    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: defined_functions(t or ""))

    return found(text)


def harvested_headers(calls: DataFrame, known: DataFrame, texts: DataFrame, homes: DataFrame, most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Functions and calls of the headers that unresolved calls lead to: ((symbol_id, path, name, line, end_line, round), (source, target, round)).

    calls: source, target; known: symbol_id of the functions that are there; texts: path, text; homes: name, symbol_id that
    a called name stands for. A header whose function a call has as target is opened once, its functions that nobody knows
    are taken, and what their bodies call is followed in the next round, until no header is new. Only headers opened in a
    round are read in it.
    """
    is_header = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*HEADER_SUFFIXES)
    headers = texts.where(is_header)
    pending = calls.select("source", "target")
    known = _cut(known.select("symbol_id").distinct())
    visited = None
    found, edges = [], []
    while most_rounds is None or len(found) < most_rounds:
        asked = pending.join(known, F.col("target") == F.col("symbol_id"), "left_anti").where(F.col("target").startswith("function:")).select(S.symbol_path(F.col("target")).alias("path")).distinct()
        opened = headers.join(asked if visited is None else asked.join(visited, "path", "left_anti"), "path", "left_semi")
        read = _cut(opened.select("path", functions_in(S.mask_comments("text")).alias("f")))
        if read.isEmpty():
            break
        number = F.lit(len(found) + 1)
        each = read.select("path", F.posexplode("f").alias("n", "s")).select("path", "n", "s.*").withColumn("symbol_id", S.symbol_id("function", F.col("path"), F.col("name")))
        new = _cut(each.join(known, "symbol_id", "left_anti").groupBy("symbol_id", "path", "name").agg(F.max_by(F.struct("line", "end_line", "calls"), "n").alias("s")).select("symbol_id", "path", "name", "s.*", number.alias("round")))
        out = new.select(F.col("symbol_id").alias("source"), F.explode("calls").alias("name")).join(homes.select("name", F.col("symbol_id").alias("target")), "name")
        pending = _cut(out.select("source", "target").distinct())
        found.append(new.drop("calls"))
        edges.append(pending.withColumn("round", number))
        known = _cut(known.unionByName(new.select("symbol_id")))
        seen = read.select("path")
        visited = _cut(seen if visited is None else visited.unionByName(seen))
    spark = calls.sparkSession
    none = (spark.createDataFrame([], "symbol_id string, path string, name string, line int, end_line int, round int"), spark.createDataFrame([], "source string, target string, round int"))
    return (reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, edges)) if found else none
