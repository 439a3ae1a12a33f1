"""Conditions in C text as rows: split at the connectives that no bracket or quote hides."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSES = {")": "(", "]": "[", "}": "{"}
ATOMS = "array<struct<text: string, any_of: boolean>>"


def brackets(text: str) -> dict[int, int]:
    """Where each opening bracket closes and each quoted string ends, by place; what is never closed is left out."""
    out, open_, at = {}, [], 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            end = at + 1
            while end < len(text) and text[end] != c:
                end += 1 + (text[end] == "\\")
            if end < len(text):
                out[at] = at = end
        elif c in "([{":
            open_.append(at)
        elif c in CLOSES and open_ and text[open_[-1]] == CLOSES[c]:
            out[open_.pop()] = at
        at += 1
    return out


def unwrapped(text: str, lo: int, hi: int, closes: dict[int, int]) -> tuple[int, int]:
    """The range without blanks around it and without parentheses around all of it."""
    while True:
        while lo < hi and text[lo].isspace():
            lo += 1
        while lo < hi and text[hi - 1].isspace():
            hi -= 1
        if lo < hi and text[lo] == "(" and closes.get(lo) == hi - 1:
            lo, hi = lo + 1, hi - 1
        else:
            return lo, hi


def connectives(text: str, lo: int, hi: int, closes: dict[int, int]) -> list[tuple[int, str]]:
    """(place, && or ||) outside brackets and quotes; brackets are stepped over whole."""
    out, at = [], lo
    while at < hi:
        if at in closes and closes[at] < hi:
            at = closes[at] + 1
        elif text[at : at + 2] in ("&&", "||") and at + 2 <= hi:
            out.append((at, text[at : at + 2]))
            at += 2
        else:
            at += 1
    return out


def atoms(text: str, must_hold: bool) -> list[tuple[str, bool]]:
    """(atom, any_of): the operands of the condition's outermost connective, and of those operands that have the same one.

    A condition that must hold falls apart at && (all of them), one that must not at || (none of them). If the outermost
    connective is the other one, its operands are alternatives: any_of. || binds weaker than &&. In time linear in the text,
    as brackets are matched once and inner ones are stepped over.
    """
    closes = brackets(text)
    lo, hi = unwrapped(text, 0, len(text), closes)
    found = {op for _, op in connectives(text, lo, hi, closes)}
    primary = "&&" if must_hold else "||"
    operator = "||" if "||" in found else "&&" if found else primary
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = unwrapped(text, *todo.pop(), closes)
        cuts = connectives(text, lo, hi, closes)
        weakest = "||" if any(op == "||" for _, op in cuts) else "&&"
        if not cuts or weakest != operator:
            out.append(text[lo:hi])
            continue
        ends = [at for at, op in cuts if op == operator]
        todo += [(a, b) for a, b in zip([lo, *(e + 2 for e in ends)], [*ends, hi])][::-1]
    return [(a, operator != primary and len(out) > 1) for a in out]


def condition_atoms(condition: Column, must_hold: Column) -> Column:
    """An array of (text, any_of) for each condition; null conditions have none."""

    @F.pandas_udf(ATOMS)
    def split(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, holds in parts:
            yield pd.Series([[] if t is None else [{"text": a, "any_of": o} for a, o in atoms(t, bool(h))] for t, h in zip(texts, holds)])

    return split(condition, F.coalesce(must_hold, F.lit(True)))
