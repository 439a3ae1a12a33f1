"""Scalar functions of code facts as column expressions; the few that need a stack are Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER = r"^[+-]?(0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+)[uUlL]*$"


def c_integer(text: Column) -> Column:
    """Value of a C integer literal (decimal, octal, hex, binary; sign; u and l suffixes), null if it is none or over 63 bits."""
    body = F.regexp_replace(F.trim(text), "[uUlL]+$", "")
    bare = F.regexp_replace(body, "^[+-]", "")
    sign = F.when(body.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    tail = lambda n, base: F.conv(F.substring(bare, n, 80), base, 10)
    value = F.when(bare.rlike("^0[xX]"), tail(3, 16)).when(bare.rlike("^0[bB]"), tail(3, 2)).when(bare.rlike("^0[0-7]+$"), tail(2, 8)).when(bare.rlike("^(0|[1-9][0-9]*)$"), bare)
    return F.when(F.trim(text).rlike(INTEGER), value.try_cast("bigint") * sign)


def normal_type(text: Column) -> Column:
    """Type text without qualifiers and storage words, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b(const|volatile|restrict|_Atomic|static|extern)\b", " "), r"\s+", " "))


def width_bytes(type_text: Column, word: int = 4) -> Column:
    t = normal_type(type_text)
    bits = F.regexp_extract(t, r"\b(?:__)?u?int(8|16|32|64)(?:_t)?\b", 1).try_cast("int")
    return (
        F.when(type_text.isNull() | (t == "") | t.rlike(r"\]$|\[\s*\d*\s*\]|^(struct|union)\b|\{"), F.lit(None).cast("int"))
        .when(t.contains("*") | t.endswith(")"), F.lit(word))
        .when(bits.isNotNull(), (bits / 8).cast("int"))
        .when(t.rlike(r"\blong\s+long\b|\bdouble\b"), F.lit(8))
        .when(t.rlike(r"\b(char|_Bool|bool|u8|s8|BYTE|byte)\b"), F.lit(1))
        .when(t.rlike(r"\b(short|u16|s16|WORD)\b"), F.lit(2))
        .when(t.rlike(r"\b(int|unsigned|signed|long|float|size_t|u32|s32|DWORD|enum)\b"), F.lit(4))
    )


def atomicity(type_text: Column, word: int = 4) -> Column:
    """single-word, wide, composite or unknown from a type's text."""
    t, w = normal_type(type_text), width_bytes(type_text, word)
    return F.when(type_text.isNull() | (t == ""), F.lit("unknown")).when(t.rlike(r"\]$|\[\s*\d*\s*\]|^(struct|union)\b|\{"), F.lit("composite")).when(w.isNull(), F.lit("unknown")).when(w <= word, F.lit("single-word")).otherwise(F.lit("wide"))


def symbol_path(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, r"^(?:function|variable):(.+):([^:]+)$", 1), F.lit(""))


def symbol_name(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, r"^(?:function|variable):(.+):([^:]+)$", 2), F.lit(""))


def symbol_id(kind: str, path: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), path, name)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def prefixes(path: Column) -> Column:
    """All directory prefixes of a path, the root as '.'."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))


def module_of(path: Column) -> Column:
    """The first two directories."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, F.lit("(root)")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/"))


def default_node(path: Column) -> Column:
    """The architecture node of a file: its first two folders; up to three, but never the file, within components; a file without folder is its own."""
    parts = F.split(path, "/")
    n = F.size(parts)
    take = F.when((parts[0] == "components") & (n > 3), F.least(F.lit(3), n - 1)).otherwise(F.least(F.lit(2), n))
    return F.when(F.coalesce(path, F.lit("")) == "", "unassigned").otherwise(F.array_join(F.slice(parts, 1, take), "/"))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading path parts two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
    return F.aggregate(same, start, lambda s, x: F.struct((s["n"] + F.when(s["go"] & x, 1).otherwise(0)).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])


def leading(path: Column) -> Column:
    """All leading parts of a path, from none to all: '' , 'a', 'a/b', ..."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def negation(condition: Column) -> Column:
    """The C text of the opposite condition."""
    c = F.trim(condition)
    simple = c.rlike(r"^!\s*[A-Za-z_][\w.\->]*(\([^()]*\))?$")
    return F.when(simple, F.regexp_replace(c, r"^!\s*", "")).when(c.rlike(r"^[A-Za-z_][\w.\->]*(\([^()]*\))?$"), F.concat(F.lit("!"), c)).otherwise(F.concat(F.lit("!("), c, F.lit(")")))


def period_ms(value: Column, unit: Column, tick_ms: float = 1.0) -> Column:
    factor = F.when(unit == "tick", F.lit(tick_ms)).when(unit == "us", F.lit(0.001)).when(unit == "s", F.lit(1000.0)).otherwise(F.lit(1.0))
    return value * factor


def loop_maximum(start: Column, limit: Column, comparison: Column, step: Column) -> Column:
    """Most passes of a counted loop with literal bounds; null if the step goes the wrong way."""
    up = comparison.isin("<", "<=", "!=")
    span = F.when(up, limit - start).otherwise(start - limit) + F.when(comparison.isin("<=", ">="), 1).otherwise(0)
    towards = F.when(up, step > 0).otherwise(step < 0)
    return F.when(towards & comparison.isin("<", "<=", ">", ">=", "!="), F.greatest(F.lit(0), F.ceil(span / F.abs(step))).cast("bigint"))


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs by value: each is padded to 12 places."""
    padded = F.regexp_replace(text, r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


def target_triple(driver: Column) -> Column:
    """A clang target of a compiler driver's name. Name parts and targets, first match wins."""
    known = (("arm-none-eabi", "arm-none-eabi"), ("armclang", "arm-none-eabi"), ("armcc", "arm-none-eabi"), ("riscv64", "riscv64-unknown-elf"), ("riscv32", "riscv32-unknown-elf"), ("xtensa", "xtensa-esp-elf"), ("avr-", "avr"), ("aarch64", "aarch64-none-elf"))
    out = F.lit(None).cast("string")
    for part, target in reversed(known):
        out = F.when(F.lower(driver).contains(part), F.lit(target)).otherwise(out)
    return out


def glob_regex(pattern: str, fold_case: bool) -> str:
    """`**` any path, `*` within a part, `?` one character (only in case-sensitive module patterns)."""
    out = []
    for token in re.findall(r"\*\*|\*|\?|[^*?]+", pattern):
        out.append(".*" if token == "**" else "[^/]*" if token == "*" else "[^/]" if token == "?" and not fold_case else "".join(re.escape(c) for c in token))
    return ("(?i)" if fold_case else "") + "^" + "".join(out) + "$"


def name_regex(pattern: str) -> str:
    """A shell name pattern: `*` any characters, `?` one."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def code_lines(text: Column) -> Column:
    """Lines with code once comments are gone."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", "")
    return F.size(F.filter(F.split(bare, "\n"), lambda x: F.trim(x) != "")).cast("bigint")


def total_lines(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n"))).cast("bigint")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


_MASKED = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


@F.pandas_udf(T.StringType())
def mask_comments(text: pd.Series) -> pd.Series:
    """Comments and literals as spaces; length and line breaks stay."""
    return text.map(lambda t: None if t is None else _MASKED.sub(_blank, t))


def _arguments(text: str | None) -> list[str] | None:
    if text is None:
        return None
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[begin:i].strip())
            begin = i + 1
    last = text[begin:].strip()
    return out + [last] if last or out else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_arguments(text: pd.Series) -> pd.Series:
    """Arguments of a call at bracket depth 0."""
    return text.map(_arguments)


def _integer(text: str) -> int | None:
    m = re.fullmatch(r"\s*([+-]?)(0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9][0-9]*)[uUlL]*\s*", text)
    if not m:
        return None
    body = m[2].lower()
    base = 16 if body.startswith("0x") else 2 if body.startswith("0b") else 8 if len(body) > 1 and body[0] == "0" else 10
    return (-1 if m[1] == "-" else 1) * int(body[2:] if base in (16, 2) else body, base)


def fold_text(text: str, constants: dict[str, str], hops: int = 4) -> tuple[int | None, str]:
    """(value, literal | symbol | expression | unresolved) of a constant text with casts, aliases (so many hops) and + - * /."""
    t = text.strip()
    while t.startswith("(") and t.endswith(")") and all(t[1:i].count("(") >= t[1:i].count(")") for i in range(1, len(t))):
        t = t[1:-1].strip()
    if m := re.fullmatch(r"\(\s*[A-Za-z_]\w*(?:\s+\w+)*\s*\*?\s*\)\s*(?![-+*/])(\S.*)", t):
        t = m[1].strip()
    if (value := _integer(t)) is not None:
        return value, "literal"
    if re.fullmatch(r"[A-Za-z_]\w*", t):
        if hops and t in constants:
            value, _ = fold_text(constants[t], constants, hops - 1)
            return value, "symbol" if value is not None else "unresolved"
        return None, "unresolved"
    for ops in ("+-", "*/"):
        depth = 0
        for i in range(len(t) - 1, 0, -1):
            depth += (t[i] in ")]") - (t[i] in "([")
            if depth == 0 and t[i] in ops and t[i - 1] not in "+-*/(":
                a, b = fold_text(t[:i], constants, hops)[0], fold_text(t[i + 1 :], constants, hops)[0]
                if a is None or b is None or t[i] == "/" and b == 0:
                    return None, "unresolved"
                return {"+": a + b, "-": a - b, "*": a * b, "/": int(a / b) if b else 0}[t[i]], "expression"
    return None, "unresolved"


def fold_constants(constants: dict[str, str]):
    """A column function to (value, basis) with these named constants, a small table of one project."""

    @F.pandas_udf(T.StructType([T.StructField("value", T.LongType()), T.StructField("basis", T.StringType())]))
    def fold(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fold_text(t, constants) if t is not None else (None, "unresolved") for t in text], columns=["value", "basis"]).astype({"value": "Int64"})

    return fold


_TAGS = re.compile(r"[@\\](brief|param|returns?|note|warning)\b(?:\[[^\]]*\])?\s*(.*?)(?=(?:[@\\](?:brief|param|returns?|note|warning)\b)|\Z)", re.S)


def _doc(comment: str | None) -> dict:
    text = re.sub(r"(?m)^\s*(?:/\*+[!<]?|\*+/|\*|///?[!<]?)\s?|\*/\s*$", "", comment or "").strip()
    out = {"brief": None, "params": [], "returns": None, "notes": [], "warnings": []}
    clean = lambda s: re.sub(r"\s+", " ", s).strip()
    head = re.split(r"[@\\](?:brief|param|returns?|note|warning)\b", text)[0]
    for tag, body in _TAGS.findall(text):
        if tag == "param":
            name, _, rest = clean(body).partition(" ")
            out["params"].append({"name": name, "text": rest})
        elif tag == "brief":
            out["brief"] = clean(body)
        elif tag.startswith("return"):
            out["returns"] = clean(body)
        else:
            out[tag + "s"].append(clean(body))
    if out["brief"] is None and clean(head):
        out["brief"] = clean(re.split(r"\n\s*\n", head)[0])
    return out


_STRINGS = T.ArrayType(T.StringType())
_PARAMETERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())]))
_DOC = T.StructType([T.StructField("brief", T.StringType()), T.StructField("params", _PARAMETERS), T.StructField("returns", T.StringType()), T.StructField("notes", _STRINGS), T.StructField("warnings", _STRINGS)])


@F.pandas_udf(_DOC)
def documentation(comment: pd.Series) -> pd.DataFrame:
    """Parts of a documentation comment."""
    return pd.DataFrame([_doc(c) for c in comment], columns=["brief", "params", "returns", "notes", "warnings"])


@F.pandas_udf(T.LongType())
def lcm_of(values: pd.Series) -> int:
    """Least common multiple of a group (a grouped aggregate); null if there is no positive value or it needs over 63 bits."""
    from math import lcm

    whole = [int(v) for v in values.dropna().unique() if v > 0]
    out = lcm(*whole) if whole else None
    return out if out is not None and out < 1 << 63 else None
