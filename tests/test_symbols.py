"""Condition atoms, outlines of documents and harvested headers against plain versions."""

import json
import random
import time

import pytest
from factweave.functions import conditions as K
from factweave.operators import derive as D
from factweave.sources import symbols as Y


def made_condition(r, depth):
    """(text, tree) of a random condition; a tree is an atom's text or (operator, trees)."""
    if not depth or r.random() < 0.3:
        atom = r.choice(["a", "!b", "f(x, (y && z))", "p->q[i || 1]", "c == ')'", 's != "&& ("', "n < 3", "g()", "{1 && 2}"])
        return atom, atom
    op = r.choice(["&&", "||"])
    parts = [made_condition(r, depth - 1) for _ in range(r.randint(2, 4))]
    text = f" {op} ".join(f"({' ' * r.randrange(2)}{t})" if isinstance(tree, tuple) or r.random() < 0.2 else t for t, tree in parts)
    return (f"(({text}))" if r.random() < 0.3 else text), (op, [tree for _, tree in parts])


def test_atoms_of_random_conditions():
    r = random.Random(3)
    seen = set()
    for _ in range(500):
        text, tree = made_condition(r, 4)
        for must in (True, False):
            got = K.atoms(text, must)
            primary = "&&" if must else "||"
            operator = tree[0] if isinstance(tree, tuple) else primary

            def flat(t):
                return [x for sub in t[1] for x in flat(sub)] if isinstance(t, tuple) and t[0] == operator else [t]

            want = flat(tree)
            assert [o for _, o in got] == [operator != primary and len(want) > 1] * len(want)
            # Each atom is the text of its tree: a leaf word for word, else it has the tree's own outermost operands.
            for (atom, _), t in zip(got, want):
                if isinstance(t, str):
                    assert atom == t
                else:
                    assert len(K.atoms(atom, t[0] == "&&")) >= 2
            seen.add((len(want) > 1, operator == primary))
    assert seen == {(False, True), (True, False), (True, True)}


@pytest.mark.parametrize("text, must, want", [
    ("a && b || c", True, [("a && b", True), ("c", True)]), ("a && b || c", False, [("a && b", False), ("c", False)]), ("", True, [("", False)]), ("((((x))))", True, [("x", False)]), ("a && ", True, [("a", False), ("", False)]),
    ("(a", True, [("(a", False)]), ("a) && b", True, [("a)", False), ("b", False)]), ("(a) && (b)", True, [("a", False), ("b", False)]), ("'&&' && x", True, [("'&&'", False), ("x", False)]), ("a & b && c | d", True, [("a & b", False), ("c | d", False)]),
])
def test_atoms_of_odd_texts(text, must, want):
    assert K.atoms(text, must) == want


def test_atoms_in_linear_time():
    began = time.time()
    for text in ("(" * 300_000 + "a" + ")" * 300_000, "(" * 500_000, "a && " * 300_000, "(a || " * 200_000 + "b" + ")" * 200_000):
        K.atoms(text, True)
    assert time.time() - began < 30


def test_atom_rows(spark):
    steps = spark.createDataFrame([(1, "if", "a && (b || c)"), (2, "else", "a && !b"), (3, "guard-return", "x || y"), (4, "if", "p || q || r"), (5, "else", None), (6, "else", "m || n == 1")], "id int, kind string, text string")
    got = sorted(tuple(x) for x in D.atom_rows(steps, "id").collect())
    assert got == [
        (1, 1, "if", "a"), (1, 2, "if", "b || c"), (2, 1, "else", "!a"), (2, 2, "or", "b"), (3, 1, "return", "x"), (3, 2, "return", "y"), (4, 1, "if", "p"), (4, 2, "or", "q"), (4, 3, "or", "r"), (6, 1, "else", "!m"), (6, 2, "else", "!(n == 1)"),
    ]


def node(name, kind, a, b, at=None, children=None):
    line = lambda n: {"line": n, "character": 2}
    out = {"name": name, "kind": kind, "range": {"start": line(a), "end": line(b)}}
    if at is not None:
        out["selectionRange"] = {"start": {"line": at, "character": 7}, "end": line(at)}
    return out | ({} if children is None else {"children": children})


def test_outline_of_any_depth(spark):
    deep = node("leaf", 13, 9, 9)
    for k in range(12):
        deep = node(f"l{k}", (3, 5, 12, 23)[k % 4], 0, 9, 1, [deep, node(f"x{k}", 13, 2, 3, 3)])
    answers = [("a.c", json.dumps([deep])), ("b.c", "not json"), ("c.c", None), ("d.c", "[]"), ("e.c", json.dumps([node("f", 12, 0, 0), {"name": "g"}, node("f", 12, 4, 6, 5)]))]
    texts = [("a.c", "extern\nint x;\nint\nstatic int y = {\n" + "}\n" * 7), ("e.c", "int f(); // {\n\n\n\nint f()\n{\n}\n"), ("b.c", ""), ("z.c", None)]
    df, files = spark.createDataFrame(answers, "path string, answer string"), spark.createDataFrame(texts, "path string, text string")
    got = {(r["path"], tuple(r["way"])): r for r in Y.outline(df).collect()}
    want = {}

    def visit(path, x, way, parent):
        at = (x.get("selectionRange") or x.get("range") or {}).get("start") or {}
        want[path, way] = (x.get("kind", 0), x["name"], at.get("line", 0) + 1, at.get("character", 0) + 1, parent)
        own = f"function:{path}:{x['name']}" if x.get("kind") in (6, 9, 12) else parent
        for i, c in enumerate(x.get("children") or []):
            visit(path, c, (*way, i), own)

    for path, answer in answers:
        if answer and answer[0] == "[":
            for i, x in enumerate(json.loads(answer)):
                visit(path, x, (i,), None)
    assert {k: (r["kind"], r["name"], r["line"], r["column"], r["parent_function"]) for k, r in got.items()} == want and max(len(w) for _, w in want) == 13
    functions = {r["symbol_id"]: r for r in Y.document_functions(Y.outline(df), files).collect()}
    assert (functions["function:e.c:f"]["line"], functions["function:e.c:f"]["is_definition"]) == (6, True)
    variables = {r["name"]: r for r in Y.document_variables(Y.outline(df), files).collect()}
    assert variables["leaf"]["scope"] == "local" and variables["x11"]["scope"] == "static" and variables["x11"]["is_aggregate"] and not variables["x0"]["is_global"]


def test_functions_in_text():
    text = "int a[] = { f(1) };\nstatic int one(int x) {\n  if (x) { two(x); }\n  return two(three (1));\n}\nint decl(void);\nvoid __attribute__((used)) last(void)\n{\n}\nstruct s { int (*cb)(void); };\nint broken(void) { four();"
    assert Y.defined_functions(text) == [{"name": "one", "line": 2, "calls": ["two", "three"], "end_line": 5}, {"name": "last", "line": 7, "calls": [], "end_line": 9}]


def test_harvest_against_a_plain_loop(spark):
    r = random.Random(9)
    names = [f"f{k}" for k in range(40)]
    home = {n: f"inc/{n[1:]}.{'h' if r.random() < 0.8 else 'c'}" for n in names}
    home["f7"] = home["f8"]
    body = {n: [names[k] for k in range(40) if k > int(n[1:]) and r.random() < 0.07] + (["f2"] if n == "f5" else []) for n in names}
    texts = {}
    for n in names:
        texts[home[n]] = texts.get(home[n], "") + f"/* x() {{ */ inline int {n}(void) {{ {' '.join(c + '();' for c in body[n])} }}\nint other(int);\n"
    sid = lambda n: f"function:{home[n]}:{n}"
    calls = [("function:m.c:main", sid(n)) for n in ("f0", "f1", "f3", "f8")] + [("function:m.c:main", "function:nowhere.h:q"), ("function:m.c:main", "variable:inc/1.h:v")]
    known = {"function:m.c:main", sid("f1")}
    pending, have, visited, rounds, plain = [t for _, t in calls], set(known), set(), 0, {}
    while True:
        paths = {t.split(":")[1] for t in pending if t not in have and t.startswith("function:")} - visited
        paths = {p for p in paths if p in texts and p.endswith(".h")}
        if not paths:
            break
        rounds += 1
        visited |= paths
        pending = []
        for n in names:
            if home[n] in paths and sid(n) not in have:
                plain[sid(n)] = rounds
                pending += [sid(c) for c in body[n]]
        have |= set(plain)
    got, edges = Y.harvested_headers(
        spark.createDataFrame(calls, "source string, target string"), spark.createDataFrame([(k,) for k in known], "symbol_id string"), spark.createDataFrame(list(texts.items()), "path string, text string"),
        spark.createDataFrame([(n, sid(n)) for n in names], "name string, symbol_id string"),
    )
    assert {x["symbol_id"]: x["round"] for x in got.collect()} == plain and rounds >= 3
    assert {(x["source"], x["target"]) for x in edges.collect()} == {(sid(n), sid(c)) for n in names if sid(n) in plain for c in body[n]}
