"""Rounds and call chains against a plain recursive version."""

import random

import pytest

from factweave.operators import rounds as R
from factweave.plans.registry import QUERIES


def plain_badge(n):
    return chr(65 + n % 26) + (str(n // 26) if n >= 26 else "")


class Plain:
    def __init__(self, calls, loops, blocks, waits, iterations):
        self.calls, self.loops, self.blocks, self.waits, self.iterations = calls, loops, blocks, waits, iterations

    def tops(self, f):
        own = [x for x in self.loops if x[0] == f and not x[4]]
        return sorted(x for x in own if not any(y[1] < x[1] and x[2] <= y[2] for y in own))

    def shown(self, f):
        return [x for x in self.tops(f) if self.iterations or x[3] != "iter"]

    def chain(self, f, visited, budget):
        """(function, loops, [(line, below)]) or None if no loop lies that way."""
        if f in visited or not budget:
            return None
        below, seen = [], set()
        for _, callee, line, kind in sorted((x for x in self.calls if x[0] == f), key=lambda x: (x[2], x[1])):
            if kind == "register" or callee in seen or any(x[1] <= line <= x[2] for x in self.tops(f)):
                continue
            seen.add(callee)
            sub = self.chain(callee, visited | {f}, budget - 1)
            if sub:
                below.append((line, sub))
        return (f, self.shown(f), below) if below or self.shown(f) else None

    def round(self, unit, f, lo, hi, most_levels, most_calls):
        known, out = {}, []
        boxes = [("", f, lo, hi, [f])]
        for level in range(most_levels):
            following = []
            for name, f, lo, hi, visited in boxes:
                rows = []

                def mark(loops, way):
                    told = []
                    for g, a, b, *_ in loops:
                        if (g, a) in known:
                            told.append(known[g, a] + "*")
                            continue
                        known[g, a] = plain_badge(len(known))
                        told.append(known[g, a])
                        following.append((known[g, a], g, a, b, way + [g]))
                    return ",".join(told)

                inside = sorted({x for x in self.blocks if x[0] == f and x[3] != "do" and lo <= x[1] and x[2] <= hi and not (x[1] <= lo and x[2] >= hi)}, key=lambda x: (x[1], -x[2], x[3]))
                steps = sorted({(x[2], x[1]) for x in self.calls if x[0] == f and lo <= x[2] <= hi})
                rest = sorted({(x[1], x[2]) for x in self.waits if x[0] == f and lo <= x[1] <= hi})
                loop_of = lambda x: [y for y in self.loops if x[3] in ("while", "for") and not y[4] and y[:3] == x[:3]][:1]
                frames = [x for x in inside if any(x[1] <= line <= x[2] for line, _ in steps + rest) or any(y[3] not in ("iter", "macro") for y in loop_of(x))]
                events = [(x[1], 0, -x[2], x[3] + (" " + x[4] if x[4] else ""), x) for x in frames] + [(line, 1, 0, g, None) for line, g in steps] + [(line, 2, 0, g, None) for line, g in rest]
                for line, what, _, label, x in sorted(events, key=lambda e: e[:4]):
                    if what == 0:
                        above = frames[: frames.index(x)]
                        rows.append(("frame", label, line, sum(y[1] <= line <= y[2] for y in above), mark([y for y in loop_of(x) if self.iterations or y[3] != "iter"], visited)))
                        continue
                    indent = sum(y[1] <= line <= y[2] for y in frames)
                    if what == 2:
                        rows.append(("yield", label, line, indent, ""))
                        continue
                    entered = any(c[0] == f and c[1] == label and c[2] == line and c[3] != "register" for c in self.calls)
                    tree = self.chain(label, set(visited), most_calls) if entered else None
                    rows.append(("step", label, line, indent, mark(tree[1], visited) if tree else ""))

                    def below(node, way, depth):
                        for at, sub in node[2]:
                            rows.append(("chain", sub[0], at, depth, mark(sub[1], way + [node[0]])))
                            below(sub, way + [node[0]], depth + 1)

                    if tree:
                        below(tree, visited, indent + 1)
                out += [(unit, level, name, i, *r) for i, r in enumerate(rows)]
            boxes = following
        return out


def facts(seed):
    r = random.Random(seed)
    names = [f"f{k}" for k in range(14)]
    loops, blocks = set(), set()
    for f in names:
        for a in (10, 30):
            if r.random() < 0.5:
                cls, macro = r.choice(["iter", "busy-var", "wait"]), r.random() < 0.2
                loops.add((f, a, a + 12, cls, macro))
                blocks.add((f, a, a + 12, r.choice(["while", "for"]), None))
                if r.random() < 0.6:
                    loops.add((f, a + 3, a + 9, r.choice(["iter", "wait"]), False))
                    blocks.add((f, a + 3, a + 9, "while", "x"))
        for a in (5, 26):
            if r.random() < 0.4:
                blocks.add((f, a, a + 20, "if", "ready"))
    calls = {(f, r.choice(names), r.randrange(1, 60), r.choice(["call", "call", "register", "dispatch"])) for f in names for _ in range(4)}
    waits = {(f, r.randrange(1, 60), "delay") for f in names for _ in range(1)}
    return names, sorted(calls), sorted(loops), sorted(blocks, key=str), sorted(waits)


@pytest.mark.parametrize("seed, levels, most, iterations", [(1, 4, 7, False), (3, 2, 3, True)])
def test_round_boxes(spark, seed, levels, most, iterations):
    names, calls, loops, blocks, waits = facts(seed)
    units = [(f"u{i}", f, *span) for i, (f, span) in enumerate([(names[0], (1, 60)), (names[1], (1, 60)), (names[2], (10, 42))])]
    got = R.round_boxes(
        spark.createDataFrame(units, "unit string, function string, from_line int, to_line int"), spark.createDataFrame(calls, "caller string, callee string, line int, kind string"),
        spark.createDataFrame(loops, "function string, line int, end_line int, class string, from_macro boolean"), spark.createDataFrame(blocks, "function string, line int, end_line int, kind string, condition string"),
        spark.createDataFrame(waits, "function string, line int, callee string"), levels, most, iterations,
    )
    plain = Plain(calls, loops, blocks, waits, iterations)
    want = [x for u in units for x in plain.round(*u, levels, most)]
    assert len({x[1] for x in want}) > 1 and any("*" in x[-1] for x in want)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_badges(spark):
    assert [r[0] for r in spark.range(60).select(R.badge(__import__("pyspark.sql.functions").sql.functions.col("id"))).collect()] == [plain_badge(n) for n in range(60)]


def test_chains_of_all_lengths(spark):
    """What the registered query binds has chains of 1, 3 and 7 calls, and steps that lead nowhere."""
    got = {r["calls"] for r in QUERIES["round_chains"](spark, "/root/testdata/sf0.001").select("calls").distinct().collect()}
    assert {1, 3, 7} <= got and max(got) == 7
