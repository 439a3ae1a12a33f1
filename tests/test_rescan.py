"""Incremental scans, recorded answers, caches, and derivations over precedence and counts, against plain versions."""

import json
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.operators import aggregates as A
from factweave.operators import joins as J
from factweave.sources import recorded as R
from factweave.streaming import rescan as N
from factweave.streaming import snapshots as S


def closure(files, path):
    seen, todo = {path}, [path]
    while todo:
        for name in re.findall(r'#include "([^"]+)"', files[todo.pop()]):
            if (p := name) in files and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def plain_facts(files):
    return sorted((u, name, p, n) for u in files if u.endswith(".c") for p in closure(files, u) for n, line in enumerate(files[p].split("\n"), 1) for name in re.findall(r"^#define (\w+)", line))


def test_rescans_equal_full_scans_and_touch_only_what_an_edit_reaches(spark, tmp_path):
    r = random.Random(4)
    names = [f"u{k}.c" for k in range(8)] + [f"h{k}.h" for k in range(8)]

    def text(name):
        return "\n".join([f'#include "{r.choice(names[8:])}"' for _ in range(r.randrange(3))] + [f"#define M{r.randrange(30)} 1" for _ in range(r.randrange(3))])

    files = {n: text(n) for n in names if r.random() < 0.8}
    target, derived = str(tmp_path / "project"), []

    def derive(rows):
        derived.append({x[0] for x in rows.select("unit").distinct().collect()})
        return N.visible_macros(rows)

    before: dict = {}
    for step in range(5):
        now = spark.createDataFrame(list(files.items()), "path string, text string")
        touched = {x["unit"]: x["what"] for x in N.rescan(now, spark.createDataFrame([], "path string, ordinal int, dir string"), target, derive, buckets=4).collect()}
        assert sorted(tuple(x) for x in N.facts(spark, target).select("unit", "name", "path", "line").collect()) == plain_facts(files)
        changed = {p for p in files.keys() | before.keys() if files.get(p) != before.get(p)}
        reach = lambda fs, u: closure(fs, u) | {n for p in closure(fs, u) for n in re.findall(r'#include "([^"]+)"', fs[p])} if u in fs else set()
        may = {u for u in files.keys() | before.keys() if u.endswith(".c") and (reach(files, u) | reach(before, u)) & changed}
        assert set(touched) <= may and {u for u, w in touched.items() if w == "derived"} == derived[-1] and {u for u, w in touched.items() if w == "removed"} == {u for u in before if u.endswith(".c") and u not in files}
        if step == 2:
            assert not touched
        before = dict(files)
        if step != 1:
            for n in r.sample(names, 2):
                if r.random() < 0.3:
                    files.pop(n, None)
                else:
                    files[n] = text(n)
    for n in [n for n in files if n.endswith(".c")]:
        del files[n]
    N.rescan(spark.createDataFrame(list(files.items()) or [("x.h", "")], "path string, text string"), spark.createDataFrame([], "path string, ordinal int, dir string"), target, N.visible_macros, buckets=4)
    assert N.facts(spark, target).count() == 0


def test_recorded_answers(spark, tmp_path):
    folder = tmp_path / "answers" / "deep"
    folder.mkdir(parents=True)
    say = lambda method, **more: json.dumps({"method": method, **more})
    (folder / "a.jsonl").write_text("\n".join([say("textDocument/hover", uri="file:///é.c", result=None), "", say("textDocument/documentSymbol", params={"textDocument": {"uri": "u"}}, result=[{"name": "x"}])]) + "\n")
    (folder / "b.jsonl").write_bytes(b'{"method": "textDocument\\/hover", "result": 1}\n{"method": \n[1, 2]\n\xff\xfe\n{"result": 3}')
    (folder / "empty.jsonl").write_text("")
    (folder / "other.log").write_text(say("textDocument/hover"))
    R.register(spark)
    got = spark.read.format("answers").load(str(tmp_path / "answers"))
    assert got.schema.simpleString() == "struct<" + R.SCHEMA.replace(" ", "").replace("string", ":string").replace("long", ":bigint") + ">"
    rows = {(x["file"], x["line"]): x for x in got.collect()}
    assert set(rows) == {("a.jsonl", 1), ("a.jsonl", 3), ("b.jsonl", 1), ("b.jsonl", 2), ("b.jsonl", 3), ("b.jsonl", 4), ("b.jsonl", 5)}
    assert rows["a.jsonl", 3]["uri"] == "u" and rows["a.jsonl", 3]["result"] == '[{"name":"x"}]' and rows["a.jsonl", 1]["uri"] == "file:///é.c" and rows["a.jsonl", 1]["result"] is None
    assert [rows["b.jsonl", k]["error"] is None for k in range(1, 6)] == [True, False, False, False, False]
    hover = got.where("method = 'textDocument/hover'")
    assert sorted((x["file"], x["line"]) for x in hover.collect()) == [("a.jsonl", 1), ("b.jsonl", 1)]
    assert sorted(x["file"] for x in got.where(F.col("method").isin("textDocument/hover", "nothing") & (F.col("line") > 0)).collect()) == ["a.jsonl", "b.jsonl"]
    reader = R.AnswersReader({"path": str(tmp_path / "answers")})
    assert [p.path.rsplit("/", 1)[-1] for p in reader.partitions()] == ["a.jsonl", "b.jsonl", "empty.jsonl"]


def test_cache_follows_the_source(spark, tmp_path):
    source, cache, reads = tmp_path / "facts.json", str(tmp_path / "cache"), []

    def read(session, path):
        reads.append(path)
        return session.read.json(path)

    source.write_text('{"a": 1}')
    os.utime(source, (1000, 1000))
    for _ in range(2):
        assert [x["a"] for x in S.cached(spark, str(source), cache, read).collect()] == [1]
    assert len(reads) == 1
    source.write_text('{"a": 2}')
    os.utime(source, (2000, 2000))
    assert [x["a"] for x in S.cached(spark, str(source), cache, read).collect()] == [2] and len(reads) == 2
    with pytest.raises(FileNotFoundError):
        S.cached(spark, str(tmp_path / "none"), cache, read)


def test_ids_by_precedence(spark):
    r = random.Random(2)
    paths = sorted({"/".join(r.choice(["a", "b-c", "b_c", "x", "a_x", "module"]) for _ in range(r.randint(1, 4))) for _ in range(150)} | {"", "/", "q/"})
    taken, want = set(), {}
    for p in paths:
        parts = [x.replace("-", "_") for x in p.split("/")]
        base = parts[-1] or "module"
        names = [base] + [f"{x}_{base}" for x in parts[-2::-1]] + [f"module_{base}"]
        name = next((n for n in names if n not in taken), None)
        if name is None:
            import hashlib

            digest = hashlib.sha1(p.encode()).hexdigest()
            name = next(n for n in (f"module_{base}_{digest[:k]}" for k in range(8, 41, 8)) if n not in taken)
        taken.add(name)
        want[p] = name
    got = J.unique_ids(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {x["path"]: x["id"] for x in got} == want and len({x["level"] for x in got}) >= 4


def test_sections_of_blocks(spark):
    r = random.Random(7)
    rows = []
    for f in range(12):
        line = 0
        for block in range(r.randint(1, 3)):
            start = line
            own = []
            for nth in range(r.randrange(8)):
                line += r.randint(1, 3)
                rule = r.choice(["lock", "irq"])
                own.append((nth, line, r.choice(["begin", "begin", "end"]), rule, r.choice("ab") if rule == "lock" else None))
            line += 1
            rows += [(f"f{f}", block, start, line, *x) for x in own]
    df = spark.createDataFrame(rows, "function string, block int, block_from long, block_end long, nth long, line long, what string, rule string, argument string")
    for per_lock in (False, True):
        want, nested = [], Counter()
        open_ = []
        for f, block, start, stop, nth, line, what, rule, arg in sorted(rows, key=lambda x: (x[0], x[2], x[1], x[4])):
            if what == "end":
                continue
            nested[f] += 0
            if any(g == f and a <= line < b and (not per_lock or (rule, arg) == lock) for g, a, b, lock in open_):
                nested[f] += 1
                continue
            end = next((x[5] for x in sorted(rows, key=lambda x: x[4]) if x[0] == f and x[1] == block and x[4] > nth and x[6] == "end" and x[7:] == (rule, arg)), None)
            open_.append((f, line, end if end is not None else stop + 1, (rule, arg)))
            want.append((f, rule, arg, line, end))
        got, skipped = J.argument_sections(df, per_lock)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(want, key=repr)
        assert {x["function"]: x["nested"] for x in skipped.collect()} == nested and sum(nested.values())


def test_stability_of_mates(spark):
    r = random.Random(3)
    runs = [(seed, n, r.choice("abc") if n < 18 else f"alone{n}") for seed in (4, 5, 6) for n in range(20)]
    home = {(s, n): c for s, n, c in runs}
    want = {}
    for n in range(20):
        mates = [m for m in range(20) if m != n and home[4, m] == home[4, n]]
        want[n] = round(sum(home[s, m] == home[s, n] for s in (4, 5, 6) for m in mates) / (3 * len(mates)), 3) if mates else 1.0
    assert {x["node"]: x["stability"] for x in A.stability(spark.createDataFrame(runs, "seed int, node int, cluster string")).collect()} == want
    numbered = [(s, n, ord(c[0])) for s, n, c in runs]
    dirs = [(n, f"d{n % 3}") for n in range(22)]
    got = A.directory_agreement(spark.createDataFrame(numbered, "seed int, node int, cluster int"), spark.createDataFrame(dirs, "node int, directory string")).collect()
    for x in got:
        count = Counter(ord(home[4, n][0]) if n < 20 else -1 for n, d in dirs if d == x["directory"])
        top = max(count.items(), key=lambda i: (i[1], -i[0]))
        assert (x["files"], x["main_cluster"], x["in_main"], x["ratio"]) == (sum(count.values()), *top, round(top[1] / sum(count.values()), 3))
