"""Readers, writers, scalars with stacks, paging and snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from factweave.functions import scalars as S
from factweave.operators import ordering as O
from factweave.sources import projects as P
from factweave.sources import text_scans as X
from factweave.streaming import snapshots

KEIL = """<Project><Targets><Target><TargetName>Debug</TargetName><TargetOption><TargetCommonOption><Cpu>IRAM(0x2000) CPUTYPE("Cortex-M4") CLOCK(8)</Cpu></TargetCommonOption>
<TargetArmAds><Cads><VariousControls><Define>A=1,B</Define><IncludePath>..\\inc;..\\sys</IncludePath></VariousControls></Cads></TargetArmAds></TargetOption>
<Groups><Group><Files><File><FileName>main.c</FileName><FilePath>..\\src\\main.c</FilePath></File><File><FileName>x.s</FileName><FilePath>x.s</FilePath></File></Files></Group></Groups></Target></Targets></Project>"""


def test_keil(spark, tmp_path):
    (tmp_path / "p.uvprojx").write_text(KEIL)
    t = P.keil_targets(spark, str(tmp_path / "p.uvprojx")).first()
    assert (t["target"], t["cpu"]) == ("Debug", "Cortex-M4")
    [c] = P.keil_commands(spark, str(tmp_path / "p.uvprojx"), "Debug").collect()
    assert c["file"] == "../src/main.c" and c["arguments"] == ["armclang", "-mcpu=cortex-m4", "-DA=1", "-DB", "-I../inc", "-I../sys", "-c", "../src/main.c"]


def test_device_pack_inherits(spark, tmp_path):
    (tmp_path / "d.pdsc").write_text('<p><family Dfamily="F"><compile header="f.h" define="FAM"/><subFamily DsubFamily="S"><compile header="s.h"/><device Dname="D1"><compile define="DEV"/></device><device Dname="D2"/></subFamily></family></p>')
    got = {r["device"]: (r["define"], r["header"]) for r in P.device_pack(spark, str(tmp_path / "d.pdsc")).collect()}
    assert got == {"D1": ("DEV", "s.h"), "D2": ("FAM", "s.h")}


def test_compile_commands(spark, tmp_path):
    (tmp_path / "build").mkdir()
    (tmp_path / "build/compile_commands.json").write_text(json.dumps([{"directory": "/w", "file": "a.c", "command": "cc -I'x y' a.c"}]))
    at = P.find_compile_commands(str(tmp_path))
    assert P.read_compile_commands(spark, at).first()["arguments"] == ["cc", "-Ix y", "a.c"]
    assert P.find_build_root(str(tmp_path / "build")) is not None
    (tmp_path / "build/compile_commands.json").write_text(json.dumps([{"directory": "/w", "file": "a.c"}]))
    with pytest.raises(Exception, match="lacks"):
        P.read_compile_commands(spark, at).collect()
    with pytest.raises(FileNotFoundError):
        P.find_compile_commands(str(tmp_path / "none"))


def test_source_tree(spark, tmp_path):
    for name in ("a.c", "build/b.c", "s/.git/x.h", "s/t.HPP", "n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("int x;")
    assert sorted(r["path"] for r in X.source_tree(spark, str(tmp_path)).collect()) == ["a.c", "s/t.HPP"]


def test_facts_files(spark, tmp_path):
    at = str(tmp_path / "f.json")
    assert P.write_facts({"a": 1}, at, packed=False) == at
    assert P.write_facts({"a": 2}, at) == at + ".gz" and not (tmp_path / "f.json").exists()
    assert P.read_facts(spark, at + ".gz").first()["a"] == 2
    (tmp_path / "odd.json").write_bytes((tmp_path / "f.json.gz").read_bytes())
    assert P.read_facts(spark, str(tmp_path / "odd.json")).select(F.expr("facts:a::int")).first()[0] == 2
    assert [P.point_to(str(tmp_path / "p"), at) for _ in range(3)] == [1, 2, 3]


def test_reports_and_drafts(spark, tmp_path):
    df = spark.createDataFrame([("src/app/a.c",), ("lib/app/b.c",), ("m.c",)], "path string")
    P.write_report({"files": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/files.parquet")).count() == 3
    assert P.summary({"files": df}) == "files: 3"
    assert [m["id"] for m in P.draft_architecture(df)] == ["root", "app", "src_app"]


def test_rules():
    rows = P.rule_rows([{"name": "a", "scheduling": "preemptive", "tick_ms": 1}, {"name": "b", "scheduling": "cooperative", "tick_ms": 10}])
    assert rows["settings"] == [{"scheduling": "preemptive", "tick_ms": 10, "atomic_width_bytes": None}]
    with pytest.raises(ValueError, match="names no function"):
        P.rule_rows([{"name": "a", "blocking": [{"kind": "wait"}]}])


def test_masking_keeps_length(spark):
    text = 'a /* x\n y */ b; // c\n"s\\"t" \'q\''
    got = spark.createDataFrame([(text,)], "t string").select(S.mask_comments("t")).first()[0]
    assert len(got) == len(text) and got.count("\n") == 2 and "x" not in got and '"' not in got and "b;" in got


def test_documentation(spark):
    c = "/** Sets it.\n * @param n the number\n * @return nothing\n * @note slow\n */"
    d = spark.createDataFrame([(c,)], "t string").select(S.documentation("t").alias("d")).first()["d"]
    assert (d["brief"], d["params"][0]["name"], d["returns"], d["notes"]) == ("Sets it.", "n", "nothing", ["slow"])


def test_paging(spark):
    df = spark.range(120).select("id")
    one = O.page(df, ["id"], 50, 50)
    assert one["total"] == 120 and one["items"][0] == {"id": 50} and one["more"] == {"offset": 100, "remaining": 20}
    assert "more" not in O.page(df, ["id"], 100)
    assert O.page(df.select(F.repeat(F.lit("x"), 2000).alias("t")), ["t"])["error"] == "too-large"
    assert O.at_path({"a": [{"b": 1}]}, "a.0.b") == (True, 1) and O.at_path({"a": []}, "a.0") == (False, None)


def test_snapshot_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2)])):
        spark.createDataFrame(rows, "id string, seq int, v int").coalesce(1).write.mode("append").parquet(src)
        snapshots.upsert(snapshots.read_snapshots(spark, src, "id string, seq int, v int"), out, str(tmp_path / "ck")).awaitTermination(60)
    assert {r["id"]: r["v"] for r in snapshots.current(spark, out).collect()} == {"a": 2, "b": 1}


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
