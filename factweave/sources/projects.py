"""Compilation databases, project files, rule profiles, facts files and reports."""

from __future__ import annotations

import gzip
import json
import os
import re
import shlex

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMAND_FIELDS = T.StructType([T.StructField("directory", T.StringType()), T.StructField("file", T.StringType()), T.StructField("command", T.StringType()), T.StructField("arguments", T.ArrayType(T.StringType())), T.StructField("output", T.StringType())])



def find_compile_commands(project: str) -> str:
    for at in (f"{project}/compile_commands.json", f"{project}/build/compile_commands.json"):
        if os.path.isfile(at):
            return at
    raise FileNotFoundError(f"no compile_commands.json in {project} or its build folder")


def find_build_root(start: str, most: int = 5) -> str | None:
    """The nearest folder at or above start, so many levels up at most, with a compilation database."""
    at = os.path.abspath(start)
    for _ in range(most + 1):
        if os.path.isfile(f"{at}/compile_commands.json") or os.path.isfile(f"{at}/build/compile_commands.json"):
            return at
        if at == os.path.dirname(at):
            break
        at = os.path.dirname(at)
    return None


# Files that tell a build system.
BUILD_FILES = {"platformio.ini": "platformio", "CMakeLists.txt": "cmake", "Makefile": "make", "west.yml": "zephyr", "sdkconfig": "esp-idf"}


def build_system(project: str) -> list[str]:
    return sorted({kind for name, kind in BUILD_FILES.items() if os.path.exists(f"{project}/{name}")})


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def split_command(command: str):
    return None if command is None else shlex.split(command)


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(directory, file, arguments, output); a row needs directory, file and arguments or command. `x.ino.cpp` stands for `x.ino`."""
    raw = spark.read.schema(COMMAND_FIELDS).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return normal_commands(raw)


def normal_commands(raw: DataFrame) -> DataFrame:
    ok = F.col("directory").isNotNull() & F.col("file").isNotNull() & (F.col("arguments").isNotNull() | F.col("command").isNotNull())
    arguments = F.when(F.col("arguments").isNotNull(), F.col("arguments")).when(F.assert_true(ok, F.lit("a command lacks directory, file or arguments")).isNull(), split_command("command"))
    return raw.select("directory", F.regexp_replace("file", r"\.ino\.cpp$", ".ino").alias("file"), arguments.alias("arguments"), "output")


def include_dirs(commands: DataFrame) -> DataFrame:
    """(file, ordinal, dir) from -I x, -Ix, /Ix, -isystem, -iquote and -idirafter, in order."""
    args = commands.select("file", F.posexplode("arguments").alias("pos", "arg"))
    nxt = F.lead("arg").over(Window.partitionBy("file").orderBy("pos"))
    flag = F.col("arg").isin("-I", "/I", "-isystem", "-iquote", "-idirafter")
    joined = F.regexp_extract("arg", "^(?:-I|/I|-isystem|-iquote|-idirafter)(.+)$", 1)
    got = args.withColumn("next", nxt).withColumn("dir", F.when(flag, F.col("next")).otherwise(F.nullif(joined, F.lit("")))).where("dir is not null")
    return got.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1).alias("ordinal"), "dir")


def infer_mapping(paths: DataFrame, top_dirs: list[str]) -> DataFrame:
    """(prefix, n): what stands most often before one of the project's top folders in compile paths."""
    hits = paths.select(F.explode(F.array(*[F.when(F.instr("path", f"/{d}/") > 0, F.substring_index("path", f"/{d}/", 1)) for d in top_dirs])).alias("prefix"))
    return hits.where("prefix is not null").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(1)


def map_paths(paths: DataFrame, before: str, after: str, existing: DataFrame) -> DataFrame:
    """(path, mapped): the mapped path if it exists or the original does not."""
    moved = F.when(F.col("path").startswith(before), F.concat(F.lit(after), F.expr(f"substr(path, {len(before) + 1})"))).otherwise(F.col("path"))
    have = existing.select(F.col("path").alias("e"), F.lit(True).alias("there"))
    a = paths.withColumn("moved", moved).join(have, F.col("moved") == F.col("e"), "left").withColumnRenamed("there", "m").drop("e")
    b = a.join(have, F.col("path") == F.col("e"), "left").withColumnRenamed("there", "o").drop("e")
    return b.select("path", F.when(F.col("m").isNotNull() | F.col("o").isNull(), F.col("moved")).otherwise(F.col("path")).alias("mapped"))


def local_commands(commands: DataFrame, driver: str = "clang") -> DataFrame:
    """Commands with a local driver and, where the old driver tells it, --target."""
    from ..functions.scalars import target_triple

    target = target_triple(F.element_at("arguments", 1))
    rest = F.slice("arguments", F.lit(2), F.greatest(F.size("arguments") - 1, F.lit(0)))
    extra = F.when(target.isNotNull(), F.array(F.concat(F.lit("--target="), target))).otherwise(F.array().cast("array<string>"))
    return commands.withColumn("arguments", F.concat(F.array(F.lit(driver)), extra, rest))


def keil_targets(spark: SparkSession, path: str) -> DataFrame:
    """(target, cpu, define, include) of a µVision project."""
    raw = spark.read.format("xml").option("rowTag", "Target").load(path)
    control = "TargetOption.TargetArmAds.Cads.VariousControls"
    return raw.select(F.col("TargetName").alias("target"), F.regexp_extract(F.col("TargetOption.TargetCommonOption.Cpu"), r'CPUTYPE\("([^"]+)"\)', 1).alias("cpu"), F.col(f"{control}.Define").alias("define"), F.col(f"{control}.IncludePath").alias("include"))


def keil_commands(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A compilation database (directory, file, arguments) of one target: its C files with defines, includes and CPU."""
    base = os.path.dirname(path)
    info = keil_targets(spark, path).where(F.col("target") == target)
    rows = spark.read.format("xml").option("rowTag", "File").load(path)
    files = rows.where(F.lower("FileName").rlike(r"\.(c|cc|cpp|cxx)$")).select(F.regexp_replace("FilePath", r"\\", "/").alias("file"))
    cut = lambda c, flag: F.transform(F.filter(F.split(F.coalesce(c.cast("string"), F.lit("")), "[,; ]+"), lambda x: x != ""), lambda x: F.concat(F.lit(flag), F.regexp_replace(x, r"\\", "/")))
    args = info.select(F.concat(F.array(F.lit("armclang"), F.concat(F.lit("-mcpu="), F.lower("cpu"))), cut(F.col("define"), "-D"), cut(F.col("include"), "-I")).alias("arguments"))
    return files.join(F.broadcast(args)).select(F.lit(base).alias("directory"), "file", F.concat("arguments", F.array(F.lit("-c"), F.col("file"))).alias("arguments"))


def device_pack(spark: SparkSession, path: str) -> DataFrame:
    """(device, define, header) of a device pack: what a device lacks comes from its subfamily, then its family."""
    compile_ = "compile STRUCT<_define: STRING, _header: STRING>"
    schema = f"_Dfamily STRING, {compile_}, subFamily ARRAY<STRUCT<_DsubFamily: STRING, {compile_.replace(' ', ': ', 1)}, device: ARRAY<STRUCT<_Dname: STRING, {compile_.replace(' ', ': ', 1)}>>>>"
    family = spark.read.schema(schema).format("xml").option("rowTag", "family").load(path)
    inner = family.select(F.col("compile").alias("fc"), F.explode("subFamily").alias("s")).select("fc", F.col("s.compile").alias("sc"), F.explode("s.device").alias("d"))
    first = lambda field: F.coalesce(F.col(f"d.compile.{field}"), F.col(f"sc.{field}"), F.col(f"fc.{field}"))
    return inner.select(F.col("d._Dname").alias("device"), first("_define").alias("define"), first("_header").alias("header"))


def _yaml(path: str):
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML; JSON profiles work without") from e
    with open(path) as f:
        return yaml.safe_load(f)


def load_document(path: str):
    if path.endswith(".json"):
        with open(path) as f:
            return json.load(f)
    return _yaml(path)


FAMILIES = {
    "task_create": ("function", "entry_argument", "kind", "confidence", "priority_argument"),
    "callback_register": ("function", "entry_argument", "kind", "confidence", "context"),
    "timer_create": ("function", "entry_argument", "kind", "confidence"),
    "isr_enable": ("function", "entry_argument", "confidence"),
    "blocking": ("function", "kind", "confidence", "duration_argument", "duration_unit"),
    "critical_section": ("begin", "end", "kind", "match_argument"),
    "systick_config": ("function", "entry_argument"),
    "task_control": ("function", "kind", "entry_argument"),
}


def rule_rows(profiles: list[dict]) -> dict[str, list[dict]]:
    """Rows of the eight rule families of merged profiles. Lists are joined, of scalars the last that is set counts, and preemptive scheduling wins."""
    out: dict[str, list[dict]] = {f: [] for f in FAMILIES}
    settings: dict = {"scheduling": None, "tick_ms": None, "atomic_width_bytes": None}
    for profile in profiles:
        name = profile.get("name", "profile")
        for family, fields in FAMILIES.items():
            for i, rule in enumerate(profile.get(family) or []):
                if not isinstance(rule, dict) or not (rule.get("function") or rule.get("begin")):
                    raise ValueError(f"{name}.{family}[{i}] names no function")
                out[family].append({"rule_id": rule.get("id") or f"{name}.{family}.{i}"} | {f: None if rule.get(f) is None else str(rule[f]) for f in fields})
        for key in settings:
            if profile.get(key) is not None and not (key == "scheduling" and settings[key] == "preemptive"):
                settings[key] = profile[key]
    return out | {"settings": [settings]}


def rule_tables(spark: SparkSession, profiles: list[dict]) -> dict[str, DataFrame]:
    rows = rule_rows(profiles)
    schema = lambda f: ", ".join(f"`{c}` string" for c in ("rule_id", *FAMILIES[f]))
    return {f: spark.createDataFrame([tuple(r.values()) for r in rows[f]], schema(f)) for f in FAMILIES}


def architecture_modules(document: dict) -> list[tuple[str, str]]:
    """(module id, path pattern) pairs of an architecture document."""
    return [(m["id"], p) for m in document.get("modules", []) for p in m.get("paths", [])]


def draft_architecture(paths: DataFrame, most: int = 200) -> list[dict]:
    """Module drafts from the first two folders of paths; an id that is taken grows by its parent folder."""
    from ..functions.scalars import module_of

    rows = paths.select(module_of(F.col("path")).alias("m")).distinct().orderBy("m").limit(most).collect()
    taken, out = set(), []
    for r in rows:
        parts = r["m"].split("/")
        name = next((n for k in range(1, len(parts) + 1) if (n := re.sub(r"\W+", "_", "_".join(parts[-k:])).strip("_")) not in taken), re.sub(r"\W+", "_", r["m"]))
        taken.add(name)
        out.append({"id": name, "paths": [f"{r['m']}/**" if r["m"] != "(root)" else "*"]})
    return out


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """A facts document as rows; gzip is told by its magic, not by the name."""
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    if packed and not path.endswith(".gz"):
        with gzip.open(path) as f:
            return spark.createDataFrame([(f.read().decode(),)], "text string").select(F.parse_json("text").alias("facts"))
    return spark.read.option("multiLine", "true").json(path)


def write_facts(facts: dict, path: str, packed: bool = True) -> str:
    """Writes a facts document, and removes the twin of the other kind so that only one is ever there."""
    twin, at = (path, path + ".gz") if packed else (path + ".gz", path)
    data = json.dumps(facts, separators=(",", ":"), sort_keys=True).encode()
    with open(at + ".part", "wb") as f:
        f.write(gzip.compress(data, mtime=0) if packed else data)
    os.replace(at + ".part", at)
    if os.path.exists(twin):
        os.remove(twin)
    return at


def point_to(path: str, facts: str) -> int:
    """Points to a facts file: an atomic rename, with a number that rises."""
    try:
        with open(path) as f:
            seq = json.load(f)["seq"] + 1
    except FileNotFoundError:
        seq = 1
    with open(path + ".part", "w") as f:
        json.dump({"facts": facts, "seq": seq}, f)
    os.replace(path + ".part", path)
    return seq


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, and its rows as JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/{name}.json")


def summary(tables: dict[str, DataFrame]) -> str:
    return "\n".join(f"{name}: {df.count()}" for name, df in sorted(tables.items()))


def library_files(files: DataFrame, header: str) -> DataFrame:
    """Libraries (.a, .lib) in a header's folder."""
    folder = os.path.dirname(header)
    return files.where(F.col("path").rlike("^" + re.escape(folder) + r"/[^/]+\.(a|lib)$"))
