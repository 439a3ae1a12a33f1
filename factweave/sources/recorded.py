"""Recorded answers of a language server as a data source: files of messages, no server.

A recording is a file of JSON lines, each an answer: {"method": ..., "uri": ..., "params": ..., "result": ...}. The format
answers(path) gives a row for each line; files are the partitions, so a lost task reads its file again. Lines that aren't such
an answer give a row with the error and no method. The filter on method is pushed down to the reader, which then skips
other lines before it parses them whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "file string, line long, method string, uri string, params string, result string, error string"


class Recording(InputPartition):
    def __init__(self, path: str, size: int):
        super().__init__(path)
        self.path, self.size = path, size


class AnswersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.methods: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("method",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.methods = wanted if self.methods is None else self.methods & wanted
            else:
                yield f

    def partitions(self) -> list[Recording]:
        """A file each, large ones first."""
        fs, at = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True)) if fs.get_file_info(at).type == pafs.FileType.Directory else [fs.get_file_info(at)]
        files = [f for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix)]
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        return [Recording(f"{scheme}{f.path}", f.size) for f in sorted(files, key=lambda f: (-f.size, f.path))]

    def read(self, partition: Recording | None) -> Iterator[tuple]:
        if partition is None:
            return
        fs, at = pafs.FileSystem.from_uri(partition.path)
        hints = None if self.methods is None else [json.dumps(m) for m in self.methods]
        name = at.rsplit("/", 1)[-1]
        with fs.open_input_stream(at, compression=None) as source:
            for number, raw in enumerate(lines_of(source), 1):
                text = raw.decode("utf-8", "replace")
                # A name can be spelt with escapes; then the line is parsed whole.
                if not text.strip() or hints is not None and "\\" not in text and not any(h in text for h in hints):
                    continue
                row = answer(text)
                if self.methods is None or row[0] in self.methods:
                    yield (name, number, *row)


def lines_of(source, size: int = 1 << 20) -> Iterator[bytes]:
    held = b""
    while data := source.read(size):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def answer(text: str) -> tuple:
    """(method, uri, params, result, error); the JSON of params and result as text."""
    try:
        x = json.loads(text)
        if not isinstance(x, dict) or not isinstance(x.get("method"), str):
            raise ValueError("no answer")
    except ValueError as e:
        return None, None, None, None, str(e)[:200] or "no answer"
    params = x.get("params")
    uri = x.get("uri") or (params or {}).get("textDocument", {}).get("uri") if isinstance(params, dict) or params is None else x.get("uri")
    keep = lambda v: None if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    return x["method"], uri, keep(params), keep(x.get("result")), None


class AnswersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswersReader:
        return AnswersReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("answers") known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnswersSource)
