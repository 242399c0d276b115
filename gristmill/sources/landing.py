"""Landed pages as a data source, and exports that are there whole or not at all.

``gristmill_pages`` reads a folder of landed answers, ``source=S/day=D/term=T/page=N``,
each page a list of records or an envelope around one. A partition is the pages of one
source, day and term in their order, which end with the first short page. Of very many pages a
file each costs more than what is in them; files right in ``term=T`` hold a page a line,
as ``{"page": N, "body": "..."}``, in any order and number of files. There a partition is a file,
and ``read_pages`` finds where pages end. Filters on source,
term and day are taken over by the source, so that other folders aren't listed as partitions.

``gristmill_export`` writes files of CSV or JSON lines aside and puts them into
place when all tasks have succeeded; a failed write leaves the export that was there."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Names under which an envelope holds its records.
ENVELOPES = ("hydra:member", "member", "jobs")
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
KEYS = ("source", "day", "term")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Pages(InputPartition):
    source: str
    day: date
    term: str
    files: list[tuple[int | None, str]]


def records(text: str) -> list[str]:
    """The records of a page as JSON: of a list, of an envelope, or the one there is; of what can't be parsed, the text."""
    return [r if isinstance(r, str) else json.dumps(r["record"], ensure_ascii=False) for r in _parsed(text)]


def _parsed(text: str) -> list[str | dict]:
    """As ``records``, not written as JSON yet."""
    try:
        found = json.loads(text)
    except ValueError:
        return [text]
    if isinstance(found, dict):
        found = next((found[n] for n in ENVELOPES if isinstance(found.get(n), list)), [found])
    return [{"record": r} for r in found] if isinstance(found, list) else [text]


class PagesReader(DataSourceReader):
    def __init__(self, path: str, size: int, packed: bool, ends: bool) -> None:
        self.path, self.size, self.packed, self.ends, self.filters = path, size, packed, ends, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in [(k,) for k in KEYS]:
                continue  # no folder is without them
            if type(f) in TESTS and f.attribute in [(k,) for k in KEYS]:
                self.filters.append((f.attribute[0], TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        store, root = _open(self.path)
        found: dict[tuple, list[tuple[int, str]]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
            name = info.path.rsplit("/", 1)[-1]
            if info.type != fs.FileType.File or name[0] in "._" or not {*KEYS} <= parts.keys() or ("page" in parts) == self.packed:
                continue
            key = {"source": unquote(parts["source"]), "day": date.fromisoformat(parts["day"]), "term": unquote(parts["term"])}
            if all(test(key[k], value) for k, test, value in self.filters):
                found.setdefault(tuple(key.values()), []).append((None if self.packed else int(parts["page"]), info.path))
        if self.packed:
            return [Pages(*key, [file]) for key, files in sorted(found.items()) for file in sorted(files)]
        return [Pages(*key, sorted(files)) for key, files in sorted(found.items())]

    def _lines(self, partition: Pages) -> Iterator[tuple]:
        """The pages of a file, read as a stream: their records, or, for ``ends``, the short ones without a record."""
        store, _ = _open(self.path)
        key = partition.source, partition.day, partition.term
        with store.open_input_stream(partition.files[0][1]) as f, io.TextIOWrapper(f, encoding="utf-8", newline="\n") as lines:
            for line in lines:
                told = json.loads(line)
                if self.ends:
                    if len(_parsed(told["body"])) < self.size:
                        yield *key, told["page"], None, None
                else:
                    for place, record in enumerate(records(told["body"])):
                        yield *key, told["page"], place, record

    def read(self, partition: Pages) -> Iterator[tuple]:
        if self.packed:
            yield from self._lines(partition)
            return
        store, _ = _open(self.path)
        for page, path in partition.files:
            with store.open_input_stream(path) as f:
                found = records(f.read().decode())
            for place, record in enumerate(found):
                yield partition.source, partition.day, partition.term, page, place, record
            if len(found) < self.size:
                return


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gristmill_pages"

    def schema(self) -> str:
        return "source string, day date, term string, page int, place int, json string"

    def reader(self, schema: StructType) -> PagesReader:
        yes = lambda name: self.options.get(name, "false").lower() == "true"
        return PagesReader(self.options["path"], int(self.options.get("pageSize", 1)), yes("packed"), yes("ends"))


def read_pages(spark: SparkSession, path: str, page_size: int = 1, packed: bool = False) -> DataFrame:
    """(source, day, term, page, place, json) of landed pages; a page of fewer than ``page_size`` records is a source's
    last. With ``packed``, those of files that hold a page a line; their last pages, one for each
    source, day and term at most, are found by a pass before and broadcast."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)
    pages = spark.read.format(PagesSource.name()).option("pageSize", page_size).option("packed", packed)
    if not packed:
        return pages.load(path)
    last = pages.option("ends", True).load(path).groupBy(*KEYS).agg(F.min("page").alias("_last"))
    return pages.option("ends", False).load(path).join(F.broadcast(last), list(KEYS), "left").where("_last IS NULL OR page <= _last").drop("_last")


@dataclass
class Part(WriterCommitMessage):
    file: str | None
    rows: int


class ExportWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], kind: str, bom: bool) -> None:
        self.path, self.columns, self.kind, self.bom = path.rstrip("/"), columns, kind, bom
        self.aside = f"{self.path}.gm-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        """One file of a task's rows; a file is read alone, so each has its mark and its header."""
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = _open(self.aside)
        store.create_dir(root, recursive=True)
        name, n = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.{self.kind}", 0
        with store.open_output_stream(f"{root}/{name}") as out, io.TextIOWrapper(out, encoding="utf-8-sig" if self.bom else "utf-8", newline="") as text:
            cells = csv.writer(text)
            if self.kind == "csv":
                cells.writerow(self.columns)
            for row in iterator:
                n += 1
                if self.kind == "csv":
                    cells.writerow(["" if v is None else v for v in row])
                else:
                    text.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, sort_keys=True, default=str) + "\n")
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        """Files of attempts that didn't count go; then the export takes the old one's place."""
        store, root = _open(self.aside)
        _, target = _open(self.path)
        store.create_dir(root, recursive=True)
        kept = {m.file for m in messages if m}
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name not in kept:
                store.delete_file(info.path)
        before = f"{root}.before"
        if there := store.get_file_info(target).type != fs.FileType.NotFound:
            store.move(target, before)
        store.move(root, target)
        if there:
            store.delete_dir(before)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _open(self.aside)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gristmill_export"

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options["path"], schema.names, self.options.get("kind", "csv"), self.options.get("bom", "false") == "true")


def export(rows: DataFrame, path: str, kind: str = "csv", bom: bool = False) -> None:
    """Replaces the export at ``path`` by ``rows`` in their order over the files,
    as ``csv`` or as ``json`` lines with sorted names; with ``bom`` files begin with
    the UTF-8 byte order mark. If a task fails for good, the old export stays."""
    rows.sparkSession.dataSource.register(ExportSource)
    rows.write.format(ExportSource.name()).mode("overwrite").option("kind", kind).option("bom", str(bom).lower()).save(path)
