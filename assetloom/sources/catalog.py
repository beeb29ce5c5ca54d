"""The asset catalog: a walk over folders, by frontiers (``catalog``) or as a Python data source (``scanned``, or
``spark.read.format("asset_catalog").option("roots", json).load()``). Spark's own file sources hide names that begin
with ``_`` and all that stands below a hidden folder; a catalog must list both.

Rules: a missing root fails the whole scan; a root can be a file; links are neither followed nor listed; unreadable
entries are left out; hidden means the leaf's own name begins with a dot; an excluded folder excludes what stands
below it, by whole components; files without an extension are left out, and so are those of other formats unless
``process_unsupported_formats``; overlapping roots list a file once for each. The data source parts wide roots by their
children; the walk by frontiers shares any tree among all tasks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from assetloom.functions.paths import FORMATS, RAW

SCHEMA = "path string, size bigint, last_modified timestamp, created timestamp, format string, format_ext string"
_BY_EXTENSION = {e: name for name, known in FORMATS.items() for e in known} | dict.fromkeys(RAW, "raw")


class Part(InputPartition):
    def __init__(self, path: str, depth: int, deep: bool):
        self.path, self.depth, self.deep = path, depth, deep


def _excluded(path: str, folders: list[str]) -> bool:
    return any(path == f or path.startswith(f.rstrip("/") + "/") for f in folders)


def asset_row(path: str, folders: list[str], unsupported: bool) -> Iterator[tuple]:
    """The catalog's row of a file, if it has one."""
    name = os.path.basename(path)
    ext = name.rpartition(".")[2] if "." in name.lstrip(".") and not name.endswith(".") else ""
    if name.startswith(".") or _excluded(path, folders) or not ext or os.path.islink(path):
        return
    format_ = _BY_EXTENSION.get(ext.lower(), "other")
    if format_ == "other" and not unsupported:
        return
    try:
        s = os.stat(path)
    except OSError:
        return
    at = lambda t: datetime.fromtimestamp(t, UTC)
    born = getattr(s, "st_birthtime", None)
    yield path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), s.st_size, at(s.st_mtime), at(born) if born is not None else None, format_, ext.lower() if format_ == "other" else None


class AssetCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "asset_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options.get("roots", "[]"))
        depth = options.get("max_depth", "")
        self.max_depth = int(depth) if str(depth).strip() else None
        self.unsupported = str(options.get("process_unsupported_formats", "false")).lower() == "true"
        self.folders = json.loads(options.get("excluded_directories", "[]"))

    def partitions(self) -> list[Part]:
        out = []
        for root in self.roots:
            if not os.path.exists(root):
                raise FileNotFoundError(f"no such root: {root}")
            out.append(Part(root, 0, False))
            if os.path.isdir(root) and (self.max_depth is None or self.max_depth > 1):
                with os.scandir(root) as found:
                    out += [Part(e.path, 1, True) for e in found if e.is_dir(follow_symlinks=False)]
        return out or [Part("", 0, False)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.path:
            return
        if os.path.isfile(part.path) and not part.deep:
            yield from asset_row(part.path, self.folders, self.unsupported)
            return
        stack = [(part.path, part.depth)]
        while stack:
            folder, depth = stack.pop()
            if self.max_depth is not None and depth + 1 > self.max_depth:
                continue
            try:
                with os.scandir(folder) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if part.deep:
                            stack.append((e.path, depth + 1))
                    elif e.is_file(follow_symlinks=False):
                        yield from asset_row(e.path, self.folders, self.unsupported)
                except OSError:
                    continue


def _listing(max_depth: int | None, folders: list[str], budget: int):
    """Lists folders (path, depth), depth first, until a task has gone through ``budget`` entries; then hands back the folders
    that it hasn't listed yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = budget
        for b in batches:
            stack = list(zip(b["path"].to_pylist(), b["depth"].to_pylist(), strict=True))[::-1]
            out: list[tuple] = []
            while stack:
                folder, depth = stack.pop()
                if left <= 0:
                    out.append((True, folder, depth))
                    continue
                left -= 1
                try:
                    if depth == 0 and os.path.isfile(folder):
                        out.append((False, folder, depth))
                        continue
                    with os.scandir(folder) as found:
                        for e in found:
                            left -= 1
                            try:
                                if e.is_dir(follow_symlinks=False):
                                    if (max_depth is None or depth + 2 <= max_depth) and not _excluded(os.fsdecode(e.path), folders):
                                        stack.append((e.path, depth + 1))
                                elif e.is_file(follow_symlinks=False):
                                    out.append((False, e.path, depth))
                            except OSError:
                                continue
                            if len(out) >= 8192:
                                yield _entries(out)
                                out = []
                except OSError:
                    continue
            yield _entries(out)

    return run


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.bool_()), pa.array(b, pa.binary()), pa.array(c, pa.int32())], names=["folder", "path", "depth"])


def _described(folders: list[str], unsupported: bool):
    types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for path in b["path"].to_pylist() for r in asset_row(os.fsdecode(path), folders, unsupported)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def walked(spark: SparkSession, roots: list[str], max_depth: int | None = None, process_unsupported_formats: bool = False, excluded_directories: list[str] | tuple[str, ...] = (), budget: int = 20_000, tasks: int | None = None) -> DataFrame:
    """The catalog by frontiers: folders are rows, dealt anew over all tasks in each round, and a round ends when every task
    has gone through ``budget`` entries, so that one deep or wide tree keeps all of them busy and a narrow one needs few
    rounds. Files are looked at in a step of their own, so that a folder of very many spreads too."""
    folders, tasks = list(excluded_directories), tasks or 4 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(bytearray(os.fsencode(r)), 0) for r in roots], "path binary, depth int")
    if max_depth == 0:
        frontier = frontier.where("false")
    files = []
    while True:
        found = frontier.repartition(tasks).mapInArrow(_listing(max_depth, folders, budget), "folder boolean, path binary, depth int").checkpoint()
        files.append(found.where("not folder"))
        frontier = found.where("folder").select("path", "depth")
        if not frontier.limit(1).count():
            break
    every = files[0]
    for f in files[1:]:
        every = every.union(f)
    return every.select("path").repartition(tasks).mapInArrow(_described(folders, process_unsupported_formats), SCHEMA)


def catalog(spark: SparkSession, roots: list[str], max_depth: int | None = None, process_unsupported_formats: bool = False, excluded_directories: list[str] | tuple[str, ...] = ()) -> DataFrame:
    for root in roots:
        if not os.path.exists(root):
            raise FileNotFoundError(f"no such root: {root}")
    return walked(spark, list(roots), max_depth, process_unsupported_formats, excluded_directories)


def scanned(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """The same through the data source: lazily, a task for each root and each of its folders."""
    spark.dataSource.register(AssetCatalog)
    sent = {k: json.dumps(list(v)) if isinstance(v, (list, tuple)) else "" if v is None else str(v).lower() for k, v in options.items()}
    return spark.read.format("asset_catalog").options(roots=json.dumps(list(roots)), **sent).load()
