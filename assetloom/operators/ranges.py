"""A table in ranges of hashed keys that split as they grow, in Parquet folders, with versions by atomic rename.

A range is all keys whose hash ends in certain bits (extendible hashing). A version is a small JSON file that names each
range's bits, folders and number of rows. A batch touches only the ranges of its keys: it either replaces their rows of
equal keys, which writes these ranges anew, or is added to them as one more folder. A range that would come to hold more
than ``most_rows`` is written anew as two, four, ... ranges in the same version, and so is one of more than MOST_FOLDERS
folders as one. The new version is put in place by a rename that fails if another writer was first; that writer's version
is then read and the batch applied to it. Readers of an older version keep it until drop_old.

All files go through Spark's own file systems, so that the table can stand wherever Spark reads. On an object store
without atomic rename only one writer may work at a time. Null keys are keys like others, of one range."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_FOLDERS = 16
#: Directory entries at most: 2 ** MOST_DEPTH. Beyond, ranges grow instead.
MOST_DEPTH = 20


@dataclass(frozen=True)
class Range:
    """Keys whose hash has ``value`` as its last ``depth`` bits."""

    depth: int
    value: int
    folders: tuple[str, ...] = ()
    rows: int = 0

    def cut(self, more: int) -> list[Range]:
        """2 ** more empty ranges that this one's keys fall into."""
        return [Range(self.depth + more, self.value + (j << self.depth)) for j in range(1 << more)]


class RangedTable:
    """meta: what a new table notes about itself; that of a table that is there stays."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, ranges: int = 1, most_rows: int = 1_000_000, meta: dict | None = None):
        self.spark, self.root, self.schema, self.key, self.most_rows = spark, root.rstrip("/"), schema, key, most_rows
        self.first, self.meta = Range(0, 0).cut(max(0, (ranges - 1).bit_length())), meta or {}

    # ---- files ----

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The newest version; 0 for none."""
        return max((int(n[2:-5]) for n in self._names(f"{self.root}/versions") if n.startswith("v=") and n.endswith(".json")), default=0)

    def ranges(self, v: int | None = None) -> list[Range]:
        v = self.version() if v is None else v
        return [Range(d, x, tuple(f), n) for d, x, f, n in self._noted(v)["ranges"]] if v else self.first

    def _noted(self, v: int) -> dict:
        fs, p = self._fs(f"{self.root}/versions/v={v}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def noted(self) -> dict:
        """What the table notes about itself."""
        v = self.version()
        return self._noted(v)["meta"] if v else self.meta

    def _load(self, some: list[Range]) -> DataFrame:
        folders = [f"{self.root}/data/{f}" for r in some for f in r.folders]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    # ---- reading ----

    def read(self, version: int | None = None) -> DataFrame:
        return self._load(self.ranges(version))

    def place(self, ranges: list[Range]) -> Column:
        """The number of the range that a row's key falls into."""
        depth = max(r.depth for r in ranges)
        of = [0] * (1 << depth)
        for i, r in enumerate(ranges):
            for j in range(1 << (depth - r.depth)):
                of[r.value + (j << r.depth)] = i
        at = F.xxhash64(self.key).bitwiseAND(F.lit((1 << depth) - 1).cast("long")).cast("int")
        return F.get(F.split(F.lit(",".join(map(str, of))), ",").cast("array<int>"), at)  # one literal

    def _touched(self, batch: DataFrame, ranges: list[Range]) -> dict[int, int]:
        """Rows of batch in each range that it touches; as many entries as ranges at most."""
        return {r["range"]: r["n"] for r in batch.groupBy(self.place(ranges).alias("range")).agg(F.count("*").alias("n")).collect()}

    def holding(self, keys: DataFrame) -> DataFrame:
        """The rows of those ranges that the keys (a table with the key column) fall into: all that can hold them."""
        ranges = self.ranges()
        return self._load([ranges[i] for i in sorted(self._touched(keys, ranges))])

    # ---- writing ----

    def put(self, batch: DataFrame, replace: bool) -> int:
        """Adds rows; those of keys that the table has replace these, if asked for. Returns the version."""
        return self._committed(lambda ranges: self._changed(batch, ranges, replace))

    def _changed(self, batch: DataFrame, ranges: list[Range], replacing: bool) -> list[Range]:
        count = self._touched(batch, ranges)
        anew, made = [], []  # ranges to write anew; the next version's ranges, each with whether it is written anew
        for i, r in enumerate(ranges):
            n = r.rows + count.get(i, 0)
            more = min(MOST_DEPTH - r.depth, max(0, (-(-n // self.most_rows) - 1).bit_length())) if i in count else 0
            if i in count and (replacing or more > 0 or len(r.folders) >= MOST_FOLDERS):
                anew.append(r)
                made += [(x, True) for x in r.cut(more)]
            else:
                made.append((replace(r, rows=n), False))
        kept = self._load(anew)
        if replacing:
            kept = kept.join(batch.select(self.key), self.key, "left_anti")
        return self._written(kept.unionByName(batch), made, max(1, sum(x for _, x in made), len(count)))

    def _written(self, rows: DataFrame, made: list[tuple[Range, bool]], files: int) -> list[Range]:
        name = uuid.uuid4().hex
        at = self.place([r for r, _ in made]).alias("range")
        path = f"{self.root}/data/{name}"
        rows.select(*self.schema.fieldNames(), at).repartition(files, "range").sortWithinPartitions("range", self.key).write.partitionBy("range").parquet(path)
        new = {int(x[6:]): f"{name}/{x}" for x in self._names(path) if x.startswith("range=")}
        counted = {}
        if any(x for _, x in made) and new:
            counted = {r["range"]: r["n"] for r in self.spark.read.parquet(path).groupBy(F.col("range").cast("int").alias("range")).agg(F.count("*").alias("n")).collect()}
        return [replace(r, folders=(*r.folders, new[i]) if i in new else r.folders, rows=counted.get(i, 0) if x else r.rows) for i, (r, x) in enumerate(made)]

    def _committed(self, made, tries: int = 20) -> int:
        """Writes what made(ranges) gives as the next version, again from the start where another writer was first."""
        jvm = self.spark._jvm
        for _ in range(tries):
            v = self.version()
            meta = self._noted(v)["meta"] if v else self.meta
            text = json.dumps({"meta": meta, "ranges": [[r.depth, r.value, list(r.folders), r.rows] for r in made(self.ranges(v))]})
            fs, temp = self._fs(f"{self.root}/versions/.{uuid.uuid4().hex}")
            out = fs.create(temp)
            out.write(bytearray(text.encode()))
            out.close()
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(temp, self._fs(f"{self.root}/versions/v={v + 1}.json")[1], none)
            except Py4JJavaError as e:
                fs.delete(temp, False)
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                continue
            return v + 1
        raise RuntimeError("other writers were first each time")

    def compact(self, files: int) -> int:
        """Writes all ranges anew, by so many tasks."""
        return self._committed(lambda ranges: self._written(self._load(ranges), [(Range(r.depth, r.value), True) for r in ranges], files))

    def reinitialise(self) -> None:
        fs, root = self._fs(self.root)
        fs.delete(root, True)

    def drop_old(self, keep: int = 2) -> None:
        """Deletes all but the newest versions, and folders that none of these names; not while another writer works."""
        fs, _ = self._fs(self.root)
        newest = self.version()
        named = {f for v in range(max(1, newest - keep + 1), newest + 1) for r in self.ranges(v) for f in r.folders}
        for v in (int(n[2:-5]) for n in self._names(f"{self.root}/versions") if n.startswith("v=")):
            if v <= newest - keep:
                fs.delete(self._fs(f"{self.root}/versions/v={v}.json")[1], False)
        for name in self._names(f"{self.root}/data"):
            for part in self._names(f"{self.root}/data/{name}"):
                if f"{name}/{part}" not in named:
                    fs.delete(self._fs(f"{self.root}/data/{name}/{part}")[1], True)
