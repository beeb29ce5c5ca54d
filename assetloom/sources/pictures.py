"""Pictures that the JVM decodes (JPEG, TIFF, PNG, GIF, BMP), by Spark's own image source: hashes and dimensions.

Pixels never leave the JVM: a hash samples 64 or 1,024 of them as column expressions. Spark's file sources don't list
names that begin with _ or . ; such files, and JPEGs that don't begin with their picture, are copied for it (``recovered_pictures``)."""

from __future__ import annotations

import hashlib
import itertools
import mmap
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions.hashing import phash64, phash1024
from assetloom.sources.decode import JPEG_MARK

EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "gif", "bmp")


def _grid(image: Column, n: int) -> Column:
    """Luma, in single precision, of n x n pixels, each the nearest to the middle of its part of the picture."""
    w, h, channels, data = (image[c] for c in ("width", "height", "nChannels", "data"))
    single = lambda x: F.lit(x).cast("float")
    at = lambda i, side: F.least(F.floor((i + 0.5) * side / n).cast("int"), side - 1)

    def luma(i: Column) -> Column:
        place = ((at(F.floor(i / n), h) * w + at(i % n, w)) * channels).cast("int")  # rows from the top; blue, green, red (and alpha)
        code = F.hex(F.substring(data, place + 1, F.least(channels, F.lit(3))))
        byte = lambda k: F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("float")
        blue, green, red = byte(0), F.when(channels >= 3, byte(1)).otherwise(byte(0)), F.when(channels >= 3, byte(2)).otherwise(byte(0))
        return single(0.299) * red + single(0.587) * green + single(0.114) * blue

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), luma)


def _decoded(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, image of what the JVM decodes below the roots."""
    either = ",".join(sorted({x for e in EXTENSIONS for x in (e, e.upper(), e.capitalize())}))
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either}}}").load(roots)
    path = F.url_decode(F.replace(F.regexp_replace("image.origin", "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))
    return raw.select(path.alias("path"), "image").where("image.width > 0")


def _hashed(rows: DataFrame, enhanced: bool) -> DataFrame:
    """rows (image and others) with width, height, pixels, phash and phash_enh in place of image."""
    image, rest = F.col("image"), [c for c in rows.columns if c != "image"]
    rows = rows.select(*rest, image["width"].alias("width"), image["height"].alias("height"), _grid(image, 8).alias("small"), (_grid(image, 32) if enhanced else F.lit(None).cast("array<float>")).alias("large"))
    return rows.select(*rest, "width", "height", (F.col("width").cast("long") * F.col("height")).alias("pixels"), phash64(F.col("small")).alias("phash"), (phash1024(F.col("large")) if enhanced else F.lit(None).cast("array<bigint>")).alias("phash_enh"))


def pictures(spark: SparkSession, roots: list[str], enhanced: bool = False) -> DataFrame:
    """path, width, height, pixels, phash (and phash_enh) of the pictures below the roots."""
    rows = _decoded(spark, roots)
    return _hashed(rows.dropDuplicates(["path"]) if len(roots) > 1 else rows, enhanced)


# ---- pictures that the image source doesn't see, or not from their first byte ----


def _marks(path: str) -> Iterator[int]:
    """Where a file has JPEG start marks, from the first on; the file is mapped, not read."""
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        at = data.find(JPEG_MARK)
        while at >= 0:
            yield at
            at = data.find(JPEG_MARK, at + 1)


def _copies(folder: str, skip: int, most: int):
    """Copies files (path) under plain names: a JPEG from each of its start marks, ``most`` of them after ``skip``; others whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            out: list[tuple] = []
            for path in b["path"].to_pylist():
                ext = path.rpartition(".")[2].lower()
                try:
                    found = list(itertools.islice(_marks(path) if ext in ("jpg", "jpeg") else iter([0]), skip, skip + most + 1))
                    for at in found[:most]:
                        name = f"{hashlib.sha256(path.encode()).hexdigest()[:40]}-{at}.{ext}"
                        fs.create_dir(f"{base}/{name[:2]}", recursive=True)
                        with open(path, "rb") as f, fs.open_output_stream(f"{base}/{name[:2]}/{name}") as to:
                            f.seek(at)
                            shutil.copyfileobj(f, to, 1 << 20)
                        out.append((path, name, at, len(found) > most))
                except (OSError, ValueError):  # gone or empty since it was listed
                    continue
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "name", "at", "more"])

    return run


def recovered_pictures(spark: SparkSession, paths: DataFrame, folder: str, enhanced: bool = False, most: int = 8) -> DataFrame:
    """As pictures(), for files (path) whose names Spark hides, or that are JPEGs with something before their picture.

    They are copied below ``folder`` (shared by all workers) under plain names, JPEGs from each start mark on, and given to the
    image source; the first start mark that decodes counts. Files that none of ``most`` marks helps go into a further
    round with their next marks, until none are left; each round's copies are its own."""
    left, found, skip = paths.select("path").distinct(), [], 0
    while True:
        here = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        tried = left.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_copies(here, skip, most), "path string, name string, at long, more boolean").checkpoint()
        if not tried.limit(1).count():
            break
        image = _hashed(_decoded(spark, [here]).withColumnRenamed("path", "name"), enhanced).withColumn("name", F.element_at(F.split("name", "/"), -1))
        first = tried.join(image, "name").groupBy("path").agg(F.min_by(F.struct("width", "height", "pixels", "phash", "phash_enh"), "at").alias("p")).select("path", "p.*").checkpoint()
        found.append(first)
        left, skip = tried.where("more").select("path").distinct().join(first, "path", "left_anti"), skip + most
    if not found:
        return spark.createDataFrame([], "path string, width int, height int, pixels long, phash long, phash_enh array<bigint>")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
