"""What several operators of this subpackage need: shared storage, folds, words and hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.sources.folders import shared_dir

BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2_000_000


#: What blocks of freed() have made so far, the innermost last: (folders, broadcasts).
_working: list[tuple[list[str], list[Broadcast]]] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the block of freed() around it or the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/assetloom-{uuid.uuid4().hex}/{name}"
    if _working:
        _working[-1][0].append(path.rpartition("/")[0])
    else:
        atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def sent(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of a bounded value, destroyed when the block of freed() around it ends."""
    out = spark.sparkContext.broadcast(value)
    if _working:
        _working[-1][1].append(out)
    return out


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Frees the working tables and broadcasts that a block made: for blocks that write their result, which must not be a
    DataFrame that is still to be worked out."""
    _working.append(([], []))
    try:
        yield
    finally:
        folders, broadcasts = _working.pop()
        for path in folders:
            _remove(spark, path)
        for b in broadcasts:
            b.destroy()
        gc.collect()  # handles of the JVM's plans
        released()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: a cut in the lineage that survives lost executors."""
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def words(text: str | None) -> list[bytes]:
    r"""Lower-cased (A-Z) words `[^\x20\x09-\x0D]+` as UTF-8: bytes.split() parts at just those six bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4_000_000, most_rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into pieces of about most_bytes of text and most_rows at most, so that a worker's memory doesn't follow the batch size."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        at, total = 0, np.cumsum(size)
        while at < b.num_rows:
            done = total[at - 1] if at else 0
            end = min(at + most_rows, max(at + 1, int(np.searchsorted(total, done + most_bytes, "right"))))
            yield b.slice(at, end - at)
            at = end


def small_batches(spark: SparkSession) -> None:
    """Has Arrow batches end at BATCH_BYTES, unless the session has a limit of its own; all rows are sent as before.

    With Spark's 64 MB a batch is 10,000 rows of any length. Executors build each in buffers that double, and malloc keeps
    tens of MB in every thread's arena once such a buffer was freed."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of counts (a table: it is read twice) with the highest n, ``most`` at most; rows of one count stay or go together.

    A histogram over fine ranges of log n gives the least count that qualifies, so that the driver never sees more rows
    than ranges, nor each task's own candidates."""
    step = F.floor(F.log(F.col(n).cast("double")) * 256).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["b"]):  # 256 ranges for each power of e
        total += r["k"]
        if total > most:
            break
        least = r["b"]
    return counts.where(F.lit(False) if least is None else step >= least)


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=_U)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, base, dtype=_U), out=out[1:])
    return out


_BYTE = mix64(np.arange(256, dtype=_U) + _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = _powers(_BASE, 4096)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the lower-cased words of one UTF-8 text, in order; equal words have equal hashes."""
    if not data:
        return np.empty(0, dtype=_U)
    global _POW
    buf = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=_U)
    length = end - start
    if length.max() > len(_POW):
        _POW = _powers(_BASE, 1 << int(length.max()).bit_length())
    flat = np.flatnonzero(inside[1:-1])
    at = flat - np.repeat(start, length)
    term = _BYTE[buf[flat]] * _POW[at]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix64(np.add.reduceat(term, first) + length.astype(_U) * _U(0xD6E8FEB86659FD93))


def removed(spark: SparkSession, table: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    for name in table.inputFiles()[:1]:
        _remove(spark, name.rpartition("/")[0])


def released() -> None:
    """Hands memory that this worker has freed back to the system; a reused worker would keep it while others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's only
        ctypes.CDLL(None).malloc_trim(0)
