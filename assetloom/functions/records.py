"""Times, sizes, progress and log records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("trace", "debug", "info", "warn", "error")
#: Seconds allowed by kind of file, for digests and for perceptual hashes.
DIGEST_SECONDS, PHASH_SECONDS = {"raw": 15, "tiff": 10, "": 5}, {"raw": 30, "tiff": 20, "": 10}


def seconds_allowed(format_: Column, perceptual: bool = False) -> Column:
    table = PHASH_SECONDS if perceptual else DIGEST_SECONDS
    return F.when(format_ == "raw", table["raw"]).when(format_ == "tiff", table["tiff"]).otherwise(table[""])


def to_unix(ts: Column) -> Column:
    """Whole seconds; times before the epoch become 0."""
    return F.greatest(F.unix_seconds(ts.cast("timestamp")), F.lit(0).cast("long"))


def from_unix(s: Column) -> Column:
    return F.timestamp_seconds(F.greatest(s, F.lit(0).cast("long")))


def file_mb(size: Column) -> Column:
    return F.floor(size / 1_000_000).cast("long")


def memory_mb(size: Column) -> Column:
    return F.floor(F.floor(size / 1024) / 1024).cast("long")


def size_class(size: Column, format_: Column) -> Column:
    """'empty' rows are rejected; large ones only noted."""
    return F.when(size == 0, "empty").when(size > 200_000_000, "large").when((format_ == "tiff") & (size > 100_000_000), "large").otherwise("ok")


def batches(n: Column, size: int) -> Column:
    return F.floor((n + size - 1) / size).cast("long")


def eta_text(seconds: Column) -> Column:
    """Ns, Mm Ss or Hh Mm."""
    part = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    return (
        F.when(seconds < 60, part(seconds, "s"))
        .when(seconds < 3600, F.concat_ws(" ", part(seconds / 60, "m"), part(seconds % 60, "s")))
        .otherwise(F.concat_ws(" ", part(seconds / 3600, "h"), part((seconds % 3600) / 60, "m")))
    )


def eta_seconds(done: Column, total: Column, elapsed: Column, default_rate: float = 25.0) -> Column:
    rate = F.when((elapsed > 0) & (done > 0), done / elapsed).otherwise(default_rate)
    return (total - done) / rate


def progress_text(speed: Column, ok: Column, errors: Column, eta: Column) -> Column:
    """The line of a run that goes on; eta in seconds, of which the whole ones count."""
    return F.concat(F.format_string("%.1f img/s | %d ok | %d errors | ETA: ", speed, ok, errors), eta_text(F.floor(eta)))


def finish_text(ok: Column, errors: Column, elapsed: Column, rate: Column) -> Column:
    return F.format_string("Completed %d images | %d ok | %d errors | %.1fs elapsed | %.1f img/s", ok + errors, ok, errors, elapsed, rate)


def rate(done: Column, elapsed: Column) -> Column:
    """Pictures a second; 0 where nothing was done or no time went by."""
    return F.when((elapsed > 0) & (done > 0), done / elapsed).otherwise(0.0)


def level_at_least(level: Column, least: str) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(level)) >= LEVELS.index(least) + 1


# How messages begin, and what stands before each of their parts.
HASH_FAILED, FILE_FAILED, FS_CHANGE, DB_OPERATION = "Hash computation failed", "File operation failed", "FS CHANGE", "DB OPERATION"
PATH, ERROR, OPERATION, DETAILS = "Path: ", "Error: ", "Operation: ", "Details: "


def hash_error(path: Column, error: Column) -> Column:
    return F.concat(F.lit(f"{HASH_FAILED} - {PATH}"), path, F.lit(f", {ERROR}"), error)


def file_error(path: Column, operation: Column, error: Column) -> Column:
    return F.concat(F.lit(f"{FILE_FAILED} - {OPERATION}"), operation, F.lit(f", {PATH}"), path, F.lit(f", {ERROR}"), error)


def fs_change(operation: Column, path: Column, details: Column) -> Column:
    """Null details are left out."""
    more = F.coalesce(F.concat(F.lit(f", {DETAILS}"), details), F.lit(""))
    return F.concat(F.lit(f"{FS_CHANGE} - {OPERATION}"), operation, F.lit(f", {PATH}"), path, more)


def db_operation(operation: Column, details: Column) -> Column:
    return F.concat(F.lit(f"{DB_OPERATION} - {OPERATION}"), operation, F.lit(f", {DETAILS}"), details)


def _cut(text: Column, at: str) -> tuple[Column, Column]:
    """What stands before the first ``at`` (all without one), and after it (null without one). at: no regular expression."""
    part = F.split(text, at, 2)
    return F.get(part, 0), F.get(part, 1)


def parse_message(message: Column) -> Column:
    """struct(operation, path, error_type, details). Database messages count as others: a quirk that is kept."""
    made = lambda *parts: F.struct(*[(F.lit(p) if isinstance(p, str) else p).alias(n) for p, n in zip(parts, ("operation", "path", "error_type", "details"), strict=True)])
    _, rest = _cut(message, f" - {PATH}")
    path, error = _cut(rest, f", {ERROR}")
    kind, more = _cut(error, ": ")
    failed = F.when(rest.isNull(), made("hash_computation", "", "unknown", message)).when(error.isNull(), made("hash_computation", rest, "unknown", ""))
    failed = failed.when(more.isNull(), made("hash_computation", path, "generic_error", error)).otherwise(made("hash_computation", path, kind, more))

    _, rest = _cut(message, OPERATION)
    operation, rest2 = _cut(rest, f", {PATH}")
    path, error = _cut(rest2, f", {ERROR}")
    file_ = F.when(rest.isNull(), made("file_operation", "", "unknown", message)).when(rest2.isNull(), made(rest, "", "unknown", ""))
    file_ = file_.when(error.isNull(), made(operation, rest2, "unknown", "")).otherwise(made(operation, path, "file_operation", error))
    path, details = _cut(rest2, f", {DETAILS}")
    change = F.when(rest.isNull(), made("fs_change", "", "unknown", message)).when(rest2.isNull(), made(rest, "", "fs_change", ""))
    change = change.when(details.isNull(), made(operation, rest2, "fs_change", "")).otherwise(made(operation, path, "fs_change", details))

    return F.when(message.startswith(HASH_FAILED), failed).when(message.startswith(FILE_FAILED), file_).when(message.startswith(FS_CHANGE), change).otherwise(made("other", "", "application", message))


def utc_text(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def log_json(level: Column, message: Column, module: Column, file: Column, line: Column, operation: Column, path: Column, kind: Column, details: Column, ts: Column) -> Column:
    """The nested log record as JSON; null parts get their defaults."""
    operation, path = F.coalesce(operation, F.lit("direct")), F.coalesce(path, F.lit(""))
    kind, details = F.coalesce(kind, F.lit("application")), F.coalesce(details, message)
    where = F.when(path == "", "system").otherwise(path)
    source = F.struct(module.alias("module"), F.coalesce(file, F.lit("unknown")).alias("file"), F.coalesce(line, F.lit(0)).alias("line"))
    error = F.struct(kind.alias("type"), details.alias("details"))
    context = F.struct(source.alias("source"), operation.alias("operation"), path.alias("path"), error.alias("error"), utc_text(ts).alias("timestamp"))
    data = F.struct(message.alias("raw_message"), F.concat(kind, F.lit(" event on "), where, F.lit(": "), details).alias("formatted_message"), context.alias("context"))
    return F.to_json(F.struct(level.alias("level"), data.alias("data")))
