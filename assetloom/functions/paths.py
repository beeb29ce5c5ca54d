"""Paths as column expressions: parts, formats, filters, and names of test images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by format.
FORMATS = {"jpeg": ("jpg", "jpeg"), "png": ("png",), "tiff": ("tif", "tiff"), "heic": ("heic",)}
RAW = ("raw", "dng", "cr2", "nef", "arw", "orf", "rw2", "nrw", "raf", "crw", "pef", "srw", "x3f", "rwl", "3fr")


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the leaf; null without a dot, or if the only one leads the name."""
    return F.nullif(F.regexp_extract(leaf(path), r"^.+\.([^.]*)$", 1), F.lit(""))


def stem(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(leaf(path), r"^(.+)\.[^.]*$", 1), F.lit("")), leaf(path))


def lower_extension(path: Column) -> Column:
    return F.coalesce(F.lower(extension(path)), F.lit(""))


def format_of(ext: Column) -> Column:
    """Format of an extension; null stays null."""
    out = F.when(F.lower(ext).isin(*RAW), "raw")
    for name, known in FORMATS.items():
        out = out.when(F.lower(ext).isin(*known), name)
    return out.when(ext.isNotNull(), "other")


def supported(format_: Column) -> Column:
    return format_ != "other"


def has_image_extension(path: Column) -> Column:
    return F.coalesce(supported(format_of(extension(path))), F.lit(False))


def is_image_path(path: Column) -> Column:
    """True for any extension, even of a text file: a quirk that is kept."""
    return extension(path).isNotNull()


def hidden(path: Column) -> Column:
    """By the leaf's name alone: a file below a hidden folder isn't hidden."""
    return leaf(path).startswith(".")


def excluded(path: Column, prefixes: Sequence[str]) -> Column:
    """Component-wise: /a/b excludes /a/b/c, not /a/bc."""
    out = F.lit(False)
    for p in prefixes:
        p = p.rstrip("/")
        out = out | (path == p) | path.startswith(p + "/")
    return out


def depth(path: Column, root: str = "") -> Column:
    """0 for the root, 1 for what stands in it."""
    rest = F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path))
    return F.when(F.length(rest) == 0, 0).otherwise(F.size(F.split(rest, "/")) - 1)


def image_name(path: Column) -> Column:
    """struct(image_name, transformation, parameter, file_type) of name_original, name_transform_index or
    name_transform_parameter..._index; null for any other name, and for one without an extension."""
    part = F.split(stem(path), "_")
    n = F.size(part)
    made = lambda t, p: F.struct(part[0].alias("image_name"), t.alias("transformation"), p.alias("parameter"), lower_extension(path).alias("file_type"))
    none = F.lit(None).cast("string")
    return F.when(extension(path).isNull(), F.lit(None)).when((n == 2) & (F.get(part, 1) == "original"), made(F.lit("original"), none)).when(n == 3, made(F.get(part, 1), none)).when(n > 3, made(F.get(part, 1), F.get(part, 2)))
