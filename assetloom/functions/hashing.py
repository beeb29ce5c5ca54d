"""Digests and perceptual hashes as column expressions.

A 64-bit hash is a bigint (two's complement); its text is 16 hexadecimal digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(content: Column) -> Column:
    """SHA-256 in hexadecimal: equal exactly for equal contents. For BLAKE3 see assetloom.functions.blake3."""
    return F.sha2(content, 256)


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def mean(pixels: Column, n: int) -> Column:
    """In single precision, summed pixel by pixel, as the hashes are defined; so does assetloom.sources.decode."""
    return (F.aggregate(pixels, F.lit(0.0).cast("float"), lambda a, x: a + x.cast("float")) / F.lit(float(n))).cast("float")


def _with_mean(pixels: Column, n: int, made: Callable[[Column], Column]) -> Column:
    """made(mean), with the mean worked out once a row: as a plain expression it would be repeated in every bit."""
    return F.get(F.transform(F.array(mean(pixels, n)), made), 0)


def threshold_bits(pixels: Column, least: Column, start: int = 0) -> Column:
    """64 bits: bit i is set where pixel start + i is above the mean."""
    one = F.array(*[F.lit(_bit(i)).cast("long") for i in range(64)])
    part = F.slice(pixels, start + 1, 64)
    return F.aggregate(F.zip_with(part, one, lambda x, b: F.when(x.cast("float") > least, b).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def phash64(pixels: Column) -> Column:
    """Mean-threshold hash of an 8 x 8 grid, row by row, lowest bit first."""
    return _with_mean(pixels, 64, lambda m: threshold_bits(pixels, m))


def phash1024(pixels: Column) -> Column:
    """Sixteen words of a 32 x 32 grid; bit i of word s is pixel 64 s + i."""
    return _with_mean(pixels, 1024, lambda m: F.array(*[threshold_bits(pixels, m, 64 * s) for s in range(16)]))


def sampled(pixels: Column, width: Column, height: Column) -> Column:
    """64 pixels at steps of max(side, 8) / 8 whole pixels, clamped to the edge: what a side has beyond 8 steps isn't seen."""
    step = lambda side: F.floor(F.greatest(side, F.lit(8)) / 8).cast("int")
    at = lambda i, side: F.least(F.lit(i) * step(side), side - 1)
    return F.array(*[F.get(pixels, (at(y, height) * width + at(x, width)).cast("int")) for y in range(8) for x in range(8)])


def phash_fast(pixels: Column, width: Column, height: Column) -> Column:
    return phash64(sampled(pixels, width, height))


def is_flat(phash: Column) -> Column:
    """Flat pictures pile up on no bits and all bits."""
    return phash.isin(0, -1)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Sum over the words of two long hashes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def hamming_mixed(short: Column, words: Column) -> Column:
    """A 64-bit hash against word 0 of a long one: it compares different areas of the pictures, a quirk that is kept."""
    return hamming(short, F.get(words, 0))


def similar(a: Column, b: Column, max_distance: int) -> Column:
    return hamming(a, b) <= max_distance


def similar_words(a: Column, b: Column, max_distance: int) -> Column:
    """The threshold of 64-bit hashes, times 16."""
    return hamming_words(a, b) <= 16 * max_distance


def hex16(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def to_bytes(h: Column) -> Column:
    """Eight bytes, highest first."""
    return F.unhex(F.lpad(F.hex(h), 16, "0"))


def words_to_bytes(h: Column) -> Column:
    return F.unhex(F.array_join(F.transform(h, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def from_bytes(b: Column, word: int = 0) -> Column:
    """Word of 8-byte (or 128-byte) codes, in two halves since the whole would overflow."""
    half = lambda at: F.conv(F.hex(F.substring(b, at, 4)), 16, 10).cast("long")
    return F.shiftleft(half(8 * word + 1), 32).bitwiseOR(half(8 * word + 5))


def fallback(name: Column, size: Column, mtime: Column) -> Column:
    """The first eight bytes of the SHA-256 of name/size/seconds, for files that can't be decoded; callers set
    phash_is_fallback, and such hashes enter no similarity join. assetloom.sources.decode has the same in Python."""
    seconds = F.unix_seconds(mtime.cast("timestamp")).cast("string")
    return from_bytes(F.unhex(F.sha2(F.concat(name, F.lit("/"), size.cast("long").cast("string"), F.lit("/"), seconds), 256)))


def target_size(w: Column, h: Column, longest: Column) -> tuple[Column, Column]:
    """Width and height with the longer side at ``longest``; worked out in single precision."""
    single = lambda x: x.cast("float")
    to = lambda a, b: F.round(single(single(a) * single(single(longest) / single(b)))).cast("int")
    return F.when(w > h, longest).otherwise(to(w, h)), F.when(w > h, to(h, w)).otherwise(longest)


def resize_plan(w: Column, h: Column, size: Column) -> tuple[Column, Column]:
    """Longest side and filter for pictures beyond 1024 pixels, by the file's size; null where none is needed."""
    mb, large = 1_000_000, F.greatest(w, h) > 1024
    side = F.when(large, F.when(size > 300 * mb, 768).when(size > 100 * mb, 896).otherwise(1024))
    kind = F.when(large, F.when(size > 300 * mb, "nearest").when(size > 100 * mb, "triangle").otherwise("lanczos3"))
    return side, kind
