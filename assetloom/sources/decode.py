"""Files to digests and perceptual hashes, with a row for every file that fails.

PNG is decoded here (all colour types and depths but interlaced pictures); JPEG and TIFF are decoded by the JVM where the
engine knows the folders (assetloom.sources.pictures); other formats need a decoder that is given as a function of bytes. A
JPEG that can't be decoded is tried again from each of its start marks, by a decoder that is given or by the JVM; if none
works it gets the fallback hash, which is flagged. Digests read a file in parts; digests and decoders run in a process
beside the worker, so that one that hangs or crashes, in foreign code too, costs its own file only."""

from __future__ import annotations

import hashlib
import multiprocessing
import os
import struct
import zlib
from collections.abc import Callable, Container, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Decoder = Callable[[bytes], np.ndarray]  # to height x width x 3, 8 bits
SCHEMA = "path string, digest binary, phash bigint, phash_enh array<bigint>, phash_is_fallback boolean, pixels bigint, stage string, error_class string, error_message string"
PNG_MARK, JPEG_MARK = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"


def png(data: bytes) -> np.ndarray:
    if data[:8] != PNG_MARK:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part, at = data[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlaced = head
    if interlaced or w == 0 or h == 0:
        raise ValueError("interlaced or empty picture")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    row, step = -(-w * channels * depth // 8), max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: h * (row + 1)].reshape(h, row + 1)
    out = np.zeros((h, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    if depth == 16:
        pixels = out.reshape(h, w, channels, 2)[..., 0]
    elif depth == 8:
        pixels = out.reshape(h, w, channels)
    else:
        bits = np.unpackbits(out, axis=1)[:, : w * depth].reshape(h, w, depth)
        pixels = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)[..., None].astype(np.uint8)
        if colour == 0:
            pixels = (pixels * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if channels < 3 else pixels[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        wide = np.pad(line, (0, -len(line) % step)).reshape(-1, step)
        return np.cumsum(wide, axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
    if kind not in (3, 4):
        raise ValueError(f"filter {kind}")
    out, up, row = bytearray(len(line)), above.tolist(), line.tolist()
    for i, x in enumerate(row):
        a, b, c = (out[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = x + guess & 255
    return np.frombuffer(bytes(out), np.uint8)


def nearest(picture: np.ndarray, w: int, h: int) -> np.ndarray:
    at = lambda n, real: np.minimum(((np.arange(n) + 0.5) * real / n).astype(int), real - 1)
    return picture[at(h, picture.shape[0])][:, at(w, picture.shape[1])]


def gray(picture: np.ndarray) -> np.ndarray:
    r, g, b = (picture[..., i].astype(np.float32) for i in range(3))
    return np.float32(0.299) * r + np.float32(0.587) * g + np.float32(0.114) * b


def word(pixels: np.ndarray, least: np.float32) -> int:
    return int(np.packbits(pixels > least, bitorder="little").view("<i8")[0])


def mean32(pixels: np.ndarray) -> np.float32:
    """A running sum in single precision, pixel by pixel."""
    return np.add.accumulate(pixels.reshape(-1), dtype=np.float32)[-1] / np.float32(pixels.size)


def phash(picture: np.ndarray) -> int:
    g = gray(nearest(picture, 8, 8)).reshape(-1)
    return word(g, mean32(g))


def phash_words(picture: np.ndarray) -> list[int]:
    g = gray(nearest(picture, 32, 32)).reshape(-1)
    m = mean32(g)
    return [word(g[64 * s : 64 * s + 64], m) for s in range(16)]


#: Filters for shrinking: how far they reach, and their weights.
FILTERS = {"triangle": (1.0, lambda x: np.maximum(0.0, 1 - np.abs(x))), "lanczos3": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0))}


def _weights(n: int, real: int, kind: str) -> np.ndarray:
    """A row of weights over the ``real`` pixels of a side for each of the n that it shrinks to."""
    reach, weight = FILTERS[kind]
    step = real / n
    wide = max(step, 1.0)
    x = (np.arange(real)[None, :] + 0.5 - ((np.arange(n) + 0.5) * step)[:, None]) / wide
    w = np.where(np.abs(x) <= reach, weight(x), 0.0)
    return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


def resized(picture: np.ndarray, w: int, h: int, kind: str) -> np.ndarray:
    if kind == "nearest":
        return nearest(picture, w, h)
    out = np.einsum("ab,bcd->acd", _weights(h, picture.shape[0], kind), picture.astype(np.float32), optimize=True)
    out = np.einsum("ab,cbd->cad", _weights(w, picture.shape[1], kind), out, optimize=True)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def shrunk(picture: np.ndarray, longest: int, kind: str) -> np.ndarray:
    """A picture beyond 1024 pixels with its longer side at ``longest``; others as they are."""
    h, w = picture.shape[:2]
    if max(h, w) <= 1024:
        return picture
    to = lambda a, b: max(1, int(np.floor(np.float32(a) * (np.float32(longest) / np.float32(b)) + np.float32(0.5))))
    return resized(picture, longest, to(h, w), kind) if w > h else resized(picture, to(w, h), longest, kind)


def phash_large(picture: np.ndarray, size: int) -> int:
    """The 64-bit hash of a picture that may be beyond 1024 pixels, shrunk first; the file's size tells how."""
    longest, kind = (768, "nearest") if size > 300_000_000 else (896, "triangle") if size > 100_000_000 else (1024, "lanczos3")
    return phash(shrunk(picture, longest, kind))


def phash_enhanced(picture: np.ndarray, format_: str) -> int | list[int]:
    """The long hash, of large pictures after shrinking; the 64-bit one for formats that have no long one."""
    return phash(picture) if format_ in ("heic", "tiff", "raw") else phash_words(shrunk(picture, 1024, "lanczos3"))


def fallback(path: str, size: int, mtime: float) -> int:
    """As assetloom.functions.hashing.fallback."""
    return int.from_bytes(hashlib.sha256(f"{os.path.basename(path)}/{size}/{int(mtime)}".encode("utf-8", "surrogateescape")).digest()[:8], "big", signed=True)


def recovered(data: bytes, decode: Decoder) -> np.ndarray | None:
    """The picture from the first start mark that decodes."""
    at = data.find(JPEG_MARK)
    while at >= 0:
        try:
            return decode(data[at:])
        except Exception:  # any decoder's error means: try the next mark
            at = data.find(JPEG_MARK, at + 1)
    return None


class HashCache:
    """Hashes by path, worked out once; emptied when it holds ``most``. For functions that hash pictures one by one."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def get(self, path: str, hash_: Callable[[str], object]) -> object:
        if path not in self.held:
            found = hash_(path)
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[path] = found
        return self.held[path]


class TimedOutError(Exception):
    pass


class DecoderDiedError(Exception):
    pass


class Guard:
    """A process of its own for work that may hang or crash in foreign code: the worker outlives it.

    ``work(*args)`` runs in a child that is forked when first asked and kept for the next; one that doesn't answer in time,
    or that dies, is ended, and the next question gets a new one. Results and errors come back over a pipe."""

    def __init__(self, work: Callable):
        self.work, self.child, self.pipe = work, None, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                args = pipe.recv()
            except EOFError:
                os._exit(0)
            try:
                out = (True, self.work(*args))
            except Exception as e:  # any decoder's error is the caller's to record
                out = (False, (type(e).__name__, str(e)[:500]))
            pipe.send(out)

    def ask(self, seconds: float, *args):
        """work(*args), or TimedOutError, DecoderDiedError, or FailedError with the error's class and text."""
        if self.child is None:
            context = multiprocessing.get_context("fork")
            self.pipe, other = context.Pipe()
            self.child = context.Process(target=self._serve, args=(other,), daemon=True)
            self.child.start()
            other.close()
        self.pipe.send(args)
        if not self.pipe.poll(seconds):
            self.end()
            raise TimedOutError(f"more than {seconds:g} s")
        try:
            good, value = self.pipe.recv()
        except EOFError:
            self.end()
            raise DecoderDiedError("the decoder's process ended") from None
        if not good:
            raise FailedError(*value)
        return value

    def end(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


class FailedError(Exception):
    """An error of guarded work: its class's name and its text."""


def work(decoders: dict[str, Decoder], digest: Callable[[BinaryIO], bytes], shrink: bool = False) -> Callable:
    """What a guard does: a file's digest, read in parts, or the hashes of its picture (None for a JPEG that no start mark helps).

    The long hash is that of the picture as phash_enhanced shrinks it (none for formats that have no long one); with
    ``shrink`` the short one is phash_large's, else every picture is sampled as it is."""

    def run(what: str, path: str, format_: str, enhanced: bool):
        with open(path, "rb") as f:
            if what == "digest":
                return digest(f)
            data, decode = f.read(), decoders[format_]
        picture = recovered(data, decode) if format_ == "jpeg" else decode(data)
        if picture is None:
            return None
        short = phash_large(picture, len(data)) if shrink else phash(picture)
        long = phash_enhanced(picture, format_) if enhanced else None
        return short, long if isinstance(long, list) else None, picture.shape[0] * picture.shape[1]

    return run


def hash_file(path: str, format_: str, known: Container[str], guard: Guard, seconds: tuple[float, float], enhanced: bool) -> tuple:
    """One row of SCHEMA. The perceptual hash is tried only after the digest. known: formats that the guard's work can decode."""

    def fail(stage: str, e: Exception, d: bytes | None = None) -> tuple:
        name, text = e.args if isinstance(e, FailedError) else (type(e).__name__, str(e))
        return path, d, None, None, None, None, stage, name, text[:500]

    try:
        size = os.path.getsize(path)
        if size == 0:
            raise ValueError("empty file")
    except (OSError, ValueError) as e:
        return fail("validate", e)
    try:
        d = guard.ask(seconds[0], "digest", path, format_, enhanced)
    except Exception as e:
        return fail("digest", e)
    try:
        if format_ not in known and format_ != "jpeg":
            raise LookupError(f"no handler for {format_}")
        found = guard.ask(seconds[1], "picture", path, format_, enhanced) if format_ in known else None
        if found is None:
            return path, d, fallback(path, size, os.path.getmtime(path)), None, True, None, None, None, None
        return path, d, found[0], found[1], False, found[2], None, None, None
    except Exception as e:
        return fail("phash", e, d)


def hashed(catalog: DataFrame, decoders: dict[str, Decoder] | None = None, digest: Callable[[BinaryIO], bytes] | None = None, enhanced: bool = False, count: Callable[[bool], None] | None = None, shrink: bool = False) -> DataFrame:
    """A row for each file of a catalog: hashes, or the stage and error that stopped it. digest: of an open file. count: is told
    of each file whether it worked."""
    from assetloom.functions.blake3 import blake3_file
    from assetloom.functions.records import DIGEST_SECONDS, PHASH_SECONDS

    known, how = {"png": png} | (decoders or {}), digest or blake3_file

    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard = Guard(work(known, how, shrink))
        for b in batches:
            rows = [hash_file(path, f, known, guard, (DIGEST_SECONDS.get(f, DIGEST_SECONDS[""]), PHASH_SECONDS.get(f, PHASH_SECONDS[""])), enhanced) for path, f in zip(b["path"].to_pylist(), b["format"].to_pylist(), strict=True)]
            for r in rows if count else ():
                count(r[6] is None)
            columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kinds[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])  # integers stay exact beside nulls
        guard.end()

    return catalog.select("path", "format").mapInArrow(run, SCHEMA)


def with_pictures(rows: DataFrame, pictures: DataFrame) -> DataFrame:
    """rows of hashed(), with what the JVM decoded in place of fallbacks and of failures to decode."""
    more = pictures.select("path", *[F.col(c).alias(f"jvm_{c}") for c in ("phash", "phash_enh", "pixels")])
    out = rows.join(more, "path", "left")
    better = F.col("digest").isNotNull() & F.col("jvm_phash").isNotNull() & (F.coalesce("phash_is_fallback", F.lit(False)) | (F.col("stage") == "phash"))
    to = {"phash": F.col("jvm_phash"), "phash_enh": F.col("jvm_phash_enh"), "phash_is_fallback": F.lit(False), "pixels": F.col("jvm_pixels")} | {c: F.lit(None).cast("string") for c in ("stage", "error_class", "error_message")}
    return out.select(*[F.when(F.coalesce(better, F.lit(False)), to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in rows.columns])


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes, and rejects."""
    good = rows.where("stage is null").select("path", "digest", "phash", "phash_enh", "phash_is_fallback", "pixels")
    return good, rows.where("stage is not null").select("path", "stage", "error_class", "error_message")
