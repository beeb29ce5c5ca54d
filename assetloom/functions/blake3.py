"""BLAKE3-256 after its published specification, many blocks at a time in numpy."""

from __future__ import annotations

import io
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (n, 8) of n blocks (n, 16)."""
    n = len(cv)
    v = [cv[:, i].copy() for i in range(8)] + [np.full(n, IV[i], np.uint32) for i in range(4)]
    v += [(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = [block[:, i] for i in range(16)]

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            v[a] = v[a] + v[b] + word
            v[d] = _turn(v[d] ^ v[a], r1)
            v[c] = v[c] + v[d]
            v[b] = _turn(v[b] ^ v[c], r2)

    for _ in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[p] for p in PERMUTATION]
    return np.column_stack([v[i] ^ v[i + 8] for i in range(8)])


def _joined(left: np.ndarray, right: np.ndarray, root: bool = False) -> np.ndarray:
    """Chaining values (n, 8) of n parents."""
    n = len(left)
    return _compress(np.tile(IV, (n, 1)), np.concatenate((left, right), axis=1), np.zeros(n, np.int64), np.full(n, BLOCK), np.full(n, PARENT + ROOT * root))


def _subtree(data: bytes, first: int, whole: bool) -> np.ndarray:
    """The chaining value of a part's chunks, of which the first has this number; of all the data's, if whole."""
    chunks = max(1, -(-len(data) // CHUNK))
    raw = np.frombuffer(data.ljust(chunks * CHUNK, b"\0"), "<u4").reshape(chunks, 16, 16)
    size = np.full(chunks, CHUNK)
    size[-1] = len(data) - (chunks - 1) * CHUNK
    blocks = np.maximum(1, -(-size // BLOCK))
    cv, counter = np.tile(IV, (chunks, 1)), first + np.arange(chunks, dtype=np.int64)
    for b in range(16):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = (CHUNK_START if b == 0 else 0) + CHUNK_END * last + (ROOT * last if whole and chunks == 1 else 0)
        cv[live] = _compress(cv[live], raw[live, b], counter[live], np.minimum(BLOCK, size[live] - b * BLOCK), flags)
    while len(cv) > 1:  # pairs from the left make the specification's left-full tree
        pairs = len(cv) // 2
        up = _joined(cv[0 : 2 * pairs : 2], cv[1 : 2 * pairs : 2], whole and len(cv) == 2)
        cv = np.concatenate((up, cv[2 * pairs :]))
    return cv


#: Bytes that are read and worked out at a time: a power of two of chunks.
PART = 4096 * CHUNK


def blake3_file(file: BinaryIO, part: int = PART) -> bytes:
    """BLAKE3 of what a file has from here on, in memory for one part and a chaining value for each level of the tree."""
    data, done, full = file.read(part), 0, []
    while len(data) == part and (after := file.read(part)):
        cv = _subtree(data, done * (part // CHUNK), False)
        done, data = done + 1, after
        for _ in range((done & -done).bit_length() - 1):  # as many full trees of equal height end here
            cv = _joined(full.pop(), cv)
        full.append(cv)
        if len(data) < part:  # a short read isn't the end yet
            while len(data) < part and (more := file.read(part - len(data))):
                data += more
    cv = _subtree(data, done * (part // CHUNK), not full)
    while full:
        cv = _joined(full.pop(), cv, not full)
    return cv[0].astype("<u4").tobytes()


def blake3(data: bytes) -> bytes:
    return blake3_file(io.BytesIO(data))


def blake3_digest(content: Column) -> Column:
    """BLAKE3 of a binary column, 32 bytes."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else blake3(bytes(b)))

    return run(content)
