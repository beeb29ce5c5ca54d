"""Token ids in files of fixed-width packed bits.

Every id takes the fewest bits that hold the vocabulary's ids. A shard file is

    blocks | offsets of the blocks, u64 each and one for the end, in bytes from the first
    | document lengths u64 | document ids i64 | flags u8 (1: null id)
    | magic "ALPK" | version u32 | bits u32 | ids per block u32 | number of ids u64 | number of documents u64

all little-endian; a block holds ids lowest bit first and starts at a whole byte, so any range of ids is read by
unpacking a few blocks with numpy. Blocks are written as they fill; a writer holds a block and 17 bytes a document.
Shards hold ranges of doc_id in ascending order, about ``shard_bytes`` of text each; their names and counts are in a
small manifest, whose running sums give every document's place in the whole.

Shards go to the folder that the cluster shares, each under a name of its own attempt and then renamed: a task that
runs twice leaves one whole file. Encoding uses the tokenizers library once for each distinct word that a worker
sees (words of Latin-1 texts; other texts are encoded whole); the worker process keeps them for its next shard, 400,000
words of up to 64 letters or what one slice of text adds to them.

Defined results: null and empty texts hold the end id only; rows with equal doc_id stand next to each other in order
of their text's crc32, then text (so that an id of many rows spreads over shards); a null doc_id comes first; texts of any
length are encoded whole; an empty table gives no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.bpe import _CONTRACTED, _KIND, _LOW, byte_letters, default_path
from assetloom.llm.common import fresh_dir, slices

MAGIC = b"ALPK"
HEAD = struct.Struct("<4sIIIQQ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids with ``bits`` bits each, lowest bit first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


class ShardWriter:
    """Writes documents to an open file."""

    def __init__(self, f, bits: int, block: int = 8192):
        self.f, self.bits, self.block = f, bits, block
        self.offsets, self.left, self.held, self.n, self.docs = array("Q", [0]), [], 0, 0, 0
        self.lengths, self.ids, self.null = array("Q"), array("q"), bytearray()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.lengths.append(len(ids))
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.n, self.docs = self.n + len(ids), self.docs + 1
        self.left.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.left)
            end = len(whole) - len(whole) % self.block
            for at in range(0, end, self.block):
                self._flush(whole[at : at + self.block])
            self.left, self.held = [whole[end:]], len(whole) - end

    def _flush(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.f.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def finish(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.left))
        for x, kind in ((self.offsets, "<u8"), (self.lengths, "<u8"), (self.ids, "<i8")):
            self.f.write(np.array(x, kind).tobytes())
        self.f.write(bytes(self.null))
        self.f.write(HEAD.pack(MAGIC, 2, self.bits, self.block, self.n, self.docs))


class ShardReader:
    """Random access to a shard; f is any seekable file."""

    def __init__(self, f):
        self.f = f
        f.seek(-HEAD.size, 2)
        magic, _, self.bits, self.block, self.n, docs = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        blocks = -(-self.n // self.block) + 1
        f.seek(-HEAD.size - 17 * docs - 8 * blocks, 2)
        self.offsets = np.frombuffer(f.read(8 * blocks), "<u8")
        self.lengths = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
        self.doc_ids, self.null = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(docs), "u1")
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids start to start + n, unpacked from the blocks that hold them."""
        if not n:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (start + n - 1) // self.block
        self.f.seek(int(self.offsets[a]))
        data = memoryview(self.f.read(int(self.offsets[b + 1] - self.offsets[a])))
        base = int(self.offsets[a])
        got = [unpack(data[int(self.offsets[i]) - base : int(self.offsets[i + 1]) - base], self.bits, min(self.block, self.n - i * self.block)) for i in range(a, b + 1)]
        return np.concatenate(got)[start - a * self.block :][:n]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.lengths[i]))

    def checksums(self, blocks: int = 64) -> Iterator[int]:
        """The crc32 of each document in order; every block is unpacked once, some at a time."""
        at, held = 0, memoryview(b"")
        for length in self.lengths.tolist():
            crc, left = 0, 4 * length
            while left:
                if not held:
                    part = self.ids(at, min(self.block * blocks, self.n - at))
                    at += len(part)
                    held = memoryview(part.astype("<u4").tobytes())
                take = min(left, len(held))
                crc, held, left = zlib.crc32(held[:take], crc), held[take:], left - take
            yield crc


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct word; a bounded memo holds what it said.

    Latin-1 texts of a slice are cut into words together, by byte tables that follow the file's normaliser and
    pre-tokeniser; the words are numbered by Arrow, so that Python only meets the distinct ones. Other texts, and those
    where special tokens may stand, are encoded whole."""

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads' arenas would only hold memory
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.memo, self.most, self.longest = {}, most, longest
        letter = byte_letters()
        self.letters = {i: "".join(letter[b] for b in chr(i).encode()) for i in range(256)}

    @property
    def bits(self) -> int:
        return max(1, int(self.whole.get_vocab_size() - 1).bit_length())

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; the memo keeps those of words up to ``longest``."""
        memo, tokenize = self.memo, self.model.tokenize
        out = [memo.get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        if len(memo) + len(new) > self.most:
            memo.clear()
        for i in new:
            w = words[i]
            out[i] = array("I", [t.id for t in tokenize(w.translate(self.letters))]).tobytes()
            if len(w) <= self.longest:
                memo[w] = out[i]
        return out

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(texts)
        plain, raw = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            latin = _latin(t) if "<|" not in t else None
            if latin is None:
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                plain.append(i)
                raw.append(latin)
        for i, ids in zip(plain, self._together(raw), strict=True):
            out[i] = ids
        return out

    def _together(self, raw: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each Latin-1 text."""
        words, first = cut(raw)
        if not len(words):
            yield from [np.empty(0, dtype=np.uint32)] * len(raw)
            return
        numbered = words.dictionary_encode()
        _, place, data = numbered.dictionary.buffers()
        place = np.frombuffer(place, np.int64, len(numbered.dictionary) + 1)
        distinct = np.insert(np.frombuffer(data, np.uint8, place[-1]), place[1:-1], 32).tobytes().decode("latin-1").split(" ")
        flat = pa.array(self._ids(distinct), pa.large_binary()).take(numbered.indices)
        _, place, data = flat.buffers()
        place, ids = np.frombuffer(place, np.int64, len(flat) + 1) // 4, np.frombuffer(data, np.uint32)
        for a, b in itertools.pairwise(place[first].tolist()):
            yield ids[a:b]


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


_KINDS, _LOWERED, _SPACES = _KIND.tobytes(), _LOW.tobytes(), np.flatnonzero(_KIND == 0).astype(np.uint8).tobytes()


def cut(raw: Sequence[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of Latin-1 texts one after another, in lower case, and where each text's begin (and one for the end).

    A word is a run of letters, a single number, a run of other characters, or a contraction's ending: an apostrophe that no
    other character stands before, with the letters that _CONTRACTED allows."""
    text = b" ".join(raw)
    kind = np.frombuffer(text.translate(_KINDS), dtype=np.uint8)
    inside = kind != 0
    starts = kind == 2
    starts[:1] = True
    starts[1:] |= kind[1:] != kind[:-1]
    starts &= inside
    if b"'" in text:
        for m in _CONTRACTED.finditer(text):
            if starts[m.start()]:
                starts[m.start() + 1] = False
                if m.end() < len(text) and inside[m.end()]:
                    starts[m.end()] = True
    begin = np.cumsum([0, *(len(t) + 1 for t in raw)])
    first = np.searchsorted(np.flatnonzero(starts), begin)
    low = text.translate(_LOWERED, _SPACES)
    place = np.append(np.flatnonzero(starts[inside]), len(low))
    return pa.Array.from_buffers(pa.large_binary(), len(place) - 1, [None, pa.py_buffer(place), pa.py_buffer(low)]), first


@lru_cache(maxsize=1)
def _encoder(path: str, changed: int) -> LibraryEncoder:
    """One for all shards that a worker process writes, with what it has learnt; changed: the file's time, in ns."""
    return LibraryEncoder(path)


def write(spark: SparkSession, docs: DataFrame, directory: str, path: str, end_id: int = 2, shard_bytes: int = 16_000_000) -> list[tuple[int, str, int, int]]:
    """Encodes docs (doc_id, text) and writes the shards; the manifest: (number, file, documents, ids) a shard, in order."""
    n = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    rows = rows.repartitionByRange(n, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "text").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        f = writer = None
        shard = 0
        store, folder = fs.FileSystem.from_uri(directory)
        for b in slices(batches, "text", 1_500_000):
            if not b.num_rows:
                continue
            if writer is None:
                shard, encoder = b["shard"][0].as_py(), _encoder(path, os.stat(path).st_mtime_ns)
                store.create_dir(folder, recursive=True)
                name = f"{folder}/shard-{shard:06d}.alpk"
                mine = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                f = store.open_output_stream(mine)
                writer = ShardWriter(f, encoder.bits)
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoder.encode(b["text"].to_pylist()), strict=True):
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is None:
            return
        writer.finish()
        f.close()
        store.move(mine, name)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{directory}/shard-{shard:06d}.alpk"]), pa.array([writer.docs], pa.int64()), pa.array([writer.n], pa.int64())], names=["shard", "file", "docs", "ids"])

    return sorted(tuple(r) for r in rows.mapInArrow(run, "shard int, file string, docs long, ids long").collect())  # one row a shard


def read(spark: SparkSession, manifest: Sequence[tuple[int, str, int, int]]) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32, by reading the files back."""
    base, rows = 0, []
    for _, name, _, n in manifest:
        rows.append((name, base))
        base += n
    listed = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b["file"].to_pylist(), b["base"].to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as f:
                    r = ShardReader(f)
                    sums = r.checksums()
                    for at in range(0, len(r.lengths), 4096):
                        part = slice(at, min(at + 4096, len(r.lengths)))
                        crc = list(itertools.islice(sums, part.stop - at))
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[part], pa.int64(), mask=r.null[part].astype(bool)), pa.array(r.starts[part] + start), pa.array(r.lengths[part]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_packed_ids(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    return read(spark, write(spark, docs, fresh_dir(spark, "shards"), path or default_path()))
