"""BPE encoding and decoding with a word lexicon in a minimal acyclic transducer.

The corpus's most frequent words are compiled into a minimal acyclic automaton over UTF-8 bytes: equal suffixes share
states, every arc carries a number, and the numbers along a word's path add up to the word's place in the list of id
sequences (the output). The automaton is a few flat arrays in one file, which each worker maps into memory. Words that
it does not hold are merged exactly, many at a time. Decoding joins the tokens' strings with single spaces, as the
tokenizers library does for a file without a decoder.

Parameters: ``lexicon_words`` bounds the automaton (and so what is broadcast); word counts cover all rows. The result
doesn't depend on the lexicon, which only saves merging.

Defined results: null and empty texts have no ids; very long words are merged with a heap; repeated rows repeat in
the result; other columns are kept.
"""

from __future__ import annotations

import heapq
import hashlib
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import most_frequent, released, sent, slices, small_batches, staged

END = "</w>"
NONE = np.iinfo(np.int64).max
#: Of a worker: bytes of text that it splits at a time, words that it merges at a time, distinct words that it counts before it sends them.
SLICE, MERGED, COUNTED = 1_000_000, 5_000, 100_000


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def _latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each Latin-1 character: its class (0 space, 1 letter, 2 number, 3 other), and its lower case or a space."""
    kind, low = np.full(256, 3, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        if regex.match(r"\p{White_Space}", c):
            kind[i], low[i] = 0, 32
        elif unicodedata.category(c)[0] in "LN":
            kind[i] = 1 if unicodedata.category(c)[0] == "L" else 2
        if len(c.lower()) == 1 and ord(c.lower()) < 256 and kind[i]:
            low[i] = ord(c.lower())
    return kind, low


_KIND, _LOW = _latin_tables()
_CONTRACTED = re.compile(rb"'(?:[stmdSTMD]|[rR][eE]|[vV][eE]|[lL][lL])")


class Splitter:
    """Texts to the words that the vocabulary file's normaliser and pre-tokeniser make of them.

    Latin-1 texts are cut with byte tables. Other texts go through the two components that the file itself defines,
    so that their Unicode rules are the library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalize, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte = {c: b for b, c in enumerate(byte_letters())}

    def words(self, text: str | None) -> list[str]:
        """Words in order; special tokens stand among them as they are written."""
        if not text:
            return []
        if self.parts and "<|" in text:
            pieces = self.parts.split(text)
            return [w for i, p in enumerate(pieces) for w in ([p] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        if _CONTRACTED.search(raw):
            return self._any(text)
        buf = np.frombuffer(raw, dtype=np.uint8)
        kind, low = _KIND[buf], _LOW[buf]
        a, b = kind[:-1], kind[1:]
        cut = np.flatnonzero((a != 0) & (b != 0) & ((a != b) | (b == 2))) + 1
        return [w for w in np.insert(low, cut, 32).tobytes().decode("latin-1").split(" ") if w]

    def _any(self, text: str) -> list[str]:
        return [bytes(map(self.byte.__getitem__, piece)).decode("utf-8", "surrogatepass") for piece, _ in self.cut(self.normalize(text))]


class Merger:
    """Exact merging of single words by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letter = model["vocab"], byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = np.array([vocab[c] for c in letter], dtype=np.int64)
        self.last = np.array([vocab[c + END] for c in letter], dtype=np.int64)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        to = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.to = key[order], np.arange(len(pairs))[order], to[order]

    @cached_property
    def pair(self) -> dict[int, tuple[int, int]]:
        """Rank and result of each pair; only very long words need it."""
        return {k: (r, t) for k, r, t in zip(self.key.tolist(), self.rank.tolist(), self.to.tolist(), strict=True)}

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        hit = self.key[at] == k
        return np.where(hit, self.rank[at], NONE), self.to[at]

    def encode(self, found: Sequence[bytes], wide: int = 48) -> list[np.ndarray]:
        """Ids of each word, given in UTF-8."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(found)
        length = np.array([len(w) for w in found])
        groups = [(4, 0), (8, 4), (12, 8), (20, 12), (wide, 20)]
        for most, least in groups:
            for some in np.array_split(at := np.flatnonzero((length <= most) & (length > least)), max(1, -(-len(at) // MERGED))):
                if len(some):
                    self._batch([found[i] for i in some], length[some], most, some, out)
        for i in np.flatnonzero(length > wide):
            out[i] = self._long(found[i])
        return out

    def _batch(self, found: list[bytes], length: np.ndarray, wide: int, at: np.ndarray, out: list[np.ndarray]) -> None:
        n = len(found)
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in found), dtype=np.uint8).reshape(n, wide)
        ids = self.inner[raw]
        row = np.arange(n)
        ids[row, length - 1] = self.last[raw[row, length - 1]]
        ids[np.arange(wide) >= length[:, None]] = -1
        rank, to = np.full((n, wide), NONE), np.zeros((n, wide), dtype=np.int64)
        if wide > 1:
            r, t = self._find(ids[:, :-1], ids[:, 1:])
            inside = ids[:, 1:] >= 0
            rank[:, :-1], to[:, :-1] = np.where(inside, r, NONE), t
        length, live = length.copy(), row
        column = np.arange(wide)
        while len(live):
            best = rank[live].argmin(axis=1)
            more = rank[live, best] != NONE
            live, best = live[more], best[more]
            if not len(live):
                break
            merged = to[live, best]
            shift = np.minimum(column + (column > best[:, None]), wide - 1)  # drops the place after best
            x, r, t = (np.take_along_axis(m[live], shift, 1) for m in (ids, rank, to))
            x[:, -1] = np.where(shift[:, -1] == column[-1], -1, x[:, -1])
            some = np.arange(len(live))
            x[some, best] = merged
            length[live] -= 1
            r[:, -1] = NONE
            left = best > 0
            r[some[left], best[left] - 1], t[some[left], best[left] - 1] = self._find(x[some[left], best[left] - 1], merged[left])
            follows = best + 1 < length[live]
            r[some, best] = NONE
            r[some[follows], best[follows]], t[some[follows], best[follows]] = self._find(merged[follows], x[some[follows], best[follows] + 1])
            ids[live], rank[live], to[live] = x, r, t
        flat, end = ids[column < length[:, None]].astype(np.uint32), np.cumsum(length)
        for i, (e, k) in enumerate(zip(end.tolist(), length.tolist(), strict=True)):
            out[at[i]] = flat[e - k : e]

    def _long(self, word: bytes) -> np.ndarray:
        """One long word, in O(n log n)."""
        ids = [*self.inner[np.frombuffer(word[:-1], dtype=np.uint8)].tolist(), int(self.last[word[-1]])]
        after, before, gone = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1)), [False] * len(ids)
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (p := self.pair.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = self.pair[a << 32 | b][1], True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := self.pair.get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[y]))
        return np.array([x for x, g in zip(ids, gone, strict=True) if not g], dtype=np.uint32)


def compile_lexicon(entries: Iterable[tuple[bytes, np.ndarray]]) -> bytes:
    """The automaton's file. entries: distinct words in UTF-8 with their ids, sorted by word.

    Layout: seven uint64 lengths, then the arrays: arc keys (state << 8 | byte, sorted), arc targets, arc outputs,
    final states, where each word's ids begin, ids, and the start state."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...)); words below are counted in `below`
    below: list[int] = []
    path: list[list] = [[False, []]]  # the unfinished states of the last word: final, arcs
    last, starts, ids = b"", [0], []

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if (s := register.get(key)) is None:
                s = register[key] = len(states)
                states.append(key)
                below.append(final + sum(below[t] for _, t in arcs))
            path[-1][1][-1] = (path[-1][1][-1][0], s)

    for word, seq in entries:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        close(common)
        for b in word[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
        ids.append(np.asarray(seq, dtype=np.uint32))
        starts.append(starts[-1] + len(seq))
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):
        before = int(final)
        for b, t in arcs:
            keys.append(s << 8 | b)
            targets.append(t)
            outputs.append(before)
            before += below[t]
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), np.array([f for f, _ in states], np.int64), np.array(starts, np.int64), np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int64), np.array([len(states) - 1], np.int64)]
    return np.array([len(a) for a in arrays], np.uint64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped from a file of the worker's own that is unlinked at once."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)
        n, at, arrays = np.frombuffer(self.map, np.uint64, 7), 56, []
        for k in n.tolist():
            arrays.append(np.frombuffer(self.map, np.int64, k, at))
            at += 8 * k
        self.key, self.target, self.output, self.final, self.start, self.ids, first = arrays
        self.first = int(first[0])

    def find(self, found: Sequence[bytes]) -> np.ndarray:
        """Each word's place in the list of outputs, or -1."""
        place = np.full(len(found), -1)
        if not len(self.key) or not len(found):
            return place
        length = np.array([len(w) for w in found])
        begin = np.cumsum(length) - length
        data = np.frombuffer(b"".join(found) + b"\0", dtype=np.uint8)
        live, state, total, step = np.arange(len(found)), np.full(len(found), self.first), np.zeros(len(found), dtype=np.int64), 0
        while len(live):
            done = length[live] == step
            ends = live[done]
            ok = self.final[state[done]] == 1
            place[ends[ok]] = total[done][ok]
            live, state, total = live[~done], state[~done], total[~done]
            if not len(live):
                break
            k = state << 8 | data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[at] == k
            live, at = live[hit], at[hit]
            state, total = self.target[at], total[hit] + self.output[at]
            step += 1
        return place


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, lexicon: bytes):
        self.split, self.merge, self.lexicon = Splitter(path), Merger(path), Lexicon(lexicon)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        strings = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.token = [b""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            self.token[i] = s.encode()

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32."""
        found = [self.split.words(t) for t in texts]
        distinct = list({w: None for ws in found for w in ws})
        known = {w: np.array([i], dtype=np.uint32) for w, i in self.split.special.items()}
        plain = [w for w in distinct if w not in known]
        raw = [w.encode("utf-8", "surrogatepass") for w in plain]
        place = self.lexicon.find(raw)
        start, ids = self.lexicon.start, self.lexicon.ids
        for i in np.flatnonzero(place >= 0).tolist():
            p = place[i]
            known[plain[i]] = ids[start[p] : start[p + 1]].astype(np.uint32)
        rest = np.flatnonzero(place < 0).tolist()
        for i, x in zip(rest, self.merge.encode([raw[i] for i in rest]), strict=True):
            known[plain[i]] = x
        as_bytes = {w: x.tobytes() for w, x in known.items()}
        return [np.frombuffer(b"".join([as_bytes[w] for w in ws]), dtype=np.uint32) for ws in found]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8."""
        return b" ".join(map(self.token.__getitem__, ids.tolist()))


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """How often each word occurs in all rows: word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = Splitter(path), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

        released()  # of what reading the file took
        for b in slices(batches, text, SLICE):
            for t in b.column(0).to_pylist():
                count.update(split.words(t))
            if len(count) > COUNTED:
                yield out()
                count.clear()
        yield out()
        del split
        count.clear()
        released()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(spark: SparkSession, docs: DataFrame, path: str, lexicon_words: int = 65_536, text: str = "text") -> bytes:
    small_batches(spark)
    counts = staged(spark, word_counts(docs, path, text).where(F.octet_length("word") <= 64), "words")
    top = most_frequent(counts, lexicon_words).select("word").collect()  # lexicon_words rows at most
    special = Splitter(path).special
    raw = sorted(r["word"].encode() for r in top if r["word"] not in special)
    return compile_lexicon(zip(raw, Merger(path).encode(raw), strict=True))


def encoded(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", **how) -> DataFrame:
    """docs, without the text, with n_tokens, ids_sha256, decoded_sha256, and (general interface) ids; columns of docs with
    these names give way."""
    return _coded(spark, docs, path, text, True, **how)


def _coded(spark: SparkSession, docs: DataFrame, path: str, text: str, with_ids: bool, **how) -> DataFrame:
    shared = sent(spark, build_lexicon(spark, docs, path, text=text, **how))  # lexicon_words words at most
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (text.lower(), "n_tokens", "ids_sha256", "decoded_sha256", "ids")], F.col(text).alias("__al_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, shared.value)
        released()  # of what reading the file took
        for b in slices(batches, "__al_text", SLICE):
            ids = codec.encode(b.column(b.num_columns - 1).to_pylist())
            more = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])]
            if with_ids:
                more.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=schema.names)
            del ids, more
        del codec
        released()

    return rows.mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    return _coded(spark, docs.select("doc_id", "text"), path or default_path(), "text", False)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
