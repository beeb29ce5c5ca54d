"""Toxicity: a sparse logistic model with a counterfactual penalty.

A text's features are its distinct lower-cased words, and prefixes and suffixes of these (word families share a
stem), hashed to ``2**BITS`` places. Weights minimise the log loss with an L1 penalty, plus ``swap_weight`` times the
squared change of the logit between counterfactual versions of labelled sentences, so that a group mention by itself
moves no score: an identity term of the sentence is swapped for others of its language; a sentence without one is
compared with itself after a neutral mention, and that mention's term is swapped in turn.

The fit uses a bounded sample, chosen by hash: at most ``sample_rows`` labelled rows. Scores cover every whole text.

Defined results: null and empty texts get the score of a text without features; a text's repeated words count once;
texts of any length are read whole; equal texts have equal scores, repeated rows each their own; a score of just 0.5
predicts 1; with no labelled row every score is 0; a doc_id with several labels counts as toxic if one of them says so; a
labelled doc_id of several rows is learnt from its smallest text; an empty table gives no rows; other columns are kept
as they are.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import fold, mix64, released, sent, slices, small_batches

BITS = 20
#: Bytes of text that a worker cuts into words at a time.
SLICE = 1_000_000
_LETTERS = re.compile(r"[^\W\d_]+")
#: Neutral group mentions, by language. Fixed values; other lists can be given.
IDENTITY_TERMS = (
    tuple("african american arab asian atheist bisexual black blind buddhist catholic chinese christian christians deaf disabled elderly european female gay hindu homosexual immigrant immigrants indian jew jewish jews latino lesbian male man men mexican muslim muslims old protestant queer refugee refugees sikh straight trans transgender white woman women young".split()),
    tuple("afrikaner amerikaner araber asiaten atheisten behinderte blinde buddhisten chinesen christen deutsche frauen gehörlose hindus homosexuelle inder juden katholiken lesben männer migranten muslime protestanten schwarze schwule türken weiße".split()),
    tuple("africains américains arabes asiatiques athées aveugles bouddhistes catholiques chinois chrétiens femmes handicapés hindous hommes homosexuels immigrés indiens juifs lesbiennes musulmans noirs protestants réfugiés sourds".split()),
    tuple("africanos americanos asiáticos ateos blancos budistas católicos chinos ciegos cristianos discapacitados gitanos hindúes hombres homosexuales indios inmigrantes judíos lesbianas mujeres musulmanes negros protestantes refugiados sordos".split()),
)
Terms = Sequence[Sequence[str]]


def letters(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _hash(kind: int, piece: bytes) -> int:
    """FNV-1a over the piece, then mixed."""
    h = 0xCBF29CE484222325 ^ kind
    for b in piece:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


class Features:
    """Feature numbers of words; a bounded memo keeps those of words seen before, as bytes."""

    def __init__(self, most: int = 100_000):
        self.memo: dict[str, bytes] = {}
        self.most = most

    def add(self, found: Sequence[str]) -> None:
        new = [w for w in dict.fromkeys(found) if w not in self.memo]
        if not new:
            return
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = list(dict.fromkeys(found))
        kinds = [(0, w) for w in new] + [(n, w[:n]) for n in (4, 5, 6) for w in new if len(w) > n] + [(10 + n, w[-n:]) for n in (5,) for w in new if len(w) > n]
        index = {x: i for i, x in enumerate(dict.fromkeys(kinds))}
        number = (mix64(np.array([_hash(k, w.encode()) for k, w in index], dtype=np.uint64)) >> np.uint64(64 - BITS)).astype(np.int32).tobytes()
        at = lambda k, w: number[4 * (i := index[k, w]) : 4 * i + 4]
        for w in new:
            n = len(w)
            self.memo[w] = b"".join([at(0, w), *[at(k, w[:k]) for k in (4, 5, 6) if n > k], *([at(15, w[-5:])] if n > 5 else [])])

    def of(self, found: Sequence[str]) -> np.ndarray:
        """Distinct feature numbers of a text with these words."""
        distinct = dict.fromkeys(found)
        return np.unique(np.frombuffer(b"".join(map(self.memo.__getitem__, distinct)), dtype=np.int32))


class Rows:
    """A sparse 0/1 (or signed) matrix, by rows and by columns, in four bytes an entry each."""

    def __init__(self, rows: Sequence[np.ndarray], width: int, signs: Sequence[np.ndarray] | None = None):
        self.n, self.width = len(rows), width
        self.col = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
        self.sign = None if signs is None else np.concatenate([*signs, np.empty(0, np.int8)]).astype(np.int8)
        size = np.array([len(r) for r in rows], dtype=np.int64)
        order = np.argsort(self.col, kind="stable").astype(np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), size)[order]
        self.row_sign = None if signs is None else self.sign[order]
        self.filled, self.used = np.flatnonzero(size), np.flatnonzero(np.bincount(self.col, minlength=width))
        self.starts = (np.cumsum(size) - size)[self.filled]
        self.tops = np.searchsorted(self.col[order], self.used)

    @staticmethod
    def _sums(values: np.ndarray, sign: np.ndarray | None, starts: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(starts):
            if sign is not None:
                values *= sign
            out[at] = np.add.reduceat(values, starts)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.col], self.sign, self.starts, self.filled, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sums(g[self.row], self.row_sign, self.tops, self.used, self.width)


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Without BLAS, whose idle threads would spin."""
    return float(np.einsum("i,i->", a, b))


def train(x: Sequence[np.ndarray], y: np.ndarray, swaps: Sequence[tuple[np.ndarray, np.ndarray]] = (), l1: float = 1e-3, swap_weight: float = 5.0, steps: int = 250, still: float = 1e-2, size: int = 1 << BITS) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated proximal gradient, until ten steps lower the loss by less than ``still`` of it.
    swaps: features lost and gained by each swap."""
    count = np.bincount(np.concatenate([*x, np.empty(0, dtype=np.int32)]), minlength=size)
    used = np.flatnonzero(count >= 3)  # a term that no text has keeps a weight of 0 and needs no penalty
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    narrow = lambda r: (p := place[r])[p >= 0]
    n, k = len(y), len(used)
    m = Rows([narrow(r) for r in x], k)
    gone = [(narrow(a), narrow(b)) for a, b in swaps]
    c = Rows([np.concatenate(p) for p in gone], k, [np.repeat(np.array([-1, 1], np.int8), [len(a), len(b)]) for a, b in gone]) if gone else None
    del gone
    scale = 1 / np.sqrt(np.maximum(count[used], 1) / n)  # a rare feature moves as freely as a common one
    scale = np.minimum(scale, 20.0)
    w, v, b, t = np.zeros(k), np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 1.0
    vb, step = b, 1.0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if 0 < y.mean() < 1 else np.ones(n)
    weight = np.sqrt(weight)

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, np.ndarray | None]:
        z = m.times(w * scale) + b
        d = c.times(w * scale) if c else None
        return float((weight * (np.logaddexp(0, z) - y * z)).mean() + (swap_weight * _dot(d, d) / max(c.n, 1) if c else 0)), z, d

    past = []
    for _ in range(steps):
        f, z, d = loss(v, vb)
        past.append(f + l1 * np.abs(v).sum())
        if len(past) > 10 and past[-11] - past[-1] < still * past[-11]:
            break
        r = weight * (1 / (1 + np.exp(-z)) - y) / n
        g = m.back(r) * scale + (2 * swap_weight / max(c.n, 1) * c.back(d) * scale if c else 0)
        gb = r.sum()
        while True:
            new = v - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            nb = vb - step * gb
            dw = new - v
            if loss(new, nb)[0] <= f + _dot(g, dw) + gb * (nb - vb) + (_dot(dw, dw) + (nb - vb) ** 2) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t, step = new, nb, t2, step * 1.1
    out = np.zeros(size, dtype=np.float32)
    out[used] = w * scale
    return out, b


def swapped(found: Sequence[str], terms: Terms, features: Features, others: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features that each counterfactual version of a text takes away and brings. Which terms replace a term, and which
    are mentioned, follows from the text."""
    have, out = set(found), []
    choice = random.Random(zlib.crc32(" ".join(found).encode("utf-8", "surrogatepass")))

    def change(gone: str | None, new: str | None, rest: np.ndarray) -> None:
        lost, gained = (np.setdiff1d(features.of([w]), rest) if w else np.empty(0, np.int32) for w in (gone, new))
        out.append((np.setdiff1d(lost, gained), np.setdiff1d(gained, lost)))

    for group in terms:
        for a in (t for t in group if t in have):
            rest = features.of([w for w in have if w != a])
            for b in choice.sample([t for t in group if t not in have], min(others, sum(t not in have for t in group))):
                change(a, b, rest)
    if not out and terms:
        rest = features.of(list(have)) if have else np.empty(0, np.int32)
        group = choice.choice([g for g in terms if g])
        a, *more = choice.sample(list(group), min(others, len(group)))
        change(None, a, rest)
        for b in more:
            change(a, b, rest)
    return out


def gathered(docs: DataFrame, labels: DataFrame, terms: Terms = IDENTITY_TERMS, sample_rows: int = 8000, text: str = "text", key: str = "doc_id") -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Features and labels of the labelled rows of docs, and their counterfactual changes."""
    small_batches(docs.sparkSession)
    y = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("k")).agg(F.max("toxic").alias("y"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rate = min(1.0, sample_rows / max(1, y.count()))
    unit = F.shiftrightunsigned(F.xxhash64("k"), 11).cast("double") / F.lit(float(2**53))
    few = rows.join(F.broadcast(y.where(unit < rate)), "k").where("t is not null").groupBy("k", "y").agg(F.min("t").alias("t"))  # about sample_rows rows at most
    flat_terms = [t for g in terms for t in g]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in slices(batches, "t", SLICE):
            got, ys = [], []
            for k, t, v in zip(b["k"].to_pylist(), b["t"].to_pylist(), b["y"].to_pylist(), strict=True):
                found = letters(t)
                f.add([*found, *flat_terms])
                got.append([(k, 0, f.of(found), [])] + [(k, 1, *p) for p in swapped(found, terms, f)])
                ys += [v] * len(got[-1])
            flat = [x for g in got for x in g]
            order = [zlib.crc32(np.asarray(x[3], np.int32).tobytes(), zlib.crc32(np.asarray(x[2], np.int32).tobytes())) for x in flat]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()), pa.array(ys, pa.int32()), pa.array([x[2] for x in flat], pa.list_(pa.int32())), pa.array([x[3] for x in flat], pa.list_(pa.int32())), pa.array(order, pa.int64())], names=["k", "kind", "y", "a", "b", "o"])
        f.memo.clear()
        released()

    got = few.select(F.col("k").cast("long"), "t", F.col("y").cast("int")).mapInArrow(run, "k long, kind int, y int, a array<int>, b array<int>, o long").toArrow()  # at most sample_rows texts and their swaps
    kind, y = got["kind"].to_numpy(), got["y"].to_numpy()
    order = np.lexsort((got["o"].to_numpy(), y, got["k"].to_numpy(), kind))
    a, b = (_views(got[c]) for c in ("a", "b"))
    first = order[kind[order] == 0]
    return [a[i] for i in first], y[first].astype(float), [(a[i], b[i]) for i in order[kind[order] == 1]]


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as parts of one array."""
    one = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return np.split(one.flatten().to_numpy(), np.asarray(one.offsets)[1:-1] - (np.asarray(one.offsets)[0] if len(one) else 0)) if len(one) else []


def fit(docs: DataFrame, labels: DataFrame, terms: Terms = IDENTITY_TERMS, sample_rows: int = 8000, text: str = "text", key: str = "doc_id", **how) -> tuple[np.ndarray, float] | None:
    """Model from the labelled rows of docs; None if there are none."""
    x, y, swaps = gathered(docs, labels, terms, sample_rows, text, key)
    model = train(x, y, swaps, **how) if x else None
    del x, y, swaps
    released()  # the driver keeps the weights only
    return model


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text") -> DataFrame:
    """docs with score (0 to 1)."""
    shared = sent(spark, model)  # 2**BITS floats at most
    small_batches(spark)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in slices(batches, text, SLICE):
            if shared.value is None:
                out = [0.0] * b.num_rows
            else:
                w, intercept = shared.value
                found = [dict.fromkeys(letters(x)) for x in b.column(at).to_pylist()]
                f.add([x for d in found for x in d])
                z = np.array([float(w[f.of(d)].sum()) if d else 0.0 for d in found]) + intercept
                out = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "score"])
        f.memo.clear()
        released()

    return docs.mapInArrow(run, schema)


def kept(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **names) -> DataFrame:
    """The rows that score below the threshold, with the columns of docs."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])  # names may clash
    out = score(spark, rows, fit(docs, labels, **names), f"c{docs.columns.index(names.get('text', 'text'))}")
    return out.where(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs.where(fold("doc_id", 5) != 0), labels)
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return score(spark, rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
