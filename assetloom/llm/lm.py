r"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Tokens are the lower-cased (A-Z) words `[^\x20\x09-\x0D]+` of a text and one end. The model predicts an output symbol
from the two before it: one of the ``direct`` commonest tokens, or one of ``forms`` classes of all other words by their
last bytes; the word within a class comes from its count. The predicted vector is R[h1] C1 + R[h2] C2, its product
with the output vectors plus a bias gives the scores, and a softmax over all symbols the normalised probability. Unseen
words of a class share the probability of one word with count 0, as they do in the base score.

Training covers every training token: each partition trains on its own from the same start (AdaGrad, noise drawn from
the symbols' counts and shared in a minibatch), and the parameters' mean, weighted by tokens, is the model. Partials
meet in a grouped sum; only the parameters, of fixed size, come to the driver.

Counts cover every training token. The ``frequent`` commonest words (a bounded number) are sent to the workers; counts
of all other words are joined by word.

Defined results: null and empty texts hold the end only; without training rows all counts are 0; repeated rows are
scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.common import fold, most_frequent, sent, slices, staged, words

END = b""  # no word is empty


def form(word: bytes, forms: int) -> int:
    return zlib.crc32(word[-3:]) % forms


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all tokens of docs (text); the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "c"])

        for b in slices(batches, "text"):
            for t in b["text"].to_pylist():
                count.update(words(t))
            count[END] += b.num_rows
            if len(count) > 300_000:
                yield out()
                count.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


class Vocabulary:
    """Symbols and counts of the frequent words; what a worker needs to turn texts into symbols."""

    def __init__(self, frequent: dict[bytes, int], direct: int, forms: int, class_n: np.ndarray, class_v: np.ndarray, n: int, v: int):
        self.forms, self.n, self.v = forms, n, v
        top = sorted((w for w in frequent if w != END), key=lambda w: (-frequent[w], w))[: direct - 1]
        self.direct = len(top) + 1
        self.symbols = self.direct + forms
        self.symbol = {END: 0} | {w: i + 1 for i, w in enumerate(top)}
        self.count = frequent
        self.base_den = np.log10(n + 0.5 * (v + 1))
        self.class_den = np.log10(class_n + 0.5 * (class_v + 1))
        unigram = np.concatenate(([frequent.get(w, 0) for w in self.symbol], class_n)) + 0.5
        self.unigram = unigram / unigram.sum()

    def of(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: symbol, count (-1: not among the frequent), form class (-1: a direct symbol)."""
        symbol, get, forms, first = [], self.symbol.get, self.forms, self.direct
        for w in distinct:
            s = get(w, -1)
            symbol.append(s if s >= 0 else first + zlib.crc32(w[-3:]) % forms)
        s = np.array(symbol, dtype=np.int64)
        return s, np.array([self.count.get(w, -1) for w in distinct], dtype=np.int64), np.where(s >= first, s - first, -1)


class Texts:
    """A batch of texts as one row of tokens; each text's end is its last token."""

    def __init__(self, texts: list[str | None], vocabulary: Vocabulary):
        found = [words(t) for t in texts]
        self.index: dict[bytes, int] = {END: 0}
        flat = [w for ws in found for w in (*ws, END)]
        for w in dict.fromkeys(flat):
            self.index.setdefault(w, len(self.index))
        self.token = np.fromiter(map(self.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.size = np.array([len(ws) + 1 for ws in found])
        self.start = np.cumsum(self.size) - self.size
        self.symbol_of, self.count_of, self.form_of = vocabulary.of(list(self.index))
        self.symbol = self.symbol_of[self.token]
        none = vocabulary.symbols
        self.h1 = np.concatenate(([none], self.symbol[:-1])) if len(flat) else self.symbol
        self.h2 = np.concatenate(([none, none], self.symbol[:-2]))[: len(flat)]
        if len(flat):
            self.h1[self.start] = none
            self.h2[self.start] = none
            second = self.start[self.size > 1] + 1
            self.h2[second] = none


class LogBilinear:
    """Parameters in one flat array: R (symbols + 1 vectors), C1, C2, Q (symbols vectors) and the bias."""

    def __init__(self, symbols: int, dims: int, flat: np.ndarray | None = None, unigram: np.ndarray | None = None, seed: int = 5):
        self.symbols, self.dims = symbols, dims
        sizes = [(symbols + 1) * dims, dims * dims, dims * dims, symbols * dims, symbols]
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, sum(sizes)).astype(np.float32)
            flat[sizes[0] : sizes[0] + 2 * dims * dims] += np.tile(np.eye(dims, dtype=np.float32).reshape(-1), 2)
            flat[-symbols:] = np.log(unigram)
        self.flat = flat
        self.r, self.c1, self.c2, self.q, self.b = (p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), ((symbols + 1, dims), (dims, dims), (dims, dims), (symbols, dims), (symbols,)), strict=True))

    def predicted(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.r[h1] @ self.c1 + self.r[h2] @ self.c2

    def log_probabilities(self, h1: np.ndarray, h2: np.ndarray, symbol: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Natural logs, normalised over all symbols; each distinct context is multiplied out once."""
        context, which = np.unique(h1 * (self.symbols + 1) + h2, return_inverse=True)
        order = np.argsort(which, kind="stable")
        edge = np.searchsorted(which[order], np.arange(0, len(context) + chunk, chunk))
        out = np.empty(len(symbol), dtype=np.float64)
        for i, at in enumerate(range(0, len(context), chunk)):
            some = context[at : at + chunk]
            score = self.predicted(some // (self.symbols + 1), some % (self.symbols + 1)) @ self.q.T + self.b
            score -= score.max(axis=1, keepdims=True)
            score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
            rows = order[edge[i] : edge[i + 1]]
            out[rows] = score[which[rows] - at, symbol[rows]]
        return out

    def train(self, h1: np.ndarray, h2: np.ndarray, symbol: np.ndarray, noise: np.ndarray, square: np.ndarray, rng: np.random.Generator, rate: float = 0.08, batch: int = 4096, k: int = 64) -> None:
        """One pass of noise-contrastive estimation; square holds AdaGrad's sums."""
        log_noise, cumulative = np.log(k * noise).astype(np.float32), np.cumsum(noise)
        grads = LogBilinear(self.symbols, self.dims, np.zeros_like(self.flat))
        order = rng.permutation(-(-len(symbol) // batch))
        for at in order * batch:
            a, b, w = h1[at : at + batch], h2[at : at + batch], symbol[at : at + batch]
            other = np.minimum(np.searchsorted(cumulative, rng.random(k)), self.symbols - 1)
            ra, rb = self.r[a], self.r[b]
            hat = ra @ self.c1 + rb @ self.c2
            own = 1 / (1 + np.exp(-np.clip((hat * self.q[w]).sum(axis=1) + self.b[w] - log_noise[w], -30, 30))) - 1  # dloss/dscore
            wrong = 1 / (1 + np.exp(-np.clip(hat @ self.q[other].T + self.b[other] - log_noise[other], -30, 30)))
            grads.flat[:] = 0
            g_hat = own[:, None] * self.q[w] + wrong @ self.q[other]
            _add(grads.q, w, own[:, None] * hat)
            np.add.at(grads.q, other, wrong.T @ hat)
            grads.b += np.bincount(w, own, self.symbols) + np.bincount(other, wrong.sum(axis=0), self.symbols)
            grads.c1 += ra.T @ g_hat
            grads.c2 += rb.T @ g_hat
            _add(grads.r, a, g_hat @ self.c1.T)
            _add(grads.r, b, g_hat @ self.c2.T)
            grads.flat /= len(w)
            square += grads.flat**2
            self.flat -= rate * grads.flat / np.sqrt(square + 1e-8)


def _add(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    start = np.flatnonzero(np.diff(at[order], prepend=-1))
    to[at[order[start]]] += np.add.reduceat(rows[order], start, axis=0)


def fit(spark: SparkSession, docs: DataFrame, counts: DataFrame, direct: int = 256, forms: int = 128, frequent: int = 50_000, dims: int = 24) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and model from the training rows (text) and their word counts (a table)."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = {r["word"].encode(): r["c"] for r in most_frequent(counts, frequent, "c").collect()}  # `frequent` words at most
    ends = counts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top[END] = ends
    zero = np.zeros(forms)
    first = Vocabulary(top, direct, forms, zero, zero, n, v)
    apart = spark.createDataFrame([(w.decode("utf-8", "replace"),) for w in first.symbol], "word string")  # `direct` words
    group = (F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)) % forms).alias("g")
    class_n, class_v = zero.copy(), zero.copy()
    for r in counts.join(F.broadcast(apart), "word", "left_anti").groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # `forms` rows
        class_n[r["g"]], class_v[r["g"]] = r["n"], r["v"]
    vocabulary = Vocabulary(top, direct, forms, class_n, class_v, n, v)
    shared = sent(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        model = LogBilinear(voc.symbols, dims, unigram=voc.unigram)
        square, rng, seen = np.zeros_like(model.flat), np.random.default_rng(11), 0
        for b in slices(batches, "text"):
            t = Texts(b["text"].to_pylist(), voc)
            if len(t.symbol):
                model.train(t.h1, t.h2, t.symbol, voc.unigram, square, rng)
                seen += len(t.symbol)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(model.flat)), pa.int32()), pa.array(model.flat.astype(np.float64) * seen), pa.array(np.full(len(model.flat), seen), pa.int64())], names=["i", "x", "n"])

    parts = docs.select("text").mapInArrow(run, "i int, x double, n long")
    start = LogBilinear(vocabulary.symbols, dims, unigram=vocabulary.unigram).flat
    for r in parts.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).collect():  # as many rows as parameters
        start[r["i"]] = r["x"]
    return vocabulary, start


def scored(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, model: np.ndarray, counts: DataFrame, text: str = "text", dims: int = 24) -> DataFrame:
    """docs, without the text, with n_tokens, n_known, train_tokens, base_score and score (log10)."""
    shared = sent(spark, (vocabulary, model))
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(F.monotonically_increasing_id().alias("__al_row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("__al_text"))
    names = [f.name for f in rows.schema.fields[:-1]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens long, known long, base double, score double, rare array<string>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, flat = shared.value
        lbl = LogBilinear(voc.symbols, dims, flat)
        for b in slices(batches, "__al_text"):
            t = Texts(b.column(b.num_columns - 1).to_pylist(), voc)
            word_of = list(t.index)
            count = t.count_of[t.token]
            rare = count < 0
            log_c = np.log10(np.where(rare, 1, count + 0.5))  # rare words' counts are added later
            group = t.form_of[t.token]
            score = lbl.log_probabilities(t.h1, t.h2, t.symbol) / np.log(10) + np.where(group >= 0, np.where(rare, 0, log_c) - voc.class_den[group], 0)
            base = np.where(rare, 0, log_c) - voc.base_den
            known = np.where(rare, 0, count > 0)
            text_of = np.repeat(np.arange(len(t.size)), t.size)
            pair, times = np.unique(text_of[rare] * len(word_of) + t.token[rare], return_counts=True)
            at = np.searchsorted(pair // len(word_of), np.arange(len(t.size) + 1))
            some = [word_of[i].decode("utf-8", "replace") for i in (pair % len(word_of)).tolist()]
            offsets = pa.array(at, pa.int32())
            add = lambda x: np.add.reduceat(x, t.start)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(t.size), pa.array(add(known), pa.int64()), pa.array(add(base)), pa.array(add(score)), pa.ListArray.from_arrays(offsets, pa.array(some, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))],
                names=[*names, "n_tokens", "known", "base", "score", "rare", "times"],
            )

    part = staged(spark, rows.mapInArrow(run, schema), "scored")
    pairs = part.select("__al_row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("k"))))
    looked = pairs.join(counts, "word", "left").groupBy("__al_row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("also"))
    out = part.drop("rare", "times").join(looked, "__al_row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op4_lm_score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    training = docs.where(fold("doc_id", 5) != 1).select("text")
    counts = staged(spark, word_counts(training), "counts")
    vocabulary, model = fit(spark, training, counts)
    return scored(spark, docs.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "text"), vocabulary, model, counts)
