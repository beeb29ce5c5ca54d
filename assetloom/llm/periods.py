"""Periodic runs: maximal stretches of words that repeat with a period.

Each text is a sequence of words. Suffix array and LCP give the longest-previous-factor array (LPF), LPF the Lempel-Ziv
blocks. Every run that touches a border between blocks is found by extending equal words to both sides of the border, for
periods that the blocks' lengths bound (Main); every other run lies strictly inside a block and is a copy of one inside the
block's earlier occurrence, so blocks are gone through from left to right and runs copied, bucketed by their starts. The
number of (border, period) trials is three times the number of words at most, however periodic the text is.

Texts of one slice are worked out together in numpy: suffixes are ranked by prefix doubling, in which only ranks that are
still shared are sorted again; the ranks of all rounds then tell how far two places agree, to the right and to the
left. A text is never cut: a slice holds a long text whole, with about 4 log2(longest repeat) + 100 bytes a word.

Defined results: words are what stands between the bytes 09-0D and 20, case-sensitive; a null or blank text has no words, no
runs and an empty collapsed text; every row is worked out by itself, so repeated rows, ties and ids don't matter; an
empty table gives an empty result; columns are kept, but those named as the results give way to them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import released, slices, small_batches

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
SLICE = 1_000_000


class Suffixes:
    """Suffixes of several sequences (word numbers, and where each sequence starts), ranked; suffixes end with their sequence."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        n = len(words)
        self.n, self.starts = n, starts
        self.of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        self.end = np.append(starts, n)[1:][self.of]
        _, first = np.unique(self.of * np.int64(words.max(initial=0) + 1) + words, return_inverse=True)
        rank = self._places(np.bincount(first, minlength=1))[first]
        self.ranks = [self._padded(rank)]
        alive, step = self._shared(rank, np.arange(n)), 1
        while len(alive):
            after = alive + step
            key = rank[alive].astype(np.int64) * (n + 1) + np.where(after < self.end[alive], rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            alive, key = alive[order], key[order]
            group = rank[alive]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            head = np.flatnonzero(np.diff(group, prepend=-1))  # a group's ranks are its first place and those that follow
            at = np.arange(len(alive))
            place = np.zeros(len(alive), dtype=np.int64)
            place[new] = new
            np.maximum.accumulate(place, out=place)
            top = np.zeros(len(alive), dtype=np.int64)
            top[head] = head
            np.maximum.accumulate(top, out=top)
            rank = rank.copy()
            rank[alive] = group + (place - top).astype(np.int32)
            self.ranks.append(self._padded(rank))
            edge = np.append(new, len(alive))
            many = np.repeat(np.diff(edge) > 1, np.diff(edge))
            alive, step = alive[at[many]], step * 2
        self.rank = rank
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)

    @staticmethod
    def _places(counts: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32)

    @staticmethod
    def _shared(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at[np.bincount(rank, minlength=1)[rank] > 1] if len(rank) else at

    def _padded(self, rank: np.ndarray) -> np.ndarray:
        """With two unequal ranks for what lies before and behind all sequences."""
        return np.concatenate((rank, np.array([-1, -2], dtype=np.int32)))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and b on (a < b, of one sequence or its end) are equal."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + out, b + out
            inside = y < self.n
            same = self.ranks[k][np.where(inside, x, self.n)] == self.ranks[k][np.where(inside, y, self.n + 1)]
            out += np.where(same, 1 << k, 0)
        return out

    def behind(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many words before a and b (a < b) are equal, none before the sequence's start (``least``)."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - out - (1 << k), b - out - (1 << k)
            inside = x >= least
            same = self.ranks[k][np.where(inside, x, self.n)] == self.ranks[k][np.where(inside, y, self.n + 1)]
            out += np.where(same, 1 << k, 0)
        return out

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """LPF: for each place the longest stretch that also begins at an earlier place of its sequence, and that place.

        Of the suffixes that begin earlier, a neighbour in suffix order shares most; later places are unlinked first."""
        lcp = np.zeros(self.n, dtype=np.int64)
        a, b = self.order[:-1], self.order[1:]
        lcp[1:] = self.ahead(np.minimum(a, b), np.maximum(a, b)) * (self.of[a] == self.of[b])
        length, source = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        # Stretches of suffix order whose neighbours share a word; suffixes outside share nothing with any other.
        tied = (lcp > 0) | np.append(lcp[1:] > 0, False)
        places = np.flatnonzero(tied[self.rank])
        short = np.cumsum(tied) - 1
        order, share = self.order[tied].tolist(), [*lcp[tied].tolist(), 0]
        up, down = list(range(-1, len(order) - 1)), list(range(1, len(order) + 1))
        long, where = [0] * len(places), [0] * len(places)
        for k, r in zip(range(len(places) - 1, -1, -1), short[self.rank[places[::-1]]].tolist(), strict=True):
            above, below = share[r], share[d := down[r]]
            u = up[r]
            if above >= below:
                long[k], where[k] = above, order[u] if above else 0
                share[d] = below
            else:
                long[k], where[k] = below, order[d]
                share[d] = above
            if u >= 0:
                down[u] = d
            if d < len(order):
                up[d] = u
        length[places], source[places] = long, where
        return length, source


def periodic(words: np.ndarray, starts: np.ndarray, least: int = 12) -> np.ndarray:
    """All runs of sequences that stand one after another: rows (start, end, period), by start, then period; with
    length >= max(least, 2 * period)."""
    if not len(words):
        return np.empty((0, 3), dtype=np.int64)
    s = Suffixes(words, starts)
    length, source = s.previous()
    block, jump = [], np.maximum(1, length).tolist()
    ends = np.append(starts, s.n)[1:]
    for at, end in zip(starts.tolist(), ends.tolist(), strict=True):
        while at < end:
            block.append(at)
            at += jump[at]
    block = np.array(block, dtype=np.int64)
    size = np.diff(np.append(block, s.n))

    # Trials: to the right of a block's start with periods up to its length; to the left of a block's start, or of a
    # sequence's end, with periods below its and the former block's lengths together.
    inner = block > s.starts[s.of[block]]
    former = np.where(inner, np.concatenate(([0], size[:-1])), 0)
    last = np.flatnonzero(np.append(~inner[1:], True))
    border = np.concatenate((block, block[inner], ends[s.of[block[last]]]))
    most = np.concatenate((size, (former + size - 1)[inner], size[last] - 1))
    left = np.concatenate((np.zeros(len(block), bool), np.ones(inner.sum() + len(last), bool)))
    begin = np.concatenate((s.starts[s.of[block]], s.starts[s.of[block[inner]]], s.starts[s.of[block[last]]]))
    end = np.concatenate((s.end[block], s.end[block[inner]], s.end[block[last]]))
    found = [np.empty((0, 3), dtype=np.int64)]
    # One side must agree by half of what a run needs; that is looked up before the exact extension.
    level = min(len(s.ranks) - 1, max(0, (-(-(-(-least // 2)) // 2)).bit_length() - 1))
    for lo, hi in _pieces(most, 1_000_000):
        which = np.repeat(np.arange(lo, hi), most[lo:hi])
        p = np.arange(len(which)) - np.repeat(np.cumsum(most[lo:hi]) - most[lo:hi], most[lo:hi]) + 1
        to_left = left[which]
        a = np.where(to_left, border[which] - p, border[which])
        b = a + p
        ok = (a >= begin[which]) & (b <= end[which])
        near = (b < s.n) & (s.ranks[level][np.minimum(a, s.n)] == s.ranks[level][np.minimum(b, s.n + 1)])
        x = a - (1 << level)
        near |= (x >= begin[which]) & (s.ranks[level][np.maximum(x, 0)] == s.ranks[level][np.maximum(x + p, 0)])
        some = np.flatnonzero(ok & near)
        a, b, p = a[some], b[some], p[some]
        right, back = s.ahead(a, b), s.behind(a, b, begin[which[some]])
        good = (right + back >= p) & (right + back + p >= least)
        found.append(np.column_stack((a - back, b + right, p))[good])
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    # A stretch that repeats with p also does with multiples of p; the smallest counts.
    found = found[np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(axis=1))] if len(found) else found
    return _copied(found, block, size, source, least)


def _pieces(most: np.ndarray, trials: int) -> Iterator[tuple[int, int]]:
    total, at = np.cumsum(most), 0
    while at < len(most):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + trials, "right")))
        yield at, end
        at = end


def _copied(found: np.ndarray, block: np.ndarray, size: np.ndarray, source: np.ndarray, least: int) -> np.ndarray:
    """found and the runs strictly inside blocks, each copied from the block's earlier occurrence."""
    roomy = np.flatnonzero(size >= least + 2)
    if not len(roomy) or not len(found):
        return found
    starts, bucket = sorted(set(found[:, 0].tolist())), {}
    for i, j, p in found.tolist():
        bucket.setdefault(i, []).append((j, p))
    for at, n, back in zip(block[roomy].tolist(), size[roomy].tolist(), (block - source[block])[roomy].tolist(), strict=True):
        k = bisect_left(starts, at - back + 1)
        while k < len(starts) and starts[k] < at - back + n:  # a block may overlap its occurrence: copies are looked at again
            i = starts[k]
            for j, p in bucket[i]:
                if j + back < at + n:
                    own = bucket.setdefault(i + back, [])
                    if not own:
                        insort(starts, i + back)
                    if (j + back, p) not in own:
                        own.append((j + back, p))
            k += 1
    return np.array(sorted((i, j, p) for i, own in bucket.items() for j, p in own), dtype=np.int64)


def _ordered(runs: np.ndarray) -> np.ndarray:
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def with_runs(spark: SparkSession, docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """docs with n_words, runs (array of start, length, period: word numbers, by start, then period) and collapsed (the text's
    words, but for those that a run holds after its first period, joined by one space)."""
    small_batches(spark)
    made = ("n_words", "runs", "collapsed")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    names = docs.columns
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # names may clash
    body = f"c{names.index(text)}"
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    kind = pa.struct([pa.field(c, pa.int64(), False) for c in RUN.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, body, SLICE):
            numbers: dict[bytes, int] = {}
            texts = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in b.column(b.schema.get_field_index(body)).to_pylist()]
            flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), dtype=np.int64, count=sum(map(len, texts)))
            count = np.array([len(t) for t in texts], dtype=np.int64)
            start = np.cumsum(count) - count
            some = np.flatnonzero(count >= least)
            flat = flat[np.repeat(count >= least, count)]
            at = np.cumsum(count[some]) - count[some]
            runs = _ordered(periodic(flat, at, least))
            owner = some[np.searchsorted(at, runs[:, 0], "right") - 1] if len(runs) else np.empty(0, np.int64)
            first = runs[:, 0] - (at[np.searchsorted(at, runs[:, 0], "right") - 1] if len(runs) else 0)
            offset = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(first), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(kind))
            gone = np.zeros(count.sum() + 1, dtype=np.int64)
            head = start[owner] + first
            np.add.at(gone, head + runs[:, 2], 1)
            np.add.at(gone, head + runs[:, 1] - runs[:, 0], -1)
            stays = np.cumsum(gone)[:-1] == 0
            with_run = set(owner.tolist())
            kept = [b" ".join(w for w, ok in zip(t, stays[s : s + len(t)].tolist(), strict=True) if ok) if i in with_run else b" ".join(t) for i, (t, s) in enumerate(zip(texts, start.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count), pa.ListArray.from_arrays(pa.array(offset), spans), pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string())], names=[*b.schema.names, *made])
        released()

    out = docs.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *made)


SPACES = "\t\n\x0b\x0c\r"


def op13_periodic_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's change of a tenth of the texts, then the operator; a null doc_id changes nothing."""
    words = F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("long")
    a = (F.col("g") % n).alias("a")
    some = some.select("doc_id", "text", "g", "w", F.when(n > 0, a).alias("a"), n.alias("n"))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    some = some.select("doc_id", "text", "w", "a", "n", F.when(F.col("a").isNotNull(), p).alias("p"))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    changed = some.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
    runs = with_runs(spark, changed)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
