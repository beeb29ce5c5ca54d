"""Near-duplicate join: exact Jaccard similarity of five-word shingle sets, by universe partition and pigeonhole.

Shingles are hashed to 64 bits. Within a band of set sizes the universe of hashes is cut into segments; the part of a
set in one segment is a subset with one signature. Two sets of sizes a and b with a Jaccard similarity of at least 3/4
differ in at most (a + b) / 7 shingles, and the differences of their subsets, summed over the segments, are no more.
Sets with equal content are one class from the start, known by the set's hash. Then:

1. Pigeonhole. A signature that no other class has is a place: every other class differs there by one at least. A class
   with more places than a partner of any size could differ in has no partner and leaves. Signatures travel packed, by
   range of signature; a document's first pass costs no row for each of them.
2. One-deletion neighbourhoods, for the classes that are left: a subset that no other class has, and whose neighbourhood
   no other class touches, differs by two at least from everyone's, and is two places. More classes leave.
3. Allocation by cost: of two similar classes the larger looks for the smaller. The places that it still needs are made
   up by the rarest signatures that it shares; only these are looked up.
4. Verification with whole sets. Every member of a signature is compared with the signature's hub, its member with the
   fewest places of its own. What hubs leave unconnected is looked up in two ways: in a signature with few members,
   one by one; in one with many, by how members differ from the hub. With differences D and E from one hub, two sets
   differ in exactly the symmetric difference of D and E, so similar ones share a number of elements that follows from
   their sizes. Elements are ordered from the rarest among the hub's members, and only the first ones are joined, with
   a bound by position; a family of copies around one original thus meets in few pairs, however many members it has.

Bands span a factor of two; sets below ``SINGLES`` shingles have a segment for each hash. A set also enters the band
below if a similar smaller set can be there. The number of segments of a band follows from its sizes such that seven
standard deviations separate the non-empty segments from the places needed. A set that has too few even so is joined
with the others by its shingles (``_short``).

Defined results: null and blank texts have an empty set and link with nothing; fewer than five words are one shingle;
rows of equal doc_id are separate documents, and repeated rows are one class; a null doc_id has n_shingles, links with
nothing and has no component; texts of any length are taken whole; of links that tie at 3/4 all count; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetloom.llm.common import mix64, released, removed, slices, small_batches, staged, word_hashes
from assetloom.llm.components import components

WIDTH = 5
SINGLES = 32
_U = np.uint64
_TURN = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_EDGES = np.array([SINGLES << k for k in range(40)], dtype=np.int64)
#: Of the packed pass: signatures and classes that a worker gathers before it sends them, and signatures in a range.
FLUSH, FLUSH_CLASSES, RANGE = 1_000_000, 32_000, 1_000_000
_MANY = 0xFFFF
#: Members of a block that is compared with one set, and rows of a cell of blocks.
BLOCK, CELL = 256, 1024


def shingles(text: str | None) -> np.ndarray:
    """The set of hashed shingles, sorted."""
    h = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, _U)
    if not len(h):
        return h
    k = min(WIDTH, len(h))
    total = np.zeros(len(h) - k + 1, dtype=_U)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * _TURN[j]
    return np.unique(mix64(total + _U(k)))


def class_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s).sum() + _U(len(s)) * _TURN[0]], dtype=_U))[0] >> _U(2))  # 62 bits


def bands(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, n, "right")


def lower_ends(band: np.ndarray) -> np.ndarray:
    return np.where(band > 0, _EDGES[np.maximum(band, 1) - 1], 1)


@cache
def segment_count(band: int) -> int:
    """The least number with enough non-empty segments at both ends of the sizes that enter the band (see above)."""
    hi = SINGLES << band
    m = hi // 3
    while True:
        spare = []
        for n in (hi, 4 * hi // 3):
            e = math.exp(-n / m)
            spare.append(m * (1 - e) - 7 * math.sqrt(m * e * (1 - (1 + n / m) * e)) - (n + hi) // 7 - 1)
        if min(spare) >= 0:
            return m
        m += max(1, m // 64)


def places(n: np.ndarray, low: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sets enter this channel (their own band, or the one below); more places than the second bound exclude any
    partner; one more than the third excludes a partner that is no larger."""
    band = bands(n)
    if low:
        lo = lower_ends(band)
        most = (n + lo - 1) // 7
        return (band > 0) & (-(-3 * n // 4) < lo), most, most
    return n > 0, (n + 4 * n // 3) // 7, 2 * n // 7


def segmented(sets: list[np.ndarray], low: bool, neighbours: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets in this channel: (set, signature, size) of each non-empty segment; and, if asked, for each shingle in a
    segment of two or more, that segment and the signature that it would have without the shingle."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    enters = np.flatnonzero(places(n, low)[0])
    if not len(enters):
        return (np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U))
    flat, n = np.concatenate([sets[i] for i in enters]), n[enters]
    band = bands(n) - low
    of = np.repeat(np.arange(len(enters)), n)
    count = np.array([segment_count(int(b)) if b else 0 for b in band], dtype=_U)[of]
    place = np.where(count > 0, (flat >> _U(32)) * count >> _U(32), flat)  # grows with the hash, and sets are sorted
    new = np.ones(len(flat), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(flat)))
    each = mix64(flat ^ _U(0x5851F42D4C957F2D))
    total, turn = np.add.reduceat(each, start), band.astype(_U) * _TURN[3]
    out = enters[of[start]], mix64(total + turn[of[start]]), size
    if not neighbours:
        return *out, np.empty(0, np.int64), np.empty(0, _U)
    at = np.repeat(np.arange(len(start)), size)
    big = size[at] > 1
    return *out, at[big], mix64((total[at] - each + turn[of])[big])


# The packed pass.


def _packed(docs: DataFrame, ranges: int) -> DataFrame:
    """For docs (key, text): a row for each document (key, n, class, flush, idx), and for each flush and range of
    signatures a row with the signatures and whose they are (range, flush, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "flush", "idx", "key", "n", "class", "data"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        flush = TaskContext.get().partitionId() << 24
        known: dict[int, int] = {}
        sigs, whose, held = [], [], 0

        def emitted() -> pa.RecordBatch:
            sig, who = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((sigs, _U), (whose, np.uint16)))
            sigs.clear()
            whose.clear()
            at = ((sig >> _U(32)) * _U(ranges) >> _U(32)) << _U(32) | sig & _U(0xFFFFFFFF)
            del sig
            order = np.argsort(at, kind="stable")
            at, who = at[order], who[order]
            del order
            new = np.ones(len(at), dtype=bool)
            new[1:] = at[1:] != at[:-1]
            who[np.append(~new[1:], [False])[: len(at)]] = _MANY  # the first of equal ones stands for all
            at, who = at[new], who[new]
            edge = np.searchsorted(at >> _U(32), np.arange(ranges + 1, dtype=_U))
            full = np.flatnonzero(np.diff(edge))
            data = []
            for r in full.tolist():
                step = np.diff((at[edge[r] : edge[r + 1]] & _U(0xFFFFFFFF)).astype(np.uint32), prepend=np.uint32(0))
                data.append(step.view(np.uint8).reshape(-1, 4).T.tobytes() + who[edge[r] : edge[r + 1]].tobytes())  # by byte: the high ones compress
            none = pa.nulls(len(full))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([flush] * len(full), pa.int64()), *[none.cast(k) for k in kinds[2:6]], pa.array(data, pa.binary())], names=names)

        for b in slices(batches, "text", 2_000_000):
            rows: tuple[list, ...] = ([], [], [], [])
            fresh, who = [], []
            for key, text in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                s = shingles(text)
                c = i = None
                if len(s) and key is not None:
                    c = class_key(s)
                    if (i := known.get(c)) is None:
                        i = known[c] = len(known)
                        fresh.append(s)
                        who.append(i)
                for to, x in zip(rows, (i, key, len(s), c), strict=True):
                    to.append(x)
            own = np.array(who, dtype=np.int64)
            for low in (False, True):
                of, sig, *_ = segmented(fresh, low)
                sigs.append(sig)
                whose.append((2 * own[of] + low).astype(np.uint16))
                held += len(sig)
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int32()), pa.array([flush] * b.num_rows, pa.int64()), *[pa.array(x, t) for x, t in zip(rows, kinds[2:6], strict=True)], pa.nulls(b.num_rows, pa.binary())], names=names)
            if held > FLUSH or len(known) > FLUSH_CLASSES // 2:  # a slice has less than the other half, see slices
                yield emitted()
                flush += 1
                known, sigs, whose, held = {}, [], [], 0
        if held:
            yield emitted()
        known, sigs, whose = {}, [], []
        released()

    return docs.mapInArrow(run, "range int, flush long, idx int, key long, n long, class long, data binary")


def _single(table: pa.Table) -> pa.Table:
    """For the packed rows of one range: for each flush, how many signatures of each of its classes occur nowhere else.

    What is sorted is sorted in place: a worker's memory is a few numbers for each signature of the range."""
    flush, parts = table["flush"].to_numpy(), table["data"]
    edge = np.append(0, np.cumsum([d.as_buffer().size // 6 for d in parts]))
    at, who = np.empty(edge[-1], dtype=_U), np.empty(edge[-1], dtype=np.uint16)
    for d, a, b in zip(parts, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        d, k = d.as_buffer(), b - a
        at[a:b] = np.cumsum(np.frombuffer(d, np.uint8, 4 * k).reshape(4, k).T.copy().view(np.uint32).ravel(), dtype=np.uint32)
        who[a:b] = np.frombuffer(d, np.uint16, k, 4 * k)
    at <<= _U(32)
    at |= np.arange(len(at), dtype=_U)  # less than 2^32 rows; the place of a signature tells its flush and class
    at.sort()
    same = np.zeros(len(at) + 1, dtype=bool)
    for k in range(0, len(at) - 1, 1 << 16):
        part = at[k : k + (1 << 16) + 1] >> _U(32)
        same[k + 1 : k + len(part)] = part[1:] == part[:-1]
    code = at[~(same[1:] | same[:-1])]
    del at
    code &= _U(0xFFFFFFFF)
    code = code[who[code] != _MANY]
    code.sort()
    start = np.searchsorted(code, edge.astype(_U))
    data = []
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        c, k = np.unique(who[code[a:b]], return_counts=True)
        data.append(c.tobytes() + k.astype(np.uint32).tobytes())
    del code, who
    released()
    return pa.table({"flush": pa.array(flush, pa.int64()), "data": pa.array(data, pa.binary())})


def _staying(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Of one flush: the documents whose places don't exclude every partner."""
    own = np.zeros(0x10000, dtype=np.int64)
    for d in counts["data"].to_pylist():
        k = len(d) // 6
        own[np.frombuffer(d, np.uint16, k)] += np.frombuffer(d[2 * k :], np.uint32, k)
    i, n = docs["idx"].to_numpy().astype(np.int64), docs["n"].to_numpy()
    (_, most, _), (low, below, _) = places(n, False), places(n, True)
    return docs.select(["key", "n", "class"]).filter(pa.array((own[2 * i] <= most) | low & (own[2 * i + 1] <= below)))


# What is left: flat rows of signatures and neighbourhoods.


def _sets(docs: DataFrame) -> DataFrame:
    """class, n, set for docs (key, class, text); another row of the key may have another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own = [(c, s) for c, t in zip(b["class"].to_pylist(), b["text"].to_pylist(), strict=True) if len(s := shingles(t)) and class_key(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()), pa.array([s.view(np.int64) for _, s in own], pa.list_(pa.int64()))], names=["class", "n", "set"])
        released()

    return docs.mapInArrow(run, "class long, n long, set array<long>")


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            c = b.slice(k, rows)
            yield c["node"].to_numpy(), [x.values.to_numpy().view(_U) for x in c["set"]]


def _signatures(sets: DataFrame, bits: int) -> DataFrame:
    """sig, who: 4 * node + 2 if of the band below + 1 if of two shingles or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, own in _parts(batches):
            for low in (False, True):
                of, sig, size, *_ = segmented(own, low)
                yield pa.RecordBatch.from_arrays([pa.array((sig >> _U(64 - bits)).astype(np.int64)), pa.array(4 * node[of] + 2 * low + (size > 1))], names=["sig", "who"])
        released()

    return sets.select("node", "set").mapInArrow(run, "sig long, who long")


def _neighbours(sets: DataFrame, bits: int) -> DataFrame:
    """v, whole: signatures without one of their shingles, and with it. No set has both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _parts(batches):
            for low in (False, True):
                _, sig, _, whole, without = segmented(own, low, neighbours=True)
                yield pa.RecordBatch.from_arrays([pa.array((x >> _U(64 - bits)).astype(np.int64)) for x in (without, sig[whole])], names=["v", "whole"])
        released()

    return sets.select("node", "set").mapInArrow(run, "v long, whole long")


def _bounds(sets: DataFrame) -> DataFrame:
    """own (2 * node + 1 for the band below), n, most (more places exclude any partner), enough (exclude one no larger)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n = b["node"].to_numpy(), b["n"].to_numpy()
            for low in (False, True):
                enters, most, smaller = places(n, low)
                yield pa.RecordBatch.from_arrays([pa.array(x[enters]) for x in (2 * node + low, n, most, smaller + 1)], names=["own", "n", "most", "enough"])

    return sets.select("node", "n").mapInArrow(run, "own long, n long, most long, enough long")


def _small(rows: DataFrame, most: int) -> DataFrame:
    """rows for a broadcast join if they are few, checked by counting; else for a shuffle join."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _compared(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs (x, node, big): x, node, their sizes nx and n, the number d of shingles in which they differ, whether they
    link, and, where big, these shingles.

    The nodes of an x go to blocks of about BLOCK, its set to each block once; a cell of blocks is compared in one go."""
    pairs = staged(spark, pairs, "pairs")
    cells = max(1, -(-pairs.count() // CELL))
    blocks = staged(spark, pairs.groupBy("x").agg((F.floor(F.count("*") / BLOCK) + 1).alias("blocks")), "blocks")  # a table, so that a hub of many members can be split in the join
    members = pairs.join(blocks, "x").select("x", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node", F.col("big").cast("int").alias("big"))
    centres = members.select("x", "block").distinct().select("x", "block", F.col("x").alias("node"), F.lit(-1).alias("big"))
    sent = members.union(centres).join(sets.select("node", "set"), "node").withColumn("cell", F.pmod(F.xxhash64("x", "block"), F.lit(cells)))

    def compare(table: pa.Table) -> pa.Table:
        node, big, each = table["node"].to_pylist(), table["big"].to_pylist(), [c.values.to_numpy().view(_U) for c in table["set"]]
        centre, by = {}, dict[tuple[int, int], list[int]]()
        for i, k in enumerate(zip(table["x"].to_pylist(), table["block"].to_pylist(), strict=True)):
            if big[i] < 0:
                centre[k] = each[i]
            else:
                by.setdefault(k, []).append(i)
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for key, held in by.items():
            c = centre[key]
            size = np.array([len(each[i]) for i in held])
            flat = np.concatenate([each[i] for i in held])
            at = np.minimum(np.searchsorted(c, flat), len(c) - 1)
            inside = c[at] == flat
            start = np.cumsum(size) - size
            d = size + len(c) - 2 * np.add.reduceat(inside, start, dtype=np.int64)
            for j, i in enumerate(held):
                differ = np.empty(0, _U)
                if big[i]:
                    lack = np.ones(len(c), dtype=bool)
                    mine = slice(start[j], start[j] + size[j])
                    lack[at[mine][inside[mine]]] = False
                    differ = np.concatenate([each[i][~inside[mine]], c[lack]])
                for to, x in zip(out, (key[0], node[i], len(c), size[j], d[j], 7 * d[j] <= size[j] + len(c), differ.view(np.int64)), strict=True):
                    to.append(x)
        kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.list_(pa.int64()))
        return pa.table(dict(zip(("x", "node", "nx", "n", "d", "link", "differ"), (pa.array(x, k) for x, k in zip(out, kinds, strict=True)), strict=True)))

    return staged(spark, sent.groupBy("cell").applyInArrow(compare, "x long, node long, nx long, n long, d long, link boolean, differ array<long>"), "compared")


def _among_hubs(spark: SparkSession, found: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (x, node) of what hubs left unconnected, by how both differ from one hub (see above).

    With e = 7 d - n, two members are similar if and only if 14 * common >= e + e', and one whose e is above the hub's
    size isn't linked to the hub. The member with the smaller e looks for the other, which therefore isn't linked."""
    m = found.where(F.size("differ") > 0).join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).withColumn("e", 7 * F.col("d") - F.col("n"))
    open_ = staged(spark, m.groupBy("x").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("x"), "open")
    m = m.join(open_, "x")
    each = m.select("x", "node", F.explode("differ").alias("z"))
    often = each.groupBy("x", "z").agg(F.count("*").alias("f")).where("f > 1")
    mine = Window.partitionBy("x", "node")
    shared = each.join(often, ["x", "z"])  # the others are nobody else's, and come first in the order
    ranked = shared.select("x", "node", "z", (F.count("*").over(mine) - F.row_number().over(mine.orderBy("f", "z")) + 1).alias("rest"))  # so many elements from here on
    ranked = ranked.join(m.select("x", "node", "comp", "nx", "e", "link"), ["x", "node"])
    least = F.ceil((F.col("e") + F.greatest("e", F.col("nx") + 1)) / 14)
    asking = ranked.where(F.col("rest") >= least).select("x", "z", F.col("node").alias("p"), F.col("comp").alias("pc"), F.col("e").alias("pe"), F.col("rest").alias("pr"))
    there = ranked.where(~F.col("link")).select("x", "z", F.col("node").alias("t"), F.col("comp").alias("tc"), F.col("e").alias("te"), F.col("rest").alias("tr"))
    fits = (F.col("pc") != F.col("tc")) & ((F.col("pe") < F.col("te")) | ((F.col("pe") == F.col("te")) & (F.col("p") < F.col("t")))) & (14 * F.least("pr", "tr") >= F.col("pe") + F.col("te"))
    return asking.join(there, ["x", "z"]).where(fits).select(F.col("p").alias("x"), F.col("t").alias("node"))


def _one_by_one(small: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (x, node) in signatures of few members that hubs left unconnected; small: sig, node, low, n, probe, hub."""
    now = small.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).where("node <> hub")
    asking = now.where("probe").select("sig", F.col("node").alias("x"), F.col("comp").alias("own"), F.col("n").alias("most"))
    there = now.where("not low").select("sig", "node", "comp", "n")
    return asking.join(there, "sig").where("own <> comp and n <= most and 4 * n >= 3 * most").select("x", "node")


def _short(short: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, node) for sets with too few segments: any n - ceil(3 n / 4) + 1 shingles have one of every similar set's."""
    some = short.select(F.col("node").alias("x")).distinct().join(sets.withColumnRenamed("node", "x"), "x").select("x", F.explode(F.slice("set", 1, (F.floor(F.col("n") / 4) + 1).cast("int"))).alias("z"))
    return some.join(sets.select("node", F.explode("set").alias("z")), "z").where("x <> node").select("x", "node")


def link_classes(spark: SparkSession, docs: DataFrame, few: int = 4, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) for docs (key long, text): rows has key, n, class; groups has class, group for linked classes."""
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = staged(spark, _packed(docs, max(1, size // 11 // RANGE)), "packed")
    counts = packed.where("range is not null").select("range", "flush", "data").groupBy("range").applyInArrow(_single, "flush long, data binary")
    kept = packed.where("range is null and class is not null").select("flush", "idx", "key", "n", "class").groupBy("flush").cogroup(counts.groupBy("flush")).applyInArrow(_staying, "key long, n long, class long")
    kept = staged(spark, kept, "kept")
    rows = staged(spark, packed.where("range is null").select("key", "n", "class"), "rows")
    removed(spark, packed)

    # The sets of what is left, with short names: a random name of eight bytes would make most of what is shuffled.
    reps = kept.groupBy("class").agg(F.min("key").alias("key"))
    sets = _sets(docs.join(_small(reps, broadcast_rows), "key").select("key", "class", "text"))
    twice = kept.groupBy("key").count().where("count > 1").limit(1).count()
    sets = staged(spark, (sets.dropDuplicates(["class"]) if twice else sets).withColumn("node", F.monotonically_increasing_id()), "sets")
    bits = min(63, max(32, (sets.agg(F.sum("n")).first()[0] or 0).bit_length() + 16))  # few signatures are equal by chance; it would cost time only

    # Places of one and of two.
    sigs = _signatures(sets, bits)
    each = staged(spark, sigs.groupBy("sig").agg(F.count("*").alias("f"), F.min("who").alias("who")), "signatures")
    met = _neighbours(sets, bits).join(each.select(F.col("sig").alias("v"), "f"), "v")
    touched = met.select(F.explode(F.array("whole", F.when(F.col("f") == 1, F.col("v")))).alias("sig")).where("sig is not null").distinct().withColumn("near", F.lit(True))
    alone = each.where("f = 1").join(touched, "sig", "left").groupBy(F.shiftright("who", 1).alias("own")).agg(F.sum(F.when((F.col("who") % 2 == 1) & F.col("near").isNull(), 2).otherwise(1)).alias("s"))
    state = staged(spark, _bounds(sets).join(alone, "own", "left").fillna(0, ["s"]).where("s <= most"), "state")

    # Allocation, after what left is gone.
    hits = sigs.join(each.where("f > 1").select("sig"), "sig").select("sig", F.shiftright("who", 1).alias("own"))
    hits = staged(spark, hits.join(_small(state.select("own"), broadcast_rows), "own"), "hits")
    short = state.join(hits.groupBy("own").agg(F.count("*").alias("c")), "own", "left").where("s + coalesce(c, 0) < enough").select(F.shiftright("own", 1).alias("node")).distinct()
    mine = Window.partitionBy("own")
    rare = hits.join(hits.groupBy("sig").agg(F.count("*").cast("int").alias("f")), "sig").select("own", "f", "sig")
    rare = rare.select("own", "f", "sig", F.count(F.when(F.col("f") == 1, 1)).over(mine).alias("more"), F.row_number().over(mine.orderBy("f", "sig")).alias("place")).where("f > 1")
    rare = rare.join(_small(state, broadcast_rows), "own").withColumn("s", F.col("s") + F.col("more")).where("s <= most")
    rare = rare.withColumn("probe", F.col("place") - F.col("more") <= F.col("enough") - F.col("s")).withColumn("low", F.col("own") % 2 == 1)
    rare = staged(spark, rare.where("probe or not low").select("sig", F.shiftright("own", 1).alias("node"), "low", "n", "s", "probe"), "allocated")

    hubs = rare.groupBy("sig").agg(F.count("*").alias("f"), F.max(F.col("probe").cast("int")).alias("asked"), F.min_by("node", F.when(~F.col("low"), F.col("s") / F.col("n"))).alias("hub"), F.min(F.col("low").cast("int")).alias("low"))
    hubs = staged(spark, hubs.where("f > 1 and asked = 1 and low = 0").select("sig", "f", "hub"), "hubs")
    stars = rare.select("sig", "node").join(hubs, "sig").where("node <> hub").groupBy(F.col("hub").alias("x"), "node").agg(F.max(F.col("f") > few).alias("big"))
    found = _compared(spark, stars, sets)
    links = found.where("link").select(F.col("x").alias("a"), F.col("node").alias("b"))
    label = components(spark, links)

    rest = _among_hubs(spark, found, label).union(_one_by_one(rare.join(hubs.where(F.col("f") <= few).select("sig", "hub"), "sig"), label))
    if short.limit(1).count():
        rest = rest.union(_short(short, sets))
    rest = _compared(spark, rest.distinct().withColumn("big", F.lit(False)), sets).where("link")
    if rest.limit(1).count():
        label = components(spark, links.union(rest.select("x", "node")))
    names = sets.select("node", "class")
    return rows, label.join(names, "node").join(names.select(F.col("node").alias("label"), F.col("class").alias("group")), "label").select("class", "group")


def joined(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """A row for each row of docs: key, n_shingles, component_id (the smallest key of its group)."""
    rows, groups = link_classes(spark, docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), **how)
    group = staged(spark, rows.join(staged(spark, groups, "classes"), "class", "left").select("key", "n", F.coalesce("group", "class").alias("group")), "groups")
    least = staged(spark, group.where("group is not null").groupBy("group").agg(F.min("key").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k"), "least")
    return group.join(least, "group", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"))


def op10_ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return joined(spark, docs)
