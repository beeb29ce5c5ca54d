"""Vector searches: exact top-k by norm buckets, and approximate neighbours by multiprobe p-stable hashing.

Both split the candidates into blocks of bounded size (by length, or by hash cell), send queries to the blocks that can
hold answers, and keep the best of each pair of blocks; a rank over each query's few rows ends the search. A
vector that occurs in a third of the rows spreads over blocks like any other.

Defined results (both): rows with a null id, or a vector that is null or holds a null or non-finite component, take
no part (the approximate search also leaves out zero vectors); vectors of different lengths count as padded with
zeros; rows with the query's own id are its own and never its answers; a query id that occurs in several rows stands
for the smallest of its vectors; ties go to the smaller id; fewer candidates than k give fewer rows, an empty table none;
repeated rows are candidates each; products and components beyond a long end at its bounds; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetloom.llm.common import sent, staged

SLACK = 1e-9  # for bounds that are computed in floating point


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    n, flat = len(one), one.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    size = np.diff(one.offsets.to_numpy()) if n else np.empty(0, dtype=np.int64)
    if n and (size == size[0]).all():
        return flat.reshape(n, size[0])
    out = np.zeros((n, size.max() if n else 0), dtype=dtype)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, d - a.shape[1]))), np.pad(b, ((0, 0), (0, d - b.shape[1])))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _queries(rows: DataFrame, is_query: Column) -> DataFrame:
    return rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))


# ---- exact search by norm buckets -------------------------------------------------------------------------------


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products, rows of p by rows of q."""
    largest = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))  # noqa: E731  of the least long, abs() is negative
    most = largest(p) * largest(q) * max(1, p.shape[1])
    if most < 2**53:
        return (p.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return p @ q.T
    return np.clip((p.astype(object) @ q.astype(object).T), -(2**63), 2**63 - 1).astype(np.int64)


class Bucket:
    """Candidates of similar length, longest first, with the two ways to prune them."""

    FOCUS = 4  # coordinates that coordinate pruning looks at

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norm))
        self.ids, self.vectors, self.norm = ids[order], vectors[order], norm[order]
        self.unit = self.vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.switch = math.inf

    def by_length(self, theta: float, q_norm: float) -> int:
        """How many rows are long enough for a product of theta."""
        return len(self.norm) if theta <= 0 else int(np.searchsorted(-self.norm, -(theta / q_norm) * (1 - SLACK), "right"))

    def by_coordinate(self, unit: np.ndarray, local: float) -> np.ndarray:
        """Rows whose coordinates allow a cosine of ``local``: with angles a of the query's coordinate and t of the
        threshold, a candidate's angle lies within t of a."""
        focus, t = np.argsort(-np.abs(unit))[: self.FOCUS], math.acos(min(1.0, local))
        bounds = []
        for f in focus.tolist():
            a = math.acos(max(-1.0, min(1.0, unit[f])))
            if f not in self.sorted:
                order = np.argsort(self.unit[:, f], kind="stable")
                self.sorted[f] = (order, self.unit[order, f])
            low, high = math.cos(min(math.pi, a + t)) - SLACK, math.cos(max(0.0, a - t)) + SLACK
            i, j = np.searchsorted(self.sorted[f][1], low, "left"), np.searchsorted(self.sorted[f][1], high, "right")
            bounds.append((j - i, f, i, j, low, high))
        bounds.sort()
        _, f, i, j, _, _ = bounds[0]
        rows = self.sorted[f][0][i:j]
        for _, f, _, _, low, high in bounds[1:]:
            x = self.unit[rows, f]
            rows = rows[(x >= low) & (x <= high)]
        return rows

    def tune(self, units: np.ndarray, q_norm: np.ndarray, theta: np.ndarray, local: np.ndarray) -> None:
        """Sets the local threshold from which coordinates prune better than lengths, from a few of the queries."""
        some = np.flatnonzero((local > 0) & (local <= 1))
        for i in some[np.argsort(-local[some])][:: max(1, len(some) // 8)]:
            left, d = len(self.by_coordinate(units[i], local[i])), self.vectors.shape[1]
            if left * d * 4 + self.FOCUS * len(self.ids) >= self.by_length(theta[i], q_norm[i]) * d:
                break
            self.switch = local[i]

    def search(self, q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        units = q / np.maximum(q_norm, 1e-300)[:, None]
        with np.errstate(invalid="ignore"):
            local = np.where(theta > 0, theta * (1 - SLACK) / np.maximum(q_norm * self.norm[0], 1e-300), -1.0)
        self.tune(units, q_norm, theta, local)
        out = []
        lengthy = [(i, self.by_length(theta[i], q_norm[i])) for i in range(len(q)) if local[i] < self.switch and local[i] <= 1]
        for at in range(0, len(lengthy), 128):
            part = lengthy[at : at + 128]
            rows = max(n for _, n in part)
            product = _products(self.vectors[:rows], q[[i for i, _ in part]])
            out += [self._kept(i, np.arange(n), product[:n, j], q_ids, theta, k) for j, (i, n) in enumerate(part)]
        for i in np.flatnonzero((local >= self.switch) & (local <= 1)):
            rows = self.by_coordinate(units[i], local[i])
            rows = rows[rows < self.by_length(theta[i], q_norm[i])]
            out.append(self._kept(i, rows, _products(self.vectors[rows], q[i : i + 1])[:, 0] if len(rows) else np.empty(0, np.int64), q_ids, theta, k))
        return out

    def _kept(self, i: int, rows: np.ndarray, score: np.ndarray, q_ids: np.ndarray, theta: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        ok = (self.ids[rows] != q_ids[i]) & (score >= theta[i])
        rows, score = rows[ok], score[ok]
        best = _best(score, self.ids[rows], k)
        return i, self.ids[rows[best]], score[best]


def exact_top_k(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 10, ratio: float = 1.05, block: int = 8192, query_block: int = 8192, longest: int = 4096) -> DataFrame:
    """Exact k highest integer products: query_id, rank, vec_id, score. rows: id long, v array<long>.

    Candidates are grouped by length into bands, each at most ``ratio`` long, and bands into blocks. The products with
    the ``longest`` vectors (a bounded set, sent to all) give each query a first threshold; a band whose longest vector
    can't reach it is never visited by that query. Candidates of a band meet the blocks of the queries that visit it."""
    rows = rows.withColumn("norm", _norm(F.col("v")))
    band = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.lit(math.log(ratio)))).otherwise(F.lit(-(10**6))).cast("long")
    rows = rows.withColumn("band", band)
    bands = rows.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()  # at most log(range of norms) rows
    schema = "query_id long, vec_id long, score long"
    if not bands:
        return _ranked(spark.createDataFrame([], schema), k)
    top = _long_ones(rows, longest).toArrow()
    seeds = sent(spark, (top["id"].to_numpy(), _matrix(top["v"], np.int64)))  # `longest` vectors
    table = sent(spark, [(r["band"], r["most"]) for r in bands])

    def reach(batches):
        """Each query with its first threshold and the bands that it must visit."""
        s_ids, s = seeds.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, q = b["id"].to_numpy(), _matrix(b["v"], np.int64)
            a, c = _widened(s, q)
            product, theta = _products(a, c), np.full(len(ids), -np.inf)
            for i in range(len(ids)):
                own = product[s_ids != ids[i], i]
                if len(own) >= k:
                    theta[i] = np.partition(own, len(own) - k)[len(own) - k]
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
            visited = [[band for band, most in table.value if theta[i] <= 0 or theta[i] * (1 - SLACK) <= norm[i] * most] for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(theta), pa.array(visited, pa.list_(pa.int64()))], names=["id", "v", "theta", "bands"])

    queries = staged(spark, _queries(rows, is_query).mapInArrow(reach, "id long, v array<long>, theta double, bands array<long>"), "queries")
    # Queries stand in blocks of those that visit as many bands (every query visits the longest first), so that a band of short
    # vectors is sent to the few blocks that reach it; a band without a visit stays where it is.
    reach_of = {r["far"]: r["n"] for r in queries.groupBy(F.size("bands").alias("far")).agg(F.count("*").alias("n")).collect()}  # a row a band at most
    first, at = {}, 0
    for far in sorted(reach_of):
        first[far] = (at, -(-reach_of[far] // query_block))
        at += first[far][1]
    own = F.broadcast(spark.createDataFrame([(far, a, n) for far, (a, n) in first.items()] or [(-1, 0, 1)], "far int, at long, n long"))
    queries = queries.withColumn("far", F.size("bands")).join(own, "far").withColumn("qb", F.col("at") + F.pmod(F.xxhash64("id"), "n")).drop("far", "at", "n")
    met = queries.select(F.explode("bands").alias("band"), "qb").distinct()  # bands * query blocks at most
    shape = F.broadcast(spark.createDataFrame([(r["band"], -(-r["n"] // block)) for r in bands], "band long, blocks long"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    visits = queries.select("id", "v", "theta", F.explode("bands").alias("band"), "qb").join(shape, "band").select("id", "v", "theta", "band", "qb", all_of("blocks").alias("salt"))
    blocks = rows.join(shape, "band").join(_few(met), "band").select("id", "v", "band", F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), "blocks").alias("salt"), "qb")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        p, q = _widened(_matrix(left["v"], np.int64), _matrix(right["v"], np.int64))
        q_ids = right["id"].to_numpy()
        found = Bucket(left["id"].to_numpy(), p).search(q_ids, q, right["theta"].to_numpy(), k)
        return pa.table({"query_id": np.concatenate([np.full(len(v), q_ids[i]) for i, v, _ in found] or [np.empty(0, np.int64)]), "vec_id": np.concatenate([v for _, v, _ in found] or [np.empty(0, np.int64)]), "score": np.concatenate([s for _, _, s in found] or [np.empty(0, np.int64)])})

    return _ranked(_cogrouped(blocks, visits, search, schema), k)


def _long_ones(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` distinct rows (id, v) of the longest: a histogram of lengths tells from which one on, and of more rows than
    that a share is taken by hash. Their products are lower bounds, whichever they are."""
    step = F.when(F.col("norm") > 0, F.floor(F.log("norm") * 64)).otherwise(F.lit(-(10**6))).cast("long")
    total, least = 0, None
    for r in sorted(rows.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["b"]):  # 64 ranges for each power of e
        total, least = total + r["n"], r["b"]
        if total >= most:
            break
    some = rows.where(step >= least).select("id", "v")
    return some.where(F.pmod(F.xxhash64("id", "v"), F.lit(-(-total // most))) == 0).distinct().limit(2 * most)


def _few(pairs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """For a broadcast join if there are few, checked by counting; else for a shuffle join."""
    return F.broadcast(pairs) if pairs.count() <= most else pairs


def _cogrouped(blocks: DataFrame, visits: DataFrame, search: Callable, schema: str) -> DataFrame:
    keys = ["band", "salt", "qb"]
    return blocks.groupBy(*keys).cogroup(visits.select(*[F.col(c).alias(f"q_{c}") if c in keys else c for c in visits.columns]).groupBy(*[f"q_{c}" for c in keys])).applyInArrow(search, schema)


def op1_exact_top_k(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    ok = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = ok.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v"))
    return exact_top_k(spark, rows, F.col("id") % 100 == 0)


# ---- multiprobe p-stable hashing ---------------------------------------------------------------------------------


class Tables:
    """Hash tables of p-stable (Gaussian) projections of points on the unit sphere; the same functions everywhere, drawn
    from a seed. A cell is a step of ``width`` in each projection; the outermost of 2 * REACH + 1 steps are open."""

    REACH = 6

    def __init__(self, dims: int, tables: int, hashes: int, width: float, distance: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.distance, self.hashes, self.side = width, distance, hashes, 2 * self.REACH + 1
        self.a = rng.normal(size=(tables, hashes, dims))  # of more dimensions, the first are not the same
        self.b = rng.uniform(0, 1, size=(tables, hashes))
        every = np.indices((self.side,) * hashes).reshape(hashes, -1)
        self.every = every  # all cells, each a step in each projection

    def _projected(self, t: int, x: np.ndarray) -> np.ndarray:
        return x @ self.a[t].T / self.width + self.b[t]

    def cells(self, t: int, x: np.ndarray) -> np.ndarray:
        steps = np.clip(np.floor(self._projected(t, x)), -self.REACH, self.REACH).astype(np.int64) + self.REACH
        return steps @ self.side ** np.arange(self.hashes - 1, -1, -1)

    def success(self, t: int, q: np.ndarray) -> np.ndarray:
        """For each query and cell, the estimated probability that a point at ``distance`` lies in the cell: its projections
        differ from the query's by a normal amount."""
        edge = np.arange(-self.REACH, self.REACH + 2, dtype=float)
        edge[0], edge[-1] = -np.inf, np.inf
        below = _normal_below((edge - self._projected(t, q)[:, :, None]) * (self.width / self.distance))
        each = np.diff(below, axis=2)  # query, projection, step
        out = np.ones((len(q), self.every.shape[1]))
        for j in range(self.hashes):
            out *= each[:, j][:, self.every[j]]
        return out


def _normal_below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, within 1e-7 (Abramowitz and Stegun 26.2.17)."""
    # The published coefficients.
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    a = np.minimum(np.abs(x), 40.0)
    k = 1 / (1 + 0.2316419 * a)
    tail = np.exp(-a * a / 2) / math.sqrt(2 * math.pi) * (k * (c[0] + k * (c[1] + k * (c[2] + k * (c[3] + k * c[4])))))
    return np.where(x > 0, 1 - tail, tail)


def _raised(x: np.ndarray, norm: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """x on the unit sphere, by one more component that brings each to the longest of its range."""
    unit = x / longest[:, None]
    return np.column_stack([unit, np.sqrt(np.maximum(0.0, 1 - (norm / longest) ** 2))])


def near(
    spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 20, tables: int = 2, hashes: int = 3, width: float = 1.0, distance: float = 1.0, success: float = 0.75, block: int = 16384, query_block: int = 16384
) -> DataFrame:
    """Approximately the k largest inner products: query_id, rank, vec_id, score. rows: id long, v array<double>.

    Inner products become distances: each candidate gets one more component that brings its length to the longest of
    its range (lengths within a factor of 2), and queries are scaled to that length, so that the nearest point of a
    range has the largest product. Every candidate is in one cell of each table, and is sent once a table: neighbouring
    cells share blocks of about ``block`` candidates, and a cell of more is split. A query visits cells of each table
    from the likeliest on, until they hold ``success`` of the estimated probability of a point at ``distance`` (the
    sphere's radius is 1), and is sent to these cells' blocks only. There the visited cells' candidates are ranked by exact
    products, and the tables' answers are merged. Queries that met fewer than k candidates are compared with all rows.

    The number of cells is bounded by their geometry (tables * 21 ranges * 13 ** hashes); their counts go to all workers."""
    schema = "query_id long, vec_id long, score double"
    rows = rows.withColumn("norm", _norm(F.col("v")))
    n, most, dims = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("v"))).first()
    if not n:
        return _ranked(spark.createDataFrame([], schema), k)
    hashed = Tables(dims + 1, tables, hashes, width, distance)
    rows = rows.withColumn("range", F.least(F.floor(F.log2(F.lit(most) / F.col("norm"))), F.lit(20)).cast("long"))

    def cells_of(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = _matrix(b["v"], np.float64)
        x = np.pad(x, ((0, 0), (0, dims - x.shape[1])))
        unit = _raised(x, b["norm"].to_numpy(), most * 0.5 ** b["range"].to_numpy().astype(float))
        for t in range(tables):
            yield t, hashed.cells(t, unit)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for t, c in cells_of(b):
                    cell, place = np.unique(np.column_stack([b["range"].to_numpy(), c]), axis=0, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t)), pa.array(cell[:, 0].copy()), pa.array(cell[:, 1].copy()), pa.array(np.bincount(place.ravel(), minlength=len(cell)))], names=["t", "range", "cell", "n"])

    count = rows.select("v", "norm", "range").mapInArrow(counted, "t long, range long, cell long, n long").groupBy("t", "range", "cell").agg(F.sum("n").alias("n")).collect()
    # Blocks: runs of cells, in the order of the first projection; a cell beyond `block` gets several blocks of its own.
    first, parts, at, held, before = {}, {}, -1, block, None
    for t, r, c, m in sorted(map(tuple, count)):
        if held + m > block or before != (t, r):
            at, held = at + 1, 0
        first[t, r, c], parts[t, r, c] = at, -(-m // block)
        at, held, before = at + parts[t, r, c] - 1, held + m if parts[t, r, c] == 1 else block, (t, r)
    ranges = sorted({r for _, r, _ in first})
    known = {(t, r): np.array(sorted(c for u, s, c in first if (u, s) == (t, r)), dtype=np.int64) for t in range(tables) for r in ranges}
    blocks_of = {key: (np.array([first[(*key, c)] for c in cells.tolist()]), np.array([parts[(*key, c)] for c in cells.tolist()])) for key, cells in known.items()}
    plan = sent(spark, (known, blocks_of))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            known, blocks_of = plan.value
            ids, r = b["id"].to_numpy(), b["range"].to_numpy()
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) + np.arange(len(ids))  # rows of one id spread too
            for t, c in cells_of(b):
                at = np.empty(len(ids), dtype=np.int64)
                for s in np.unique(r).tolist():
                    some = np.flatnonzero(r == s)
                    j = np.searchsorted(known[t, s], c[some])
                    at[some] = blocks_of[t, s][0][j] + salt[some] % blocks_of[t, s][1][j]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c), b["id"], b["v"]], names=["block", "cell", "id", "v"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks_of = plan.value
        for whole in batches:
            for k0 in range(0, whole.num_rows, 256):
                b = whole.slice(k0, 256)
                q = _matrix(b["v"], np.float64)
                q = np.pad(q, ((0, 0), (0, dims + 1 - q.shape[1])))
                q = q / np.sqrt((q**2).sum(axis=1))[:, None]
                out: tuple[list, list, list] = ([], [], [])
                for t in range(tables):
                    chance = hashed.success(t, q)
                    for r in ranges:
                        cells = known[t, r]
                        at, more = blocks_of[t, r]
                        p = chance[:, cells]
                        order = np.argsort(-p, axis=1, kind="stable")
                        sure = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
                        for i in range(len(q)):
                            some = np.sort(order[i, : np.searchsorted(sure[i], success) + 1])
                            edge = np.flatnonzero(np.diff(at[some], prepend=-1))
                            for s, own in zip(edge, np.split(some, edge[1:]), strict=True):
                                for part in range(more[own[0]]):
                                    out[0].append(at[some[s]] + part)
                                    out[1].append(i)
                                    out[2].append(cells[own])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), b["id"].take(pa.array(out[1], pa.int64())), b["v"].take(pa.array(out[1], pa.int64())), b["qb"].take(pa.array(out[1], pa.int64()))], names=["at", "cells", "id", "v", "qb"])

    q_blocks = max(1, -(-rows.where(is_query).count() // query_block))
    queries = _queries(rows, is_query).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("long"))
    queries = queries.where(F.exists("v", lambda x: x != 0))
    candidates = rows.select("id", "v", "norm", "range").mapInArrow(placed, "block long, cell long, id long, v array<double>")
    visits = queries.mapInArrow(visiting, "at long, cells array<long>, id long, v array<double>, qb long")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q = _widened(_matrix(left["v"], np.float64), _matrix(right["v"], np.float64))
        cell, of = np.unique(left["cell"].to_numpy(), return_inverse=True)
        met = np.zeros((len(q), len(cell)), dtype=bool)
        for i, own in enumerate(right["cells"].to_pylist()):
            j = np.searchsorted(cell, own)
            j = j[(j < len(cell)) & (cell[np.minimum(j, len(cell) - 1)] == own)]
            met[i, j] = True
        return _searched(x, left["id"].to_numpy(), q, right["id"].to_numpy(), k, lambda i: met[i][of])

    # A block of candidates goes to the blocks of queries that visit it, and nowhere else.
    visits = staged(spark, visits, "visits")
    met = visits.select(F.col("at").alias("block"), F.col("qb").alias("of")).distinct()  # blocks * query blocks at most
    candidates = candidates.join(_few(met), "block")
    found = candidates.groupBy("block", "of").cogroup(visits.groupBy("at", "qb")).applyInArrow(search, schema)
    found = staged(spark, found.distinct(), "found")

    few = min(k, n - 1)
    counts = found.groupBy("query_id").count().where(F.col("count") >= few)
    lonely = queries.join(counts, queries["id"] == counts["query_id"], "left_anti").select("id", "v", "qb")
    if lonely.limit(1).count():
        lonely = staged(spark, lonely, "lonely")
        salts = -(-n // block)
        left = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(salts)).cast("long").alias("block"), F.lit(0).cast("long").alias("cell"))
        there = lonely.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("at"), F.array(F.lit(0).cast("long")).alias("cells"), "id", "v")
        found = found.union(left.groupBy("block").cogroup(there.groupBy("at")).applyInArrow(search, schema)).distinct()
    return _ranked(found, k)


def _searched(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, met: Callable) -> pa.Table:
    """The k highest products of each query among the candidates that it met; products as sums in the order of components."""
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), 64):
        rough = x @ q[at : at + 64].T
        for i in range(at, min(at + 64, len(q))):
            rows = np.flatnonzero(met(i) & (ids != q_ids[i]))
            if not len(rows):
                continue
            own = rough[rows, i - at]
            if len(rows) > k:  # exact products only where rounding can matter
                least = np.partition(own, len(own) - k)[len(own) - k]
                rows = rows[own >= least - 1e-9 * (1 + abs(least))]
            score = (x[rows] * q[i]).sum(axis=1)
            best = _best(score, ids[rows], k)
            out[0].append(np.full(len(best), q_ids[i]))
            out[1].append(ids[rows[best]])
            out[2].append(score[best])
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({name: np.concatenate([e, *v]) for name, v, e in zip(("query_id", "vec_id", "score"), out, empty, strict=True)})


def op6_near(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    ok = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    rows = ok.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return near(spark, rows, F.col("id") % 20 == 0)
