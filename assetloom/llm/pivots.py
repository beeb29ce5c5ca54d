"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order of nearness. An inverted list for each pivot
and label holds vectors that have the pivot among theirs; within a list, vectors that share enough pivots are candidates,
and their exact cosine decides.

Two of ``nearest`` pivots each that share ``shared`` or more have a common one among the first ``nearest - shared + 1`` of
either, whatever order pivots stand in, so a vector enters that many lists only; the order is by rarity, which keeps
lists short. A pair is compared in the list of its first common pivot and nowhere else. A list of more than ``block``
rows is cut into parts, and each two of them meet in a task of their own; what a list holds is never gathered in one
task. Nothing is dropped. From a list come counts and stars (a vector and the smallest of those that it hangs together
with), never pairs.

The pivots come from a bounded sample; their number grows with the table (``pivot_number``), so that about 8,192 unrelated
vectors at most meet a vector, up to 4,096 pivots.

Defined results: vectors that are null, zero or hold null or non-finite components, and those without a label, link with
nothing; vectors of different lengths count as padded with zeros; rows with the same vector and label are one node with
their number as weight, so that they are linked with each other without being compared; rows of equal id are separate
vectors; a null id is a vector like others, but never the name of a component unless all ids in it are null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.common import removed, sent, staged
from assetloom.llm.components import components
from assetloom.llm.vectors import _matrix, usable

#: Classes that are sent to all workers; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: About so many places in short lists make a task.
TASK_ROWS = 4096


def pivot_number(n: int) -> int:
    """Pivots for n vectors: a power of two, 256 at least and 4,096 at most."""
    return min(4096, 1 << max(8, (max(1, n // 328) - 1).bit_length()))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; a zero row stays zero."""
    x = vectors.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0.0), 5e-324)[:, None]  # squares of huge components would overflow
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 5e-324)[:, None]


def chosen(sample: np.ndarray, n: int, alike: float = 0.9) -> np.ndarray:
    """n pivots: of the sample, in its order, those that aren't alike to one before, then random directions."""
    taken = np.empty((n, sample.shape[1]))
    k = 0
    for x in sample:
        if k < n and (k == 0 or (taken[:k] @ x).max() < alike):
            taken[k] = x
            k += 1
    taken[k:] = units(np.random.default_rng(11).normal(size=(n - k, sample.shape[1])))
    return taken


def permutation(unit: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first; ties to the smaller number."""
    near = unit @ pivots.T
    some = np.sort(np.argpartition(-near, nearest - 1, axis=1)[:, :nearest] if nearest < near.shape[1] else np.tile(np.arange(nearest), (len(near), 1)), axis=1)
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1).astype(np.int32)


class InvertedList:
    """Rows of one pivot's list: what they share and what hangs together. ``places``: each row's pivots by rank of rarity."""

    TILE = 64

    def __init__(self, unit: np.ndarray, places: np.ndarray, weight: np.ndarray, own: int):
        self.unit, self.places, self.weight = unit, np.sort(places, axis=1), weight
        order = np.argsort(self.places, axis=None, kind="stable")
        flat = self.places.ravel()[order]
        self.rows_of = dict(zip(flat[edge := np.flatnonzero(np.diff(flat, prepend=-1))].tolist(), np.split(order // places.shape[1], edge[1:]), strict=True))
        self.own, self.links, self.root = own, np.zeros(len(unit), np.int64), np.arange(len(unit))

    def candidates(self, i: int, others: np.ndarray, shared: int) -> np.ndarray:
        """Places in ``others`` (a mask over rows) that share enough pivots with row i, this list's being their first common one."""
        mask = others.copy()
        for p in self.places[i].tolist():
            if p >= self.own:
                break
            mask[self.rows_of[p]] = False
        if not mask.any():
            return np.empty(0, np.int64)
        count = np.bincount(np.concatenate([self.rows_of[p] for p in self.places[i].tolist()]), minlength=len(mask))
        return np.flatnonzero(mask & (count >= shared))

    def compare(self, left: np.ndarray, right: np.ndarray, shared: int, cosine: float) -> None:
        """Links of rows in left with later rows in right (masks)."""
        rows = np.flatnonzero(left)
        for at in range(0, len(rows), self.TILE):
            some = rows[at : at + self.TILE]
            met = []
            for i in some.tolist():
                others = right.copy()
                if left is right:
                    others[: i + 1] = False
                met.append(self.candidates(i, others, shared))
            dense = sum(map(len, met)) * 8 > len(some) * len(right)
            product = self.unit[some] @ self.unit.T if dense else None
            for k, (i, js) in enumerate(zip(some.tolist(), met, strict=True)):
                if len(js):
                    near = product[k, js] if dense else self.unit[js] @ self.unit[i]
                    self._link(i, js[near >= cosine])

    def _link(self, i: int, js: np.ndarray) -> None:
        if not len(js):
            return
        self.links[i] += self.weight[js].sum()
        self.links[js] += self.weight[i]
        roots = np.unique(np.append(self.root[js], self.root[i]))
        if len(roots) > 1:
            hit = np.zeros(len(self.root), dtype=bool)
            hit[roots[1:]] = True
            self.root[hit[self.root]] = roots[0]


def _compared(shared: int, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        part, place, apart = table["part"].to_numpy(), table["place"].to_numpy(), table["a"][0] != table["b"][0]
        label = pc.dictionary_encode(table["label"]).combine_chunks()
        name = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        node, weight = table["node"].to_numpy(), table["weight"].to_numpy()
        places = _matrix(table["places"], np.int32)
        order = np.lexsort((node, place, name))
        edge = np.flatnonzero(np.diff(name[order], prepend=-1) | np.diff(place[order], prepend=-1))
        out: tuple[list, list, list] = ([], [], [])
        for rows in np.split(order, edge[1:]):
            sides = np.unique(part[rows])
            if len(rows) < 2 or len(sides) != 1 + apart:
                continue
            found = InvertedList(units(_matrix(table["v"].take(pa.array(rows)), np.float64)), places[rows], weight[rows], int(place[rows[0]]))
            left = part[rows] == sides[0]
            found.compare(left, ~left if apart else left, shared, cosine)  # parts of one list meet two by two, or each itself
            some = np.flatnonzero(found.links)
            out[0].append(node[rows[some]])
            out[1].append(found.links[some])
            out[2].append(node[rows[found.root[some]]])
        return pa.table({n: np.concatenate([np.empty(0, np.int64), *x]) for n, x in zip(("node", "links", "root"), out, strict=True)})

    return run


def near_vectors(spark: SparkSession, rows: DataFrame, cosine: float = 0.98, nearest: int = 10, shared: int = 6, block: int = 16_384, pivots: int | None = None) -> DataFrame:
    """A row for each of rows (id long, v array<float or double>, label): id, n_links, component_id.

    Links hold exactly; a pair is found if it shares ``shared`` of ``nearest`` pivots (of isotropic vectors in 64 dimensions
    that are just at a cosine of 0.98, 99.5 % do with 256 pivots, and more of nearer ones)."""
    ok = usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    key = ["label", "h1", "h2"]  # 128 bits of hash stand for the vector
    rows = rows.select("id", F.col("label").cast("string").alias("label"), "v", ok.alias("ok"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    classes = rows.where("ok").groupBy(*key).agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = staged(spark, classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n, dims = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))

    number = pivots or pivot_number(n)
    few = classes.where(F.pmod("h2", F.lit(max(1, n // (4 * number)))) == 0).orderBy("h1", "h2").limit(4 * number).select("v").toArrow()  # the documented sample: four vectors a pivot
    wide = lambda x: np.pad(x, ((0, 0), (0, dims - x.shape[1])))
    points = sent(spark, chosen(wide(units(_matrix(few["v"], np.float64))), number))
    first = nearest - shared + 1

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                own = permutation(wide(units(_matrix(b["v"], np.float64))), points.value, nearest)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), nearest).cast(pa.list_(pa.int32()))], names=[*b.schema.names, "pivots"])

    kind = classes.schema["v"].dataType.simpleString()
    index = staged(spark, classes.mapInArrow(described, f"label string, h1 long, h2 long, least long, weight long, v {kind}, node long, pivots array<int>"), "pivots")
    removed(spark, classes)
    use = {r["p"]: r["n"] for r in index.select(F.explode("pivots").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    rank = {p: i for i, p in enumerate(sorted(range(number), key=lambda p: (use.get(p, 0), p)))}
    rank = F.split(F.lit(",".join(str(rank[p]) for p in range(number))), ",").cast("array<int>")  # one literal
    lists = index.select("node", "label", "weight", "v", F.array_sort(F.transform("pivots", lambda p: F.get(rank, p))).alias("places"))
    lists = lists.select("*", F.explode(F.slice("places", 1, first)).alias("place"))

    # Short lists share tasks; a long one is cut into parts, each two of which are a task.
    name = F.xxhash64("label", "place")
    sizes = index.select("label", F.explode("pivots").alias("p")).select("label", F.get(rank, F.col("p")).alias("place")).groupBy("label", "place").agg(F.count("*").alias("n"))
    long = sizes.where(F.col("n") > block).select("label", "place", F.ceil(F.col("n") / block).alias("parts"))  # n * nearest / block rows at most
    lists = lists.join(_small(long), ["label", "place"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    lists = lists.withColumn("part", F.coalesce(own, F.lit(0)).cast("long")).withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    task = F.when(F.col("parts").isNull(), F.pmod(name, F.lit(max(1, n * first // TASK_ROWS)))).otherwise(name)
    lists = lists.select("node", "label", "weight", "v", "places", "place", "part", task.alias("task"), F.col("parts").isNotNull().alias("cut"), F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    found = staged(spark, lists.groupBy("task", "cut", "a", "b").applyInArrow(_compared(shared, cosine), "node long, links long, root long"), "linked")

    label = components(spark, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = index.select(*key, "node", "least", "weight").join(links, "node", "left").join(label.withColumnRenamed("label", "group"), "node", "left")
    group = named.where("group is not null").groupBy("group").agg(F.min("least").alias("smallest"))
    named = named.join(group, "group", "left").where("weight > 1 or group is not null")
    named = staged(spark, named.select(*[F.col(c).alias(f"c_{c}") for c in key], (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")), "named")
    both = rows.join(_small(named), F.col("ok") & (F.col("label") == F.col("c_label")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2")), "left")
    return both.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def op11_pivot_near_dup(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    vector = F.col("embedding")
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), (vector if kind == "float" else F.transform(vector, lambda x: x.cast("double"))).alias("v"), "label")
    return near_vectors(spark, rows).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
