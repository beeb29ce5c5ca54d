"""Filter interaction audit: what filters remove together, in every order.

Rows are reduced to cells: how many rows of a part fail just one set of filters. All orders of the filters are then walked
by adjacent transpositions (Steinhaus, Johnson and Trotter): from one order to the next two neighbours change places, so
only these two steps have other results, read from the cells anew; the other steps stay. Shapley sums gather along the walk.

A row's failures are column expressions of its own text, but for duplicates: those are found by grouped minima over a
128-bit hash of the text, after equal rows were counted together, so that a text that a third of the rows have is a few
rows before anything is shuffled by text. Cells are bounded (2 ** filters for a part) and each part's walk is its own
group, so parts spread over tasks.

Defined results: a null text counts as empty, a null part as an empty text; a null id is neither smaller nor larger than
another, so it never makes a duplicate nor is one; rows of equal id and text aren't duplicates of each other; an id that
the labels name several times is good (toxic) if one of its labels says so; ids without a label, and null labels, are
neither; an empty table has no parts and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six bytes that part words.
SPACES = "\t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def transpositions(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of n things, each with the place of the first of the two neighbours that changed (None for the first)."""
    order, way = list(range(n)), [-1] * n
    yield order, None
    while True:
        movable = [x for x in range(n) if 0 <= (j := order.index(x) + way[x]) < n and order[j] < x]
        if not movable:
            return
        x = max(movable)
        i = order.index(x)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield order, min(i, j)


def walk(cells: np.ndarray, filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """(orders, removed, shapley) for cells (2 ** filters, m): what each step of each order removes, of m kinds of counts,
    and each filter's first kind summed over all orders."""
    mask = np.arange(1 << filters)
    removed = lambda before, f: cells[((mask >> f) & 1 == 1) & (mask & before == 0)].sum(axis=0)
    orders, out, shapley = [], [], np.zeros(filters, dtype=np.int64)
    step = np.zeros((filters, cells.shape[1]), dtype=np.int64)
    for order, changed in transpositions(filters):
        for i in range(filters) if changed is None else (changed, changed + 1):
            step[i] = removed(sum(1 << f for f in order[:i]), order[i])
        orders.append(tuple(order))
        out.append(step.copy())
        shapley[order] += step[:, 0]
    return orders, np.array(out), shapley


def cells(rows: DataFrame, failures: dict[str, Column], labels: DataFrame, part: Column, text: Column, key: Column, duplicates: str) -> DataFrame:
    """part, mask, n, good, toxic: rows by what they fail. failures: conditions in order of their bits; the last bit, named
    ``duplicates``, is for rows whose text a smaller key has."""
    body = F.coalesce(text, F.lit(""))
    mask = F.lit(0)
    for i, fails in enumerate(failures.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    some = rows.select(key.cast("long").alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"))
    some = some.groupBy(*some.columns).agg(F.count("*").alias("n"))
    said = labels.where("id is not null").groupBy("id").agg(F.max(F.coalesce(F.col("good"), F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic"), F.lit(False))).alias("toxic"))
    some = some.join(said, "id", "left").fillna(False, ["good", "toxic"])
    # Rows of one text differ in few ways (part and labels): what matters of ids is the smallest and how often it occurs.
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    some = some.groupBy("h1", "h2", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first)
    least = some.groupBy("h1", "h2").agg(F.min("first.id").alias("least"))
    some = some.join(least, ["h1", "h2"])
    fresh = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), fresh.alias("n")), F.struct((F.col("mask") + (1 << len(failures))).alias("mask"), (F.col("n") - fresh).alias("n")))).alias("c")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("c.n")).otherwise(0)).cast("long").alias(flag)
    return some.select("part", "good", "toxic", both).where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").cast("long").alias("n"), of("good"), of("toxic"))


def audit(counted: DataFrame, names: str) -> DataFrame:
    """Rows (part, filter_order, step, ...) of every order of the filters (one letter each, in order of their bits) for cells."""
    m = len(names)

    def run(table: pa.Table) -> pa.Table:
        cell = np.zeros((1 << m, 3), dtype=np.int64)
        np.add.at(cell, table["mask"].to_numpy(), np.column_stack([table[c].to_numpy() for c in ("n", "good", "toxic")]))
        orders, removed, shapley = walk(cell, m)
        mask, total = np.arange(1 << m), cell[:, 0].sum()
        fails = np.array([cell[(mask >> f) & 1 == 1, 0].sum() for f in range(m)])
        order = np.array(orders)
        flat = order.ravel()
        columns = {
            "part": [table["part"][0].as_py()] * len(flat), "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], m), "step": np.tile(np.arange(1, m + 1, dtype=np.int32), len(orders)),
            "kept": (total - np.cumsum(removed[:, :, 0], axis=1)).ravel(), "removed": removed[:, :, 0].ravel(), "redundant": fails[flat] - removed[:, :, 0].ravel(), "unique_fails": cell[1 << flat, 0],
            "good_lost": removed[:, :, 1].ravel(), "toxic_lost": removed[:, :, 2].ravel(), "shapley": shapley[flat],
        }
        return pa.table(columns)

    return counted.groupBy("part").applyInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op12_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    length = F.length(text)
    failures = {
        "A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * (length - F.length(F.translate(text, CAPITALS, ""))).cast("long") > 3 * length.cast("long"), "D": text.rlike(r"[#$%&*|]"),
    }
    said = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit(cells(docs, failures, said, F.col("lang"), F.col("text"), F.col("doc_id"), "E"), "ABCDE")
