"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target: a share of the total of all sizes, by its weight, never over ``max_repeats`` times what
the source has (the excess goes to the others by weight). Within a source, rows stand in a shuffled order that a
64-bit hash fixes, up to ``max_repeats`` times over. A row's virtual finish time is the source's running size
divided by its target; all sources' rows are put in one order by that time, and the mix takes them up to the total.

Nothing is ordered in one task: the running size of a source is a prefix sum over ranges of the hash (each of about
``range_rows`` rows), and the cut through the global order is found by summing sizes over ranges of the finish time,
again and again within the range that holds the cut.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in
order; rows that are equal in every column share one place in the order and are taken as separate rows; an empty
table gives an empty result. Columns are kept whatever their names; working columns start with ``__al_``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assetloom.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
CUT_RANGES = 1024


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fair_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], max_repeats: int) -> dict[str | None, float]:
    """Targets by source. Sources stand in code point order, null last; weights repeat along that order."""
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size, weight = dict(sizes), {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, free, target = float(sum(size.values())), set(order), dict.fromkeys(order, 0.0)
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in order if s in free and share * weight[s] >= max_repeats * size[s]]
        for s in full:
            target[s] = float(max_repeats * size[s])
            left -= target[s]
            free.discard(s)
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
    return target


def _placed(rows: DataFrame, offsets: DataFrame, ranges: int) -> DataFrame:
    """rows with __al_at, the running size of the row's source up to and with it, and the source's totals."""
    own = Window.partitionBy("__al_source", "__al_null", "__al_range").orderBy("__al_hash", "__al_size")
    both = rows.withColumn("__al_range", _range(ranges)).join(offsets, ["__al_source", "__al_null", "__al_range"])
    running = F.sum("__al_size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("__al_at", running + F.col("__al_before"))


def _range(ranges: int) -> Column:
    """Equal ranges of the hash, in its order."""
    return F.floor((F.shiftright("__al_hash", 32).cast("double") + F.lit(2.0**31)) * F.lit(ranges / 2.0**32)).cast("long")


def _finish(p: int) -> Column:
    return (F.lit(p) * F.col("__al_total") + F.col("__al_at")).cast("double") / F.col("__al_target")


def prepared(docs: DataFrame, source: str, size: Column, tie: Sequence[str]) -> DataFrame:
    """docs with the working columns that the queue needs: source, size and the hash that shuffles."""
    return docs.withColumns({
        "__al_source": F.coalesce(F.col(source), F.lit("")),
        "__al_null": F.col(source).isNull(),
        "__al_size": size,
        "__al_hash": F.xxhash64(*tie),
    })


def queue(spark: SparkSession, narrow: DataFrame, rows: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, range_rows: int = 4096) -> DataFrame:
    """rows with __al_total, __al_target and __al_times, how often the mix takes a row.

    narrow holds the working columns of the same rows (see prepared()); it is read several times, so give a table.
    """
    by = ["__al_source", "__al_null"]
    totals = narrow.groupBy(*by).agg(F.sum("__al_size").alias("__al_total"), F.count("*").alias("n")).collect()  # one row a source
    target = fair_targets([(None if r["__al_null"] else r["__al_source"], r["__al_total"]) for r in totals], weights, max_repeats)
    schema = T.StructType([T.StructField("__al_source", T.StringType()), T.StructField("__al_null", T.BooleanType()), T.StructField("__al_total", T.LongType()), T.StructField("__al_target", T.DoubleType())])
    listed = [(r["__al_source"], r["__al_null"], r["__al_total"], target[None if r["__al_null"] else r["__al_source"]]) for r in totals]
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.float64())
    known = spark.createDataFrame(pa.table([pa.array([r[i] for r in listed], k) for i, k in enumerate(kinds)], names=schema.names), schema)  # a list would start a second set of Python workers
    ranges = max(1, -(-sum(r["n"] for r in totals) // range_rows))
    budget = sum(r["__al_total"] for r in totals)

    part = narrow.withColumn("__al_range", _range(ranges)).groupBy(*by, "__al_range").agg(F.sum("__al_size").alias("__al_sum"))
    before = Window.partitionBy(*by).orderBy("__al_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.withColumn("__al_before", F.coalesce(F.sum("__al_sum").over(before), F.lit(0))).drop("__al_sum").join(known, by)
    offsets = staged(spark, offsets, "offsets")

    # Size 0 takes no room in the queue, and such rows are never taken.
    taken = F.col("__al_size") > 0
    queued = staged(spark, _placed(narrow.select(*by, "__al_size", "__al_hash"), offsets, ranges).where(taken).select("__al_size", "__al_hash", F.inline(F.array(*[F.struct(_finish(p).alias("v")) for p in range(max_repeats)]))), "queued")
    v, h = _cut(queued, budget)
    times = sum((F.when((_finish(p) < v) | ((_finish(p) == v) & (F.col("__al_hash") <= h)), 1).otherwise(0) for p in range(max_repeats)), F.lit(0))
    return _placed(rows, offsets, ranges).withColumn("__al_times", F.when(taken, times).otherwise(0))


def _cut(queued: DataFrame, budget: int, few: int = 20_000) -> tuple[float, int]:
    """The last place (finish time, hash) of the order up to which the sizes stay within the budget.

    Only sums over at most CUT_RANGES ranges come to the driver; the range with the cut is divided again until it
    has few rows, which one small sort then orders."""
    top = queued.agg(F.max("v")).first()[0]
    if top is None:
        return 0.0, 0
    low, high, spent = 0.0, top * (1 + 1e-12), 0
    for _ in range(12):
        step = (high - low) / CUT_RANGES
        inside = queued.where((F.col("v") >= low) & (F.col("v") < high)) if spent or high <= top else queued
        number = F.least(F.floor((F.col("v") - low) / step), F.lit(CUT_RANGES - 1)).cast("int") if step > 0 else F.lit(0)
        sums = sorted((r["b"], r["s"], r["n"]) for r in inside.groupBy(number.alias("b")).agg(F.sum("__al_size").alias("s"), F.count("*").alias("n")).collect())
        for b, s, n in sums:
            if spent + s > budget:
                break
            spent += s
        else:
            return high, 0
        low, high = max(low, low + b * step), low + (b + 1) * step
        if n <= few or step <= 0:
            break
    # The ranges' bounds are rounded, so the rest is taken with everything before low summed exactly.
    spent = queued.where(F.col("v") < low).agg(F.coalesce(F.sum("__al_size"), F.lit(0))).first()[0]
    last = queued.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v", "__al_hash").agg(F.sum("__al_size").alias("s")).orderBy("v", "__al_hash").collect()
    v, h = low, -(2**63)
    for r in last:
        spent += r["s"]
        if spent > budget:
            break
        v, h = r["v"], r["__al_hash"]
    return v, h


def mixed(spark: SparkSession, docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each row of docs as often as the queue takes it (general interface; texts are kept)."""
    rows = prepared(docs, source, text_size(F.col(text)), [key, text, source])
    narrow = staged(spark, rows.select("__al_source", "__al_null", "__al_size", "__al_hash"), "sizes")
    out = queue(spark, narrow, rows, **how).where("__al_times > 0")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), "__al_times")).alias("__al_copy")).drop("__al_copy")


def op8_mixing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = prepared(docs, "source", text_size(F.col("text")), ["doc_id", "text", "source"])
    narrow = staged(spark, rows.select("doc_id", "__al_source", "__al_null", "__al_size", "__al_hash"), "sizes")
    return queue(spark, narrow, narrow).select(
        "doc_id", F.col("__al_size").alias("size"), F.col("__al_total").alias("source_size"), F.col("__al_target").alias("target"), (F.col("__al_size") * F.col("__al_times")).alias("taken")
    )
