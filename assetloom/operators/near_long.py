"""Near pairs and groups of long hashes (sixteen 64-bit words): the 64-bit threshold t becomes 16 t of 1,024 bits.

The index is that of short hashes, over all sixteen words: bands in groups, of which two near hashes agree in k bands of one
group at least, so that every choice of k bands of a group is a key (assetloom.operators.similarity). Keys hold the number
of a hash, never its 128 bytes; candidates are taken once and only then meet the words.

Groups need no dense pairs. In a first step every hash is compared with one hash of each of its keys, the smallest, which
links most of a family at once; in a second one, hashes that share a key and still are in different groups. Both give
links, from which the groups follow; pairs inside a group are never listed.

Defined results: null hashes take no part; hashes of fewer or more than sixteen words, and words that are null, are an
error; equal hashes are one from the start; an empty table gives an empty result."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.hashing import hamming_words
from assetloom.operators.components import components
from assetloom.operators.similarity import TASK_ROWS, _long, band_groups

WORDS, BITS = 16, 1024
Kept = Callable[[DataFrame], DataFrame]


def _checkpoint(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def _band(words: Column, low: int, high: int) -> Column:
    """Bits low to high - 1 as a long; of more than 64, words lie over each other, so that equal bits still give equal longs."""
    parts, at = F.lit(0).cast("long"), low
    while at < high:
        end = min(high, (at // 64 + 1) * 64)
        bits = F.shiftrightunsigned(F.get(words, at // 64), at % 64).bitwiseAND(_long((1 << (end - at)) - 1))
        parts, at = parts.bitwiseOR(F.shiftleft(bits, (at - low) % 64)), end
    return parts


def nodes(hashes: DataFrame, words: str, kept: Kept) -> DataFrame:
    """node, words: each distinct hash with a number."""
    whole = F.when((F.size(words) == WORDS) & F.forall(words, lambda x: x.isNotNull()), F.col(words)).otherwise(F.raise_error(F.lit("a long hash has sixteen words")))
    some = hashes.where(F.col(words).isNotNull()).select(whole.cast("array<bigint>").alias("words")).distinct()
    return kept(some.withColumn("node", F.monotonically_increasing_id()))


def keyed(some: DataFrame, max_bits: int, count: int) -> DataFrame:
    """key, node for every choice of bands."""
    groups, k = band_groups(max_bits, count, BITS)
    n = groups[-1].stop
    edge = [BITS * i // n for i in range(n + 1)]
    band = [_band(F.col("words"), a, b) for a, b in itertools.pairwise(edge)]
    keys = [F.xxhash64(F.lit(j), *[F.col(f"b{i}") for i in c]) for j, c in enumerate(c for g in groups for c in itertools.combinations(g, k))]
    rows = some.repartition(max(1, count * len(keys) // TASK_ROWS), "node").select("node", *[b.alias(f"b{i}") for i, b in enumerate(band)])
    return rows.select(F.explode(F.array(*keys)).alias("key"), "node")


def _verified(pairs: DataFrame, some: DataFrame, max_bits: int) -> DataFrame:
    """a, b, distance of pairs (a, b: nodes) within max_bits."""
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    return both.select("a", "b", hamming_words(F.col("x"), F.col("y")).alias("distance")).where(F.col("distance") <= max_bits)


def _met(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes that share a key."""
    # Spark takes rows for as large as before explode, and would broadcast them.
    other = rows.select("key", F.col("node").alias("b")).hint("merge")
    return rows.select("key", F.col("node").alias("a")).hint("merge").join(other, "key").where("a < b").select("a", "b").distinct()


def near_long_pairs(hashes: DataFrame, max_distance: int, words: str = "phash_enh", kept: Kept = _checkpoint) -> DataFrame:
    """Distinct hashes a < b (arrays, in the order of arrays) within 16 * max_distance bits, with distance: all pairs."""
    max_bits = _limit(max_distance)
    some = nodes(hashes, words, kept)
    found = _verified(_met(keyed(some, max_bits, some.count())), some, max_bits)
    named = found.join(some.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    low = F.col("x") < F.col("y")
    return named.select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("b"), "distance")


def _limit(max_distance: int) -> int:
    if not 0 <= max_distance < 64:
        raise ValueError("max_distance lies between 0 and 63")
    return 16 * max_distance


def near_long_links(some: DataFrame, max_distance: int, kept: Kept = _checkpoint) -> tuple[DataFrame, DataFrame]:
    """(links, groups) of nodes(): links a, b, distance that connect what near pairs connect; groups node, label."""
    max_bits = _limit(max_distance)
    rows = kept(keyed(some, max_bits, some.count()))
    first = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = rows.join(first.hint("merge"), "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = kept(_verified(stars, some, max_bits))
    label = kept(components(links.select("a", "b"), kept))
    # Beyond two hashes a key may also join two that aren't its smallest; those already in one group need no link.
    rest = rows.join(first.where("n > 2").select("key").hint("merge"), "key").join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    other = rest.select("key", F.col("node").alias("b"), F.col("label").alias("of_b")).hint("merge")
    apart = rest.withColumnsRenamed({"node": "a", "label": "of_a"}).hint("merge").join(other, "key").where("a < b and of_a <> of_b").select("a", "b").distinct()
    more = kept(_verified(apart, some, max_bits))
    if more.limit(1).count():
        links = links.union(more)
        label = components(links.select("a", "b"), kept)
    return links, label


def near_long_groups(hashes: DataFrame, max_distance: int, key: str, words: str = "phash_enh", kept: Kept = _checkpoint) -> DataFrame:
    """key, label: the smallest key that is reached over near pairs or equal hashes, however long the chain."""
    some = nodes(hashes, words, kept)
    _, label = near_long_links(some, max_distance, kept)
    grouped = some.join(label, "node", "left").select("words", F.coalesce("label", "node").alias("group"))
    rows = hashes.where(F.col(words).isNotNull()).select(F.col(key), F.col(words).cast("array<bigint>").alias("words"))
    least = rows.groupBy("words").agg(F.min(key).alias("least")).join(grouped, "words")
    named = least.join(least.groupBy("group").agg(F.min("least").alias("label")), "group").select("words", "label")
    return rows.join(named, "words").select(key, "label")
