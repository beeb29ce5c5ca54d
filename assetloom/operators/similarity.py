"""Near pairs of 64-bit hashes and their groups.

Hashes are cut into t + g (k - 1) + 1 bands in g groups; two within t bits differ in t bands at most, so that in one group
they agree in k bands at least. Each choice of k bands of one group is a key. Groups and k follow from the number of hashes:
more and wider keys where narrow ones would meet too many hashes that aren't near, so that candidates don't grow with the
square of the table. Equal hashes are one class from the start, so that a value that many files share (flat pictures) makes
no pairs with itself."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.hashing import hamming
from assetloom.operators.components import components

#: Keys of a hash at most; beyond, keys stay narrower.
MOST_KEYS = 512
#: Candidates that take as long as one key of one hash, and rows of keys that one task makes.
CANDIDATES, TASK_ROWS = 16, 1_000_000


def bands(n: int) -> list[int]:
    """n bands of 64 bits, of nearly equal width, as masks."""
    edge = [64 * i // n for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in itertools.pairwise(edge)]


def _long(x: int) -> Column:
    return F.lit(x - 2**64 if x >= 2**63 else x).cast("long")


def band_groups(max_distance: int, hashes: int, bits: int = 64) -> tuple[list[range], int]:
    """Groups of bands and how many bands of a group make a key: the cheapest for so many hashes, as far as MOST_KEYS lets."""
    best = None
    for g, k in itertools.product(range(1, bits // 8 + 1), range(1, 33)):
        n = max_distance + g * (k - 1) + 1
        if n > bits:
            continue
        groups = [range(n * i // g, n * (i + 1) // g) for i in range(g)]
        keys = sum(math.comb(len(x), k) for x in groups)
        cost = keys * (1 + hashes / 2 ** min(500.0, bits * k / n) / CANDIDATES)
        if keys <= MOST_KEYS and (best is None or cost < best[0]):
            best = cost, groups, k
    return best[1:]


class Keys:
    """The keys of hashes for a distance and so many hashes: every choice of k bands of one group."""

    LOW = MOST_KEYS - 1  # the last bits of a key tell which choice of bands it is

    def __init__(self, max_distance: int, hashes: int):
        if not 0 <= max_distance < 64:
            raise ValueError("max_distance lies between 0 and 63")
        self.max_distance = max_distance
        self.groups, self.k = band_groups(max_distance, hashes)
        self.mask = bands(self.groups[-1].stop)
        self.choices = [c for g in self.groups for c in itertools.combinations(g, self.k)]

    def of(self, h: str) -> Column:
        """All keys of a hash, an array."""
        made = [F.xxhash64(F.col(h).bitwiseAND(_long(sum(self.mask[i] for i in c)))) for c in self.choices]
        return F.array(*[x.bitwiseAND(F.lit(~self.LOW).cast("long")).bitwiseOR(_long(j)) for j, x in enumerate(made)])

    def first(self, key: str, a: str, b: str) -> Column:
        """Whether the pair is near and this is the first of the keys that it shares.

        It comes from the first group in which it agrees in k bands, and there from the first k of them, so no distinct is
        needed; this also drops what only shares a hash."""
        x, j = F.col(a).bitwiseXOR(F.col(b)), F.col(key).bitwiseAND(_long(self.LOW)).cast("int")
        agree = F.lit(0).cast("long")
        for i, m in enumerate(self.mask):
            agree = agree.bitwiseOR(F.when(x.bitwiseAND(_long(m)) == 0, _long(1 << i)).otherwise(_long(0)))
        which = F.get(F.array(*[_long(sum(1 << i for i in c)) for c in self.choices]), j)
        upto = F.get(F.array(*[_long((2 << c[-1]) - (1 << g.start)) for g in self.groups for c in itertools.combinations(g, self.k)]), j)
        first, start = agree.bitwiseAND(upto) == which, 0
        for g in self.groups[:-1]:
            start += math.comb(len(g), self.k)
            first = first & ((j < start) | (F.bit_count(agree.bitwiseAND(_long((1 << g.stop) - (1 << g.start)))) < self.k))
        return (hamming(F.col(a), F.col(b)) <= self.max_distance) & first


def near_hashes(hashes: DataFrame, max_distance: int, phash: str = "phash") -> DataFrame:
    """Distinct hashes a < b within max_distance, with distance."""
    one = hashes.where(F.col(phash).isNotNull()).select(F.col(phash).alias("h")).distinct()
    count = one.count()
    keys = Keys(max_distance, count)
    rows = one.repartition(max(1, count * len(keys.choices) // TASK_ROWS), "h").select(F.explode(keys.of("h")).alias("key"), F.col("h").alias("a"))
    # Spark takes rows for as large as before explode, and would broadcast them.
    pairs = rows.hint("merge").join(rows.select("key", F.col("a").alias("b")).hint("merge"), "key")
    return pairs.where((F.col("a") < F.col("b")) & keys.first("key", "a", "b")).select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


def near_groups(hashes: DataFrame, pairs: DataFrame, key: str, phash: str = "phash") -> DataFrame:
    """key, label: the smallest key that is reached over near pairs or equal hashes, however long the chain."""
    return named(hashes, components(pairs.select("a", "b"), lambda df: df.checkpoint()).withColumnsRenamed({"node": "h", "label": "group"}), key, phash)


def named(hashes: DataFrame, group: DataFrame, key: str, phash: str = "phash") -> DataFrame:
    """key, label: the smallest key of each hash's group (h, group; hashes that have none are groups of their own)."""
    least = hashes.where(F.col(phash).isNotNull()).groupBy(F.col(phash).alias("h")).agg(F.min(key).alias("least"))
    grouped = least.join(group, "h", "left").select("h", "least", F.coalesce("group", "h").alias("group"))
    label = grouped.join(grouped.groupBy("group").agg(F.min("least").alias("label")), "group").select("h", "label")
    return hashes.join(label, F.col(phash) == F.col("h")).select(key, "label")
