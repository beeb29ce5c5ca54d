"""Long hashes against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.operators import near_long, similarity


def family(seed, bases=12, copies=9, step=60):
    """Chains of perturbed hashes: neighbours differ in up to ``step`` bits, ends in many more."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(bases):
        bits = r.integers(0, 2, 1024).astype(bool)
        for _ in range(copies):
            bits = bits.copy()
            bits[r.integers(0, 1024, r.integers(0, step))] ^= True
            out.append(np.packbits(bits).view(">i8").tolist())
    return out


def distance(a, b):
    return sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))


def brute_groups(hashes, most):
    label = list(range(len(hashes)))
    for i in range(len(hashes)):
        for j in range(i):
            if distance(hashes[i], hashes[j]) <= most and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return dict(enumerate(label))


def frame(spark, hashes):
    return spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "id long, phash_enh array<bigint>")


@pytest.mark.parametrize("t", [0, 2, 6])
def test_pairs_equal_brute_force(spark, t):
    hashes = family(t)
    want = {(tuple(min(a, b)), tuple(max(a, b))): distance(a, b) for i, a in enumerate(hashes) for b in hashes[:i] if a != b and distance(a, b) <= 16 * t}
    got = near_long.near_long_pairs(frame(spark, hashes), t).collect()
    assert {(tuple(r["a"]), tuple(r["b"])): r["distance"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("g", "k"), [(8, 1), (40, 2), (24, 3)])
def test_groups_of_every_shape_of_keys(spark, monkeypatch, g, k):
    n = 96 + g * (k - 1) + 1
    monkeypatch.setattr(near_long, "band_groups", lambda *a: ([range(n * i // g, n * (i + 1) // g) for i in range(g)], k))
    hashes = [*family(7, 6, 12, 100), [0] * 16, [0] * 15 + [1], [-1] * 16, [-1] * 16]
    got = {r["id"]: r["label"] for r in near_long.near_long_groups(frame(spark, hashes), 6, "id").collect()}
    assert got == brute_groups(hashes, 96)


def test_links_of_a_family_are_few(spark):
    """300 hashes all near each other: stars, not the 44,850 pairs."""
    r = np.random.default_rng(3)
    base = r.integers(-(2**63), 2**63, 16)
    hashes = []
    for _ in range(300):
        flips = np.zeros(16, np.int64)
        for w, b in r.integers(0, [16, 64], (20, 2)):
            flips[w] ^= np.int64(1) << b
        hashes.append((base ^ flips).tolist())
    some = near_long.nodes(frame(spark, hashes), "phash_enh", lambda df: df.checkpoint())
    links, groups = near_long.near_long_links(some, 6)
    groups = groups.collect()
    assert len(groups) == some.count() and len({r["label"] for r in groups}) == 1
    assert links.count() < 20 * 300


def test_odd_long_hashes(spark):
    df = spark.createDataFrame([(1, None, 5), (2, [7] * 16, 5), (3, [7] * 16, 5), (None, [7] * 16, 5)], "id long, phash_enh array<bigint>, node int").withColumn("key", F.lit(1))
    assert sorted(map(tuple, near_long.near_long_groups(df, 6, "id").collect()), key=repr) == [(2, 2), (3, 2), (None, 2)]
    assert near_long.near_long_pairs(df, 6).collect() == [] == near_long.near_long_groups(df.limit(0), 6, "id").collect()
    with pytest.raises(Exception, match="sixteen words"):
        near_long.near_long_groups(df.selectExpr("id", "slice(phash_enh, 1, 3) as phash_enh"), 6, "id").collect()
    with pytest.raises(ValueError, match="between"):
        near_long.near_long_pairs(df, 64)


def test_keys_of_many_hashes_stay_few():
    for n in (10, 10**4, 10**6, 10**8):
        for t, bits in ((6, 64), (96, 1024)):
            groups, k = similarity.band_groups(t, n, bits)
            assert groups[-1].stop == t + len(groups) * (k - 1) + 1 <= bits
            assert sum(len(list(itertools.combinations(x, k))) for x in groups) <= similarity.MOST_KEYS
