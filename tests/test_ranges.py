"""Ranges that split, joins against few of them, and the index of near hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.operators import ranges, similarity, store
from assetloom.operators.near_index import NearIndex
from assetloom.plans.engine import Engine
from tests.test_engine import picture, png


def frame(spark, ids, tag=b"1"):
    return spark.createDataFrame([(f"p{i}", bytearray(tag), i, None, False, None) for i in ids], store.SCHEMA)


def test_a_range_splits_as_it_grows_beside_another_writer(spark, tmp_path):
    s, other = (store.HashStore(spark, str(tmp_path / "s"), most_rows=16) for _ in range(2))
    assert len(s.ranges()) == 1
    s.upsert(frame(spark, range(10)))
    assert len(s.ranges()) == 1
    changed = s._changed

    def late(batch, found, replacing):
        if s.version() == 1:
            other.upsert(frame(spark, range(300, 330), b"other"))  # splits, and is first
        return changed(batch, found, replacing)

    s._changed = late
    s.upsert(frame(spark, range(5, 60), b"2"))
    for k in range(60, 700, 160):
        s.upsert(frame(spark, range(k, k + 160), b"3"))
    found = s.ranges()
    assert len(found) >= 64
    assert sum(2.0**-r.depth for r in found) == 1 and len({(r.depth, r.value) for r in found}) == len(found)  # they part all keys
    assert all(r.rows == s._load([r]).count() <= 2 * 16 for r in found if r.rows) and sum(r.rows for r in found) == 700
    assert {r["path"]: bytes(r["digest"]) for r in s.read().collect()} == {f"p{i}": b"1" if i < 5 else b"2" if i < 60 else b"3" for i in range(700)}
    assert s.read(1).count() == 10  # readers of the first version keep it
    s.drop_old(1)
    assert s.read().count() == 700 and s.compact(2) and s.read().count() == 700


def test_rows_that_are_only_added(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "MOST_FOLDERS", 3)
    schema = "key long, h long"
    t = ranges.RangedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, "key", most_rows=50)
    for k in range(6):
        t.put(spark.range(k * 15, k * 15 + 15).selectExpr("id % 20 as key", "id as h"), replace=False)
        assert max(len(r.folders) for r in t.ranges()) <= 4
    assert sorted(r["h"] for r in t.read().collect()) == list(range(90)) and len(t.ranges()) >= 2
    assert sum(r.rows for r in t.ranges()) == 90
    same = spark.createDataFrame([(None, 1)] * 60 + [(7, 2)] * 60, schema)  # a hot key can't be split
    t.put(same, replace=False)
    assert t.read().count() == 210 and t.holding(same.where("key is null")).where("key is null").count() == 60


def test_new_assets_without_an_exchange_of_the_store(spark, tmp_path):
    s = store.HashStore(spark, str(tmp_path / "s"), most_rows=20)
    s.upsert(frame(spark, range(400)))
    s.upsert(spark.createDataFrame([("none", None, 5, None, False, None)], store.SCHEMA))
    few = spark.createDataFrame([("p3",), ("none",), ("q1",), ("q1",), (None,)], "path string")
    assert sorted(map(str, (r["path"] for r in s.new_assets(few).collect()))) == ["None", "none", "q1", "q1"]
    known = s.known(few)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
    known.collect()
    final = known._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    store_side = final[: final.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in store_side  # the streamed side comes first
    assert len({f.split("/range=")[0] + f.split("/range=")[1].split("/")[0] for f in known.inputFiles()}) <= 5 < len(s.ranges())
    wide = spark.range(380, 420).select(F.format_string("p%d", "id").alias("path"))
    for most in (0, 10**6):
        assert sorted(r["path"] for r in s.new_assets(wide, broadcast_rows=most).collect()) == [f"p{i}" for i in range(400, 420)]
    assert s.new_assets(wide.limit(0)).count() == 0 and s.new_assets(wide, force_rescan=True).count() == 40
    assert store.HashStore(spark, str(tmp_path / "none")).new_assets(wide).count() == 40


def hashes(seed, bases=25):
    r = np.random.default_rng(seed)
    out = []
    for b in r.integers(-(2**63), 2**63, bases):
        for _ in range(int(r.integers(1, 12))):  # chains
            b ^= np.bitwise_or.reduce(np.int64(1) << r.integers(0, 63, int(r.integers(0, 4))), initial=np.int64(0))
            out.append(int(b))
    return out


@pytest.mark.parametrize("few", [0, 10**6])
def test_index_in_batches_gives_the_groups_of_a_full_run(spark, tmp_path, few):
    found = hashes(3)
    order = np.random.default_rng(1).permutation(len(found))
    df = spark.createDataFrame([(i, h) for i, h in enumerate(found)] + [(1000, None), (1001, found[0])], "id long, phash long").cache()
    want = sorted(map(tuple, similarity.near_groups(df, similarity.near_hashes(df, 3), "id").collect()))
    index = NearIndex(spark, str(tmp_path / "i"), 3, expected=1000, most_rows=40, broadcast_rows=few)
    for part in np.array_split(order, 3):
        some = spark.createDataFrame([(found[i],) for i in part.tolist()] + [(None,)], "phash long")
        assert index.add(some) == len({found[i] for i in part.tolist()} - {found[i] for i in order[: list(order).index(part[0])].tolist()})
        assert index.add(some) == 0
    assert sorted(map(tuple, index.near_groups(df, "id").collect())) == want
    assert index.keys.read().count() == len(set(found)) * len(index.plan.choices)
    again = NearIndex(spark, str(tmp_path / "i"), 3)  # another session: the noted plan counts
    assert again.plan.choices == index.plan.choices and sorted(map(tuple, again.near_groups(df, "id").collect())) == want
    with pytest.raises(ValueError, match="distance 3"):
        NearIndex(spark, str(tmp_path / "i"), 4)


def test_a_small_batch_reads_few_ranges(spark, tmp_path, monkeypatch):
    index = NearIndex(spark, str(tmp_path / "i"), 2, expected=1000, most_rows=30)
    index.add(spark.createDataFrame([(h,) for h in hashes(5)], "phash long"))
    read = []
    real = index.keys._load
    monkeypatch.setattr(index.keys, "_load", lambda some: read.append(len(some)) or real(some))
    index.add(spark.createDataFrame([(12345,)], "phash long"))
    assert max(read) <= len(index.plan.choices) < len(index.keys.ranges())


def test_a_batch_that_ended_between_its_tables_is_added_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes(9, 6))], "id long, phash long")
    index = NearIndex(spark, str(tmp_path / "i"), 3, expected=1000)
    index.add(df.where("id % 2 = 0"))
    put = index.groups.put
    monkeypatch.setattr(index.groups, "put", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        index.add(df)
    monkeypatch.setattr(index.groups, "put", put)
    index.add(df)
    want = sorted(map(tuple, similarity.near_groups(df, similarity.near_hashes(df, 3), "id").collect()))
    assert sorted(map(tuple, index.near_groups(df, "id").collect())) == want


def test_engine_keeps_the_index(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    engine = Engine(spark, str(tmp_path / "store"), Config(max_distance=3))
    groups = lambda: {r["path"].rsplit("/")[-1]: r["label"].rsplit("/")[-1] for r in engine.near_duplicates().collect()}
    (files / "a.png").write_bytes(png(picture(1)))
    engine.hash_and_persist(engine.discover([str(files)]))
    (files / "b.png").write_bytes(png(picture(1, 64)))
    (files / "c.png").write_bytes(png(picture(2)))
    engine.hash_and_persist(engine.discover([str(files)]), enhanced=True)
    assert groups() == {"a.png": "a.png", "b.png": "a.png", "c.png": "c.png"}
    assert {r["path"].rsplit("/")[-1] for r in engine.near_long_duplicates().collect()} == {"b.png", "c.png"}
    (files / "c.png").write_bytes(png(picture(1, 8)))
    again = Engine(spark, str(tmp_path / "store"), Config(max_distance=3, force_rescan=True))
    again.hash_and_persist(again.discover([str(files)]))
    assert groups() == {"a.png": "a.png", "b.png": "a.png", "c.png": "a.png"}
