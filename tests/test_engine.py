import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.functions import hashing as H
from assetloom.functions.blake3 import blake3, blake3_file
from assetloom.operators import similarity, store
from assetloom.plans.engine import Engine, suffix_plan
from assetloom.sources import decode
from assetloom.sources.catalog import catalog, scanned
from assetloom.streaming.incremental import file_stream, into_store


def png(pixels: np.ndarray, filter_: int = 0) -> bytes:
    h, w, _ = pixels.shape
    rows, above = b"", np.zeros(w * 3, np.uint8)
    for y in range(h):
        line = pixels[y].reshape(-1)
        left = np.concatenate((np.zeros(3, np.uint8), line[:-3]))
        rows += bytes([filter_]) + {0: line, 1: line - left, 2: line - above, 3: line - ((left.astype(int) + above) // 2).astype(np.uint8)}[filter_].tobytes()
        above = line
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return decode.PNG_MARK + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def picture(seed: int, side: int = 8) -> np.ndarray:
    small = np.random.default_rng(seed).integers(0, 256, (8, 8, 3), dtype=np.uint8)
    return np.repeat(np.repeat(small, side // 8, axis=0), side // 8, axis=1)


@pytest.mark.parametrize("filter_", [0, 1, 2, 3])
def test_png(filter_):
    p = picture(3, 24)
    assert (decode.png(png(p, filter_)) == p).all()


def test_hash_does_not_change_with_size():
    assert len({decode.phash(picture(5, s)) for s in (8, 24, 64)}) == 1
    assert decode.phash(picture(5)) != decode.phash(picture(6))


def test_blake3_known_values():
    # Fixed values of the published test vectors (bytes 0..250 repeating).
    data = bytes(i % 251 for i in range(102400))
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(data[:1]).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert len({blake3(data[:n]) for n in (63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 102400)}) == 10
    for n, want in {
        64: "4eed7141ea4a5cd4b788606bd23f46e212af9cacebacdc7d1f4c6dc7f2511b98", 1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
        31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
    }.items():
        assert blake3(data[:n]).hex() == want, n


def test_blake3_in_parts_is_blake3_of_the_whole():
    import io

    data = np.random.default_rng(1).integers(0, 256, 70_000, dtype=np.uint8).tobytes()
    for n in (0, 1, 1024, 2047, 2048, 2049, 4096, 8192, 8193, 16_384, 30_001, 65_536, 65_537, 70_000):
        assert {blake3_file(io.BytesIO(data[:n]), part) for part in (1024, 2048, 8192, 1 << 20)} == {blake3(data[:n])}


def test_a_large_sparse_file_in_bounded_memory(tmp_path):
    """In a process of its own: the digest of a 2 GB file adds less than 200 MB to it."""
    import subprocess
    import sys

    with open(tmp_path / "big", "wb") as f:
        f.truncate(2_000_000_000)
    code = f"import resource as r\nfrom assetloom.functions.blake3 import blake3_file\na = r.getrusage(r.RUSAGE_SELF).ru_maxrss\nblake3_file(open({str(tmp_path / 'big')!r}, 'rb'))\nprint(r.getrusage(r.RUSAGE_SELF).ru_maxrss - a)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert int(out.stdout) < 200_000


@pytest.fixture
def tree(tmp_path):
    for name in ("a.JPG", "b.png", "_c.png", ".d.png", "noext", "e.txt", "zero.png", "sub/f.tif", ".dir/g.jpg", "sub/deep/h.heic", "ex/i.png", "exx/j.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"" if name == "zero.png" else b"DUMMY IMAGE DATA")
    (tmp_path / "link.png").symlink_to(tmp_path / "b.png")
    return tmp_path


def names(df, root):
    return sorted(os.path.relpath(r["path"], root) for r in df.collect())


def test_catalog_rules(spark, tree):
    root = str(tree)
    everything = [".dir/g.jpg", "_c.png", "a.JPG", "b.png", "ex/i.png", "exx/j.png", "sub/deep/h.heic", "sub/f.tif", "zero.png"]
    assert names(catalog(spark, [root]), root) == everything
    assert names(catalog(spark, [root], max_depth=1), root) == ["_c.png", "a.JPG", "b.png", "zero.png"]
    assert names(catalog(spark, [root], max_depth=2), root) == [n for n in everything if n.count("/") < 2]
    assert names(catalog(spark, [root], max_depth=0), root) == []
    assert names(catalog(spark, [root], excluded_directories=[f"{root}/ex"]), root) == [n for n in everything if n != "ex/i.png"]
    assert names(catalog(spark, [root], process_unsupported_formats=True), root) == sorted([*everything, "e.txt"])
    assert names(catalog(spark, [root, f"{root}/sub"]), root).count("sub/f.tif") == 2
    assert names(catalog(spark, [f"{root}/b.png"]), root) == ["b.png"]
    with pytest.raises(FileNotFoundError):
        catalog(spark, [root, f"{root}/none"])
    for options in ({}, {"max_depth": 2}, {"excluded_directories": [f"{root}/ex"]}, {"process_unsupported_formats": True}):  # the data source by the same rules
        assert names(scanned(spark, [root, f"{root}/sub"], **options), root) == names(catalog(spark, [root, f"{root}/sub"], **options), root)


def test_a_deep_tree_is_shared_by_all_tasks(spark, tmp_path):
    from assetloom.sources.catalog import walked

    here, want = tmp_path, []
    for k in range(12):  # one folder a level, each with a wide one beside it
        here = here / f"d{k}"
        for j in range(6):
            (here / f"w{j}").mkdir(parents=True)
            (here / f"w{j}" / f"{k}_{j}.png").write_bytes(b"x")
            want.append(f"{k}_{j}.png")
    (tmp_path / "d0" / os.fsdecode(b"bad\xff")).mkdir()
    (tmp_path / "d0" / os.fsdecode(b"bad\xff") / "deep").mkdir()
    (tmp_path / "d0" / os.fsdecode(b"bad\xff") / "deep" / "z.png").write_bytes(b"x")
    for budget in (4, 20_000):
        got = walked(spark, [str(tmp_path)], budget=budget, tasks=6)
        assert sorted(os.path.basename(r["path"]) for r in got.collect()) == sorted([*want, "z.png"])
        spread = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(spread) == 6 and max(r["count"] for r in spread) <= 40  # files are looked at by all tasks


def test_engine_from_files_to_plan(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    for name, data in {"a.png": png(picture(1)), "copy.png": png(picture(1)), "big.png": png(picture(1, 64)), "other.png": png(picture(2)), "zero.png": b"", "bad.png": b"not a picture", "raw.cr2": b"abc", "x.jpg": b"junk"}.items():
        (files / name).write_bytes(data)
    engine = Engine(spark, str(tmp_path / "store"), Config(max_distance=3))
    assets = engine.discover([str(files)])
    version, rejects = engine.hash_and_persist(assets)
    assert version == 1
    assert {os.path.basename(r["path"]): r["stage"] for r in rejects.collect()} == {"zero.png": "validate", "bad.png": "phash", "raw.cr2": "phash"}
    kept = {os.path.basename(r["path"]): r for r in engine.store.read().collect()}
    assert set(kept) == {"a.png", "copy.png", "big.png", "other.png", "x.jpg"}
    assert kept["a.png"]["phash"] == kept["big.png"]["phash"] and kept["a.png"]["digest"] != kept["big.png"]["digest"]
    assert kept["x.jpg"]["phash_is_fallback"]
    plan = engine.duplicates(assets).collect()
    assert [(os.path.basename(r["original_path"]), os.path.basename(r["duplicate_path"]), r["action_type"], r["dry_run"]) for r in plan] == [("a.png", "copy.png", "move", True)]
    groups = {os.path.basename(r["path"]): os.path.basename(r["label"]) for r in engine.near_duplicates().collect()}
    assert groups == {"a.png": "a.png", "copy.png": "a.png", "big.png": "a.png", "other.png": "other.png"}
    assert store.new_assets(assets, engine.store.read()).count() == 3  # the rejects


def test_recovery_from_leading_junk():
    def jpeg(data: bytes) -> np.ndarray:
        if not data.startswith(b"\xff\xd8ok"):
            raise ValueError("broken")
        return picture(4)

    assert (decode.recovered(b"junk\xff\xd8no\xff\xd8ok", jpeg) == picture(4)).all()
    assert decode.recovered(b"junk", jpeg) is None


def hang(data: bytes) -> np.ndarray:
    """Blocks in C, where no Python signal handler runs."""
    if data.startswith(b"hang"):
        import ctypes

        ctypes.PyDLL(None).sleep(60)
    if data.startswith(b"crash"):
        os.kill(os.getpid(), 9)
    return picture(1)


def test_a_decoder_that_hangs_or_dies_costs_its_own_file(spark, tmp_path):
    import time

    rows = []
    for name, data in {"a": b"fine", "b": b"hang", "c": b"crash", "d": b"fine too", "e": b""}.items():
        (tmp_path / f"{name}.heic").write_bytes(data)
        rows.append(str(tmp_path / f"{name}.heic"))
    guard, began = decode.Guard(decode.work({"heic": hang}, blake3_file)), time.time()
    got = [decode.hash_file(p, "heic", {"heic"}, guard, (5, 1), False) for p in rows]
    guard.end()
    assert time.time() - began < 20
    assert [(r[6], r[7]) for r in got] == [(None, None), ("phash", "TimedOutError"), ("phash", "DecoderDiedError"), (None, None), ("validate", "ValueError")]
    assert got[0][1] == blake3(b"fine") and got[1][1] == blake3(b"hang") and got[3][2] == decode.phash(picture(1))
    frame = spark.createDataFrame([(p, "heic") for p in rows if "b.heic" not in p], "path string, format string").coalesce(1)
    found = {os.path.basename(r["path"]): r["error_class"] for r in decode.hashed(frame, {"heic": hang}).collect()}
    assert found == {"a.heic": None, "c.heic": "DecoderDiedError", "d.heic": None, "e.heic": "ValueError"}


def test_store(spark, tmp_path):
    s = store.HashStore(spark, str(tmp_path / "s"), ranges=4)
    row = lambda p, d, h=None, e=None: (p, bytearray(d), h, e, False, None)
    frame = lambda *rows: spark.createDataFrame(rows, store.SCHEMA)
    assert s.read().count() == 0
    s.upsert(frame(row("a", b"1", 1), row("b", b"2", -1)))
    s.upsert(frame(row("b", b"3", 5), row("c", b"4", None, list(range(16)))))
    assert {r["path"]: bytes(r["digest"]) for r in s.read().collect()} == {"a": b"1", "b": b"3", "c": b"4"}
    assert s.upsert(frame()) == 3 and s.compact(1) == 4 and s.read().count() == 3
    assert {r["key"]: len(r["value"]) for r in store.key_value_view(s.read()).collect() if r["key"].startswith("pp:")} == {"pp:a": 8, "pp:b": 8, "pp:c": 128}
    s.drop_old(1)
    assert s.read().count() == 3
    s.reinitialise()
    assert s.version() == 0


def test_hash_columns(spark):
    words = list(range(-8, 8))
    df = spark.createDataFrame([(1, -1, words, [w ^ 1 for w in words])], "a long, b long, x array<long>, y array<long>")
    row = df.select(H.hamming(F.col("a"), F.col("b")).alias("d"), H.hamming_words(F.col("x"), F.col("y")).alias("w"), H.similar_words(F.col("x"), F.col("y"), 1).alias("s"), H.hamming_mixed(F.col("b"), F.col("x")).alias("m"), H.from_bytes(H.words_to_bytes(F.col("x")), 3).alias("c"), H.is_flat(F.col("b")).alias("f")).first()
    assert tuple(row) == (63, 16, True, bin(-8 ^ -1).count("1"), -5, True)


def test_bands_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 40)
    hashes = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (6, 2))})
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "id long, phash long")
    for t in (0, 3, 6):
        want = {(a, b) for a in hashes for b in hashes if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= t}
        got = similarity.near_hashes(df, t).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_near_hashes_broadcast_no_keys(spark):
    df = spark.range(3000).select((F.xxhash64("id").bitwiseAND(F.lit(-8)) + F.col("id") % 3).alias("phash"))
    got = similarity.near_hashes(df, 6)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # Spark takes exploded keys for as small as the hashes
    assert "ReusedExchange" in plan  # and would make them twice


def test_every_choice_of_bands_finds_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 60)
    hashes = sorted({int(b) ^ int(np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, n))) for b in base for n in range(1, 9)})
    df = spark.createDataFrame([(h,) for h in hashes], "phash long")
    real, shapes = similarity.band_groups, set()
    for t, of in ((6, 1), (6, 30_000), (6, 3_000_000), (10, 30_000)):
        groups, k = real(t, of)
        shapes.add((len(groups), k))
        monkeypatch.setattr(similarity, "band_groups", lambda *a, found=(groups, k): found)
        want = {(a, b) for a in hashes for b in hashes if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= t}
        got = similarity.near_hashes(df, t).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert len(shapes) == 4


def test_groups_of_long_chains(spark):
    ring = [((1 << i) - 1) if i <= 64 else (2**64 - 1) ^ ((1 << (i - 64)) - 1) for i in range(120)]  # each a bit from the next
    rows = [(i, h - 2**64 if h >= 2**63 else h) for i, h in enumerate(ring)]
    df = spark.createDataFrame([*rows, (500, rows[119][1]), (501, None)], "id long, phash long")
    got = similarity.near_groups(df, similarity.near_hashes(df, 1), "id").collect()
    assert sorted(map(tuple, got)) == [*((i, 0) for i in range(120)), (500, 0)]
    df = spark.range(900).selectExpr("id", "id * 7 as phash")
    pairs = spark.range(899).where("id <> 399").selectExpr("id * 7 as a", "id * 7 + 7 as b")
    got = similarity.near_groups(df, pairs, "id").collect()
    assert sorted(map(tuple, got)) == [(i, 0 if i < 400 else 400) for i in range(900)]


def test_suffix_plan_blocks_taken_names(spark):
    head = bytes.fromhex("89504E470D0A1A0A") + bytes(8)
    df = spark.createDataFrame([("/p/a.jpg", head), ("/p/a.png", head), ("/p/b.jpg", head), ("/p/c.jpg", b"?"), ("/p/d.doc", head)], "path string, content binary")
    got = {r["old_path"]: (r["status"], r["new_path"], r["blocked"]) for r in suffix_plan(df).collect()}
    assert got == {"/p/a.jpg": ("mismatch", "/p/a.png", True), "/p/a.png": ("ok", None, False), "/p/b.jpg": ("mismatch", "/p/b.png", False), "/p/c.jpg": ("unknown", None, False)}


def test_config(tmp_path):
    c = Config(max_distance=4, preferred_formats=("png",))
    c.save_to_file(str(tmp_path / "c.json"))
    assert Config.from_file(str(tmp_path / "c.json")) == c
    assert Config(similarity_pct=90).distance() == 6 and Config(similarity_pct=90).distance(1024) == 102
    with pytest.raises(ValueError):
        Config(prioritization=("nonsense",))


def test_stream_sees_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    s = store.HashStore(spark, str(tmp_path / "s"))
    for k in range(2):
        (folder / f"{k}.bin").write_bytes(bytes([k]))
        into_store(file_stream(spark, str(folder)), s, str(tmp_path / "ck")).awaitTermination()
    assert s.read().count() == 2


def test_jpeg_and_tiff_by_the_jvm(spark, tmp_path):
    """The ladder of one picture as JPEG in several qualities and sizes, as TIFF and PNG, against another picture."""
    files = tmp_path / "files"
    files.mkdir()
    rng = np.random.default_rng(8)
    jvm = spark._jvm

    def save(pixels: np.ndarray, name: str, kind: str, quality: float | None = None) -> None:
        h, w, _ = pixels.shape
        image = jvm.java.awt.image.BufferedImage(w, h, 1)
        raster = spark.sparkContext._gateway.new_array(jvm.int, w * h)
        for i, (r, g, b) in enumerate(pixels.reshape(-1, 3).tolist()):
            raster[i] = r << 16 | g << 8 | b
        image.setRGB(0, 0, w, h, raster, 0, w)
        writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
        param = writer.getDefaultWriteParam()
        if quality:
            param.setCompressionMode(2)
            param.setCompressionQuality(quality)
        stream = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(files / name)))
        writer.setOutput(stream)
        writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
        stream.close()

    small = rng.integers(0, 256, (8, 8, 3), dtype=np.uint8)
    scaled = lambda k: np.repeat(np.repeat(small, k, axis=0), k, axis=1)
    for q in (0.9, 0.5, 0.2):
        save(scaled(8), f"q{int(q * 100)}.jpg", "jpeg", q)
    save(scaled(5), "small.JPEG", "jpeg", 0.9)
    save(scaled(8), "t.tif", "tiff")
    save(scaled(8)[:, ::-1], "turned.jpg", "jpeg", 0.9)
    (files / "a b+c%41.png").write_bytes(png(scaled(8)))
    (files / "junk.jpg").write_bytes(b"\xff\xd8 no picture")
    real = (files / "q90.jpg").read_bytes()
    (files / "late.jpg").write_bytes(b"junk\xff\xd8" * 20 + b"\xff\xd8\xff and more" + real)  # the picture is behind 21 false marks
    (files / "_c.jpg").write_bytes(real)
    (files / ".dir").mkdir()
    (files / ".dir" / "t2.tif").write_bytes((files / "t.tif").read_bytes())
    (files / "_bad.jpg").write_bytes(b"nothing")
    engine = Engine(spark, str(tmp_path / "store"), Config(max_distance=8))
    assets = engine.discover([str(files)])
    _, rejects = engine.hash_and_persist(assets, enhanced=True)
    assert rejects.count() == 0
    kept = {os.path.basename(r["path"]): r for r in engine.store.read().collect()}
    assert len(kept) == 12 and sorted(n for n, r in kept.items() if r["phash_is_fallback"]) == ["_bad.jpg", "junk.jpg"]
    for copy, of in (("late.jpg", "q90.jpg"), ("_c.jpg", "q90.jpg"), ("t2.tif", "t.tif")):
        assert [kept[copy][c] for c in ("phash", "phash_enh", "pixels")] == [kept[of][c] for c in ("phash", "phash_enh", "pixels")] and kept[copy]["digest"]
    kept = {n: r for n, r in kept.items() if n not in ("late.jpg", "_c.jpg", "t2.tif", "_bad.jpg")}
    exact = kept["a b+c%41.png"]
    assert kept["t.tif"]["phash"] == exact["phash"] == decode.phash(scaled(8)) and kept["t.tif"]["phash_enh"] == exact["phash_enh"] == decode.phash_words(scaled(8))
    distance = lambda n: bin((kept[n]["phash"] ^ exact["phash"]) & (2**64 - 1)).count("1")
    assert distance("q90.jpg") <= distance("q50.jpg") + 2 and max(distance(n) for n in ("q90.jpg", "q50.jpg", "q20.jpg", "small.JPEG")) <= 8 < distance("turned.jpg")
    assert {n: r["pixels"] for n, r in kept.items()} == {"q90.jpg": 4096, "q50.jpg": 4096, "q20.jpg": 4096, "small.JPEG": 1600, "t.tif": 4096, "turned.jpg": 4096, "a b+c%41.png": 4096, "junk.jpg": None}
    groups = {os.path.basename(r["path"]): r["label"] for r in engine.near_duplicates().collect()}
    assert len({groups[n] for n in ("q90.jpg", "q50.jpg", "t.tif", "small.JPEG", "a b+c%41.png")}) == 1 and groups["turned.jpg"] != groups["t.tif"]


def test_fast_hash_steps_by_whole_pixels(spark):
    for w, h in ((8, 8), (20, 9), (5, 3), (33, 17)):
        px = list(range(w * h))
        got = spark.createDataFrame([(px, w, h)], "px array<int>, w int, h int").select(H.sampled(F.col("px"), F.col("w"), F.col("h")).alias("s")).first()["s"]
        assert got == [min(y * (max(h, 8) // 8), h - 1) * w + min(x * (max(w, 8) // 8), w - 1) for y in range(8) for x in range(8)]


def test_image_names(spark):
    names = {"IMG-1_original.JPG": ("IMG-1", "original", None, "jpg"), "IMG_original": None, "a_resize_800x600_1.png": ("a", "resize", "800x600", "png"), "a_crop_9.jpg": ("a", "crop", None, "jpg"), "a_b.jpg": None, "x.jpg": None}
    from assetloom.functions import paths

    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", paths.image_name(F.col("n")).alias("i"))
    assert {r["n"]: r["i"] and tuple(r["i"]) for r in df.collect()} == names


def test_two_writers(spark, tmp_path):
    s, other = (store.HashStore(spark, str(tmp_path / "s"), ranges=4) for _ in range(2))
    frame = lambda *rows: spark.createDataFrame([(p, bytearray(d), h, None, False, None) for p, d, h in rows], store.SCHEMA)
    s.upsert(frame(*((f"p{i}", b"1", i) for i in range(40))))
    changed = s._changed

    def late(batch, ranges, replacing):
        if s.version() == 1:  # another writer is first
            other.upsert(frame(("p1", b"other", 100), ("q", b"other", 101)))
        return changed(batch, ranges, replacing)

    s._changed = late
    assert s.upsert(frame(("p1", b"9", 9), ("p2", b"9", 9), ("p1", b"last", 1))) == 3
    got = {r["path"]: bytes(r["digest"]) for r in s.read().collect()}
    assert len(got) == 41 and got["p1"] == b"last" and got["p2"] == b"9" and got["q"] == b"other"
    assert s.read(2).where("path = 'p1'").first()["phash"] == 100  # readers of an older version keep it
    before = s.ranges(3)
    s.upsert(frame(("p5", b"x", 0)))
    after = s.ranges(4)
    assert len(before) == len(after) == 4 and sum(a != b for a, b in zip(before, after, strict=True)) == 1  # only the range that the batch touches
    s.drop_old(1)
    assert s.read().count() == 41 and s.version() == 4


def test_keeper_rules_need_their_columns(spark):
    from assetloom.operators import dedup

    df = spark.createDataFrame([("/a/1", "d", 5, 10), ("/b/2", "d", 9, None), ("/b/3", "d", 9, 10)], "path string, digest string, size int, pixels int")
    with pytest.raises(ValueError):
        dedup.keepers(df, "path", {"size": "size"})
    keeper = lambda **c: dedup.keepers(df, "path", {"size": "size", "pixels": "pixels"}, Config(**c)).first()["keeper"]
    assert keeper(prioritization=("highest_resolution", "largest_file_size")) == "/b/3"
    assert keeper(prioritization=("smallest_file_size",)) == "/a/1"
    assert keeper(prioritization=("preferred_directory", "smallest_file_size"), preferred_directories=("/b",)) == "/b/2"


def test_actions_and_their_results(spark):
    from assetloom.operators import dedup

    df = spark.createDataFrame([("/a/1", "d"), ("/b/1", "d"), ("/c/1", "d"), ("/d/2", "d"), ("/e/9", "f"), ("/f/9", "f")], "path string, digest string")
    for config, kind in ((Config(delete_duplicates=True, create_symlinks=True, prioritization=()), "delete"), (Config(create_symlinks=True, prioritization=()), "symlink"), (Config(prioritization=()), "move")):
        plan = dedup.action_plan(df, dedup.keepers(df, "path", {}, config), "path", config)
        assert {r["action_type"] for r in plan.collect()} == {kind}
        got = {r["duplicate_path"]: (r["success"], r["error"]) for r in dedup.action_results(plan, df.where("path not in ('/d/2', '/e/9')")).collect()}
        same = (False, "target exists") if kind == "move" else (True, None)
        assert got == {"/b/1": (True, None), "/c/1": same, "/d/2": (False, "duplicate not found"), "/f/9": (False, "original not found")}


def test_force_rescan_and_missing_files(spark, tmp_path):
    f = tmp_path / "a.png"
    f.write_bytes(png(picture(1)))
    assets = catalog(spark, [str(tmp_path)]).cache()
    engine = Engine(spark, str(tmp_path / "s"), Config(force_rescan=True))
    assert engine.hash_and_persist(assets)[0] == 1 and engine.hash_and_persist(assets)[0] == 2
    assert store.new_assets(assets, engine.store.read(), force_rescan=True).count() == 1 and store.new_assets(assets, engine.store.read()).count() == 0
    assert decode.hash_file(str(tmp_path / "none.png"), "png", {"png"}, None, (5, 5), False)[6] == "validate"


def test_first_seen_within_the_watermark(spark, tmp_path):
    from assetloom.streaming.incremental import first_seen

    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(([("a", 0), ("a", 60), ("b", 0)], [("a", 30), ("c", 10)])):
        spark.createDataFrame(rows, "path string, s int").selectExpr("path", "timestamp_seconds(1000000 + s) as ts").coalesce(1).write.parquet(str(folder / f"k{k}"))
    stream = first_seen(spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder) + "/*"))
    stream.writeStream.format("memory").queryName("first_seen_rows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["path"] for r in spark.sql("select path from first_seen_rows").collect()) == ["a", "b", "c"]


def test_skip_list_and_cache(spark, tmp_path):
    for n in ("a.png", "b.png"):
        (tmp_path / n).write_bytes(png(picture(1)))
    engine = Engine(spark, str(tmp_path / "s"), Config(log_level="debug"))
    late = spark.createDataFrame([(str(tmp_path / "a.png"), "phash", "TimedOutError", "x"), (str(tmp_path / "b.png"), "phash", "ValueError", "x")], "path string, stage string, error_class string, error_message string")
    engine.skipped.add(late)
    engine.skipped.add(late)
    assert [os.path.basename(r["path"]) for r in engine.skipped.read().collect()] == ["a.png"]
    engine.hash_and_persist(engine.discover([str(tmp_path)]))
    assert [os.path.basename(r["path"]) for r in engine.store.read().collect()] == ["b.png"]
    assert [r["key"][:3] for r in store.in_key_order(store.key_value_view(engine.store.read())).collect()] == ["pc:", "pp:"]
    cache, asked = decode.HashCache(2), []
    for p in ("x", "x", "y", "z", "x"):
        assert cache.get(p, lambda q: asked.append(q) or q.upper()) == p.upper()
    assert asked == ["x", "y", "z", "x"]


def test_shrinking_large_pictures():
    small = np.random.default_rng(2).integers(0, 256, (8, 8, 3), dtype=np.uint8)
    big = np.repeat(np.repeat(small, 150, axis=0), 260, axis=1)  # 1200 x 2080
    assert decode.shrunk(big, 1024, "lanczos3").shape == (591, 1024, 3) and decode.shrunk(big.transpose(1, 0, 2), 768, "nearest").shape == (768, 443, 3)
    assert decode.shrunk(small, 768, "nearest") is small
    for size in (1, 200_000_000, 400_000_000):
        assert decode.phash_large(big, size) == decode.phash(small)
    assert decode.phash_enhanced(big, "png") == decode.phash_words(small) and decode.phash_enhanced(big, "tiff") == decode.phash(small)
    flat = np.full((1100, 30, 3), 77, np.uint8)
    for kind in ("triangle", "lanczos3"):
        assert (decode.resized(flat, 20, 700, kind) == 77).all()


def test_components_of_hubs_chains_and_rings(spark, tmp_path):
    """A hub of 100,000 members gathers in no task; all shapes give the smallest member."""
    from assetloom.operators.components import components

    hub = spark.range(1, 100_001).selectExpr("0L as a", "id as b")
    chain = spark.range(300_000, 300_060).selectExpr("id + 1 as a", "id as b")
    down = spark.range(400_000, 400_500).selectExpr("999999L as a", "id as b")  # the hub is the largest
    ring = spark.range(500_000, 500_021).selectExpr("id as a", "500000 + (id - 500000 + 8) % 21 as b")
    own = spark.createDataFrame([(7, 7), (100_001, 100_001)], "a long, b long")
    links = hub.union(chain).union(down).union(ring).union(own).union(hub.limit(50))
    shuffles = []

    def kept(df):
        df = df.checkpoint()
        shuffles.append(max((r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()), default=0))
        return df

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    for most in (10**6, 0):
        got = components(links, kept, broadcast_rows=most)
        sizes = {r["label"]: r["n"] for r in got.groupBy("label").agg(F.count_distinct("node").alias("n"), F.count("*").alias("m")).where("n = m").collect()}
        assert sizes == {0: 100_001, 300_000: 61, 400_000: 501, 500_000: 21} and max(shuffles) < 60_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_progress_while_a_run_goes_on(spark, tmp_path):
    import time

    files = tmp_path / "files"
    files.mkdir()
    for i in range(30):
        (files / f"{i}.heic").write_bytes(b"bad" if i % 5 == 0 else b"good")

    def slow(data: bytes) -> np.ndarray:
        time.sleep(0.1)
        if data == b"bad":
            raise ValueError("bad")
        return picture(1)

    told = []
    engine = Engine(spark, str(tmp_path / "s"))
    _, rejects = engine.hash_and_persist(engine.discover([str(files)]), decoders={"heic": slow}, tell=told.append)
    last = told[-1]
    assert (last.total, last.ok, last.errors, last.eta) == (30, 24, 6, 0) and rejects.count() == 6
    assert last.tasks_done == last.tasks >= 8 and last.rate > 1 and last.text().endswith("| 24 ok | 6 errors | ETA: 0s")
    early = [s for s in told[:-1] if s.ok + s.errors < 30]
    assert early and all(s.eta > 0 for s in early) and [s.ok for s in told] == sorted(s.ok for s in told)
    from assetloom.plans.progress import State

    assert State(100, 0, 0, 5.0, 1, 0).eta == 4 and State(200, 0, 0, 0.0, 0, 0).text() == "0.0 img/s | 0 ok | 0 errors | ETA: 8s"
    assert State(10_000, 1, 0, 2.0, 0, 0).text().endswith("ETA: 5h 33m") and State(700, 50, 50, 100.0, 0, 0).text().endswith("ETA: 10m 0s")


def test_one_fallback_hash(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"junk")
    os.utime(tmp_path / "x.jpg", (1_700_000_000, 1_700_000_000))
    row = spark.sql("select 'x.jpg' as n, 4L as s, timestamp_seconds(1700000000) as t").select(H.fallback(F.col("n"), F.col("s"), F.col("t")).alias("h")).first()
    assert row["h"] == decode.fallback(str(tmp_path / "x.jpg"), 4, 1_700_000_000.7) == 4237383503060961922


def test_large_pictures_are_shrunk_before_they_are_hashed(tmp_path):
    rng = np.random.default_rng(5)
    big = np.repeat(np.repeat(rng.integers(0, 256, (37, 61, 3), dtype=np.uint8), 30, axis=0), 30, axis=1)  # 1110 x 1830
    (tmp_path / "big").write_bytes(b"x")
    for shrink in (False, True):
        got = decode.work({"png": lambda d: big, "tiff": lambda d: big}, blake3_file, shrink)("picture", str(tmp_path / "big"), "png", True)
        assert got == (decode.phash_large(big, 1) if shrink else decode.phash(big), decode.phash_enhanced(big, "png"), 1110 * 1830)
        assert decode.work({"tiff": lambda d: big}, blake3_file, shrink)("picture", str(tmp_path / "big"), "tiff", True)[1] is None


def test_a_key_that_comes_again_after_the_watermark(spark, tmp_path):
    from assetloom.streaming.incremental import first_seen_for

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def put(name, rows):
        spark.createDataFrame(rows, "path string, s long, n int").selectExpr("path", "timestamp_seconds(s) as ts", "n").coalesce(1).write.parquet(str(folder / name))

    def run():
        stream = first_seen_for(spark.readStream.schema("path string, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(str(folder) + "/*"))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    put("k0", [("a", 1000, 1), ("a", 900, 2), ("b", 1000, None), (None, 5, 1)])
    put("k1", [("z", 9_000_000, 1), ("b", 1001, 3)])  # far beyond any watermark
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    run()
    put("k2", [("a", 1000, 9), ("a", 99_000_000, 9), ("c", 7, 4), (None, 6, 2)])  # again, after a restart
    run()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted((tuple(r) for r in spark.read.parquet(str(out)).select("path", "n").collect()), key=repr)
    assert got == sorted([("a", 2), ("b", None), ("c", 4), ("z", 1), (None, 1)], key=repr)
