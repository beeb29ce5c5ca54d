"""Queries of the engine's own operators on the driver's tables, and the same in SQL for DuckDB.

The tables hold no pictures, so roles are bound to them: documents are assets with content, pages are paths and bytes,
embeddings are 8 x 8 pixel grids (sixteen in a row make a 32 x 32 one), labels stand for what is stored, events for logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.functions import hashing as H
from assetloom.functions import magic as M
from assetloom.functions import paths as P
from assetloom.functions import records as R
from assetloom.operators import dedup, near_long, similarity, store
from assetloom.operators.near_index import NearIndex
from assetloom.sources.folders import shared_dir

LARGEST = Config(prioritization=("largest_file_size",))
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _assets(spark: SparkSession, d: str) -> DataFrame:
    """documents as assets."""
    size = F.octet_length("text").cast("long")
    return _t(spark, d, "documents").select("doc_id", "source", "lang", H.digest(F.col("text")).alias("digest"), size.alias("size"))


# ---- exact duplicates, keepers, actions ----


@_query("SELECT digest, doc_id, n FROM (SELECT sha256(text) AS digest, doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def q_exact_groups(spark, d):
    return dedup.exact_groups(_assets(spark, d)).select("digest", "doc_id", "n")


@_query("SELECT first, doc_id AS other FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE first <> doc_id")
def q_exact_pairs(spark, d):
    return dedup.representative_pairs(_assets(spark, d), "doc_id")


_KEEPER = "SELECT sha256(text) AS digest, doc_id, octet_length(encode(text))::BIGINT AS size, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY octet_length(encode(text)) DESC, doc_id) AS rn FROM documents"


@_query(f"SELECT digest, doc_id AS keeper, n FROM ({_KEEPER}) WHERE n > 1 AND rn = 1")
def q_keeper(spark, d):
    return dedup.keepers(_assets(spark, d), "doc_id", {"size": "size"}, LARGEST)


_DEFAULT = "SELECT sha256(text) AS digest, doc_id, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 END DESC NULLS LAST, octet_length(encode(text)) DESC, CASE WHEN doc_id % 7 > 0 THEN doc_id % 2 END NULLS LAST, doc_id) AS rn FROM documents"


@_query(f"SELECT digest, doc_id AS keeper, n FROM ({_DEFAULT}) WHERE n > 1 AND rn = 1")
def q_keeper_default(spark, d):
    """The default order: resolution, size, age; some rows know neither resolution nor age."""
    rows = _assets(spark, d).withColumns({"pixels": F.expr("case when doc_id % 3 > 0 then doc_id % 5 end"), "created": F.expr("case when doc_id % 7 > 0 then doc_id % 2 end")})
    return dedup.keepers(rows, "doc_id", {"size": "size", "pixels": "pixels", "created": "created"})


@_query(
    f"WITH k AS ({_KEEPER}), p AS (SELECT a.doc_id AS original_path, b.doc_id AS duplicate_path FROM k b JOIN k a ON a.digest = b.digest AND a.rn = 1 WHERE b.rn > 1), h AS (SELECT doc_id FROM documents WHERE doc_id % 4 > 0) "
    "SELECT 'delete' AS action_type, duplicate_path, original_path, error IS NULL AS success, error FROM (SELECT *, CASE WHEN original_path NOT IN (SELECT doc_id FROM h) THEN 'original not found' WHEN duplicate_path NOT IN (SELECT doc_id FROM h) THEN 'duplicate not found' END AS error FROM p)"
)
def q_action_result(spark, d):
    assets = _assets(spark, d)
    config = Config(prioritization=("largest_file_size",), delete_duplicates=True, create_symlinks=True)
    plan = dedup.action_plan(assets, dedup.keepers(assets, "doc_id", {"size": "size"}, config), "doc_id", config)
    return dedup.action_results(plan, assets.where("doc_id % 4 > 0"), "doc_id")


@_query(
    f"WITH k AS ({_KEEPER}) SELECT b.digest, a.doc_id AS original_path, b.doc_id AS duplicate_path, 'move' AS action_type, 'duplicates/' || b.doc_id AS target_path, true AS dry_run "
    "FROM k b JOIN k a ON a.digest = b.digest AND a.rn = 1 WHERE b.rn > 1"
)
def q_action_plan(spark, d):
    assets = _assets(spark, d)
    return dedup.action_plan(assets, dedup.keepers(assets, "doc_id", {"size": "size"}, LARGEST), "doc_id")


@_query(
    "WITH k AS (SELECT sha256(text) AS digest, doc_id, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, octet_length(encode(text)), doc_id) AS rn FROM documents) "
    "SELECT digest, doc_id AS keeper, n FROM k WHERE n > 1 AND rn = 1"
)
def q_keeper_by_format(spark, d):
    rules = Config(prioritization=("preferred_format", "smallest_file_size"), preferred_formats=("fr", "de"))
    rows = _assets(spark, d)
    return dedup.keepers(rows, "doc_id", {"format": "lang", "size": "size"}, rules)


@_query("SELECT page_id, sha256(html) AS digest FROM pages")
def q_digest(spark, d):
    return _t(spark, d, "pages").select("page_id", H.digest(F.col("html")).alias("digest"))


@_query("SELECT doc_id, substring(sha256(source || '/' || octet_length(encode(text)) || '/' || coalesce(epoch(o_orderdate)::BIGINT, 0)), 1, 16) AS phash, true AS phash_is_fallback FROM documents LEFT JOIN orders ON o_orderkey = doc_id")
def q_fallback(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate"), "doc_id", "left")
    return rows.select("doc_id", H.hex16(H.fallback(F.col("source"), F.octet_length("text"), F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz")))).alias("phash"), F.lit(True).alias("phash_is_fallback"))


# ---- perceptual hashes ----

_BITS = "list_sum(list_transform(range(0, 64), lambda i: CASE WHEN px[i + 1]::FLOAT > m THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END))::HUGEINT::UBIGINT"
_HEX = "lower(lpad(to_hex({}), 16, '0'))"
_ONE = f"SELECT vec_id, {_BITS} AS h FROM (SELECT vec_id, embedding AS px, (list_reduce(list_transform(embedding, lambda x: x::FLOAT), lambda a, x: (a + x)::FLOAT) / 64::FLOAT)::FLOAT AS m FROM embeddings)"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", H.phash64(F.col("embedding")).alias("h"))


@_query(f"SELECT vec_id, {_HEX.format('h')} AS phash, bit_count(h)::INTEGER AS bits FROM ({_ONE})")
def q_phash64(spark, d):
    return _hashes(spark, d).select("vec_id", H.hex16(F.col("h")).alias("phash"), F.bit_count("h").alias("bits"))


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """32 x 32 pictures of sixteen vectors each; the last one may end in black."""
    rows = _t(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).cast("long").alias("image")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    return rows.select("image", F.slice(F.concat(F.flatten(F.col("rows.embedding")), F.array_repeat(F.lit(0.0).cast("float"), 1024)), 1, 1024).alias("px"))


_GRID = "SELECT image, list_resize(flatten(list(embedding::FLOAT[] ORDER BY vec_id)), 1024, 0::FLOAT) AS px FROM (SELECT vec_id // 16 AS image, vec_id, embedding FROM embeddings) GROUP BY image"
_GRID_M = f"SELECT image, px, (list_reduce(list_transform(px, lambda x: x::FLOAT), lambda a, x: (a + x)::FLOAT) / 1024::FLOAT)::FLOAT AS m FROM ({_GRID})"


@_query(f"SELECT image, s::INTEGER AS word, {_HEX.format(_BITS)} AS phash FROM (SELECT image, s, px[s * 64 + 1 : s * 64 + 64] AS px, m FROM ({_GRID_M}), range(0, 16) t(s))")
def q_phash1024(spark, d):
    words = _grids(spark, d).select("image", F.posexplode(H.phash1024(F.col("px"))).alias("word", "h"))
    return words.select("image", "word", H.hex16(F.col("h")).alias("phash"))


# Sides that 8 divides, sides that it doesn't, and one below 8. A step is a whole number of pixels.
_SIDES = ((32, 32), (20, 51), (7, 146))
_FAST = (
    "SELECT image, w, list_transform(range(0, 64), lambda k: px[least((k // 8) * (greatest(h, 8) // 8), h - 1) * w + least((k % 8) * (greatest(w, 8) // 8), w - 1) + 1]) AS px "
    f"FROM ({_GRID}), (VALUES {', '.join(map(str, _SIDES))}) s(w, h)"
)


@_query(f"SELECT image, w::INTEGER AS width, {_HEX.format(_BITS)} AS phash FROM (SELECT image, w, px, (list_reduce(list_transform(px, lambda x: x::FLOAT), lambda a, x: (a + x)::FLOAT) / 64::FLOAT)::FLOAT AS m FROM ({_FAST}))")
def q_phash_fast(spark, d):
    sides = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in _SIDES])).alias("side")
    return _grids(spark, d).select("image", "px", sides).select("image", F.col("side.w").alias("width"), H.hex16(H.phash_fast(F.col("px"), F.col("side.w"), F.col("side.h"))).alias("phash"))


@_query("SELECT vec_id, k::INTEGER AS pixel, 0.299::DOUBLE * embedding[3 * k + 1]::DOUBLE + 0.587::DOUBLE * embedding[3 * k + 2]::DOUBLE + 0.114::DOUBLE * embedding[3 * k + 3]::DOUBLE AS luma FROM embeddings, range(0, 21) t(k)")
def q_luma(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("pixel"))
    e = [F.get("embedding", 3 * F.col("pixel") + i).cast("double") for i in range(3)]
    return rows.select("vec_id", "pixel", H.luma(*e).alias("luma"))


_NEXT = f"WITH h AS ({_ONE}) SELECT a.vec_id, b.vec_id AS other, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1"


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    return h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("h").alias("g")), "vec_id")


@_query(_NEXT)
def q_hamming(spark, d):
    return _neighbours(spark, d).select("vec_id", "other", H.hamming(F.col("h"), F.col("g")).alias("distance"))


@_query(f"SELECT vec_id, other, distance <= 30 AS is_similar FROM ({_NEXT})")
def q_similar(spark, d):
    return _neighbours(spark, d).select("vec_id", "other", H.similar(F.col("h"), F.col("g"), 30).alias("is_similar"))


@_query(f"SELECT vec_id, k::INTEGER AS flipped, bit_count(xor(h, g))::INTEGER AS distance FROM (SELECT vec_id, k, h, xor(h, ((1::UBIGINT << k) - 1)::UBIGINT) AS g FROM ({_ONE}), range(0, 9) t(k))")
def q_ladder(spark, d):
    rows = _hashes(spark, d).select("vec_id", "h", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("flipped"))
    return rows.select("vec_id", "flipped", H.hamming(F.col("h"), F.col("h").bitwiseXOR(F.expr("shiftleft(1L, flipped) - 1"))).alias("distance"))


def _family(spark: SparkSession, d: str) -> DataFrame:
    """Each hash with copies of 2 and 4 bits changed: asset, phash."""
    rows = _hashes(spark, d).select("vec_id", "h", F.explode(F.array(F.lit(0), F.lit(3), F.lit(15))).alias("k"))
    return rows.select((F.col("vec_id") * 16 + F.col("k")).alias("asset"), F.col("h").bitwiseXOR(F.col("k").cast("long")).alias("phash"))


_FAMILY = f"SELECT vec_id * 16 + k AS asset, xor(h, k::UBIGINT) AS phash FROM ({_ONE}), (VALUES (0), (3), (15)) t(k)"


@_query(f"WITH f AS (SELECT DISTINCT phash FROM ({_FAMILY})) SELECT {_HEX.format('least(a.phash, b.phash)')} AS low, {_HEX.format('greatest(a.phash, b.phash)')} AS high, bit_count(xor(a.phash, b.phash))::INTEGER AS distance FROM f a JOIN f b ON a.phash < b.phash WHERE bit_count(xor(a.phash, b.phash)) <= 6")
def q_near_pairs(spark, d):
    a, b = H.hex16(F.col("a")), H.hex16(F.col("b"))
    return similarity.near_hashes(_family(spark, d), 6).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), "distance")


_GROUPS = (
    f"WITH RECURSIVE f AS ({_FAMILY}), u AS (SELECT phash, min(asset) AS least FROM f GROUP BY phash), "
    "e AS (SELECT a.phash AS a, b.phash AS b FROM u a JOIN u b ON a.phash <> b.phash WHERE bit_count(xor(a.phash, b.phash)) <= 3), "
    "r AS (SELECT phash AS a, phash AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) "
    "SELECT f.asset, l.label FROM f JOIN (SELECT r.a, min(u.least) AS label FROM r JOIN u ON u.phash = r.b GROUP BY r.a) l ON l.a = f.phash"
)


@_query(_GROUPS)
def q_near_groups(spark, d):
    f = _family(spark, d)
    return similarity.near_groups(f, similarity.near_hashes(f, 3), "asset")


@_query(_GROUPS)
def q_near_index(spark, d):
    """The same groups by an index that three batches come to one after another."""
    f = _family(spark, d)
    index = NearIndex(spark, f"{shared_dir(spark)}/q_near_index-{uuid.uuid4().hex}", 3, expected=100_000)
    for k in range(3):
        index.add(f.where(F.col("asset") % 3 == k))
    return index.near_groups(f, "asset")


# Copies of each long hash: 6 bits of every word changed (just near), 7 (near to those), 16 (apart).
_MASKS = (0, 0x3F, 0x7F, 0xFFFF0000)


def _long_family(spark: SparkSession, d: str) -> DataFrame:
    """asset, phash_enh; the last copy occurs twice."""
    rows = _grids(spark, d).select("image", H.phash1024(F.col("px")).alias("w"))
    copies = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("long").alias("m")) for k, m in enumerate((*_MASKS, _MASKS[-1]))])).alias("c")
    rows = rows.select("image", "w", copies)
    return rows.select((F.col("image") * 8 + F.col("c.k")).alias("asset"), F.transform("w", lambda x: x.bitwiseXOR(F.col("c.m"))).alias("phash_enh"))


_WORDS = f"SELECT image, list(h ORDER BY s) AS w FROM (SELECT image, s, {_BITS} AS h FROM (SELECT image, s, px[s * 64 + 1 : s * 64 + 64] AS px, m FROM ({_GRID_M}), range(0, 16) t(s))) GROUP BY image"
_LONG = f"SELECT image * 8 + k AS asset, list_transform(w, lambda x: xor(x, m::UBIGINT)) AS w FROM ({_WORDS}), (VALUES {', '.join(f'({k}, {m})' for k, m in enumerate((*_MASKS, _MASKS[-1])))}) t(k, m)"
_APART = "list_sum(list_transform(list_zip(a.w, b.w), lambda z: bit_count(xor(z[1], z[2]))))"


@_query(f"WITH f AS (SELECT w, min(asset) AS asset FROM ({_LONG}) GROUP BY w) SELECT a.asset AS low, b.asset AS high, {_APART}::INTEGER AS distance FROM f a JOIN f b ON a.asset < b.asset WHERE {_APART} <= 96")
def q_near_long_pairs(spark, d):
    """Pairs of distinct long hashes within 96 bits, each named by its smallest asset."""
    f = _long_family(spark, d)
    name = f.groupBy("phash_enh").agg(F.min("asset").alias("asset"))
    pairs = near_long.near_long_pairs(f, 6)
    named = pairs.join(name.select(F.col("phash_enh").alias("a"), F.col("asset").alias("p")), "a").join(name.select(F.col("phash_enh").alias("b"), F.col("asset").alias("q")), "b")
    return named.select(F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), "distance")


@_query(
    f"WITH RECURSIVE f AS ({_LONG}), u AS (SELECT w, min(asset) AS least FROM f GROUP BY w), "
    f"e AS (SELECT a.least AS a, b.least AS b FROM u a JOIN u b ON a.least <> b.least WHERE {_APART} <= 96), "
    "r AS (SELECT least AS a, least AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) "
    "SELECT f.asset, l.label FROM f JOIN u ON u.w = f.w JOIN (SELECT a, min(b) AS label FROM r GROUP BY a) l ON l.a = u.least"
)
def q_near_long_groups(spark, d):
    return near_long.near_long_groups(_long_family(spark, d), 6, "asset")


@_query(f"SELECT vec_id, {_HEX.format('h')} AS code, CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS phash FROM ({_ONE})")
def q_codec(spark, d):
    code = H.to_bytes(F.col("h"))
    return _hashes(spark, d).select("vec_id", F.lower(F.hex(code)).alias("code"), H.from_bytes(code).alias("phash"))


# ---- store ----


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "labels").select("doc_id", F.col("quality").alias("digest"))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def q_new_assets(spark, d):
    return store.new_assets(_t(spark, d, "documents").select("doc_id"), _stored(spark, d), "doc_id")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def q_store_new_assets(spark, d):
    """The same against a store in ranges, of which only those that the catalog touches are read."""
    held = store.HashStore(spark, f"{shared_dir(spark)}/q_store_new_assets-{uuid.uuid4().hex}", most_rows=200)
    none = {"phash": "bigint", "phash_enh": "array<bigint>", "phash_is_fallback": "boolean", "pixels": "bigint"}
    rows = _stored(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.col("digest").cast("string").cast("binary").alias("digest"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    held.upsert(rows)
    return held.new_assets(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"))).select(F.col("path").cast("long").alias("doc_id"))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_skiplist(spark, d):
    return store.without_skipped(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").where("toxic = 1"), "doc_id")


@_query("SELECT d.doc_id, sha256(d.text) AS digest, l.quality AS phash FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_all_hashes(spark, d):
    return store.all_hashes(_assets(spark, d).select("doc_id", "digest"), _t(spark, d, "labels").select("doc_id", F.col("quality").alias("phash")), "doc_id")


_ODD = "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'phash_only' ELSE 'digest_only' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE (d.doc_id IS NULL) <> (l.doc_id IS NULL)"


def _odd(spark: SparkSession, d: str) -> DataFrame:
    return store.inconsistent(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@_query(_ODD)
def q_diagnose(spark, d):
    return _odd(spark, d)


@_query(f"SELECT * FROM ({_ODD}) ORDER BY doc_id LIMIT 5")
def q_diagnose_head(spark, d):
    return _odd(spark, d).orderBy("doc_id").limit(5)


@_query(f"SELECT (SELECT count(*) FROM documents) AS digests, (SELECT count(*) FROM labels) AS phashes, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS keys, (SELECT count(*) FROM ({_ODD})) AS inconsistent")
def q_diagnose_summary(spark, d):
    a, b = _t(spark, d, "documents").select("doc_id", F.lit(1).alias("x")), _t(spark, d, "labels").select("doc_id", F.lit(1).alias("y"))
    return a.join(b, "doc_id", "full_outer").agg(F.count("x").alias("digests"), F.count("y").alias("phashes"), F.count("*").alias("keys"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("inconsistent"))


@_query("SELECT count(d.doc_id) AS digests, count(l.quality) AS phashes FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_store_stats(spark, d):
    return store.all_hashes(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").select("doc_id", "quality"), "doc_id").agg(F.count("doc_id").alias("digests"), F.count("quality").alias("phashes"))


@_query("SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q_upsert(spark, d):
    rows = _t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return store.latest(rows, ["user_id", "event_type"], ["ts", "event_id"])


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'old' END AS digest, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE doc_id END AS phash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def q_store_upsert(spark, d):
    """A store of every other document, then a batch of every third, each twice; the later row of a path stays."""
    held = store.HashStore(spark, f"{shared_dir(spark)}/q_store_upsert-{uuid.uuid4().hex}", ranges=8)
    none = [F.lit(None).cast("array<bigint>").alias("phash_enh"), F.lit(False).alias("phash_is_fallback"), F.lit(None).cast("long").alias("pixels")]
    rows = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text", "n_chars")
    held.upsert(rows.where("doc_id % 2 = 0").select("path", F.encode(F.lit("old"), "utf-8").alias("digest"), F.col("doc_id").alias("phash"), *none))
    third = rows.where("doc_id % 3 = 0")
    first = third.select("path", F.encode(F.lit("zzz"), "utf-8").alias("digest"), F.lit(0).cast("long").alias("phash"), *none, F.lit(1).alias("turn"))
    last = third.select("path", F.encode(F.sha2("text", 256), "utf-8").alias("digest"), F.col("n_chars").alias("phash"), *none, F.lit(2).alias("turn"))
    held.upsert(last.union(first), "turn")
    return held.read().select(F.col("path").cast("long").alias("doc_id"), F.decode("digest", "utf-8").alias("digest"), "phash")


@_query("SELECT 'pc:' || doc_id AS key, sha256(text) AS value FROM documents UNION ALL SELECT 'pp:' || doc_id, lower(lpad(to_hex(n_chars::UBIGINT), 16, '0')) FROM documents")
def q_key_value(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.unhex(F.sha2("text", 256)).alias("digest"), F.col("n_chars").alias("phash"), F.lit(None).cast("array<bigint>").alias("phash_enh"))
    return store.key_value_view(rows).select("key", F.lower(F.hex("value")).alias("value"))


# ---- paths and formats ----

_LEAF = "string_split(url, '/')[-1]"
_EXT = f"nullif(regexp_extract({_LEAF}, '^.+\\.([^.]*)$', 1), '')"
# Fixed values, as in assetloom.functions.paths: file extensions by format.
_FORMATS = "CASE WHEN lower({0}) IN ('raw','dng','cr2','nef','arw','orf','rw2','nrw','raf','crw','pef','srw','x3f','rwl','3fr') THEN 'raw' WHEN lower({0}) IN ('jpg','jpeg') THEN 'jpeg' WHEN lower({0}) = 'png' THEN 'png' WHEN lower({0}) IN ('tif','tiff') THEN 'tiff' WHEN lower({0}) = 'heic' THEN 'heic' WHEN {0} IS NOT NULL THEN 'other' END"


@_query(f"SELECT page_id, url AS path, octet_length(encode(html))::BIGINT AS size, {_FORMATS.format(_EXT)} AS format, coalesce(lower({_EXT}), '') AS ext FROM pages")
def q_catalog(spark, d):
    url = F.col("url")
    return _t(spark, d, "pages").select("page_id", url.alias("path"), F.octet_length("html").cast("long").alias("size"), P.format_of(P.extension(url)).alias("format"), P.lower_extension(url).alias("ext"))


@_query(f"SELECT page_id, {_LEAF} AS leaf, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, {_EXT} AS ext, coalesce(nullif(regexp_extract({_LEAF}, '^(.+)\\.[^.]*$', 1), ''), {_LEAF}) AS stem FROM pages")
def q_path_parts(spark, d):
    url = F.col("url")
    return _t(spark, d, "pages").select("page_id", P.leaf(url).alias("leaf"), P.parent(url).alias("parent"), P.extension(url).alias("ext"), P.stem(url).alias("stem"))


_NAMES = ("a.JPG", "b.jpeg", "c.png", "d.tif", "e.TIFF", "f.heic", "g.cr2", "h.3fr", "i.txt", ".hidden", "noext", "j.tar.gz", "k.")


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("_"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES)).cast("int") + 1))
    return _t(spark, d, "documents").select("doc_id", path.alias("path")), F.col("path")


_NAMED = f"SELECT doc_id, '/' || source || '/' || doc_id || '_' || ({list(_NAMES)})[doc_id % {len(_NAMES)} + 1] AS url FROM documents"


@_query(f"SELECT doc_id, url AS path, {_FORMATS.format(_EXT)} AS format, {_EXT} IS NOT NULL AS is_image_path, coalesce({_FORMATS.format(_EXT)} <> 'other', false) AS has_image_extension FROM ({_NAMED})")
def q_format(spark, d):
    rows, path = _named(spark, d)
    return rows.select("doc_id", "path", P.format_of(P.extension(path)).alias("format"), P.is_image_path(path).alias("is_image_path"), P.has_image_extension(path).alias("has_image_extension"))


@_query(f"SELECT doc_id, url AS path FROM ({_NAMED}) WHERE NOT (url = '/src1' OR starts_with(url, '/src1/')) AND NOT starts_with({_LEAF}, '.')")
def q_exclude(spark, d):
    rows, path = _named(spark, d)
    return rows.where(~P.excluded(path, ["/src1/"]) & ~P.hidden(path)).select("doc_id", "path")


@_query("SELECT page_id, (len(string_split(url[6:], '/')) - 1)::INTEGER AS depth FROM (SELECT page_id, 'root:' || regexp_replace(url, '^https?:/', '') AS url FROM pages) WHERE len(string_split(url[6:], '/')) - 1 <= 3")
def q_depth(spark, d):
    path = F.concat(F.lit("root:"), F.regexp_replace("url", "^https?:/", ""))
    return _t(spark, d, "pages").select("page_id", P.depth(path, "root:").alias("depth")).where("depth <= 3")


_HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "474946383961", "00000018667479706D696631", "524946460000000057454250", "")


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("page_id") % len(_HEADS)).cast("int") + 1))
    name = F.concat(F.lit("/p/"), (F.col("page_id") - F.col("page_id") % 2).cast("string"), F.element_at(F.array(*map(F.lit, (".jpg", ".png", ".jpeg", ".heif", ".webp"))), (F.col("page_id") % 5).cast("int") + 1))
    return _t(spark, d, "pages").select("page_id", name.alias("path"), F.concat(head, F.encode("html", "utf-8")).alias("content"))


_BYTES = f"SELECT page_id, '/p/' || (page_id - page_id % 2) || (['.jpg','.png','.jpeg','.heif','.webp'])[page_id % 5 + 1] AS path, ({list(_HEADS)})[page_id % {len(_HEADS)} + 1] || hex(encode(html)) AS x FROM pages"
_MAGIC = "CASE WHEN x[9:16] IN ('66747970','68656963','68656966','6D696631') THEN 'heic' WHEN starts_with(x, 'FFD8FF') THEN 'jpg' WHEN starts_with(x, '89504E47') THEN 'png' WHEN starts_with(x, '47494638') THEN 'gif' WHEN starts_with(x, '52494646') AND x[17:24] = '57454250' THEN 'webp' END"


@_query(f"SELECT page_id, {_MAGIC} AS format, coalesce(x[9:16] IN ('66747970','68656963','68656966','6D696631'), false) AS is_heic FROM ({_BYTES})")
def q_magic(spark, d):
    c = F.col("content")
    return _bytes(spark, d).select("page_id", M.format_by_magic(c).alias("format"), M.is_heic(c).alias("is_heic"))


_PLAN = f"SELECT *, CASE WHEN format IS NULL THEN 'unknown' WHEN ext = format OR (format = 'jpg' AND ext IN ('jpg','jpeg','jpe','jfif')) OR (format = 'heic' AND ext IN ('heic','heif')) THEN 'ok' ELSE 'mismatch' END AS status FROM (SELECT page_id, path AS old_path, {_MAGIC} AS format, string_split(path, '.')[-1] AS ext FROM ({_BYTES}))"


@_query(f"SELECT old_path, format, CASE WHEN status = 'mismatch' THEN new_path END AS new_path, status, coalesce(status = 'mismatch' AND new_path IN (SELECT path FROM ({_BYTES})), false) AS blocked FROM (SELECT *, string_split(old_path, '.')[1] || '.' || format AS new_path FROM ({_PLAN}))")
def q_suffix_mismatch(spark, d):
    from assetloom.plans.engine import suffix_plan

    return suffix_plan(_bytes(spark, d))


@_query(f"SELECT status, count(*) AS n FROM ({_PLAN}) GROUP BY status")
def q_suffix_summary(spark, d):
    from assetloom.plans.engine import suffix_plan

    return suffix_plan(_bytes(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


# ---- sizes, times, records ----


@_query("SELECT doc_id, CASE WHEN s = 0 THEN 'empty' WHEN s > 200000000 THEN 'large' WHEN lang = 'tiff' AND s > 100000000 THEN 'large' ELSE 'ok' END AS size_class, s // 1000000 AS file_mb, s // 1024 // 1024 AS memory_mb FROM (SELECT doc_id, lang, octet_length(encode(text))::BIGINT * 20000 AS s FROM documents) WHERE s > 0")
def q_validate(spark, d):
    s = F.col("s")
    rows = _assets(spark, d).withColumn("s", F.col("size") * 20000).where("s > 0")
    return rows.select("doc_id", R.size_class(s, F.col("lang")).alias("size_class"), R.file_mb(s).alias("file_mb"), R.memory_mb(s).alias("memory_mb"))


_SIDE = "CASE WHEN greatest(w, h) > 1024 THEN CASE WHEN s > 300000000 THEN 768 WHEN s > 100000000 THEN 896 ELSE 1024 END END"


@_query(
    f"SELECT o_orderkey, side, kind, CASE WHEN w > h THEN side ELSE round((w::FLOAT * (side::FLOAT / h::FLOAT)::FLOAT)::FLOAT)::INTEGER END AS width, CASE WHEN w > h THEN round((h::FLOAT * (side::FLOAT / w::FLOAT)::FLOAT)::FLOAT)::INTEGER ELSE side END AS height FROM (SELECT o_orderkey, w, h, {_SIDE} AS side, "
    "CASE WHEN greatest(w, h) > 1024 THEN CASE WHEN s > 300000000 THEN 'nearest' WHEN s > 100000000 THEN 'triangle' ELSE 'lanczos3' END END AS kind FROM (SELECT o_orderkey, (o_custkey % 4000 + 1)::INTEGER AS w, (o_orderkey % 3000 + 1)::INTEGER AS h, (o_totalprice * 1000)::BIGINT AS s FROM orders))"
)
def q_resize_plan(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4000 + 1).cast("int").alias("w"), (F.col("o_orderkey") % 3000 + 1).cast("int").alias("h"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("s"))
    side, kind = H.resize_plan(F.col("w"), F.col("h"), F.col("s"))
    rows = rows.withColumns({"side": side, "kind": kind})
    w, h = H.target_size(F.col("w"), F.col("h"), F.col("side"))
    return rows.select("o_orderkey", "side", "kind", w.alias("width"), h.alias("height"))


@_query(f"SELECT doc_id, CASE f WHEN 'raw' THEN 15 WHEN 'tiff' THEN 10 ELSE 5 END::INTEGER AS digest_s, CASE f WHEN 'raw' THEN 30 WHEN 'tiff' THEN 20 ELSE 10 END::INTEGER AS phash_s FROM (SELECT doc_id, {_FORMATS.format(_EXT)} AS f FROM ({_NAMED}))")
def q_timeout(spark, d):
    rows, path = _named(spark, d)
    f = P.format_of(P.extension(path))
    return rows.select("doc_id", R.seconds_allowed(f).alias("digest_s"), R.seconds_allowed(f, True).alias("phash_s"))


@_query("SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END AS eta FROM (SELECT o_orderkey, o_orderkey % 9000 AS s FROM orders)")
def q_eta(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", R.eta_text(F.col("o_orderkey") % 9000).alias("eta"))


@_query("SELECT o_orderkey, greatest(epoch(o_orderdate)::BIGINT - 800000000, 0) AS seconds, epoch(o_orderdate)::BIGINT AS back FROM orders")
def q_unix(spark, d):
    shifted = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 800_000_000)
    back = R.to_unix(R.from_unix(R.to_unix(F.col("o_orderdate"))))
    return _t(spark, d, "orders").select("o_orderkey", R.to_unix(shifted).alias("seconds"), back.alias("back"))


@_query("SELECT event_id AS id, 'p/' || event_id AS path, greatest(floor(epoch(ts))::BIGINT, 0) AS last_modified, sha256(event_type) AS hash, floor(value)::BIGINT AS phash FROM events")
def q_stored_roundtrip(spark, d):
    flat = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("p/"), "event_id").alias("path"), R.to_unix(F.col("ts")).alias("m"), F.unhex(F.sha2("event_type", 256)).alias("b"), H.to_bytes(F.floor("value")).alias("p"))
    return flat.select("id", "path", R.to_unix(R.from_unix(F.col("m"))).alias("last_modified"), F.lower(F.hex("b")).alias("hash"), H.from_bytes(F.col("p")).alias("phash"))


_EVENT_MESSAGE = "CASE event_id % 5 WHEN 0 THEN 'Hash computation failed - Path: /u/' || user_id || ', Error: ' || event_type || ': ' || event_id WHEN 1 THEN 'File operation failed - Operation: ' || event_type || ', Path: /u/' || user_id || ', Error: ' || event_id WHEN 2 THEN 'FS CHANGE - Operation: ' || event_type || ', Path: /u/' || user_id || ', Details: ' || event_id WHEN 3 THEN 'FS CHANGE - Operation: ' || event_type || ', Path: /u/' || user_id ELSE 'DB OPERATION - Operation: ' || event_type || ', Details: ' || event_id END"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    path, kind, n = F.concat(F.lit("/u/"), "user_id"), F.col("event_type"), F.col("event_id").cast("string")
    k = F.col("event_id") % 5
    text = F.when(k == 0, R.hash_error(path, F.concat(kind, F.lit(": "), n))).when(k == 1, R.file_error(path, kind, n)).when(k == 2, R.fs_change(kind, path, n))
    text = text.when(k == 3, R.fs_change(kind, path, F.lit(None).cast("string"))).otherwise(R.db_operation(kind, n))
    level = F.element_at(F.array(*map(F.lit, R.LEVELS)), (F.col("event_id") % 5).cast("int") + 1)
    return _t(spark, d, "events").select("*", text.alias("message"), level.alias("level"))


@_query(f"SELECT event_id, {_EVENT_MESSAGE} AS message FROM events")
def q_log_build(spark, d):
    return _messages(spark, d).select("event_id", "message")


@_query(
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'hash_computation' WHEN 4 THEN 'other' ELSE event_type END AS operation, CASE event_id % 5 WHEN 4 THEN '' ELSE '/u/' || user_id END AS path, "
    f"CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'file_operation' WHEN 4 THEN 'application' ELSE 'fs_change' END AS error_type, CASE event_id % 5 WHEN 3 THEN '' WHEN 4 THEN {_EVENT_MESSAGE} ELSE event_id::VARCHAR END AS details FROM events"
)
def q_log_parse(spark, d):
    return _messages(spark, d).select("event_id", R.parse_message(F.col("message")).alias("p")).select("event_id", "p.*")


@_query(
    "SELECT event_id, to_json({level: 'ERROR', data: {raw_message: event_type, formatted_message: 'application event on system: ' || event_type, context: {source: {module: 'assetloom', file: 'unknown', line: 0}, operation: 'direct', path: '', "
    "error: {type: 'application', details: event_type}, timestamp: strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC'}}})::VARCHAR AS payload FROM events"
)
def q_log_json(spark, d):
    none = F.lit(None).cast("string")
    kind = F.col("event_type")
    return _t(spark, d, "events").select("event_id", R.log_json(F.lit("ERROR"), kind, F.lit("assetloom"), none, F.lit(None).cast("int"), none, none, none, none, F.col("ts")).alias("payload"))


@_query("SELECT event_id, (['trace','debug','info','warn','error'])[event_id % 5 + 1] AS level FROM events WHERE event_id % 5 >= 3")
def q_log_level(spark, d):
    return _messages(spark, d).where(R.level_at_least(F.col("level"), "warn")).select("event_id", "level")


_PARTS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN p_name || '_original' WHEN 0 THEN p_name || '_original.JPG' WHEN 1 THEN p_name || '_resize_800x600_1.jpg' WHEN 2 THEN p_name || '_crop_9.jpg' ELSE p_name || '_odd.png' END AS leaf FROM (SELECT p_partkey, replace(p_name, '_', '-') AS p_name FROM part)"
_PARSED = f"SELECT p_partkey, CASE WHEN p_partkey % 5 >= 3 THEN NULL ELSE string_split(leaf, '_')[1] END AS image_name, CASE p_partkey % 5 WHEN 0 THEN 'original' WHEN 1 THEN 'resize' WHEN 2 THEN 'crop' END AS transformation, CASE p_partkey % 5 WHEN 1 THEN '800x600' END AS parameter, CASE WHEN p_partkey % 5 >= 3 THEN NULL ELSE 'jpg' END AS file_type FROM ({_PARTS})"


def _registry(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, ("_original.JPG", "_resize_800x600_1.jpg", "_crop_9.jpg", "_odd.png", "_original")))
    name = F.concat(F.replace(F.col("p_name"), F.lit("_"), F.lit("-")), F.element_at(ends, (F.col("p_partkey") % 5).cast("int") + 1))
    return _t(spark, d, "part").select("p_partkey", P.image_name(name).alias("i")).select("p_partkey", "i.*")


@_query(_PARSED)
def q_registry_parse(spark, d):
    return _registry(spark, d)


@_query(f"SELECT p_partkey, 'exact' AS how FROM ({_PARSED}) WHERE transformation = 'crop' AND parameter IS NULL UNION ALL SELECT p_partkey, 'any' FROM ({_PARSED}) WHERE transformation IS NOT NULL AND file_type = 'jpg'")
def q_registry_find(spark, d):
    """An exact search takes a null parameter as null only; a search by criteria takes a null criterion as any."""
    rows = _registry(spark, d)
    exact = rows.where((F.col("transformation") == "crop") & F.col("parameter").eqNullSafe(F.lit(None)))
    criterion = F.lit(None).cast("string")
    loose = rows.where(F.col("transformation").isNotNull() & (F.col("file_type") == "jpg") & (criterion.isNull() | (F.col("parameter") == criterion)))
    return exact.select("p_partkey", F.lit("exact").alias("how")).union(loose.select("p_partkey", F.lit("any").alias("how")))


@_query(f"SELECT DISTINCT transformation, file_type FROM ({_PARSED}) WHERE transformation IS NOT NULL")
def q_registry_distinct(spark, d):
    return _registry(spark, d).where("transformation is not null").select("transformation", "file_type").distinct()


_PROGRESS = "SELECT event_type, n, floor(epoch(last))::BIGINT - floor(epoch(first))::BIGINT AS elapsed, CASE WHEN floor(epoch(last))::BIGINT > floor(epoch(first))::BIGINT THEN n::DOUBLE / (floor(epoch(last))::BIGINT - floor(epoch(first))::BIGINT) ELSE 25.0::DOUBLE END AS speed FROM (SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type)"


@_query(
    "SELECT event_type, n, elapsed, (100000 - n) / speed AS eta, printf('%.1f img/s | %d ok | 0 errors | ETA: ', speed, n) || CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END AS line "
    f"FROM (SELECT *, floor((100000 - n) / speed)::BIGINT AS s FROM ({_PROGRESS}))"
)
def q_progress(spark, d):
    at = lambda f: F.unix_seconds(f("ts").cast("timestamp"))
    rows = _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (at(F.max) - at(F.min)).alias("elapsed"))
    rows = rows.withColumn("eta", R.eta_seconds(F.col("n"), F.lit(100_000), F.col("elapsed")))
    speed = F.when(F.col("elapsed") > 0, R.rate(F.col("n"), F.col("elapsed"))).otherwise(25.0)
    return rows.select("event_type", "n", "elapsed", "eta", R.progress_text(speed, F.col("n"), F.lit(0), F.col("eta")).alias("line"))


@_query("SELECT event_id, max(value) OVER w AS peak, value - first_value(value) OVER w AS change FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def q_peak_memory(spark, d):
    """Of each run (a user's events of one type): the highest measure so far, and the change since the first."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _t(spark, d, "events").select("event_id", F.max("value").over(w).alias("peak"), (F.col("value") - F.first("value").over(w)).alias("change"))


@_query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS ok, count(*) FILTER (WHERE NOT value > 50) AS rejected, (count(*) + 99) // 100 AS batches FROM events GROUP BY event_type")
def q_batch_summary(spark, d):
    n = F.count("*")
    return _t(spark, d, "events").groupBy("event_type").agg(n.alias("n"), F.count_if(F.col("value") > 50).alias("ok"), F.count_if(~(F.col("value") > 50)).alias("rejected"), R.batches(n, 100).alias("batches"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
