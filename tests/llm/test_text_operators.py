"""Operators on documents against brute force, on odd rows and on empty tables."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetloom.llm import bpe, langid, lm, mixing, ngram_join, packing, toxicity


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def tokens(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark, docs_of, odd_rows, library):
    got = sorted(bpe.op3_bpe(spark, docs_of(odd_rows)).collect(), key=repr)
    want = []
    for i, text, *_ in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_clashing_columns_give_way(spark, docs_of, odd_rows):
    df = docs_of(odd_rows[:5]).withColumns({"n_tokens": F.lit(1), "IDS": F.lit("x"), "__x": F.lit(2)})
    got = bpe.encoded(spark, df, bpe.default_path())
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "__x", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and len(got.collect()) == 5


def test_bpe_on_odd_strings(library):
    texts = ["don't 's 'S 12 345, \x1c a\x85b\xa0c ½²ªµÿŸ", "<|startoftext|>hi<|endoftext|> x<|endoftext|", "a" * 60 + " " + "é" * 99, "x'y ''ll we're \"'s", "﻿à à ﬁ ǅ Σς ΑΣ İ", " a ", "0" * 70]
    splitter = bpe.Splitter(bpe.default_path())
    raw = sorted({w.encode() for t in texts[:3] for w in splitter.words(t) if w not in splitter.special})
    lexicon = bpe.compile_lexicon(zip(raw, bpe.Merger(bpe.default_path()).encode(raw), strict=True))
    codec = bpe.Codec(bpe.default_path(), lexicon)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert codec.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact():
    entries = sorted({f"{a}{b}ing".encode() for a in "abcdef" for b in "xyz"})
    data = bpe.compile_lexicon((w, np.arange(i, i + 2)) for i, w in enumerate(entries))
    lexicon = bpe.Lexicon(data)
    assert len(lexicon.final) == 6  # start, after the first letter, after the second, and i, in, ing
    assert lexicon.find(entries).tolist() == list(range(len(entries)))
    assert lexicon.find([b"", b"ax", b"axin", b"axinging", b"zz", b"\xff"]).tolist() == [-1] * 6
    assert bpe.Lexicon(bpe.compile_lexicon([])).find([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    import io

    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 7, 100, 0, 3001)]
    file = io.BytesIO()
    w = packing.ShardWriter(file, bits, block=64)
    for i, ids in enumerate(docs):
        w.add(i, ids)
    w.finish()
    r = packing.ShardReader(file)
    assert list(r.checksums(blocks=2)) == [zlib.crc32(d.tobytes()) for d in docs]
    assert all((r.document(i) == d).all() and len(r.document(i)) == len(d) for i, d in enumerate(docs))
    whole = np.concatenate(docs)
    assert (r.ids(60, 200) == whole[60:260]).all()


def test_packed_ids_spread_one_id_over_shards(spark, docs_of, library, tmp_path):
    rows = [(None if i % 3 else 7, f"text number {i} " * 50, "en", "s") for i in range(300)]
    manifest = packing.write(spark, docs_of(rows), f"file://{tmp_path}", bpe.default_path(), shard_bytes=30_000)
    assert len(manifest) > 5 and max(d for _, _, d, _ in manifest) < 150
    got = packing.read(spark, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 200 + [7] * 100
    assert [r["start"] for r in got][1:] == np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()
    want = Counter(zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t, *_ in rows)
    assert Counter(r["ids_crc32"] for r in got) == want


def test_texts_with_words_that_the_library_parts_otherwise(library):
    e = packing.LibraryEncoder(bpe.default_path())
    e.memo = {"hello": None}
    texts = ["hello world", "other world", "hello", None]
    assert [x.tolist() for x in e.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_python_meets_only_the_distinct_words_of_a_slice(library):
    class Asked(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.n += 1
            return super().__getitem__(k)

    e = packing.LibraryEncoder(bpe.default_path())
    texts = ["some words again " * 5_000, "Again some WORDS " * 5_000, "y" * 70 + " don't " * 100]
    for _ in range(2):
        e.memo = asked = Asked(e.memo)
        assert [x.tolist() for x in e.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert asked.n <= 20
    assert "again" in asked and "y" * 70 not in asked


def test_packed_words_are_cut_as_by_the_library(library):
    rng, e = np.random.default_rng(5), packing.LibraryEncoder(bpe.default_path(), most=500)
    for letters in ("'stmdrevlaxSTMDREVL 1.", "'`s1 \n", "".join(map(chr, range(256)))):
        texts = ["".join(rng.choice(list(letters), rng.integers(0, 40))) for _ in range(400)]
        texts[::50] = [None, "", " ", "'", "'s", "<|endoftext|> x", "\xa0\x85", "’s 日本 it's"]
        for t, x in zip(texts, e.encode(texts), strict=True):
            assert x.tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    assert e.encode([]) == [] and [len(x) for x in e.encode([None, "", " "])] == [0, 0, 0]


def test_shards_of_one_worker_share_an_encoder():
    path = bpe.default_path()
    assert packing._encoder(path, 1) is packing._encoder(path, 1) is not packing._encoder(path, 2)


def test_packed_ids(spark, docs_of, odd_rows, library):
    got = packing.op5_packed_ids(spark, docs_of(odd_rows)).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, text, *_ in order:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_language_model(spark, docs_of, odd_rows):
    got = lm.op4_lm_score(spark, docs_of(odd_rows)).collect()
    count = Counter()
    for i, text, *_ in odd_rows:
        if fold(i, 5) != 1:
            count.update([*tokens(text), b""])
    n, v = sum(count.values()), len(count)
    rows = []
    for i, text, *_ in odd_rows:
        t = [*tokens(text), b""]
        rows.append((i, fold(i, 5) == 1, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)))
    assert sorted(map(repr, rows)) == sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))) for r in got)
    assert all(r["score"] < 0 for r in got)


def test_language_model_gains_over_counts(spark):
    """On held-out texts of the driver's own table the model says more than the counts do."""
    got = lm.op4_lm_score(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.05


def test_language_model_is_normalised():
    frequent = {b"": 5, b"a": 9, b"b": 4, b"rare": 1}
    zero = np.zeros(4)
    zero[lm.form(b"rare", 4)] = 1
    voc = lm.Vocabulary(frequent, 3, 4, zero, zero, 19, 4)
    model = lm.LogBilinear(voc.symbols, 6, unigram=voc.unigram)
    h = np.repeat(np.arange(voc.symbols + 1), voc.symbols)
    p = model.log_probabilities(h, h[::-1].copy(), np.tile(np.arange(voc.symbols), voc.symbols + 1), chunk=3)
    assert np.allclose(np.exp(p).reshape(-1, voc.symbols).sum(axis=1), 1, atol=1e-5)


def test_nce_learns_what_follows_what():
    rng = np.random.default_rng(0)
    s = np.cumsum(rng.random(40_000) < 0.9) % 5  # mostly the next symbol, in a ring
    voc = 5
    h1, h2 = np.concatenate(([5], s[:-1])), np.concatenate(([5, 5], s[:-2]))
    noise = np.full(voc, 0.2)
    model, square = lm.LogBilinear(voc, 8, unigram=noise), None
    square = np.zeros_like(model.flat)
    for _ in range(8):
        model.train(h1, h2, s, noise, square, rng, batch=512)
    assert model.log_probabilities(h1, h2, s).mean() > -0.6 > np.log(0.2)


def brute_components(rows):
    def of(text):
        w = tokens(text)
        return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, of(t)) for i, t, *_ in rows]
    label = list(range(len(sets)))
    for a, (i, s) in enumerate(sets):
        for b in range(a):
            j, t = sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, s), x in zip(sets, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted(repr((i, len(s), least[x] if i is not None else None)) for (i, s), x in zip(sets, label, strict=True))


def varied(seed, n, base_words, edits):
    import random

    r = random.Random(seed)
    w = list(base_words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.random()}"
    return " ".join(w[:n])


def test_join_equals_brute_force(spark, docs_of, odd_rows):
    rows = list(odd_rows)
    at = 1000
    for family, n in enumerate((8, 30, 120, 160, 400, 700)):
        base = [f"w{family}x{i}" for i in range(n)]
        for k in range(14):  # similarities on both sides of the threshold, and sizes on both sides of the bands
            rows.append((at, varied(f"{family}{k}", n - k * n // 60, base, k * n // 150), "en", "s0"))
            at += 1
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(at + i, f"{passage} " + " ".join(f"q{i}y{j}" for j in range(20 + 40 * (i % 6))), "en", "s1") for i in range(40)]
    rows.append((1000, "another text of the same id that is long enough to matter here", "en", "s1"))
    base = [f"b{i}" for i in range(150)]  # a large family around one text: edits that many members share, on both sides of the threshold
    for k in range(120):
        w = list(base)
        for j in range(k % 9):
            at_ = (j * 17 + k * 7 + (k * k * 31 if j % 2 else 0)) % 150
            w[at_] = f"c{at_}" if j % 3 else f"d{k}x{j}"
        rows.append((5000 + k, " ".join(w), "en", "s2"))
    rows += [(6000, " ".join(base), "en", "s1"), (6000, " ".join(base), "en", "s1"), (None, " ".join(base), "en", "s1")]
    got = ngram_join.op10_ngram_join(spark, docs_of(rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_components(rows)


def test_join_by_differences_from_a_hub_equals_brute_force(spark, docs_of, monkeypatch):
    """Every signature counts as one of many members, blocks and ranges are small, and some sets count as short."""
    import random

    r = random.Random(5)
    rows = []
    for f in range(3):
        base = [f"b{f}x{i}" for i in range(60 + 90 * f)]
        for k in range(60):
            w = [x if r.random() > 0.06 * r.random() else r.choice(("", f"c{f}", f"e{r.random()}")) for x in base]
            rows.append((100 * f + k, " ".join(w[: len(w) - r.randrange(12)]), "en", "s"))
    want = brute_components(rows)
    df = docs_of(rows).select(F.col("doc_id").alias("doc_id"), "text")
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "CELL", 16)
    for few in (1, 16):
        assert sorted(repr(tuple(x)) for x in ngram_join.joined(spark, df, few=few).collect()) == want
    short, bounds, asked = ngram_join._short, ngram_join._bounds, []
    monkeypatch.setattr(ngram_join, "_short", lambda *a: asked.append(1) or short(*a))
    monkeypatch.setattr(ngram_join, "_bounds", lambda sets: bounds(sets).withColumn("enough", F.lit(10**6)))  # as if segments were too few: shingles decide
    monkeypatch.setattr(ngram_join, "_one_by_one", lambda small, label: spark.createDataFrame([], "x long, node long"))
    assert sorted(repr(tuple(x)) for x in ngram_join.joined(spark, df).collect()) == want and asked


def test_mixing(spark, docs_of, odd_rows):
    got = mixing.op8_mixing(spark, docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    size = Counter()
    for _, text, _, source in odd_rows:
        size[source] += len(tokens(text))
    target = mixing.fair_targets(list(size.items()), (1, 2, 3), 3)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(t <= 3 * size[s] + 1e-9 for s, t in target.items())
    by_id = {r[0]: r for r in odd_rows}
    taken = Counter()
    for r in got:
        _, text, _, source = by_id[r["doc_id"]]
        assert r["size"] == len(tokens(text)) and r["source_size"] == size[source] and abs(r["target"] - target[source]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[source] += r["taken"]
    assert sum(taken.values()) <= sum(size.values())
    for s, t in target.items():
        most = max(len(tokens(x[1])) for x in odd_rows if x[3] == s)
        assert abs(taken[s] - t) <= most + 1, s
    again = mixing.op8_mixing(spark, docs_of(odd_rows).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing_equals_brute_force(spark, docs_of, odd_rows):
    """The queue by hand: finish times in order, up to the budget."""
    df = docs_of(odd_rows + [(500 + i, "w " * (1 + i * 37 % 90), "en", f"s{i % 5}") for i in range(300)])
    rows = [(r["doc_id"], r["source"], len(tokens(r["text"])), r["h"]) for r in df.withColumn("h", F.xxhash64("doc_id", "text", "source")).collect()]
    total = Counter()
    for _, s, n, _ in rows:
        total[s] += n
    target = mixing.fair_targets(list(total.items()), (1, 2, 3), 3)
    queued = []
    for s in total:
        at = 0
        for i, _, n, h in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[2])):
            at += n
            queued += [((p * total[s] + at) / target[s], h, n, i) for p in range(3) if n]
    taken, left = Counter(), sum(total.values())
    ended = False
    for k in sorted({(v, h) for v, h, *_ in queued}):
        same = [q for q in queued if q[:2] == k]
        ended = ended or sum(q[2] for q in same) > left
        if not ended:
            left -= sum(q[2] for q in same)
            for q in same:
                taken[q[3]] += q[2]
    got = Counter()
    for r in mixing.op8_mixing(spark, df).collect():
        got[r["doc_id"]] += r["taken"]
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in taken.items() if n}


def test_mixing_keeps_clashing_columns(spark, docs_of, odd_rows):
    df = docs_of(odd_rows).withColumns({"size": F.lit(1), "n": F.lit("x"), "v": F.lit(2.0)})
    assert mixing.mixed(spark, df).columns == df.columns


def test_language(spark, docs_of, odd_rows):
    from tests.llm.conftest import prose

    rows = odd_rows + [(1000 + i, prose("en" if i % 2 else "de", 1000 + i), "en" if i % 2 else "de", "s") for i in range(200)]
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] >= 1000}
    got = langid.op9_language_id(spark, docs_of(rows)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (60, 61, 62, 63)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    df = docs_of(rows).withColumn("score", F.lit("mine"))
    kept = langid.kept(spark, df)
    assert kept.columns == df.columns and not {60, 61, 62, 63} & {r["doc_id"] for r in kept.collect()}


def test_language_equals_compressing_by_hand(spark, docs_of, odd_rows):
    import zstandard

    docs = docs_of(odd_rows)
    content = langid.fit(docs)
    assert list(content) == ["en", "de"]
    for k, data in content.items():  # whole texts, each once
        whole = {langid.plain(t) for _, t, lang, _ in odd_rows if lang == k and t and any(c.isalpha() for c in t)}
        assert len(data) <= 112_000 and all(w in data for w in whole if len(w) < 10_000)
    params = {k: zstandard.ZstdCompressionParameters.from_level(7, dict_size=len(d), source_size=1500, write_content_size=0, write_dict_id=0) for k, d in content.items()}
    coder = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params[k]) for k, d in content.items()}
    for r in langid.identify(spark, docs, content).collect():
        data = langid.plain(r["text"] or "")
        if r["lang_pred"] == "und":
            assert not any(c.isalpha() for c in r["text"] or "") and r["score"] == 0
            continue
        size = {k: sum(len(c.compress(data[i : i + 1500])) for i in range(0, len(data), 1500)) for k, c in coder.items()}
        best, second = sorted(size.values())
        assert size[r["lang_pred"]] == best and (best < second or r["lang_pred"] == "en")
        assert abs(r["score"] - min(1, (second - best) / second / 0.1)) < 1e-9


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs_of, odd_rows):
    from tests.llm.conftest import prose

    rows = odd_rows + [(1000 + i, prose("en", i) + (f" you {('idiot', 'moronic', 'scumbag')[i % 3]}" if i % 4 == 0 else ""), "en", "s") for i in range(240)]
    labels = labels_of(spark, [(1000 + i, 1, int(i % 4 == 0)) for i in range(240)] + [(None, 1, 1), (5, None, None)])
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, docs_of(rows), labels).collect() if r["doc_id"] is not None}
    held = [r for i, r in got.items() if i >= 1000 and r["held_out"]]
    assert len(held) > 20 and all(r["predicted"] == int((r["doc_id"] - 1000) % 4 == 0) for r in held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and 60 in got


def test_swaps_take_the_weight_from_identity_terms():
    f = toxicity.Features()
    r = np.random.default_rng(3)
    texts, y = [], []
    for i in range(600):
        group = "women" if r.random() < (0.8 if i % 2 else 0.2) else "men"
        texts.append([f"w{r.integers(50)}", f"w{r.integers(50)}", group, "idiot" if i % 2 and r.random() < 0.7 else "friend"])
        y.append(i % 2)
    f.add([w for t in texts for w in t] + ["women", "men"])
    x = [f.of(t) for t in texts]
    swaps = [s for t in texts for s in toxicity.swapped(t, [("women", "men")], f)]

    def gap(model):
        w, b = model
        return abs(float(w[f.of(["women"])].sum() - w[f.of(["men"])].sum()))

    free, held = toxicity.train(x, np.array(y, float)), toxicity.train(x, np.array(y, float), swaps)
    assert gap(held) < 0.2 * gap(free) and held[0][f.of(["idiot"])].sum() > 1


def test_neutral_mentions_move_no_score(spark):
    """On the driver's own sentences, which hold no identity term: each is compared with itself after a mention."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    x, y, swaps = toxicity.gathered(docs, labels)
    assert len(swaps) >= len(x) > 100
    w, b = toxicity.train(x, y, swaps)
    assert max(abs(float(w[gained].sum() - w[lost].sum())) for lost, gained in swaps) < 0.05
    free = toxicity.train(x, y)
    wrong = sum((w[r].sum() + b > 0) != v for r, v in zip(x, y, strict=True))
    assert free[0].any() and wrong <= 0.1 * len(x)


def test_toxicity_keeps_ties_and_takes_one_text_of_a_label(spark, docs_of):
    rows = [(1, "same words here", "en", "s"), (2, "same words here", "en", "s"), (2, "same words here", "en", "s"), (3, "other", "en", "s"), (3, "another text", "en", "s")]
    labels = labels_of(spark, [(1, 1, 1), (3, 0, 0), (3, 0, None), (9, 1, 1)])
    x, y, _ = toxicity.gathered(docs_of(rows), labels)
    assert y.tolist() == [1, 0]
    got = toxicity.op2_toxicity(spark, docs_of(rows), labels).collect()
    assert len(got) == 5 and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    assert bpe.op3_bpe(spark, none).count() == 0
    assert packing.op5_packed_ids(spark, none).count() == 0
    assert lm.op4_lm_score(spark, none).count() == 0
    assert ngram_join.op10_ngram_join(spark, none).count() == 0
    assert mixing.op8_mixing(spark, none).count() == 0
    assert langid.op9_language_id(spark, none).count() == 0
    assert toxicity.op2_toxicity(spark, none, labels_of(spark, [])).count() == 0


def packed_range(rng, flushes, per, top):
    """A range of signatures as the join's first pass packs it, and (flush, class, signature) of each."""
    data, flat = [], []
    for f in range(flushes):
        at = np.unique(rng.integers(0, top, per, dtype=np.uint64)).astype(np.uint32)
        who = rng.integers(0, 900, len(at)).astype(np.uint16)
        who[rng.random(len(at)) < 0.05] = 0xFFFF
        data.append(np.diff(at, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() + who.tobytes())
        flat += [(f, w, a) for w, a in zip(who.tolist(), at.tolist(), strict=True)]
    return pa.table({"flush": pa.array([f << 24 for f in range(flushes)], pa.int64()), "data": pa.array(data, pa.binary())}), flat


def test_join_counts_single_signatures():
    for flushes, per, top in ((1, 1, 5), (3, 50, 60), (5, 40_000, 2**32), (4, 40_000, 200_000)):
        table, flat = packed_range(np.random.default_rng(per), flushes, per, top)
        times = Counter(a for *_, a in flat)
        want = Counter((f, w) for f, w, a in flat if times[a] == 1 and w != 0xFFFF)
        got = {}
        for f, d in enumerate(ngram_join._single(table)["data"].to_pylist()):
            k = len(d) // 6
            got |= {(f, int(w)): int(c) for w, c in zip(np.frombuffer(d, np.uint16, k), np.frombuffer(d[2 * k :], np.uint32, k), strict=True)}
        assert got == want


def test_join_counts_in_little_memory():
    table, flat = packed_range(np.random.default_rng(3), 10, 50_000, 2**32)
    n = len(flat)
    del flat
    tracemalloc.start()
    ngram_join._single(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * n


def peak_mb(call):
    call()  # what is kept once, such as caches, doesn't count
    tracemalloc.start()
    call()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_bpe_merges_in_little_memory():
    merger = bpe.Merger(bpe.default_path())
    found = [(f"{i:06d}" * 7).encode() for i in range(20_000)]  # unseen words of 42 bytes
    assert peak_mb(lambda: merger.encode(found)) < 30
    assert "pair" not in vars(merger)


def test_toxicity_memo_in_little_memory():
    found = [f"{i:06d}"[::-1] + f"letters{i:06d}" for i in range(50_000)]

    def call():
        f = toxicity.Features()
        for k in range(0, len(found), 1000):
            f.add(found[k : k + 1000])

    assert peak_mb(call) < 10


def test_executors_get_small_batches(spark):
    from assetloom.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    spark.conf.unset(common.BATCH_KEY)
    docs = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "repeat('word and ', 300) as text", "'en' as lang")
    langid.identify(spark, docs, {})
    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * common.BATCH_BYTES
    spark.conf.set(common.BATCH_KEY, "8000000")
    langid.identify(spark, docs, {})
    assert spark.conf.get(common.BATCH_KEY) == "8000000"  # who set it knows why
    spark.conf.unset(common.BATCH_KEY)


def test_mixing_starts_no_python_worker(spark, monkeypatch):
    plans = {}

    def staged(session, df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return df

    monkeypatch.setattr(mixing, "staged", staged)
    docs = spark.sql("select id as doc_id, repeat('word ', 3) as text, 's' as source from range(9)")
    assert mixing.mixed(spark, docs).count() and "offsets" in plans and "RDD" not in plans["offsets"]
