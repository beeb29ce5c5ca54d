"""The pipeline's stages, each against what it should do to its own input, and all together."""

from ast import literal_eval as literal
from collections import Counter

import pytest

import corpus_pipeline
from assetloom.llm import langid, registry, toxicity
from tests.llm.conftest import prose
from tests.llm.test_text_operators import brute_components, tokens


@pytest.fixture(scope="module")
def folder(spark, docs_of, odd_rows, tmp_path_factory):
    rows = odd_rows + [(2000 + i, prose("en" if i % 2 else "de", f"p{i}", 90) + (" you idiot scum" if i % 5 == 0 else ""), "en" if i % 2 else "de", f"s{i % 3}") for i in range(150)]
    rows += [(3000 + i, prose("en", "p7", 90) + f" tail{i}", "en", "s1") for i in range(5)]
    d = str(tmp_path_factory.mktemp("data"))
    docs_of(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(2000 + i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def kept_by_hand(rows):
    """One row of each component: the smallest id, null last; rows are nodes by their places."""
    component = [literal(x)[2] for x in brute_components([(i, *r[1:]) for i, r in enumerate(rows)])]
    at = dict(zip([literal(x)[0] for x in brute_components([(i, *r[1:]) for i, r in enumerate(rows)])], component, strict=True))
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, i)
        best[at[i]] = min(key, best.get(at[i], key))
    return [rows[k[2]] for k in best.values()]


def listed(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns, name
        seen.append((docs, out))
        docs = out

    before, after = seen[0]  # what the classifier rejects, by hand
    model = langid.Classifier(langid.fit(before))
    want = [r for r in before.collect() if (m := model.margin(r["text"]))[0] != langid.UND and m[1] / 0.1 >= 0.02]
    assert listed(after) == sorted(repr(tuple(r)) for r in want)

    before, after = seen[1]
    scores = toxicity.score(spark, before, toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet")))
    assert listed(after) == sorted(repr(tuple(r)[:-1]) for r in scores.collect() if r["score"] < 0.5)
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert len(gone & {2000 + 5 * i for i in range(30)}) >= 28 and len(gone) <= 32

    before, after = seen[2]
    assert sorted(map(repr, map(tuple, after.collect()))) == sorted(map(repr, kept_by_hand([tuple(r) for r in before.collect()])))

    before, after = seen[3]
    times = Counter(map(repr, (tuple(r) for r in after.collect())))
    total = sum(len(tokens(r["text"])) for r in before.collect())
    assert set(times) <= set(listed(before)) and max(times.values()) <= 3
    assert 0.7 * total < sum(len(tokens(r["text"])) for r in after.collect()) <= total

    before, after = seen[4]
    assert after.count() == before.count() and {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} <= set(after.columns)


def test_run_repeats_itself(spark, folder):
    a = corpus_pipeline.run(spark, folder)
    assert a.count() and listed(a.select("doc_id", "ids_sha256")) == listed(corpus_pipeline.run(spark, folder).select("doc_id", "ids_sha256"))


def test_stages_on_an_empty_table_and_with_clashing_columns(spark, folder, docs_of, tmp_path):
    names = ("n_tokens", "ids", "score", "lang_pred", "size", "n", "component_id", "class", "key", "block", "Label")
    wide = spark.read.parquet(f"{folder}/documents.parquet").limit(60).selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(names)])
    for rows in (wide, wide.limit(0)):
        d = str(tmp_path / f"d{rows.count()}")
        rows.write.parquet(f"{d}/documents.parquet")
        spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d)
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "component_id", "Label"} <= set(out.columns)
        assert (out.count() > 0) == (rows.count() > 0)


def test_registry():
    assert sorted(registry.queries()) == sorted(["pipeline", *(f"op{n}_{x}" for n, x in {1: "exact_top_k", 2: "toxicity", 3: "bpe", 4: "lm_score", 5: "packed_ids", 6: "near", 7: "html_text", 8: "mixing", 9: "language_id", 10: "ngram_join", 11: "pivot_near_dup", 12: "filter_audit", 13: "periodic_runs"}.items())])


def test_near_duplicates_are_rows_not_ids(spark, docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (7, c, "en", "s"), (7, c, "de", "s"), (None, c + " x", "en", "s"), (None, "q w e r t y u i", "en", "s"), (None, "q w e r t y u i", "en", "s"), (8, "", "en", "s"), (8, "", "en", "s")]
    got = corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(3, a), (5, b), (7, c), (None, "q w e r t y u i"), (8, ""), (8, "")], key=repr)
    assert got[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_free_what_they_worked_with(spark, folder, monkeypatch):
    from assetloom.llm import common

    gone, destroyed = [], []
    remove = common._remove
    monkeypatch.setattr(common, "_remove", lambda s, p: gone.append(p) or remove(s, p))
    monkeypatch.setattr(common.Broadcast, "destroy", lambda self, blocking=False: destroyed.append(self))
    out = corpus_pipeline.run(spark, folder)
    assert len(gone) > 10 and len(destroyed) >= 3 and not common._working
    assert out.count() > 0  # the result's own table stays
