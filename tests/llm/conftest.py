import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text, lang, source) rows; n_chars follows."""

    def make(rows):
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)

    return make


WORDS = {"en": "the of and to in is that was for it with as his on be at by this had not are but from or have".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split()}


def prose(lang, seed, n=60):
    import random

    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) + ("" if r.random() < 0.7 else r.choice(WORDS[lang])) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    rows = [(i, prose("en" if i % 3 else "de", i), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    rows += [(60, None, "en", "s0"), (61, "", "de", "s1"), (62, " \t\n", None, None), (63, "12345 !!! ...", "en", None), (None, prose("en", 7), "en", "s1"), (64, prose("de", 3), None, "s2")]
    rows += [(65, prose("en", 1) + " Z", "en", "s1"), (66, prose("en", 1), "en", "s2"), (66, prose("en", 1), "en", "s2"), (67, "word " * 30_000, "en", "s3"), (68, "x" * 200_000, "en", "s0"), (69, "日本語 テキスト \U0001f389 é İstanbul ΑΣ's", None, "s3")]
    return rows
