"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text is
compressed with each dictionary, whole, in pieces of ``piece`` bytes (so that the dictionary counts throughout a long
text), and the language whose dictionary gives the fewest bytes is taken. The margin is the part by which the best
size is below the second; documents with a narrow margin are rejected.

Parameters that bound the fit: a language's dictionary holds whole texts, ``sample_docs`` of them at most, in the order of
a hash, each of at most ``longest`` bytes and as many as ``dict_bytes`` have room for; a language without a text that
short has its shortest one. Everything else covers all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; equal sizes go to the
language with the most labelled rows, then by name; with one language only, the margin is 1; with no labelled row every text is ``und``;
repeated rows each have their own result, texts of any length are read whole, an empty table gives no rows.
Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import fold, released, sent, slices, small_batches

UND = "und"
#: Digits, ASCII punctuation and white space tell nothing about a language.
_PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower-cased letters; runs of anything else in ASCII become one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 200, longest: int = 16_000, dict_bytes: int = 112_000) -> dict[str, bytes]:
    """Dictionary contents by language, the commonest language first."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"), F.octet_length(text).alias("size"))
    fits = F.col("size") <= longest
    count = {r["lang"]: r for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(fits).alias("short"), F.min(F.struct("size", "h")).alias("least")).collect()}  # one row a language
    if not count:
        return {}
    unit = (F.shiftrightunsigned(F.col("h"), 11).cast("double")) / F.lit(float(2**53))
    rate = F.create_map(*[F.lit(x) for k, r in sorted(count.items()) for x in (k, min(1.0, 1.5 * sample_docs / max(1, r["short"])))])
    rows = known.where(fits & (unit < rate[F.col("lang")])).select("lang", "h", "text").distinct()
    if alone := [(k, *r["least"]) for k, r in count.items() if not r["short"]]:
        rows = rows.union(known.join(F.broadcast(known.sparkSession.createDataFrame(alone, "lang string, size int, h long")), ["lang", "size", "h"]).select("lang", "h", "text").distinct())
    out: dict[str, list[bytes]] = {k: [] for k in sorted(count)}
    room = dict.fromkeys(count, dict_bytes)
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):  # about 1.5 * sample_docs texts a language
        k, data = r["lang"], plain(r["text"])
        if len(out[k]) < sample_docs and (len(data) < room[k] or not out[k]):
            out[k].append(data)
            room[k] -= len(data) + 1
    return {k: b" ".join(out[k]) for k in sorted(count, key=lambda k: (-count[k]["n"], k))}


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = 7, piece: int = 1500):
        self.langs, self.piece = list(content), piece
        self.coders = []
        for k in self.langs:
            d = zstd.ZstdCompressionDict(content[k] or b" ", dict_type=zstd.DICT_TYPE_RAWCONTENT)
            p = zstd.ZstdCompressionParameters.from_level(level, dict_size=len(content[k]), source_size=piece, write_content_size=0, write_dict_id=0)
            d.precompute_compress(compression_params=p)
            self.coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=p))

    def margin(self, text: str | None) -> tuple[str, float]:
        """Language and margin."""
        data = plain(text) if text else b""
        if not self.langs or not data or not any(c.isalpha() for c in text):
            return UND, 0.0
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        size = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        best = min(range(len(size)), key=size.__getitem__)
        second = min((s for i, s in enumerate(size) if i != best), default=None)
        return self.langs[best], 1.0 if second is None else (second - size[best]) / second


def identify(spark: SparkSession, docs: DataFrame, content: dict[str, bytes], text: str = "text", wide: float = 0.1) -> DataFrame:
    """docs with lang_pred and score: the margin in units of ``wide``, at most 1."""
    shared = sent(spark, content)  # dict_bytes a language
    small_batches(spark)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for b in slices(batches, text):
            found = [model.margin(x) for x in b.column(at).to_pylist()]
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array(np.minimum([m / wide for _, m in found], 1.0), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, score], names=[*b.schema.names, "lang_pred", "score"])
        del model
        released()

    return docs.mapInArrow(run, schema)


def kept(spark: SparkSession, docs: DataFrame, least_score: float = 0.02, **names) -> DataFrame:
    """The rows that are not rejected, with the columns of docs. Labels come from all rows of docs that have one."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])  # names may clash
    text = f"c{docs.columns.index(names.get('text', 'text'))}"
    out = identify(spark, rows, fit(docs, **names), text)
    return out.where((F.col("lang_pred") != UND) & (F.col("score") >= least_score)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    content = fit(docs.where(fold("doc_id", 3) != 1))
    rows = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return identify(spark, rows, content).drop("text")
