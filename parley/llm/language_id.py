"""Language identification by compression with a dictionary per language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import table

#: Bytes of learned text per language: the bound of the sample that is fitted.
DICTIONARY_BYTES = 65_536
#: Characters of one document that may enter a dictionary, so that it draws on many documents: a stretch of the text
#: whose place is drawn by a hash of it.
PIECE = 1_024
#: Bytes of a text's letters that are compressed at a time, each with the dictionary: what that saves is bounded, so
#: a margin over one code of a long text would fall with its length.
CODE_BYTES = 16_384
#: A language is accepted if its code is shorter than the next one's by this share.
MIN_MARGIN = 0.002
#: Languages that may be told apart.
MAX_LANGUAGES = 512
LEVEL = 6
LETTERS = re.compile(r"[^\W\d_]+")


def normal(text: str) -> bytes:
    """Runs of letters, in lower case: what languages differ in."""
    return " ".join(LETTERS.findall(text)).lower().encode()


def learn(labelled: DataFrame, size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """A raw-content dictionary per language, from a bounded sample of labelled rows.

    labelled: text, lang; rows where either is null or empty are skipped, a text is learned once however
    often it is repeated. Of each language a stretch of the first text of each bin of a hash comes in, until size bytes are
    full. The languages are told in order of their learned rows, the commonest first.
    """
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - PIECE + 1, F.lit(1))).cast("int") + 1
    rows = labelled.select("lang", F.substr("text", at, F.lit(PIECE)).alias("piece")).where("lang is not null and length(piece) > 0")
    rows = rows.withColumn("h", F.xxhash64("piece", "lang"))
    bins = F.pmod("h", F.lit(4 * size // PIECE))
    few = rows.groupBy("lang", bins.alias("bin")).agg(F.min(F.struct("h", "piece")).alias("least"), F.count("*").alias("n"))
    got = few.limit(MAX_LANGUAGES * (4 * size // PIECE) + 1).collect()
    texts: dict[str, list] = {}
    counts: dict[str, int] = {}
    for r in sorted(got, key=lambda r: r.least):
        texts.setdefault(r.lang, []).append(normal(r.least.piece))
        counts[r.lang] = counts.get(r.lang, 0) + r.n
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [(lang, b" ".join(texts[lang])[:size]) for lang in sorted(texts, key=lambda x: (-counts[x], x))]


def identify(docs: DataFrame, model: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds lang_pred, score, margin and accepted to documents.

    The letters of each whole text are compressed with each language's dictionary, CODE_BYTES at a time, and the lengths
    of the codes are summed, so that the margin does not depend on the length; the shortest code wins, ties go to the
    language that comes first in the model. margin: the share by which the next code is longer; score: margin / (margin + min_margin), from 0 to 1. accepted is false where the margin
    is under min_margin. A text that is null, empty or without a letter gets und, score 0 and is not accepted, and so do
    all texts of a model without languages. Other columns stay as they are.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL("lang_pred string, score double, margin double, accepted boolean")

    def told(batches):
        langs = [lang for lang, _ in model]
        coders = []
        for _, raw in model:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            pred, score, margins, ok = [], [], [], []
            for value in batch.column(place):
                text = value.as_py()
                raw = normal(text) if text else b""
                if not coders or not any(map(str.isalpha, raw.decode())):
                    pred.append("und"), score.append(0.0), margins.append(0.0), ok.append(False)
                    continue
                parts = [raw[at : at + CODE_BYTES] for at in range(0, len(raw), CODE_BYTES)]
                sizes = np.array([sum(len(c.compress(part)) for part in parts) for c in coders], dtype=float)
                order = np.argsort(sizes, kind="stable")
                margin = 1.0 if len(order) == 1 else float(sizes[order[1]] / sizes[order[0]] - 1)
                pred.append(langs[order[0]]), margins.append(margin), ok.append(margin >= min_margin)
                score.append(margin / (margin + min_margin) if margin else 0.0)
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margins, pa.float64()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *fields.names])

    own = docs.drop(*(c for c in docs.columns if c in fields.names))
    place = own.columns.index("text")
    sent = own.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own.columns)))
    schema = StructType([*sent.schema.fields, *fields.fields])
    return sent.mapInArrow(told, schema).toDF(*own.columns, *fields.names)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: learned from the documents that are not held out, told of all."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")
