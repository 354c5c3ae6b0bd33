"""Chunk tables and the message contract: scans, checks, JSON both ways, protocol rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS

CHUNKS = "session_id string, seq long, arrived_at timestamp, pcm binary"
# The kinds of message and their fields.
KINDS = ["hello", "bye", "ready", "vad", "utterance", "partial", "final", "translation", "speakers", "error"]
FIELDS = {
    "hello": "session_id string, protocol_version int, sample_rate int, channels int, sample_width int, chunk_ms int, client string",
    "bye": "reason string",
    "ready": "session_id string, protocol_version int, sample_rate int, chunk_bytes int",
    "vad": "event string, at_ms double",
    "utterance": "index long, start_ms double, end_ms double, duration_ms double, reason string, continues_previous boolean, kept boolean, label string, speech_score double, speaker_id string, lang_code string",
    "partial": "speaker_id string, lang_code string, transcript string",
    "final": "sentence_id long, speaker_id string, lang_code string, transcript string, speech_score double",
    "translation": "sentence_id long, translation string, reason string, raw string",
    "speakers": "labels map<string,string>",
    "error": "message string, fatal boolean",
}
HELLO = {"protocol_version": 1, "sample_rate": 16_000, "channels": 1, "sample_width": 2, "chunk_ms": 200, "client": ""}


def read_chunks(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The chunk table, or a stream of its files."""
    return (spark.readStream if streaming else spark.read).schema(CHUNKS).parquet(path)


def count_chunks(chunks: DataFrame, key: str = "session_id", pcm: str = "pcm") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length(pcm)), F.lit(0)).cast("long").alias("bytes"))


def with_reason(df: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """Adds problem: the text of the first rule (holds, text) that does not hold, '' if all do; null counts as not."""
    out = F.lit("")
    for holds, text in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), text).otherwise(out)
    return df.withColumn("problem", out)


def split_valid(df: DataFrame, rules: list[tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows without a problem, rows with their problem)."""
    marked = with_reason(df, rules)
    return marked.where("problem = ''").drop("problem"), marked.where("problem <> ''")


def chunk_rule(size: int = DEFAULTS.chunk_bytes, pcm: str = "pcm") -> tuple[Column, Column]:
    n = F.octet_length(pcm)
    return n == size, F.concat(F.lit("a chunk must have "), F.lit(size), F.lit(" bytes, not "), F.coalesce(n, F.lit(0)))


def contract_mismatch(df: DataFrame, expected: dict) -> DataFrame:
    """Adds mismatch: every field that differs from what is expected, joined with '; '."""
    told = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(f", expected {v}"))) for c, v in expected.items()]
    return df.withColumn("mismatch", F.array_join(F.filter(F.array(*told), lambda x: x.isNotNull()), "; "))


def parse_messages(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds kind and problem: not valid JSON, not an object, or unknown type."""
    v = F.try_parse_json(raw)
    kind = F.try_variant_get(v, "$.type", "string")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    problem = F.when(v.isNull(), "not valid JSON").when(~is_object, "not an object").when(~F.coalesce(kind.isin(KINDS), F.lit(False)), "unknown type").otherwise("")
    return df.withColumns({"kind": F.when(problem == "", kind), "problem": problem})


def typed(messages: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """The messages of one kind with their fields as columns; unknown fields are dropped."""
    other = [c for c in messages.columns if c not in (raw, "kind", "problem")]
    return messages.where(F.col("kind") == kind).select(*other, F.from_json(raw, FIELDS[kind]).alias("m")).select(*other, "m.*")


def parse_hello(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed hellos with defaults filled, and problem where the session id is no text or empty."""
    other = [c for c in messages.columns if c not in (raw, "kind", "problem")]
    own = messages.where("kind = 'hello'").withColumn("m", F.from_json(raw, FIELDS["hello"]))
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.session_id", "variant")) == "STRING"
    ok = F.coalesce(is_text, F.lit(False)) & (F.length(F.trim("m.session_id")) > 0)
    return own.select(*other, F.col("m.session_id").alias("hello_id"), *(F.coalesce(F.col(f"m.{c}"), F.lit(v)).alias(c) for c, v in HELLO.items()), F.when(ok, "").otherwise("session_id must be a text that is not empty").alias("problem"))


def to_messages(df: DataFrame, kind: str) -> Column:
    """JSON of one kind from columns of its field names: times to 1 decimal, an utterance's speech_score to 3."""
    names = [f.split()[0] for f in FIELDS[kind].split(", ")]
    def value(c):
        if c.endswith("_ms") and kind in ("vad", "utterance"):
            return F.bround(F.col(c), 1).alias(c)
        return (F.bround(F.col(c), 3) if c == "speech_score" and kind == "utterance" else F.col(c)).alias(c)

    return F.to_json(F.struct(F.lit(kind).alias("type"), *(value(c) for c in names)), {"ignoreNullFields": "false"})


def protocol_violations(log: DataFrame, key: str = "session_id", order: str = "seq", kind: str = "kind") -> DataFrame:
    """(session, order, kind, violation) of a client's log; kind 'audio' stands for a chunk."""
    by = W.partitionBy(key).orderBy(order)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    seen = lambda k: F.coalesce(F.max((F.col(kind) == k).cast("int")).over(before), F.lit(0)) == 1
    own = log.select(key, order, kind, seen("hello").alias("_h"), seen("bye").alias("_b"))
    k = F.col(kind)
    told = F.when(F.col("_b"), "after close").when((k == "hello") & F.col("_h"), "second hello").when((k == "audio") & ~F.col("_h"), "audio before hello").when(~k.isin("audio", "hello", "bye"), "not for a client to send")
    return own.withColumn("violation", told).where("violation is not null").drop("_h", "_b")
