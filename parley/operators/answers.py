"""Translation answers: history, prompts, inference, judgement, lateness and statistics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parley.config import DEFAULTS
from parley.functions.text import clean_answer, is_echo, wrong_script

PAIRS = {"vi": "ja", "ja": "vi"}
NAMES = {"vi": "Vietnamese", "ja": "Japanese"}
EXPANSION = {"vi": 2.0, "ja": 1.0}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def target_language(lang: Column, pairs: dict = PAIRS) -> Column:
    return F.coalesce(_lookup(pairs, lang), F.lit(""))


def turn_history(df: DataFrame, fields: list[str], key: str = "session_id", order: str = "sentence_id", n: int = DEFAULTS.history) -> DataFrame:
    """Adds history: the n turns before, oldest first, as structs of fields."""
    by = W.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("history", F.collect_list(F.struct(*fields)).over(by))


def render_history(history: Column, style: str = "sources", speaker: str = "speaker_id", source: str = "transcript", answer: str = "translation") -> Column:
    """plain: source => answer; labelled: speaker: source => answer; sources: sources alone. One line a turn."""
    line = {
        "plain": lambda t: F.concat(t[source], F.lit(" => "), t[answer]),
        "labelled": lambda t: F.concat(t[speaker], F.lit(": "), t[source], F.lit(" => "), t[answer]),
        "sources": lambda t: t[source],
    }[style]
    return F.array_join(F.transform(history, line), "\n")


def build_prompts(df: DataFrame, lang: str = "lang_code", text: str = "transcript", history: str | None = "history_text", names: dict = NAMES, pairs: dict = PAIRS, short: int = 12) -> DataFrame:
    """Adds target, system_prompt and user_prompt; '' where there is nothing to ask."""
    target = target_language(F.col(lang), pairs)
    name = lambda c: F.coalesce(_lookup(names, c), c)
    hint = F.when(F.length(F.trim(text)) < short, " The line is short; translate it as it stands.").otherwise("")
    system = F.concat(F.format_string("Translate %s into %s. Answer with the translation only.", name(F.col(lang)), name(target)), hint)
    before = F.when(F.length(history) > 0, F.concat(F.lit("Earlier lines:\n"), F.col(history), F.lit("\n\n"))).otherwise("") if history else F.lit("")
    ask = (target != "") & (F.trim(text) != "")
    return df.withColumns({"target": target, "system_prompt": F.when(ask, system).otherwise(""), "user_prompt": F.when(ask, F.concat(before, F.lit("Line:\n"), F.trim(text))).otherwise("")})


def infer(df: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[str]]], system: str = "system_prompt", user: str = "user_prompt") -> DataFrame:
    """Adds raw and error. make() gives a client once per partition; it answers lists of (system, user).

    A batch that fails is asked again line by line, and a line that fails gets its reason as error.
    Columns of the names raw and error are replaced.
    """
    own = df.drop("raw", "error")
    schema = StructType([*own.schema.fields, StructField("raw", StringType()), StructField("error", StringType())])

    def run(parts):
        client = make()
        for rows in parts:
            asks = list(zip(rows[system], rows[user], strict=True))
            try:
                raw, error = list(client(asks)), [""] * len(asks)
            except Exception:
                raw, error = [], []
                for a in asks:
                    try:
                        raw.append(client([a])[0])
                        error.append("")
                    except Exception as e:
                        raw.append(None)
                        error.append(f"{type(e).__name__}: {e}")
            yield rows.assign(raw=pd.Series(raw, index=rows.index, dtype=object), error=pd.Series(error, index=rows.index, dtype=object))

    return own.mapInPandas(run, schema)


def too_long(source: Column, answer: Column, target: Column, ratios: dict = EXPANSION) -> Column:
    ratio = _lookup(ratios, target)
    return F.coalesce(F.length(answer) > F.length(source) * ratio + DEFAULTS.extra_chars, F.lit(False))


def judge_answer(df: DataFrame, source: str = "transcript", target: str = "target", raw: str = "raw") -> DataFrame:
    """Adds translation ('' if refused) and reason; the raw answer stays."""
    text = clean_answer(F.col(raw))
    own = df.withColumn("_t", text)
    t, s, g = F.col("_t"), F.col(source), F.col(target)
    reason = (
        F.when(F.coalesce(F.trim(s), F.lit("")) == "", "nothing to translate").when(g == "", "the language was undecided").when(t == "", "there is no answer")
        .when(is_echo(s, t), "the answer repeats the source").when(wrong_script(t, g, DEFAULTS.wrong_script), F.concat(F.lit("the answer is not written in "), g)).when(too_long(s, t, g), "the answer is too long").otherwise("")
    )
    return own.withColumns({"reason": reason, "translation": F.when(reason == "", t).otherwise("")}).drop("_t")


def retry_echoes(judged: DataFrame, make, keys: list[str], text: str = "transcript", lang: str = "lang_code") -> DataFrame:
    """Asks echoes again without history, once; adds retried and rescued, and adopts only a clean answer."""
    echo = F.col("reason") == "the answer repeats the source"
    again = build_prompts(judged.where(echo).select(*keys, text, lang), lang, text, None)
    again = judge_answer(infer(again, make), text).where("reason = ''").select(*keys, F.col("translation").alias("_t"), F.col("raw").alias("_r"))
    out = judged.join(again, keys, "left").withColumns({"retried": echo, "rescued": F.col("_t").isNotNull()})
    return out.withColumns({"translation": F.coalesce("_t", "translation"), "raw": F.coalesce("_r", "raw"), "reason": F.when(F.col("rescued"), "").otherwise(F.col("reason"))}).drop("_t", "_r")


def translation_stats(judged: DataFrame, key: str = "session_id") -> DataFrame:
    has = lambda r: F.count(F.when(F.col("reason") == r, 1))
    return judged.groupBy(key).agg(F.count("*").alias("seen"), has("").alias("translated"), F.count(F.when(F.col("reason") != "", 1)).alias("refused"), has("the answer repeats the source").alias("echoes"), has("the answer is too long").alias("too_long"), F.count(F.when(F.col("reason").startswith("the answer is not"), 1)).alias("wrong_script"))


def drop_stale(jobs: DataFrame, submitted: str = "submitted_at", taken: str = "taken_at", budget_s: float = DEFAULTS.max_lag_s) -> DataFrame:
    """Adds age_s, stale and reason: a job older than the budget when it is taken is dropped."""
    age = (F.unix_micros(F.col(taken).cast("timestamp")) - F.unix_micros(F.col(submitted).cast("timestamp"))) / F.lit(1_000_000.0)
    stale = age > budget_s
    return jobs.withColumns({"age_s": age, "stale": stale, "reason": F.when(stale, F.format_string("too late (%.0f s)", F.floor(age).cast("double"))).otherwise("")})


def bounded_backlog(jobs: DataFrame, key: str = "session_id", order: str = "sentence_id", waiting: str = "waiting", depth: int = DEFAULTS.backlog) -> DataFrame:
    """Adds reason: of the jobs of a session that wait, all but the newest depth are evicted."""
    by = W.partitionBy(key, waiting).orderBy(F.desc(order))
    return jobs.withColumn("_n", F.row_number().over(by)).withColumn("reason", F.when(F.col(waiting) & (F.col("_n") > depth), "evicted: too many waiting").otherwise("")).drop("_n")


def answer_leftovers(jobs: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason): jobs that nobody answered before the session ended."""
    return jobs.join(answers.select(*keys), keys, "left_anti").select(*keys, F.lit("the session ended first").alias("reason"))


def answer_status(finals: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, lag_s): translated, refused or never answered."""
    lag = (F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("arrived_at").cast("timestamp"))) / F.lit(1_000_000.0)
    own = finals.select(*keys, "arrived_at").join(answers.select(*keys, "translation", F.col("arrived_at").alias("_at")), keys, "left")
    status = F.when(F.col("_at").isNull(), "never answered").when(F.coalesce(F.trim("translation"), F.lit("")) == "", "refused").otherwise("translated")
    return own.select(*keys, status.alias("status"), lag.alias("lag_s"))


def expansion_stats(judged: DataFrame, keys: list[str], source: str = "transcript", answer: str = "translation") -> DataFrame:
    """(keys, n, least, median, most): how many times its source's length an answer has."""
    own = judged.where((F.length(answer) > 0) & (F.length(source) > 0)).withColumn("_x", F.length(answer) / F.length(source))
    return own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("least"), F.percentile("_x", F.lit(0.5)).alias("median"), F.max("_x").alias("most"))
