"""Level measurement: dBFS, envelopes, speaking level and the policy on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.config import DEFAULTS

FLOOR = -120.0


def dbfs(x: Column) -> Column:
    """20 log10 of an amplitude, FLOOR at least; null and 0 give FLOOR."""
    return F.when(x > 0, F.greatest(F.lit(FLOOR), 20 * F.log10(x))).otherwise(F.lit(FLOOR))


def rms(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.greatest(F.size(values), F.lit(1)))


def rms_dbfs(values: Column) -> Column:
    return dbfs(rms(values))


def peak_dbfs(values: Column) -> Column:
    return dbfs(F.array_max(F.transform(values, lambda x: F.abs(x).cast("double"))))


def envelope(samples: DataFrame, window: int, keys: list[str], pos: str = "pos", value: str = "value", how: str = "rms") -> DataFrame:
    """(keys, window_idx, level): RMS or peak of each window of so many samples.

    A partial last window is left out, unless it is the only one. pos counts samples from 0.
    """
    level = F.sqrt(F.avg(F.col(value) * F.col(value))) if how == "rms" else F.max(F.abs(F.col(value)))
    each = samples.groupBy(*keys, F.floor(F.col(pos) / window).alias("window_idx")).agg(F.count("*").alias("_n"), level.alias("level"))
    return each.where((F.col("_n") == window) | (F.col("window_idx") == 0)).drop("_n")


def speaking_level(levels: DataFrame, keys: list[str], share: float = DEFAULTS.speaking_percentile) -> DataFrame:
    """(keys, speaking_level): the percentile, between neighbours by line, of the envelope."""
    return levels.groupBy(*keys).agg(F.percentile("level", F.lit(share)).alias("speaking_level"))


def level_policy(levels: DataFrame, level_db: str = "level_db", peak_db: str = "peak_db") -> DataFrame:
    """Adds shaped, reason, gate_db and compressor_db: quiet or empty audio is left as it is."""
    reason = F.when(F.col(level_db).isNull(), "empty audio").when(F.col(level_db) <= DEFAULTS.floor_dbfs, F.format_string("too quiet (%.1f dBFS)", level_db)).otherwise("")
    on = reason == ""
    return levels.withColumns({"shaped": on, "reason": reason, "gate_db": F.when(on, F.col(peak_db) + DEFAULTS.gate_db), "compressor_db": F.when(on, F.col(peak_db) + DEFAULTS.compressor_db)})


def gated_levels(samples: DataFrame, policy: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """policy with after_db: the level of the samples that are at the gate or over it; what was not shaped keeps its level."""
    own = samples.join(policy.select(*keys, "gate_db"), keys)
    loud = own.groupBy(*keys).agg(F.sqrt(F.avg(F.when(dbfs(F.abs(F.col(value))) >= F.col("gate_db"), F.col(value) * F.col(value)))).alias("_r"))
    return policy.join(loud, keys, "left").withColumn("after_db", F.when(F.col("shaped"), dbfs(F.coalesce("_r", F.lit(0.0)))).otherwise(F.col("level_db"))).drop("_r")


def level_stats(policy: DataFrame, keys: list[str], level_db: str = "level_db", after_db: str | None = None) -> DataFrame:
    """(keys, seen, shaped_n, too_quiet, empty): how many were shaped, and why the others were not. With after_db also by how much the level
    of the shaped ones moved, on average (0 without any) and at the most in both directions."""
    counts = [F.count("*").alias("seen"), F.count(F.when(F.col("shaped"), 1)).alias("shaped_n"), F.count(F.when(F.col("reason").startswith("too quiet"), 1)).alias("too_quiet"), F.count(F.when(F.col("reason") == "empty audio", 1)).alias("empty")]
    if after_db:
        gain = F.when(F.col("shaped"), F.col(after_db) - F.col(level_db))
        counts += [F.coalesce(F.avg(gain), F.lit(0.0)).alias("mean_gain_db"), F.min(gain).alias("least_gain_db"), F.max(gain).alias("most_gain_db")]
    return policy.groupBy(*keys).agg(*counts)


def signal_health(samples: DataFrame, keys: list[str], window: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """(keys, samples, clipped, silent_share, peak, level): silent windows are those whose peak is under 1e-4."""
    size = F.abs(F.col(value))
    each = samples.groupBy(*keys, F.floor(F.col(pos) / window).alias("_w")).agg(F.count("*").alias("n"), F.count(F.when(size >= 0.999, 1)).alias("c"), F.max(size).alias("p"), F.sum(size * size).alias("q"))
    return each.groupBy(*keys).agg(F.sum("n").alias("samples"), F.sum("c").alias("clipped"), F.avg((F.col("p") < 1e-4).cast("int")).alias("silent_share"), F.max("p").alias("peak"), F.sqrt(F.sum("q") / F.sum("n")).alias("level"))


def compare_levels(before: DataFrame, after: DataFrame, keys: list[str], most_loss_db: float = 3.0, least_gain_db: float = 6.0) -> DataFrame:
    """What a treatment does: (keys, kept_db, removed_db, separates). Inputs: keys, dominant_db, bleed_db."""
    both = before.alias("b").join(after.alias("a"), keys)
    kept, removed = F.col("a.dominant_db") - F.col("b.dominant_db"), F.col("b.bleed_db") - F.col("a.bleed_db")
    return both.select(*keys, kept.alias("kept_db"), removed.alias("removed_db"), ((F.abs(kept) <= most_loss_db) & (removed >= least_gain_db)).alias("separates"))
