"""Sums of doubles that are those of SQL, which adds up the rows of a session in their order."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from parley.operators import quality as ql

COLUMNS = "session_id long, seq long, item_id long, stage string, seconds double"


def timings(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).coalesce(1).withColumn("audio_seconds", F.lit(0.2))


def test_share_of_audio_added_up_in_order(spark):
    seconds = [0.35, 0.3517, 0.1, 0.2, 0.7, 0.1, 0.35, 0.3, 0.15, 0.4, 0.45, 0.25, 0.6, 0.33, 0.5, 0.5]
    rows = [(1, i, i // 4, "a", s) for i, s in enumerate(seconds)]
    want = reduce(add, seconds)
    audio = reduce(add, [0.2] * 16)
    assert audio != 3.2
    for own in (rows, rows[::-1], rows[8:] + rows[:8]):
        assert [(r.seconds, r.share, r["rank"]) for r in ql.stage_cost(timings(spark, own), order="seq").collect()] == [(want, want / audio, 1)]


def test_items_at_the_limit_and_worst_stage_in_order(spark):
    # 0.7 + 0.1 + 0.1 + 0.1 stays below 1 as doubles, 0.1 + 0.1 + 0.1 + 0.7 does not; 0.1 + 0.2 is more than 0.3
    rows = [(1, i, 0, "a", s) for i, s in enumerate((0.7, 0.1, 0.1, 0.1))] + [(2, i, 0, "a", s) for i, s in enumerate((0.1, 0.1, 0.1, 0.7))]
    rows += [(3, 0, 0, "a", 0.1), (3, 1, 0, "a", 0.2), (3, 2, 0, "b", 0.3), (3, 3, 0, "c", 0.25), (3, 4, 0, "d", 0.25)]
    # the stages of an item are added up as they begin
    rows += [(4, i, 0, "dcba"[i], s) for i, s in enumerate((0.7, 0.1, 0.1, 0.1))] + [(5, i, 0, "abcd"[i], s) for i, s in enumerate((0.1, 0.1, 0.1, 0.7))]
    for own in (rows, rows[::-1]):
        got = {r.session_id: (r.total, r.worst, sorted(r.breakdown)) for r in ql.slow_items(timings(spark, own), ["session_id", "item_id"], 1.0, order="seq").collect()}
        assert got == {2: (1.0, "a", ["a"]), 3: (reduce(add, (0.1 + 0.2, 0.3, 0.25, 0.25)), "a", ["a", "b", "c", "d"]), 5: (1.0, "d", ["a", "b", "c", "d"])}


def test_the_queries_have_the_sums_of_their_sql(spark, tmp_path):
    import duckdb
    import random

    from parley.plans import session_queries as sq

    draw, folder = random.Random(3), str(tmp_path)
    rows = [(i, i * 1_000_003, draw.randrange(60), draw.choice(["view", "click", "error"]), round(draw.expovariate(0.02), 2)) for i in range(4_000)]
    t = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double").select("event_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    t.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view events as select * from '{folder}/events.parquet/*.parquet'")
    for name in ("stage_cost", "slow_items"):
        want = con.execute(sq.SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(tuple(r) for r in sq.QUERIES[name](spark, folder).select(*columns).collect()) == sorted(want.fetchall())
