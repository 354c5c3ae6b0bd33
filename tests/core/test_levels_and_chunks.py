"""Levels before and after a gate, halves of sentences, chunk tables, and files by meeting."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import levels as lv
from parley.operators import voices as vc
from parley.sources import contract as ct
from parley.sources import sinks


def test_gain_of_gated_levels(spark):
    rows = [(1, v) for v in (0.5, -0.5, 0.01, 0.0)] + [(2, v) for v in (0.25, 0.25)] + [(3, 0.5)]
    samples = spark.createDataFrame(rows, "utt int, value double")
    policy = spark.createDataFrame([(1, -9.0, True, -18.0, ""), (2, -12.0412, True, -10.0, ""), (3, -60.0, False, None, "too quiet (-60.0 dBFS)"), (4, None, False, None, "empty audio")], "utt int, level_db double, shaped boolean, gate_db double, reason string")
    own = lv.gated_levels(samples, policy, ["utt"])
    after = {r.utt: r.after_db for r in own.collect()}
    # two of four samples pass; none passes; not shaped; no samples
    assert after == {1: pytest.approx(-6.0206, abs=1e-4), 2: -120.0, 3: -60.0, 4: None}
    r = lv.level_stats(own, [], after_db="after_db").first()
    assert (r.seen, r.shaped_n, r.too_quiet, r.empty) == (4, 2, 1, 1)
    assert r.most_gain_db == pytest.approx(2.9794, abs=1e-4) and r.least_gain_db == pytest.approx(-107.9588) and r.mean_gain_db == pytest.approx((r.most_gain_db + r.least_gain_db) / 2)
    assert lv.level_stats(policy.where("not shaped"), []).columns == ["seen", "shaped_n", "too_quiet", "empty"]


def test_halves_and_counts_of_labels(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.0, 0.0]), (3, 1, [1.0, 0.0])]
    got = {r.s: r.similarity for r in vc.half_similarity(spark.createDataFrame(rows, "s int, half int, embedding array<double>"), ["s"]).collect()}
    assert got == pytest.approx({1: 2**-0.5, 3: 0.0})
    df = spark.createDataFrame([("a", "Speaker_01"), ("b", "Speaker_02"), ("b", vc.UNKNOWN), ("b", "Speaker_02")], "who string, label string")
    assert tuple(vc.label_count(df, "who").first()) == (2, 2, True)
    assert tuple(vc.label_count(df.where("who = 'b'"), "who").first()) == (1, 1, True)
    assert tuple(vc.label_count(df.where("label = 'Speaker_unknown'"), "who").first()) == (1, 0, False)


def test_chunk_tables_and_streams(spark, tmp_path):
    rows = [("a", 0, dt.datetime(2024, 1, 1), b"12"), ("a", 1, dt.datetime(2024, 1, 1), b""), ("b", 0, None, None)]
    spark.createDataFrame(rows, ct.CHUNKS).write.parquet(f"{tmp_path}/c")
    want = [("a", 2, 2), ("b", 1, 0)]
    assert sorted(tuple(r) for r in ct.count_chunks(ct.read_chunks(spark, f"{tmp_path}/c")).collect()) == want
    stream = ct.count_chunks(ct.read_chunks(spark, f"{tmp_path}/c", streaming=True))
    q = stream.writeStream.format("memory").queryName("chunk_counts_live").outputMode("complete").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("chunk_counts_live").collect()) == want


def test_rows_are_written_by_meeting(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 3, 5, 9, 7, 1)), (2, dt.datetime(2024, 3, 5, 9, 7, 1)), (3, dt.datetime(2025, 1, 1))], "id int, began timestamp")
    sinks.write_by_meeting(df, f"{tmp_path}/m", "began")
    sinks.write_by_meeting(df.where("id = 3"), f"{tmp_path}/m", "began")
    assert sorted(p.name for p in tmp_path.joinpath("m").glob("meeting=*")) == ["meeting=2024-03-05_090701", "meeting=2025-01-01_000000"]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/m").where("meeting = '2025-01-01_000000'").collect()) == [3, 3]


def test_separation_by_tiles_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, rng.normal(size=4).round(1).tolist(), f"v{rng.integers(k)}") for s, n, k in ((1, 70, 3), (2, 9, 2), (3, 4, 1), (4, 3, 50), (5, 2, 50)) for i in range(n)]
    # repeated and opposite vectors: ties in bins and at both ends
    rows += [(6, i, [1.0, 0.0, 0.0, 0.0] if i % 3 else [-1.0, 0.0, 0.0, 0.0], f"v{i % 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "session_id int, sentence_id long, embedding array<double>, label string").repartition(4)
    pairs = vc.pairwise(df)
    label = {(r[0], r[1]): r[3] for r in rows}
    same = spark.createDataFrame([(s, a, b, label[s, a] == label[s, b]) for s in range(1, 7) for a in range(70) for b in range(a + 1, 70) if (s, a) in label and (s, b) in label], "session_id int, a long, b long, same boolean")
    want = {r.session_id: r for r in vc.separation(pairs.join(same, ["session_id", "a", "b"]), ["session_id"], F.col("same")).collect()}
    for tile, bins in ((256, 1024), (16, 3)):
        got = {r.session_id: r for r in vc.voice_separation(df, tile=tile, bins=bins).collect()}
        assert set(got) == set(want)
        for s, r in want.items():
            for c in r.__fields__:
                assert (got[s][c] is None) == (r[c] is None) and (r[c] is None or got[s][c] == pytest.approx(r[c])), (s, c)
