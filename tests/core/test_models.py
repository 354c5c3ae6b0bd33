"""Plugged-in models: one load for each worker, batches, errors as reasons, memory by session."""

import pytest
from pyspark.sql import functions as F

from parley.operators import models as md


def test_answers_one_by_one_where_a_batch_fails():
    def model(xs):
        if any(x < 0 for x in xs):
            raise ValueError("below zero")
        return [x + 1 for x in xs]

    assert md.answers(model, [1, 2]) == ([2, 3], ["", ""])
    assert md.answers(model, [1, -1, 3]) == ([2, None, 4], ["", "ValueError: below zero", ""])
    assert md.answers(lambda xs: xs[:1], [5, 6]) == ([5, 6], ["", ""])
    assert md.answers(lambda xs: [], [5]) == ([None], ["ValueError: 0 answers to 1 inputs"])


def test_columns_of_models(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [5.0])], "id long, samples array<double>")

    def scores():
        return lambda batch: [{"n": float(len(x)), "first": 1.0 / len(x) and x[0]} for x in batch]

    got = {r.id: (r.scores, r.error.split(":")[0]) for r in md.classify(df, scores).collect()}
    assert got == {1: ({"n": 2.0, "first": 1.0}, ""), 2: (None, ""), 3: (None, "ZeroDivisionError"), 4: ({"n": 1.0, "first": 5.0}, "")}
    got = {r.id: r.embedding for r in md.embed(df, lambda: lambda batch: [[sum(x), 1.0] for x in batch]).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0], 4: [5.0, 1.0]}

    def half():
        def model(batch):
            if any(len(x) == 1 for x in batch):
                raise OSError("one sample")
            return [[v / 2 for v in x] for x in batch]

        return model

    got = {r.id: (r.samples, r.error) for r in md.process(df, half).collect()}
    assert got == {1: ([0.5, 1.0], ""), 2: (None, ""), 3: ([], ""), 4: ([5.0], "OSError: one sample")}


def test_pieces_and_frames(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "x!")], "id long, text string")

    def words():
        def model(batch):
            if any("!" in t for t in batch):
                raise RuntimeError("noise")
            return [[{"text": w, "avg_logprob": -0.5} for w in t.split()] for t in batch]

        return model

    got = sorted(((r.id, r.piece_idx, r.text, r.avg_logprob, r.no_speech_prob, r.error) for r in md.decode(df, words, ["id"], "text").collect()), key=str)
    assert got == [(1, 0, "a", -0.5, None, ""), (1, 1, "b", -0.5, None, ""), (4, None, None, None, None, "RuntimeError: noise")]

    class Sum:
        def __init__(self):
            self.total = 0.0

        def __call__(self, x):
            self.total += x
            return self.total

    frames = spark.range(40).select((F.col("id") % 3).alias("s"), F.col("id").alias("frame_idx"), F.lit(1.0).alias("samples")).repartition(4)
    got = {(r.s, r.frame_idx): r.prob for r in md.score_frames(frames, Sum, ["s"]).collect()}
    assert got == pytest.approx({(i % 3, i): i // 3 + 1.0 for i in range(40)})
