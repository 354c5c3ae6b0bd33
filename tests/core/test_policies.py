"""Hand-made cases of the operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.config import DEFAULTS
from parley.functions import text as tx
from parley.operators import answers as an
from parley.operators import drift as dr
from parley.operators import frames as fr
from parley.operators import guards as gd
from parley.operators import language as lg
from parley.operators import quality as ql
from parley.operators import segments as sg
from parley.operators import transcript as tr
from parley.operators import utterances as ut
from parley.operators import voices as vc

C = F.col


def series(spark, *runs):
    rows = [(s, i, float(p)) for s, r in enumerate(runs) for i, p in enumerate(r)]
    return spark.createDataFrame(rows, "session_id long, frame_idx long, prob double")


def by_loop(probs, thr, neg, n, m, pad):
    """Segments by a plain state machine."""
    high = low = closed = start = 0
    is_open, out = False, []
    for i, p in enumerate(probs):
        high, low = (high + 1 if p >= thr else 0), (low + 1 if p < neg else 0)
        if not is_open and high >= n:
            is_open, start = True, i - min(pad, i - closed)
        elif is_open and low >= m:
            is_open, closed = False, i
            out.append((start, i, False))
    return [*out, (start, len(probs), True)] if is_open else out


def test_default_parameters():
    assert (DEFAULTS.open_frames, DEFAULTS.close_frames, DEFAULTS.pad_frames, DEFAULTS.neg_threshold) == (3, 16, 8, 0.35)


def test_segments_of_hand(spark):
    runs = [[0.9] * 2 + [0.02] * 30, [0.9] * 5 + [0.02] * 16, [0.02] * 20 + [0.9] * 5 + [0.02] * 16, [0.9] * 4 + [0.4] * 60, [0.9] * 5 + [0.02] * 15 + [0.9] + [0.02] * 15]
    got = {}
    for r in sg.segment_hysteresis(series(spark, *runs)).orderBy("session_id", "segment_idx").collect():
        got.setdefault(r.session_id, []).append((r.start_frame, r.end_frame, r.open_at_end))
    assert got == {1: [(0, 20, False)], 2: [(14, 40, False)], 3: [(0, 64, True)], 4: [(0, 36, True)]}
    with pytest.raises(ValueError):
        sg.segment_hysteresis(series(spark, [0.1]), threshold=0.1, neg=0.2)


def test_segments_against_a_loop(spark):
    rng = random.Random(2)
    runs = [[rng.choice([0.1, 0.3, 0.4, 0.6, 0.9]) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    for n, m, pad in ((1, 1, 0), (2, 3, 2), (3, 5, 8)):
        got = {}
        for r in sg.segment_hysteresis(series(spark, *runs), n_open=n, n_close=m, pad=pad).orderBy("session_id", "segment_idx").collect():
            got.setdefault(r.session_id, []).append((r.start_frame, r.end_frame, r.open_at_end))
        assert got == {i: s for i, r in enumerate(runs) if (s := by_loop(r, 0.5, 0.35, n, m, pad))}


def test_split_points_and_utterances(spark):
    assert ut.split_points(np.ones(30), 10, 4) == [7, 14, 21]
    assert ut.split_points(np.ones(9), 10, 4) == []
    power = np.ones(25)
    power[8] = 0
    assert ut.split_points(power, 10, 4)[0] == 9
    segs = spark.createDataFrame([(1, 0, 0, 25, False), (1, 1, 30, 34, True)], "session_id long, segment_idx long, start_frame long, end_frame long, open_at_end boolean")
    frames = spark.createDataFrame([(1, i, float(power[i]) if i < 25 else 1.0) for i in range(34)], "session_id long, frame_idx long, power double")
    rows = ut.build_utterances(segs, frames, frame_ms=1.0, limit=10, search=4).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.reason, r.continues_previous) for r in rows] == [(0, 9, "max_duration", False), (9, 16, "max_duration", True), (16, 25, "pause", True), (30, 34, "end_of_stream", False)]
    assert [r.idx for r in rows] == [0, 1, 2, 3]


def test_lost_end_and_cuts(spark):
    ev = spark.createDataFrame([(1, 0, "speech_start", 0.0), (1, 1, "speech_start", 50.0), (1, 2, "speech_end", 80.0), (1, 3, "speech_start", 80.0)], "session_id long, seq long, kind string, at_ms double")
    got = [(r.idx, r.start_ms, r.end_ms, r.reason) for r in ut.utterances_from_events(ev).orderBy("idx").collect()]
    assert got == [(0, 0, 50, "pause"), (1, 50, 80, "pause")]
    u = spark.createDataFrame([(1, 0, 0.0, 50.0, "pause", True)], "session_id long, idx long, start_ms double, end_ms double, reason string, continues_previous boolean")
    cut = lambda at: [(r.part, r.start_ms, r.end_ms, r.continues_previous) for r in ut.cut_at(u, spark.createDataFrame([(1, 0, at)], "session_id long, idx long, at_ms double")).orderBy("part").collect()]
    assert cut(20.0) == [(0, 0, 20, True), (1, 20, 50, False)] and cut(50.0) == cut(-1.0) == [(0, 0, 50, True)]


def test_pcm_round_trip_and_reframe(spark):
    raw = np.array([0, 100, -100, 32767, -32767], "<i2").tobytes()
    df = fr.decode_pcm(spark.createDataFrame([(raw,), (None,)], "pcm binary"), scale=32767.0)
    assert fr.encode_pcm(df.drop("pcm")).first().pcm == raw
    two = fr.decode_pcm(spark.createDataFrame([(np.array([1, 3, 5], "<f4").tobytes(),)], "pcm binary"), "f32", 2).first().samples
    assert two == [2.0]
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(1000))
    cuts = sorted(rng.sample(range(1000), 9))
    rows = [("a", i, bytearray(data[x:y])) for i, (x, y) in enumerate(zip([0, *cuts], [*cuts, 1000], strict=True))]
    chunks = spark.createDataFrame(rows, "session_id string, seq long, pcm binary")
    got = [bytes(r.pcm) for r in fr.reframe(chunks, 64).orderBy("frame_idx").collect()]
    assert got == [data[i : i + 64] for i in range(0, 960, 64)]
    assert bytes(fr.reframe(chunks, 64, pad_tail=True).orderBy(F.desc("frame_idx")).first().pcm) == data[960:] + bytes(24)


def test_language_cases(spark):
    ln = math.log
    rows = [("vi", 2000.0, {"vi": ln(0.9), "ja": ln(0.02)}), ("ja", 2000.0, {"vi": ln(0.01), "ja": ln(0.85)}), ("?", 2000.0, {"vi": ln(0.3), "ja": ln(0.28)}), ("short", 599.0, {"vi": 0.0, "ja": -9.0}), ("lacks", 900.0, {"vi": 0.0})]
    got = {r.name: r for r in lg.decide_language(spark.createDataFrame(rows, "name string, duration_ms double, scores map<string,double>")).collect()}
    assert [got[n].lang_code for n in ("vi", "ja", "?", "short", "lacks")] == ["vi", "ja", "", "", ""]
    assert got["?"].confidence > 0.5 and 0 < got["?"].margin < 0.3 and "ja" in got["lacks"].reason and "599" in got["short"].reason
    labels = spark.createDataFrame([("vi",), ("vi: Vietnamese",), (" JA : Japanese ",)], "l string").select(lg.language_code(C("l")).alias("c"))
    assert [r.c for r in labels.collect()] == ["vi", "vi", "ja"]
    fills = spark.createDataFrame([(1, i, x, True) for i, x in enumerate(["", "vi", "", "ja", "", ""])], "session_id long, seq long, lang_code string, is_final boolean")
    assert [r.filled for r in lg.fill_language(fills).orderBy("seq").collect()] == ["", "vi", "vi", "ja", "ja", "ja"]
    told = [["vi"] * 4 + ["ja"] * 4, ["vi"] * 4, ["vi"], ["vi", "ja", None], ["vi", "ja"], ["vi"] * 30 + ["ja"] * 2, ["vi"] + ["ja"] * 30]
    rows = [(u, i, x) for u, langs in enumerate(told) for i, x in enumerate(langs)]
    found = lg.language_boundary(spark.createDataFrame(rows, "utt int, window_idx int, lang string").repartition(4), ["utt"])
    assert [tuple(r)[1:] for r in found.orderBy("utt").collect()] == [
        (4, "vi", "ja", 5, "split"), (None, "vi", "vi", 2, "one_language"), (None, "", "", 0, "too_short"), (None, "", "", 2, "undecided"), (1, "vi", "ja", 2, "split"),
        (31, "vi", "ja", 5, "split"), (4, "vi", "ja", 5, "split"),
    ]


def test_language_cut_snaps_back_to_the_quiet(spark):
    power = [5, 5, 1, 5, 2, 5, 2, 5, 5, 0, 5, 5]
    frames = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate(power)], "session_id int, frame_idx long, power double")
    rows = [(0, 1, 0.0, 256.0), (1, 1, 96.0, 250.0), (2, 1, 0.0, 20.0), (3, 2, 0.0, 256.0), (4, 1, 0.0, 330.0)]
    b = spark.createDataFrame(rows, "utt int, session_id int, start_ms double, at_ms double")
    got = {r.utt: r.cut_ms for r in lg.snap_to_quiet(b, frames, ["utt"], search=5).collect()}
    # frames 3 to 7: the earlier of two; 3 to 6 of the second utterance; no whole frame; another session; frames 5 to 9
    assert got == {0: 160.0, 1: 160.0, 2: 20.0, 3: 256.0, 4: 320.0}
    u = spark.createDataFrame([(0, 0.0, 400.0, False), (4, 0.0, 330.0, True)], "utt int, start_ms double, end_ms double, continues_previous boolean")
    cut = lg.snap_to_quiet(b, frames, ["utt"], search=5).withColumns({"before": C("utt").cast("string"), "after": C("utt").cast("string")})
    parts = [(r.utt, r.part, r.start_ms, r.end_ms) for r in lg.split_by_language(u, cut, ["utt"], 0.0, 96).orderBy("utt", "part").collect()]
    assert parts == [(0, 0, 0.0, 160.0), (0, 1, 160.0, 400.0), (4, 0, 0.0, 330.0)]


def test_voices(spark):
    m = vc.Matcher(threshold=0.5)
    assert m.assign([1, 0, 0]) == ("Speaker_01", 0.0, True)
    label, near, new = m.assign([0.95, 0.1, 0.05])
    assert (label, new) == ("Speaker_01", False) and near > 0.9
    assert m.assign([0, 1, 0])[::2] == ("Speaker_02", True)
    assert m.centroids[0] == pytest.approx([0.985, 0.03, 0.015])
    full = vc.Matcher(threshold=0.9, most=1)
    full.assign([1, 0])
    assert full.assign([0, 1])[0] == "Speaker_01"
    rng = np.random.default_rng(7)
    points = np.eye(8)[[0, 3, 0, 3]] + rng.normal(0, 0.15, (4, 8))
    assert sorted(vc.cluster(points, 0.3)) == [[0, 2], [1, 3]]
    assert vc.cluster(np.zeros((0, 8)), 0.3) == []
    order = rng.permutation(8)
    eight = np.eye(8)[[0] * 4 + [5] * 4] + rng.normal(0, 0.15, (8, 8))
    assert sorted(map(len, vc.cluster(eight[order], 0.3))) == [4, 4]
    assert vc.name_clusters([[0, 1, 2]], ["Speaker_02", "Speaker_02", "Speaker_07"]) == ["Speaker_02"] * 3
    assert vc.name_clusters([[0], [1, 2]], ["Speaker_01"] * 3) == ["Speaker_02", "Speaker_01", "Speaker_01"]
    assert vc.name_clusters([[0], [1]], [vc.UNKNOWN] * 2) == ["Speaker_01", "Speaker_02"]
    df = spark.createDataFrame([(1, 599.0, [1.0]), (2, 900.0, [float("nan")]), (3, 900.0, []), (4, 900.0, None), (5, 600.0, [1.0, 2.0])], "i long, duration_ms double, embedding array<double>")
    assert {r.i: r.usable for r in vc.usable_voice(df).collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(vc.cosine(C("a"), C("b")).alias("c")).first().c == 0.0
    v = spark.createDataFrame([("s", i, x) for i, x in enumerate([[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.9, 0.1]])], "session_id string, sentence_id long, embedding array<double>")
    assert [r.label for r in vc.assign_voices(v, threshold=0.5).orderBy("sentence_id").collect()] == ["Speaker_01", "Speaker_01", "Speaker_02", "Speaker_02"]
    assert [r.sentence_id for r in vc.voice_changes(v, ["session_id"], "sentence_id").collect()] == [2]


def test_guard_table(spark):
    rows = [("hello there", 0.05, -0.2, 1.6, 2000.0, ""), (" ", 0.05, -0.2, 1.6, 2000.0, "empty"), ("hello", 0.86, -0.35, 1.6, 6800.0, ""), ("hello", 0.86, -0.31, 1.6, 500.0, "no speech"), ("hello", 0.86, -1.0, 1.6, 6800.0, "no speech"), ("hello", 0.05, -1.0, 1.6, 2000.0, ""), ("hello", 0.05, -1.01, 1.6, 2000.0, "low confidence"), ("hello", 0.05, -0.2, 2.41, 2000.0, "repetition"), ("Thank you for watching!", 0.02, -0.15, 1.5, 2000.0, "known hallucination")]
    df = spark.createDataFrame(rows, "text string, ns double, lp double, ratio double, ms double, want string")
    listed = gd.listed(df, spark.createDataFrame([("thank you for watching",)], "line string"), [], spark.createDataFrame([], "line string"))
    for r in listed.withColumn("got", gd.refuse_reason(C("text"), C("ns"), C("lp"), C("ratio"), C("ms"), C("invented"))).collect():
        assert r.got == r.want, r
    lines = ["chào tạm biệt", "Chào tạm biệt nhé.", "hay subscribe cho kenh X de khong", "say hay subscribe cho kenh X de khong", "kept line", "tắt", "tab"]
    one = spark.createDataFrame([(x,) for x in lines], "text string")
    block = spark.createDataFrame([("Chào, tạm biệt!",), ("kept line",), ("tab",)], "line string")
    out = gd.listed(one, block, ["hay subscribe cho kenh .* de khong"], spark.createDataFrame([("Kept line.",)], "line string"))
    assert {r.text: r.invented for r in out.collect()} == dict(zip(lines, [True, False, True, False, False, False, True], strict=True))
    words = spark.createDataFrame([(0, "abc"), (1, "defgh"), (2, "ij"), (3, "k")], "pos long, word string")
    assert gd.vocabulary_prompt(words, limit=12).first().prompt == "abc, defgh"
    ratio = one.select(tx.compression_ratio("text").alias("r")).first().r
    assert ratio == pytest.approx(len("chào tạm biệt".encode()) / len(__import__("zlib").compress("chào tạm biệt".encode())))


def test_answers(spark):
    raw = {"Sure! Here is the translation: X": "X", "Translation: X": "X", "翻訳：X": "X", '"X"': "X", "「X」": "X", "Certainly: 「X」": "X", "Xin chào: hôm nay": "Xin chào: hôm nay", '"': '"', "<think>a</think>X": "X", "<think>a": "", "<THINK>a</THINK>X": "X", " <Think>a": "", "a <think> b": "a <think> b", "「“X”」": "X", "Sure X": "X", "got it, X": "X", "Here is what you asked: X": "X", "Here's the\nX": "Here's the\nX", "Sure! Okay. Dịch: 'X'": "X", "Surely X": "Surely X", "\u3000X\u3000": "X", "": "", None: ""}
    df = spark.createDataFrame([(k,) for k in raw], "a string")
    assert {r.a: r.c for r in df.select("a", tx.clean_answer(C("a")).alias("c")).collect()} == raw
    # an announcement may have 40 characters before its colon, beside the article
    told = {f"Here is {'a' * n}: X": "X" if n <= 39 else f"Here is {'a' * n}: X" for n in (38, 39, 40, 43, 44)}
    told |= {f"here's the {'b' * n}： X": "X" if n <= 39 else f"here's the {'b' * n}： X" for n in (39, 40, 43, 44)} | {"Here is\nit: X": "Here is\nit: X", "Here is it\n: X": "X"}
    df2 = spark.createDataFrame([(k,) for k in told], "a string")
    assert {r.a: r.c for r in df2.select("a", tx.clean_answer(C("a")).alias("c")).collect()} == told
    ratios = {"15": None, "Task đó": 0.0, "プレー": 1.0, "コーヒー": 1.0, "人々": 0.5, "ｶﾅ": 0.0}
    got = {r.a: r.c for r in spark.createDataFrame([(k,) for k in ratios], "a string").select("a", tx.japanese_ratio(C("a")).alias("c")).collect()}
    assert got == ratios
    rows = [("Ờ", "ờ", "vi", "the answer repeats the source"), ("プレー", "コーヒー", "vi", "the answer is not written in vi"), ("a" * 10, "b" * 71, "vi", "the answer is too long"), ("a" * 10, "b" * 70, "vi", ""), ("", "x", "vi", "nothing to translate"), ("a", "x", "", "the language was undecided"), ("a", "<think>", "vi", "there is no answer"), ("a", "15", "ja", "")]
    df = spark.createDataFrame(rows, "transcript string, raw string, target string, want string")
    for r in an.judge_answer(df).collect():
        assert r.reason == r.want and (r.translation != "") == (r.want == ""), r
    pairs = [("ja", "vi", n, m) for n, m in ((4, 5), (6, 22), (9, 40), (21, 74), (29, 53))] + [("vi", "ja", n, m) for n, m in ((33, 23), (45, 20), (59, 30))]
    fits = spark.createDataFrame(pairs, "a string, target string, n int, m int").select(an.too_long(F.repeat(F.lit("x"), C("n")), F.repeat(F.lit("y"), C("m")), C("target")).alias("t"))
    assert not any(r.t for r in fits.collect())


def test_inference_errors_become_reasons(spark):
    def make():
        def client(asks):
            if any(u == "bad" for _, u in asks):
                raise RuntimeError("down")
            return [u.upper() for _, u in asks]

        return client

    df = spark.createDataFrame([("s", "a"), ("s", "bad")], "system_prompt string, user_prompt string").coalesce(1)
    got = {r.user_prompt: (r.raw, r.error) for r in an.infer(df, make).collect()}
    assert got == {"a": ("A", ""), "bad": (None, "RuntimeError: down")}
    t = spark.createDataFrame([(1, "hello friend", "ja", "Hello, friend!"), (2, "other", "ja", "fine"), (3, "hello", "ja", "hello")], "id long, transcript string, lang_code string, raw string").withColumn("target", an.target_language(C("lang_code")))
    again = lambda: lambda asks: ["xin chào" if "friend" in u else "hello" for _, u in asks]
    out = {r.id: (r.retried, r.rescued, r.translation, r.reason) for r in an.retry_echoes(an.judge_answer(t), again, ["id"]).collect()}
    assert out == {1: (True, True, "xin chào", ""), 2: (False, False, "fine", ""), 3: (True, False, "", "the answer repeats the source")}


def test_queue(spark):
    jobs = spark.sql("select 1 as session_id, timestamp_seconds(0) as submitted_at, timestamp_millis(10000) as taken_at union all select 2, timestamp_seconds(0), timestamp_millis(10100)")
    assert {r.session_id: r.stale for r in an.drop_stale(jobs).collect()} == {1: False, 2: True}
    many = spark.range(17).select(F.lit(1).alias("session_id"), C("id").alias("sentence_id"), F.lit(True).alias("waiting"))
    assert [r.sentence_id for r in an.bounded_backlog(many).where("reason <> ''").collect()] == [0]


def test_transcript(spark):
    none = None
    rows = [
        (1, 1, "final", 0, "A", "vi", "one", none, none, none, none), (1, 2, "partial", none, none, "vi", "tw", none, none, none, none), (1, 3, "translation", 0, none, none, none, "eins", "", "eins", none),
        (1, 4, "translation", 9, none, none, none, "lost", "", "", none), (1, 5, "final", 1, "B", "ja", "two", none, none, none, none), (1, 6, "speakers", none, none, none, none, none, none, none, {"1": "C", "7": "D", "0": "A"}),
        (1, 7, "zzz", none, none, none, none, none, none, none, none), (1, 8, "partial", none, none, "vi", "run", none, none, none, none),
    ]
    log = spark.createDataFrame(rows, "session_id long, seq long, kind string, sentence_id long, speaker_id string, lang_code string, transcript string, translation string, reason string, raw string, labels map<string,string>")
    got = {r.sentence_id: r for r in tr.fold_messages(log).collect()}
    assert sorted(got) == [0, 1]
    assert (got[0].translation, got[0].answered, got[0].relabelled, got[0].speaker_id) == ("eins", True, False, "A")
    assert (got[1].speaker_id, got[1].relabelled, got[1].answered) == ("C", True, False)
    assert tr.current_partial(log).first().running == "run" and tr.current_partial(log.where("seq < 6")).first().running == ""


def test_lag_and_breaker(spark):
    ev = spark.createDataFrame([(1, 0.0, 0.866)], "session_id long, at_ms double, arrived_s double")
    gaps = spark.createDataFrame([(1, 0.0, 0.5)], "session_id long, gap_at_s double, waited_s double")
    r = ql.corrected_lag(ql.event_lag(ev), gaps).first()
    assert (round(r.lag_ms, 6), round(r.corrected_ms, 6)) == (866, 366)
    assert not spark.range(1).select(ql.judgeable(F.lit(120.0), F.lit(107.0), F.lit(0.0)).alias("j")).first().j
    runs = [("a", i, f, "x") for i, f in enumerate([True, True, False, True, True, True, True])] + [("b", 0, False, ""), ("b", 1, True, "CUDA error"), ("b", 2, False, "")]
    df = spark.createDataFrame(runs, "stage string, seq long, failed boolean, message string")
    out = {(r.stage, r.seq): (r.skipped, r.notice) for r in ql.circuit_breaker(df, ["stage"]).collect()}
    assert [k for k, v in out.items() if v[0]] == [("a", 6), ("b", 2)] and sorted(k for k, v in out.items() if v[1]) == [("a", 5), ("b", 1)]


def test_drift(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("x", "y"), ("one two", "one two"), ("", "z")], "a string, b string")
    assert [r.j.strip() for r in df.select(dr.join_without_repeats(C("a"), C("b")).alias("j")).collect()] == ["a b c d", "x y", "one two", "z"]
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(["the cat", "the cat sat", "the dog", "the dog ran"])], "session_id long, seq long, transcript string")
    assert [r.agreed for r in dr.agreed_prefix(p).orderBy("seq").collect()] == [0, 2, 2, 2]
    art = spark.createDataFrame([(1, "こ れ は ペ ン"), (2, "the the end end end")], "id long, transcript string")
    assert {r.id: (r.letters_apart, r.repeats) for r in dr.text_artifacts(art, ["id"]).collect()} == {1: (True, 0), 2: (False, 3)}
    near = dr.near_block_list(spark.createDataFrame([(1, "Thank you for watchin"), (2, "thank you for watching!"), (3, "nothing alike")], "id long, transcript string"), spark.createDataFrame([("Thank you for watching",)], "line string"), ["id"])
    assert [r.id for r in near.collect()] == [1]


def test_sums_of_stages_do_not_depend_on_the_order(spark):
    """0.1 + 0.2 and 0.3 are equal, and 0.1 + 0.2 + 0.7 is 1, whatever doubles make of it one by one."""
    rows = [(1, 1, "b", 0.1), (1, 1, "b", 0.2), (1, 1, "a", 0.3), (2, 1, "a", 0.7), (2, 1, "a", 0.1), (2, 1, "a", 0.2)]
    for own in (rows, rows[::-1]):
        t = spark.createDataFrame(own, "session_id long, item_id long, stage string, seconds double").coalesce(1).withColumn("audio_seconds", F.lit(0.1))
        assert {(r.session_id, r.stage, r.seconds, r["rank"]) for r in ql.stage_cost(t).collect()} == {(1, "a", 0.3, 1), (1, "b", 0.3, 2), (2, "a", 1.0, 1)}
        assert [(r.session_id, r.total) for r in ql.slow_items(t, ["session_id", "item_id"], 1.0).collect()] == [(2, 1.0)]
