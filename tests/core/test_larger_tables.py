"""Steps whose work grew faster than their tables, or was done more than once for each row."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from parley.sources import sinks
from parley.streaming import transcripts as ts


def test_a_batch_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for rows in parts:
            seen.add(len(rows))
            yield rows

    write = sinks.upsert_transcript(spark, f"{tmp_path}/t", buckets=4)
    for batch in range(2):
        rows = spark.range(20).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("sentence_id"), (F.col("id") + 100 * batch).alias("seq"))
        write(rows.mapInPandas(count, rows.schema), batch)
        assert seen.value == 20 * (batch + 1)
    assert sorted(r.seq for r in sinks.read_transcript(spark, f"{tmp_path}/t").collect()) == list(range(100, 120))


class States:
    """The states of one session that count how often they are asked."""

    def __init__(self):
        self.map, self.list, self.calls = {}, [], []

    def getMapState(self, *_):
        return self

    def getListState(self, *_):
        return Line(self)

    def __getattr__(self, name):
        work = {"containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k], "updateValue": self.map.__setitem__, "removeKey": lambda k: self.map.pop(k), "clear": self.map.clear}[name]
        return lambda *x: (self.calls.append(name), work(*x))[1]


class Line:
    def __init__(self, of):
        self.of = of

    def exists(self):
        self.of.calls.append("exists")
        return bool(self.of.list)

    def get(self):
        self.of.calls.append("get")
        return iter(self.of.list)

    def put(self, rows):
        self.of.calls.append("put")
        self.of.list = rows

    def clear(self):
        self.of.list = []


def test_the_state_is_asked_only_for_what_it_holds():
    names = [c.split()[0] for c in "seq long, kind string, sentence_id long, speaker_id string, lang_code string, transcript string, translation string, reason string, raw string, labels map".split(", ")]
    message = lambda seq, kind, sid=None, **x: Row(*names)(*(({"seq": seq, "kind": kind, "sentence_id": sid, "speaker_id": "A"} | x).get(c) for c in names))
    fold, states = ts.TranscriptFold(3, None), States()
    fold.init(states)
    first = [message(10 * i, "final", i, transcript=f"t{i}") for i in range(4)] + [message(35, "speakers", labels=[("3", "B"), ("9", "C")])]
    out = list(fold.handleInputRows((1,), iter(first[::-1]), None))
    assert [(r.sentence_id, r.version, r.speaker_id, r.relabelled) for r in out] == [(0, 0, "A", False), (1, 10, "A", False), (2, 20, "A", False), (3, 35, "B", True)]
    assert states.calls == ["get", *["updateValue"] * 3, "put"]
    states.calls.clear()
    out = list(fold.handleInputRows((1,), iter([message(50, "translation", 2, translation="x"), message(51, "translation", 0, translation="y")]), None))
    assert [(r.sentence_id, r.translation, r.transcript, r.answered) for r in out] == [(2, "x", "t2", True)]
    assert states.calls == ["get", "getValue", "updateValue"]


def test_a_log_judges_its_turns_in_one_pass(spark):
    from parley.plans import text_queries as tq

    log = tq.message_log(spark, "/root/testdata/sf0.001")
    assert log._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_edits_after_what_two_texts_begin_with_alike(spark):
    from parley.operators import drift as dr

    texts = ["", "a", "ab", "abc", "axc", "b", "ba", "a😀bc", "a😀xc", "😀", "phở bò", "phở gà ngon", "kitten", "sitting", "ab\ncd", "ab\nd", None]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    rows = pairs.select("a", "b", dr.edits(F.col("a"), F.col("b")).alias("got"), F.levenshtein("a", "b").alias("want")).collect()
    assert len(rows) == len(texts) ** 2 and [r for r in rows if r.got != r.want] == []


def test_running_text_that_only_grew_needs_no_table_of_its_characters(spark):
    import time

    from parley.operators import drift as dr

    long = "lời nói " * 50_000
    rows = spark.createDataFrame([(1, 0, False, long[:100_000]), (1, 1, True, long), (1, 2, False, long[:300_000]), (1, 3, True, long)], "session_id long, seq long, is_final boolean, transcript string")
    at = time.time()
    got = [(r.seq, r.rewritten) for r in dr.far_from_partial(rows).select("seq", "rewritten").collect()]
    assert got == [(1, 0.75)] and time.time() - at < 60


def test_running_and_committed_texts_come_from_one_scan(spark):
    from parley.plans import session_queries as sq

    assert sq.texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_spaced_form_by_translation(spark):
    import random

    from parley.functions import text as tx

    marks, draw = tx._SPACES + tx._MARKS, random.Random(5)
    texts = ["", " ", "  ", " , ", "a b c", "a  b", "a,b", ",", "é、 x", "😀 -- 😀 ", None] + ["".join(draw.choice(draw.choice((marks, "  aZ0é語​_&^"))) for _ in range(draw.randrange(30))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.norm_spaced(F.col("t")).alias("got"), F.lower(F.trim(F.regexp_replace("t", f"[{tx.BLANKS}{tx.MARKS}]+", " "))).alias("want")).collect()
    assert len(rows) == len(texts) and [r for r in rows if r.got != r.want] == []
    # no class of many ranges goes over every character
    plan = spark.range(1).select(tx.norm_spaced(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace(translate(" in plan
