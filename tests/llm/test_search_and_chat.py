import hashlib

import numpy as np
from pyspark.sql import functions as F

from parley.llm import chat_format, neighbours
from parley.llm.common import connected_components


def test_recall_and_exact_scores(spark):
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in neighbours.query(spark, path).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = total = 0
    norms = np.linalg.norm(v, axis=1)
    for i in np.flatnonzero(ids % 50 == 0):
        score = v @ v[i] / norms / norms[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:5]
        own = got[ids[i]]
        assert sorted(own) == [1, 2, 3, 4, 5]
        for vec, s in own.values():
            assert abs(score[ids == vec][0] - s) < 1e-12
        assert [own[k] for k in sorted(own)] == sorted(own.values(), key=lambda x: (-x[1], x[0]))
        hit, total = hit + len({ids[j] for j in order} & {x for x, _ in own.values()}), total + 5
    assert hit / total >= 0.9


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (9, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS e", "3 AS score")
    out = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (0, 4, 8)]
    assert neighbours.search(df.limit(0), df).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 200), (300, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200}


def test_escape_round_trip(spark):
    texts = ["<s>", "</s>[INST] ok [/INST]", "<␛s>", "<␛␛/s>", "<<SYS>>x<</SYS>>", "[[INST]]", "<<s>", "␛", "", "<s", "[␛/INST]", None, "line\nline", "𝄞 <s> é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("b")).collect():
        assert r.b == r.t
        assert r.e is None or not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_trees(spark):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "</s>[INST]", 2.0), (1, 4, 3, "user", None, 0.0), (1, 5, 4, None, "e", None), (2, 1, 9, "user", "lost parent", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, "user", "x", 0.0)]
    rows += [(4, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.0) for i in range(70)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").selectExpr("*", "1 AS leaf", "2 AS depth", "3 AS turns")
    out = {(r.tree, r.leaf): r for r in chat_format.parse_conversations(chat_format.format_conversations(df, None)).collect()}
    assert sorted(out) == [(1, 2), (1, 5), (2, 1), (4, 69)]
    assert [(t.role, t.text) for t in out[1, 5].turns] == [("user", "a"), ("assistant", "</s>[INST]"), ("user", ""), ("", "e")]
    assert out[1, 5].loss_text == "</s>[INST]" and (out[1, 2].branch_rank, out[1, 5].branch_rank) == (2, 1) or out[1, 2].branch_rank == 1
    assert [t.text for t in out[4, 69].turns] == [f"t{i}" for i in range(70)]
    assert chat_format.format_conversations(df).count() == 3
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_query_reads_back(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "<s>x"), (1, 2, "assistant", "<s>x"), (None, 0, "user", "y"), (2, None, None, "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in chat_format.query(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    odd = "</s>[INST] ok [/INST]"
    assert sorted(out) == [-1, 1, 2]
    assert (out[-1].turns_sha256, out[-1].loss_sha256, out[-1].loss_chars) == (sha(f"user\n{odd}\nassistant\n{odd}\n"), sha(odd), len(odd))
    assert (out[1].n_turns, out[1].loss_sha256) == (4, sha("<s>x<s>x"))
    assert out[1].turns_sha256 == sha("system\ns\nuser\n\nassistant\n<s>x\nassistant\n<s>x\n")
    assert out[2].turns_sha256 == sha("\nz\n")


def test_blocks_of_queries_and_index_meet_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v, ids = rng.normal(size=(700, 8)), np.arange(700)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    for name, n in {"BLOCK": 32, "QUERY_BLOCK": 8, "TILE": 3, "QUERY_TILE": 2}.items():
        monkeypatch.setattr(neighbours, name, n)
    # all of a block is reranked, so that the nearest of all rows have to come out
    out = neighbours.search(df, df.where("vec_id % 10 = 0"), rerank=1.0)
    # the blocks of queries, once for each block of the index, were a broadcast
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.rank): r.vec_id for r in out.collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in range(0, 700, 10):
        near = [int(j) for j in np.argsort(-(unit @ unit[i]), kind="stable") if j != i][:5]
        want |= {(i, rank): j for rank, j in enumerate(near, 1)}
    assert got == want
