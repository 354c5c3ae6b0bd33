import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, frame
from pyspark.sql import functions as F

from parley.llm import centroids, exact_dedup, vector_blocks, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string, block string, raw string, part string, code_ string, keys string"


def vectors(dim, n=150, seed=5, scale=1.0):
    """Clustered vectors with ties, repeated rows, a hot vector, and rows that take no part."""
    rng = np.random.default_rng(seed)
    middle = rng.integers(-8, 9, (6, dim))
    rows = [(i, (scale * (middle[i % 6] + rng.integers(-1, 2, dim)) / 8).tolist(), f"l{i % 3}" if i % 7 else None) for i in range(n)]
    rows += [(1000 + i, rows[4][1], "hot") for i in range(60)] + [rows[9], rows[9], (9, rows[1][1], "l0"), (None, rows[2][1], None)]
    good = list(rows)
    bad = [None, [], [0.5] * (dim - 1), [None] + [0.1] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1e300] * dim]
    return good, [(2000 + i, v, "bad") for i, v in enumerate(bad)]


def table(spark, rows):
    return spark.createDataFrame([(*r, *["odd"] * 5) for r in rows], SCHEMA)


def floors(v, scale):
    return [int(np.floor(scale * x)) for x in v]


def near(x, cs):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(cs))


def lloyd(xs, cs, rounds):
    for _ in range(rounds):
        own = defaultdict(list)
        for x in xs:
            own[near(x, cs)[1]].append(x)
        cs = [[sum(col) // len(own[i]) for col in zip(*own[i], strict=True)] if own[i] else c for i, c in enumerate(cs)]
    return cs


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_clusters_against_plain_rounds(spark, scale):
    good, bad = vectors(64, scale=scale)
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    df = table(spark, good + bad).repartition(3)
    out, found, scans = centroids.cluster(df, ["vec_id", "block"], order, block=32)
    xs = [floors(v, 64) for _, v, _ in good]
    by = sorted(range(len(good)), key=lambda i: (good[i][0] is None, hashlib.sha256(f"1:{good[i][0]}".encode()).hexdigest(), xs[i]))
    cs = lloyd(xs, [xs[i] for i in by[:16]], 3)
    assert found.tolist() == cs
    want = sorted((str(r[0]), *reversed(near(x, cs))) for r, x in zip(good, xs, strict=True))
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in out.collect()) == want
    assert out.columns == ["vec_id", "block", "cluster", "distance"]
    # the first pass looks at all, later ones at what has expired alone
    assert scans[0] == len(good) and max(scans[1:]) < 0.7 * len(good)


def test_clusters_of_few_and_of_no_vectors(spark):
    df = table(spark, vectors(64)[0][:3])
    out, found, _ = centroids.cluster(df, ["vec_id"], F.col("vec_id"))
    assert len(found) == 3 and [r.distance for r in out.collect()] == [0, 0, 0]
    out, found, _ = centroids.cluster(df, ["vec_id"], F.col("vec_id"), k=1)
    assert found.shape == (1, 64) and out.count() == 3
    out, found, _ = centroids.cluster(table(spark, vectors(64)[1]), ["vec_id"], F.col("vec_id"))
    assert out.columns == ["vec_id", "cluster", "distance"] and out.count() == 0 and not len(found)


def test_heaps_give_back_what_expires():
    heaps = centroids.Heaps(2)
    off = np.array([1.0, 0.0])
    heaps.push(np.arange(6), np.array([0, 0, 0, 1, 1, 1]), np.array([5.0, 1.0, 3.0, 0.0, 2.0, 9.0]), off)
    again = centroids.Heaps(2, *heaps.state())
    places, of = again.pop(np.array([3.5, 2.0]))
    assert sorted(zip(places.tolist(), of.tolist(), strict=True)) == [(1, 0), (3, 1), (4, 1)]
    assert [len(h) for h in again.heaps] == [2, 1]


@pytest.mark.parametrize("scale", [1.0, 3e3])
def test_codes_against_plain_rounds(spark, scale):
    good, bad = vectors(16, scale=scale)
    out, books = vector_codes.compress(table(spark, good + bad).repartition(3), ["vec_id", "label", "raw"], entries=40, block=64)
    xs = [floors(v, 1024) for _, v, _ in good]
    by = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, xs[i]))
    want = [lloyd([x[p : p + 4] for x in xs], [xs[i][p : p + 4] for i in by[:40]], 4) for p in (0, 4, 8, 12)]
    assert books.tolist() == want
    rows = []
    for (i, _, label), x in zip(good, xs, strict=True):
        best = [near(x[4 * p : 4 * p + 4], want[p]) for p in range(4)]
        rows.append((str(i), str(label), "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    assert sorted((str(r.vec_id), str(r.label), r.code, r.error) for r in out.collect()) == sorted(rows)
    total = defaultdict(int)
    for r in rows:
        total[r[1]] += r[3]
    for share in (1000, 3):
        got = vector_codes.with_totals(out, "label", "error", "label_error", share)
        assert sorted((str(r.vec_id), str(r.label), r.label_error) for r in got.collect()) == sorted((r[0], r[1], total[r[1]]) for r in rows)


def test_codes_of_no_vectors_and_of_several_lengths(spark):
    good, bad = vectors(16)
    out, books = vector_codes.compress(table(spark, [*bad, (1, [], "a")]), ["vec_id"])
    assert out.columns == ["vec_id", "code", "error"] and out.count() == 0 and books.size == 0
    mixed = table(spark, [*good[:5], *[(50 + i, [0.5] * 8, "x") for i in range(4)], *[(60 + i, [0.5] * 7, "x") for i in range(9)]])
    out, books = vector_codes.compress(mixed, ["vec_id"])
    assert sorted(r.vec_id for r in out.collect()) == [0, 1, 2, 3, 4] and books.shape == (4, 5, 4)


def test_trees_hold_every_point_once_and_shrink_candidates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-30, 30, (300, 5)) + 1000 * rng.integers(-3, 4, 5) for _ in range(6)] + [np.tile([7, 7, 7, 7, 7], (400, 1))])
    tree = vector_codes.build(x, leaf=16)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for i in range(len(tree.radius)):
        mine = x[tree.order[tree.low[i] : tree.high[i]]]
        assert tree.sums[i].tolist() == [*mine.sum(axis=0).tolist(), len(mine)]
        assert np.sqrt(((mine - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        if tree.left[i] >= 0:
            assert (tree.low[i], tree.high[i]) == (tree.low[tree.left[i]], tree.high[tree.right[i]])
    entries = np.concatenate([x[::60], x[:3], x[:3]])
    code, sums, looked = vector_codes.walk(x, tree, entries)
    assert code.tolist() == vector_blocks.squared(x, entries).argmin(axis=1).tolist()
    assert (sums == vector_blocks.grouped_sums(x, code, len(entries))).all()
    assert looked < len(x) * len(entries) // 4


def test_distances_are_whole_numbers_at_every_size():
    rng = np.random.default_rng(2)
    for top in (10, 1 << 25):
        x, c = rng.integers(-top, top, (9, 16)), rng.integers(-top, top, (4, 16))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
        assert vector_blocks.squared(x, c).tolist() == want


def plain_groups(rows):
    groups = defaultdict(list)
    for i, (doc, text, *_) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for norm, held in groups.items():
        best = min(held)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(rows[h[3]][0], rows[best[3]][0], len(held), h == best, sha) for h in held]
    return out


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 16), (7, 2), (7, 16)])
def test_exact_groups_against_a_plain_loop(spark, parts, fan_in):
    rng = random.Random(4)
    rows = documents()
    rows += [(500 + i, rng.choice(["a  hot text", "a hot\ttext ", "ahottext"]), "en", "s") for i in range(60)] + [(700, "long " * 50_000, "en", "s"), (701, "long" * 50_000, "en", "s")]
    out = exact_dedup.exact_groups(frame(spark, rows).repartition(parts), fan_in=fan_in)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    # of rows that share doc_id, length and text any one stays: told apart by nothing, so compared as a multiset
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3], r[4])
    assert sorted(map(key, out.collect())) == sorted(map(key, plain_groups(rows)))


def test_kept_rows_have_all_their_columns(spark):
    rows = documents()
    df = frame(spark, rows).selectExpr("*", "1 AS run", "2 AS head", "3 AS total", "4 AS row", "5 AS chars")
    out = exact_dedup.keep_one(df.repartition(5), fan_in=2)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(rows_id), str(text)) for rows_id, text in kept_texts(rows))
    assert exact_dedup.keep_one(df.limit(0)).count() == 0 and exact_dedup.exact_groups(df.limit(0)).count() == 0


def kept_texts(rows):
    groups = {}
    for i, (doc, text, *_) in enumerate(rows):
        norm = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups[norm] = min(groups.get(norm, (1, True, 0, 0)), (-len(text or ""), doc is None, doc or 0, i))
    return [rows[g[3]][:2] for g in groups.values()]


def test_entries_of_one_digest_but_another_text_stay_apart(spark):
    rows = [(i, i % 3, 1, 4, bytes([i // 6]) * 32, 4, 100 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "key long, run long, digest long, n_bytes long, sha binary, chars long, doc_id long")
    got = sorted((r.key, r.keep_id, r.group_size) for r in exact_dedup.merge(df, 2).collect())
    assert got == [(i, 100 if i < 6 else 106, 6) for i in range(12)]
