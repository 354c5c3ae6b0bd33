import random

import numpy as np
import pyarrow as pa
from test_documents import components, shingles

from parley.llm import bucket_links, line_dedup


def test_parts_share_their_first():
    """Buckets of any length keep their rows, and each part has the bucket's first."""
    rows = [(b, s) for b, n in ((1, 1), (2, 2), (3, 9001), (4, 1), (5, 2048), (6, 2049)) for s in range(100, 100 + n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 700], strict=True)], names=["bucket", "short"]) for i in range(0, len(rows), 700)]
    got = [tuple(r.values()) for b in bucket_links._shared(iter(batches)) for r in b.to_pylist()]
    want = [(b, (s - 100) // 2048, s, 100) for b, s in rows if b not in (1, 4)] + [(3, i, 100, 100) for i in range(1, 5)] + [(6, 1, 100, 100)]
    assert sorted(got) == sorted(want)


def test_buckets_of_the_same_members_are_one(spark):
    """Each set of members stays once, in its parts; no bucket loses a member where batches end."""
    rng = random.Random(5)
    sets = {b: tuple(rng.sample(range(40), rng.choice([1, 2, 2, 3, 7]))) for b in range(3000)} | {b: tuple(range(100, 100 + n)) for b, n in ((3000, 2048), (3001, 2048), (3002, 2049), (3003, 9001), (3004, 4096))}
    buckets = {}
    for b, shorts in sets.items():
        for s in shorts:
            buckets.setdefault(s, []).append(b)
    rows = spark.createDataFrame(list(buckets.items()), "short long, buckets array<long>").repartition(3)
    got = {}
    for r in bucket_links.members(rows).collect():
        got.setdefault(r.bucket, []).append((r.part, r.short, r.first))
    told = sorted(tuple(sorted({s for _, s, _ in x})) for x in got.values())
    assert told == sorted({tuple(sorted(x)) for x in sets.values() if len(x) > 1})
    for x in got.values():
        parts = {}
        for p, s, f in x:
            parts.setdefault(p, []).append(s)
        firsts = {f for _, _, f in x}
        assert len(firsts) == 1 and all(firsts <= set(m) and len(set(m)) == len(m) <= 2049 for m in parts.values())
        assert len(x) == len({s for _, s, _ in x}) + len(parts) - 1
    # batches of any length
    flat = sorted((b, s) for b, x in sets.items() for s in x)
    for n in (1, 2, 7, 700):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat[i : i + n], strict=True)], names=["bucket", "short"]) for i in range(0, len(flat), n)]
        rows = [tuple(r.values()) for b in bucket_links._folded(bucket_links._shared(iter(batches))) for r in b.to_pylist()]
        whole = {}
        for b, _, s, _ in rows:
            whole.setdefault(b, set()).add(s)
        assert sorted(map(sorted, whole.values())) == sorted(map(sorted, {frozenset(x) for x in sets.values() if len(x) > 1}))


def test_groups_are_solved_or_left():
    rng = random.Random(1)
    texts, group = [], []
    for g in range(30):
        base = "".join(rng.choice("abcdefgh ") for _ in range(120))
        for _ in range(rng.choice([2, 3, 8, 30])):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(120)] = "#"
            texts.append("".join(t))
            group.append(g)
    sets = [shingles(t) for t in texts]
    want = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if group[a] == group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    for limit in (1_000_000, 900):
        cols = [pa.array(group), pa.array([0] * len(group)), pa.array([b"%05d" % i for i in range(len(texts))]), pa.array([t.encode() for t in texts])]
        batch = pa.RecordBatch.from_arrays(cols, names=["bucket", "part", "key", "text"])
        out = [r for b in bucket_links._meet(line_dedup._sets(8), 0.8, limit)(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist()]
        got = components(range(len(texts)), [(int(r["ka"]), int(r["kb"])) for r in out if r["ka"]])
        left = {r["left"] for r in out if r["left"] is not None}
        assert bool(left) == (limit == 900) and len(left) < 30
        assert all(got[i] == want[i] for i in range(len(texts)) if group[i] not in left)
        assert all(want[i] == want[got[i]] for i in range(len(texts)))


def test_shingle_hashes_tell_characters_apart():
    lines = ["abcdefghij", "abcdefghiJ", "αβγδεζηθικ", "short", "", "αβγ", "αβγδεζηθ"]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in lines])
    hashes, row = line_dedup._shingles(data, ends - [len(x.encode()) for x in lines], ends, 8)
    told = {i: {int(h) for h, r in zip(hashes, row, strict=True) if r == i} for i in range(len(lines))}
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            x, y = ({s[k : k + 8] for k in range(max(1, len(s) - 7))} for s in (a, b))
            assert len(told[i] & told[j]) == len(x & y)


def test_buckets_do_not_depend_on_other_lines(spark):
    """A line has the same buckets in a block of plain characters and beside others, so near lines meet from both."""
    line = "a plain line of about sixty characters, which stands in two blocks"
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], names=["doc_id", "text"])
    plain, mixed = (next(line_dedup._lines(8, 10, 4)(iter([batch(t)]))).to_pylist()[0] for t in (line, line + "\nγραμμή"))
    assert plain == mixed
    docs = spark.createDataFrame([(1, line), (2, f"{line}!\nγραμμή")], "doc_id long, text string").repartition(2, "doc_id")
    assert [(r.doc_id, r.gone) for r in line_dedup.repeated_lines(docs).collect()] == [(2, [0])]


def test_blank_lines_are_told():
    lines = ["", " ", " a", "a ", "\t \r", "\u00a0", "b", " ", ""]
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    _, start, stop = line_dedup.line_bounds(data, np.array([0, len(data)]))
    assert [bool(x) for x in line_dedup._blank(data, start, stop)] == [not x.strip(" \t\r") for x in lines]
