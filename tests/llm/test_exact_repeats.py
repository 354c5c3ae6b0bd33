import hashlib
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import recompression, suffix_dedup


def brute_words(rows, width):
    docs = {}
    for d, t, *_ in rows:
        if d is not None:
            docs.setdefault(d, (t or "").encode().split())
    first = {}
    for d, ws in docs.items():
        for i in range(len(ws) - width + 1):
            k = tuple(ws[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, ws in docs.items():
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), kept)
    return out


def brute_bytes(rows, width):
    docs = {}
    for d, t, *_ in rows:
        if d is not None:
            docs.setdefault(d, (t or "").encode())
    first = {}
    for d in sorted(docs):
        for i in range(len(docs[d]) - width + 1):
            first.setdefault(docs[d][i : i + width], (d, i))
    out = {}
    for d, raw in docs.items():
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < (d, i):
                gone[i : i + width] = True
        spans = int((gone[1:] > gone[:-1]).sum() + gone[0])
        out[d] = (len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]))
    return out


@pytest.mark.parametrize("width", [50, 12])
def test_words_against_brute_force(spark, width):
    docs = frame(spark)
    rows = recompression.remove_words(docs, recompression.repeated_words(docs, width)).collect()
    want = brute_words(documents(), width)
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in documents())
    assert any(w[1] for w in want.values())
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept.encode()) == want[r.doc_id]


@pytest.mark.parametrize(("width", "anchor", "bucket"), [(100, 32, 512), (100, 32, 2), (24, 8, 512)])
def test_bytes_against_brute_force(spark, width, anchor, bucket):
    docs = frame(spark)
    rows = suffix_dedup.remove_bytes(docs, suffix_dedup.repeated_bytes(docs, width, anchor=anchor, bucket=bucket)).collect()
    want = brute_bytes(documents(), width)
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in documents())
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert recompression.remove_words(docs, recompression.repeated_words(docs)).count() == 0
    assert suffix_dedup.remove_bytes(docs, suffix_dedup.repeated_bytes(docs)).count() == 0


def test_whole_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    words = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.query(spark, path.rpartition("/")[0]).collect()}
    assert words == {d: (n, g, sha(k)) for d, (n, g, k) in brute_words(rows, 50).items()}
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, path.rpartition("/")[0]).collect()}
    assert found == {d: (n, g, s, sha(k)) for d, (n, g, s, k) in brute_bytes(rows, 100).items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcd", max_size=60), min_size=1, max_size=4), st.integers(2, 9))
def test_windows_choose_by_content(texts, width):
    """Equal windows choose equal symbols, at equal places."""
    with np.errstate(over="ignore"):
        names = np.array([ord(c) * 7919 for t in texts for c in t], np.uint64)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        if len(names) < width:
            return
        parse = recompression.Parse(names, doc)
        for turn in range(3):
            parse.runs()
            parse.pairs(turn)
        pick = recompression.chosen(parse, len(names), width)
    seen = {}
    for w in range(len(names) - width + 1):
        if doc[w] == doc[w + width - 1]:
            got = (int(parse.start[pick[w]]) - w, int(parse.name[pick[w]])) if pick[w] >= 0 else None
            assert seen.setdefault(tuple(names[w : w + width]), got) == got


def test_interval_tree_is_complete():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 300).astype(np.uint8)
    place = np.arange(280)
    order, lcp = suffix_dedup.suffix_order(text, np.zeros(280, np.uint64), place, np.full(280, 300), 6)
    raw = text.tobytes()
    for i in range(1, len(order)):
        a, b = raw[order[i - 1] :], raw[order[i] :]
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[i] == (same if same >= 6 else 0)
    groups = {raw[order[a] : order[a] + d]: sorted(order[a:b].tolist()) for a, b, d in suffix_dedup.intervals(lcp, 6)}
    for content, members in groups.items():
        assert members == [p for p in range(280) if raw[p : p + len(content)] == content]
