"""The flow of op3 against all flows of small tables and over overlapping sources; op7 against a plain loop."""

import random
import re
from itertools import product

import zstandard
from fixtures import documents, frame

from parley.llm import language_id, mixing


def _cost(words, room):
    """A word of the first pass over a pattern costs 0, of the second 1, of the third 2."""
    return sum(turn * min(room, max(0, words - turn * room)) for turn in range(3))


def _best(a, b, ab, qa, qb):
    """(most words, least cost of these) over all ways to serve two sources from three patterns."""
    best = (0, 0)
    for xa, xb in product(range(min(3 * a, qa) + 1), range(min(3 * b, qb) + 1)):
        for ya, yb in product(range(min(3 * ab, qa - xa) + 1), range(min(3 * ab, qb - xb) + 1)):
            if ya + yb <= 3 * ab:
                found = (xa + xb + ya + yb, -_cost(xa, a) - _cost(xb, b) - _cost(ya + yb, ab))
                best = max(best, found)
    return best[0], -best[1]


def test_flow_against_all_flows():
    rng = random.Random(8)
    for _ in range(150):
        a, b, ab, qa, qb = (rng.randrange(n) for n in (4, 4, 4, 9, 9))
        room = {("a",): a, ("b",): b, ("a", "b"): ab}
        flow = mixing.min_cost_flow(room, {"a": qa, "b": qb})
        assert all(s in p and v > 0 for (p, s), v in flow.items())
        given = {p: sum(v for (q, _), v in flow.items() if q == p) for p in room}
        taken = {s: sum(v for (_, t), v in flow.items() if t == s) for s in "ab"}
        assert all(given[p] <= 3 * room[p] for p in room) and taken["a"] <= qa and taken["b"] <= qb
        assert (sum(taken.values()), sum(_cost(given[p], room[p]) for p in room)) == _best(a, b, ab, qa, qb), (room, qa, qb)


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(2)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "a"], ["a", "b", "c"], ["c", None], [None], [], None, ["a", "a"]]
    rows = [(i, rng.choice(kinds), rng.randrange(40)) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, members array<string>, size long")).collect()
    assert len(out) == len(rows)
    capacity, taken = {}, {}
    for r in out:
        p = tuple(s.s for s in r.pattern)
        assert len(set(p)) == len(p) and set(p) == set(r.members or [])
        assert r.taken == r.repeats * r.size and 0 <= r.repeats <= 3 and (p or r.taken == 0)
        capacity[p], taken[p] = capacity.get(p, 0) + r.size, taken.get(p, 0) + r.taken
    sizes = {}
    for p, c in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + c / len(p)
    quota = {s: round(t) for s, t in mixing.targets(sizes).items()}
    flow = mixing.min_cost_flow({p: c for p, c in capacity.items() if p}, quota)
    for p in capacity:
        want = sum(v for (q, _), v in flow.items() if q == p)
        # what is left open is less than a document of each size
        assert want - 40 <= taken[p] <= want, (p, taken[p], want)
    for s, q in quota.items():
        assert abs(sum(v for (_, t), v in flow.items() if t == s) - q) <= 1
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, members array<string>, size long")).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in out}


def test_codes_against_a_plain_loop(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(texts)
    assert len(model) > 1 and all(0 < len(raw) <= language_id.DICTIONARY_BYTES for _, raw in model)
    docs = frame(spark, [*documents(), *(tuple(r) + (None,) for r in texts.limit(150).collect()), (7, "wörter und straße " * 4000, None, None)])
    seen = 0
    for r in language_id.identify(docs, model).collect():
        letters = " ".join(re.findall(r"[^\W\d_]+", r.text or "")).lower().encode()
        if not any(map(str.isalpha, letters.decode())):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        codes = []
        for lang, raw in model:
            coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            codes.append(sum(len(coder.compress(letters[at : at + 16_384])) for at in range(0, len(letters), 16_384)))
        short, second = sorted(codes)[:2]
        assert r.lang_pred == model[codes.index(short)][0]
        assert abs(r.margin - (second / short - 1)) < 1e-12 and r.accepted == (r.margin >= 0.002)
        assert 0 <= r.score < 1 and (r.score >= 0.5) == r.accepted
        seen += 1
    assert seen > 150
