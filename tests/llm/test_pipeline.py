import re

import corpus_pipeline as cp
from test_documents import DATA, brute_leaks, components, lower, shingles

from parley.llm import mixing
from parley.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 110")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    extra = [(9001, "12 34 !!", "en", "s", 8), (9002, None, "en", "s", None), (9003, items[0][1], "en", "s", 9), (9004, items[0][1].replace(" ", " \t"), "en", "s", 9), (9005, docs.first().text, None, None, 5)]
    rows = docs.union(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in rows.collect()}
        rows = cut(stage(spark, rows, DATA))
        if name != "mix_sources":
            assert rows.columns == COLUMNS
        kept[name] = before, {r.doc_id: r for r in rows.collect()}

    before, after = kept["language_id"]
    assert not {9001, 9002} & set(after) and len(after) >= 0.95 * len(before) - 2
    assert all(after[d].text == before[d].text and after[d].lang for d in after)

    before, after = kept["line_dedup"]
    lines = {(d, i): s for d, r in before.items() for i, s in enumerate(r.text.split("\n")) if s.strip(" \t\r\x0b\x0c")}
    sets = {p: shingles(s) for p, s in lines.items()}
    order = sorted(lines)
    near = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if 0.7 * len(sets[a]) < len(sets[b]) < 1.4 * len(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    head = components(order, near)
    for d, r in before.items():
        stay = [s for i, s in enumerate(r.text.split("\n")) if head.get((d, i), (d, i)) == (d, i)]
        text = "\n".join(stay)
        if text == r.text or re.search(r"[^\x20\x09-\x0D]", text):
            assert (after[d].text, after[d].n_chars) == (text, len(text)), d
        else:
            assert d not in after

    before, after = kept["simhash_dedup"]
    grams = {d: {" ".join(w) for w in zip(*(lower(r.text).split()[i:] for i in range(5)), strict=False)} for d, r in before.items()}
    for d in before:
        alike = {e: len(grams[d] & grams[e]) / len(grams[d] | grams[e]) for e in before if e != d and grams[d] and grams[e]}
        if len(grams[d]) > 50:
            assert d not in after or not any(s >= 0.9 and e < d for e, s in alike.items())
            assert d in after or max(alike.values()) >= 0.65

    before, after = kept["decontaminate"]
    leaking = {d for d, _ in brute_leaks([(d, r.text) for d, r in before.items()], items)}
    assert 9003 in leaking and set(after) == set(before) - leaking

    before, after = kept["mix_sources"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    targets = mixing.targets(sizes)
    for s, target in targets.items():
        own = [r for r in after.values() if r.source == s]
        assert all(r.taken == r.repeats * size(r.text) and 1 <= r.repeats <= 3 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(size(r.text) for r in before.values() if r.source == s), s


def test_empty_corpus(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        rows = stage(spark, rows, DATA)
        assert rows.count() == 0
