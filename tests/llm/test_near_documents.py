import random

from test_documents import components, shingles

from parley.llm import line_dedup, simhash


def grams(text, k=5):
    ws = text.split()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def alike(a, b):
    return bool(a | b) and len(a & b) >= 0.8 * len(a | b) or a == b


def changed(ws, at, word):
    ws = list(ws)
    for i in at:
        ws[i] = word
    return ws


def test_documents_at_both_sides_of_the_similarity(spark):
    """17 of 804 words changed leave 0.808 of the shingles alike, 18 leave 0.798."""
    rng, rows = random.Random(8), []
    for i in range(120):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(804)]
        n = 17 + i % 2
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(changed(ws, range(10, 10 + 40 * n, 40), "odd")))]
    sets = {d: grams(t) for d, t in rows}
    near = [alike(sets[2 * i], sets[2 * i + 1]) for i in range(120)]
    assert near == [i % 2 == 0 for i in range(120)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(120)} | {2 * i + 1 for i in range(120) if not near[i]}


def test_family_of_documents_against_all_pairs(spark):
    """A form that many documents fill in, each with a near copy, short texts, equal ones and texts without words."""
    rng = random.Random(5)
    form = [f"form{i}" for i in range(90)]
    rows = [(900 + i, t) for i, t in enumerate([None, "", " \n", "one two", "One  two", "one two three four five", "x y z"])]
    for i in range(60):
        ws = form + [f"own{rng.randrange(10**6)}" for _ in range(14)]
        rows += [(4 * i, " ".join(ws)), (4 * i + 1, " ".join(changed(ws, [rng.randrange(88, 104)], "odd"))), (4 * i + 2, " ".join(changed(ws, [3 + i % 9, 40], "odd")))]
    sets = {d: grams((t or "").lower()) for d, t in rows}
    want = components(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    docs = spark.createDataFrame([*rows, rows[9], (None, "one two")], "doc_id long, text string")
    got = simhash.similar_documents(docs, **simhash.STAGE).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items()) and len(got) == len(rows) + 1


def test_family_of_lines_against_all_pairs(spark):
    """Some hundred lines of one template fill the buckets of all bands; each has a near copy, unlike pairs are at 0.75."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    form = "".join(rng.choice(letters) for _ in range(93))
    lines = []
    for _ in range(300):
        own = "".join(rng.choice(letters) for _ in range(14))
        lines += [form + own, form[:60] + "#" + form[61:] + own]
    sets = [shingles(s) for s in lines]
    want = components(range(len(lines)), [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.repeated_lines(docs).collect()}
    assert len(set(want.values())) > 1
    assert gone == {i for i, c in want.items() if i != c}


def test_fingerprints_bring_documents_together(spark):
    """One word in 4,000 changed: a single band of 1,024 values joins few such pairs, their SimHash fingerprints nearly all."""
    rng, rows = random.Random(9), []
    for i in range(20):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(changed(ws, [2000], "odd")))]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8, bands=1, rows=1024).collect()
    assert sum(r.component_id == r.doc_id - 1 for r in got if r.doc_id % 2) >= 17
    assert all(r.component_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in got)
