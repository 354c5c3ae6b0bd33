"""Texts that hashes modulo a power of two take for equal: a Thue-Morse word and its complement."""

from test_exact_repeats import brute_bytes, brute_words

from parley.llm import decontaminate, line_dedup, recompression, suffix_dedup


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits)


WORD = thue_morse(1024)
OTHER = WORD.translate(str.maketrans("ab", "ba"))


def test_words_and_bytes(spark):
    tail = " ".join(f"w{i}" for i in range(49))
    seq = [" ".join(("no", "yes")[c == w] for c in WORD) for w in "ab"]
    rows = [(1, f"{WORD} {tail}"), (2, f"{OTHER} {tail}"), (3, seq[0]), (4, seq[1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in recompression.remove_words(docs, recompression.repeated_words(docs)).collect()}
    assert words == brute_words(rows, 50)
    assert words[2][1] == 0
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_bytes(docs, suffix_dedup.repeated_bytes(docs)).collect()}
    assert found == brute_bytes(rows, 100)


def test_lines_and_items(spark):
    docs = spark.createDataFrame([(1, WORD), (2, OTHER), (3, f"q {WORD}x")], "doc_id long, text string")
    texts = [r.text for r in line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs, similarity=1.01)).orderBy("doc_id").collect()]
    assert texts == [WORD, OTHER, f"q {WORD}x"]
    marks = spark.createDataFrame([(7, f"{OTHER} one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {WORD} one two three four five six seven"), (2, f"x {OTHER} one two three four five six seven")], "doc_id long, text string")
    got = {r.doc_id: r.similarity for r in decontaminate.leaks(docs, marks, similarity=0.5).collect()}
    assert got[2] == 1.0 and got.get(1, 0.5) < 1


def test_shingles_are_of_characters(spark):
    """Lines of characters of two and three bytes are as alike as their characters are."""
    base = "Δοκιμή γραμμής με αρκετά γράμματα ώστε να μετρά 検査のための行"
    near, far = base[:-1] + "x", "".join(chr(ord(c) + 1) if i % 5 == 0 else c for i, c in enumerate(base))
    docs = spark.createDataFrame([(1, base), (2, near), (3, far)], "doc_id long, text string")
    kept = [r.text for r in line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs)).orderBy("doc_id").collect()]
    assert kept == [base, "", far]
