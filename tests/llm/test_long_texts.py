import hashlib

from parley.llm import decontaminate, language_id, line_dedup, recompression, simhash, suffix_dedup
from parley.llm.textblocks import CHUNK


def test_margin_does_not_fall_with_length(spark):
    """A clear text of several MB is told as surely as its first part."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = docs.where("lang = 'en'").orderBy("doc_id").select("text").limit(4000).collect()
    text = "\n".join(r.text for r in rows if r.text)
    long = (text * (5_000_000 // len(text) + 1))[:5_000_000]
    out = language_id.identify(spark.createDataFrame([(1, long), (2, long[:100_000])], "doc_id long, text string"), model)
    long, short = sorted(out.collect(), key=lambda r: r.doc_id)
    assert long.lang_pred == short.lang_pred == "en"
    assert long.accepted and short.accepted and long.margin > 0.5 * short.margin


def _long():
    """A text of 3 MB, more than one block of bytes, without a repeat; 12 words a line."""
    ws = [hashlib.md5(str(i).encode()).hexdigest()[:9] for i in range(300_000)]
    return "\n".join(" ".join(ws[i : i + 12]) for i in range(0, len(ws), 12))


def test_copies_beyond_a_block(spark):
    """A copy with an end of its own: all of it but the end goes, at each of the operators."""
    text = _long()
    assert len(text) > CHUNK
    tail = "here is an end of its own that nobody else has"
    rows = [(1, text), (2, f"{text}\n{tail}"), (3, "a short one"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    w = by_id(recompression.remove_words(docs, recompression.repeated_words(docs)))
    assert {d: (r.n_words, r.n_removed) for d, r in w.items()} == {1: (300_000, 0), 2: (300_011, 300_000), 3: (3, 0), 4: (0, 0)}
    assert w[2].kept == tail and w[1].kept == " ".join(text.split())
    b = by_id(suffix_dedup.remove_bytes(docs, suffix_dedup.repeated_bytes(docs)))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans) for d, r in b.items()} == {1: (len(text), 0, 0), 2: (len(text) + 1 + len(tail), len(text), 1), 3: (11, 0, 0), 4: (0, 0, 0)}
    assert bytes(b[2].kept).decode() == f"\n{tail}"
    lines = by_id(line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs)))
    assert (lines[1].text, lines[2].text, lines[3].text, lines[4].text) == (text, tail, "a short one", None)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept in ({1, 3, 4}, {2, 3, 4})


def test_leaks_beyond_a_block_and_in_repeated_rows(spark):
    """An item at the end of a long text is found; repeated rows each go, rows of null ids stay as stated."""
    text = _long()
    item = " ".join(text.split()[290_000:290_030])
    docs = spark.createDataFrame([(1, text), (2, "clean " + text[:3000]), (3, item), (3, item), (None, "nothing of it")], "doc_id long, text string")
    marks = spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, marks).collect()} == {(1, 7), (3, 7)}
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(docs, marks).collect()) == [0, 2]
