import corpus_pipeline as cp


def test_rows_of_null_and_of_shared_doc_id(spark):
    rows = [(None, "a b c", "en", "s", 5), (None, "d e", "en", "s", 3), (1, "f", "en", "s", 1), (1, "g h i j", "en", "s", 7), (2, "k l", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.mix_sources(spark, docs, None)
    assert out.columns == [*docs.columns, "size", "repeats", "taken"]
    got = sorted((r.text, r.doc_id, r.size, r.repeats, r.taken) for r in out.collect())
    assert got == sorted((t, d, len(t.split()), 1, len(t.split())) for d, t, *_ in rows)
