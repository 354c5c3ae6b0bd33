"""Small documents with every awkward case, made by rule from a seed."""

import random

WORDS = "an the of red blue stone river house green under over mill lane boat cart Über día ça field".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "s"]) for _ in range(n))


def documents(seed=3, n=40):
    """(doc_id, text, lang, source): copies, near copies, shared passages, junk, null and empty texts, repeats, ties."""
    rng = random.Random(seed)
    shared = prose(rng, 70)
    texts = [prose(rng, rng.choice([1, 3, 30, 60, 120, 300])) for _ in range(n)]
    texts += [texts[i] for i in (2, 3, 3, 5)]
    for i in (4, 9, 14):
        ws = texts[i].split()
        texts.append(" ".join(ws[: len(ws) // 2] + ["odd"] + ws[len(ws) // 2 + 1 :]))
    texts += [f"{prose(rng, k)} {shared} {prose(rng, 12)}" for k in (0, 5, 40)]
    texts += [shared, "x " * 130, "x " * 70 + prose(rng, 5), "a b " * 60, "\n\n", "", " ", "ß€𝄞" * 80, "\x00\x01 \x00 ok " * 30, None]
    texts += ["\n".join(prose(rng, 9) for _ in range(4)) + "\n" + texts[4][:90], "y" * 1500, "one\r\ntwo\tthree\x0bfour\x0cfive\x85six"]
    rows = [(i * 3 % 101, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[1], None, None)]


SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = "key, variant, n, start, first, component, spans, fp, gone, size, lang_pred, pattern, node"


def frame(spark, rows=None):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", *(f"'odd' AS {c.strip()}" for c in CLASH.split(",")))
