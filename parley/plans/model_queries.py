"""Queries of plugged-in models, with small functions of the text in place of trained ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import models as md
from parley.plans.bind import FRAMES, frames, spread, table

LETTERS = "aeiou"


def _letter_shares():
    """A classifier: the share of a few letters; it refuses texts without any letter of them."""
    def model(texts):
        for t in texts:
            if not any(c in t for c in LETTERS):
                raise ValueError("no letter of these")
        return [{c: t.count(c) / len(t) for c in LETTERS} for t in texts]

    return model


def classified(spark, d):
    """Every document through a classifier of letters."""
    out = md.classify(spread(table(spark, d, "documents")).select("doc_id", "text"), _letter_shares, "text")
    return out.select("doc_id", *(F.round(F.col("scores")[c], 9).alias(c) for c in LETTERS), "error")


def _sentences():
    """A decoder: the sentences of a text, with figures from their lengths."""
    return lambda texts: [[{"text": s, "avg_logprob": -len(s) / 100, "no_speech_prob": 0.0, "compression_ratio": 1.0} for s in t.split(". ") if s] for t in texts]


def decoded(spark, d):
    """Every document's sentences as pieces."""
    out = md.decode(spread(table(spark, d, "documents")), _sentences, ["doc_id"], "text")
    return out.select("doc_id", "piece_idx", F.md5("text").alias("text_md5"), "avg_logprob")


class _Smooth:
    """A scorer with a memory: the running mean of what it heard, halved at every step."""

    def __init__(self):
        self.last = 0.0

    def __call__(self, x):
        self.last = 0.5 * self.last + 0.5 * x
        return self.last


def scored_frames(spark, d):
    return md.score_frames(frames(spark, d), _Smooth, ["session_id"], frame="prob").withColumn("prob", F.round("prob", 9))


QUERIES = {"classify": classified, "decode": decoded, "score_frames": scored_frames}

_SHARES = ", ".join(f"CASE WHEN ok THEN round((length(text) - length(replace(text, '{c}', ''))) / length(text), 9) END AS {c}" for c in LETTERS)
SQL = {
    "classify": f"SELECT doc_id, {_SHARES}, CASE WHEN ok OR text IS NULL THEN '' ELSE 'ValueError: no letter of these' END AS error FROM (SELECT doc_id, text, regexp_matches(text, '[{LETTERS}]') AS ok FROM documents)",
    "decode": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS piece_idx, md5(s) AS text_md5, -length(s) / 100 AS avg_logprob
FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents) WHERE s <> ''""",
    "score_frames": f"""WITH RECURSIVE {FRAMES}, s AS (SELECT session_id, frame_idx, 0.5 * prob AS p FROM frames WHERE frame_idx = 0
UNION ALL SELECT f.session_id, f.frame_idx, 0.5 * s.p + 0.5 * f.prob FROM s JOIN frames f ON f.session_id = s.session_id AND f.frame_idx = s.frame_idx + 1)
SELECT session_id, frame_idx, round(p, 9) AS prob FROM s""",
}
