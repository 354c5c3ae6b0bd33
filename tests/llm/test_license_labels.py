import re
from collections import defaultdict

from fixtures import documents, frame
from test_documents import lower

from parley.llm import license_scan as ls


def brute(ws):
    """{label: share} of the templates: every diagonal of word 3-grams, runs of diagonals at most two apart."""
    told = {}
    three = lambda a: [tuple(a[i : i + 3]) for i in range(len(a) - 2)]
    have = three(ws)
    for exact, rows in ((True, ls.PHRASES), (False, ls.NOTICES)):
        for label, text in rows:
            want = text.split()
            votes = defaultdict(list)
            for i, g in enumerate(have):
                for j, h in enumerate(three(want)):
                    if g == h:
                        votes[i - j].append(i)
            if exact:
                if any(ws[i : i + len(want)] == want for i in range(len(ws))):
                    told[label] = 1.0
                continue
            runs = []
            for d in sorted(votes):
                if not runs or d - runs[-1][-1] > 2:
                    runs.append([])
                runs[-1].append(d)
            for run in runs:
                places = [i for d in run for i in votes[d]]
                a, b = min(places), max(places) + 3
                share = len(set(three(ws[a:b])) & set(three(want))) / len(set(three(want)))
                if len(places) >= 0.6 * (len(want) - 2) and b - a <= 2 * len(want) and share >= 0.6:
                    told[label] = max(told.get(label, 0), share)
    return told


def test_labels_and_scores(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows, at = documents(), 700
    for _, text in ls.NOTICES:
        ws = text.split()
        for t in (ws, [*ws[:7], "odd", *ws[7:]], ws[: len(ws) // 2], ws[:3] + ws[4:9] + ["x"] + ws[10:], ws[len(ws) // 3 :], ["pre", *ws, *ws], ws[::-1]):
            rows.append((at, f"Some words. {' '.join(t).title()}! More of it.", None, None))
            at += 1
    got = {(r.doc_id, r.n_words): (r.labels, round(r.score, 9)) for r in ls.label_documents(frame(spark, rows)).collect()}
    assert sum(bool(v[0]) for v in got.values()) > 30
    for d, t, *_ in rows:
        ws = word.findall(lower(t or ""))
        told = brute(ws)
        assert got[d, len(ws)] == (",".join(sorted(told)), round(max(told.values(), default=0.0), 9)), (d, t)
