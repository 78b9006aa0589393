"""License scans against a plain scan, over whole sample tables and odd rows."""

import random
import re

import duckdb
import pytest

from attestra.llm import licenses
from attestra.llm import queries as q

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, labels string, words string, t string, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_spans(text, templates, gram=3, slide=3, cover=0.8, whole=10):
    """(label, phrase, begin, end, votes, coverage) by loops over all diagonals."""
    w, out, notices = words(text), [], []
    for at, x in enumerate(templates):
        t = words(x.text)
        if not t:
            continue
        g, lines = min(gram, len(t)), []
        for d in range(-len(t) + 1, len(w)):
            same = [k for k in range(len(t)) if 0 <= d + k < len(w) and w[d + k] == t[k]]
            votes = [k for k in same if {*range(k, k + g)} <= {*same}]
            if votes:
                lines.append((d + votes[0], d, d + votes[-1] + g, len(votes), same))
        if x.phrase:
            out += [(x.label, True, b, e, v, 1.0) for b, d, e, v, same in lines if len(same) == len(t)]
            continue
        far, spans = min(slide, len(t) // 4), []
        for line in sorted(lines, key=lambda r: r[:2]):
            if spans and abs(line[1] - spans[-1][-1][1]) <= far and line[0] - spans[-1][-1][2] <= len(t):
                spans[-1].append(line)
            else:
                spans.append([line])
        for s in spans:
            coverage = len({k for line in s for k in line[4]}) / len(t)
            if coverage >= (1 if len(t) < whole else cover):
                notices.append((coverage, sum(r[3] for r in s), -at, min(r[0] for r in s), max(r[2] for r in s), x.label))
    for c, v, at, b, e, label in notices:
        if not any(o[3] < e and b < o[4] and o[:3] > (c, v, at) for o in notices):
            out.append((label, False, b, e, v, c))
    return sorted(out)


def plain_row(doc_id, text):
    spans = plain_spans(text, licenses.TEMPLATES)
    base = [s for s in spans if s[1]]
    score = max([0.5 if s[1] else s[5] for s in spans], default=0.0)
    return (doc_id, len(words(text)), len(base), min((s[2] for s in base), default=None), max((s[2] for s in base), default=None), ",".join(sorted({s[0] for s in base})), ",".join(sorted({s[0] for s in spans})), round(score, 9))


def test_query_matches_plain_scan(spark):
    want = sorted(plain_row(*r) for r in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = sorted((*r[:7], round(r[7], 9)) for r in q.op13_license_scan(spark, SF).collect())
    assert got == want
    assert {r[6] for r in got} == {"", "apache,apache-2.0", "mit", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0"}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(2)
    notice = licenses.NOTICES[4].text
    w = notice.split()
    near = [*w[:10], "kindly", *w[10:20], *w[22:]]
    noise = lambda n: " ".join(rng.choice(["the", "software", "and", "or", "license", "by", "cc", "mit", "of", "copy"]) for _ in range(n))
    texts = [None, "", " .,;\n", "MIT License", "mit-license, CC/BY and gnu general public license", notice, " ".join(near), " ".join(w[: len(w) // 2]), f"{noise(300)} {notice} {noise(300)} {' '.join(near)}", noise(40_000), "cc by " * 3000, "x" * 200_000, "Licensed under the Apache License, Version 2.0. " * 50, "Permission is hereby granted", "Licensed under the Foo License", licenses.NOTICES[6].text, licenses.NOTICES[7].text]
    rows = list(enumerate(texts)) + [(3, "MIT License")] * 3 + [(None, "mit license"), (5, "another text under the MIT License")]
    return rows


def test_odd_rows_match_plain_scan(spark, odd):
    frame = spark.createDataFrame([(i, t, "kept", "kept", "kept", "kept", "kept") for i, t in odd], DOCS)
    out = licenses.scan_licenses(frame).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["places"], r["labels"], round(r["score"], 9), sorted((s["label"], s["phrase"], s["begin"], s["end"], s["votes"], s["coverage"]) for s in r["spans"] or [])) for r in out)
    want = []
    for i, t in odd:
        row, spans = plain_row(i, t), plain_spans(t, licenses.TEMPLATES)
        want.append((str(i), row[1], row[2], row[6].split(",") if row[6] else [], row[7], spans))
    assert got == sorted(want)
    labels = {r["doc_id"]: r["labels"] for r in out if r["doc_id"] in (6, 7, 14, 15, 16)}
    assert labels == {6: ["mit"], 7: [], 14: [], 15: ["gpl", "gpl-3.0"], 16: ["gpl", "gpl-2.0"]}


def test_no_documents_or_templates(spark, odd):
    frame = spark.createDataFrame([(i, t, "kept", "kept", "kept", "kept", "kept") for i, t in odd], DOCS)
    assert licenses.scan_licenses(frame.limit(0)).count() == 0
    assert licenses.license_spans(frame, []).count() == 0
    assert licenses.license_spans(frame, [licenses.Template("none", " .. ")]).count() == 0
    one = licenses.license_spans(frame, [licenses.Template("word", "permission", True)]).collect()
    assert {r["doc_id"] for r in one} == {5, 6, 7, 8, 13}
