"""Greedy cuts of long documents, by doubling, against the pass over spans and lines."""

import random

import pytest

from attestra.operators import segments as sg


def cut(spans, limit):
    out = []
    for s, e in sorted(spans):
        if out and e - out[-1][0] <= limit:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("limit", [1, 40, 10_000])
def test_windows_by_doubling_equal_the_greedy_pass(spark, limit):
    rng, rows = random.Random(limit), []
    for d in range(12):
        at = 0
        for _ in range(rng.choice([1, 2, 60, 150])):
            at += rng.randrange(0, 5)
            size = rng.choice([1, 7, 12, 55])
            rows.append((f"v{d}", at, at + size))
            at += size
    spans = spark.createDataFrame(rows, "video_id string, start int, end int")
    want = sorted((f"v{d}", k, s, e) for d in range(12) for k, (s, e) in enumerate(cut([r[1:] for r in rows if r[0] == f"v{d}"], limit)))
    for long in (3, 10**6):
        assert sorted(tuple(r) for r in sg.merged_windows(spans, limit, long).collect()) == want


def test_chunks_by_doubling_equal_those_in_an_array(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["", "  ", "a" * rng.randrange(1, 30), "b" * 90]) for _ in range(rng.randrange(1, 120))) for _ in range(8)] + ["", "\n\n \n", None, "one line"]
    docs = spark.createDataFrame([(f"v{k}", t) for k, t in enumerate(texts)], "video_id string, text string")
    far = sorted(tuple(r) for r in sg.line_chunks(docs, 60, 0).collect())
    assert far == sorted(tuple(r) for r in sg.line_chunks(docs, 60, 10**6).collect()) and len(far) > 100


def test_a_text_of_many_lines(spark):
    docs = spark.range(1).selectExpr("'v' as video_id", "array_join(transform(sequence(1, 60000), i -> concat('line ', i)), '\n') as text")
    rows = sg.line_chunks(docs).selectExpr("count(*) as n", "sum(length(text)) as chars", "max(length(text)) as longest", "max(chunk) as last").first()
    assert rows["longest"] <= 800 and rows["last"] == rows["n"] - 1 and rows["chars"] + rows["n"] - 1 == docs.selectExpr("length(text) as n").first()["n"]
