"""Novel links: all pairs by plain Python, over components and groups of tasks; no pair is shuffled."""

import random
from itertools import combinations

import pytest

from attestra.operators import building as bd

SCHEMA = "subject_id string, object_id string, transcript_id string, rel_id string, confidence double"


def shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def plain(rel, least, limit):
    rel = [r for r in rel if r[0] != r[1]]
    near, told, own = {}, {}, {}
    for s, o, t, r, c in rel:
        for e, m in ((s, o), (o, s)):
            near.setdefault(e, set()).add(m)
            told.setdefault(e, set()).update([t] if t is not None else [])
            own.setdefault(e, []).append((m, t, r, c))
    out = []
    for a, b in combinations(sorted(near), 2):
        n, t = len(near[a] & near[b]), len(told[a] & told[b])
        if n and b not in near[a] and n + t >= least:
            support = sum(sum(c or 0.0 for r, c in {(r, c) for m, x, r, c in own[p] if m in near[q] or x in told[q]}) for p, q in ((a, b), (b, a)))
            out.append((-round(2 * n + t + 0.1 * support, 6), a, b, n, t, round(support, 6)))
    return sorted(out)[:limit]


@pytest.mark.parametrize("rows", [1_000_000, 120, 40])
def test_novel_links_are_those_of_all_pairs(spark, monkeypatch, rows):
    rng = random.Random(rows)
    rel = [(f"{part}{rng.randrange(n)}", f"{part}{rng.choice('mxé')}{rng.randrange(12)}", rng.choice([None, *(f"t{k}" for k in range(6))]), f"r{rng.randrange(150)}", rng.choice([None, 0.25, 0.5, 1.0])) for part, n in (("p", 9), ("q", 14), ("z", 5)) for _ in range(70)]
    rel += [("p1", "p2", "t1", "r1", 0.5), ("p1", "p1", "t1", "r2", 0.5), ("p3", None, "t1", "r3", 0.5)]
    want = plain([r for r in rel if r[1]], 2, 20)
    monkeypatch.setattr(bd, "LINK_ROWS", rows, raising=False)
    monkeypatch.setattr(bd, "PROBED", 6)
    got = bd.novel_links(spark.createDataFrame(rel, SCHEMA), limit=20).collect()
    assert [(-r["score"], r["a"], r["b"], r["shared_nodes"], r["shared_transcripts"], r["support"]) for r in got] == want


def test_pairs_of_hubs_are_not_shuffled(spark):
    """50 hubs with the same 80 transcripts: 98,000 meetings of pairs and transcripts, 4,000 relations."""
    rel = spark.range(4000).selectExpr("concat('hub', id % 50) subject_id", "concat('n', id div 50 % 20) object_id", "concat('t', id div 50) transcript_id", "concat('r', id) rel_id", "0.5D confidence")
    before = shuffled_rows(spark)
    assert len(bd.novel_links(rel).collect()) == 50
    assert shuffled_rows(spark) - before < 60_000
