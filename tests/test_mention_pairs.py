"""Nearest mentions of a window: all pairs by plain Python; windows are dealt once and no pair is shuffled."""

import random

from attestra.operators import segments as sg


def test_nearest_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    held = []
    for k in range(60):
        spans = [(rng.randrange(40), rng.randrange(1, 6)) for _ in range(rng.choice([2, 3, 8, 25]))]
        held += [(f"d{k % 7}", k, f"m{rng.randrange(1000):03d}{i}", s, s + n, f"w{i}") for i, (s, n) in enumerate(spans)]
    df = spark.createDataFrame(held, "video_id string, window int, mention_id string, start int, end int, surface string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        found = sg.mention_pairs(df, 4, carry=("surface",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for v, w in {r[:2] for r in held}:
        ms = sorted((r[3], r[2], r[3] + r[4], r[5]) for r in held if r[:2] == (v, w))
        pairs = sorted((abs(x[2] - y[2]) / 2, x[:2], y[:2], x[3], y[3]) for i, x in enumerate(ms) for y in ms[i + 1 :])[:4]
        want += [(v, w, n, a[1], b[1], d, p, q) for n, (d, a, b, p, q) in enumerate(pairs, 1)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_windows_are_dealt_once(spark):
    held = spark.range(100).selectExpr("concat('d', id % 5) video_id", "int(id % 3) window", "concat('m', id) mention_id", "int(id) start", "int(id + 3) end")
    pairs = sg.mention_pairs(held)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Scan ExistingRDD" not in plan
    assert pairs.count() == 150 and sg.mention_pairs(held.limit(0)).count() == 0
