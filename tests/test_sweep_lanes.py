"""Sweeps of small components side by side: the same values as one by one, from rows that are read once."""

import random

import numpy as np
import pandas as pd
from pyspark.sql.functions import udf

from attestra.operators import reasoning as rs
from attestra.operators import sweeps as sw

RELATIONS = "rel_id string, subject_id string, object_id string, confidence double, anchor double, row long"
CLAIMS = "claim_id string, confidence double, truth double"
DEPS = "source string, target string, kind string, rationale string"


def counted(spark, df, column):
    """df, and how often a value of column was made."""
    n = spark.sparkContext.accumulator(0)

    @udf("string")
    def told(x):
        n.add(1)
        return x

    return df.withColumn(column, told.asNondeterministic()(column)), n


def test_relations_side_by_side_equal_the_loop():
    rng = random.Random(5)
    rows = [(g, k, f"n{g}-{rng.randrange(5)}", f"n{g}-{rng.randrange(5)}", rng.choice([0.0, 0.3, 0.8]), rng.choice([np.nan, np.nan, 0.1, 0.9])) for g in range(60) for k in range(rng.randrange(1, 9))]
    place = np.array([r[1] for r in rows])
    sweep, value = sw.relation_lanes(*(np.array([r[i] for r in rows], object if i < 4 else float) for i in (2, 3, 4, 5)), place, 0.4)
    held = [[s, o, c, sw._value(a), sw._value(a)] for _, _, s, o, c, a in rows]
    sums = sw.relation_sums(held)
    for _ in range(6):
        assert sweep() == sw.sweep_relations(held, *sums, 0.4)
        assert np.array_equal(value, np.array([r[4] for r in held], float), equal_nan=True)


def test_claims_side_by_side_equal_the_loop():
    rng = random.Random(6)
    names = [(g, k) for g in range(60) for k in range(rng.randrange(1, 9))]
    number = {x: i for i, x in enumerate(names)}
    links = [(number[x], number[rng.choice([y for y in names if y[0] == x[0]])], rng.choice(["supports", "logical", "alternative", "undercuts", "presupposes"])) for x in names for _ in range(2)]
    sure, anchor = np.array([rng.choice([0.0, 0.2, 0.9]) for _ in names]), np.array([rng.choice([np.nan, 0.2, 0.9]) for _ in names])
    for together in (False, True):
        source, target, how = (np.array([x[i] for x in links], kind) for i, kind in enumerate((int, int, object)))
        sweep, value = sw.claim_lanes(source, target, how, sure, anchor, np.array([0 if together else k for _, k in names]), together=together)
        now, pulls, needs = {i: a for i, a in enumerate(anchor.tolist()) if a == a}, {}, {}
        for s, t, h in links:
            needs.setdefault(s, []).append(t) if h == "presupposes" else pulls.setdefault(t, []).append((s, h))
        for _ in range(6):
            assert sweep() == sw.sweep_claims([(i, sw._value(a)) for i, a in enumerate(anchor.tolist())], pulls, needs, now, dict(enumerate(sure.tolist())), together=together)
            assert np.array_equal(value, np.array([now.get(i) for i in range(len(names))], float), equal_nan=True)


def test_claims_are_read_once(spark):
    claims = spark.createDataFrame([(f"c{k:03d}", 1.0, 0.9 if k % 5 == 0 else None) for k in range(100)], CLAIMS)
    deps = spark.createDataFrame([(f"c{k:03d}", f"c{k + 1:03d}", "supports", None) for k in range(99) if k % 5 < 4], DEPS)
    for options in ({}, {"order": "claim_id"}):
        seen, n = counted(spark, claims, "claim_id")
        out = rs.claim_truth(seen, deps, None, 50, 1e-9, **options)[0]
        assert out.where("abs(value - 0.9) < 1e-9").count() == 100 and n.value == 100


def test_relations_are_read_once(spark):
    rows = [(f"r{k:03d}", f"n{k}", f"n{k + 1 if k % 5 < 4 else k}", 1.0, 0.9 if k % 5 == 0 else None, k) for k in range(100)]
    edges, n = counted(spark, spark.createDataFrame(rows, RELATIONS), "rel_id")
    out = sw.relation_sweeps(edges)[0]
    assert out.where("value is not null").count() == 100 and n.value == 100


def test_relations_without_ends_or_names_stay_apart(spark):
    rows = [("a", None, "x", 1.0, 0.5, 1), ("b", None, "y", 1.0, None, 2), ("c", None, None, 1.0, 0.7, 3), ("d", None, None, None, None, 4), ("e", "x", None, 1.0, None, 5)]
    got = {r["rel_id"]: r["value"] for r in sw.relation_sweeps(spark.createDataFrame(rows, RELATIONS))[0].collect()}
    assert got == {"a": got["a"], "b": None, "c": 0.7, "d": None, "e": got["a"]} and abs(got["a"] - 0.5) < 1e-9


def test_frames_of_moves_keep_their_types():
    got = sw._with_moves(pd.DataFrame({"rel_id": ["a"], "value": [0.5]}), [0.25])
    assert got["rel_id"].tolist()[0] == "a" and got["sweep"].isna().tolist() == [True, False]
