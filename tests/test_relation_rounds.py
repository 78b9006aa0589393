"""Synchronous truth of relations: tasks that hold whole components give what rounds over all rows give."""

import random

import pytest

from attestra.operators import graph as gr
from attestra.operators import reasoning as rs
from attestra.operators import sweeps as sw

SCHEMA = "rel_id string, subject_id string, object_id string, confidence double, anchor double"


def relations(seed):
    rng = random.Random(seed)
    rows = [(f"r{p}{k}", f"{p}{rng.randrange(n)}", f"{p}{rng.randrange(n)}", rng.choice([0.0, 0.3, 0.5, 0.9, None]), rng.choice([None, None, 0.0, 0.2, 1.0])) for p, n in (("a", 6), ("b", 30), ("c", 3)) for k in range(24)]
    return [*rows, ("n1", "a1", None, 0.7, 0.4), ("n2", None, "b2", 0.7, 0.9), ("n3", None, None, 0.7, 0.9), ("l", "solo", "solo", 0.5, 0.3), (None, "x", "y", 0.5, 0.1)]


@pytest.mark.parametrize(("most", "epsilon"), [(1_000_000, 0.0), (30, 0.02), (1, 0.0)])
def test_rounds_in_tasks_are_rounds_over_all_rows(spark, most, epsilon):
    df = spark.createDataFrame(relations(3), SCHEMA)
    start = df.withColumn("value", df["anchor"])
    want, taken, change = rs.settle(start, lambda s: gr.propagate_round(s, was="was"), "value", "was", 7, epsilon)
    got, rounds, last = sw.relation_rounds(df, 7, epsilon, most=most)
    assert rounds == taken and abs(last - change) < 1e-9
    key = lambda r: (r["rel_id"] or "", r["subject_id"], r["object_id"])
    one, two = sorted(want.collect(), key=key), sorted(got.collect(), key=key)
    assert [key(r) for r in one] == [key(r) for r in two]
    assert all(a["value"] is None and b["value"] is None or abs(a["value"] - b["value"]) < 1e-9 for a, b in zip(one, two, strict=True))


def test_relations_are_dealt_once_not_in_every_round(spark, monkeypatch):
    made, real = [], gr.propagate_round
    monkeypatch.setattr(gr, "propagate_round", lambda *args, **kwargs: made.append(1) or real(*args, **kwargs))
    df = spark.createDataFrame(relations(4), SCHEMA)
    out, taken, _ = rs.relation_truth(df, 5, 0.0)
    assert taken == 5 and out.count() == 74 and not made
