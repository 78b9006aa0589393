"""Rounds, caps and samples against plain loops; faults that earlier SQL could not show."""

import random

import pytest

from attestra.functions import text as tx
from attestra.operators import claims as cl
from attestra.operators import curation as cu
from attestra.operators import entities as en
from attestra.operators import graph as gr
from attestra.operators import quality as ql
from attestra.operators import reasoning as rs
from attestra.streaming import contradiction as sc


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_agreement_cap_equals_the_greedy_pass(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        a, b = rng.sample(range(9), 2)
        rows.append((f"v{a}:c_{k}", f"v{b}:c_{k}", f"v{a}", f"v{b}"))
    pairs = spark.createDataFrame(rows, "left string, right string, left_video string, right_video string")
    used, want = {}, set()
    for left, right, a, b in sorted(rows, key=lambda r: "|".join(sorted(r[:2]))):
        if used.get(a, 0) < 4 and used.get(b, 0) < 4:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.add((left, right))
    assert {(r["left"], r["right"]) for r in rs.agreement_cap(pairs).collect()} == want
    assert rs.agreement_cap(pairs.limit(0)).count() == 0


def test_relation_truth_reaches_the_fixpoint_and_invents_nothing(spark):
    rows = [("r1", "a", "b", 0.9, 1.0), ("r2", "b", "c", 0.8, None), ("r3", "c", "d", 0.7, 0.2), ("r4", "x", "y", 0.5, None), ("r5", "p", "q", 1.0, 0.4)]
    out, taken, change = rs.relation_truth(spark.createDataFrame(rows, "rel_id string, subject_id string, object_id string, confidence double, anchor double"), 60, 1e-9)
    got = {r["rel_id"]: r["value"] for r in out.collect()}
    assert got["r4"] is None and got["r5"] == 0.4 and change <= 1e-9 and taken < 60
    assert abs(got["r1"] - (0.6 + 0.4 * got["r2"])) < 1e-6 and abs(got["r3"] - (0.12 + 0.4 * got["r2"])) < 1e-6
    assert abs(got["r2"] - (0.9 * got["r1"] + 0.7 * got["r3"]) / 1.6) < 1e-6


def test_claim_truth_of_kinds(spark):
    claims = spark.createDataFrame([("a", 1.0, 0.9), ("b", 0.5, 0.4), ("c", 1.0, None), ("d", 1.0, 0.8)], "claim_id string, confidence double, truth double")
    deps = spark.createDataFrame([("a", "c", "contradicts", "[alternative] x"), ("b", "c", "supports", None), ("d", "b", "presupposes", None), ("a", "d", "contradicts", "[undercuts] y")], "source string, target string, kind string, rationale string")
    got = {r["claim_id"]: r["value"] for r in rs.claim_truth(claims, deps)[0].collect()}
    assert abs(got["c"] - (0.5 * 0.1 + 0.5 * 0.4) / 1.0) < 1e-9
    assert got["d"] == 0.4 and got["a"] == 0.9  # held down by what it presupposes


def test_mention_ids_do_not_repeat_beyond_9999(spark):
    df = spark.range(10_001).selectExpr("'v' as video_id", "cast(id as int) as ordinal")
    got = en.numbered(df)
    assert got.select("mention_id").distinct().count() == 10_001
    assert got.where("ordinal in (0, 10000)").orderBy("ordinal").toPandas()["mention_id"].tolist() == ["m_0001", "m_10001"]


def test_clock_surfaces_and_contractions(spark):
    row = spark.range(1).select(tx.clock(tx.F.lit(6065.0)).alias("a"), tx.clean_surface(tx.F.lit("  (_Bob  Ray_)! ")).alias("b")).first()
    assert (row["a"], row["b"]) == ("101:05", "_bob ray_")
    m = spark.createDataFrame([("person", "They've"), ("person", "Bob")], "label string, surface string")
    assert [r["norm"] for r in en.usable(m).collect()] == ["bob"]


def test_same_claim_of_opposed_stances_is_no_agreement(spark):
    claims = spark.createDataFrame([("a", "asserts", "x"), ("b", "denies", "y"), ("c", "asserts", "z")], "claim_id string, stance string, text string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "left string, right string")
    verdicts = pairs.selectExpr("left", "right", "'SAME-CLAIM' as verdict")
    got = {r["right"]: (r["route"], r["verdict"]) for r in cl.routed(pairs, verdicts, claims).collect()}
    assert got == {"b": ("dropped", "SAME-CLAIM-stance-mismatch"), "c": ("agreement", "SAME-CLAIM")}


def test_types_and_upserts(spark):
    kind = "subject_id string, predicate string, object_id string"
    rel = spark.createDataFrame([("person:a", "born_in", "person:b"), ("person:a", "born_in", "location:b"), ("a", "born_in", "person:b"), ("person:a", "accused_of", "role:b")], kind)
    assert gr.type_checked(rel).count() == 3
    rows = [("r", "s", "p", "o", "t", 0, 5, 1.0, 0.5, 0.2, "nlp"), ("r", "s", "p", "o", "t", 0, 5, 1.0, 0.9, None, "ai")]
    out = gr.upsert(spark.createDataFrame(rows, "rel_id string, subject_id string, predicate string, object_id string, transcript_id string, char_start int, char_end int, time_start double, confidence double, direct_truth double, provenance string")).first()
    assert (out["subject_id"], out["object_id"], out["confidence"], out["provenance"]) == ("s", "o", 0.9, "both")


def test_metrics_without_direction_are_information(spark):
    kind = "name string, value double"
    now, base = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0), ("d", None)], kind), spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", 1.0)], kind)
    got = {r["name"]: r["status"] for r in cl.gate(now, base, {"b": False}).collect()}
    assert got == {"a": "new", "b": "regressed", "c": "ok", "d": "missing"}


def test_sample_equals_the_greedy_loop(spark):
    rng = random.Random(5)
    rows = [(f"v{rng.randrange(12)}", rng.choice("abcde"), rng.choice(["asserts", "denies", None])) for _ in range(110)]
    against = {f"v{k}": k % 4 for k in range(12)}
    docs = {}
    for v, k, s in rows:
        docs.setdefault(v, []).append((k, s))
    has = {v: {f"kind:{k}" for k, _ in c} | {f"stance:{s}" for _, s in c if s} | {"size:short" if len(c) <= 8 else "size:medium" if len(c) <= 13 else "size:long"} for v, c in docs.items()}
    want, covered = ["v3"], set(has["v3"])
    while len(want) < 6:
        best = max(sorted(v for v in docs if v not in want), key=lambda v: (len(has[v] - covered) * 1000 + against[v] + len(docs[v]) / 100))
        want.append(best)
        covered |= has[best]
    claims = spark.createDataFrame(rows, "video_id string, kind string, stance string")
    assert ql.representative_sample(claims, spark.createDataFrame(list(against.items()), "video_id string, n int"), 6, ["v3"]) == want


def test_speaker_ranges_fold_like_single_steps(spark):
    rng = random.Random(7)
    rows = [("a", k, rng.choice([-0.4, -0.03, 0.0, 0.3])) for k in range(700)] + [("b", 5, 0.9)]
    got = {r["speaker"]: r["score"] for r in sc.speaker_scores(spark.createDataFrame(rows, "speaker string, seq long, weight double"), 50).collect()}
    want = {}
    for who, _, w in rows:
        s = want.get(who, 0.7)
        want[who] = min(1.0, max(0.0, s + (0.5 - s) * 0.05 + w))
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_clusters_join_through_others_and_stay_apart_when_marked(spark):
    rows = [("v1", "person", "Bob"), ("v1", "person", "Bob Ray"), ("v2", "person", "Bob Ray"), ("v2", "person", "Bob Ray Smith"), ("v3", "person", "Ann"), ("v4", "person", "Ann Lee"), ("v5", "quantity", "one"), ("v5", "quantity", "one two")]
    named = spark.createDataFrame(rows, "video_id string, label string, canonical string")
    none = spark.createDataFrame([], "a string, b string")
    got = cu.merge_clusters(named, none).collect()
    assert [(r["cluster"], r["canonical_key"], r["together"]) for r in got] == [("person:bob||person:bob ray||person:bob ray smith", "person:bob ray smith", 2)]
    marked = spark.createDataFrame([("person:bob ray", "person:bob")], "a string, b string")
    assert [r["cluster"] for r in cu.merge_clusters(named, marked).collect()] == ["person:bob ray||person:bob ray smith"]
