"""Rows on which an earlier version went wrong: verdicts, entities of captions, answers, loops, names, metrics."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import building as bd
from attestra.operators import claims as cl
from attestra.operators import curation as cu
from attestra.operators import graph as gr
from attestra.operators import loops as lo
from attestra.operators import sweeps as sw
from attestra.sources import captions as cp


def test_verdicts_either_way_and_without_hashes(spark):
    claims = spark.createDataFrame([(c, f"text {c}", s) for c, s in (("a", "asserts"), ("b", "denies"), ("c", "asserts"), ("d", None))], "claim_id string, text string, stance string")
    sha = {r["claim_id"]: r["h"] for r in claims.select("claim_id", F.sha1("text").alias("h")).collect()}
    pairs = spark.createDataFrame([("a", "b", "cross-video"), ("a", "c", "cross-video"), ("b", "c", "cross-video"), ("c", "d", "broken-presupposition"), ("b", "d", "pair")], "left string, right string, kind string")
    verdicts = spark.createDataFrame([("b", "a", "DEBUNKS", None, sha["a"]), ("a", "c", "SAME-CLAIM", None, None), ("c", "b", "DEBUNKS", sha["c"], "old"), ("c", "d", "IRRELEVANT", None, None), ("b", "d", "UNDERCUTS", sha["b"], sha["d"])], "left string, right string, verdict string, left_hash string, right_hash string")
    got = {(r["left"], r["right"]): (r["route"], r["verdict"]) for r in cl.routed(pairs, verdicts, claims).collect()}
    assert got == {("a", "b"): ("contradiction", "DEBUNKS"), ("a", "c"): ("agreement", "SAME-CLAIM"), ("b", "c"): ("pending", None), ("c", "d"): ("contradiction", None), ("b", "d"): ("contradiction", "UNDERCUTS")}


def test_caption_entities(spark):
    said = {"&#55357;&#56832; ok": "\U0001f600 ok", "a&#0000065;b": "aAb", "&#55357; x": "� x", "&#38;#60; &amp;lt;": "&#60; <", "&#233;&#128512;": "é\U0001f600", "&#99999999999999999999;": chr(99999999999999999999 % 65536), "none": "none"}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", cp.decode_entities(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == said


def test_answers_are_typed(spark):
    answers = spark.createDataFrame([("v", '[{"subjectId": 5, "objectId": "b", "predicate": "p", "cueIndex": 0, "confidence": 1}, {"subjectId": "a", "objectId": "b", "predicate": "p", "cueIndex": "0", "confidence": 1}, {"subjectId": "a", "objectId": "b", "predicate": "q", "cueIndex": 0, "confidence": 1}, {"subjectId": "a", "objectId": "b", "predicate": "p", "cueIndex": 1.0, "confidence": 7}, {"subjectId": "a", "objectId": "b", "predicate": "p", "cueIndex": 0.5, "confidence": 1}, null, 3, "x"]'), ("w", "not json"), ("u", '{"subjectId": "a"}'), ("t", None)], "video_id string, json string")
    cues = spark.createDataFrame([("v", 0, 0.0, 2.0, "abc"), ("v", 1, 2.0, 3.5, "de")], "video_id string, cue_idx int, start double, duration double, text string")
    rows = bd.external_edges(answers, cues, ["p"]).collect()
    assert [(r["subject_id"], r["char_start"], r["char_end"], r["time_start"], r["time_end"], r["confidence"]) for r in rows] == [("a", 4, 6, 2.0, 5.5, 1.0)]
    faults = [r["fault"] for r in bd.answered_edges(answers, ["p"]).collect()]
    assert sorted(map(str, faults)) == sorted(["ids are no text", "cue is no number", "unknown predicate", "None", "None", *["ids are no text"] * 3])


def test_titles_determiners_tokens_and_gate(spark):
    row = spark.range(1).select(cu.normal_form(F.lit("the " * 9 + "House"), F.lit("location")).alias("a"), cu.normal_form(F.lit("Dr. " * 12 + "An A Who's"), F.lit("person")).alias("b"), tx.token_set(F.lit("snake_case under_ x"), 3, None, tx.NOT_WORD).alias("c")).first()
    assert (row["a"], row["b"], sorted(row["c"])) == ("house", "who", ["snake_case", "under_"])
    values = spark.createDataFrame([("new", None), ("lost", None), ("kept", 1.0)], "name string, value double")
    base = spark.createDataFrame([("new", None), ("lost", 2.0), ("kept", 1.0)], "name string, value double")
    assert {r["name"]: r["status"] for r in cl.gate(values, base, {}).collect()} == {"new": "ok", "lost": "missing", "kept": "ok"}
    assert {r["name"]: r["status"] for r in cl.gate(values, base.limit(0), {}).collect()} == {"new": "ok", "lost": "ok", "kept": "new"}


def test_upsert_keeps_stored_truth(spark):
    rows = [("r", "a", "p", "b", "t", 0, 1, 0.0, 0.9, 1.0, "ai", 2), ("r", "a", "p", "b", "t", 0, 1, 0.0, 0.5, 0.2, "nlp", 1), ("q", "a", "p", "b", "t", 5, 6, 0.0, 0.5, None, "nlp", 1), ("q", "a", "p", "b", "t", 5, 6, 0.0, 0.4, 0.7, "nlp", 2)]
    df = spark.createDataFrame(rows, "rel_id string, subject_id string, predicate string, object_id string, transcript_id string, char_start int, char_end int, time_start double, confidence double, direct_truth double, provenance string, seen int")
    got = {r["rel_id"]: (r["direct_truth"], r["confidence"], r["provenance"]) for r in gr.upsert(df, "seen").collect()}
    assert got == {"r": (0.2, 0.9, "both"), "q": (None, 0.5, "nlp")}


def relations(spark, rows):
    return spark.createDataFrame(rows, "rel_id string, subject_id string, predicate string, object_id string, direct_truth double, derived_truth double")


def test_loops_of_any_length_by_derived_truth(spark):
    ring = [(f"r{k:02d}", f"n{k:02d}", "p", f"n{(k + 1) % 50:02d}", None, 0.9) for k in range(50)]
    other = [("x1", "a", "p", "b", 0.2, 0.9), ("x2", "b", "p", "c", 0.9, None), ("x3", "c", "p", "a", 0.6, None), ("y1", "d", "p", "e", 0.9, 0.1), ("y2", "e", "p", "d", 0.9, None), ("z", "s", "p", "s", 1.0, None)]
    rel = relations(spark, ring + other)
    loops, report = lo.true_loops(rel)
    assert {(r["loop"], r["length"]) for r in loops.collect()} == {("#".join(r[0] for r in ring), 50), ("x1#x2#x3", 3), ("z", 1)}
    assert all(r["complete"] for r in report.collect())
    kinds = bd.conflict_report(rel).where("kind = 'loop'").collect()
    assert sorted(r["a"] for r in kinds) == sorted(["#".join(r[0] for r in ring), "x1#x2#x3", "z"])
    assert lo.true_loops(rel.limit(0))[0].count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loops_in_match_all_simple_paths(seed):
    rng = random.Random(seed)
    rel = [(f"e{k}", rng.randrange(7), rng.randrange(7)) for k in range(18)]
    want = set()

    def walk(start, at, ids, seen):
        for i, s, o in rel:
            if s == at and o == start:
                want.add(tuple(sorted([*ids, i])))
            elif s == at and o > start and o not in seen:
                walk(start, o, [*ids, i], seen | {o})

    for n in range(7):
        walk(n, n, [], {n})
    found, complete = lo.loops_in(rel, 10**6)
    assert complete and {tuple(sorted(f)) for f in found} == want and len(found) == len(want)
    few, complete = lo.loops_in(rel, 3)
    assert len(few) == min(3, len(want)) and complete == (len(want) < 3)
    assert lo.loops_in(rel, 10**6, 5)[1] is False


def test_loops_beyond_the_budget_are_reported(spark):
    dense = [(f"d{a}{b}", f"m{a}", "p", f"m{b}", 0.9, None) for a in range(7) for b in range(7) if a != b]
    loops, report = lo.true_loops(relations(spark, dense), loops=20)
    assert loops.count() == 20 and [(r["relations"], r["complete"]) for r in report.collect()] == [(42, False)]
    loops, report = lo.true_loops(relations(spark, dense), most=10)
    assert loops.count() == 0 and [(r["component"], r["relations"], r["complete"]) for r in report.collect()] == [("m0", 42, False)]


def test_incremental_truth_equals_a_full_run(spark, tmp_path):
    rng = random.Random(8)
    schema = "rel_id string, subject_id string, object_id string, confidence double, anchor double, row long"
    edge = lambda k, a, b: (f"r{k:03d}", f"n{a:02d}", f"n{b:02d}", rng.choice([0.4, 1.0]), rng.choice([None, 0.1, 0.9]), k)
    rows = [edge(10 * g + k, 4 * g + rng.randrange(4), 4 * g + rng.randrange(4)) for g in range(20) for k in range(5)]
    store = sw.RelationTruth(spark, str(tmp_path / "truth"), parts=8)
    store.start(spark.createDataFrame(rows, schema))
    now = {r[0]: r for r in rows}
    for step in range(2):
        gone = rng.sample(sorted(now), 3)
        new = [edge(300 + 10 * step + k, rng.randrange(8), 4 * 9 + rng.randrange(4)) for k in range(2)]
        first = rows[30 + step]
        if first[0] not in gone and first[0] in now:
            new.append((*first[:4], 0.5, first[5]))
        removed = spark.createDataFrame([now[g][:3] for g in gone], "rel_id string, subject_id string, object_id string")
        parts_before = dict(store.held)
        store.change(spark.createDataFrame(new, schema), removed)
        now = {i: r for i, r in now.items() if i not in gone} | {r[0]: r for r in new}
        assert any(store.held.get(p) == g for p, g in parts_before.items())  # some parts stay as they were
        got = {r["rel_id"]: r["value"] for r in store.relations().collect()}
        full, _, _ = sw.relation_sweeps(spark.createDataFrame(list(now.values()), schema), each=True)
        want = {r["rel_id"]: r["value"] for r in full.collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
