"""Findings projected to larger tables: what made them slow or large must not come back."""

import random

import pytest
from pyspark.sql.functions import udf

from attestra.operators import building as bd
from attestra.operators import claims as cl
from attestra.operators import quality as ql
from attestra.operators import segments as sg
from attestra.sources import captions as cp


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_timed_text_is_read_once(spark):
    said = "".join(f'<p t="{k * 1000}" d="900"><s>a &amp;#{65 + k};</s><s ac="0"> b > c</s></p>' for k in range(3))
    rows = [("new", f"<body>{said}</body>"), ("old", '<text start="1.5" dur="">x &lt; <b>y</b>\n</text><text dur="2">z</text>'), ("gap", '<p t="1" d="2">\n﻿</p><text\nstart="3" dur="4" > w</text>')]
    out = cp.timed_text_cues(spark.createDataFrame(rows, "id string, xml string"))
    got = sorted((r["id"], r["cue_idx"], r["start"], r["duration"], r["text"]) for r in out.collect())
    assert got == [("gap", 0, 3.0, 4.0, " w"), ("new", 0, 0.0, 0.9, "a A b > c"), ("new", 1, 1.0, 0.9, "a B b > c"), ("new", 2, 2.0, 0.9, "a C b > c"), ("old", 0, 1.5, 0.0, "x < y\n")]
    # one pass each for the shapes, the spans, and per shape the halves and the decimal entities
    assert plan(out).count("regexp_extract_all") <= 7


def test_claims_meet_their_text_last(spark):
    span = "array<struct<transcript_id:string,char_start:int,char_end:int,time_start:double,time_end:double,quote:string>>"
    kind = f"video_id string, claim_id string, text string, kind string, stance string, confidence double, truth double, rationale string, entities array<string>, relationships array<string>, evidence {span}, dependencies array<struct<target:string,kind:string>>"
    one = lambda k, quote, entity: ("v", f"v:{k}", "t", "opinion", "denies", 0.5, None, "r", [entity], ["r1"], [("v", 1, 3, 0.0, 1.0, quote)], [])
    claims = spark.createDataFrame([one(1, "bc", "person:a"), one(2, "xx", "person:b"), one(3, "bc", "person:b")], kind)
    texts = spark.createDataFrame([("v", "abcd")], "video_id string, text string")
    out = ql.claim_errors(claims, texts, spark.createDataFrame([("v", "person:a")], "video_id string, entity_id string"), spark.createDataFrame([("v", "r1")], "video_id string, rel_id string"))
    assert {r["claim_id"]: r["errors"] for r in out.collect()} == {"v:1": [], "v:2": ["entity-unknown", "evidence-quote"], "v:3": ["entity-unknown"]}
    last = next(line for line in plan(out).splitlines() if "Join LeftOuter" in line)
    assert "claim_id" not in last  # else each claim is shuffled with its document's whole text


def test_pages_of_few_entities_shuffle_no_relations(spark):
    rel = spark.createDataFrame([("r1", "a", "p", "b", "v1", 4.9), ("r2", "b", "q", "b", "v2", 1.0), ("r3", "c", "p", "d", "v1", 0.0)], "rel_id string, subject_id string, predicate string, object_id string, transcript_id string, time_start double")
    out = bd.entity_page(rel, spark.createDataFrame([("b",), ("b",)], "entity_id string"))
    assert sorted((r["entity_id"], r["rel_id"], r["counterpart"]) for r in out.collect()) == [("b", "r1", "a"), ("b", "r2", "b")]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def plain_pairs(claims, floor=0.1, overlap=2):
    out = set()
    for i, v, a, said, words in claims:
        for k, w, b, other, more in claims:
            both, x, y = set(a) & set(b), set(words.split()), set(more.split())
            like = len(x & y) / len(x | y) if x | y else 0.0
            if said == "asserts" and other == "denies" and v != w and both and (like >= floor or len(both) >= overlap):
                out.add((*((i, k) if v < w else (k, i)), len(both), round(like, 6), "jaccard" if like >= floor else "strong-overlap"))
    return out


@pytest.mark.parametrize("few", [0, 512])
def test_shared_entity_pairs_equal_the_loop(spark, few, monkeypatch):
    monkeypatch.setattr(cl, "FEW_TOKENS", few)
    rng = random.Random(5)
    words = [f"word{k}" for k in range(80)]
    claims = [(f"c{k:02d}", f"v{rng.randrange(4)}", rng.sample("abcd", rng.choice([1, 2, 2, 3])), rng.choice(["asserts", "denies", "uncertain"]), " ".join(rng.sample(words, rng.randrange(9)))) for k in range(60)]
    df = spark.createDataFrame(claims, "claim_id string, video_id string, entities array<string>, stance string, text string")
    out = cl.cross_document(df, block=7)
    assert {tuple(r) for r in out.collect()} == plain_pairs(claims)
    if few:
        assert "array_union" not in plan(out)  # sets of words are not met as arrays


def test_pairs_with_verdicts_look_nothing_up(spark):
    pairs = spark.createDataFrame([("a", "b", "asserts", "denies", "SAME-CLAIM"), ("a", "c", "asserts", "asserts", "SAME-CLAIM"), ("b", "c", "denies", "asserts", None), ("b", "d", None, "asserts", "DEBUNKS"), ("c", "d", "asserts", "asserts", "IRRELEVANT")], "left string, right string, left_stance string, right_stance string, verdict string")
    out = cl.routed(pairs, None, spark.createDataFrame([], "claim_id string, stance string, text string"))
    assert [(r["route"], r["verdict"]) for r in out.orderBy("left", "right").collect()] == [("dropped", "SAME-CLAIM-stance-mismatch"), ("agreement", "SAME-CLAIM"), ("pending", None), ("contradiction", "DEBUNKS"), ("dropped", "IRRELEVANT")]
    assert "Join" not in plan(out)


def test_texts_are_cut_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(sg, "TOKEN_ROWS", 2)
    docs = spark.createDataFrame([("a", "One. \U0001f600 two!\n\n Mr. X? "), ("b", None), ("c", " \n"), ("d", "etc. x")], "video_id string, text string")
    words = sg.tokens(docs)
    got = sorted((r["video_id"], r["token_idx"], r["start"], r["end"], r["token"]) for r in words.collect())
    assert got == [("a", 0, 0, 4, "One."), ("a", 1, 5, 6, "\U0001f600"), ("a", 2, 7, 11, "two!"), ("a", 3, 14, 17, "Mr."), ("a", 4, 18, 20, "X?"), ("d", 0, 0, 4, "etc."), ("d", 1, 5, 6, "x")]
    assert "Window" not in plan(words)
    cut = sg.sentences(docs)
    assert sorted(tuple(r) for r in cut.collect()) == [("a", 0, 4), ("a", 5, 11), ("a", 14, 20), ("d", 0, 6)]
    assert "substring" not in plan(cut) and "Repartition" in plan(cut)  # no piece has its whole text beside it


def test_mentions_meet_their_windows_once(spark):
    mentions = spark.createDataFrame([("v", "m1", 0, 3), ("v", "m2", 5, 9), ("v", "m3", 600, 603)], "video_id string, mention_id string, start int, end int")
    out = sg.in_windows(mentions, spark.createDataFrame([("v", 0, 0, 20), ("v", 1, 590, 620)], "video_id string, window int, start int, end int"))
    assert sorted(r["mention_id"] for r in out.collect()) == ["m1", "m2"]
    assert plan(out).count("Join") == 1


def test_both_ends_of_edges_meet_mentions_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    ids = spark.createDataFrame([("v", "m1", "person:a"), ("v", "m2", "person:b")], "video_id string, mention_id string, entity_id string").coalesce(1)
    ids = ids.withColumn("entity_id", udf(count, "string")("entity_id"))
    edges = spark.createDataFrame([("v", "e1", "met_with", "m1", "m2"), ("v", "e2", "met_with", "m1", "m3")], "video_id string, edge_id string, predicate string, subject_mention_id string, object_mention_id string")
    out = bd.document_relations(edges, ids, None, False)
    assert [(r["edge_id"], r["subject_id"], r["object_id"]) for r in out.collect()] == [("e1", "person:a", "person:b")]
    assert made.value == 2
