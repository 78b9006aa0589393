"""Routes of vector pairs: verdicts and the texts that they were given on come with the pairs, which are not shuffled."""

import random

from attestra.operators import claims as cl
from attestra.plans import claim_queries as cq


def test_a_verdict_on_another_text_is_pending(spark):
    rows = [("a", "b", "asserts", "denies", "DEBUNKS", "1", "1", "2", "2"), ("a", "c", "asserts", "denies", "DEBUNKS", "1", "0", "2", "2"), ("a", "d", "asserts", "asserts", "SAME-CLAIM", "1", None, "2", "2"), ("a", "e", "asserts", "denies", "SAME-CLAIM", "1", "1", "2", "9")]
    pairs = spark.createDataFrame(rows, "left string, right string, left_stance string, right_stance string, verdict string, left_text_hash string, left_hash string, right_text_hash string, right_hash string")
    out = cl.routed(pairs, None, pairs)
    assert {r["right"]: (r["route"], r["verdict"]) for r in out.collect()} == {"b": ("contradiction", "DEBUNKS"), "c": ("pending", None), "d": ("agreement", "SAME-CLAIM"), "e": ("pending", None)}
    assert out.columns == ["left", "right", "verdict", "route"]


def test_routes_look_no_pair_up(spark):
    plan = cq._routes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "Window" not in plan


def test_blocks_of_heavy_entities_give_all_pairs(spark):
    rng = random.Random(2)
    claims = [(f"v{k % 5}", f"v{k % 5}:c{k}", rng.choice(["asserts", "denies", "uncertain"]), rng.sample(["hub", "x", "y", None], rng.choice([1, 2])), k % 3) for k in range(40)]
    c = spark.createDataFrame(claims, "video_id string, claim_id string, stance string, entities array<string>, n int")
    v = spark.createDataFrame([(r[1], [[1.0, 0.1], [0.9, 0.4], [-0.0, 1.0]][r[4]]) for r in claims if r[1] != "v0:c0"], "claim_id string, vec array<double>")
    key = lambda rows: sorted((r["left"], r["right"], r["shared"], r["similarity"], r["left_n"], r["right_n"]) for r in rows)
    cos = [[1.0, 0.944, 0.0995], [0.944, 1.0, 0.4061], [0.0995, 0.4061, 1.0]]
    want = {(a[1], b[1]) for a in claims for b in claims if a[0] < b[0] and "v0:c0" not in (a[1], b[1]) and set(a[3]) & set(b[3]) - {None} and cos[a[4]][b[4]] >= (0.55 if {a[2], b[2]} == {"asserts", "denies"} else 0.7)}
    whole = key(cl.vector_pairs(c, v, carry=("n",)).collect())
    assert {r[:2] for r in whole} == want and len(whole) == len(want)
    assert key(cl.vector_pairs(c, v, block=3, carry=("n",)).collect()) == whole
