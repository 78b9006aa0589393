"""Work that must not grow faster than its input: jobs, rows between steps, and results beside plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import building as bd
from attestra.operators import claims as cl
from attestra.operators import components as co
from attestra.operators import facets as fa
from attestra.operators import reasoning as rs
from attestra.operators import sweeps as sw
from attestra.plans import fixtures as fx
from tests.test_components import close, plain_weak

CLAIMS, DEPS = "claim_id string, confidence double, truth double", "source string, target string, kind string, rationale string"


def jobs(spark, group, run):
    """The number of jobs that run starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plain_rounds(claims, deps, rounds, epsilon):
    """Synchronous rounds, one after the other."""
    sure, value = {c[0]: c[1] for c in claims}, {c[0]: c[2] for c in claims}
    taken, last = 0, float("inf")
    while taken < rounds and last > epsilon:
        taken, last, after = taken + 1, 0.0, {}
        for name, _, anchor in claims:
            w = wv = 0.0
            caps = [value[t] for s, t, kind, _ in deps if s == name and kind == "presupposes" and value.get(t) is not None]
            for s, t, kind, why in deps:
                v = value.get(s)
                if t != name or v is None or kind not in ("supports", "contradicts"):
                    continue
                if kind == "contradicts" and why == "[undercuts] x":
                    caps.append(1 - 0.2 * v * sure[s])
                    continue
                c = sure[s] * (0.5 if kind == "contradicts" and why == "[alternative] x" else 1)
                w, wv = w + c, wv + c * (v if kind == "supports" else 1 - v)
            new = anchor if w == 0 else wv / w if anchor is None else 0.6 * anchor + 0.4 * wv / w
            after[name] = None if new is None else max(0.0, min([new, 1.0, *caps]))
            if after[name] is not None:
                last = max(last, abs(after[name] - (value[name] or 0.0)))
        value = after
    return value, taken, last


@pytest.mark.parametrize(("most", "rounds", "epsilon"), [(200_000, 50, 0.001), (200_000, 3, 0.0), (20, 3, 0.0)])
def test_claim_rounds_equal_the_loop(spark, most, rounds, epsilon):
    rng = random.Random(rounds)
    claims = [(f"c{k:02d}", rng.choice([0.2, 0.7, 1.0]), rng.choice([None, 0.1, 0.6, 1.0])) for k in range(50)]
    kinds = [("supports", None), ("contradicts", "[alternative] x"), ("contradicts", "[undercuts] x"), ("contradicts", "plain"), ("presupposes", None), ("elaborates", None), ("cites", None)]
    deps = [(f"c{rng.randrange(50):02d}", f"c{rng.randrange(50):02d}", *rng.choice(kinds)) for _ in range(60)] + [("gone", "c01", "supports", None), ("c02", "gone", "presupposes", None)]
    want, taken, last = plain_rounds(claims, deps, rounds, epsilon)
    out, t, d = sw.claim_sweeps(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(deps, DEPS), sweeps=rounds, epsilon=epsilon, most=most, together=True)
    close({r["claim_id"]: r["value"] for r in out.collect()}, want)
    assert t == taken and abs(d - last) < 1e-9


def test_claim_rounds_take_no_job_each(spark):
    def run(n):
        claims = spark.createDataFrame([(f"c{k:02d}", 1.0, 0.9 if k == 0 else None) for k in range(n)], CLAIMS)
        deps = spark.createDataFrame([(f"c{k:02d}", f"c{k + 1:02d}", "supports", None) for k in range(n - 1)], DEPS).coalesce(1)
        out, taken, _ = rs.claim_truth(claims, deps, None, 50, 1e-9)
        assert taken == n and out.where("abs(value - 0.9) < 1e-9").count() == n

    assert jobs(spark, "rounds-long", lambda: run(30)) <= jobs(spark, "rounds-short", lambda: run(4)) + 4


@pytest.mark.parametrize("most", [1, 7, 200_000])
def test_components_from_edges_side_by_side(spark, most, monkeypatch):
    rng = random.Random(most)
    edges = [(f"n{rng.randrange(90):02d}", f"n{rng.randrange(90):02d}") for _ in range(60)] + [("z", "z")]
    found = list(co._local(iter([spark.createDataFrame(edges[:-1], "u string, v string").where("u <> v").toPandas()])))
    assert {n: r for p in found for n, r in zip(p["node"], p["root"], strict=True)} == plain_weak(edges)
    got = co.weak(spark.createDataFrame(edges, "u string, v string").repartition(min(most, 9)))
    assert {r["node"]: r["component"] for r in got.collect()} == plain_weak(edges)


def test_small_components_need_no_round(spark):
    chains = spark.range(300).select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"), "id").select(F.format_string("%04d-%d", "id", "k").alias("u"), F.format_string("%04d-%d", "id", F.col("k") + 1).alias("v"))
    assert jobs(spark, "components", lambda: co.weak(chains.coalesce(1))) <= 6
    assert co.weak(chains.coalesce(2)).groupBy("component").count().where("count = 8").count() == 300


def test_dependencies_lead_to_the_line_before_only(spark, tmp_path):
    rows = [(7, 10, 1, 1), (7, 11, 1, 2), (7, 12, 1, 4), (7, 13, 1, 5), (7, 9, 1, 5), (8, 10, 1, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").selectExpr("*", "1.0d l_extendedprice", "timestamp'2020-01-01' l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fx.dependencies(spark, str(tmp_path)).select("source", "target", "kind")
    assert {tuple(r) for r in got.collect()} == {("v7:c_7_2", "v7:c_7_1", "elaborates"), ("v7:c_7_5", "v7:c_7_4", "contradicts")}
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 0


@pytest.mark.parametrize("most", [5, 200_000])
def test_agreement_cap_in_blocks(spark, most):
    rng = random.Random(most)
    rows = sorted({(f"v{a:02d}:c{rng.randrange(40)}", f"v{b:02d}:c{rng.randrange(40)}") for a, b in (sorted(rng.sample(range(12), 2)) for _ in range(400))})
    n, want = {}, set()
    for l, r in sorted(rows, key="|".join):
        a, b = l[:3], r[:3]
        if n.get(a, 0) < 4 and n.get(b, 0) < 4:
            n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
            want.add((l, r))
    pairs = spark.createDataFrame([(l, r, l[:3], r[:3]) for l, r in rows], "left string, right string, left_video string, right_video string")
    assert {(r["left"], r["right"]) for r in rs.agreement_cap(pairs, most=most).collect()} == want


def test_agreements_in_sorted_order_take_few_jobs(spark):
    """Every document's turn comes after that of the one before: rounds over all pairs took one for each document."""
    pairs = spark.range(60).alias("a").join(spark.range(60).alias("b"), F.col("a.id") < F.col("b.id")).select(F.format_string("v%02d", "a.id").alias("left_video"), F.format_string("v%02d", "b.id").alias("right_video"))
    pairs = pairs.select(F.concat("left_video", F.lit(":c")).alias("left"), F.concat("right_video", F.lit(":c")).alias("right"), "left_video", "right_video").coalesce(1).cache()
    assert jobs(spark, "agreements", lambda: rs.agreement_cap(pairs).count()) < 40


def pair_rows(df, *columns):
    return {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()}


def test_classes_of_vectors_and_whole_vectors_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(5)
    vecs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)] + [[0.0] * 8, [1.0, 2.0], [-0.0] * 8]
    claims = spark.createDataFrame([(f"v{k % 7}", f"c{k:03d}", rng.choice(["asserts", "denies", "uncertain", None]), [f"e{rng.randrange(4)}", f"e{rng.randrange(4)}"], f"t{k}") for k in range(150)], "video_id string, claim_id string, stance string, entities array<string>, tag string")
    vectors = spark.createDataFrame([(f"c{k:03d}", rng.choice(vecs)) for k in range(140)] + [("c149", [float("nan")]), ("c148", None)], "claim_id string, vec array<double>")
    columns = ("left", "right", "shared", "similarity", "left_tag", "right_tag")
    few = pair_rows(cl.vector_pairs(claims, vectors, block=20, carry=("tag",)), *columns)
    monkeypatch.setattr(cl, "FEW_VECTORS", 0)
    assert few and few == pair_rows(cl.vector_pairs(claims, vectors, block=20, carry=("tag",)), *columns)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_pairs_are_not_shuffled_for_their_vectors_and_texts(spark):
    claims = spark.createDataFrame([(f"v{k}", f"c{k}", "asserts", ["e"], "text", f"h{k}") for k in range(6)], "video_id string, claim_id string, stance string, entities array<string>, text string, text_hash string")
    vectors = spark.createDataFrame([(f"c{k}", [1.0, 0.0]) for k in range(5)], "claim_id string, vec array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = cl.vector_pairs(claims, vectors, carry=("stance", "text_hash"))
        assert exchanges(p) <= 8  # claims by id twice a side, by entity once a side
        verdicts = p.select("left", "right", F.lit("SAME-CLAIM").alias("verdict"), F.col("left_text_hash").alias("left_hash"), F.when(F.col("left") == "c0", "old").otherwise(F.col("right_text_hash")).alias("right_hash"))
        routes = cl.routed(p, verdicts, claims)
        assert exchanges(routes) <= 2 * exchanges(p) + 2
        assert {r["route"]: r["count"] for r in routes.groupBy("route").count().collect()} == {"pending": 4, "agreement": 6}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_claim_neighbourhood_is_that_of_all_links(spark):
    rng = random.Random(3)
    claims = spark.createDataFrame([(f"c{k:02d}", f"v{k % 9}", [f"e{k % 5}"], rng.choice([None, [], ["r1"], ["r2", "r1"], ["r3", "r2", "r2"], [f"r{k}"], [None]])) for k in range(60)], "claim_id string, video_id string, entities array<string>, relationships array<string>")
    pick = lambda: f"c{rng.randrange(66):02d}"
    deps = spark.createDataFrame([(pick(), pick(), rng.choice(["supports", "contradicts"])) for _ in range(60)], "source string, target string, kind string")
    pairs = spark.createDataFrame([(pick(), pick()) for _ in range(20)], "left string, right string")
    seeds = [fa.seeds_of(claims, kind, key) for kind, key in (("entity", "e2"), ("document", "v7"), ("claim", "c63"), ("claim", "c01"))]
    links = fa.claim_links(claims, deps, pairs)
    want = fa.merged_neighbourhoods([fa.neighbourhood(claims, links, s) for s in seeds])
    got = fa.claim_neighbourhood(claims, deps, pairs, seeds[0].union(seeds[1]).union(seeds[2]).union(seeds[3]))
    for g, w in zip(got, want, strict=True):
        assert sorted(map(tuple, g.collect())) == sorted(map(tuple, w.collect()))


def test_claim_graph_nodes_need_no_pair_of_claims(spark):
    """All 4,000 claims cite one relation: all pairs would be 16 million rows, those of the seed's links alone 4,000."""
    claims = spark.range(4000).select(F.format_string("c%04d", "id").alias("claim_id"), F.array(F.lit("r")).alias("relationships"))
    none = spark.createDataFrame([], "source string, target string, kind string")
    nodes, edges = fa.claim_neighbourhood(claims, none, none.select(F.col("source").alias("left"), F.col("target").alias("right")), claims.where("claim_id < 'c1000'").select("claim_id"))
    assert nodes.groupBy("distance").count().orderBy("distance").collect() == [(0, 1000), (1, 3000)]
    assert "Join Inner" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count() == 1000 * 3999


def test_relation_rounds_move_no_names(spark, monkeypatch):
    """Rounds see numbers for rows and nodes, and deal rows twice at most, besides the nodes' sums."""
    seen, real = [], rs.gr.propagate_round

    def watched(state, *args, **kwargs):
        out = real(state, *args, **kwargs)
        seen.append((state.schema["rel_id"].dataType.typeName(), exchanges(out)))
        return out

    monkeypatch.setattr(rs.gr, "propagate_round", watched)
    rows = [("r1", "a", "b", 0.9, 1.0), ("r2", "b", "a", 0.8, None), ("r3", "b", "c", 0.7, 0.2), ("r4", "c", "c", 0.5, None), (None, "p", None, 1.0, 0.4), ("r6", "p", "q", 0.3, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out, taken, change = rs.relation_truth(spark.createDataFrame(rows, "rel_id string, subject_id string, object_id string, confidence double, anchor double"), 2, 0.0)
        got = {r["rel_id"]: r["value"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert taken == 2 and all(kind == "long" and n <= 6 for kind, n in seen)
    r1, r2, r3 = 1.0, (0.9 * 1.0 + 0.7 * 0.2) / 1.6, 0.12 + 0.4 * 1.0
    assert got.keys() == {"r1", "r2", "r3", "r4", "r6"} and got["r6"] is None
    assert abs(got["r1"] - (0.6 + 0.4 * (0.8 * r2 + 0.7 * r3) / 1.5)) < 1e-9
    assert abs(got["r2"] - (0.9 * (0.6 + 0.4 * 0.2) + 0.7 * r3) / 1.6) < 1e-9


def test_novel_links_leave_weak_entities_out(spark, monkeypatch):
    """Pairs of entities that cannot reach the first ones are not made, and the result is that of all pairs."""
    rng = random.Random(9)
    rel = [(f"s{a}", f"m{rng.randrange(40)}", f"t{rng.randrange(30)}") for a in range(8) for _ in range(30)] + [(f"x{k}", f"m{k % 40}", f"t{k % 30}") for k in range(200)]
    df = spark.createDataFrame([(s, o, t, f"r{k}", 0.5) for k, (s, o, t) in enumerate(rel)], "subject_id string, object_id string, transcript_id string, rel_id string, confidence double")
    whole = bd.novel_links(df, limit=5).collect()
    monkeypatch.setattr(bd, "PROBED", 8)
    assert bd.novel_links(df, limit=5).collect() == whole
    monkeypatch.setattr(bd, "PROBED", 0)
    assert bd.novel_links(df, limit=5).collect() == whole
