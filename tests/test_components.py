"""Components and sweeps in row order against plain loops."""

import random

import pytest

from attestra.operators import components as co
from attestra.operators import sweeps as sw


def plain_weak(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {n: top(n) for n in list(parent)}


def plain_strong(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for x in reach.values():
            more = set().union(*(reach.get(y, set()) for y in x)) - x
            changed |= bool(more)
            x |= more
    cyclic = [n for n in reach if n in reach[n]]
    return {n: min(m for m in cyclic if m in reach[n] and n in reach[m]) for n in cyclic}


def random_edges(seed, nodes=60, n=75, ring=50):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(1000 + k, 1000 + (k + 1) % ring) for k in range(ring)] + [(2000 + k, 2001 + k) for k in range(ring)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


@pytest.mark.parametrize("seed", [1, 2])
def test_weak_components(spark, seed):
    edges = random_edges(seed)
    assert {r["node"]: r["component"] for r in co.weak(frame(spark, edges)).collect()} == plain_weak(edges)
    assert co.weak(frame(spark, [(1, 1)])).count() == 0


@pytest.mark.parametrize(("seed", "most"), [(3, 200_000), (4, 5)])
def test_strong_components(spark, seed, most):
    """In tasks, and by colours where a component is too large for one."""
    edges = random_edges(seed) if most > 100 else random_edges(seed, 16, 22, 4)
    assert {r["node"]: r["component"] for r in co.strong(frame(spark, edges), most=most).collect()} == plain_strong(edges)


def test_strong_components_of_odd_edges(spark):
    assert co.strong(frame(spark, [])).count() == 0
    assert co.strong(frame(spark, [(1, 2), (2, 3), (None, 1), (3, None)])).count() == 0
    assert {tuple(r) for r in co.strong(frame(spark, [(1, 1), (1, 2), (1, 1), (5, 6), (6, 5)])).collect()} == {(1, 1), (5, 5), (6, 5)}


@pytest.mark.parametrize("seed", [6])
def test_labels_follow_changes(spark, seed):
    rng = random.Random(seed)
    before = random_edges(seed)
    removed = rng.sample(before, 12)
    added = [(rng.randrange(80), rng.randrange(80)) for _ in range(6)] + [(3000, 3001), (3001, 1003), (4000, 4000)]
    after = [e for e in before if e not in removed] + added
    labels, touched = co.relabelled(co.weak(frame(spark, before)), frame(spark, after), frame(spark, added), frame(spark, removed))
    got = {r["node"]: r["component"] for r in labels.collect()}
    want = plain_weak(after)
    assert got == want
    ends = {n for e in added + removed for n in e}
    assert {want[n] for n in ends if n in want} <= {r["component"] for r in touched.collect()}


def plain_relations(rows, sweeps=50, epsilon=0.001):
    """In place, in the order of rows (id, s, o, c, anchor)."""
    value = {r[0]: r[4] for r in rows}
    taken, last = 0, float("inf")
    while taken < sweeps and last > epsilon:
        last, taken = 0.0, taken + 1
        for i, s, o, _, anchor in rows:
            near = [r for r in rows if r[0] != i and {s, o} & {r[1], r[2]} and value[r[0]] is not None]
            w = sum(r[3] for r in near)
            mean = sum(r[3] * value[r[0]] for r in near) / w if w > 0 else None
            new = mean if anchor is None else anchor if mean is None else 0.6 * anchor + 0.4 * mean
            if new is not None:
                last = max(last, abs(new - (new if value[i] is None else value[i])))
                value[i] = new
    return value, taken, last


def plain_claims(claims, deps, sweeps=50, epsilon=0.001):
    value, sure = {c[0]: c[2] for c in claims}, {c[0]: c[1] for c in claims}
    taken, last = 0, float("inf")
    while taken < sweeps and last > epsilon:
        last, taken = 0.0, taken + 1
        for i, _, anchor in claims:
            w = wv = 0.0
            caps = [value[t] for s, t, kind, _ in deps if s == i and kind == "presupposes" and value.get(t) is not None]
            for s, t, kind, why in deps:
                v = value.get(s)
                if t != i or v is None or kind in ("elaborates", "presupposes"):
                    continue
                if kind == "contradicts" and why == "[undercuts] x":
                    caps.append(1 - 0.2 * v * sure[s])
                    continue
                c = sure[s] * (0.5 if why == "[alternative] x" and kind == "contradicts" else 1)
                w, wv = w + c, wv + c * (v if kind == "supports" else 1 - v)
            new = anchor if w == 0 else wv / w if anchor is None else 0.6 * anchor + 0.4 * wv / w
            if new is not None:
                new = min([new, *caps])
                last = max(last, abs(new - (value[i] or 0.0)))
                value[i] = new
    return {i: None if v is None else min(max(v, 0.0), 1.0) for i, v in value.items()}, taken, last


def close(got, want):
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


@pytest.mark.parametrize(("seed", "most"), [(1, 200_000), (2, 25)])
def test_relation_sweeps_equal_the_loop(spark, seed, most):
    rng = random.Random(seed)
    rows = [(f"r{k:03d}", f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice([0.0, 0.3, 0.8, 1.0]), rng.choice([None, None, 0.0, 0.4, 1.0])) for k in range(40)]
    rows += [(f"s{k}", f"m{k}", f"m{k + 1}", 0.5, 0.9 if k == 0 else None) for k in range(4)] + [("t0", "z", "z", 0.5, 0.2), ("t1", "z", "z", 0.7, None), ("u0", "y1", "y2", 0.5, None)]
    rng.shuffle(rows)
    sweeps = 50 if most > 100 else 2  # blocks take a job each
    want, taken, last = plain_relations(rows, sweeps)
    edges = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "rel_id string, subject_id string, object_id string, confidence double, anchor double, row long")
    out, t, d = sw.relation_sweeps(edges, sweeps=sweeps, most=most)
    close({r["rel_id"]: r["value"] for r in out.collect()}, want)
    assert t == taken and abs(d - last) < 1e-9


@pytest.mark.parametrize(("seed", "most"), [(1, 200_000), (2, 30)])
def test_claim_sweeps_equal_the_loop(spark, seed, most):
    rng = random.Random(seed)
    claims = [(f"c{k:02d}", rng.choice([0.2, 0.7, 1.0]), rng.choice([None, 0.1, 0.6, 1.0])) for k in range(50)]
    kinds = [("supports", None), ("contradicts", "[alternative] x"), ("contradicts", "[undercuts] x"), ("contradicts", "plain"), ("presupposes", None), ("elaborates", None)]
    deps = [(f"c{rng.randrange(50):02d}", f"c{rng.randrange(50):02d}", *rng.choice(kinds)) for _ in range(60)] + [("gone", "c01", "supports", None), ("c02", "gone", "presupposes", None)]
    sweeps = 50 if most > 100 else 2
    want, taken, last = plain_claims(claims, deps, sweeps)
    out, t, d = sw.claim_sweeps(spark.createDataFrame(claims, "claim_id string, confidence double, truth double"), spark.createDataFrame(deps, "source string, target string, kind string, rationale string"), sweeps=sweeps, most=most)
    close({r["claim_id"]: r["value"] for r in out.collect()}, want)
    assert t == taken and abs(d - last) < 1e-9


def test_chain_of_200_settles_in_row_order(spark):
    """One sweep carries truth along the whole chain; fifty rounds would end after fifty steps."""
    claims = [(f"c{k:03d}", 1.0, 0.9 if k == 0 else None) for k in range(200)]
    deps = [(f"c{k:03d}", f"c{k + 1:03d}", "supports", None) for k in range(199)]
    out, taken, last = sw.claim_sweeps(spark.createDataFrame(claims, "claim_id string, confidence double, truth double"), spark.createDataFrame(deps, "source string, target string, kind string, rationale string"))
    assert {round(r["value"], 9) for r in out.collect()} == {0.9} and (taken, last) == (2, 0.0)
    rows = [(f"r{k:03d}", f"n{k:03d}", f"n{k + 1:03d}", 1.0, 0.9 if k == 0 else None) for k in range(200)]
    edges = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "rel_id string, subject_id string, object_id string, confidence double, anchor double, row long")
    out, taken, last = sw.relation_sweeps(edges)
    want, t, d = plain_relations(rows)
    close({r["rel_id"]: r["value"] for r in out.collect()}, want)
    assert (taken, last) == (t, d) and all(v is not None for v in want.values())
    assert sw.relation_sweeps(edges.limit(0))[0].count() == 0
