"""Pairs that used to be made all with all: nearest mentions, names in names, candidates by vectors or words."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import claims as cl
from attestra.operators import curation as cu
from attestra.operators import segments as sg


@pytest.mark.parametrize(("seed", "cap"), [(1, 10), (2, 3), (3, 1)])
def test_nearest_pairs_with_many_ties(spark, seed, cap):
    rng = random.Random(seed)
    rows = []
    for w in range(30):
        for k in range(rng.randrange(1, 40)):
            start = rng.randrange(0, 6 if w % 3 else 200)
            rows.append(("v", w, f"m{k:02d}", start, start + rng.choice([1, 2, 3, 3])))
    got = sorted((r["window"], r["rank"], r["a"], r["b"], r["distance"]) for r in sg.mention_pairs(spark.createDataFrame(rows, "video_id string, window int, mention_id string, start int, end int"), cap).collect())
    want = []
    for w in range(30):
        m = sorted((r[3], r[2], (r[3] + r[4]) / 2) for r in rows if r[1] == w)
        pairs = sorted((abs(a[2] - b[2]), a[:2], b[:2]) for i, a in enumerate(m) for b in m[i + 1 :])
        want += [(w, n + 1, a[1], b[1], d) for n, (d, a, b) in enumerate(pairs[:cap])]
    assert got == want


def test_one_window_of_many_mentions(spark):
    """20,000 mentions of one window: no list of all pairs is made."""
    held = spark.range(20_000).selectExpr("'v' as video_id", "0 as window", "concat('m', id) as mention_id", "cast(id % 977 as int) as start", "cast(id % 977 + 4 as int) as end")
    began = time.time()
    rows = sg.mention_pairs(held).collect()
    assert len(rows) == 10 and {r["distance"] for r in rows} == {0.0} and time.time() - began < 60


def test_one_document_of_many_names(spark):
    """20,000 names of one document and label meet by their rarest run of characters only."""
    named = spark.range(20_000).selectExpr("'v' as video_id", "'person' as label", "concat('name ', conv(cast(id * 7919 + 100000 as string), 10, 36), if(id % 100 = 0, concat(' of name ', conv(cast((id + 1) * 7919 + 100000 as string), 10, 36)), '')) as canonical")
    none = spark.createDataFrame([], "a string, b string")
    began = time.time()
    assert cu.substring_pairs(named, none).count() >= 200 and time.time() - began < 60


def test_substring_pairs_match_all_with_all(spark):
    rng = random.Random(4)
    rows = [(f"v{rng.randrange(3)}", rng.choice(["person", "event", "quantity"]), "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9)))) for _ in range(300)]
    got = {(r["shorter"], r["longer"]): r["together"] for r in cu.substring_pairs(spark.createDataFrame(rows, "video_id string, label string, canonical string"), spark.createDataFrame([], "a string, b string")).collect()}
    want = {}
    names = {(v, label, " ".join(c.strip(" ").split())) for v, label, c in rows if label != "quantity"}
    for v, label, s in names:
        for w, other, x in names:
            if v == w and label == other and len(s) > 2 and len(s) < len(x) and s in x:
                want[f"{label}:{s}", f"{label}:{x}"] = want.get((f"{label}:{s}", f"{label}:{x}"), 0) + 1
    assert got == want


def test_candidates_by_vectors_or_words(spark):
    claims = spark.createDataFrame([("v1", "v1:a", "asserts", ["e"], "red apples fall"), ("v2", "v2:b", "denies", ["e"], "red apples fall"), ("v3", "v3:c", "denies", ["e"], "blue pears rise"), ("v4", "v4:d", "asserts", ["e"], "red apples fall")], "video_id string, claim_id string, stance string, entities array<string>, text string")
    vectors = spark.createDataFrame([("v1:a", [1.0, 0.0]), ("v2:b", [0.0, 1.0]), ("v3:c", [1.0, 0.1]), ("v4:d", None)], "claim_id string, vec array<double>")
    got = {(r["left"], r["right"]): r["reason"] for r in cl.candidate_pairs(claims, vectors).collect()}
    assert got == {("v1:a", "v3:c"): "cosine", ("v2:b", "v4:d"): "jaccard"}


def test_cosines_by_halves_match_all_with_all(spark):
    """Bounds on half of the coordinates drop nine of ten pairs, and none that belongs to the result."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 32))
    vecs = np.concatenate([base, base + rng.normal(size=base.shape) * 0.6, rng.normal(size=(120, 32))])
    rows = [(f"v{k % 9}", f"c{k:03d}", ["asserts", "denies", "uncertain"][k % 3], ["hub", f"e{k % 5}"]) for k in range(200)]
    claims = spark.createDataFrame([*rows, ("v0", "zero", "asserts", ["hub"]), ("v1", "bad", "denies", ["hub"]), ("v2", "short", "denies", ["hub"]), ("v3", "none", "denies", ["hub"])], "video_id string, claim_id string, stance string, entities array<string>")
    made = [(r[1], [float(x) for x in v]) for r, v in zip(rows, vecs, strict=True)]
    odd = [("zero", [0.0] * 32), ("bad", [None, *[1.0] * 31]), ("short", [1.0] * 31), ("none", [float("nan")] * 32)]
    vectors = spark.createDataFrame([*made, *odd], "claim_id string, vec array<double>")
    got = {(r["left"], r["right"]): (r["shared"], r["similarity"]) for r in cl.vector_pairs(claims, vectors, block=60).collect()}
    unit, want, met = vecs / np.linalg.norm(vecs, axis=1, keepdims=True), {}, 0
    for i, a in enumerate(rows):
        for k, b in enumerate(rows):
            if a[0] < b[0]:
                met += 1
                sim = float(unit[i] @ unit[k])
                if sim >= (0.55 if {a[2], b[2]} == {"asserts", "denies"} else 0.7):
                    want[a[1], b[1]] = (1 + (a[3][1] == b[3][1]), sim)
    assert len(want) > 20 and got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    assert cl.head_pairs(claims, cl.unit_halves(vectors), block=60).count() < met / 5


def test_few_products_on_the_sample_vectors(spark):
    """On the sample's vectors, which have no clusters, less than a tenth of the pairs need their full product."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").cast("string").alias("claim_id"), F.col("embedding").alias("vec"))
    claims = v.select("claim_id", F.col("claim_id").alias("video_id"), F.element_at(F.array(*[F.lit(x) for x in ("asserts", "denies", "uncertain")]), (F.col("claim_id").cast("int") % 3 + 1)).alias("stance"), F.array(F.lit("e")).alias("entities"))
    n = v.count()
    assert cl.head_pairs(claims, cl.unit_halves(v)).count() < n * (n - 1) / 2 / 10


def test_no_vectors(spark):
    claims = spark.createDataFrame([("v", "c", "asserts", ["e"])], "video_id string, claim_id string, stance string, entities array<string>")
    assert cl.vector_pairs(claims, spark.createDataFrame([], "claim_id string, vec array<double>")).count() == 0
