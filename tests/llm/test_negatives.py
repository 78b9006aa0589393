"""Hard negatives against full scans: odd rows, hot vectors, and the walk over cells itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, q string, key string, ids string, score string"


def plain(rows, positives=5, kept=3):
    """The result by loops over all rows."""
    live = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        live.append((vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    place = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (a, label, q) in enumerate(live):
        if a is None or a % 50:
            continue
        scores = [(sum(x * y for x, y in zip(q, o, strict=False)), i, lab) for n, (i, lab, o) in enumerate(live) if n != k]
        near = sorted((r for r in scores if r[2] == label), key=place)[:positives]
        for s, p, _ in near:
            hard = sorted((r for r in scores if r[2] != label and 50 * s <= 100 * r[0] <= 95 * s), key=place)[:kept]
            out += [(a, p, n + 1, r[1], s, r[0]) for n, r in enumerate(hard)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vec = lambda d=10: [rng.gauss(0, 0.3) for _ in range(d)]
    base = vec()
    found = [(k, [x + rng.gauss(0, 0.15) for x in base] if k % 3 else vec(), k % 4) for k in range(900)]
    found += [(1000 + k, base, k % 2) for k in range(400)]  # one vector, many rows, anchors too
    found += [(50, vec(), None), (100, None, 1), (150, [0.1, None, 0.2], 1), (200, [float("nan")] * 10, 2), (250, [float("inf")] * 10, 2), (None, vec(), 1), (None, base, 1), (300, vec(4), 1), (350, [], 2), (400, [0.0] * 10, 3), (450, vec(), 77), (1000, base, 0), (1000, base, 0), (500, [-x for x in base], -1)]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(*r, "kept", "kept", "kept", "kept") for r in rows], ROWS)


def got(out):
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("probe", [1, 2048])
def test_mine_matches_full_scan(spark, rows, monkeypatch, probe):
    for name, value in {"CELL_ROWS": 8, "BUCKET_ROWS": 100, "SLICE_ROWS": 3, "CHUNK": 16}.items():
        monkeypatch.setattr(negatives, name, value)
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, probe=probe)) == plain(rows)


def test_mine_few_rows(spark, rows):
    anchor = F.col("vec_id") % 50 == 0
    assert negatives.mine(frame(spark, rows).limit(0), anchor).count() == 0
    assert negatives.mine(frame(spark, [(1, [0.5], 1), (2, [0.5], 2)]), anchor).count() == 0
    assert got(negatives.mine(frame(spark, [(50, [1.0], 1), (2, [1.0], 1), (3, [0.75], 2)]), anchor)) == [(50, 2, 1, 3, 65536, 49152)]


def test_walk_is_by_falling_bound_and_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.integers(-200, 200, (2000, 8))
    codes = (negatives.fit_half(x[:, :4], 6), negatives.fit_half(x[:, 4:], 5))
    (c1, d1), (c2, d2) = negatives.nearest(x[:, :4], codes[0]), negatives.nearest(x[:, 4:], codes[1])
    radii = tuple(np.array([d[c == k].max(initial=0) for k in range(len(code))]) for c, d, code in ((c1, d1, codes[0]), (c2, d2, codes[1])))
    counts = np.zeros((6, 5), int)
    np.add.at(counts, (c1, c2), 1)
    index = negatives.Index(codes, radii, counts, counts, counts)
    first, second = negatives.half_bounds(x[:20], index)
    for k in range(20):
        walk = list(negatives.cells_by_bound(first[k], second[k]))
        assert len({w[1:] for w in walk}) == 30 and all(a[0] >= b[0] for a, b in zip(walk, walk[1:], strict=False))
        scores = x @ x[k]
        assert (scores <= first[k][c1] + second[k][c2]).all()
        least = int(np.sort(scores)[-6])
        near = negatives.visits(first[k], second[k], index, None, 300)
        far = negatives.visits(first[k], second[k], index, least, 300)
        assert not set(near) & set(far) and {(a, b) for a, b, s in zip(c1, c2, scores, strict=True) if s >= least} <= {*near, *far}
