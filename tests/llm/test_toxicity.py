"""The toxicity classifier's parts against plain loops."""

import math
import random

import numpy as np

from attestra.llm import toxicity as tx

M = (1 << 64) - 1


def plain_features(text):
    codes = [ord(c) * 0x9E3779B97F4A7C15 & M for c in (text or "").lower()]
    found = set()
    for n in tx.LENGTHS:
        for i in range(len(codes) - n + 1):
            h = codes[i]
            for j in range(1, n):
                h = (h * 0x100000001B3 & M) ^ codes[i + j]
            found.add((h * (0xD6E8FEB86659FD93 + 2 * n) & M) >> (64 - tx.BITS))
    return sorted(found)


def test_features_match_plain_hashes():
    rng = random.Random(1)
    texts = ["", None, "a", "ab", "abc", "Straße ÄÖ", "\U0001f600" * 5, "x" * 5000] + ["".join(rng.choice("abcdé 你") for _ in range(rng.randrange(80))) for _ in range(40)]
    for t in texts:
        f = tx.features(t)
        assert f.tolist() == plain_features(t) and (tx.unpack(tx.pack(f)) == f).all()


def test_ratios_match_plain_logs():
    toxic, clean = np.array([0, 3, 5, 1]), np.array([0, 1, 0, 9])
    got = tx.ratios(toxic, clean, 6, 10)
    for k in range(4):
        p = (toxic[k] + 2 * 6 / 16) / (6 * (1 + 2 / 16))
        q = (clean[k] + 2 * 10 / 16) / (10 * (1 + 2 / 16))
        assert abs(got[k] - math.log(p / q)) < 1e-6
    assert abs(got[0]) < 1e-6 and got[2] > got[1] > 0 > got[3]


def test_fit_matches_plain_steps():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(30, rng.integers(1, 8), replace=False)) for _ in range(40)]
    labels, scale = (rng.random(40) < 0.4).astype(int), rng.normal(0, 1, 30).astype(np.float32)
    w, g2, order = [0.0] * 30, [1e-3] * 30, np.random.default_rng(5)
    b, b2 = math.log(labels.mean() / (1 - labels.mean())), 1.0
    for _ in range(3):
        for k in order.permutation(40):
            z = sum(w[i] * scale[i] for i in rows[k]) + b
            err = 1 / (1 + math.exp(-z)) - labels[k]
            if abs(err) < 1e-3:
                continue
            for i in rows[k]:
                g = err * scale[i] + 1e-5 * w[i]
                g2[i] += g * g
                w[i] -= 0.1 * g / math.sqrt(g2[i])
            b2 += err * err
            b -= 0.1 * err / math.sqrt(b2)
    got, bias = tx.fit_part(rows, labels, scale, epochs=3)
    assert np.allclose(got, np.array(w) * scale, atol=1e-4) and abs(bias - b) < 1e-4


def test_scores_are_sums_of_weights():
    weights = np.random.default_rng(4).normal(0, 0.1, 1 << tx.BITS).astype(np.float32)
    model = tx.Model(weights, -0.3)
    texts = ["some text", None, "", "another " * 50]
    want = [1 / (1 + math.exp(-(sum(float(weights[i]) for i in plain_features(t)) - 0.3))) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-6)
