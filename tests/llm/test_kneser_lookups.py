"""Lookups of the Kneser-Ney model: each distinct run once, and sorted sums of runs of any width."""

import random

import numpy as np
import pytest

from attestra.llm import kneser_ney as kn


@pytest.mark.parametrize("top", [7, 5_000_000, (1 << 32) - 1])
@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sums_of_runs_equal_the_dictionary(top, width):
    rng = random.Random(width)
    rows = [tuple(rng.choice([0, 1, top - 1, top]) for _ in range(width)) for _ in range(500)]
    want = {}
    for k, r in enumerate(rows):
        want[r] = want.get(r, 0) + k
    cols, n = kn.summed([np.array(c, np.int64) for c in zip(*rows, strict=True)], np.arange(500))
    assert list(zip(zip(*[c.tolist() for c in cols], strict=True), n.tolist(), strict=True)) == sorted(want.items())


def test_runs_of_a_piece_are_looked_up_once(spark, monkeypatch):
    texts = [f"a b c a b c a b {w}" for w in "xyz"] * 40
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    model = kn.train(docs, order=3)
    asked = []
    found = kn.Arrays._found
    monkeypatch.setattr(kn.Arrays, "_found", lambda self, name, key, wanted, *a: (asked.append((key, len(wanted))), found(self, name, key, wanted, *a))[1])
    ids, lengths = kn.Numberer(kn.arrays_of(model))([t.encode() for t in texts])
    kn.log_probabilities(model, ids, lengths)
    # contexts of pairs: seven words and the begin; of runs of three: the pairs found
    assert sum(n for key, n in asked if key == "ctx") <= 8 + 11
    assert len(ids) == 1200


def test_kept_words_do_not_change_identifiers(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(300)),)], "text string")
    arrays = kn.arrays_of(kn.train(docs))
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(50)).encode() for _ in range(30)] + [None]
    whole, _ = kn.Numberer(arrays)(texts)
    for kept in (0, 5, 60):
        monkeypatch.setattr(kn, "KEPT_WORDS", kept)
        number = kn.Numberer(arrays)
        assert np.concatenate([number([t])[0] for t in texts]).tolist() == whole.tolist()
        assert len(number.known) <= max(kept, 51)
    assert (whole == -1).any()


def test_first_tokens_are_those_of_the_whole_text():
    texts = [None, b"", b" \n", b"A", b"a B", b"\t a  B c ", b"a b c d " * 50]
    for t in texts:
        for most in (1, 2, 3, 4):
            assert kn.first_tokens(t, most) == kn.tokens_of(t)[:most]


def test_distinct_values_and_their_places():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        v = rng.integers(0, 300, n).astype(np.uint64) << np.uint64(40)
        found, one, back = kn.distinct(v)
        assert (found == np.unique(v)).all() and (v[one] == found).all() and (found[back] == v).all()
