"""The Merkle manifest against a plain tree, on odd tables and with small superblocks."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from attestra.llm import merkle
from attestra.llm.common import UPPER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, i string, gid string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain(rows, branch):
    """(doc_id, leaf, subroot, root, siblings) of every row, by plain loops."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][k : k + branch]) for k in range(0, len(levels[-1]), branch)])
        return levels

    def beside(levels, j):
        found = []
        for level in levels[:-1]:
            run = range(j - j % branch, min(j - j % branch + branch, len(level)))
            found += [level[k] for k in run if k != j]
            j //= branch
        return found

    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    leaves = [(r[0], r[2], digest(*[value(v) for v in (r[0], r[3], r[2], r[4], r[1])])) for r in rows]
    langs = sorted({r[1] for r in leaves}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([r[2] for r in sorted((r for r in leaves if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]) for g in langs]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(langs):
        mine = sorted((r for r in leaves if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        out += [(r[0], r[2], trees[k][-1][0], top[-1][0], "".join(beside(trees[k], j) + beside(top, k))) for j, r in enumerate(mine)]
    return out


def lowered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    langs = [None, "", "de", "en", "en", "en", "é", "zz"] + [f"l{k}" for k in range(12)]
    found = [(rng.randint(-50, 2**60), rng.choice(["Aa é", "x" * 50, "plain", None, ""]), rng.choice(langs), rng.choice(["s", None]), rng.choice([3, None])) for _ in range(700)]
    found += [(None, None, None, None, None)] * 3 + [(7, "Same", "en", "s", 1)] * 5 + [(8, "Long Text " * 40_000, "en", "s", 1), (9, "One", "only", "s", 1)]
    return [(*r, "kept", "kept", "kept", "kept") for r in found]


@pytest.mark.parametrize(("branch", "depth"), [(8, 3), (2, 2), (3, 1)])
def test_manifest_matches_plain_tree(spark, rows, branch, depth):
    out = merkle.manifest(spark.createDataFrame(rows, DOCS), COLUMNS, "lang", "doc_id", {"text": lowered()}, branch, depth).collect()
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], bytes(r["proof"]).hex()) for r in out)
    assert got == sorted((str(a), *rest) for a, *rest in plain(rows, branch))
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    for r in out:
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any(t and t.lower() != t for t in texts[r["doc_id"]])
        assert r["verified"] == (r["folded_root"] == r["root"]) == (r["received_leaf"] == r["leaf"]) and (changed or r["verified"])
        path = [*merkle.places(r["i"], r["n"], branch), *merkle.places(r["g"], r["n_groups"], branch)]
        assert merkle.fold(r["received_leaf"], bytes(r["proof"]).hex(), path) == r["folded_root"]
    assert any(not r["verified"] for r in out)


def test_manifest_of_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    assert merkle.manifest(frame.limit(0), COLUMNS, "lang", "doc_id").count() == 0
    (one,) = merkle.manifest(frame.where("doc_id = 9"), COLUMNS, "lang", "doc_id").collect()
    assert one["leaf"] == one["subroot"] == one["root"] and bytes(one["proof"]) == b"" and one["verified"]
