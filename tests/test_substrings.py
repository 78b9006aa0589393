"""The substring index beside plain scans, after changes, deletions and a failed update."""

import random

from pyspark.sql import functions as F

from attestra.operators.substrings import SubstringIndex, grams


def hits(index, q):
    return sorted(tuple(r) for r in index.search(q).collect())


def test_hits_are_those_of_a_scan_through_changes(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abAB c%_é😀") for _ in range(rng.randrange(0, 30)))
    now = {f"k{i}": text() for i in range(300)}
    index = SubstringIndex(spark, str(tmp_path / "i"), 8)
    assert hits(index, "abc") == [] and index.texts().count() == 0
    frame = lambda d: spark.createDataFrame(list(d.items()), "key string, text string")
    assert index.update(frame(now)) == 0
    change = {f"k{i}": (None if i % 3 == 0 else text()) for i in range(0, 120)} | {"new": "xxabAxx", None: "abA"}
    assert index.update(frame(change)) == 1
    now = {k: v for k, v in (now | change).items() if k is not None and v is not None}
    other = index.compact(str(tmp_path / "j"))
    assert other.generations() == [0]
    for q in ("abA", "ABab", "b%", "", "É😀a"[:2], "zzzz", "a c"):
        want = sorted((k, v, v.lower().find(q.lower())) for k, v in now.items() if q.lower() in v.lower())
        assert hits(index, q) == want, q
        assert q == "" or hits(other, q) == want, q
    # an update that ended before its names were written is not seen, and is replaced by the next
    frame({"half": "halfway"}).selectExpr("key", "'hal' as gram", "0 as part").write.partitionBy("part").parquet(str(tmp_path / "i/postings/gen=2"))
    assert hits(index, "halfway") == []
    assert index.update(frame({"whole": "halfway"})) == 2 and hits(index, "FWAY") == [("whole", "halfway", 3)]


def test_searches_read_the_parts_of_their_grams_only(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path), 16)
    index.update(spark.range(2000).selectExpr("cast(id as string) as key", "concat('name ', conv(cast(id * 7919 as string), 10, 36)) as text"))
    found = index.candidates(["name"[:3]])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan and found.count() == 2000
    assert 1 <= len({f.split("part=")[1].split("/")[0] for f in index._of("postings", "key string, gram string", ["nam"]).inputFiles()}) <= 16


def test_grams(spark):
    rows = spark.createDataFrame([("abcab",), ("ab",), ("",), ("a😀b\nc",), (None,), ("aaaa",)], "t string")
    assert [r[0] for r in rows.select(grams(F.col("t"))).collect()] == [["abc", "bca", "cab"], [], [], ["a😀b", "😀b\n", "b\nc"], None, ["aaa"]]
