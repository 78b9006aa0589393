"""The data sources beside the readers; writers that lose a task; a stream that starts again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from attestra.sources import json_source as js
from attestra.sources import readers as rd
from tests.test_sources import write

SPAN = {"transcriptId": "a", "charStart": 1, "charEnd": 3, "timeStart": 0.5, "timeEnd": 2}


@pytest.fixture(scope="module")
def source(spark):
    js.register(spark)
    return lambda kind, folder, **o: spark.read.format("attestra").options(kind=kind, **o).load(str(folder))


def same(got, want):
    assert got.schema.simpleString() == want.schema.simpleString()
    key = lambda rows: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in rows)
    found = key(got.collect())
    assert found and found == key(want.collect())


def test_rows_are_those_of_the_readers(spark, source, tmp_path):
    t, m, e, c = (tmp_path / x for x in "tmec")
    for folder in (t, m, e, c):
        folder.mkdir()
        write(folder, "broken.json", '{"videoId": "b", "cues": [')
        write(folder, "_hidden.json", {"videoId": "h", "transcriptId": "h"})
    for k in range(7):
        write(t, f"{k}.json", {"videoId": f"v{k}", "language": "en", "kind": None, "more": [1], "cues": [{"start": k, "duration": 2.5, "text": "hé 😀"}, {"text": None}]})
    write(t, "none.json", {"language": "en"})
    write(m, "a.json", {"transcriptId": "a", "mentions": [{"id": "m_1", "label": "person", "surface": "Ann", "span": SPAN, "score": 1}, {"id": "m_2", "derivedFrom": "m_1"}]})
    write(m, "b.json", {"transcriptId": "b", "mentions": []})
    write(e, "a.json", {"transcriptId": "a", "edges": [{"id": "r_1", "predicate": "p", "subjectMentionId": "m_1", "objectMentionId": "m_2", "score": 0.25, "evidence": SPAN}]})
    write(c, "v1.json", {"videoId": "v1", "claims": [{"id": "v1:c_1", "text": "x", "kind": "opinion", "entities": ["a:b"], "confidence": 0.5, "evidence": [{**SPAN, "quote": "q"}], "dependencies": [{"target": "t", "kind": "supports"}]}]})
    write(c, "claims-index.json", {"videoId": "v9", "claims": [{"id": "v9:c_1"}]})
    write(c, "none.json", {"claims": [{"id": "c"}]})
    same(source("transcripts", t), rd.read_transcripts(spark, str(t))[0])
    same(source("mentions", m), rd.read_mentions(spark, str(m)))
    same(source("edges", e), rd.read_edges(spark, str(e)))
    same(source("claims", c), rd.read_claims(spark, str(c))[0].drop("file"))
    narrow = spark.read.format("attestra").schema("claim_id string, truth double").option("kind", "claims").load(str(c))
    assert [tuple(r) for r in narrow.collect()] == [("v1:c_1", None)]
    with pytest.raises(Exception, match="broken"):
        source("claims", c, mode="failfast").collect()
    with pytest.raises(Exception, match="kind must be"):
        source("nothing", c)


def test_tasks_are_planned_by_size(spark, source, tmp_path):
    assert [p.paths for p in js.packed([("a", 5), ("b", 90), ("c", 5), ("d", 5)], 30, 5)] == [("b",), ("a", "c", "d")]
    for k in range(40):
        write(tmp_path, f"{k}.json", {"videoId": f"v{k}", "cues": []})
    df = source("transcripts", tmp_path, partitionBytes="1000", openCost="74")
    assert df.count() == 40 and 4 <= df.rdd.getNumPartitions() <= 12
    empty = tmp_path / "empty"
    empty.mkdir()
    assert source("transcripts", empty).count() == 0


def test_values_that_do_not_fit_are_null(source, tmp_path):
    write(tmp_path, "a.json", {"transcriptId": "a", "mentions": [{"id": 5, "score": "high", "span": [1], "label": {"x": 1}}, None]})
    assert [(r["video_id"], r["mention_id"], r["score"], r["span"], r["label"]) for r in source("mentions", tmp_path).collect()] == [("a", "5", None, None, '{"x":1}'), ("a", None, None, None, None)]


def test_a_lost_task_leaves_nothing(spark, source, tmp_path):
    out = str(tmp_path / "out")
    spark.range(20).selectExpr("id", "id / 2 as score").write.format("attestra_updates").mode("append").option("path", out).save()
    assert spark.read.json(f"{out}/rows").agg(F.sum("id")).first()[0] == 190 and sorted(os.listdir(out)) == ["rows"]
    lost = str(tmp_path / "lost")
    with pytest.raises(Exception):  # noqa: B017
        spark.range(0, 20, 1, 4).selectExpr("if(id = 13, raise_error('lost'), id) as id").write.format("attestra_updates").mode("append").option("path", lost).save()
    assert not os.path.isdir(f"{lost}/rows") and [f for _, _, fs in os.walk(lost) for f in fs] == []


def test_a_stream_that_starts_again(spark, source, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def run():
        rows = spark.readStream.schema("speaker string, seq long").parquet(src)
        rows.writeStream.format("attestra_updates").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([("a", 1), ("b", 2)], "speaker string, seq long").write.parquet(src)
    run()
    spark.createDataFrame([("a", 3)], "speaker string, seq long").write.mode("append").parquet(src)
    run()
    got = sorted((r["speaker"], r["seq"]) for r in spark.read.json(out).collect())
    assert got == [("a", 1), ("a", 3), ("b", 2)] and sorted(d for d in os.listdir(out)) == ["batch=0", "batch=1"]
