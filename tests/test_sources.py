"""Readers, captions, vectors and sinks on small files."""

import json

import pytest

from attestra.sources import captions as cp
from attestra.sources import readers as rd
from attestra.sources import sinks


def write(folder, name, body):
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))


def test_transcripts_skip_what_cannot_be_read(spark, tmp_path):
    write(tmp_path, "a.json", {"videoId": "a", "language": "en", "kind": "auto", "cues": [{"start": 0, "duration": 2.5, "text": "hi"}]})
    write(tmp_path, "b.json", '{"videoId": "b", "cues": [')
    write(tmp_path, "c.json", {"other": 1})
    rows, bad = rd.read_transcripts(spark, str(tmp_path))
    assert [(r["video_id"], r["cues"][0]["text"]) for r in rows.collect()] == [("a", "hi")]
    assert [r["file"] for r in bad.collect()] == ["b.json"]


def test_claims_leave_out_reports(spark, tmp_path):
    write(tmp_path, "v1.json", {"videoId": "v1", "claims": [{"id": "v1:c_1", "text": "x", "kind": "opinion", "entities": ["a:b"], "confidence": 0.5}]})
    write(tmp_path, "claims-index.json", {"videoId": "v9", "claims": [{"id": "v9:c_1"}]})
    write(tmp_path, "v2.json", {"videoId": "v2", "claims": []})
    rows, documents = rd.read_claims(spark, str(tmp_path))
    assert [r["claim_id"] for r in rows.collect()] == ["v1:c_1"]
    assert {(r["video_id"], r["claims"]) for r in documents.collect()} == {("v1", 1), ("v2", 0)}


def test_overrides_fill_missing_sections(spark, tmp_path):
    write(tmp_path, "o.json", {"merges": [{"from": "a:b", "to": "a:c"}], "dismissed": [{"members": ["x", "y"]}]})
    found = rd.read_overrides(spark, str(tmp_path / "o.json"))
    assert set(found) == set(rd.SECTIONS)
    assert [tuple(r) for r in found["merges"].collect()] == [("a:b", "a:c")]
    assert found["dismissed"].first()["members"] == ["x", "y"] and found["claimDeletions"].count() == 0


def test_timed_text_of_both_shapes(spark):
    new = '<p t="1000" d="2500"><s>A &amp;</s><s ac="1"> &#233;</s></p><p t="9" d="1"> </p>'
    old = '<text start="1.5" dur="2">Bob &lt;3 <b>x</b></text><text dur="2">no start</text><text start="4">y</text>'
    rows = spark.createDataFrame([(1, new + old), (2, old), (3, None), (4, "")], "id int, xml string")
    got = [(r["id"], r["start"], r["duration"], r["text"]) for r in cp.timed_text_cues(rows).orderBy("id", "cue_idx").collect()]
    assert got == [(1, 1.0, 2.5, "A & é"), (2, 1.5, 2.0, "Bob <3 x"), (2, 4.0, 0.0, "y")]


def test_tracks_and_pages(spark):
    ok = '{"captionTracks":[{"languageCode":"de","baseUrl":"u1"},{"languageCode":"en","kind":"asr","baseUrl":"u2"}]}'
    rows = spark.createDataFrame([(1, ok), (2, None), (3, '{"captionTracks":[broken]}'), (4, '"playabilityStatus":{"status":"UNPLAYABLE"}')], "id int, html string")
    got = {r["id"]: (r["state"], len(r["tracks"])) for r in cp.page_state(rows).collect()}
    assert got == {1: ("ok", 2), 2: ("no-captions", 0), 3: ("no-captions", 0), 4: ("removed", 0)}


def test_vectors_are_embedded_once_and_another_model_misses(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    known = rd.cached_vectors(texts, spark.createDataFrame([], "text_hash string, vec array<float>"), "m1").where("text = 'a'").selectExpr("text_hash", "array(cast(9.0 as float)) as vec")

    def embed(frames):
        for f in frames:
            yield f.assign(vec=[[1.0]] * len(f))[["text_hash", "vec"]]

    assert sorted(r["vec"][0] for r in rd.fill_vectors(texts, known, "m1", embed).collect()) == [1.0, 9.0]
    assert sorted(r["vec"][0] for r in rd.fill_vectors(texts, known, "m2", embed).collect()) == [1.0, 1.0]


def test_seeds_and_inserts(spark):
    lines = spark.createDataFrame([("https://x.org/watch?v=abcdefghijk",), ("abcdefghijk",), ("# abcdefghijk",), ("",), (None,), ("short",)], "line string")
    seeds = rd.parse_seeds(lines)
    assert {r["video_id"] for r in seeds.collect()} == {"abcdefghijk"} and seeds.count() == 2
    catalog = spark.createDataFrame([("zzz", "fetched")], "video_id string, status string")
    assert {(r["video_id"], r["status"]) for r in rd.insert_new(catalog, seeds).collect()} == {("zzz", "fetched"), ("abcdefghijk", "pending")}


def test_reports_are_known_and_history_keeps_other_days(spark, tmp_path):
    df = spark.createDataFrame([("d1", "s", "n", 1.0), ("d2", "s", "n", 2.0)], "day string, section string, name string, value double")
    with pytest.raises(ValueError):
        sinks.write_reports(str(tmp_path), {"nothing": df})
    folder = str(tmp_path / "history")
    sinks.write_metric_history(folder, df)
    sinks.write_metric_history(folder, df.where("day = 'd2'").selectExpr("day", "section", "name", "5.0D as value"))
    assert {(r["day"], r["value"]) for r in spark.read.parquet(folder).collect()} == {("d1", 1.0), ("d2", 5.0)}
