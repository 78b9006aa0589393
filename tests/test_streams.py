"""Self-contradictions as a table and as a stream; percentiles and cues by plain loops."""

import random

from attestra.operators import quality as ql
from attestra.operators import segments as sg
from attestra.streaming import skeptic as sk


def plain(rows, remembered):
    """(speaker, seq, score, contradictions) by one loop."""
    said, score, out = {}, {}, []
    for speaker, seq, text in sorted(rows, key=lambda r: (r[1], (r[2] or "").lower())):
        low = (text or "").lower()
        past = said.setdefault(speaker, [])
        n = sum((p == f"not {low}") + (low == f"not {p}") for p in past[-remembered:])
        weight = -0.02 * ("maybe" in low) - 0.03 * ("never" in low)
        s = score.get(speaker, 0.7)
        score[speaker] = min(1.0, max(0.0, s + (0.5 - s) * 0.05 + weight - 0.15 * n))
        past.append(low)
        out.append((speaker, seq, round(score[speaker], 9), n))
    return sorted(out)


def test_contradictions_agree_as_table_and_as_stream_with_a_restart(spark, tmp_path):
    rng = random.Random(5)
    texts = ["It is so", "not it is so", "not not it is so", "Maybe", "not maybe", "never", None, "not "]
    rows = [(f"s{rng.randrange(3)}", k, rng.choice(texts)) for k in range(150)]
    schema, src = "speaker string, seq long, text string", str(tmp_path / "in")
    want = plain(rows, 20)
    batch = {(r["speaker"], r["seq"]): r["n"] for r in sk.self_contradictions(spark.createDataFrame(rows, schema), 20).collect()}
    assert batch == {(a, b): n for a, b, _, n in want if n}

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        q = sk.skeptic_stream(stream, 20).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    for part in (rows[:70], rows[70:]):  # the second run goes on from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    got = sorted((r["speaker"], r["seq"], round(r["score"], 9), r["contradictions"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_percentiles_without_groups(spark):
    rng = random.Random(6)
    values = [rng.randrange(500) for _ in range(3000)] + [7] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(7)
    at = {f"p{k}": k / 100 for k in (0, 25, 50, 90, 99, 100)}
    row = ql.percentiles(df, [], "v", at).first()
    values.sort()
    assert {k: row[k] for k in at} == {k: values[min(len(values) - 1, int(len(values) * p))] for k, p in at.items()}
    assert ql.percentiles(df.limit(0), [], "v", {"p": 0.5}).first()["p"] is None


def test_cue_at_offsets(spark):
    cues = spark.createDataFrame([("v", 0, 0.0, "abc"), ("v", 1, 1.5, ""), ("v", 2, 4.0, "xy"), ("w", 0, 9.0, "q")], "video_id string, cue_idx int, start double, text string")
    offsets = spark.createDataFrame([("v", p) for p in (-1, 0, 3, 4, 5, 100)] + [("u", 0)], "video_id string, pos int")
    got = sorted((r["pos"], r["cue_idx"], r["time"]) for r in sg.cue_at(cues, offsets).collect())
    assert got == [(0, 0, 0.0), (3, 0, 0.0), (4, 1, 1.5), (5, 2, 4.0), (100, 2, 4.0)]
    assert sg.line_search(cues, "B").count() == 1 and sg.line_search(cues, " ").count() == 0
