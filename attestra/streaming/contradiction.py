"""Speaker scores at scale, contradiction of the graph, streams and their sinks (M2, M4-M7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import NOT_WORD, WEIGHTS, token_set
from attestra.streaming.speaker import DECAY, MIDDLE, START, score_stream

#: Sequence numbers in a range: a range's utterances are folded in one row.
RANGE = 4096


def _clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def speaker_scores(utterances: DataFrame, width: int = RANGE) -> DataFrame:
    """M2: (speaker, utterances, score), as score_batch, without a speaker's whole history in one row.

    An utterance takes s to clip(a s + b); such maps compose into maps of the same form
    (a, b, lo, hi). Each range of seq is folded to one map, and a speaker's maps are folded in
    order: a row holds a range, or one map per range.
    """
    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def after(f: Column, a: Column, b: Column, lo: Column, hi: Column) -> Column:
        return F.struct((a * f["a"]).alias("a"), (a * f["b"] + b).alias("b"), _clip(a * f["lo"] + b, lo, hi).alias("lo"), _clip(a * f["hi"] + b, lo, hi).alias("hi"))

    def say(f: Column, x: Column) -> Column:
        return after(f, F.lit(1 - DECAY), F.lit(MIDDLE * DECAY) + x["weight"], F.lit(0.0), F.lit(1.0))

    part = utterances.withColumn("part", F.floor(F.col("seq") / width)).groupBy("speaker", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "weight"))).alias("rows"))
    maps = part.select("speaker", "part", F.size("rows").cast("long").alias("n"), F.aggregate("rows", zero, say).alias("f"))
    per = maps.groupBy("speaker").agg(F.sum("n").alias("utterances"), F.array_sort(F.collect_list(F.struct("part", "f"))).alias("maps"))
    whole = F.aggregate("maps", zero, lambda f, x: after(f, x["f"]["a"], x["f"]["b"], x["f"]["lo"], x["f"]["hi"]))
    per = per.withColumn("f", whole)
    return per.select("speaker", "utterances", F.round(_clip(F.col("f.a") * START + F.col("f.b"), F.col("f.lo"), F.col("f.hi")), 6).alias("score"))


def graph_contradictions(utterances: DataFrame, rel: DataFrame, names: DataFrame) -> DataFrame:
    """M4: (speaker, seq, rel_id, weight): of each utterance (speaker, seq, text) the first relation below 0.5 one of whose ends it names.

    A name is one token of more than three characters; names: (entity_id, canonical). Streams and
    tables alike: the relations are the static side, and the first is found per utterance.
    """
    low = rel.where("direct_truth < 0.5").select("rel_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    held = low.join(names.select("entity_id", F.lower("canonical").alias("token")), "entity_id").groupBy("token").agg(F.min("rel_id").alias("rel_id"))
    said = utterances.select("speaker", "seq", F.explode(token_set(F.col("text"), 3, None, NOT_WORD)).alias("token"))
    return said.join(held, "token").groupBy("speaker", "seq").agg(F.min("rel_id").alias("rel_id")).withColumn("weight", F.lit(WEIGHTS["graph"]))


def run_scores(utterances: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, available_now: bool = True):
    """M5, M6: a streaming frame (speaker, seq, weight) through the keyed scores to every sink, batch by batch.

    A batch that runs again has the same number, so sinks that replace by number stay exact.
    """

    def fan_out(batch: DataFrame, number: int) -> None:
        for sink in sinks:
            sink(batch, number)

    writer = score_stream(utterances).writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def parquet_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def refreshed_edges(edges: DataFrame, rel: DataFrame, changed: DataFrame) -> DataFrame:
    """M7: graph edges (subject_id, predicate, object_id, n) after documents (transcript_id) changed: only edges that they touch are counted anew.

    rel holds the relations after the change, changed also the old ones' edges of those documents
    (transcript_id, subject_id, predicate, object_id).
    """
    key = ["subject_id", "predicate", "object_id"]
    docs = changed.select("transcript_id").distinct()
    touched = changed.select(key).union(rel.join(docs, "transcript_id", "left_semi").select(key)).dropna().distinct()
    fresh = rel.join(touched, key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return edges.join(touched, key, "left_anti").unionByName(fresh)
