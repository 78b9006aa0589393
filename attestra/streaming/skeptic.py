"""Speakers who contradict themselves: over a table by ranks, and as a keyed stream with the last utterances as state (M1-M3, M5)."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from attestra.functions.text import WEIGHTS
from attestra.streaming.speaker import DECAY, MIDDLE, START, signal_weight

#: Utterances of a speaker that are remembered.
REMEMBERED = 200
OUT = "speaker string, seq long, score double, delta double, contradictions long"


def self_contradictions(utterances: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """M3: (speaker, seq, n, weight) of utterances (speaker, seq, text) that are the negation of, or are negated by, n of the speaker's last ones.

    One text is another's negation where it is "not " and that text. Utterances are taken in order of seq,
    then text, and meet by an equi-join on speaker and negated text. Null texts are empty ones; a null speaker is one.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    t = utterances.select("speaker", "seq", low.alias("low")).withColumn("at", F.row_number().over(Window.partitionBy("speaker").orderBy("seq", "low")))
    prior = t.select(F.col("speaker").alias("_s"), F.col("low").alias("_low"), F.col("at").alias("_at"))
    bare = F.when(F.col("low").startswith("not "), F.expr("substring(low, 5)"))
    asked = t.withColumn("_other", F.explode(F.array_compact(F.array(F.concat(F.lit("not "), "low"), bare))))
    met = asked.join(prior, F.col("speaker").eqNullSafe(F.col("_s")) & (F.col("_other") == F.col("_low")) & (F.col("_at") < F.col("at")) & (F.col("at") - F.col("_at") <= remembered))
    n = met.groupBy("speaker", "seq", "at").agg(F.count(F.lit(1)).alias("n"))
    return n.select("speaker", "seq", "n", F.round(F.col("n") * WEIGHTS["self"], 4).alias("weight"))


class Skeptic(StatefulProcessor):
    """M2, M3 as a stream: per speaker the score, and the last utterances in a list; rows of a batch are taken in order of seq, then text."""

    def __init__(self, remembered: int = REMEMBERED, ttl_ms: int | None = None):
        self.remembered, self.ttl = remembered, ttl_ms

    def init(self, handle) -> None:
        self.score = handle.getValueState("score", "score double", self.ttl)
        self.said = handle.getListState("said", "low string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values(["seq", "low"])
        s = self.score.get()[0] if self.score.exists() else START
        last = deque((r[0] for r in self.said.get()) if self.said.exists() else (), maxlen=self.remembered)
        counts, out = Counter(last), []
        for seq, low, weight in zip(batch["seq"], batch["low"], batch["weight"], strict=True):
            n = counts[f"not {low}"] + (counts[low[4:]] if low.startswith("not ") else 0)
            before, s = s, min(1.0, max(0.0, s + (MIDDLE - s) * DECAY + weight + n * WEIGHTS["self"]))
            if len(last) == self.remembered and last:
                counts[last[0]] -= 1
            last.append(low)
            counts[low] += 1
            out.append((key[0], int(seq), s, s - before, n))
        self.score.update((s,))
        self.said.put([(low,) for low in last])
        yield pd.DataFrame(out, columns=["speaker", "seq", "score", "delta", "contradictions"])

    def close(self) -> None:
        pass


def skeptic_stream(utterances: DataFrame, remembered: int = REMEMBERED, ttl_ms: int | None = None) -> DataFrame:
    """Rows (speaker, seq, score, delta, contradictions) of a streaming frame (speaker, seq, text); needs the RocksDB state store.

    Language signals are weighed before the state is met. With ttl_ms a speaker who was silent so long begins
    anew. What comes late is taken when it comes; a watermark on the input drops what is too late beforehand.
    """
    said = utterances.select("speaker", "seq", F.lower(F.coalesce("text", F.lit(""))).alias("low"), signal_weight(F.col("text")).alias("weight"))
    return said.groupBy("speaker").transformWithStateInPandas(Skeptic(remembered, ttl_ms), OUT, "Append", "None" if ttl_ms is None else "ProcessingTime")
