"""Speaker scores: stateless language signals, a batch fold, and the same rule as a keyed stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from attestra.functions.text import ABSOLUTES, EVASIONS, HEDGES, WEIGHTS

START, DECAY, MIDDLE = 0.7, 0.05, 0.5


def signal_weight(text: Column) -> Column:
    """M1: the sum of the weights of all phrases that an utterance holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total: Column = F.lit(0.0)
    for kind, phrases in (("hedge", HEDGES), ("evasion", EVASIONS), ("absolute", ABSOLUTES)):
        for p in phrases:
            total = total + F.when(low.contains(p), WEIGHTS[kind]).otherwise(0.0)
    return total


def score_batch(utterances: DataFrame) -> DataFrame:
    """M2: each speaker's last score from rows (speaker, seq, weight), folded in order of seq.

    score moves by DECAY of its distance from the middle, plus the weight, within 0 and 1.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "weight")))

    def step(s: Column, x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s + (MIDDLE - s) * DECAY + x["weight"]))

    per = utterances.groupBy("speaker").agg(rows.alias("rows"))
    return per.select("speaker", F.size("rows").cast("long").alias("utterances"), F.round(F.aggregate("rows", F.lit(START), step), 6).alias("score"))


class SpeakerScore(StatefulProcessor):
    """M2 as a stream: the state is a speaker's score; rows of a batch are taken in order of seq."""

    def init(self, handle) -> None:
        self.score = handle.getValueState("score", "score double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values("seq")
        s, n = self.score.get() if self.score.exists() else (START, 0)
        out = []
        for seq, w in zip(batch["seq"], batch["weight"], strict=True):
            before = s
            s = min(1.0, max(0.0, s + (MIDDLE - s) * DECAY + w))
            n += 1
            out.append((key[0], int(seq), s, s - before))
        self.score.update((s, n))
        yield pd.DataFrame(out, columns=["speaker", "seq", "score", "delta"])

    def close(self) -> None:
        pass


def score_stream(utterances: DataFrame) -> DataFrame:
    """Rows (speaker, seq, score, delta) from a streaming frame (speaker, seq, weight); needs the RocksDB state store."""
    return utterances.groupBy("speaker").transformWithStateInPandas(SpeakerScore(), "speaker string, seq long, score double, delta double", "Append", "None")
