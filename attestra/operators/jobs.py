"""Which stages of which documents have to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_state(records: DataFrame, documents: DataFrame, needs: DataFrame) -> DataFrame:
    """(video_id, stage, satisfied, stale) for every document and stage.

    records: (video_id, stage, at); needs: (stage, need), need null for a stage without one: a
    small fixed table. Stale: no record, or a needed stage is newer. Satisfied: all needs have
    records. Documents carry their records as one map, so that a single shuffle is enough.
    """
    done = records.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "at"))).alias("done"))
    needed = needs.groupBy("stage").agg(F.array_sort(F.collect_list("need")).alias("needed"))
    per = documents.select("video_id").distinct().join(done, "video_id", "left").crossJoin(F.broadcast(needed))
    at = F.try_element_at("done", F.col("stage"))
    newer = F.exists("needed", lambda n: F.coalesce(F.try_element_at("done", n) > at, F.lit(False)))
    met = F.forall("needed", lambda n: F.try_element_at(F.coalesce(F.col("done"), F.create_map().cast("map<string,date>")), n).isNotNull())
    return per.select("video_id", "stage", met.alias("satisfied"), (at.isNull() | newer).alias("stale"))


def reset_failed(rows: DataFrame) -> DataFrame:
    """Failed rows are pending again, without their last error."""
    failed = F.col("status").startswith("failed")
    return rows.withColumns({"status": F.when(failed, "pending").otherwise(F.col("status")), "last_error": F.when(~failed, F.col("last_error"))})


def status_listing(records: DataFrame) -> DataFrame:
    """(video_id, stages): each document's stages with the day on which they ran, by name."""
    one = F.concat_ws("=", "stage", F.date_format("at", "yyyy-MM-dd"))
    return records.groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("stages"))
