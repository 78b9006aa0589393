"""Catalogue queries and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify_gaps(rows: DataFrame) -> DataFrame:
    """K8: ok, retry or needs-user, with the reason."""
    ok = F.col("has_transcript") & (F.col("status") == "fetched")
    needs = F.col("status") == "failed-needs-user"
    bucket = F.when(ok, "ok").when(needs, "needs-user").otherwise("retry")
    reason = F.when(ok, "transcript present").when(needs, F.coalesce("last_error", F.lit("no captions available; upload or pick another source"))).otherwise(F.coalesce("last_error", F.lit("not yet fetched")))
    return rows.withColumn("bucket", bucket).withColumn("reason", reason)


def page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """K4, K5: newest first, undated last; size between 1 and 200. Only a page's rows are ranked together."""
    size = max(1, min(200, size))
    top = rows.orderBy(F.desc_nulls_last("published"), "video_id").limit(number * size)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("published"), "video_id"))).where(F.col("rank") > (number - 1) * size)
    return ranked


def matching(rows: DataFrame, q: str) -> DataFrame:
    """K2: text in title, id or channel."""
    return rows.where(F.lower(F.concat_ws(" ", "title", "video_id", "channel")).contains(q.lower()))


def newest(rows: DataFrame) -> DataFrame:
    """The newest document of each channel; ties by the greatest id."""
    return rows.where("published is not null").groupBy("channel").agg(F.max(F.struct("published", "video_id")).alias("m")).select("channel", "m.video_id", "m.published")


def filtered(rows: DataFrame, channel: str | None = None, status: str | None = None, not_status: str | None = None, required: list[str] | None = None) -> DataFrame:
    """K1: rows of a channel, of a status, not of another, and without one of the required stages (stages is a map)."""
    out = rows
    for column, value, same in (("channel", channel, True), ("status", status, True), ("status", not_status, False)):
        if value is not None:
            out = out.where(F.col(column).eqNullSafe(F.lit(value)) == same)
    if required:
        missing = F.array_except(F.array(*[F.lit(s) for s in required]), F.map_keys("stages"))
        out = out.where(F.col("stages").isNull() | (F.size(missing) > 0))
    return out


def text_match(rows: DataFrame, q: str) -> DataFrame:
    """K2: text in title, id, channel, keywords (an array) or description."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "video_id", "channel", F.array_join(F.col("keywords"), " "), "description")), F.lit(q.strip().lower())))


def with_entity_matches(rows: DataFrame, found: DataFrame, index: DataFrame, q: str) -> DataFrame:
    """K3: found rows and those fetched documents that hold an entity whose name matches; index: (entity_id, canonical, video_id)."""
    hit = index.where(F.contains(F.lower("canonical"), F.lit(q.strip().lower()))).select("video_id").distinct()
    more = rows.where("status = 'fetched'").join(hit, "video_id", "left_semi")
    return found.unionByName(more.join(found.select("video_id"), "video_id", "left_anti"))


def page_with_total(rows: DataFrame, number: int = 1, size: int = 50) -> tuple[DataFrame, int]:
    """K5: (a page, the number of all rows)."""
    return page(rows, number, size), rows.count()


def column_sorted(rows: DataFrame, column: str, down: bool = False, limit: int = 200) -> DataFrame:
    """K6: by a column, numbers in texts by value; blank ones last, and first when the order is turned; ties by id."""
    text = F.lower(F.col(column).cast("string"))
    natural = F.array_join(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 18, "0")).otherwise(p)), "")
    blank = (F.coalesce(text, F.lit("")) == "").cast("int")
    order = [blank.desc(), natural.desc()] if down else [blank.asc(), natural.asc()]
    return rows.orderBy(*order, "video_id").limit(limit)


def suggestions(entities: DataFrame, documents: DataFrame, most: tuple[int, int] = (8, 6)) -> DataFrame:
    """K7: (section, id, total): the first entities and documents found, each with how many were found in all."""
    n = lambda df: df.agg(F.count(F.lit(1)).alias("total"))
    a = entities.limit(most[0]).select(F.lit("entity").alias("section"), F.col("entity_id").alias("id")).crossJoin(n(entities))  # one row
    return a.union(documents.limit(most[1]).select(F.lit("document"), "video_id").crossJoin(n(documents)))


def classified_failures(rows: DataFrame, failures: DataFrame, needs_user: tuple[str, ...] = ("login-required", "removed", "no-captions")) -> DataFrame:
    """K9: rows with the status, error and reason of their last failure (video_id, reason, message, seq); reasons that no retry mends need a user."""
    last = failures.groupBy("video_id").agg(F.max_by(F.struct("reason", "message"), "seq").alias("f"))
    j = rows.join(last, "video_id", "left")
    status = F.when(F.col("f").isNull(), F.col("status")).when(F.col("f.reason").isin(list(needs_user)), "failed-needs-user").otherwise("failed-retryable")
    return j.withColumns({"status": status, "last_error": F.coalesce("f.message", "last_error"), "error_reason": F.col("f.reason")}).drop("f")


def ingest_candidates(rows: DataFrame) -> DataFrame:
    """Rows still to be fetched: pending or to be tried again."""
    return rows.where("status in ('pending', 'failed-retryable')")


def cleared_stages(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Rows without the records of some stages; clearing "fetched" makes a row pending."""
    kept = F.map_filter("stages", lambda k, _: ~k.isin(stages))
    out = rows.withColumn("stages", kept)
    return out.withColumn("status", F.when(F.lit("fetched" in stages), "pending").otherwise(F.col("status"))) if "fetched" in stages else out


def cleared_paths(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose transcript file is gone, without its path; files: (path)."""
    there = files.select(F.col("path").alias("transcript_path"), F.lit(True).alias("_f")).distinct()
    return rows.join(there, "transcript_path", "left").withColumn("transcript_path", F.when(F.col("_f"), F.col("transcript_path"))).drop("_f")


def stage_histogram(rows: DataFrame) -> DataFrame:
    """(stage, n) over the records of all rows."""
    return rows.select(F.explode(F.map_keys("stages")).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def state_audit(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(video_id, status, transcript, nlp, suspicious) by which files (video_id, what, at) are there; an older result is stale."""
    at = files.groupBy("video_id").agg(F.max(F.when(F.col("what") == "transcript", F.col("at"))).alias("t"), F.max(F.when(F.col("what") == "nlp", F.col("at"))).alias("n"))
    j = rows.select("video_id", "status").join(at, "video_id", "left")
    nlp = F.when(F.col("n").isNull(), "missing").when(F.col("t") > F.col("n"), "stale").otherwise("present")
    j = j.select("video_id", "status", F.when(F.col("t").isNull(), "missing").otherwise("present").alias("transcript"), nlp.alias("nlp"))
    return j.withColumn("suspicious", (F.col("nlp") == "stale") | ((F.col("status") == "fetched") & ((F.col("transcript") == "missing") | (F.col("nlp") == "missing"))))


def graph_stale(stages: DataFrame, changes: DataFrame) -> DataFrame:
    """Graph stages (stage, at) with stale: never run, or run before the last change (at)."""
    dirty = changes.agg(F.max("at").alias("_dirty"))
    return stages.crossJoin(F.broadcast(dirty)).select("stage", "at", (F.col("at").isNull() | F.coalesce(F.col("_dirty") > F.col("at"), F.lit(False))).alias("stale"))  # one row


def behind_upstream(rows: DataFrame, upstream: DataFrame) -> DataFrame:
    """The newest document of each channel, and whether upstream (channel, published) has a newer one."""
    up = upstream.groupBy("channel").agg(F.max("published").alias("_up"))
    return newest(rows).join(up, "channel", "left").select("channel", "video_id", "published", F.coalesce(F.col("_up") > F.col("published"), F.lit(False)).alias("behind"))


def stale_indexes(derived: DataFrame, sources: DataFrame) -> DataFrame:
    """Derived files (name, at) with fresh: not older than any source (at)."""
    last = sources.agg(F.max("at").alias("_last"))
    return derived.crossJoin(F.broadcast(last)).select("name", "at", F.coalesce(F.col("at") >= F.col("_last"), F.col("at").isNotNull()).alias("fresh"))  # one row


def run_outcomes(planned: DataFrame, done: DataFrame) -> DataFrame:
    """(stage, outcome, n) of planned runs (video_id, stage) against what was done (video_id, stage, ok)."""
    j = planned.join(done, ["video_id", "stage"], "left")
    return j.groupBy("stage", F.when(F.col("ok"), "done").when(~F.col("ok"), "failed").otherwise("skipped").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
