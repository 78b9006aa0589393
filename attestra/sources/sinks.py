"""Writers of reports, metric history and URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The reports of a run, each a folder of its own.
REPORTS = ("entity-index", "entity-videos", "relationships-graph", "claims-index", "dependency-graph", "contradictions", "edge-truth", "consonance", "conflicts", "novel")


def write_reports(folder: str, reports: dict[str, DataFrame]) -> None:
    """Each report as Parquet in its folder, replacing the one before."""
    unknown = set(reports) - set(REPORTS)
    if unknown:
        raise ValueError(f"unknown reports: {sorted(unknown)}")
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_metric_history(folder: str, metrics: DataFrame) -> None:
    """Metrics (day, section, name, value) by day; a day that is written again is replaced, others stay."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def url_list(base: str, static: list[str], stages: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(section, url, lastmod): fixed pages, and one per document, entity and claim; lastmod is a document's newest stage time."""
    spark = stages.sparkSession
    page = lambda path, key: F.concat(F.lit(f"{base}/{path}/"), F.url_encode(key))
    newest = stages.groupBy("video_id").agg(F.max("at").alias("lastmod"))
    none = F.lit(None).cast(newest.schema["lastmod"].dataType)
    fixed = spark.createDataFrame([(f"{base}{p}",) for p in static], "url string").select(F.lit("static").alias("section"), "url", none.alias("lastmod"))
    docs = newest.select(F.lit("document").alias("section"), page("video", F.col("video_id")).alias("url"), "lastmod")
    ents = entities.select(F.lit("entity").alias("section"), page("entity", F.col("entity_id")).alias("url"), none.alias("lastmod"))
    said = claims.join(newest, "video_id", "left").select(F.lit("claim").alias("section"), page("claim", F.col("claim_id")).alias("url"), "lastmod")
    return fixed.union(docs).union(ents).union(said)


def write_url_list(folder: str, urls: DataFrame) -> None:
    """The list as text, a URL and its date per line."""
    urls.select(F.concat_ws("\t", "url", F.date_format("lastmod", "yyyy-MM-dd"))).write.mode("overwrite").text(folder)
