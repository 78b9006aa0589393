"""A training-corpus pipeline over documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontaminate, linededup, mixture, ngramjoin, toxicity
from attestra.llm.common import content_key, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the model is fitted on the labelled rows of docs.

    Null and empty texts are scored as empty ones. Where the labels are of one kind, or there are
    none, the model cannot tell texts apart and rejects none.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights.any():
        return docs.select(*COLUMNS)
    return toxicity.score(docs, model).where("score < 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines one stays in the corpus; a document that loses all its lines goes, one that had none stays."""
    return linededup.dedup_lines(docs, drop_emptied=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: with the least doc_id, null last (of equal rows, one)."""
    linked = ngramjoin.link_rows(docs).where("n_links > 0").groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.count(F.lit(1)).alias("rows"), F.first(F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_key") == F.col("one_key"))).alias("stays"))
    linked = stash(linked, "linked")
    keyed, same = docs.withColumn("_key", content_key(F.col("text"))), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    kept = keyed.join(linked.where("not stays or rows > 1"), same, "left_anti")
    once = keyed.join(linked.where("stays and rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "_key"])
    return kept.union(once).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Repeated rows share the decision."""
    spans = decontaminate.shared_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = spans.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    kept = docs.withColumn("_key", content_key(F.col("text"))).join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_anti")
    return kept.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the words the mix takes of each; null and empty texts stay with none."""
    return mixture.mixed_documents(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The stages are not expressible in SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
