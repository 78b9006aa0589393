"""Readers of transcripts, mentions, relations, claims, overrides and caches (A1-A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<transcriptId:string,charStart:int,charEnd:int,timeStart:double,timeEnd:double>"
TRANSCRIPT = "videoId string, language string, kind string, cues array<struct<start:double,duration:double,text:string>>"
MENTIONS = f"transcriptId string, mentions array<struct<id:string,label:string,surface:string,canonical:string,span:{SPAN},score:double,derivedFrom:string>>"
EDGES = f"transcriptId string, edges array<struct<id:string,predicate:string,subjectMentionId:string,objectMentionId:string,score:double,evidence:{SPAN}>>"
CLAIMS = "videoId string, claims array<struct<id:string,text:string,kind:string,entities:array<string>,relationships:array<string>,evidence:array<struct<transcriptId:string,charStart:int,charEnd:int,timeStart:double,timeEnd:double,quote:string>>,confidence:double,directTruth:double,rationale:string,dependencies:array<struct<target:string,kind:string,rationale:string>>,hostStance:string>>"
#: The sections of the override file, each with its fields.
SECTIONS = {
    "merges": "from:string,to:string",
    "deletedEntities": "key:string",
    "display": "key:string,display:string",
    "notSame": "a:string,b:string",
    "dismissed": "members:array<string>",
    "videoMerges": "videoId:string,from:string,to:string",
    "deletedRelations": "videoId:string,subject:string,predicate:string,object:string,timeStart:double",
    "claimTruthOverrides": "claimId:string,directTruth:double",
    "claimDeletions": "claimId:string",
    "claimFieldOverrides": "claimId:string,text:string,kind:string,hostStance:string,rationale:string",
    "contradictionDismissals": "a:string,b:string",
    "customContradictions": "a:string,b:string,summary:string,sharedEntities:array<string>",
}
# File names in a folder of claims that are reports, not documents.
REPORTS = ["claims-index.json", "dependency-graph.json", "contradictions.json", "edge-truth.json", "consonance.json", "embeddings.json", "contradiction-verdicts.json"]
# Marks in a flat override table.
DELETED, NOT_SAME, DISMISSED = "__deleted__", "__not_same__", "__dismissed__"
OLD_DELETED, OLD_DISMISSED = "__hidden__", "__rejected__"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): JSON documents with a fixed schema; what cannot be read goes to rejects (file, record, parsed), parsed being what was understood of it."""
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", multi_line).json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    known = F.to_json(F.struct(*[c for c in raw.columns if c not in ("_bad", "file")]))
    return raw.where("_bad is null").drop("_bad"), raw.where("_bad is not null").select("file", F.col("_bad").alias("record"), known.alias("parsed"))


def read_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """A1: (video_id, language, kind, cues), and the rejects."""
    rows, bad = read_json(spark, path, TRANSCRIPT, multi_line)
    return rows.where("videoId is not null").select(F.col("videoId").alias("video_id"), "language", "kind", "cues"), bad


def read_mentions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A2: a row per mention or derived date."""
    rows, _ = read_json(spark, path, MENTIONS, multi_line)
    return rows.select(F.col("transcriptId").alias("video_id"), F.inline("mentions")).withColumnsRenamed({"id": "mention_id", "derivedFrom": "derived_from"})


def read_edges(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A3: a row per relation edge."""
    rows, _ = read_json(spark, path, EDGES, multi_line)
    return rows.select(F.col("transcriptId").alias("video_id"), F.inline("edges")).withColumnsRenamed({"id": "edge_id", "subjectMentionId": "subject_mention_id", "objectMentionId": "object_mention_id"})


def read_claims(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """A4: (claims, documents): a row per claim, and the documents with their number of claims; reports are no documents."""
    rows, _ = read_json(spark, path, CLAIMS, multi_line)
    rows = rows.where(~F.col("file").isin(REPORTS) & F.col("videoId").isNotNull())
    documents = rows.select(F.col("videoId").alias("video_id"), F.coalesce(F.size("claims"), F.lit(0)).alias("claims"))
    return rows.select(F.col("videoId").alias("video_id"), F.inline("claims")).withColumnsRenamed({"id": "claim_id", "hostStance": "stance", "directTruth": "truth"}), documents


def read_overrides(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A5: a DataFrame per section of the override file; a section that is missing is empty."""
    schema = ", ".join(f"`{k}` array<struct<{v}>>" for k, v in SECTIONS.items())
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return {k: raw.select(F.inline(F.coalesce(F.col(k), F.array().cast(f"array<struct<{v}>>")))) for k, v in SECTIONS.items()}


def typed_overrides(flat: DataFrame) -> DataFrame:
    """(section, fields) from a flat table (key, value): what each prefixed key stands for.

    fields is an array of strings in the order of the section's columns; dismissed holds the
    members. Rows that fit no section are left out.
    """
    k, v = F.col("key"), F.col("value")

    def after(prefix: str) -> Column:
        return F.substring(k, F.lit(len(prefix) + 1), F.length(k))

    def head(text: Column) -> Column:
        return F.substring_index(text, ":", 1)

    def tail(text: Column) -> Column:
        return F.substring(text, F.instr(text, ":") + 1, F.length(text))

    parts = F.split(tail(after("del:")), r"\|")
    inner = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "|")
    time = F.try_element_at(parts, F.lit(-1))
    pair = F.split(k, "~~")
    members = F.array_remove(F.split(k, r"\|\|"), "")
    sentinel = v.isin(DELETED, NOT_SAME, DISMISSED, OLD_DELETED, OLD_DISMISSED)

    def row(section: str, *fields: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.array(*fields).alias("fields"))

    found = (
        F.when(k.startswith("display:"), row("display", after("display:"), v))
        .when(k.startswith("video:"), F.when(F.instr(after("video:"), ":") > 0, row("videoMerges", head(after("video:")), tail(after("video:")), v)))
        .when(k.startswith("del:"), F.when((F.instr(after("del:"), ":") > 0) & (F.size(parts) >= 4) & time.try_cast("double").isNotNull(), row("deletedRelations", head(after("del:")), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), inner, time)))
        .when(k.contains("~~") & (v == NOT_SAME), F.when((F.get(pair, F.lit(0)) != "") & (F.get(pair, F.lit(1)) != ""), row("notSame", F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))))
        .when(k.contains("||") & v.isin(DISMISSED, OLD_DISMISSED), F.when(F.size(members) >= 2, F.struct(F.lit("dismissed").alias("section"), members.alias("fields"))))
        .when(k.contains("~~") | k.contains("||"), None)
        .when(v.isin(DELETED, OLD_DELETED), row("deletedEntities", k))
        .when((v != "") & ~sentinel, row("merges", k, v))
    )
    return flat.select(found.alias("x")).where("x is not null").select("x.section", "x.fields")


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts with vec, null where the cache has none for sha1(model NUL text); cache: (text_hash, vec)."""
    keyed = texts.withColumn("text_hash", F.sha1(F.concat(F.lit(model), F.lit("\0"), F.col("text"))))
    return keyed.join(cache.select("text_hash", "vec").dropDuplicates(["text_hash"]), "text_hash", "left")


def fill_vectors(texts: DataFrame, cache: DataFrame, model: str, embed) -> DataFrame:
    """(text_hash, vec) of all texts: from the cache where it knows them, else by embed.

    embed takes an iterator of pandas frames (text_hash, text) and yields (text_hash, vec); each missing
    text is embedded once, by Spark tasks. Another model has other hashes, so its cache hits nothing.
    """
    found = cached_vectors(texts, cache, model).select("text_hash", "text", "vec")
    missing = found.where("vec is null").select("text_hash", "text").dropDuplicates(["text_hash"])
    made = missing.mapInPandas(embed, "text_hash string, vec array<float>")
    return found.where("vec is not null").select("text_hash", "vec").distinct().unionByName(made)


def latest_verdicts(rows: DataFrame) -> DataFrame:
    """Of rows (left, right, verdict, seq) the last of each pair, whichever way round, as (lo, hi, verdict, seq)."""
    pair = rows.withColumn("lo", F.least("left", "right")).withColumn("hi", F.greatest("left", "right"))
    return pair.groupBy("lo", "hi").agg(F.max_by("verdict", F.struct("seq", "verdict")).alias("verdict"), F.max("seq").alias("seq"))


def parse_seeds(lines: DataFrame, column: str = "line") -> DataFrame:
    """(video_id, source_url) from lines with a URL or an id; blank lines and comments are skipped."""
    line = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    in_url = F.regexp_extract(line, r"(?:v=|youtu\.be/|/shorts/)([A-Za-z0-9_-]{11})", 1)
    alone = F.regexp_extract(line, r"^([A-Za-z0-9_-]{11})$", 1)
    rows = lines.select(line.alias("line"), in_url.alias("u"), alone.alias("i")).where("line <> '' and not startswith(line, '#') and (u <> '' or i <> '')")
    return rows.select(F.when(F.col("u") != "", F.col("u")).otherwise(F.col("i")).alias("video_id"), F.when(F.col("u") != "", F.col("line")).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("i"))).alias("source_url"))


def insert_new(catalog: DataFrame, seeds: DataFrame) -> DataFrame:
    """A10: the catalogue with the seeds that it does not know, as pending rows; a seed that repeats is added once."""
    new = seeds.groupBy("video_id").agg(F.min("source_url").alias("source_url")).join(catalog.select("video_id"), "video_id", "left_anti")
    return catalog.unionByName(new.withColumn("status", F.lit("pending")), allowMissingColumns=True)
