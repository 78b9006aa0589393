"""Mentions and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import PRONOUNS, clean_surface, entity_key


def usable(mentions: DataFrame, drop_labels: tuple[str, ...] = ("technology",)) -> DataFrame:
    """Add norm; drop labels that are not wanted, pronouns and surfaces under two characters."""
    out = mentions.withColumn("norm", clean_surface(F.col("surface")))
    return out.where(~F.col("label").isin(list(drop_labels)) & ~F.col("norm").isin(PRONOUNS) & (F.length("norm") >= 2))


def canonical(mentions: DataFrame) -> DataFrame:
    """Per (label, norm) the surface with the greatest length * 1000 + count; ties by surface."""
    per = mentions.groupBy("label", "norm", "surface").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label", "norm").orderBy(F.desc(F.length("surface") * 1000 + F.col("n")), "surface")
    return per.withColumn("r", F.row_number().over(w)).where("r = 1").select("label", "norm", F.col("surface").alias("canonical"))


def numbered(mentions: DataFrame) -> DataFrame:
    """m_0001, m_0002, ... within each document; from the 10,000th on with more digits."""
    w = Window.partitionBy("video_id").orderBy("ordinal")
    return mentions.withColumn("mention_id", F.format_string("m_%04d", F.row_number().over(w)))


def corpus_entities(mentions: DataFrame) -> DataFrame:
    """Per key mentions, documents and the longest surface (ties: the greatest)."""
    keyed = mentions.withColumn("entity_id", entity_key(F.col("label"), F.col("surface")))
    return keyed.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("video_id").alias("documents"), F.max(F.struct(F.length("surface"), F.col("surface")))["surface"].alias("canonical"))


def close_merges(merges: DataFrame, hops: int = 10) -> DataFrame:
    """(source, target) chains followed for up to hops steps; the table alone is joined to itself."""
    out = merges.select("source", F.col("target").alias("final"))
    step = merges.select(F.col("source").alias("final"), F.col("target").alias("further"))
    for _ in range(hops - 1):
        out = out.join(step, "final", "left").select("source", F.coalesce("further", "final").alias("final"))
    return out


def resolve(df: DataFrame, merges: DataFrame, deleted: DataFrame, column: str = "entity_id") -> DataFrame:
    """Replace keys by what they were merged into and drop the deleted."""
    out = df.join(merges.withColumnRenamed("source", column), column, "left").withColumn(column, F.coalesce("final", column)).drop("final")
    return out.join(deleted.select(F.col("entity_id").alias(column)), column, "left_anti")


def article_merges(entities: DataFrame) -> DataFrame:
    """E18: "the x" into "x" where both exist."""
    label, name = F.substring_index("entity_id", ":", 1), F.expr("substring(entity_id, instr(entity_id, ':') + 1)")
    the = entities.where(name.startswith("the ")).select(F.col("entity_id").alias("source"), F.concat(label, F.lit(":"), F.expr("substring(entity_id, instr(entity_id, ':') + 5)")).alias("target"))
    return the.join(entities.select(F.col("entity_id").alias("target")), "target", "left_semi").select("source", "target")


def prefix_merges(mentions: DataFrame, least: int = 4) -> DataFrame:
    """E17 on surfaces: within a document and label, a surface that begins exactly one longer one."""
    keys = mentions.select("video_id", "label", F.lower("surface").alias("s")).distinct()
    longer = keys.select("video_id", "label", F.col("s").alias("t"))
    pairs = keys.where(F.length("s") >= least).join(longer, ["video_id", "label"]).where(F.col("t").startswith(F.col("s")) & (F.length("t") > F.length("s")))
    w = Window.partitionBy("video_id", "label", "s")
    return pairs.withColumn("n", F.count(F.lit(1)).over(w)).where("n = 1").select("video_id", "label", F.col("s").alias("source"), F.col("t").alias("target"))


def tiers(entities: DataFrame, top: int = 5, wide: int = 5) -> DataFrame:
    """Per label the top entities by mentions, and those in many documents; ranks are cut before rows move."""
    w = Window.partitionBy(F.substring_index("entity_id", ":", 1)).orderBy(F.desc("mentions"), "entity_id")
    first = entities.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    first = first.select("entity_id", "mentions", "documents", F.lit("top").alias("tier"))
    many = entities.where(F.col("documents") >= wide).join(F.broadcast(first.select("entity_id")), "entity_id", "left_anti")  # top rows of each label
    return first.union(many.select("entity_id", "mentions", "documents", F.lit("wide")))


def audit_tiers(entities: DataFrame, top: int = 100, wide: int = 5, wide_limit: int = 500, rare: int = 5, rare_limit: int = 2000) -> DataFrame:
    """Per label three tiers by mentions: the top, those in many documents, and those with few mentions, each up to its limit.

    An entity is in every tier that it meets. Each tier ranks on its own, so that ranks are cut before rows move.
    """
    w = Window.partitionBy(F.substring_index("entity_id", ":", 1)).orderBy(F.desc("mentions"), "entity_id")

    def tier(name: str, rows: DataFrame, limit: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("entity_id", "mentions", "documents", F.lit(name).alias("tier"))

    return tier("top", entities, top).union(tier("wide", entities.where(F.col("documents") >= wide), wide_limit)).union(tier("rare", entities.where(F.col("mentions") <= rare), rare_limit))


def status(entities: DataFrame, merges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Active, merged or deleted."""
    j = entities.join(merges.select(F.col("source").alias("entity_id"), "final"), "entity_id", "left").join(deleted.select("entity_id", F.lit(True).alias("gone")), "entity_id", "left")
    return j.select("entity_id", F.when(F.col("gone"), "deleted").when(F.col("final").isNotNull(), "merged").otherwise("active").alias("status"))


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last writer of each key wins; removals drop it."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1 and op <> 'remove'").drop("_r")


def audit(entities_with_status: DataFrame) -> DataFrame:
    """Totals per label."""
    def n(s: str):
        return F.count_if(F.col("status") == s).alias(s)

    return entities_with_status.groupBy(F.substring_index("entity_id", ":", 1).alias("label")).agg(F.count(F.lit(1)).alias("total"), n("deleted"), n("merged"), n("active"))


def visible(mentions: DataFrame, hidden: list[str]) -> DataFrame:
    """Mentions whose label is not hidden; those without a label stay."""
    return mentions.where(~F.coalesce(F.col("label").isin(hidden), F.lit(False)))
