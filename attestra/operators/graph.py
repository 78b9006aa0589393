"""Entity graph: nodes, edges, upserts, searches, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Labels that a predicate's subject and object may have; other predicates take any.
PERSON_OR_GROUP = ["person", "organization", "group_or_movement"]
GROUP = ["organization", "group_or_movement"]
PLACE = ["location", "facility"]
PLACE_OR_TIME = ["location", "facility", "date_time"]
ANY_LABEL = ["person", "organization", "location", "facility", "event", "work_of_media", "technology", "date_time", "quantity", "nationality_or_ethnicity", "group_or_movement", "ideology", "role", "law_or_policy", "time_of_day", "specific_date_time", "specific_week"]
ARGUMENTS = {
    "located_in": (["person", "organization", "location", "facility", "event", "group_or_movement"], PLACE),
    "member_of": (["person", "organization"], GROUP),
    "part_of": (["organization", "location", "facility", "work_of_media", "technology", "group_or_movement"], ["organization", "location", "facility", "work_of_media", "technology", "event", "group_or_movement"]),
    "authored": (PERSON_OR_GROUP, ["work_of_media"]),
    "published": (PERSON_OR_GROUP, ["work_of_media"]),
    "founded": (["person", "organization"], ["organization", "group_or_movement", "facility"]),
    "works_for": (["person"], GROUP),
    "led_by": (["organization", "group_or_movement", "event"], ["person"]),
    "born_in": (["person"], PLACE_OR_TIME),
    "died_in": (["person"], PLACE_OR_TIME),
    "operates_in": (["person", "organization", "facility"], PLACE),
    "met_with": (PERSON_OR_GROUP, PERSON_OR_GROUP),
    "allied_with": (PERSON_OR_GROUP, PERSON_OR_GROUP),
    "opposed_by": (ANY_LABEL, PERSON_OR_GROUP),
    "funded_by": (ANY_LABEL, PERSON_OR_GROUP),
    "investigated_by": (ANY_LABEL, PERSON_OR_GROUP),
    "prosecuted_by": (PERSON_OR_GROUP, PERSON_OR_GROUP),
    "convicted_of": (["person"], ["event", "role"]),
    "created": (PERSON_OR_GROUP, ["work_of_media", "technology", "organization", "facility"]),
    "occurred_on": (["event"], ["date_time", "specific_date_time", "specific_week", "time_of_day"]),
}


def type_checked(rel: DataFrame) -> DataFrame:
    """relations whose argument labels (read from the ids) suit the predicate; ids without a label suit all."""
    subject, object_ = (F.when(F.instr(c, ":") > 1, F.substring_index(c, ":", 1)) for c in ("subject_id", "object_id"))
    ok = F.lit(True)
    for name, (subjects, objects) in ARGUMENTS.items():
        ok = F.when(F.col("predicate") == name, subject.isNull() | object_.isNull() | (subject.isin(subjects) & object_.isin(objects))).otherwise(ok)
    return rel.where(ok)


def upsert(rel: DataFrame, order: str | None = None) -> DataFrame:
    """one row per rel_id: highest confidence; provenance "both" where sources differ.

    Subject, predicate, object and span are in the rel_id and so the same in all its rows. The truth
    is that of the first row by the order column, the one stored before, null or not; without an
    order, that of the surest row, ties by the greater truth.
    """
    kept = [F.first(c).alias(c) for c in ("subject_id", "predicate", "object_id", "transcript_id", "char_start", "char_end", "time_start")]
    stored = F.min_by(F.struct("direct_truth"), order)["direct_truth"].alias("direct_truth") if order else None
    truth = F.max(F.struct("confidence", F.col("direct_truth").isNotNull(), "direct_truth"))["direct_truth"].alias("direct_truth")
    provenance = F.when(F.min("provenance") != F.max("provenance"), "both").otherwise(F.min("provenance")).alias("provenance")
    return rel.groupBy("rel_id").agg(*kept, truth if stored is None else stored, F.max("confidence").alias("confidence"), provenance)


def nodes(rel: DataFrame) -> DataFrame:
    """entities weighted by incident relation rows."""
    return rel.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("weight"))


def edges(rel: DataFrame) -> DataFrame:
    """relation rows per (subject, predicate, object)."""
    return rel.groupBy("subject_id", "predicate", "object_id").agg(F.count(F.lit(1)).alias("n"))


def search(nodes_: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Exact 100, prefix 50, contains 10, plus weight; ties by id."""
    name = F.lower(F.substring_index("entity_id", ":", -1))
    base = F.when(name == q, 100).when(name.startswith(q), 50).when(name.contains(q), 10)
    return nodes_.withColumn("score", base + F.col("weight")).where("score is not null").orderBy(F.desc("score"), "entity_id").limit(limit)


def search_by_position(nodes_: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """By where the text stands, then weight, then id."""
    at = F.instr(F.lower("entity_id"), q)
    return nodes_.withColumn("position", at).where("position > 0").orderBy("position", F.desc("weight"), "entity_id").limit(limit)


def by_role(rel: DataFrame, entity: str, role: str = "either", predicate: str | None = None) -> DataFrame:
    """Relations in which an entity is subject or object."""
    hit = {"subject": F.col("subject_id") == entity, "object": F.col("object_id") == entity}
    out = rel.where(hit["subject"] | hit["object"] if role == "either" else hit[role])
    return out.where(F.col("predicate") == predicate) if predicate else out


def neighbours(edges_: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges_.select(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("other"), "predicate", "n").unionByName(edges_.select(F.col("object_id").alias("entity_id"), F.col("subject_id").alias("other"), "predicate", "n"))


def neighbour_page(edges_: DataFrame, nodes_: DataFrame, per: int = 5, offset: int = 0) -> DataFrame:
    """Distinct neighbours of every entity, heaviest first, with their total."""
    pairs = neighbours(edges_).select("entity_id", "other").distinct().join(nodes_.select(F.col("entity_id").alias("other"), "weight"), "other")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("weight"), "other"))
    ranked = pairs.withColumn("rank", rank).where(F.col("rank") <= offset + per).where(F.col("rank") > offset)  # the first lets Spark cut ranks before rows move
    total = pairs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(total, "entity_id").select("entity_id", "other", "weight", "rank", "total")


def within(edges_: DataFrame, set_: DataFrame) -> DataFrame:
    """Edges with both ends in a set of entity_id."""
    s, o = set_.select(F.col("entity_id").alias("subject_id")), set_.select(F.col("entity_id").alias("object_id"))
    return edges_.join(s, "subject_id", "left_semi").join(o, "object_id", "left_semi")


def undirected(edges_: DataFrame) -> DataFrame:
    """Counts of both directions together."""
    return edges_.groupBy(F.least("subject_id", "object_id").alias("lo"), "predicate", F.greatest("subject_id", "object_id").alias("hi")).agg(F.sum("n").alias("n"))


def by_predicate(rel: DataFrame) -> DataFrame:
    """Of every subject and predicate, the counterparts and their number."""
    return rel.groupBy("subject_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("object_id")), ",").alias("objects"))


def conflicts(rel: DataFrame) -> DataFrame:
    """H6: pairs of the same edge whose truths lie on both sides of 0.5."""
    t = rel.where("direct_truth is not null").select("subject_id", "predicate", "object_id", "rel_id", "direct_truth").distinct()
    a, b = t.alias("a"), t.alias("b")
    same = (F.col("a.subject_id") == F.col("b.subject_id")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.object_id") == F.col("b.object_id"))
    apart = (F.col("a.direct_truth") >= 0.5) & (F.col("b.direct_truth") < 0.5)
    return a.join(b, same & apart).select(F.col("a.rel_id").alias("true_rel"), F.col("b.rel_id").alias("false_rel"), F.col("a.direct_truth").alias("true_value"), F.col("b.direct_truth").alias("false_value"))


# Predicates that exclude each other.
EXCLUSIVE = [("accused_of", "denies"), ("allied_with", "opposed_by"), ("endorses", "denies")]


def exclusive(rel: DataFrame, floor: float = 0.5) -> DataFrame:
    """H7: both of two excluding predicates held between the same entities; the first of each."""
    t = rel.where(F.col("direct_truth") >= floor).groupBy("subject_id", "object_id", "predicate").agg(F.min("rel_id").alias("rel"))
    found = None
    for p, q in EXCLUSIVE:
        one = t.where(F.col("predicate") == p).select("subject_id", "object_id", F.col("rel").alias("left_rel"))
        two = t.where(F.col("predicate") == q).select("subject_id", "object_id", F.col("rel").alias("right_rel"))
        pair = one.join(two, ["subject_id", "object_id"]).withColumn("predicates", F.lit(f"{p}/{q}"))
        found = pair if found is None else found.unionByName(pair)
    return found


def propagate_round(edges_: DataFrame, blend: float = 0.4, was: str | None = None) -> DataFrame:
    """H4, one synchronous round over (rel_id, subject_id, object_id, confidence, anchor, value).

    The neighbours of an edge are those that share an endpoint; their sums come from sums per
    endpoint and per pair of endpoints, less the edge itself, so no list of edge pairs is made. was names
    a column for the value before.
    """
    w = F.when(F.col("value").isNotNull(), F.col("confidence")).otherwise(0.0)
    v = edges_.select("rel_id", "subject_id", "object_id", "confidence", "anchor", "value").withColumn("w", w).withColumn("wv", w * F.coalesce("value", F.lit(0.0))).withColumn("k", (F.col("w") > 0).cast("long"))
    sums = [F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.sum("k").alias("k")]
    ends = v.select("w", "wv", "k", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("node")).groupBy("node").agg(*sums)
    # rows are dealt by their lesser end, which serves the sums of a pair of nodes and those of that end; then by the other
    rows = v.where("subject_id is not null and object_id is not null").withColumn("lo", F.least("subject_id", "object_id")).withColumn("hi", F.greatest("subject_id", "object_id"))
    pair = Window.partitionBy("lo", "hi")
    rows = rows.repartition("lo").withColumns({f"p{x}": F.sum(x).over(pair) for x in ("w", "wv", "k")})
    s = ends.select(F.col("node").alias("lo"), F.col("w").alias("sw"), F.col("wv").alias("swv"), F.col("k").alias("sk"))
    o = ends.select(F.col("node").alias("hi"), F.col("w").alias("ow"), F.col("wv").alias("owv"), F.col("k").alias("ok"))
    j = rows.join(s, "lo").join(o, "hi")
    loop = F.col("lo") == F.col("hi")
    nw = F.col("sw") + F.when(loop, 0.0).otherwise(F.col("ow") - F.col("pw")) - F.col("w")
    nwv = F.col("swv") + F.when(loop, 0.0).otherwise(F.col("owv") - F.col("pwv")) - F.col("wv")
    many = F.col("sk") + F.when(loop, 0).otherwise(F.col("ok") - F.col("pk")) - F.col("k")  # counted, as sums may not cancel to 0
    mean = F.when(many > 0, nwv / nw)
    nxt = F.when(F.col("anchor").isNotNull(), F.when(mean.isNotNull(), (1 - blend) * F.col("anchor") + blend * mean).otherwise(F.col("anchor"))).otherwise(mean)
    return j.select("rel_id", "subject_id", "object_id", "confidence", "anchor", nxt.alias("value"), *([F.col("value").alias(was)] if was else []))


def novel_links(rel: DataFrame, least: int = 2, limit: int = 50) -> DataFrame:
    """H10 without the confidence term: unlinked pairs by shared neighbours and shared transcripts."""
    ends = rel.select("subject_id", "object_id").distinct()
    near = ends.select(F.col("subject_id").alias("a"), F.col("object_id").alias("m")).union(ends.select(F.col("object_id").alias("a"), F.col("subject_id").alias("m"))).distinct()
    two = near.join(near.select(F.col("a").alias("b"), "m"), "m").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    known = ends.select(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b"))
    return two.where(F.col("shared") >= least).join(known, ["a", "b"], "left_anti").orderBy(F.desc("shared"), "a", "b").limit(limit)


def relation_lines(rel: DataFrame) -> DataFrame:
    """Relations with line, their reading: subject, predicate in words, object, provenance in brackets."""
    return rel.withColumn("line", F.format_string("%s %s %s [%s]", "subject_id", F.translate("predicate", "_", " "), "object_id", "provenance"))
