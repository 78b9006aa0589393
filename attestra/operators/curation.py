"""Curation of entities: overrides, merge clusters, proposals, audit samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.reasoning import ensure_checkpoints

# Titles before names, and words before nouns.
TITLES = r"^(?:(?:dr\.|dr|mr\.|mr|mrs\.|mrs|ms\.|ms|sir|dame|lord|lady|professor|prof\.|prof|rev\.|reverend|father|saint|st\.|st)\s+)+"
DETERMINERS = r"^(?:(?:the|a|an)\s+)+"
#: Labels whose texts hold each other by chance.
NO_SUBSTRINGS = ("date_time", "quantity")
#: Labels whose short forms name one of a document's longer forms.
SHORTENED = ("person", "organization", "group_or_movement", "location", "facility", "event")


def label_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def norm_of(key: Column) -> Column:
    return F.substring(key, F.instr(key, ":") + 1, F.length(key))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("~~", F.least(a, b), F.greatest(a, b))


def compiled(merges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(source, target) of merges (source, target), target null for the deleted (entity_id): a deletion overwrites a merge."""
    gone = deleted.select(F.col("entity_id").alias("source")).distinct()
    return merges.select("source", "target").join(gone, "source", "left_anti").union(gone.withColumn("target", F.lit(None).cast("string")))


def resolve_in_documents(rows: DataFrame, document_merges: DataFrame, closed: DataFrame, deleted: DataFrame, column: str = "entity_id") -> DataFrame:
    """Keys resolved by their document's own merges (video_id, source, target) first, then by the corpus' closed chains; the deleted go."""
    own = document_merges.select("video_id", F.col("source").alias(column), F.col("target").alias("_own"))
    out = rows.join(own, ["video_id", column], "left").withColumn(column, F.coalesce("_own", column)).drop("_own")
    out = out.join(closed.select(F.col("source").alias(column), F.col("final").alias("_final")), column, "left").withColumn(column, F.coalesce("_final", column)).drop("_final")
    return out.join(deleted.select(F.col("entity_id").alias(column)), column, "left_anti")


def displayed(entities: DataFrame, display: DataFrame) -> DataFrame:
    """Entities with the names that operators gave (entity_id, name) in place of their canonical ones."""
    return entities.join(display.select("entity_id", F.col("name").alias("_n")), "entity_id", "left").withColumn("canonical", F.coalesce("_n", "canonical")).drop("_n")


def without_deleted_relations(rel: DataFrame, deleted: DataFrame) -> DataFrame:
    """Relations but those that an operator deleted in their document: (transcript_id, subject_id, predicate, object_id, time), time floored."""
    gone = deleted.select("transcript_id", "subject_id", "predicate", "object_id", F.floor("time").alias("_t"))
    return rel.withColumn("_t", F.floor("time_start")).join(gone, ["transcript_id", "subject_id", "predicate", "object_id", "_t"], "left_anti").drop("_t")


def corpus(named: DataFrame) -> DataFrame:
    """(entity_id, label, norm, canonical, total, documents) of mentions (video_id, label, canonical); the longest canonical, ties the greatest."""
    norm = F.regexp_replace(F.trim(F.lower("canonical")), r"\s+", " ")
    k = named.select("video_id", "label", "canonical", norm.alias("norm"), F.concat_ws(":", "label", norm).alias("entity_id"))
    return k.groupBy("entity_id", "label", "norm").agg(F.max(F.struct(F.length("canonical"), "canonical"))["canonical"].alias("canonical"), F.count(F.lit(1)).alias("total"), F.count_distinct("video_id").alias("documents"))


def rarest_part(short: DataFrame, long: DataFrame, on: list[str], name: str, parts: str) -> tuple[DataFrame, DataFrame]:
    """(short names, index of long names), both with _g: what holds a short name has its rarest part, so names meet on that alone.

    parts: the column of both with a name's parts. Of a short name's parts the one is taken that the
    fewest long names of the same `on` have; one that none has leaves it without partners.
    """
    index = long.withColumn("_g", F.explode(F.array_distinct(parts))).drop(parts)
    counts = index.groupBy(*on, "_g").agg(F.count(F.lit(1)).alias("_c"))
    of = short.select(*on, name, F.explode(F.array_distinct(parts)).alias("_g")).distinct().join(counts, [*on, "_g"], "left")
    rare = of.groupBy(*on, name).agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "_g"))["_g"].alias("_g"))
    return short.drop(parts).join(rare, [*on, name]), index


def _grams(norm: str) -> Column:
    """The runs of three characters of a name that is not shorter."""
    return F.transform(F.sequence(F.lit(1), F.length(norm) - 2), lambda i: F.substring(F.col(norm), i, F.lit(3)))


def substring_pairs(named: DataFrame, not_same: DataFrame) -> DataFrame:
    """(shorter, longer, together): entities of a label that share a document and of which one's name holds the other's.

    Pairs are made within documents, never within a label, where the longer name has the shorter
    one's rarest run of three characters. Names of two characters or fewer, labels
    of NO_SUBSTRINGS and pairs marked as not the same (a, b) are left out.
    """
    norm = F.regexp_replace(F.trim(F.lower("canonical")), r"\s+", " ")
    k = named.where(~F.col("label").isin(list(NO_SUBSTRINGS))).select("video_id", "label", norm.alias("norm")).distinct().where(F.length("norm") > 2).withColumn("_p", _grams("norm"))
    short, index = rarest_part(k.withColumnRenamed("norm", "s"), k, ["video_id", "label"], "s", "_p")
    p = short.join(index, ["video_id", "label", "_g"]).where((F.length("s") < F.length("norm")) & F.contains("norm", "s"))
    p = p.groupBy(F.concat_ws(":", "label", "s").alias("shorter"), F.concat_ws(":", "label", "norm").alias("longer")).agg(F.count(F.lit(1)).alias("together"))
    apart = not_same.select(pair_key(F.col("a"), F.col("b")).alias("_p"))
    return p.withColumn("_p", pair_key(F.col("shorter"), F.col("longer"))).join(apart, "_p", "left_anti").drop("_p")


def connected(pairs: DataFrame, a: str = "shorter", b: str = "longer") -> DataFrame:
    """(entity_id, root): the least key of each connected component, by rounds of least neighbours with a jump, each round checkpointed."""
    ensure_checkpoints(pairs.sparkSession)
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).union(pairs.select(b, a)).distinct().checkpoint()
    roots = ends.select(F.col("u").alias("entity_id"), F.col("u").alias("root")).distinct().checkpoint()
    while True:
        near = ends.join(roots.select(F.col("entity_id").alias("v"), "root"), "v").groupBy(F.col("u").alias("entity_id")).agg(F.min("root").alias("_n"))
        step = roots.join(near, "entity_id", "left").select("entity_id", F.least("root", F.coalesce("_n", "root")).alias("root"), F.col("root").alias("_old"))
        jump = step.select(F.col("entity_id").alias("root"), F.col("root").alias("_j"))
        after = step.join(jump, "root", "left").select("entity_id", F.least("root", F.coalesce("_j", "root")).alias("root"), "_old").checkpoint()
        moved = after.where("root <> _old").limit(1).count()
        roots = after.drop("_old")
        if not moved:
            return roots


def merge_clusters(named: DataFrame, not_same: DataFrame) -> DataFrame:
    """(cluster, canonical_key, members, together): connected substring pairs; the longest name stands for a cluster.

    cluster is its identity, the sorted members joined.
    """
    pairs = substring_pairs(named, not_same)
    roots = connected(pairs)
    names = roots.join(corpus(named).select("entity_id", "canonical"), "entity_id")
    met = pairs.join(roots.withColumnRenamed("entity_id", "shorter"), "shorter").groupBy("root").agg(F.sum("together").alias("together"))
    per = names.groupBy("root").agg(F.array_sort(F.collect_set("entity_id")).alias("members"), F.max(F.struct(F.length("canonical"), "entity_id"))["entity_id"].alias("canonical_key"))
    return per.join(met, "root").select(F.array_join("members", "||").alias("cluster"), "canonical_key", "members", "together")


def cluster_status(clusters: DataFrame, merges: DataFrame, not_same: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(cluster, status): dismissed by its identity, resolved when every member is merged, apart or canonical, else pending."""
    m = clusters.select("cluster", "canonical_key", F.explode("members").alias("member"))
    m = m.join(merges.select(F.col("source").alias("member"), F.lit(True).alias("_m")).distinct(), "member", "left")
    apart = not_same.select(pair_key(F.col("a"), F.col("b")).alias("_p"), F.lit(True).alias("_a")).distinct()
    m = m.withColumn("_p", pair_key(F.col("member"), F.col("canonical_key"))).join(apart, "_p", "left")
    settled = (F.col("member") == F.col("canonical_key")) | F.coalesce("_m", "_a", F.lit(False))
    per = m.groupBy("cluster").agg(F.bool_and(settled).alias("settled"))
    gone = dismissed.select("cluster", F.lit(True).alias("_d")).distinct()
    return per.join(gone, "cluster", "left").select("cluster", F.when(F.col("_d"), "dismissed").when(F.col("settled"), "resolved").otherwise("pending").alias("status"))


def reviewed(clusters: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges, not_same) of a review: checked members (cluster, member) merge into the canonical, the others are marked apart."""
    m = clusters.select("cluster", "canonical_key", F.explode("members").alias("member")).where("member <> canonical_key")
    m = m.join(checked.select("cluster", "member", F.lit(True).alias("_c")).distinct(), ["cluster", "member"], "left")
    return m.where("_c").select(F.col("member").alias("source"), F.col("canonical_key").alias("target")), m.where("_c is null").select(F.least("member", "canonical_key").alias("a"), F.greatest("member", "canonical_key").alias("b"))


def committed_deletions(entities: DataFrame, merges: DataFrame, deleted: DataFrame, labels: list[str], listed: DataFrame) -> DataFrame:
    """(entity_id, source, outcome): corpus keys of whole labels, then a committed list (entity_id); handled keys are skipped.

    source is label or list; a key of both counts under its label first and is skipped in the list.
    """
    handled = deleted.select("entity_id").union(merges.select("source")).distinct().withColumn("_h", F.lit(True))
    whole = entities.where(label_of(F.col("entity_id")).isin(labels)).select("entity_id").distinct()
    first = whole.join(handled, "entity_id", "left").select("entity_id", F.lit("label").alias("source"), F.when(F.col("_h"), "skipped").otherwise("applied").alias("outcome"))
    then = listed.select("entity_id").distinct().join(handled, "entity_id", "left").join(whole.withColumn("_w", F.lit(True)), "entity_id", "left")
    return first.union(then.select("entity_id", F.lit("list"), F.when(F.coalesce("_h", "_w", F.lit(False)), "skipped").otherwise("applied")))


def committed_promotions(listed: DataFrame, entities: DataFrame, merges: DataFrame, deleted: DataFrame, not_same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promotions with outcome, merges after): both ends known, none deleted, not merged, not apart; merges of deleted keys are purged."""
    known, gone, merged = entities.select("entity_id"), deleted.select("entity_id"), merges.select(F.col("source").alias("entity_id"))

    def flag(df: DataFrame, side: str, name: str) -> DataFrame:
        return df.select(F.col("entity_id").alias(side), F.lit(True).alias(name)).distinct()

    j = listed.select("source", "target").distinct()
    for side in ("source", "target"):
        j = j.join(flag(known, side, f"_k_{side}"), side, "left").join(flag(gone, side, f"_g_{side}"), side, "left")
    j = j.join(flag(merged, "source", "_m"), "source", "left").withColumn("_p", pair_key(F.col("source"), F.col("target")))
    j = j.join(not_same.select(pair_key(F.col("a"), F.col("b")).alias("_p"), F.lit(True).alias("_a")).distinct(), "_p", "left")
    good = F.coalesce(F.col("_k_source") & F.col("_k_target"), F.lit(False)) & F.col("_g_source").isNull() & F.col("_g_target").isNull() & F.col("_m").isNull() & F.col("_a").isNull()
    # of several promotions of one key the first is applied, the others find it merged
    rank = F.row_number().over(Window.partitionBy("source", F.when(good, 1)).orderBy("target"))
    out = j.withColumn("outcome", F.when(good & (rank == 1), "applied").otherwise("skipped")).select("source", "target", "outcome")
    after = merges.select("source", "target").union(out.where("outcome = 'applied'").select("source", "target")).join(gone.withColumnRenamed("entity_id", "source"), "source", "left_anti")
    return out, after


def shortened(named: DataFrame, handled: DataFrame, document_merges: DataFrame, not_same: DataFrame, common: list[str], least: int = 2) -> DataFrame:
    """(video_id, source, target, outcome) of each document's short forms: a run of tokens of exactly one longer form.

    Only the labels of SHORTENED; tokens of three characters or more; a target is said least times
    and does not begin with "the". outcome is proposed or why not: label, handled, short, common,
    ambiguous, not-same, target-handled; forms without a target are left out. handled: entity_id
    of merged and deleted keys.
    """
    norm = F.regexp_replace(F.trim(F.lower("canonical")), r"\s+", " ")
    e = named.groupBy("video_id", "label", norm.alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    e = e.withColumn("key", F.concat_ws(":", "label", "norm")).withColumn("toks", F.array_remove(F.split("norm", "[^a-z0-9]+"), ""))
    done = handled.select(F.col("entity_id").alias("key"), F.lit(True).alias("_h")).distinct()
    e = e.join(done, "key", "left").join(document_merges.select("video_id", F.col("source").alias("key"), F.lit(True).alias("_d")).distinct(), ["video_id", "key"], "left")
    first = F.get("toks", F.lit(0))
    why = F.when(~F.col("label").isin(list(SHORTENED)), "label").when(F.coalesce("_h", "_d", F.lit(False)), "handled").when((F.size("toks") == 0) | F.exists("toks", lambda t: F.length(t) < 3), "short").when((F.size("toks") == 1) & first.isin(common), "common")
    e = e.withColumn("why", why).withColumn("_in", F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" ")))
    y = e.where((F.col("n") >= least) & (first != "the")).select("video_id", "label", F.col("key").alias("target"), F.col("_in").alias("_yin"), F.col("_h").alias("_yh"), "toks")
    short, index = rarest_part(e.where("why is null").select("video_id", "label", "key", "_in", "toks"), y, ["video_id", "label"], "key", "toks")
    p = short.join(index, ["video_id", "label", "_g"]).where((F.col("key") != F.col("target")) & F.contains("_yin", "_in"))
    p = p.groupBy("video_id", F.col("key").alias("source")).agg(F.count(F.lit(1)).alias("m"), F.min("target").alias("target"), F.bool_or(F.coalesce("_yh", F.lit(False))).alias("_yh"))
    apart = not_same.select(pair_key(F.col("a"), F.col("b")).alias("_p"), F.lit(True).alias("_a")).distinct()
    p = p.withColumn("_p", pair_key(F.col("source"), F.col("target"))).join(apart, "_p", "left")
    out = F.when(F.col("m") > 1, "ambiguous").when(F.col("_a"), "not-same").when(F.col("_yh"), "target-handled").otherwise("proposed")
    found = p.select("video_id", "source", F.when(F.col("m") == 1, F.col("target")).alias("target"), out.alias("outcome"))
    return found.union(e.where("why is not null").select("video_id", "key", F.lit(None).cast("string"), "why"))


def bracketed(entities: DataFrame, handled: DataFrame) -> DataFrame:
    """Entities that are marks of the transcript, such as [music], and not handled yet."""
    mark = F.contains("norm", F.lit("[music]")) | F.col("canonical").rlike(r"^\[.+\]$")
    return entities.where(mark).join(handled.select("entity_id"), "entity_id", "left_anti")


def normal_form(canonical: Column, label: Column) -> Column:
    """Lower case, without titles (of persons), determiners, a final possessive and punctuation but hyphens."""
    s = F.trim(F.lower(canonical))
    s = F.when(label == "person", F.regexp_replace(s, TITLES, "")).otherwise(s)
    s = F.regexp_replace(s, DETERMINERS, "")
    s = F.regexp_replace(F.regexp_replace(s, "'s$", ""), r"[^\p{L}\p{N}\s-]", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normal_form_merges(entities: DataFrame, not_same: DataFrame) -> DataFrame:
    """(source, target): entities of a label and normal form into the most mentioned of them; pairs marked apart stay."""
    e = entities.withColumn("nk", normal_form(F.col("canonical"), F.col("label"))).where(F.length("nk") >= 2)
    best = e.groupBy("label", "nk").agg(F.max_by("entity_id", F.struct("total", "entity_id")).alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    p = e.join(best, ["label", "nk"]).where("entity_id <> target").select(F.col("entity_id").alias("source"), "target")
    apart = not_same.select(pair_key(F.col("a"), F.col("b")).alias("_p"))
    return p.withColumn("_p", pair_key(F.col("source"), F.col("target"))).join(apart, "_p", "left_anti").drop("_p")


def applied_proposals(proposals: DataFrame, entities: DataFrame, merges: DataFrame, deleted: DataFrame, document_merges: DataFrame, not_same: DataFrame) -> DataFrame:
    """Proposals (seq, verdict, video_id, source, target) with reason, null where they are applied, "info" for KEEP and DEFER.

    Verdicts are DELETE-GLOBAL (of source), MERGE-INTO and PER-VIDEO-MERGE. Guards look at the state
    and at the proposals before in seq: a key is deleted once and merged once (in a document once).
    """
    known, gone, merged = entities.select("entity_id").distinct(), deleted.select("entity_id").distinct(), merges.select("source").distinct()

    def flag(df: DataFrame, column: str, to: str, name: str) -> DataFrame:
        return df.select(F.col(column).alias(to), F.lit(True).alias(name))

    j = proposals
    for side in ("source", "target"):
        j = j.join(flag(known, "entity_id", side, f"_k_{side}"), side, "left").join(flag(gone, "entity_id", side, f"_g_{side}"), side, "left")
    j = j.join(flag(merged, "source", "source", "_m"), "source", "left").join(document_merges.select("video_id", "source", F.lit(True).alias("_v")).distinct(), ["video_id", "source"], "left")
    j = j.withColumn("_p", pair_key(F.col("source"), F.col("target"))).join(not_same.select(pair_key(F.col("a"), F.col("b")).alias("_p"), F.lit(True).alias("_a")).distinct(), "_p", "left")
    delete, merge, local = (F.col("verdict") == v for v in ("DELETE-GLOBAL", "MERGE-INTO", "PER-VIDEO-MERGE"))
    fresh = delete & F.col("_k_source") & F.col("_g_source").isNull()
    deletes = j.where(fresh).groupBy("source").agg(F.min("seq").alias("_at"))
    for side in ("source", "target"):
        j = j.join(deletes.select(F.col("source").alias(side), F.col("_at").alias(f"_at_{side}")), side, "left")
    dead = F.coalesce(F.col("_g_source") | (F.col("_at_source") < F.col("seq")), F.col("_at_source") < F.col("seq"), F.col("_g_source"), F.lit(False))
    dead_target = F.coalesce(F.col("_g_target") | (F.col("_at_target") < F.col("seq")), F.col("_at_target") < F.col("seq"), F.col("_g_target"), F.lit(False))
    common = F.when(F.col("source").isNull() | F.col("target").isNull() | (local & F.col("video_id").isNull()), "missing fields").when(F.col("source") == F.col("target"), "source is target").when(F.col("_k_source").isNull() | F.col("_k_target").isNull(), "endpoint not in corpus").when(dead | dead_target, "endpoint already deleted")
    guard = F.when(delete, F.when(F.col("source").isNull(), "missing key").when(F.col("_k_source").isNull(), "not in corpus").when(F.col("_g_source").isNotNull() | (F.col("seq") > F.col("_at_source")), "already deleted"))
    guard = guard.when(merge, F.coalesce(common, F.when(F.col("_m"), "already merged"), F.when(F.col("_a"), "marked not the same")))
    guard = guard.when(local, F.coalesce(common, F.when(F.col("_v"), "already merged in document"), F.when(F.col("_a"), "marked not the same")))
    guard = guard.when(F.col("verdict").isin("KEEP", "DEFER"), "info").otherwise(F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit(""))))
    j = j.withColumn("reason", guard)
    # the first merge of a key that passes is applied, later ones find it merged
    place = F.row_number().over(Window.partitionBy("verdict", "source", F.when(local, F.col("video_id")), F.col("reason").isNull()).orderBy("seq"))
    late = F.col("reason").isNull() & ~delete & (place > 1)
    return j.select("seq", "verdict", "video_id", "source", "target", F.when(late & merge, "already merged").when(late, "already merged in document").otherwise(F.col("reason")).alias("reason"))


def token_neighbours(entities: DataFrame, limit: int = 8) -> DataFrame:
    """(entity_id, other, overlap, total, rank): entities of the label that share most tokens, then the most mentioned."""
    t = entities.select("entity_id", "label", "total", F.explode(F.array_distinct(F.array_remove(F.split("norm", "[^a-z0-9]+"), ""))).alias("tok"))
    o = t.select("label", "tok", F.col("entity_id").alias("other"), F.col("total").alias("other_total"))
    p = t.join(o, ["label", "tok"]).where("entity_id <> other").groupBy("entity_id", "other", F.col("other_total").alias("total")).agg(F.count(F.lit(1)).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("overlap"), F.desc("total"), "other"))
    return p.withColumn("rank", rank).where(F.col("rank") <= limit).select("entity_id", "other", "overlap", "total", "rank")


def context_samples(mentions: DataFrame, limit: int = 5, per_document: int = 2) -> DataFrame:
    """(entity_id, place, video_id, start) of mentions (entity_id, video_id, start): one of every document first, from those that say it most."""
    w = Window.partitionBy("entity_id", "video_id")
    m = mentions.withColumn("round", F.row_number().over(w.orderBy("start"))).where(F.col("round") <= per_document)
    n = mentions.groupBy("entity_id", "video_id").agg(F.count(F.lit(1)).alias("said"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("round", F.desc("said"), "video_id"))
    return m.join(n, ["entity_id", "video_id"]).withColumn("place", place).where(F.col("place") <= limit).select("entity_id", "place", "video_id", "start")


def ambiguous_names(entities: DataFrame, labels: tuple[str, ...] = ("person",), least: int = 1, limit: int = 10) -> DataFrame:
    """(entity_id, candidate, total, rank): names of one token of three characters or more, and the longer names of the label that hold it."""
    e = entities.where(F.col("label").isin(list(labels))).withColumn("toks", F.array_remove(F.split("norm", "[^a-z0-9]+"), ""))
    one = e.where((F.size("toks") == 1) & (F.length(F.get("toks", F.lit(0))) >= 3)).select("entity_id", "label", F.get("toks", F.lit(0)).alias("tok"))
    many = e.where(F.size("toks") > 1).select("label", F.explode(F.array_distinct("toks")).alias("tok"), F.col("entity_id").alias("candidate"), "total")
    w = Window.partitionBy("entity_id")
    p = one.join(many, ["label", "tok"]).where("entity_id <> candidate").withColumn("rank", F.row_number().over(w.orderBy(F.desc("total"), "candidate")))
    enough = p.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("entity_id")
    return p.where(F.col("rank") <= limit).join(enough, "entity_id", "left_semi").select("entity_id", "candidate", "total", "rank")


def documents_to_review(named: DataFrame, eligible: DataFrame, pool: int = 50) -> DataFrame:
    """The documents with most entities of eligible (entity_id), at most pool of them."""
    norm = F.regexp_replace(F.trim(F.lower("canonical")), r"\s+", " ")
    k = named.select("video_id", F.concat_ws(":", "label", norm).alias("entity_id")).distinct().join(eligible.select("entity_id").distinct(), "entity_id", "left_semi")
    return k.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "video_id").limit(pool)


def remaining(entities: DataFrame, status: DataFrame, limit: int = 30) -> DataFrame:
    """Per label the most mentioned entities that are still active."""
    e = entities.join(status.where("status = 'active'").select("entity_id"), "entity_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("total"), "entity_id"))
    return e.withColumn("rank", rank).where(F.col("rank") <= limit).select("label", "rank", "entity_id", "total", "documents")


def folded_patches(log: DataFrame, key: list[str], fields: list[str], order: str = "seq") -> DataFrame:
    """A log of patches (key, op, fields, order) to one row per key: each field's last value that is set, after the last removal.

    A key whose fields are all empty has no row. Adding a row twice changes nothing.
    """
    w = Window.partitionBy(*key)
    cut = F.coalesce(F.max(F.when(F.col("op") == "remove", F.col(order))).over(w), F.lit(-1))
    live = log.withColumn("_cut", cut).where((F.col(order) > F.col("_cut")) & (F.col("op") != "remove"))
    per = live.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])
    return per.where(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull())


def in_range(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) by whether a truth lies within 0 and 1."""
    ok = F.coalesce(F.col(column).between(0, 1), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def ordered_section(rows: DataFrame, by: list[str]) -> DataFrame:
    """An override section in its stable order, in one sorted run of files."""
    return rows.orderBy(*by)


def autocomplete(entities: DataFrame, marked: DataFrame, q: str = "", label: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose canonical holds q, of a label, without those marked by a sentinel, the most mentioned first."""
    e = entities.where(F.contains(F.lower("canonical"), F.lit(q.lower().strip())))
    e = e.where(F.col("label") == label) if label else e
    return e.join(marked.select("entity_id"), "entity_id", "left_anti").orderBy(F.desc("total"), "entity_id").limit(limit)


def calibration_bundle(sections: dict[str, DataFrame], verdicts: DataFrame, limit: int = 50) -> DataFrame:
    """(section, row): the first rows of each section as JSON, and of the verdicts those by operators."""
    out = verdicts.where("by = 'operator'").select(F.lit("verdicts").alias("section"), F.to_json(F.struct("*")).alias("row"))
    for name, rows in sections.items():
        out = out.union(rows.orderBy(*rows.columns).limit(limit).select(F.lit(name), F.to_json(F.struct("*"))))
    return out


def audit_log(entries: DataFrame, newest: int = 500, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest entries of the log, newest first; ties by the later columns of the order."""
    return entries.orderBy(*[F.desc(c) for c in order]).limit(newest)
