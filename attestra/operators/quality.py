"""Checks of claims (I1-I4, I18, I30-I41) and quality metrics (L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import PRONOUNS, subkind
from attestra.operators import claims as cl
from attestra.operators import reasoning as rs
from attestra.operators import sweeps as sw

# Kinds of claims, stances and dependencies.
KINDS = ["empirical", "historical", "speculative", "opinion", "definitional"]
STANCES = ["asserts", "denies", "uncertain", "steelman"]
DEPENDENCIES = ["supports", "contradicts", "presupposes", "elaborates"]


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def valid_keys(mentions: DataFrame, display: DataFrame, documents: DataFrame) -> DataFrame:
    """I4: (video_id, entity_id): the keys of a document's mentions, and those that operators gave a name to, in every document."""
    own = mentions.select("video_id", "entity_id").distinct()
    named = documents.select("video_id").distinct().crossJoin(F.broadcast(display.select("entity_id").distinct()))  # operators' names are few, by hand
    return own.union(named).distinct()


def claim_errors(claims: DataFrame, texts: DataFrame, keys: DataFrame, relations: DataFrame) -> DataFrame:
    """Claims with errors, the sorted codes of what is wrong with each.

    claims: claim_id, video_id, text, kind, stance, confidence, truth, rationale, entities,
    relationships, evidence (transcript_id, char_start, char_end, time_start, time_end, quote) and
    dependencies (target, kind). texts: (video_id, text), flattened. keys: (video_id, entity_id).
    relations: (video_id, rel_id). Keys, relations and targets are looked up by joins.
    """
    bad = claims.select("video_id", "claim_id", F.explode("entities").alias("entity_id")).where(F.contains("entity_id", F.lit(":"))).join(keys, ["video_id", "entity_id"], "left_anti").select("video_id", "claim_id", F.lit("entity-unknown").alias("e"))
    gone = claims.select("video_id", "claim_id", F.explode("relationships").alias("rel_id")).join(relations.select("video_id", "rel_id"), ["video_id", "rel_id"], "left_anti").select("video_id", "claim_id", F.lit("relation-unknown"))
    ids = claims.select("video_id", F.col("claim_id").alias("target")).distinct()
    lost = claims.select("video_id", "claim_id", F.explode("dependencies.target").alias("target")).join(ids, ["video_id", "target"], "left_anti").select("video_id", "claim_id", F.lit("dependency-target"))
    looked = bad.union(gone).union(lost).groupBy("video_id", "claim_id").agg(F.collect_set("e").alias("_looked"))
    # texts come last: a claim that has its document's text beside it is not moved any more
    c = claims.join(looked, ["video_id", "claim_id"], "left").join(texts.select("video_id", F.col("text").alias("_t"), F.length(F.coalesce("text", F.lit(""))).alias("_length")), "video_id", "left")
    length = F.coalesce("_length", F.lit(0))

    def evidence(e: Column) -> Column:
        span = (e["char_start"] < 0) | (e["char_end"] <= e["char_start"]) | (e["char_end"] > length)
        slice_ = F.substring(F.col("_t"), e["char_start"] + 1, e["char_end"] - e["char_start"])
        return F.array(
            F.when(~e["transcript_id"].eqNullSafe(F.col("video_id")), "evidence-document"),
            F.when(F.coalesce(span, F.lit(True)), "evidence-span").when(F.coalesce(e["quote"], F.lit("")) == "", "evidence-no-quote").when(slice_ != e["quote"], "evidence-quote"),
            F.when(~F.coalesce(span, F.lit(True)) & ~F.coalesce(e["time_end"] >= e["time_start"], F.lit(False)), "evidence-time"),
        )

    keyed = lambda test: F.exists("entities", test)
    own = F.array(
        F.when(~F.coalesce(F.col("claim_id").startswith(F.concat("video_id", F.lit(":"))), F.lit(False)), "id"), F.when(blank("text"), "text"), F.when(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), "kind"),
        F.when(keyed(lambda k: ~F.contains(k, F.lit(":"))), "entity-malformed"), F.when(keyed(lambda k: F.trim(F.lower(F.split_part(k, F.lit(":"), F.lit(2)))).isin(PRONOUNS)), "entity-pronoun"),
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "evidence-none"), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"), F.when(~F.col("truth").between(0, 1), "truth"), F.when(blank("rationale"), "rationale"),
        F.when(F.exists("dependencies", lambda x: ~F.coalesce(x["kind"].isin(DEPENDENCIES), F.lit(False))), "dependency-kind"), F.when(F.exists("dependencies", lambda x: x["target"] == F.col("claim_id")), "dependency-self"),
        F.when(~F.col("stance").isin(STANCES), "stance"),
    )
    all_ = F.concat(own, F.coalesce(F.flatten(F.transform("evidence", evidence)), F.array().cast("array<string>")), F.coalesce("_looked", F.array().cast("array<string>")))
    return c.withColumn("errors", F.array_sort(F.array_distinct(F.array_compact(all_)))).drop("_t", "_length", "_looked")


def payload_errors(claims: DataFrame, payloads: DataFrame, versions: tuple[str, ...] = ("v1", "v2")) -> DataFrame:
    """(video_id, error) of documents: ids that repeat, versions that are unknown."""
    twice = claims.groupBy("video_id", "claim_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("video_id", F.lit("duplicate-id").alias("error")).distinct()
    odd = payloads.where(~F.coalesce(F.col("version").isin(list(versions)), F.lit(False))).select("video_id", F.lit("version")).distinct()
    return twice.union(odd)


def accepted_claims(checked: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, rejects): a document with any error is rejected whole."""
    wrong = checked.where(F.size("errors") > 0).select("video_id").union(payload.select("video_id")).distinct()
    return checked.join(wrong, "video_id", "left_anti"), checked.join(wrong, "video_id", "left_semi")


def validation_report(checked: DataFrame) -> DataFrame:
    """(video_id, claims, errors, kinds, evidence, dependencies, with_truth) of documents; the counts stand only where there is no error."""
    kinds = F.array_sort(F.collect_set("kind"))
    per = checked.groupBy("video_id").agg(F.count(F.lit(1)).alias("claims"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("errors"), kinds.alias("kinds"), F.sum(F.size("evidence")).alias("evidence"), F.sum(F.size("dependencies")).alias("dependencies"), F.count("truth").alias("with_truth"))
    ok = F.size("errors") == 0
    return per.withColumns({c: F.when(ok, F.col(c)) for c in ("kinds", "evidence", "dependencies", "with_truth")})


def pair_summary(pairs: DataFrame, claims: DataFrame, cut: int = 80) -> DataFrame:
    """Pairs (left, right, kind) with summary, a text for each kind; a pair of another kind keeps its own.

    pair: both texts, each cut, and truths, with subkind; broken-presupposition: the same of what is presupposed;
    cross-video: documents, stances, similarity and the first three shared_entities, by cosine or by words (reason).
    Missing truths are 0, missing stances "?". claims: claim_id, video_id, text, truth, stance.
    """
    short = F.when(F.length("text") > cut, F.concat(F.substring("text", 1, cut - 1), F.lit("…"))).otherwise(F.col("text"))
    side = lambda s: claims.select(F.col("claim_id").alias(s), *[c.alias(f"_{s}_{n}") for n, c in (("text", short), ("truth", F.coalesce("truth", F.lit(0.0))), ("stance", F.coalesce("stance", F.lit("?"))), ("video", F.col("video_id")))])
    has = lambda c, t: F.col(c) if c in pairs.columns else F.lit(None).cast(t)
    j = pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")
    two = F.format_string('"%s" contradicts "%s" but both asserted true (%.2f vs %.2f) [%s]', "_left_text", "_right_text", "_left_truth", "_right_truth", F.coalesce(has("subkind", "string"), F.lit("logical")))
    broken = F.format_string('"%s" (%.2f) presupposes "%s" which has low truth (%.2f)', "_left_text", "_left_truth", "_right_text", "_right_truth")
    shared, like = F.array_join(F.slice(has("shared_entities", "array<string>"), 1, 3), ", "), has("similarity", "double")
    who = [F.col(c) for c in ("_left_video", "_left_stance", "_right_video", "_right_stance")]
    near = F.format_string("%s %s vs %s %s — cos=%.2f — shared: %s (pending verify)", *who, like, shared)
    words = F.format_string("%s %s vs %s %s — shared: %s — jaccard=%.2f (%s)", *who, shared, like, has("reason", "string"))
    text = F.when(F.col("kind") == "pair", two).when(F.col("kind") == "broken-presupposition", broken).when(F.col("kind") == "cross-video", F.when(has("reason", "string") == "cosine", near).otherwise(words)).otherwise(has("summary", "string"))
    return j.withColumn("summary", text).drop(*[f"_{s}_{n}" for s in ("left", "right") for n in ("text", "truth", "stance", "video")])


def verification_queue(pairs: DataFrame, claims: DataFrame, verdicts: DataFrame, shards: int, kind: str | None = None, mechanical: tuple[str, ...] = ("broken-presupposition", "manual"), order: str | None = None) -> DataFrame:
    """Pairs without a verdict, with both texts, dealt in turn to shards; mechanical kinds need none.

    Turns are in the order of a column, or of the sorted pair; pairs are numbered over sorted ranges, so no task holds the queue.
    """
    p = pairs.where(~F.col("kind").isin(list(mechanical)))
    p = p.where(F.col("kind") == kind) if kind else p
    p = p.withColumn("lo", F.least("left", "right")).withColumn("hi", F.greatest("left", "right")).join(verdicts.select("lo", "hi"), ["lo", "hi"], "left_anti")
    side = lambda s: claims.select(F.col("claim_id").alias(s), F.col("text").alias(f"{s}_text"))
    p = p.join(side("left"), "left").join(side("right"), "right").withColumn("order", F.struct(*([order] if order else []), "lo", "hi", "kind"))
    rs.ensure_checkpoints(pairs.sparkSession)
    return sw.numbered_rows(p).withColumn("shard", (F.col("row") % shards).cast("int")).drop("lo", "hi", "row")


def strict_routes(routes: DataFrame, surfacing: tuple[str, ...] = ("LOGICAL-CONTRADICTION", "DEBUNKS")) -> DataFrame:
    """I32: routes anew, where only the strict verdicts make a contradiction."""
    return routes.withColumn("route", F.when((F.col("route") == "contradiction") & ~F.col("verdict").isin(list(surfacing)), "dropped").otherwise(F.col("route")))


def claim_input(mentions: DataFrame, edges: DataFrame, cues: DataFrame) -> DataFrame:
    """(video_id, keys, edges, duration): entity keys by mentions, edges by their keys, seconds of the document."""
    k = mentions.groupBy("video_id", "entity_id").agg(F.count(F.lit(1)).alias("n")).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "entity_id", "n"))).alias("k"))
    e = edges.groupBy("video_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", "subject_id", "predicate", "object_id"))).alias("edges"))
    d = cues.groupBy("video_id").agg(F.max(F.col("start") + F.col("duration")).alias("duration"))
    j = d.join(k, "video_id", "left").join(e, "video_id", "left")
    return j.select("video_id", F.transform("k", lambda x: F.concat_ws("=", x["entity_id"], x["n"])).alias("keys"), "edges", "duration")


def marked_stale(records: DataFrame, upstream: dict[str, list[str]]) -> DataFrame:
    """Records (video_id, stage, at) with since and reason where a stage that feeds theirs was made later."""
    by = records.select("video_id", F.col("stage").alias("_u"), F.col("at").alias("_at"))
    needs = records.sparkSession.createDataFrame([(s, u) for s, us in upstream.items() for u in us], "stage string, _u string")
    later = records.join(F.broadcast(needs), "stage").join(by, ["video_id", "_u"]).where("_at > `at`").groupBy("video_id", "stage").agg(F.min("_at").alias("since"), F.array_join(F.array_sort(F.collect_set("_u")), ",").alias("reason"))
    return records.join(later, ["video_id", "stage"], "left")


def reasoning_moves(index: DataFrame, least: float = 0.05, limit: int = 5) -> DataFrame:
    """The claims whose derived truth moved most from the direct one."""
    moved = F.round(F.abs(F.col("derived") - F.col("truth")), 6)
    return index.where("derived is not null and truth is not null").withColumn("moved", moved).where(F.col("moved") > least).orderBy(F.desc("moved"), "claim_id").limit(limit).select("claim_id", "moved")


def stamped_versions(claims: DataFrame, begin: str, end: str, p50: float = 150) -> DataFrame:
    """(video_id, p50, version) of documents by the day they were made and the median length of their quotes: v2 if short and in the window, v1 before it, else unknown."""
    per = percentiles(claims, ["video_id"], "quote_length", {"p50": 0.5}).join(claims.groupBy("video_id").agg(F.max("made").alias("made")), "video_id")
    version = F.when(F.col("made") < F.lit(begin).cast("date"), "v1").when((F.col("made") <= F.lit(end).cast("date")) & (F.col("p50") <= p50), "v2").otherwise("unknown")
    return per.select("video_id", "p50", version.alias("version"))


def subset_reasoning(claims: DataFrame, deps: DataFrame, documents: DataFrame, cache: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(truth, contradictions, cache counts) of chosen documents alone, without overrides; cache: (claim_id, vec)."""
    c = claims.join(documents.select("video_id"), "video_id", "left_semi")
    d = deps.join(documents.select("video_id"), "video_id", "left_semi")
    truth = rs.claim_truth(c, d, None, **options)[0]
    # rounded, as a sum that is a bound but for its last digit must not depend on its order
    held = c.join(truth.select("claim_id", F.col("value").alias("_v")), "claim_id").withColumn("truth", F.round(F.coalesce("_v", "truth"), 9))
    found = cl.pair_contradictions(d, held).select(F.lit("pair").alias("kind"), "source", "target").union(cl.broken_presuppositions(d, held).select(F.lit("broken-presupposition"), "source", "target"))
    hits = c.join(cache.select("claim_id", F.lit(1).alias("_h")), "claim_id", "left").agg(F.count("_h").alias("hits"), F.count_if(F.col("_h").isNull()).alias("misses"))
    return truth, found, hits


# L
def percentiles(df: DataFrame, group: list[str], column: str, at: dict[str, float]) -> DataFrame:
    """Each group's element at min(n - 1, floor(n * p)): equal values are counted first, so only distinct ones are ranked.

    Without groups the distinct values are dealt by ranges and the ranges' counts are summed up, so that no task sees them all.
    """
    n = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("_c"))
    if group:
        w = Window.partitionBy(*group)
        r = n.withColumn("_upto", F.sum("_c").over(w.orderBy(column))).withColumn("_n", F.sum("_c").over(w))
    else:
        rs.ensure_checkpoints(df.sparkSession)
        dealt = n.repartitionByRange(column).withColumn("_part", F.spark_partition_id()).checkpoint()
        sums = dealt.groupBy("_part").agg(F.sum("_c").alias("_s"))
        w = Window.partitionBy(F.lit(0))  # a row for each range
        sums = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(w).alias("_n"))
        r = dealt.join(F.broadcast(sums), F.col("_part") == F.col("_p")).withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy("_part").orderBy(column)))
    hit = lambda p: F.min(F.when(F.col("_upto") > F.least(F.col("_n") - 1, F.floor(F.col("_n") * p)), F.col(column)))
    return r.groupBy(*group).agg(*[hit(p).alias(name) for name, p in at.items()])


def percent(n: Column, d: Column) -> Column:
    """N of d in percent, to two places; of nothing 0."""
    return F.when(d == 0, 0.0).otherwise(F.round(n / F.nullif(d, F.lit(0)) * 100, 2))


def as_metrics(section: str, row: DataFrame) -> DataFrame:
    """(section, name, value) of the columns of a one-row frame."""
    names = row.columns
    long = row.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot([], [f"`{c}`" for c in names], "name", "value")
    return long.select(F.lit(section).alias("section"), "name", "value")


def hygiene_metrics(entities: DataFrame, merges: DataFrame, deleted: DataFrame, document_merges: DataFrame, labels: list[str], role_nouns: list[str], tautologies: list[str], listed: int) -> DataFrame:
    """L1: eight counts of entities (entity_id, label, norm) and of what was done to them."""
    e = entities.join(deleted.select("entity_id", F.lit(True).alias("_d")).distinct(), "entity_id", "left").join(merges.select(F.col("source").alias("entity_id"), F.lit(True).alias("_m")).distinct(), "entity_id", "left")
    live = ~F.col("label").isin(labels) & F.col("_d").isNull() & F.col("_m").isNull()
    row = e.agg(F.count(F.lit(1)).alias("entities.total"), F.count_if(live).alias("entities.active"), F.count_if(live & (F.col("label") == "person") & F.col("norm").isin(role_nouns)).alias("entities.roleNounPersons"), F.count_if(live & F.col("entity_id").isin(tautologies)).alias("entities.tautologies"))
    for name, df in (("entities.deleted", deleted), ("entities.merged", merges), ("entities.perVideoMerged", document_merges)):
        row = row.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row beside one row
    return as_metrics("entity-hygiene", row.withColumn("entities.deleteAlwaysListSize", F.lit(listed)))


def resolution_metrics(named: DataFrame, entities: DataFrame, promoted: DataFrame, document_merges: DataFrame, least: int = 3) -> DataFrame:
    """L2: the promote list's size and live entries, persons of one token in several documents, names that collide in lower case."""
    known = entities.select(F.col("entity_id"), F.lit(True).alias("_k")).distinct()
    p = promoted.join(known.withColumnRenamed("entity_id", "source"), "source", "left").withColumnRenamed("_k", "_s").join(known.withColumnRenamed("entity_id", "target"), "target", "left")
    row = p.agg(F.count(F.lit(1)).alias("resolution.gazetteerSize"), F.count_if(F.coalesce("_s", "_k", F.lit(False))).alias("resolution.gazetteerActive"))
    norm = F.regexp_replace(F.trim(F.lower("canonical")), r"\s+", " ")
    one = named.where((F.col("label") == "person") & ~F.contains(norm, F.lit(" "))).select("video_id", F.concat_ws(":", "label", norm).alias("source")).distinct().join(document_merges.select("video_id", "source"), ["video_id", "source"], "left_anti")
    often = one.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).agg(F.count(F.lit(1)).alias("resolution.firstNamePersonsMultiVideo"))
    same = entities.groupBy("label", F.regexp_replace(F.trim(F.lower("canonical")), r"\s+", " ").alias("n")).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("resolution.caseDuplicates"))
    return as_metrics("entity-resolution", row.crossJoin(often).crossJoin(same))  # one row each


def claim_metrics(claims: DataFrame, deps: DataFrame, quotes: DataFrame, payloads: DataFrame) -> DataFrame:
    """L3: eleven metrics of claims (claim_id, video_id, truth, stance), dependencies (source, kind, rationale), quotes (length) and payloads (video_id, version); null where there are no claims."""
    total = F.count(F.lit(1))
    c = claims.join(deps.select(F.col("source").alias("claim_id"), F.lit(True).alias("_d")).distinct(), "claim_id", "left")
    row = c.agg(total.alias("claims.total"), F.when(total > 0, F.round(total / F.nullif(F.count_distinct("video_id"), F.lit(0)), 2)).alias("claims.avgPerVideo"), percent(F.count("truth"), total).alias("claims.directTruthPct"), percent(F.count_if(F.col("stance") == "denies"), total).alias("claims.deniesPct"), percent(F.count("_d"), total).alias("claims.dependencyCoveragePct"))
    q = percentiles(quotes, [], "length", {"claims.evidenceP50Chars": 0.5, "claims.evidenceP90Chars": 0.9, "claims.evidenceMaxChars": 1.0})
    against = F.col("kind") == "contradicts"
    typed = deps.agg(F.when(F.count_if(against) == 0, 100.0).otherwise(percent(F.count_if(against & subkind(F.col("rationale")).isNotNull()), F.count_if(against))).alias("claims.contradictsSubkindPct"))
    v = payloads.agg(F.when(total > 0, percent(F.count_if(F.col("version") == "v2"), total)).alias("claims.promptVersionV2Pct"), F.count_if(~F.coalesce(F.col("version").isin("v1", "v2"), F.lit(False))).alias("claims.promptVersionUnknownFiles"))
    row = row.crossJoin(q.agg(*[F.max(f"`{x}`").alias(x) for x in q.columns])).crossJoin(typed).crossJoin(v)  # one row each
    return as_metrics("claims", row).withColumn("value", F.when((F.col("name") == "claims.total") | (F.max(F.when(F.col("name") == "claims.total", F.col("value"))).over(Window.partitionBy("section")) > 0), F.col("value")))


VERDICT_NAMES = {"LOGICAL-CONTRADICTION": "logicalContradiction", "DEBUNKS": "debunks", "UNDERCUTS": "undercuts", "ALTERNATIVE": "alternative", "COMPLEMENTARY": "complementary", "IRRELEVANT": "irrelevant", "SAME-CLAIM": "sameClaim"}


def contradiction_metrics(pairs: DataFrame, verdicts: DataFrame, agreements: DataFrame, vectors: DataFrame) -> DataFrame:
    """L4: seventeen counts of contradictions (kind, verdict), verdicts (verdict, by), agreements and cached vectors (vec)."""
    n = F.count(F.lit(1))
    kind = lambda k: F.count_if(F.col("kind") == k)
    row = pairs.agg(n.alias("contradictions.total"), kind("pair").alias("contradictions.pair"), kind("cross-video").alias("contradictions.crossVideo"), kind("broken-presupposition").alias("contradictions.brokenPresupposition"), F.count_if(~F.col("kind").isin("broken-presupposition", "manual") & F.col("verdict").isNull()).alias("contradictions.pendingVerify"))
    v = verdicts.agg(n.alias("verdicts.total"), *[F.count_if(F.col("verdict") == k).alias(f"verdicts.{name}") for k, name in VERDICT_NAMES.items()], F.count_if(F.col("by") == "operator").alias("verdicts.operator"))
    return as_metrics("contradictions", row.crossJoin(v).crossJoin(agreements.agg(n.alias("consonance.count"))).crossJoin(vectors.agg(n.alias("embeddings.cached"), F.max(F.size("vec")).alias("embeddings.dimensions"))))  # one row each


#: Override sections and the metric of each.
CORRECTIONS = {"claimTruthOverrides": "claimTruthOverrides", "claimDeletions": "claimDeletions", "claimFieldOverrides": "claimFieldOverrides", "contradictionDismissals": "contradictionDismissals", "customContradictions": "customContradictions", "display": "displayOverrides", "notSame": "notSamePairs", "dismissed": "dismissedClusters", "deletedRelations": "deletedRelations"}


def correction_metrics(sections: dict[str, DataFrame]) -> DataFrame:
    """Nine counts of operators' corrections; a section that is missing counts 0."""
    some = next(iter(sections.values()))
    names = some.sparkSession.createDataFrame([(f"corrections.{m}",) for m in CORRECTIONS.values()], "name string")
    found = None
    for s, m in CORRECTIONS.items():
        if s in sections:
            one = sections[s].agg(F.lit(f"corrections.{m}").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
            found = one if found is None else found.union(one)
    return names.join(found, "name", "left").select(F.lit("operator-corrections").alias("section"), "name", F.coalesce("value", F.lit(0.0)).alias("value"))


def frozen(metrics: DataFrame) -> DataFrame:
    """(name, value) of the metrics that have one, as a baseline."""
    return metrics.where("value is not null").select("name", "value")


def document_shape(claims: DataFrame, deps: DataFrame, quotes: DataFrame) -> DataFrame:
    """(video_id, claims, p50, denies, contradicts) of documents: what L10-L12 compare. quotes: (video_id, length)."""
    c = claims.groupBy("video_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("stance") == "denies").alias("denies"))
    d = deps.where("kind = 'contradicts'").groupBy("video_id").agg(F.count(F.lit(1)).alias("contradicts"))
    return c.join(percentiles(quotes, ["video_id"], "length", {"p50": 0.5}), "video_id", "left").join(d, "video_id", "left").fillna(0, ["contradicts", "p50"])


def corpus_fingerprint(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """(part, bucket, n): percentiles of quote lengths, kinds, stances, truth bands, claims per day, and compound sentences in a thousand."""
    q = percentiles(quotes, [], "length", {"p50": 0.5, "p90": 0.9, "max": 1.0}).selectExpr("stack(3, 'p50', p50, 'p90', p90, 'max', max) as (bucket, n)").select(F.lit("quote-length").alias("part"), "bucket", F.col("n").cast("long").alias("n"))
    count = lambda part, bucket: claims.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), F.coalesce("bucket", F.lit("none")).alias("bucket"), "n")
    band = F.when(F.col("truth").isNull(), None).when(F.col("truth") < 0.3, "low").when(F.col("truth") <= 0.7, "middle").otherwise("high")
    two = F.regexp_count(F.lower("text"), F.lit(r"\b(and|but|because|while)\b|;")) > 0
    rate = claims.agg(F.floor(F.count_if(two) * 1000 / F.greatest(F.count(F.lit(1)), F.lit(1))).cast("long").alias("n")).select(F.lit("compound").alias("part"), F.lit("per-thousand").alias("bucket"), "n")
    return q.union(count("kind", F.col("kind"))).union(count("stance", F.col("stance"))).union(count("truth", band)).union(count("day", F.date_format("published", "yyyy-MM-dd"))).union(rate)


def representative_sample(claims: DataFrame, contradictions: DataFrame, count: int = 10, pinned: list[str] | None = None) -> list[str]:
    """Documents that cover kinds, stances and size bins: each step takes the one that adds most; ties by contradictions, then size.

    Features are made once per document and kept in the shared folder; a step is one distributed
    arg-max and brings one row to the driver, for at most count steps. contradictions: (video_id, n).
    """
    rs.ensure_checkpoints(claims.sparkSession)
    n = F.count(F.lit(1))
    size = F.when(n <= 8, "size:short").when(n <= 13, "size:medium").otherwise("size:long")
    f = claims.groupBy("video_id").agg(n.alias("claims"), F.array_union(F.array_union(F.transform(F.collect_set("kind"), lambda k: F.concat(F.lit("kind:"), k)), F.transform(F.collect_set("stance"), lambda k: F.concat(F.lit("stance:"), k))), F.array(size)).alias("has"))
    f = f.join(contradictions.select("video_id", F.col("n").alias("against")), "video_id", "left").fillna(0, ["against"]).checkpoint()
    picked, covered = [], set()
    for row in f.where(F.col("video_id").isin(pinned or [])).orderBy("video_id").collect():  # the pinned documents only
        picked.append(row["video_id"])
        covered |= set(row["has"])
    while len(picked) < count:
        gain = F.size(F.array_except("has", F.array(*[F.lit(c) for c in sorted(covered)]).cast("array<string>")))
        best = f.where(~F.col("video_id").isin(picked)).withColumn("score", gain * 1000 + F.col("against") + F.col("claims") / 100).orderBy(F.desc("score"), "video_id").first()
        if best is None:
            break
        picked.append(best["video_id"])
        covered |= set(best["has"])
    return picked


def gold_check(gold: DataFrame, current: DataFrame) -> DataFrame:
    """(video_id, status, reasons) of gold documents against current ones, both as document_shape gives them."""
    g = gold.select("video_id", *[F.col(c).alias(f"g_{c}") for c in ("claims", "p50", "denies", "contradicts")])
    j = g.join(current.withColumn("_here", F.lit(True)), "video_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("claims") < F.col("g_claims") * 0.7, "claims"), F.when((F.col("p50") > F.col("g_p50") * 2) & (F.col("g_p50") > 0), "p50"), F.when(F.col("denies") < F.col("g_denies") / 2, "denies"), F.when(F.col("contradicts") < F.col("g_contradicts") / 2, "contradicts")))
    status = F.when(F.col("_here").isNull(), "missing").when(F.size(reasons) > 0, "regressed").otherwise("ok")
    return j.select("video_id", status.alias("status"), F.array_join(F.when(F.col("_here"), reasons).otherwise(F.array().cast("array<string>")), ",").alias("reasons"))


def documents_by_claims(documents: DataFrame, claims: DataFrame, having: bool = True) -> DataFrame:
    """Documents (video_id, ...) that have one of the claims, or, without having, that have none."""
    return documents.join(claims.select("video_id"), "video_id", "left_semi" if having else "left_anti")


def extraction_summary(claims: DataFrame) -> DataFrame:
    """(video_id, kind, n, with_truth): each document's claims by kind, and how many of them have a truth."""
    return claims.groupBy("video_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("truth").alias("with_truth"))


def reasoning_histograms(index: DataFrame, deps: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(section, bucket, n): claims by document, kind and stance (null: none), with direct and derived truth, dependencies, contradictions by kind.

    index: video_id, kind, stance, truth, derived; contradictions: kind. The greatest moves are reasoning_moves'.
    """
    cells = [F.struct(F.lit(s).alias("section"), c.cast("string").alias("bucket")) for s, c in (("document", F.col("video_id")), ("kind", F.col("kind")), ("stance", F.coalesce("stance", F.lit("none"))))]
    cells += [F.when(F.col(c).isNotNull(), F.struct(F.lit("truth").alias("section"), F.lit(name).alias("bucket"))) for c, name in (("truth", "direct"), ("derived", "derived"))]
    rows = index.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.section", "x.bucket")
    rows = rows.union(deps.select(F.lit("dependencies"), F.lit("all"))).union(contradictions.select(F.lit("contradiction"), "kind"))
    return rows.groupBy("section", "bucket").agg(F.count(F.lit(1)).alias("n"))
