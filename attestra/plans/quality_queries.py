"""Registered queries of claim checks, quality metrics, the catalogue and streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import catalog as kt
from attestra.operators import quality as ql
from attestra.plans import claim_queries as cq
from attestra.plans import entity_queries as eq
from attestra.plans import facet_queries as fq
from attestra.plans import fixtures as fx
from attestra.plans import more
from attestra.streaming import contradiction as sc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


_C, _D = fx.claims, fx.dependencies
_CD = f"with {fx.LI}, {fx.CLAIMS}, {fx.DEPS}"
#: Kinds of faults that the claims of lines have.
_FAULTS = 16


# A claim for every line of a document, one in three with a fault
def checked_claims(s: SparkSession, d: str) -> DataFrame:
    k = F.col("cue_idx") % (3 * _FAULTS)
    at = lambda i: k == 3 * i
    before = F.coalesce(F.sum(F.length("text") + 1).over(fx.Window.partitionBy("video_id").orderBy("cue_idx").rowsBetween(fx.Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    c = fx.cues(s, d).withColumn("cs", before).withColumn("n", F.length("text")).where("n > 0")
    span = F.struct(F.when(at(0), "other").otherwise(F.col("video_id")).alias("transcript_id"), F.when(at(1), -1).otherwise(F.col("cs")).alias("char_start"), (F.col("cs") + F.col("n")).alias("char_end"), F.when(at(2), F.col("start") + 9).otherwise(F.col("start")).alias("time_start"), (F.col("start") + 4).alias("time_end"), F.when(at(3), F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("quote"))
    me = F.concat(F.col("video_id"), F.lit(":c_"), "cue_idx")
    return c.select(
        "video_id", F.when(at(4), F.concat(F.lit("x"), me)).otherwise(me).alias("claim_id"), F.when(at(5), " ").otherwise(F.lit("said")).alias("text"), F.when(at(6), "rumour").otherwise(fx._pick(fx.KINDS, F.col("cue_idx"))).alias("kind"),
        F.when(at(7), "shouts").when(F.col("cue_idx") % 2 == 0, "denies").alias("stance"), F.when(at(8), 1.5).otherwise(0.5).alias("confidence"), F.when(at(9), -0.1).when(F.col("cue_idx") % 2 == 0, 0.4).alias("truth"), F.when(at(10), "").otherwise(F.lit("because")).alias("rationale"),
        F.array(F.when(at(11), "person:They ").when(at(12), "nobody").when(at(13), "person:unknown").otherwise("person:bob")).alias("entities"), F.when(at(14), F.array(F.lit("r0"))).otherwise(F.array(F.lit("r1"))).alias("relationships"), F.when(at(15), F.array().cast(span_type(c, span))).otherwise(F.array(span)).alias("evidence"),
        F.array(F.struct(F.when(F.col("cue_idx") % 3 == 1, me).otherwise(F.concat(F.col("video_id"), F.lit(":c_9999999"))).alias("target"), F.lit("supports").alias("kind"))).alias("d"), "cue_idx",
    ).withColumn("dependencies", F.when(F.col("cue_idx") % 30 == 1, F.col("d")).when(F.col("cue_idx") % 30 == 2, F.col("d")).otherwise(F.slice("d", 1, 0))).drop("d")


def span_type(df: DataFrame, span: F.Column) -> str:
    return f"array<{df.select(span.alias('x')).schema['x'].dataType.simpleString()}>"


def _checked(s: SparkSession, d: str) -> DataFrame:
    texts = fx.table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), "text")
    c = checked_claims(s, d)
    docs = c.select("video_id").distinct()
    keys = ql.valid_keys(docs.withColumn("entity_id", F.lit("person:bob")), s.createDataFrame([("person:They ",)], "entity_id string"), docs)
    return ql.claim_errors(c, texts, keys, docs.withColumn("rel_id", F.lit("r1")))


_CODES = ["evidence-document", "evidence-span", "evidence-time", "evidence-quote", "id", "text", "kind", "stance", "confidence", "truth", "rationale", "entity-pronoun", "entity-malformed", "entity-unknown", "relation-unknown", "evidence-none"]
_CH = f"""{fx.CUES}, ch as (select video_id, case when cue_idx % 48 = 12 then 'x' else '' end || video_id || ':c_' || cue_idx claim_id, cue_idx, {fx._sql_list(fx.KINDS)}[1 + cue_idx % 5] knd, case when cue_idx % 48 % 3 = 0 then {fx._sql_list(_CODES)}[1 + (cue_idx % 48) // 3] end e1, case when cue_idx % 30 = 2 or cue_idx % 30 = 1 and cue_idx % 48 = 12 then 'dependency-target' when cue_idx % 30 = 1 then 'dependency-self' end e2 from cues where length(text) > 0),
er as (select *, list_sort([e for e in [e1, e2] if e is not null]) errors from ch)"""
_add("i1_i2_claim_errors", lambda s, d: _checked(s, d).select("claim_id", F.array_join("errors", ",").alias("errors")), f"with {_CH} select claim_id, array_to_string(errors, ',') errors from er")


def _payloads(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), F.when(F.col("doc_id") % 10 == 0, "v9").when(F.col("doc_id") % 10 == 1, "v1").otherwise("v2").alias("version"))


def _twice(s: SparkSession, d: str) -> DataFrame:
    c = checked_claims(s, d).select("video_id", "claim_id", "cue_idx")
    return c.union(c.where("cue_idx = 5 and video_id like '%7'"))


_add("i3_payload_errors", lambda s, d: ql.payload_errors(_twice(s, d), _payloads(s, d)), f"with {_CH} select video_id, 'duplicate-id' error from ch where cue_idx = 5 and video_id like '%7' union all select 'd' || doc_id, 'version' from documents where doc_id % 10 = 0")
_add("i4_valid_keys", lambda s, d: ql.valid_keys(_C(s, d).select("video_id", F.get("entities", F.lit(0)).alias("entity_id")), fx.table(s, d, "nation").select(F.concat(F.lit("location:"), "n_name").alias("entity_id")), _C(s, d)), f"{_CD} select video_id, entities[1] entity_id from claims union select video_id, 'location:' || n_name from (select distinct video_id from claims), nation")
_add("i40_validation_report", lambda s, d: ql.validation_report(_checked(s, d)).select("video_id", "claims", F.array_join("errors", ",").alias("errors"), F.array_join("kinds", ",").alias("kinds"), "evidence", "with_truth"), f"with {_CH}, p as (select video_id, count(*)::bigint claims, list_sort(list_distinct(flatten(list(errors)))) errors, string_agg(distinct knd, ',' order by knd) kinds, count(*)::bigint ev, count(*) filter (cue_idx % 2 = 0)::bigint wt from er group by 1) select video_id, claims, array_to_string(errors, ',') errors, case when len(errors) = 0 then kinds end kinds, case when len(errors) = 0 then ev end evidence, case when len(errors) = 0 then wt end with_truth from p")
_add("i41_accepted_claims", lambda s, d: ql.accepted_claims(_checked(s, d).withColumn("errors", F.when(F.col("cue_idx") % 48 == 0, F.slice("errors", 1, 0)).otherwise(F.col("errors"))), ql.payload_errors(_twice(s, d), _payloads(s, d)))[0].select("claim_id"), f"with {_CH} select claim_id from ch where video_id not in (select video_id from er where len(errors) > 0 and cue_idx % 48 <> 0) and video_id not in (select video_id from ch where cue_idx = 5 and video_id like '%7' union select 'd' || doc_id from documents where doc_id % 10 = 0)")

# I18, I30-I32, I34-I39
_K2 = "case when length(text) > 22 then text[1:21] || '…' else text end"


def _kinds(s: SparkSession, d: str) -> DataFrame:
    """Dependencies as pairs of all kinds."""
    k = F.when(F.col("kind") == "contradicts", "pair").when(F.col("kind") == "presupposes", "broken-presupposition").when(F.col("kind") == "supports", "cross-video").otherwise("manual")
    near = F.col("source").like("%2")
    shared = _C(s, d).select(F.col("claim_id").alias("left"), F.concat("entities", F.array(F.lit("thing:a"), F.lit("thing:b"))).alias("shared_entities"))
    p = fx.dependencies(s, d).select(F.col("source").alias("left"), F.col("target").alias("right"), k.alias("kind"), tx.subkind(F.col("rationale")).alias("subkind"), F.when(near, "cosine").otherwise("strong-overlap").alias("reason"), (F.length("source") / 40.0).alias("similarity"), F.lit("by hand").alias("summary"))
    return p.join(shared, "left")


def _two(x: str) -> str:
    return f"round(coalesce({x}, 0)::decimal(18, 6), 2)::decimal(18, 2)"


_add(
    "i18_pair_summaries",
    lambda s, d: ql.pair_summary(_kinds(s, d), _C(s, d).withColumn("stance", F.nullif("stance", F.lit("uncertain"))), 22).select("left", "right", "summary"),
    f"""{_CD}, t as (select *, {_K2} x, case when stance = 'uncertain' then '?' else stance end st from claims) select source "left", target "right", case kind when 'contradicts' then '"' || a.x || '" contradicts "' || b.x || '" but both asserted true (' || {_two('a.truth')} || ' vs ' || {_two('b.truth')} || ') [' || coalesce(nullif(lower(regexp_extract(rationale, '^\\s*\\[(logical|debunks|alternative|undercuts)\\]', 1)), ''), 'logical') || ']'
  when 'presupposes' then '"' || a.x || '" (' || {_two('a.truth')} || ') presupposes "' || b.x || '" which has low truth (' || {_two('b.truth')} || ')'
  when 'supports' then a.video_id || ' ' || a.st || ' vs ' || b.video_id || ' ' || b.st || case when source like '%2' then ' — cos=' || {_two('length(source) / 40.0')} || ' — shared: ' || a.entities[1] || ', ' || a.entities[2] || ', thing:a (pending verify)' else ' — shared: ' || a.entities[1] || ', ' || a.entities[2] || ', thing:a — jaccard=' || {_two('length(source) / 40.0')} || ' (strong-overlap)' end else 'by hand' end summary
  from deps join (select claim_id, x, st, truth, video_id, entities from t) a on a.claim_id = source join (select claim_id, x, st, truth, video_id from t) b on b.claim_id = target""",
)


def _verdict_rows(s: SparkSession, d: str) -> DataFrame:
    v = fq.pairs(s, d).where("left like '%4'").select("left", "right", F.lit("DEBUNKS").alias("verdict"), F.lit(1).alias("seq"))
    return v.union(v.select("right", "left", F.lit("UNDERCUTS"), F.lit(2)))


def _latest(s: SparkSession, d: str) -> DataFrame:
    from attestra.sources import readers as rd

    return rd.latest_verdicts(_verdict_rows(s, d))


_add("i30_verification_queue", lambda s, d: ql.verification_queue(fq.pairs(s, d), _C(s, d), _latest(s, d), 4, None, ("presupposes",)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("left_text") + F.length("right_text")).alias("chars"), F.count_distinct("shard").alias("shards")), f"{_CD} select deps.kind as kind, count(*)::bigint n, sum(length(a.text) + length(b.text))::bigint chars, 4::bigint shards from deps join claims a on a.claim_id = source join claims b on b.claim_id = target where deps.kind <> 'presupposes' and source not like '%4' group by 1")
_add(
    "i30_queue_in_turn",
    lambda s, d: ql.verification_queue(fq.pairs(s, d), _C(s, d), _latest(s, d), 4, None, ("presupposes",)).select("left", "right", "shard"),
    f"{_CD} select source as \"left\", target as \"right\", ((row_number() over (order by least(source, target), greatest(source, target), kind) - 1) % 4)::int shard from deps where kind <> 'presupposes' and source not like '%4'",
)
_add(
    "i37_reasoning_histograms",
    lambda s, d: ql.reasoning_histograms(_C(s, d).withColumns({"derived": F.when(F.col("l_linenumber") > 1, F.col("truth")), "stance": F.nullif("stance", F.lit("uncertain"))}), fx.dependencies(s, d), fq.pairs(s, d)),
    f"{_CD} select 'document' section, video_id bucket, count(*)::bigint n from claims group by 2 union all select 'kind', kind, count(*) from claims group by 2 union all select 'stance', case when stance = 'uncertain' then 'none' else stance end, count(*) from claims group by 2 union all select 'truth', 'direct', count(truth) from claims having count(truth) > 0 union all select 'truth', 'derived', count(*) from claims where l_linenumber > 1 and truth is not null having count(*) > 0 union all select 'dependencies', 'all', count(*) from deps having count(*) > 0 union all select 'contradiction', kind, count(*) from deps group by 2",
)
_add("i31_verdict_merge", lambda s, d: _latest(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")), f"{_CD} select 'UNDERCUTS' verdict, count(*)::bigint n, 2::int seq from deps where source like '%4'")
_add("i32_strict_routes", lambda s, d: ql.strict_routes(cq._routes(s, d)).groupBy("route", "verdict").agg(F.count(F.lit(1)).alias("n")), f"{cq._CD}, {cq._VEC}, {cq._VP}, {cq._ROUTES} select case when verdict is null then 'pending' when verdict = 'DEBUNKS' then 'contradiction' when verdict = 'SAME-CLAIM' and not opp then 'agreement' else 'dropped' end route, case when verdict = 'SAME-CLAIM' and opp then 'SAME-CLAIM-stance-mismatch' else verdict end verdict, count(*)::bigint n from ro group by 1, 2")
_add(
    "i34_claim_input",
    lambda s, d: ql.claim_input(_C(s, d).select("video_id", F.explode("entities").alias("entity_id")), fx.relationships(s, d).withColumn("video_id", F.col("transcript_id")), fx.relationships(s, d).select(F.col("transcript_id").alias("video_id"), F.col("time_start").alias("start"), F.lit(4.0).alias("duration"))).select("video_id", F.sha1(F.array_join("keys", ",")).alias("keys"), F.size("edges").cast("long").alias("edges"), "duration"),
    f"{_CD}, {fx.REL}, k as (select video_id, e, count(*) n from (select video_id, unnest(entities) e from claims) group by 1, 2), ks as (select video_id, sha1(string_agg(e || '=' || n, ',' order by n desc, e)) keys from k group by 1) select transcript_id video_id, any_value(keys) keys, count(distinct subject_id || '|' || predicate || '|' || object_id)::bigint edges, max(time_start) + 4 duration from rel left join ks on ks.video_id = transcript_id group by 1",
)
_NEED = {"claims": ["nlp", "fetched"], "graph": ["claims"]}
_add("i35_stale_marks", lambda s, d: ql.marked_stale(more._records(s, d), _NEED), f"with {more._RECORDS}, l as (select r.video_id, r.stage, min(u.at_) since, string_agg(distinct u.stage, ',' order by u.stage) reason from rec r join rec u on u.video_id = r.video_id and u.at_ > r.at_ and (r.stage = 'claims' and u.stage in ('nlp', 'fetched') or r.stage = 'graph' and u.stage = 'claims') group by 1, 2) select rec.video_id, rec.stage, at_ \"at\", since, reason from rec left join l using (video_id, stage)")


def _i37(s: SparkSession, d: str) -> DataFrame:
    from attestra.operators import reasoning as rs

    # the index's claims as far as the moves need them: its header is a pass of its own over all of it
    held = rs.overridden(_C(s, d), cq._fields(s, d), cq._deleted(s, d))
    return ql.reasoning_moves(rs.claim_truth(held, _D(s, d), cq._pins(s, d), epsilon=1e-9)[0].withColumnRenamed("value", "derived"))


_add("i37_reasoning_moves", _i37, f"{cq._CD}, {cq._SDEPS}, {cq._HELD}, {cq._claim_rounds('t', 'held2', cq._PIN)} select h.claim_id, round(abs(v - truth), 6) moved from held2 h join t{cq._LAST} t on t.claim_id = h.claim_id where v is not null and truth is not null and round(abs(v - truth), 6) > 0.05 order by moved desc, h.claim_id limit 5")


def _quotes(s: SparkSession, d: str) -> DataFrame:
    return _C(s, d).select("video_id", "claim_id", (F.length("text") * 7 % 250).alias("length"), F.col("published").alias("made"))


_Q = "qu as (select video_id, claim_id, length(text) * 7 % 250 l, published made from claims)"
_P50 = "pq as (select video_id, l p50 from (select video_id, l, row_number() over (partition by video_id order by l) - 1 r, count(*) over (partition by video_id) n from qu) where r = least(n - 1, floor(n * 0.5)))"
_add("i38_stamped_versions", lambda s, d: ql.stamped_versions(_quotes(s, d).withColumnRenamed("length", "quote_length"), "1998-06-01", "1998-10-31", 120), f"{_CD}, {_Q}, {_P50}, m as (select video_id, max(made) made from qu group by 1) select video_id, p50::int p50, case when made < date '1998-06-01' then 'v1' when made <= date '1998-10-31' and p50 <= 120 then 'v2' else 'unknown' end version from pq join m using (video_id)")


def _i39(s: SparkSession, d: str) -> DataFrame:
    docs = _C(s, d).where("video_id like '%5'").select("video_id").distinct()
    _, found, hits = ql.subset_reasoning(_C(s, d), _D(s, d), docs, cq.vectors(s, d), epsilon=1e-9)
    n = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return n.union(hits.select(F.lit("hits"), "hits")).union(hits.select(F.lit("misses"), "misses"))


_add(
    "i39_subset_reasoning",
    _i39,
    f"{cq._CD}, {cq._SDEPS}, {cq._VEC}, sub as (select * from claims where video_id like '%5'), {cq._claim_rounds('t', 'sub', 'null')}, h as (select s.claim_id, round(coalesce(v, truth), 9) truth from sub s join t{cq._LAST} t on t.claim_id = s.claim_id), x as (select kind, coalesce({cq._SUB}, 'logical') sk, a.truth a, b.truth b from deps join h a on a.claim_id = source join h b on b.claim_id = target), r as (select 'pair' kind from x where kind = 'contradicts' and (sk = 'logical' and least(coalesce(a, 0), coalesce(b, 0)) >= 0.5 or sk = 'debunks' and least(coalesce(a, 0), coalesce(b, 0)) >= 0.7) union all select 'broken-presupposition' from x where kind = 'presupposes' and b < 0.3 and a >= 0.5) select kind, count(*)::bigint n from r group by 1 union all select 'hits', count(*) from sub where claim_id in (select claim_id from ve) union all select 'misses', count(*) from sub where claim_id not in (select claim_id from ve)",
)

# L
_add("l1_hygiene_metrics", lambda s, d: ql.hygiene_metrics(eq.cu.corpus(eq.named(s, d)), eq.merges(s, d), eq.handled(s, d), fx.table(s, d, "nation"), ["role"], ["ring", "bolt"], ["person:gear", "organization:gear"], 16), f"with {eq._FIX}, l as (select * from co where label <> 'role' and entity_id not in (from hd) and entity_id not in (select source from mg)) select 'entity-hygiene' section, name, value::double as value from (select 'entities.total' as name, count(*) as value from co union all select 'entities.active', count(*) from l union all select 'entities.roleNounPersons', count(*) from l where label = 'person' and norm in ('ring', 'bolt') union all select 'entities.tautologies', count(*) from l where entity_id in ('person:gear', 'organization:gear') union all select 'entities.deleted', count(*) from hd union all select 'entities.merged', count(*) from mg union all select 'entities.perVideoMerged', count(*) from nation union all select 'entities.deleteAlwaysListSize', 16)")
_add("l2_resolution_metrics", lambda s, d: ql.resolution_metrics(eq.named(s, d), eq.cu.corpus(eq.named(s, d)), eq.merges(s, d).union(s.createDataFrame([("a:b", "c:d")], "source string, target string")), eq.named(s, d).where("start % 10 = 0 and label = 'person'").select("video_id", F.lower(F.concat_ws(":", "label", "canonical")).alias("source")).distinct()), f"with {eq._FIX}, o as (select k, count(distinct video_id) n from na where label = 'person' and not contains(norm, ' ') and not exists (from na b where b.start % 10 = 0 and b.label = 'person' and b.video_id = na.video_id and lower(b.label || ':' || b.canonical) = na.k) group by 1) select 'entity-resolution' section, name, value::double as value from (select 'resolution.gazetteerSize' as name, count(*) + 1 as value from mg union all select 'resolution.gazetteerActive', count(*) from mg where source in (select entity_id from co) or target in (select entity_id from co) union all select 'resolution.firstNamePersonsMultiVideo', count(*) from o where n >= 3 union all select 'resolution.caseDuplicates', 0)")
_PCT = "case when {1} = 0 then 0 else round({0} / {1} * 100, 2) end"


def _l3(s: SparkSession, d: str) -> DataFrame:
    return ql.claim_metrics(_C(s, d), _D(s, d), _quotes(s, d), _payloads(s, d)).union(ql.claim_metrics(_C(s, d).limit(0), _D(s, d).limit(0), _quotes(s, d).limit(0), _payloads(s, d).limit(0)).withColumn("section", F.lit("empty")))


_L3 = ["total", "avgPerVideo", "directTruthPct", "deniesPct", "dependencyCoveragePct", "evidenceP50Chars", "evidenceP90Chars", "evidenceMaxChars", "contradictsSubkindPct", "promptVersionV2Pct", "promptVersionUnknownFiles"]
_RANK = "(select l from (select l, row_number() over (order by l) - 1 r, count(*) over () n from qu) where r = least(n - 1, floor(n * {0})))"
_L3V = ["count(*)", "round(count(*) / count(distinct video_id), 2)", "round(count(truth) / count(*) * 100, 2)", "round(count(*) filter (stance = 'denies') / count(*) * 100, 2)", "round(count(*) filter (claim_id in (select source from deps)) / count(*) * 100, 2)", _RANK.format(0.5), _RANK.format(0.9), _RANK.format(1.0), f"(select round(count(*) filter ({cq._SUB} is not null) / count(*) * 100, 2) from deps where kind = 'contradicts')", "(select round(count(*) filter (doc_id % 10 > 1) / count(*) * 100, 2) from documents)", "(select count(*) from documents where doc_id % 10 = 0)"]
_add("l3_claim_metrics", _l3, f"{_CD}, {_Q} " + " union all ".join(f"select 'claims' section, 'claims.{n}' as name, ({v})::double as value" + ("" if v.startswith("(select") else " from claims") for n, v in zip(_L3, _L3V, strict=True)) + " union all " + " union all ".join(f"select 'empty', 'claims.{n}', {'0' if n == 'total' else 'null'}" for n in _L3))


def _l4(s: SparkSession, d: str) -> DataFrame:
    p = fq.pairs(s, d).select(F.when(F.col("kind") == "supports", "pair").when(F.col("kind") == "contradicts", "cross-video").when(F.col("kind") == "presupposes", "broken-presupposition").otherwise("manual").alias("kind"), F.when(F.col("left").like("%2"), "DEBUNKS").alias("verdict"))
    v = _D(s, d).select(fx._pick(["LOGICAL-CONTRADICTION", "DEBUNKS", "UNDERCUTS", "ALTERNATIVE", "COMPLEMENTARY", "IRRELEVANT", "SAME-CLAIM"], F.length("source")).alias("verdict"), F.when(F.col("source").like("%5"), "operator").otherwise("ai").alias("by"))
    return ql.contradiction_metrics(p, v, fx.table(s, d, "nation"), cq.vectors(s, d))


_V7 = list(ql.VERDICT_NAMES.items())
_add(
    "l4_contradiction_metrics",
    _l4,
    f"{_CD}, {cq._VEC}, w as (select ['LOGICAL-CONTRADICTION', 'DEBUNKS', 'UNDERCUTS', 'ALTERNATIVE', 'COMPLEMENTARY', 'IRRELEVANT', 'SAME-CLAIM'][1 + length(source) % 7] v, source from deps), m as (select 'contradictions.total' n, count(*) v from deps union all select 'contradictions.pair', count(*) from deps where kind = 'supports' union all select 'contradictions.crossVideo', count(*) from deps where kind = 'contradicts' union all select 'contradictions.brokenPresupposition', count(*) from deps where kind = 'presupposes' union all select 'contradictions.pendingVerify', count(*) from deps where kind in ('supports', 'contradicts') and source not like '%2' union all select 'verdicts.total', count(*) from w union all "
    + " union all ".join(f"select 'verdicts.{n}', count(*) from w where v = '{k}'" for k, n in _V7)
    + " union all select 'verdicts.operator', count(*) from w where source like '%5' union all select 'consonance.count', count(*) from nation union all select 'embeddings.cached', count(*) from ve union all select 'embeddings.dimensions', max(len(vec)) from ve) select 'contradictions' section, n as name, v::double as value from m",
)
_add("l5_correction_metrics", lambda s, d: ql.correction_metrics({"display": fx.table(s, d, "nation"), "notSame": eq.not_same(s, d), "claimDeletions": cq._deleted(s, d)}), f"{_CD}, {eq._FIX.removeprefix(fx.LI + ', ')} select 'operator-corrections' section, 'corrections.' || n as name, v::double as value from (select 'displayOverrides' n, count(*) v from nation union all select 'notSamePairs', count(*) from ns union all select 'claimDeletions', count(*) from claims where l_orderkey % 17 = 0 and l_linenumber = 3 union all select unnest(['claimTruthOverrides', 'claimFieldOverrides', 'contradictionDismissals', 'customContradictions', 'dismissedClusters', 'deletedRelations']), 0)")
_add("l6_counted_percentiles", lambda s, d: ql.percentiles(_quotes(s, d), ["video_id"], "length", {"p50": 0.5, "p90": 0.9}), f"{_CD}, {_Q}, r as (select video_id, l, row_number() over (partition by video_id order by l) - 1 r, count(*) over (partition by video_id) n from qu) select video_id, max(l) filter (r = least(n - 1, floor(n * 0.5)))::int p50, max(l) filter (r = least(n - 1, floor(n * 0.9)))::int p90 from r group by 1")
_add("l7_percentages", lambda s, d: _C(s, d).groupBy("video_id").agg(ql.percent(F.count_if(F.col("stance") == "denies"), F.count("truth")).alias("denied")), f"{_CD} select video_id, {_PCT.format('count(*) filter (stance = $$denies$$)', 'count(truth)')}::double denied from claims group by 1")
_add("l9_frozen_baseline", lambda s, d: ql.frozen(_l3(s, d).where("section = 'empty'").union(_l4(s, d).where("name like 'consonance%'"))), "select 'claims.total' as name, 0.0::double as value union all select 'consonance.count', count(*) from nation")
_BAND = "case when truth is null then 'none' when truth < 0.3 then 'low' when truth <= 0.7 then 'middle' else 'high' end"
_add("l10_corpus_fingerprint", lambda s, d: ql.corpus_fingerprint(_C(s, d), _quotes(s, d)), f"{_CD}, {_Q} select 'quote-length' part, 'p50' bucket, {_RANK.format(0.5)}::bigint n union all select 'quote-length', 'p90', {_RANK.format(0.9)} union all select 'quote-length', 'max', {_RANK.format(1.0)} union all select 'kind', kind, count(*) from claims group by 2 union all select 'stance', stance, count(*) from claims group by 2 union all select 'truth', {_BAND}, count(*) from claims group by 2 union all select 'day', strftime(published, '%Y-%m-%d'), count(*) from claims group by 2 union all select 'compound', 'per-thousand', floor(count(*) filter (regexp_matches(lower(text), '\\b(and|but|because|while)\\b|;')) * 1000 / count(*))::bigint from claims")


def _l11(s: SparkSession, d: str) -> DataFrame:
    against = _D(s, d).where("kind = 'contradicts'").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return s.createDataFrame([(i, v) for i, v in enumerate(ql.representative_sample(_C(s, d), against, 6, ["v7"]))], "place int, video_id string")


_add("l11_representative_sample", _l11)


def _l12(s: SparkSession, d: str) -> DataFrame:
    gold = ql.document_shape(_C(s, d), _D(s, d), _quotes(s, d))
    now = _C(s, d).where("video_id <> 'v7' and l_orderkey % 3 <> 0")
    return ql.gold_check(gold, ql.document_shape(now, _D(s, d).where("source like '%2'"), _quotes(s, d).withColumn("length", F.col("length") * 3)))


_SHAPE = "select c.video_id, c.n, c.d, coalesce(k, 0) k, coalesce(p50, 0) p50 from (select video_id, count(*) n, count(*) filter (stance = 'denies') d from claims where {0} group by 1) c left join (select video_id, count(*) k from deps where kind = 'contradicts' and {1} group by 1) x using (video_id) left join pq using (video_id)"
_add("l12_gold_check", _l12, f"{_CD}, {_Q}, {_P50}, g as ({_SHAPE.format('true', 'true')}), u as ({_SHAPE.format(chr(39).join(['video_id <> ', 'v7', ' and l_orderkey % 3 <> 0']), chr(39).join(['source like ', '%2', '']))}) select g.video_id, case when u.video_id is null then 'missing' when u.n < g.n * 0.7 or u.p50 * 3 > g.p50 * 2 and g.p50 > 0 or u.d < g.d / 2 or u.k < g.k / 2 then 'regressed' else 'ok' end status, case when u.video_id is null then '' else concat_ws(',', case when u.n < g.n * 0.7 then 'claims' end, case when u.p50 * 3 > g.p50 * 2 and g.p50 > 0 then 'p50' end, case when u.d < g.d / 2 then 'denies' end, case when u.k < g.k / 2 then 'contradicts' end) end reasons from g left join u using (video_id)")


# K
def rows(s: SparkSession, d: str) -> DataFrame:
    """The catalogue with stages, keywords, description and a transcript path."""
    c = fx.catalog(s, d)
    k = F.substring("video_id", 2, 20).cast("long")
    stages = F.map_from_entries(F.filter(F.array(*[F.when(k % m != 0, F.struct(F.lit(n).alias("key"), F.lit(1).alias("value"))) for n, m in (("fetched", 97), ("nlp", 5), ("claims", 4))]), lambda x: x.isNotNull()))
    return c.withColumns({"k": k, "stages": stages, "keywords": F.array(F.concat(F.lit("tag"), k % 9)), "description": F.concat(F.lit("about "), k % 13), "transcript_path": F.when(k % 3 != 0, F.concat(F.lit("/t/"), k))})


_RO = f"{fx.CATALOG}, ro as (select *, video_id[2:]::bigint k from catalog)"
_add("k1_filtered_rows", lambda s, d: kt.filtered(rows(s, d), "1-URGENT", None, "pending", ["fetched", "nlp"]).select("video_id"), f"with {_RO} select video_id from ro where channel = '1-URGENT' and status <> 'pending' and (k % 97 = 0 or k % 5 = 0)")
_add("k2_text_match", lambda s, d: kt.text_match(rows(s, d), " About 12").select("video_id"), f"with {_RO} select video_id from ro where contains(lower(concat_ws(' ', title, video_id, channel, 'tag' || k % 9, 'about ' || k % 13)), 'about 12')")
_add("k3_entity_matches", lambda s, d: kt.with_entity_matches(rows(s, d), kt.text_match(rows(s, d), "tag3"), fx.relationships(s, d).select(F.col("object_id").alias("entity_id"), F.col("object_id").alias("canonical"), F.col("transcript_id").alias("video_id")), "S3").select("video_id"), f"with {_RO}, {fx.REL} select video_id from ro where contains(lower(concat_ws(' ', title, video_id, channel, 'tag' || k % 9)), 'tag3') or status = 'fetched' and video_id in (select transcript_id from rel where contains(object_id, 's3'))")


def _k5(s: SparkSession, d: str) -> DataFrame:
    p, n = kt.page_with_total(rows(s, d), 2, 500)
    return p.select("video_id", "rank", F.lit(n).cast("long").alias("total"))


_add("k5_page_with_total", _k5, f"with {_RO} select video_id, row_number() over (order by published desc nulls last, video_id)::int rank, count(*) over ()::bigint total from ro qualify rank between 201 and 400")
_NAT = "case when {0} is null then '' else regexp_replace({0}, '[0-9]+$', '') || lpad(regexp_extract({0}, '([0-9]+)$'), 18, '0') end"
_add("k6_column_sort", lambda s, d: kt.column_sorted(rows(s, d), "transcript_path", False, 50).select("video_id").union(kt.column_sorted(rows(s, d), "transcript_path", True, 50).select("video_id")), f"with {_RO}, t as (select video_id, case when k % 3 <> 0 then '/t/' || k end p from ro) select video_id from (select video_id from t order by p is null, {_NAT.format('p')}, video_id limit 50) union all select video_id from (select video_id from t order by p is null desc, {_NAT.format('p')} desc, video_id limit 50)")
_add("k7_suggestions", lambda s, d: kt.suggestions(eq.cu.autocomplete(eq.cu.corpus(eq.named(s, d)), eq.handled(s, d).limit(0), "ring", None, 100_000), kt.text_match(rows(s, d), "tag5").orderBy("video_id").limit(9)), f"with {eq._FIX}, {_RO} select 'entity' section, entity_id id, (select count(*) from co where contains(lower(canonical), 'ring'))::bigint total from (select entity_id from co where contains(lower(canonical), 'ring') order by total desc, entity_id limit 8) union all select 'document', video_id, 9 from (select video_id from ro where k % 9 = 5 order by video_id limit 6)")


def _failures(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "events").select(F.concat(F.lit("v"), F.col("user_id") * 2).alias("video_id"), fx._pick(["timeout", "removed", "no-captions", "http"], F.col("event_id")).alias("reason"), F.concat(F.lit("m"), "event_id").alias("message"), F.col("event_id").alias("seq"))


_FAIL = "lf as (select 'v' || user_id * 2 video_id, max(event_id) e from events group by 1)"
_add("k9_classified_failures", lambda s, d: kt.classified_failures(rows(s, d), _failures(s, d)).select("video_id", "status", "last_error", "error_reason"), f"with {_RO}, {_FAIL} select ro.video_id, case when e is null then status when e % 4 in (1, 2) then 'failed-needs-user' else 'failed-retryable' end status, coalesce('m' || e, last_error) last_error, ['timeout', 'removed', 'no-captions', 'http'][1 + e % 4] error_reason from ro left join lf on lf.video_id = ro.video_id")
_add("k10_ingest_candidates", lambda s, d: kt.ingest_candidates(kt.classified_failures(rows(s, d), _failures(s, d))).select("video_id"), f"with {_RO}, {_FAIL} select ro.video_id from ro left join lf on lf.video_id = ro.video_id where e is null and status = 'pending' or e % 4 not in (1, 2)")
_add("k12_cleared_stages", lambda s, d: kt.cleared_stages(rows(s, d), ["fetched", "nlp"]).select("video_id", "status", F.size("stages").cast("long").alias("stages")), f"with {_RO} select video_id, 'pending' status, (k % 4 <> 0)::bigint stages from ro")
_add("k12_cleared_paths", lambda s, d: kt.cleared_paths(rows(s, d), rows(s, d).where("k % 7 <> 0").select(F.col("transcript_path").alias("path"))).select("video_id", "transcript_path"), f"with {_RO} select video_id, case when k % 3 <> 0 and k % 7 <> 0 then '/t/' || k end transcript_path from ro")
_add("k13_stage_histogram", lambda s, d: kt.stage_histogram(rows(s, d)), f"with {_RO} select 'fetched' stage, count(*)::bigint n from ro where k % 97 <> 0 union all select 'nlp', count(*) from ro where k % 5 <> 0 union all select 'claims', count(*) from ro where k % 4 <> 0")


def _files(s: SparkSession, d: str) -> DataFrame:
    r = rows(s, d)
    return r.where("k % 4 <> 0").select("video_id", F.lit("transcript").alias("what"), (F.col("k") % 6).alias("at")).union(r.where("k % 5 <> 0").select("video_id", F.lit("nlp"), F.lit(3).cast("long")))


_add("k14_state_audit", lambda s, d: kt.state_audit(rows(s, d), _files(s, d)), f"with {_RO}, a as (select video_id, status, case when k % 4 = 0 then 'missing' else 'present' end transcript, case when k % 5 = 0 then 'missing' when k % 4 <> 0 and k % 6 > 3 then 'stale' else 'present' end nlp from ro) select *, nlp = 'stale' or status = 'fetched' and (transcript = 'missing' or nlp = 'missing') suspicious from a")
_add("k16_graph_stages", lambda s, d: kt.graph_stale(fx.table(s, d, "nation").select(F.col("n_name").alias("stage"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey").cast("int")).alias("at")), fx.table(s, d, "nation").where("n_nationkey < 11").select(F.col("n_nationkey").cast("int").alias("at"))), "select n_name stage, case when n_nationkey % 4 <> 0 then n_nationkey::int end \"at\", n_nationkey % 4 = 0 or n_nationkey < 10 stale from nation")


def _k17(s: SparkSession, d: str) -> DataFrame:
    plan = more._state(s, d).where("stale and satisfied").select("video_id", "stage")
    k = F.substring("video_id", 2, 20).cast("long") % 3
    return kt.run_outcomes(plan, plan.where(k != 0).withColumn("ok", k == 1))


_add("k17_run_outcomes", _k17, f"{more._STATE} select stage, case video_id[2:]::bigint % 3 when 0 then 'skipped' when 1 then 'done' else 'failed' end outcome, count(*)::bigint n from st where stale and satisfied group by 1, 2")
_add("k18_behind_upstream", lambda s, d: kt.behind_upstream(fx.catalog(s, d), fx.catalog(s, d).where("channel < '3'").groupBy("channel").agg(F.date_add(F.max("published"), 2).alias("published"))), f"with {fx.CATALOG} select channel, max({{'p': published, 'v': video_id}}).v video_id, max(published) published, channel < '3' behind from catalog where published is not null group by 1")
_add("k19_stale_indexes", lambda s, d: kt.stale_indexes(fx.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("at")), fx.table(s, d, "region").select((F.col("r_regionkey") * 3).cast("int").alias("at"))), "select n_name as name, n_nationkey::int \"at\", n_nationkey >= (select max(r_regionkey) * 3 from region) fresh from nation")


# M
def _utterances(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "events").select(F.when(F.col("user_id") % 3 == 0, "loud").otherwise(F.col("user_id").cast("string")).alias("speaker"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", -0.03).when(F.col("event_type") == "purchase", 0.25).otherwise(0.0).alias("weight"))


_add(
    "m2_speaker_scores_in_ranges",
    lambda s, d: sc.speaker_scores(_utterances(s, d), 64),
    "with u as (select case when user_id % 3 = 0 then 'loud' else user_id::varchar end speaker, event_id seq, case event_type when 'click' then -0.03 when 'purchase' then 0.25 else 0 end::double w from events) select speaker, count(*)::bigint utterances, round(list_reduce(list_prepend(0.7::double, list(w order by seq)), lambda s, x: greatest(0, least(1, s + (0.5 - s) * 0.05 + x))), 6) score from u group by 1",
)


def _m4(s: SparkSession, d: str) -> DataFrame:
    said = fx.table(s, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("speaker"), F.col("turn").alias("seq"), F.replace("text", F.lit(" "), F.lit(" _")).alias("text"))
    names = fx.table(s, d, "customer").select(F.concat(F.lit("person:c"), "c_custkey").alias("entity_id"), fx._pick(["_that", "dans", "_nicht", "_para", "thing"], F.col("c_custkey")).alias("canonical"))
    return sc.graph_contradictions(said, fx.relationships(s, d), names)


_add("m4_graph_contradictions", _m4, f"with {fx.REL}, h as (select ['_that', 'dans', '_nicht', '_para', 'thing'][1 + c_custkey % 5] tok, min(rel_id) r from rel join customer on subject_id = 'person:c' || c_custkey where direct_truth < 0.5 group by 1), u as (select distinct conv_id || '/' || role speaker, turn seq, unnest([x for x in string_split_regex(lower(coalesce(replace(text, ' ', ' _'), '')), '[^a-z0-9_]+') if length(x) > 3]) tok from conversations) select speaker, seq, min(r) rel_id, -0.2::double weight from u join h using (tok) group by 1, 2")


def _m5(s: SparkSession, d: str) -> DataFrame:
    """The stream over all events as files, one batch after the other, read back from its sink: each speaker's last score."""
    from attestra.plans.source_queries import scratch

    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = scratch(s, "utterances"), scratch(s, "scores")
    _utterances(s, d).repartition(1).sortWithinPartitions("seq").write.parquet(src)
    stream = s.readStream.schema("speaker string, seq long, weight double").parquet(src)
    sc.run_scores(stream, [sc.parquet_sink(out)], scratch(s, "state")).awaitTermination()
    return s.read.parquet(out).groupBy("speaker").agg(F.count(F.lit(1)).alias("utterances"), F.round(F.max_by("score", "seq"), 6).alias("score"))


_add("m5_m6_streamed_scores", _m5, SQL["m2_speaker_scores_in_ranges"])


def _m7(s: SparkSession, d: str) -> DataFrame:
    old = fx.relationships(s, d)
    new = old.where("not (transcript_id = 'v7' and char_start < 300)").withColumn("predicate", F.when(F.col("transcript_id") == "v9", "endorses").otherwise(F.col("predicate")))
    from attestra.operators import graph as gr

    return sc.refreshed_edges(gr.edges(old), new, old.where("transcript_id in ('v7', 'v9')").select("transcript_id", "subject_id", "predicate", "object_id"))


_add("m7_refreshed_edges", _m7, f"with {fx.REL} select subject_id, case when transcript_id = 'v9' then 'endorses' else predicate end predicate, object_id, count(*)::bigint n from rel where not (transcript_id = 'v7' and char_start < 300) group by 1, 2, 3")
