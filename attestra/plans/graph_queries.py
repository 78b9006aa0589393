"""Registered queries of graph building, graph questions and truth from verdicts, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import building as bd
from attestra.operators import graph as gr
from attestra.operators import loops as lo
from attestra.operators.components import ensure_checkpoints
from attestra.operators.substrings import SubstringIndex
from attestra.plans import fixtures as fx
from attestra.plans import text_queries as tq

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


_rel = fx.relationships
_R = f"with {fx.REL}"


# Mentions and the edges between those that follow each other
def _mentions(s: SparkSession, d: str) -> DataFrame:
    return tq.mentions(s, d).withColumn("canonical", F.when(F.length("surface") > 9, F.substring("surface", 1, 9)))


def _doc_edges(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("start")
    m = tq.mentions(s, d).select("video_id", F.col("mention_id").alias("subject_mention_id"), F.lead("mention_id").over(w).alias("object_mention_id"), fx._pick(["met_with", "works_for", "located_in", "accused_of"], F.length("surface")).alias("predicate"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), (F.col("start") / 10.0).alias("time_start"))
    return m.where("object_mention_id is not null").withColumn("edge_id", F.concat(F.lit("r"), "subject_mention_id")).withColumn("score", F.lit(0.5))


def _keys(m: DataFrame) -> DataFrame:
    return m.select(F.concat_ws(":", "label", F.lower(F.coalesce("canonical", "surface"))).alias("k")).distinct()


def _no_merges(s: SparkSession) -> DataFrame:
    return s.createDataFrame([], "video_id string, source string, target string")


def resolved(s: SparkSession, d: str) -> DataFrame:
    """Mentions, made once, resolved by chains and deletions of their keys."""
    ensure_checkpoints(s)
    m = _mentions(s, d).checkpoint()
    closed = _keys(m).where("k like '%s'").select(F.col("k").alias("source"), F.expr("substring(k, 1, length(k) - 1)").alias("final"))
    return bd.mention_entities(m, _no_merges(s), closed, _keys(m).where("k like '%ing'").select(F.col("k").alias("entity_id")))


_RES = f"""{tq._DOCS}, {tq._TOKS}, {tq._MEN.replace(" me as (", " me as materialized (", 1).replace("me as (", "me as materialized (", 1) if tq._MEN.startswith("me as (") else tq._MEN.replace(" me as (", " me as materialized (", 1)}, m2 as (select *, case when length(surface) > 9 then surface[1:9] else surface end c from me), m3 as (select *, label || ':' || lower(c) k from m2), rs as materialized (select * from (select *, case when k like '%s' then k[1:length(k) - 1] else k end entity_id from m3) where not exists (from (select distinct k from m3 where k like '%ing') x where x.k = entity_id)),
eg as materialized (select video_id, mention_id sm, lead(mention_id) over (partition by video_id order by start) om, ['met_with', 'works_for', 'located_in', 'accused_of'][1 + length(surface) % 4] predicate, start, "end" from me),
dr as (select eg.*, a.entity_id s, b.entity_id o from eg join rs a on a.video_id = eg.video_id and a.mention_id = sm join rs b on b.video_id = eg.video_id and b.mention_id = om where a.entity_id <> b.entity_id)"""
_OK = "(predicate not in ('met_with', 'works_for', 'located_in') or predicate = 'met_with' and split_part(s, ':', 1) in ('person', 'organization') and split_part(o, ':', 1) in ('person', 'organization') or predicate = 'works_for' and split_part(s, ':', 1) = 'person' and split_part(o, ':', 1) = 'organization' or predicate = 'located_in' and split_part(s, ':', 1) <> 'technology' and split_part(o, ':', 1) in ('location', 'facility'))"
_add(
    "f1_document_entities",
    lambda s, d: bd.document_entities(resolved(s, d), s.createDataFrame([("person:and", "AND")], "entity_id string, name string")).select("video_id", "entity_id", "type", "canonical", F.array_join("aliases", ",").alias("aliases"), F.size("spans").cast("long").alias("spans")),
    f"with {_RES} select video_id, entity_id, min(label) as type, case when entity_id = 'person:and' then 'AND' else arg_min(c, start) end canonical, coalesce(string_agg(distinct case when surface <> c then surface end, ',' order by case when surface <> c then surface end), '') aliases, count(*)::bigint spans from rs group by 1, 2",
)
_add("f2_document_relations", lambda s, d: bd.relation_id(bd.document_relations(_doc_edges(s, d), resolved(s, d))).select("rel_id", "edge_id"), f"with {_RES} select s || '|' || predicate || '|' || o || '|' || video_id || ':' || start || '-' || \"end\" rel_id, 'r' || sm edge_id from dr where {_OK}")
_add("f13_graph_edges_of_document_edges", lambda s, d: bd.document_relations(_doc_edges(s, d), resolved(s, d), None, False).select("video_id", "edge_id", F.concat_ws("|", "subject_id", "predicate", "object_id").alias("edge")), f"with {_RES} select video_id, 'r' || sm edge_id, s || '|' || predicate || '|' || o edge from dr")


def _f16(s: SparkSession, d: str) -> DataFrame:
    """Without overrides."""
    none = s.createDataFrame([], "source string, final string"), s.createDataFrame([], "entity_id string")
    rows = bd.mention_entities(_mentions(s, d), _no_merges(s), *none)
    return bd.document_relations(_doc_edges(s, d), rows, None, False).groupBy("subject_id", "predicate", "object_id").agg(F.count(F.lit(1)).alias("n"))


_add("f16_display_graph", _f16, f"with {_RES} select a.k subject_id, predicate, b.k object_id, count(*)::bigint n from eg join m3 a on a.video_id = eg.video_id and a.mention_id = sm join m3 b on b.video_id = eg.video_id and b.mention_id = om where a.k <> b.k group by 1, 2, 3")

# F4, F6-F10, F14, F15
_bent = lambda s, d: _rel(s, d).withColumn("char_end", F.when(F.col("char_start") == 300, F.col("char_start")).otherwise(F.col("char_end")))
_add("f4_rejected_relations", lambda s, d: bd.well_formed(_bent(s, d))[1].select("rel_id").distinct(), f"{_R} select distinct rel_id from rel where char_start = 300")


def _f6(s: SparkSession, d: str) -> DataFrame:
    p = fx.table(s, d, "part")
    one = lambda mod, name: p.where(f"p_partkey % {mod} = 0").select(F.concat(F.lit("thing:"), "p_partkey").alias("entity_id"), F.concat("p_name", F.lit(name)).alias("canonical"), F.array("p_type", "p_brand" if mod == 3 else "p_type").alias("aliases"), F.array(F.struct(F.lit(mod).alias("start"), F.col("p_size").alias("end"))).alias("spans"))
    return bd.upserted_entities(one(2, " old"), one(3, " new")).select("entity_id", "canonical", F.array_join("aliases", ",").alias("aliases"), F.size("spans").cast("long").alias("spans"))


_add("f6_entity_upsert", _f6, "select 'thing:' || p_partkey entity_id, p_name || case when p_partkey % 2 = 0 then ' old' else ' new' end canonical, case when p_partkey % 3 <> 0 then p_type when p_type < p_brand then p_type || ',' || p_brand else p_brand || ',' || p_type end aliases, (case when p_partkey % 6 = 0 then 2 else 1 end)::bigint spans from part where p_partkey % 2 = 0 or p_partkey % 3 = 0")
_add("f7_unknown_evidence", lambda s, d: bd.known_evidence(_rel(s, d), fx.table(s, d, "orders").where("o_orderkey % 500 <> 7").select(F.concat(F.lit("v"), F.col("o_orderkey") % 500).alias("video_id")))[1].select("rel_id").distinct(), f"{_R} select distinct rel_id from rel where transcript_id = 'v7'")
_add("f8_selected_relations", lambda s, d: bd.select_relations(_rel(s, d), "organization:s3", "denies").select("rel_id", "transcript_id"), f"{_R} select rel_id, transcript_id from rel where 'organization:s3' in (subject_id, object_id) and predicate = 'denies'")
_ENDS = "en as (select subject_id entity_id, transcript_id, char_start from rel union all select object_id, transcript_id, char_start from rel)"
_add("f9_entity_index_of_both_ends", lambda s, d: bd.entity_index(_rel(s, d)), f"{_R}, {_ENDS} select entity_id, count(distinct transcript_id)::bigint documents, count(*)::bigint mentions from en group by 1")
_add("f10_entity_documents_of_both_ends", lambda s, d: bd.entity_documents(_rel(s, d)).withColumn("spans", F.array_join(F.col("spans").cast("array<string>"), ",")), f"{_R}, {_ENDS} select entity_id, transcript_id, array_to_string(list_sort(list_distinct(list(char_start)))::varchar[], ',') spans from en group by 1, 2")


def _answers(s: SparkSession, d: str) -> DataFrame:
    c = fx.cues(s, d)
    k = F.col("cue_idx")
    one = F.struct(F.lit("person:a").alias("subjectId"), F.lit("thing:b").alias("objectId"), F.when(k % 3 == 0, "denies").when(k % 3 == 1, "endorses").otherwise("likes").alias("predicate"), F.when(k % 5 == 4, k + 100_000).otherwise(k).alias("cueIndex"), F.when(k % 7 != 6, k / 4.0 - 0.5).alias("confidence"))
    text = F.when(k % 11 == 10, F.replace(F.to_json(one), F.lit('"person:a"'), F.lit("5"))).when(k % 13 == 12, F.regexp_replace(F.to_json(one), r'"cueIndex":(\d+)', '"cueIndex":"$1"')).otherwise(F.to_json(one))
    body = c.groupBy("video_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit(', null, 7]')).alias("json"))
    return body.withColumn("json", F.when(F.col("video_id").like("%3"), "no json").otherwise(F.col("json")))


_add(
    "f14_external_edges",
    lambda s, d: bd.external_edges(_answers(s, d), fx.cues(s, d), ["denies", "endorses"]).select("rel_id", "time_start", "time_end", "confidence", "provenance"),
    f"with {fx.CUES}, c as (select *, coalesce(sum(length(text) + 1) over (partition by video_id order by cue_idx rows between unbounded preceding and 1 preceding), 0)::int s from cues) select 'person:a|' || case when cue_idx % 3 = 0 then 'denies' else 'endorses' end || '|thing:b|' || video_id || ':' || s || '-' || (s + length(text)) rel_id, cue_idx * 4.0::double time_start, cue_idx * 4.0::double + 4 time_end, greatest(0, least(1, cue_idx / 4.0 - 0.5))::double confidence, 'ai' provenance from c where video_id not like '%3' and cue_idx % 3 < 2 and cue_idx % 5 < 4 and cue_idx % 7 < 6 and cue_idx % 11 < 10 and cue_idx % 13 < 12",
)
_add(
    "f14_faults_of_answers",
    lambda s, d: bd.answered_edges(_answers(s, d), ["denies", "endorses"]).groupBy("video_id").agg(F.count("fault").alias("faults"), F.count(F.lit(1)).alias("edges")),
    f"with {fx.CUES} select video_id, 2 + count(*) filter (cue_idx % 3 = 2 or cue_idx % 7 = 6 or cue_idx % 11 = 10 or cue_idx % 13 = 12)::bigint faults, 2 + count(*)::bigint edges from cues where video_id not like '%3' group by 1",
)
_add(
    "f15_enrichment_input",
    lambda s, d: bd.enrichment_input(resolved(s, d), fx.cues(s, d)).select("video_id", F.sha1(F.array_join("entities", ",")).alias("entities"), F.size("cues").cast("long").alias("cues"), F.get("cues", F.lit(0))["text"].alias("first")),
    f"with {_RES}, {fx.CUES}, e as (select video_id, string_agg(distinct entity_id, ',' order by entity_id) es from rs group by 1) select c.video_id, sha1(coalesce(any_value(es), '')) entities, count(*)::bigint cues, arg_min(c.text, cue_idx) as first from cues c left join e on e.video_id = c.video_id group by 1",
)


# G
def _entities(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "part").select(F.concat(F.lit("thing:p"), "p_partkey").alias("entity_id"), F.lit("thing").alias("type"), "p_name", F.concat("p_name", F.lit(" "), F.col("p_partkey") % 10).alias("canonical"), F.array("p_type").alias("aliases"), F.col("p_size").alias("mentions"))


_EN = "with e as (select 'thing:p' || p_partkey entity_id, p_name || ' ' || p_partkey % 10 canonical, p_type, p_size mentions from part)"
_SCORE = "case when canonical = '{q}' then 3 when contains(canonical, '{q}') then 2 when contains(lower(p_type), '{q}') then 1 end"
_add("g1_entity_search", lambda s, d: bd.search_entities(_entities(s, d), " Eco ", 30).select("entity_id", "score", "matched_on"), f"{_EN} select entity_id, s score, case when s >= 2 then 'canonical' else 'alias' end matched_on from (select *, {_SCORE.format(q='eco')} s from e) where s is not null order by s desc, canonical, entity_id limit 30")
_add("g4_index_search", lambda s, d: bd.search_index(_entities(s, d), "ring", "thing", ("role",), 500).select("entity_id", "position", "mentions"), f"{_EN} select entity_id, instr(canonical, 'ring')::int as position, mentions from e where contains(canonical, 'ring') order by position, mentions desc, canonical, entity_id limit 200")
_some = lambda s: s.createDataFrame([("organization:s1",), ("person:c7",)], "entity_id string")
_LINK = "'https://watch.example/' || transcript_id || '?t=' || floor(time_start)::bigint"
_add("g5_g15_entity_pages", lambda s, d: bd.entity_page(_rel(s, d), _some(s)), f"{_R} select entity_id, predicate, rel_id, counterpart, link from (select subject_id entity_id, predicate, rel_id, object_id counterpart, {_LINK} link from rel union all select object_id, predicate, rel_id, subject_id, {_LINK} from rel) where entity_id in ('organization:s1', 'person:c7')")


def _g8(s: SparkSession, d: str) -> DataFrame:
    e = gr.nodes(_rel(s, d)).select("entity_id", F.col("entity_id").alias("canonical"), F.array().cast("array<string>").alias("aliases"))
    return bd.lookup(e, _rel(s, d), "person:c1", 5).select("entity_id", "score", "rel_id", "counterpart")


_add("g8_lookup_report", _g8, f"{_R}, h as (select *, case when e = 'person:c1' then 3 else 2 end score from (select distinct subject_id e from rel where contains(subject_id, 'person:c1')) order by score desc, e limit 5) select e entity_id, score, rel_id, object_id counterpart from h join rel on subject_id = e")
_EDGE = "ed as (select subject_id, predicate, object_id, count(*)::bigint n from rel group by all)"
_add("g9_neighbour_edges", lambda s, d: bd.neighbour_edges(gr.edges(_rel(s, d)), 5, 2), f"{_R}, {_EDGE}, b as (select subject_id entity_id, object_id other, predicate, n from ed union all select object_id, subject_id, predicate, n from ed) select *, row_number() over (partition by entity_id order by n desc, other, predicate)::int rank from b qualify rank between 3 and 7")


def _sliced(s: SparkSession, d: str) -> DataFrame:
    t = _rel(s, d).groupBy("subject_id", "predicate", "object_id").agg(F.count(F.lit(1)).alias("n"), F.max("direct_truth").alias("truth"))
    n, e = bd.view_slice(gr.nodes(_rel(s, d)).where("weight > 20"), t, ["person", "organization"], ["denies", "endorses"], 0.3)
    return e.select(F.concat_ws("|", "subject_id", "predicate", "object_id").alias("item"), F.col("n").alias("size")).union(n.select("entity_id", "weight"))


_add("g12_g13_view_slice", _sliced, f"{_R}, nd as (select e, count(*)::bigint w from (select subject_id e from rel union all select object_id from rel) group by 1 having count(*) > 20), ed as (select subject_id, predicate, object_id, count(*)::bigint n, max(direct_truth) t from rel group by all), sl as (select * from ed where predicate in ('denies', 'endorses') and coalesce(t, 0) >= 0.3 and subject_id in (select e from nd) and object_id in (select e from nd)) select subject_id || '|' || predicate || '|' || object_id item, n as size from sl union all select e, w from nd where e in (select subject_id from sl union select object_id from sl)")
_add("g14_one_hop_of_seeds", lambda s, d: bd.one_hop(gr.edges(_rel(s, d)), _some(s)), f"{_R}, {_EDGE} select * from ed where subject_id in ('organization:s1', 'person:c7') or object_id in ('organization:s1', 'person:c7')")


def _g17(s: SparkSession, d: str) -> DataFrame:
    both = gr.edges(_rel(s, d)).union(gr.edges(_rel(s, d)).where("n > 1").select("object_id", "predicate", "subject_id", "n"))
    truth = _rel(s, d).where("direct_truth is not null").groupBy("subject_id", "predicate", "object_id").agg(F.max("direct_truth").alias("truth"))
    turned = truth.where("predicate = 'denies'").select(F.col("object_id").alias("subject_id"), "predicate", F.col("subject_id").alias("object_id"), F.lit(0.9).alias("truth"))
    return bd.truth_overlay(both, truth.union(turned)).withColumn("truth", F.round("truth", 6))


_add("g17_truth_overlay", _g17, f"{_R}, {_EDGE}, t as (select subject_id, predicate, object_id, max(direct_truth) t from rel where direct_truth is not null group by all) select least(ed.subject_id, ed.object_id) lo, ed.predicate, greatest(ed.subject_id, ed.object_id) hi, (case when n > 1 then 2 * n else n end)::bigint n, round(case when ed.predicate = 'denies' then (t + 0.9) / 2 else t end, 6) truth from ed left join t on ed.subject_id = t.subject_id and ed.predicate = t.predicate and ed.object_id = t.object_id")
_add("g18_entity_detail", lambda s, d: bd.entity_detail(_rel(s, d), fx.catalog(s, d), "organization:s3"), f"{_R}, {fx.CATALOG} select transcript_id video_id, published, count(*)::bigint mentions from rel left join catalog on video_id = transcript_id where object_id = 'organization:s3' group by 1, 2")
_add("g19_expanded_seeds", lambda s, d: bd.expanded(gr.edges(_rel(s, d)), gr.nodes(_rel(s, d)), _some(s), 4), f"{_R}, {_EDGE}, nd as (select e, count(*) w from (select subject_id e from rel union all select object_id from rel) group by 1), nb as (select distinct * from (select subject_id a, object_id b from ed union all select object_id, subject_id from ed) where a in ('organization:s1', 'person:c7')), k as (select b from nb join nd on e = b qualify row_number() over (partition by a order by w desc, b) <= 4 union select unnest(['organization:s1', 'person:c7'])) select * from ed where subject_id in (from k) and object_id in (from k)")


def _g20(s: SparkSession, d: str) -> DataFrame:
    types, top = bd.document_panel(_rel(s, d), 3)
    return types.select("transcript_id", F.col("type").alias("item"), "mentions").union(top.select("transcript_id", "rel_id", "rank"))


_add("g20_document_panel", _g20, f"{_R}, {_ENDS} select transcript_id, split_part(entity_id, ':', 1) item, count(*)::bigint mentions from en group by 1, 2 union all select transcript_id, rel_id, rank from (select *, row_number() over (partition by transcript_id order by confidence desc, rel_id) rank from rel) where rank <= 3")


# H1-H3: lines with verdicts put into every third document
def verdict_lines(s: SparkSession, d: str) -> DataFrame:
    k = F.col("cue_idx")
    word = F.when(k % 3 == 0, " Confirmed, not false").when(k % 3 == 1, " debunked?").otherwise(" uncertainly disputed")
    mark = F.when((k == 2) & F.col("video_id").like("%1"), " In conclusion").otherwise("")
    return fx.cues(s, d).withColumn("text", F.concat("text", F.when(k % 2 == 0, word).otherwise(""), mark))


_VC = f"{fx.CUES}, vl as (select video_id, cue_idx, text || case when cue_idx % 2 = 0 then case cue_idx % 3 when 0 then ' Confirmed, not false' when 1 then ' debunked?' else ' uncertainly disputed' end else '' end || case when cue_idx = 2 and video_id like '%1' then ' In conclusion' else '' end as text from cues), bg as (select video_id, coalesce(min(cue_idx) filter (regexp_matches(text, '(?i)\\b(verdict|summary|fact[- ]check|in conclusion|to sum up|final|recap)\\b')), floor(count(*) * 0.85)) b from vl group by 1), " + """
vc as (select video_id, cue_idx, case when regexp_matches(text, '(?i)\\b(?:true|confirmed|verified|accurate|correct)\\b') then 'true' when regexp_matches(text, '(?i)\\b(?:false|debunked|wrong|incorrect|misleading|inaccurate)\\b') then 'false' when regexp_matches(text, '(?i)\\b(?:unclear|unverified|inconclusive|uncertain|disputed)\\b') then 'uncertain' end verdict, text from vl join bg using (video_id) where cue_idx >= b)"""
_add("h1_h2_verdict_cues", lambda s, d: bd.verdict_cues(verdict_lines(s, d)).select("video_id", "cue_idx", "verdict", "score"), f"with {_VC} select video_id, cue_idx, verdict, case verdict when 'true' then 1.0 when 'false' then 0.0 else 0.5 end::double score from vc where verdict is not null")


def _h3(s: SparkSession, d: str) -> DataFrame:
    c = verdict_lines(s, d)
    rel = c.select(F.concat_ws("#", "video_id", "cue_idx").alias("rel_id"), "video_id", "cue_idx")
    return bd.verdict_truth(rel, bd.verdict_cues(c), c)


_T = "list_distinct([x for x in string_split_regex(lower(text), '[^a-z0-9]+') if length(x) > 2])"
_add("h3_verdict_truth", _h3, f"with {_VC}, w as (select video_id, cue_idx, {_T} t from vl), v as (select video_id, cue_idx i, case verdict when 'true' then 1.0 when 'false' then 0.0 else 0.5 end score, {_T} t from vc where verdict is not null) select w.video_id || '#' || w.cue_idx rel_id, arg_max(score, i)::double truth from w join v on v.video_id = w.video_id where len(list_intersect(w.t, v.t)) > 0 and len(list_intersect(w.t, v.t)) / len(list_distinct(list_concat(w.t, v.t))) >= 0.15 group by 1")


# H8-H11
def loop_edges(s: SparkSession, d: str) -> DataFrame:
    """Rings of four parts with a chord; some relations are not held."""
    p = fx.table(s, d, "part")
    k = F.col("p_partkey")
    node = lambda x: F.concat(F.lit("q:"), F.lpad(x.cast("string"), 8, "0"))
    ring = p.select(node(k).alias("subject_id"), F.lit("denies").alias("predicate"), node(F.when(k % 4 == 3, k - 3).otherwise(k + 1)).alias("object_id"), F.concat(F.lit("e"), k).alias("rel_id"), F.when(k % 12 == 5, 0.2).otherwise(0.9).alias("direct_truth"))
    chord = p.where("p_partkey % 4 = 0").select(node(k), F.lit("denies"), node(k + 2), F.concat(F.lit("f"), k), F.lit(0.8))
    back = p.where("p_partkey % 4 = 1 and p_partkey % 3 = 0").select(node(k), F.lit("denies"), node(k - 1), F.concat(F.lit("g"), k), F.lit(0.7))
    return ring.union(chord).union(back).withColumn("truth", F.col("direct_truth"))


_NODE = "'q:' || lpad(({})::varchar, 8, '0')"
_LOOP = f"le as (select {_NODE.format('p_partkey')} s, {_NODE.format('case when p_partkey % 4 = 3 then p_partkey - 3 else p_partkey + 1 end')} o, 'e' || p_partkey id, case when p_partkey % 12 = 5 then 0.2 else 0.9 end t from part union all select {_NODE.format('p_partkey')}, {_NODE.format('p_partkey + 2')}, 'f' || p_partkey, 0.8 from part where p_partkey % 4 = 0 union all select {_NODE.format('p_partkey')}, {_NODE.format('p_partkey - 1')}, 'g' || p_partkey, 0.7 from part where p_partkey % 4 = 1 and p_partkey % 3 = 0), he as (select * from le where t >= 0.5)"
_add(
    "h8_true_loops",
    lambda s, d: lo.true_loops(loop_edges(s, d))[0].select("loop", "length"),
    f"with recursive {_LOOP}, pa(f, l, ids, ns) as (select s, o, [id], [s] from he union all select f, o, list_append(ids, id), list_append(ns, l) from pa join he on s = l where l > f and not list_contains(ns, l)) select distinct array_to_string(list_sort(ids), '#') loop, len(ids)::bigint length from pa where f = l",
)


def long_loop_edges(s: SparkSession, d: str) -> DataFrame:
    """Rings of fifty parts with a chord; every third ring is broken, by derived truth, and some truth is derived only."""
    p, k = fx.table(s, d, "part"), F.col("p_partkey")
    node = lambda x: F.concat(F.lit("q:"), F.lpad(x.cast("string"), 8, "0"))
    broken = (F.floor(k / 50) % 3 == 2) & (k % 50 == 30)
    ring = p.select(node(k).alias("subject_id"), node(F.when(k % 50 == 49, k - 49).otherwise(k + 1)).alias("object_id"), F.concat(F.lit("e"), k).alias("rel_id"), F.when(k % 7 == 3, 0.2).otherwise(0.9).alias("direct_truth"), F.when(broken, 0.3).when(k % 7 == 3, 0.8).alias("derived_truth"))
    chord = p.where("p_partkey % 50 = 10").select(node(k), node(k + 20), F.concat(F.lit("f"), k), F.when(F.floor(k / 50) % 2 == 0, 0.8), F.lit(None).cast("double"))
    return ring.union(chord)


_LONG = f"""ll as (select {_NODE.format('p_partkey')} s, {_NODE.format('case when p_partkey % 50 = 49 then p_partkey - 49 else p_partkey + 1 end')} o, 'e' || p_partkey id, case when (p_partkey // 50) % 3 = 2 and p_partkey % 50 = 30 then 0.3 when p_partkey % 7 = 3 then 0.8 else 0.9 end t from part
  union all select {_NODE.format('p_partkey')}, {_NODE.format('p_partkey + 20')}, 'f' || p_partkey, case when (p_partkey // 50) % 2 = 0 then 0.8 end from part where p_partkey % 50 = 10), he as (select * from ll where t >= 0.5)"""
_add(
    "h8_long_loops",
    lambda s, d: lo.true_loops(long_loop_edges(s, d))[0].select("loop", "length"),
    f"with recursive {_LONG}, pa(f, l, ids, ns) as (select s, o, [id], [s] from he union all select f, o, list_append(ids, id), list_append(ns, l) from pa join he on s = l where l > f and not list_contains(ns, l)) select distinct array_to_string(list_sort(ids), '#') loop, len(ids)::bigint length from pa where f = l",
)
_add(
    "h8_loop_components",
    lambda s, d: lo.loop_components(long_loop_edges(s, d)),
    f"with recursive {_LONG}, re(s, o) as (select s, o from he union select re.s, he.o from re join he on re.o = he.s), c as (select a.s n, min(a.o) component from re a join re b on a.s = b.o and a.o = b.s group by 1) select x.component, count(distinct he.s)::bigint nodes, count(*)::bigint relations from he join c x on he.s = x.n join c y on he.o = y.n and x.component = y.component group by 1",
)


def _h9(s: SparkSession, d: str) -> DataFrame:
    cols = ["subject_id", "predicate", "object_id", "rel_id", "direct_truth"]
    return bd.conflict_report(_rel(s, d).select(cols).union(loop_edges(s, d).select(cols)), 0.2).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("lefts"))


_EXC = " union all ".join(f"select a.r l from x a join x b using (subject_id, object_id) where a.predicate = '{p}' and b.predicate = '{q}'" for p, q in gr.EXCLUSIVE)
_add(
    "h9_conflict_report",
    _h9,
    f"with recursive {fx.REL}, {_LOOP}, t as (select distinct subject_id, predicate, object_id, rel_id, direct_truth v from rel where direct_truth is not null), c as (select a.rel_id l from t a join t b using (subject_id, predicate, object_id) where a.v >= 0.5 and b.v < 0.5), x as (select subject_id, object_id, predicate, min(rel_id) r from rel where direct_truth >= 0.2 group by 1, 2, 3), y as ({_EXC}), ls as (select * from le where t >= 0.2), pa(f, l, ids, ns) as (select s, o, [id], [s] from ls union all select f, o, list_append(ids, id), list_append(ns, l) from pa join ls on s = l where l > f and not list_contains(ns, l)), z as (select distinct array_to_string(list_sort(ids), '#') l from pa where f = l) select 'truth' kind, count(*)::bigint n, count(distinct l)::bigint lefts from c having count(*) > 0 union all select 'exclusive', count(*), count(distinct l) from y having count(*) > 0 union all select 'loop', count(*), count(distinct l) from z having count(*) > 0",
)
_NOVEL = f"""{_R}, en as (select subject_id e, object_id o, rel_id, transcript_id t, confidence c from rel union all select object_id, subject_id, rel_id, transcript_id, confidence from rel), nr as materialized (select distinct e, o m from en), tt as materialized (select distinct e, t from en),
sn as (select x.e a, y.e b, count(*) sn from nr x join nr y using (m) where x.e < y.e group by 1, 2), st as (select x.e a, y.e b, count(*) st from tt x join tt y using (t) where x.e < y.e group by 1, 2),
p0 as materialized (select sn.a, sn.b, sn, coalesce(st, 0) st, 2.0 * sn + coalesce(st, 0) base from sn left join st using (a, b) where not exists (from nr where e = sn.a and m = sn.b) and sn + coalesce(st, 0) >= 2),
mo as (select e, sum(c) c from en group by 1), cut as (select min(base) v from (select base from p0 order by base desc limit 50)), p as materialized (select p0.* from p0 join mo x on x.e = a join mo y on y.e = b, cut where base + 0.1 * (x.c + y.c) >= v - 1e-9),
su as (select a, b, sum(c) s from (select distinct a, b, rel_id, c from p join en on en.e = p.a where exists (from nr where nr.e = p.b and nr.m = en.o) or exists (from tt where tt.e = p.b and tt.t = en.t) union all select distinct a, b, rel_id, c from p join en on en.e = p.b where exists (from nr where nr.e = p.a and nr.m = en.o) or exists (from tt where tt.e = p.a and tt.t = en.t)) group by 1, 2)
select a, b, sn::bigint shared_nodes, st::bigint shared_transcripts, round(coalesce(s, 0), 6) support, round(base + 0.1 * coalesce(s, 0), 6) score, a || ' <-?-> ' || b || '  score=' || round((base + 0.1 * coalesce(s, 0))::decimal(18, 6), 2)::decimal(18, 2) || '  shared=' || sn || '+' || st line from p left join su using (a, b) order by score desc, a, b limit 50"""
_add("h10_h11_novel_links", lambda s, d: bd.novel_links(_rel(s, d)).drop("line"), f"select * exclude (line) from ({_NOVEL})")
_add("h11_novel_lines", lambda s, d: bd.novel_links(_rel(s, d)).select("line"), f"select line from ({_NOVEL})")


# Substring search through an index that a second update changes
def _indexed(s: SparkSession, d: str) -> DataFrame:
    ensure_checkpoints(s)
    index = SubstringIndex(s, f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/names-{uuid.uuid4().hex}", 16)
    names = fx.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    index.update(names)
    k = F.col("key").cast("long")
    index.update(names.where(k % 7 < 2).select("key", F.when(k % 7 == 0, F.concat(F.reverse("text"), F.lit(" Steel")))).toDF("key", "text"))
    return index.search("STEEL").select("key", "position")


_add(
    "g4_indexed_search",
    _indexed,
    "with p as (select p_partkey k, p_name || ' ' || p_type t from part), q as (select k, case when k % 7 = 0 then reverse(t) || ' Steel' else t end t from p where k % 7 <> 1) select k::varchar as key, (strpos(lower(t), 'steel') - 1)::int as position from q where contains(lower(t), 'steel')",
)
