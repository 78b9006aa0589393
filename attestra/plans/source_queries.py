"""Registered queries of readers and writers, each beside its SQL: files are made from the sample tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import reasoning as rs
from attestra.plans import fixtures as fx
from attestra.sources import captions as cp
from attestra.sources import readers as rd
from attestra.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def scratch(s: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share."""
    rs.ensure_checkpoints(s)
    return f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


# A1-A4: a JSON document per document, every ninth one broken
def _transcripts(s: SparkSession, d: str) -> DataFrame:
    cue = F.struct("start", "duration", "text")
    c = fx.cues(s, d).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", cue.alias("cue")))), lambda x: x["cue"]).alias("cues"))
    body = F.to_json(F.struct(F.col("video_id").alias("videoId"), F.lit("en").alias("language"), F.lit("manual").alias("kind"), "cues"))
    whole = F.when(F.substring("video_id", 2, 20).cast("long") % 9 == 0, F.concat(body, F.lit("}{"))).otherwise(body)
    return c.select(F.when(F.substring("video_id", 2, 20).cast("long") % 9 == 1, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(body))


def _a1(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "transcripts")
    _transcripts(s, d).write.text(path)
    rows, _ = rd.read_transcripts(s, path, multi_line=False)
    return rows.select("video_id", "language", "kind", F.size("cues").cast("long").alias("cues"), F.aggregate("cues", F.lit(0), lambda n, c: n + F.length(c["text"])).cast("long").alias("chars"))


_add("a1_transcripts", _a1, f"with {fx.CUES} select video_id, 'en' as language, 'manual' kind, count(*)::bigint cues, sum(length(text))::bigint chars from cues where video_id[2:]::bigint % 9 <> 1 group by 1")


def _span(start: str, end: str) -> F.Column:
    return F.struct(F.col("video_id").alias("transcriptId"), F.col(start).alias("charStart"), F.col(end).alias("charEnd"), F.lit(0.0).alias("timeStart"), F.lit(4.0).alias("timeEnd"))


def _a2(s: SparkSession, d: str) -> DataFrame:
    m = fx.mentions(s, d).withColumn("end", F.col("ordinal") + F.length("surface"))
    one = F.struct(F.format_string("m_%04d", F.col("ordinal") + 1).alias("id"), "label", "surface", F.lower("surface").alias("canonical"), _span("ordinal", "end").alias("span"), F.lit(0.9).alias("score"), F.lit(None).cast("string").alias("derivedFrom"))
    path = scratch(s, "mentions")
    m.groupBy("video_id").agg(F.collect_list(one).alias("mentions")).select(F.to_json(F.struct(F.col("video_id").alias("transcriptId"), "mentions"))).write.text(path)
    return rd.read_mentions(s, path, multi_line=False).select("video_id", "mention_id", "label", "surface", "canonical", F.col("span.charEnd").alias("char_end"), "score", "derived_from")


_add("a2_mentions", _a2, f"with {fx.MENTIONS} select video_id, printf('m_%04d', ordinal + 1) mention_id, label, surface, lower(surface) canonical, (ordinal + length(surface))::int char_end, 0.9::double score, null::varchar derived_from from mentions")


def _a3(s: SparkSession, d: str) -> DataFrame:
    r = fx.relationships(s, d).withColumn("video_id", F.col("transcript_id"))
    one = F.struct(F.concat_ws("|", "rel_id", "provenance").alias("id"), "predicate", F.col("subject_id").alias("subjectMentionId"), F.col("object_id").alias("objectMentionId"), F.col("confidence").alias("score"), _span("char_start", "char_end").alias("evidence"))
    path = scratch(s, "edges")
    r.groupBy("video_id").agg(F.collect_list(one).alias("edges")).select(F.to_json(F.struct(F.col("video_id").alias("transcriptId"), "edges"))).write.text(path)
    return rd.read_edges(s, path, multi_line=False).groupBy("video_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("edge_id").alias("ids"), F.max("score").alias("score"), F.sum("evidence.charStart").alias("starts"))


_add("a3_relation_edges", _a3, f"with {fx.REL} select transcript_id video_id, predicate, count(*)::bigint n, count(distinct rel_id || '|' || provenance)::bigint ids, max(confidence) score, sum(char_start)::bigint starts from rel group by 1, 2")


def _a4(s: SparkSession, d: str) -> DataFrame:
    c = fx.claims(s, d)
    one = F.struct(F.col("claim_id").alias("id"), "text", "kind", "entities", "confidence", F.col("truth").alias("directTruth"), F.lit("said").alias("rationale"), F.col("stance").alias("hostStance"))
    path = scratch(s, "claims")
    c.groupBy("video_id").agg(F.collect_list(one).alias("claims")).select(F.to_json(F.struct(F.col("video_id").alias("videoId"), "claims"))).write.text(path)
    rows, documents = rd.read_claims(s, path, multi_line=False)
    per = rows.groupBy("video_id").agg(F.count("truth").alias("with_truth"), F.sum(F.size("entities")).alias("entities"), F.max("claim_id").alias("last_id"))
    return documents.withColumn("claims", F.col("claims").cast("long")).join(per, "video_id")


_add("a4_claims_of_documents", _a4, f"with {fx.LI}, {fx.CLAIMS} select video_id, count(*)::bigint claims, count(truth)::bigint with_truth, sum(len(entities))::bigint entities, max(claim_id) last_id from claims group by 1")


# overrides
def _a5(s: SparkSession, d: str) -> DataFrame:
    p, c = fx.table(s, d, "part"), fx.table(s, d, "customer")
    merges = p.where("p_partkey % 5 = 1").agg(F.collect_list(F.struct(F.concat(F.lit("thing:p"), "p_partkey").alias("from"), F.concat(F.lit("thing:p"), F.col("p_partkey") - 1).alias("to"))).alias("merges"))
    shown = c.agg(F.collect_list(F.struct(F.concat(F.lit("person:c"), "c_custkey").alias("key"), F.col("c_name").alias("display"))).alias("display"))
    path = scratch(s, "overrides")
    merges.crossJoin(shown).select(F.to_json(F.struct("merges", "display"))).coalesce(1).write.text(path)  # one row beside one row
    found = rd.read_overrides(s, path)
    out = found["merges"].select(F.lit("merges").alias("section"), F.col("from").alias("a"), F.col("to").alias("b"))
    out = out.union(found["display"].select(F.lit("display"), "key", "display"))
    return out.union(found["claimDeletions"].select(F.lit("claimDeletions"), "claimId", "claimId"))


_add("a5_override_sections", _a5, "select 'merges' section, 'thing:p' || p_partkey a, 'thing:p' || (p_partkey - 1) b from part where p_partkey % 5 = 1 union all select 'display', 'person:c' || c_custkey, c_name from customer")
_FLAT = [
    ("display:person:c{k}", "Name {k}", "display", ["person:c{k}", "Name {k}"]),
    ("video:v{k}:person:x", "person:c{k}", "videoMerges", ["v{k}", "person:x", "person:c{k}"]),
    ("del:v{k}:person:a|denies|thing:b|c|12.5", "true", "deletedRelations", ["v{k}", "person:a", "denies", "thing:b|c", "12.5"]),
    ("del:v{k}:person:a|denies|thing:b|soon", "true", None, []),
    ("person:c{k}~~person:d", "__not_same__", "notSame", ["person:c{k}", "person:d"]),
    ("person:c{k}||person:d||", "__rejected__", "dismissed", ["person:c{k}", "person:d"]),
    ("person:c{k}||person:d", "person:e", None, []),
    ("person:c{k}", "__hidden__", "deletedEntities", ["person:c{k}"]),
    ("person:c{k}", "person:d", "merges", ["person:c{k}", "person:d"]),
    ("person:c{k}", "__not_same__", None, []),
    ("video:v{k}", "person:c1", None, []),
]


def flat_overrides(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders").select("o_orderkey").distinct()
    at = (F.col("o_orderkey") % 11).cast("int")

    def filled(texts: list[str]) -> F.Column:
        return F.replace(F.get(F.array(*[F.lit(t) for t in texts]), at), F.lit("{k}"), F.col("o_orderkey").cast("string"))

    return o.select(filled([x[0] for x in _FLAT]).alias("key"), filled([x[1] for x in _FLAT]).alias("value"))


_ROWS = " union all ".join(f"select '{sec}' section, replace('{' / '.join(fields)}', '{{k}}', k) fields from o where k::bigint % 11 = {i}" for i, (_, _, sec, fields) in enumerate(_FLAT) if sec)
_add("a6_typed_overrides", lambda s, d: rd.typed_overrides(flat_overrides(s, d)).select("section", F.array_join("fields", " / ").alias("fields")), f"with o as (select distinct o_orderkey::varchar k from orders) {_ROWS}")


# caches
def _texts(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "part").select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 400).cast("string")).alias("text")).distinct()


def _cache(s: SparkSession, d: str) -> DataFrame:
    v = fx.table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    p = fx.table(s, d, "part").where("p_partkey % 3 = 0").select(F.sha1(F.concat(F.lit("model-a"), F.lit("\0"), "p_name", F.lit(" "), (F.col("p_partkey") % 400).cast("string"))).alias("text_hash"), (F.col("p_partkey") % 50).alias("vec_id"))
    return p.groupBy("text_hash").agg(F.min("vec_id").alias("vec_id")).join(v, "vec_id").select("text_hash", "vec")


_CACHED = "t as (select distinct p_name || ' ' || p_partkey % 400 as text from part), ca as (select p_name || ' ' || p_partkey % 400 as text, min(p_partkey % 50) vec_id from part where p_partkey % 3 = 0 group by 1)"
_add("a7_cached_vectors", lambda s, d: rd.cached_vectors(_texts(s, d), _cache(s, d), "model-a").where("vec is not null").select("text", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first")), f"with {_CACHED} select t.text, round(embedding[1]::double, 5) as first from t join ca on t.text = ca.text join embeddings using (vec_id)")


def _length_embedder(frames):
    """A stand-in for a model: a text's length, as a vector of one."""
    for f in frames:
        yield f.assign(vec=[[float(len(t))] for t in f["text"]])[["text_hash", "vec"]]


_add("i29_filled_vectors", lambda s, d: rd.fill_vectors(_texts(s, d), _cache(s, d), "model-a", _length_embedder).select("text_hash", F.size("vec").cast("long").alias("dims"), F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first")), f"with {_CACHED} select sha1('model-a' || chr(0) || t.text) text_hash, coalesce(len(embedding), 1)::bigint dims, round(coalesce(embedding[1], length(t.text))::double, 5) as first from t left join ca on t.text = ca.text left join embeddings using (vec_id)")
_add(
    "a8_latest_verdicts",
    lambda s, d: rd.latest_verdicts(fx.table(s, d, "events").select(F.concat(F.lit("c"), F.col("user_id") % 40).alias("left"), F.concat(F.lit("c"), F.col("event_id") % 37).alias("right"), F.col("event_type").alias("verdict"), F.col("event_id").alias("seq"))),
    "with e as (select 'c' || user_id % 40 a, 'c' || event_id % 37 b, event_type verdict, event_id seq from events) select least(a, b) lo, greatest(a, b) hi, arg_max(verdict, seq) verdict, max(seq) seq from e group by 1, 2",
)

# seeds
_SEED = ["https://example.org/watch?v={i}&t=3", "https://youtu.be/{i}", "https://example.org/shorts/{i}?x", "  {i}  ", "# {i}", "", "{i}0", "not an id"]


def seed_lines(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders").select("o_orderkey").distinct()
    form = F.get(F.array(*[F.lit(t) for t in _SEED]), (F.col("o_orderkey") % 8).cast("int"))
    return o.select(F.replace(form, F.lit("{i}"), F.lpad(F.col("o_orderkey").cast("string"), 11, "x")).alias("line"))


_SEEDS = "sd as (select k, id, case k % 8 when 0 then 'https://example.org/watch?v=' || id || '&t=3' when 1 then 'https://youtu.be/' || id when 2 then 'https://example.org/shorts/' || id || '?x' else 'https://www.youtube.com/watch?v=' || id end url from (select distinct o_orderkey k, lpad(o_orderkey::varchar, 11, 'x') id from orders) where k % 8 < 4)"
_add("a9_seeds", lambda s, d: rd.parse_seeds(seed_lines(s, d)), f"with {_SEEDS} select id video_id, url source_url from sd")
_add(
    "a10_seeded_catalog",
    lambda s, d: rd.insert_new(fx.table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.lpad(F.col("o_orderkey").cast("string"), 11, "x").alias("video_id"), F.lit("fetched").alias("status")).distinct(), rd.parse_seeds(seed_lines(s, d))).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("source_url").alias("with_url")),
    f"with {_SEEDS} select 'fetched' status, count(distinct o_orderkey)::bigint n, 0::bigint with_url from orders where o_orderkey % 3 = 0 union all select 'pending', count(*), count(*) from sd where k % 3 <> 0",
)


# Captions made from the documents' lines
def _escaped(c: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("é", "&#233;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _captions(s: SparkSession, d: str, cue: F.Column, before: str, after: str, apart: str, name: str) -> DataFrame:
    c = fx.cues(s, d).withColumn("one", cue)
    return c.groupBy("video_id").agg(F.concat(F.lit(before), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", "one"))), lambda x: x["one"]), apart), F.lit(after)).alias(name))


def _a11(s: SparkSession, d: str) -> DataFrame:
    said, at = _escaped(F.col("text")), (F.col("cue_idx") * 4000).cast("string")
    half = (F.length("text") / 2).cast("int")
    words = F.concat(F.lit("<s>"), _escaped(F.substring(F.col("text"), F.lit(1), half)), F.lit('</s><s ac="0">'), _escaped(F.substring(F.col("text"), half + 1, F.length("text"))), F.lit("</s>"))
    new = F.concat(F.lit('<p t="'), at, F.lit('" d="4000">'), F.when(F.col("cue_idx") % 2 == 0, words).otherwise(F.concat(F.lit("<b>"), said, F.lit("</b>"))), F.lit("</p>"))
    old = F.concat(F.lit('<text start="'), (F.col("cue_idx") * 4).cast("string"), F.lit('" dur="4.5">'), said, F.lit("</text>"))
    even = F.substring("video_id", 2, 20).cast("long") % 2 == 0
    return cp.timed_text_cues(_captions(s, d, F.when(even, new).otherwise(old), "<body>", "</body>", "", "xml"))


_TRIMMED = r"regexp_replace(text, '^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$', '', 'g')"
_add(
    "a11_timed_text_cues",
    _a11,
    f"with {fx.CUES}, c as (select *, video_id[2:]::bigint % 2 = 0 new, {_TRIMMED} x from cues) select video_id, (row_number() over (partition by video_id order by cue_idx) - 1)::int cue_idx, cue_idx * 4.0::double as start, case when new then 4.0 else 4.5 end::double duration, case when new then x else text end as text from c where x <> ''",
)
_add(
    "a12_event_cues",
    lambda s, d: cp.event_cues(_captions(s, d, F.to_json(F.struct((F.col("cue_idx") * 4000).alias("tStartMs"), F.lit(4000).alias("dDurationMs"), F.array(F.struct(F.concat(F.lit("\n"), "text").alias("utf8")), F.struct(F.lit(" ").alias("utf8"))).alias("segs"))), '{"events":[{"segs":[{"utf8":"no time"}]},', "]}", ",", "json")),
    f"with {fx.CUES}, c as (select *, {_TRIMMED} x from cues) select video_id, (row_number() over (partition by video_id order by cue_idx) - 1)::int cue_idx, cue_idx * 4.0::double as start, 4.0::double duration, x as text from c where x <> ''",
)
# Player pages
_PAGE = ['{"playabilityStatus":{"status":"OK"},"captionTracks":[{"languageCode":"de","kind":"asr","baseUrl":"u1"},{"languageCode":"en-GB","kind":"asr","baseUrl":"u2"},{"languageCode":"fr","baseUrl":"u3"}]}', '{"playabilityStatus": {"status" : "ERROR"}}', '{"playabilityStatus":{"status":"AGE_VERIFICATION_REQUIRED"}}', '{"status":"LOGIN_REQUIRED"}', '{"captionTracks":[]}', '{"captionTracks":[{"languageCode":"en","baseUrl":"u4"},{"languageCode":"en","kind":"asr","baseUrl":"u5"}]}', '{"captionTracks":[{"languageCode":"de","kind":"asr","baseUrl":"u6"},{"languageCode":"es","baseUrl":"u7"}]}', "<p>nothing</p>", '{"captionTracks":[{"kind":"asr","baseUrl":"u8"}]}']
_STATES = [("ok", 3, "u2"), ("removed", 0, None), ("login-required", 0, None), ("login-required", 0, None), ("no-captions", 0, None), ("ok", 2, "u4"), ("ok", 2, "u7"), ("no-captions", 0, None), ("ok", 1, "u8")]


def _a14(s: SparkSession, d: str) -> DataFrame:
    body = F.get(F.array(*[F.lit(p) for p in _PAGE]), (F.col("page_id") % 9).cast("int"))
    pages = fx.table(s, d, "pages").select("page_id", F.concat("html", F.lit("<script>var p = "), body, F.lit(";</script>")).alias("html"))
    return cp.page_state(pages).select("page_id", "state", F.size("tracks").cast("long").alias("tracks"), cp.pick_track(F.col("tracks"))["base_url"].alias("picked"))


_add("a13_a14_pages_and_tracks", _a14, "select page_id, case page_id % 9 " + " ".join(f"when {k} then '{st}'" for k, (st, _, _) in enumerate(_STATES)) + " end state, case page_id % 9 " + " ".join(f"when {k} then {n}" for k, (_, n, _) in enumerate(_STATES)) + " end::bigint tracks, case page_id % 9 " + " ".join(f"when {k} then '{u}'" for k, (_, _, u) in enumerate(_STATES) if u) + " end picked from pages where html is not null")


# metadata
def _meta(s: SparkSession, d: str, side: int) -> DataFrame:
    c = fx.table(s, d, "customer").where(f"c_custkey % 4 <> {side}")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("v"), k).alias("video_id"), F.when(k % 3 != side, F.concat("c_name", F.lit(f" {side}"))).alias("title"), F.when(k % 5 != side, F.concat("c_mktsegment", F.lit(f" {side}"))).alias("category"), F.when(k % 7 != side, k * 10 + side).alias("view_count"))


_SIDE = "m{0} as (select 'v' || c_custkey video_id, case when c_custkey % 3 <> {0} then c_name || ' {0}' end title, case when c_custkey % 5 <> {0} then c_mktsegment || ' {0}' end category, case when c_custkey % 7 <> {0} then c_custkey * 10 + {0} end view_count from customer where c_custkey % 4 <> {0})"
_add("a15_merged_metadata", lambda s, d: cp.merge_metadata(_meta(s, d, 1), _meta(s, d, 2)), f"with {_SIDE.format(1)}, {_SIDE.format(2)} select coalesce(m1.video_id, m2.video_id) video_id, coalesce(m1.title, m2.title) title, coalesce(m2.category, m1.category) category, coalesce(m1.view_count, m2.view_count) view_count from m1 full join m2 on m1.video_id = m2.video_id")
_add("a16_metadata_backfill", lambda s, d: cp.needs_metadata(fx.catalog(s, d), ("published",)).select("video_id"), f"with {fx.CATALOG} select video_id from catalog where status = 'fetched' and published is null")


def _a20(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    thumbs = F.struct(F.array(F.struct(F.lit("small").alias("url"), F.lit(120).alias("width")), F.struct(F.concat(F.lit("wide"), k).alias("url"), (k % 3 * 200).alias("width")), F.struct(F.lit("last").alias("url"), F.lit(400).alias("width"))).alias("thumbnails"))
    vd = F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), F.array("c_mktsegment").alias("keywords"), F.when(k % 2 == 0, (k * 3).cast("string")).alias("lengthSeconds"), F.when(k % 5 == 0, F.lit("many")).otherwise(k.cast("string")).alias("viewCount"), thumbs.alias("thumbnail"))
    mf = F.struct(F.struct(F.when(k % 4 == 0, F.concat(F.lit("Owner "), k)).alias("ownerChannelName"), F.lit("2020-01-02").alias("uploadDate")).alias("playerMicroformatRenderer"))
    rows = fx.table(s, d, "customer").select(F.concat(F.lit("v"), k).alias("video_id"), F.to_json(F.struct(vd.alias("videoDetails"), mf.alias("microformat"))).alias("player"))
    return cp.player_metadata(rows).select("video_id", "title", "channel", F.size("keywords").cast("long").alias("keywords"), "upload_date", "length_seconds", "view_count", "thumbnail_url")


_add("a20_player_metadata", _a20, "select 'v' || c_custkey video_id, c_name title, case when c_custkey % 4 = 0 then 'Owner ' || c_custkey else c_mktsegment end channel, 1::bigint keywords, '2020-01-02' upload_date, case when c_custkey % 2 = 0 then c_custkey * 3 end length_seconds, case when c_custkey % 5 <> 0 then c_custkey end view_count, case when c_custkey % 3 = 2 then 'wide' || c_custkey else 'last' end thumbnail_url from customer")


def _sync(s: SparkSession, d: str, empty: tuple[str, ...]) -> DataFrame:
    k = F.col("c_custkey")
    old = fx.table(s, d, "customer").select(F.concat(F.lit("v"), k).alias("video_id"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("keywords"), (k * 2).alias("view_count"))
    new = fx.table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("v"), k).alias("video_id"), F.when(k % 2 == 0, F.lit("new")).alias("keywords"), F.when(k % 7 == 0, k).otherwise(k * 2).alias("view_count"))
    return cp.sync_metadata(old, new, ["keywords", "view_count"], empty).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("keywords") == "new").alias("new_keywords"), F.sum("view_count").alias("views"))


_SYNC = """with c as (select c_custkey k, c_mktsegment seg, c_custkey % 5 <> 0 seen from customer), x as (select k, seen, seen and k % 2 = 0{0} kw, seen and k % 7 = 0 and k <> 0 vc from c)
select case when not seen then 'missing' when kw or vc then 'updated' else 'unchanged' end outcome, count(*)::bigint n, count(*) filter (kw)::bigint new_keywords, sum(case when vc then k else k * 2 end)::bigint views from x group by 1"""
_add("a21_metadata_sync", lambda s, d: _sync(s, d, ()), _SYNC.format(""))
_add("a22_selective_refresh", lambda s, d: _sync(s, d, ("keywords",)), _SYNC.format(" and k % 3 = 0"))


# Sinks, read back
def _a17(s: SparkSession, d: str) -> DataFrame:
    rel, claims = fx.relationships(s, d), fx.claims(s, d)
    made = {"entity-index": rel.groupBy("object_id").agg(F.count(F.lit(1)).alias("mentions")), "relationships-graph": rel.groupBy("subject_id", "predicate", "object_id").agg(F.count(F.lit(1)).alias("n")), "claims-index": claims.select("claim_id", "kind", "truth"), "dependency-graph": fx.dependencies(s, d).select("source", "target", "kind")}
    folder = scratch(s, "reports")
    sinks.write_reports(folder, made)
    sinks.write_reports(folder, {"claims-index": made["claims-index"].where("truth is not null")})
    out = None
    for name in made:
        one = s.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), "n")
        out = one if out is None else out.union(one)
    return out


_add("a17_reports", _a17, f"with {fx.REL}, {fx.LI}, {fx.CLAIMS}, {fx.DEPS} select 'entity-index' report, count(distinct object_id)::bigint n from rel union all select 'relationships-graph', count(*) from (select distinct subject_id, predicate, object_id from rel) union all select 'claims-index', count(truth) from claims union all select 'dependency-graph', count(*) from deps")


def _a18(s: SparkSession, d: str) -> DataFrame:
    m = fx.table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    m = m.select("day", F.lit("orders").alias("section"), F.lit("count").alias("name"), "value")
    folder = scratch(s, "history")
    sinks.write_metric_history(folder, m)
    sinks.write_metric_history(folder, m.where("day like '%-03'").withColumn("value", -F.col("value")))
    return s.read.schema("section string, name string, value double, day string").parquet(folder).select("day", "section", "name", "value")


_add("a18_metric_history", _a18, "select strftime(o_orderdate, '%Y-%m') as day, 'orders' section, 'count' as name, (case when month(o_orderdate) = 3 then -1 else 1 end * count(*))::double as value from orders group by 1, month(o_orderdate)")


def _a19(s: SparkSession, d: str) -> DataFrame:
    stages = fx.table(s, d, "orders").select(F.concat(F.lit("v"), F.col("o_orderkey") % 500).alias("video_id"), F.col("o_orderdate").cast("date").alias("at"))
    ents = fx.table(s, d, "part").select(F.concat(F.lit("thing:p "), "p_partkey").alias("entity_id"))
    urls = sinks.url_list("https://site.example", ["/", "/about"], stages, ents, fx.claims(s, d).select("video_id", "claim_id"))
    folder = scratch(s, "urls")
    sinks.write_url_list(folder, urls)
    back = s.read.text(folder).select(F.split("value", "\t").alias("x"))
    return back.select(F.get("x", F.lit(0)).alias("url"), F.get("x", F.lit(1)).alias("lastmod"))


_add(
    "a19_url_list",
    _a19,
    f"with {fx.LI}, {fx.CLAIMS}, st as (select 'v' || o_orderkey % 500 video_id, strftime(max(o_orderdate), '%Y-%m-%d') lastmod from orders group by 1) select 'https://site.example/' url, null lastmod union all select 'https://site.example/about', null union all select 'https://site.example/video/' || video_id, lastmod from st union all select 'https://site.example/entity/thing%3Ap+' || p_partkey, null from part union all select 'https://site.example/claim/' || replace(claim_id, ':', '%3A'), lastmod from claims left join st using (video_id)",
)
