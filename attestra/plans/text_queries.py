"""Registered queries of text preparation and extraction, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import dates
from attestra.operators import segments as sg
from attestra.plans import fixtures as fx
from attestra.plans import more

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def docs(s: SparkSession, d: str) -> DataFrame:
    """Documents with an abbreviation after every comma, so that some full stops end no sentence."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return fx.table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), F.regexp_replace(t, ", ", ", Mrs. Etc. ").alias("text"))


_DOCS = "dx as (select 'd' || doc_id video_id, regexp_replace(coalesce(text, ''), ', ', ', Mrs. Etc. ', 'g') as text from documents)"
_SP = r"[ \t\n\r\x0B\x0C\x{00A0}]"
_ABB = "|".join(sg.ABBREVIATIONS)
# marks instead of look-behind: abbreviations' full stops are set aside, ends are marked, the text is split
_SENT = rf"""{_DOCS}, m1 as (select video_id, regexp_replace(text, '(^|[^A-Za-z])({_ABB})\.', '\1\2' || chr(2), 'gi') t from dx), m2 as (select video_id, replace(regexp_replace(replace(regexp_replace(t, '([.!?])({_SP})', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), '([.!?])$', '\1' || chr(1)), chr(2), '.') t from m1),
pc as (select video_id, unnest(string_split(t, chr(1))) p, generate_subscripts(string_split(t, chr(1)), 1) i from m2), of as (select video_id, p, coalesce(sum(length(p)) over (partition by video_id order by i rows between unbounded preceding and 1 preceding), 0)::int s from pc),
se as (select video_id, (s + length(p) - length(regexp_replace(p, '^{_SP}+', '')))::int as start, (s + length(p))::int as "end" from of where regexp_replace(p, '{_SP}+', '', 'g') <> '')"""
_add("b3_sentences", lambda s, d: sg.sentences(docs(s, d)), f"with {_SENT} select * from se")
_WIN = f"""with recursive {_SENT}, n as (select *, row_number() over (partition by video_id order by start) i from se),
r as (select video_id, i, start ws, "end" we, 0 win from n where i = 1 union all select n.video_id, n.i, case when n."end" - r.ws > 500 then n.start else r.ws end, n."end", case when n."end" - r.ws > 500 then r.win + 1 else r.win end from r join n on n.video_id = r.video_id and n.i = r.i + 1),
wi as (select video_id, win::int as "window", min(ws)::int as start, max(we)::int as "end" from r group by 1, 2)"""
_add("b4_windows", lambda s, d: sg.merged_windows(sg.sentences(docs(s, d))), f"{_WIN} select * from wi")
_add(
    "b5_line_chunks",
    lambda s, d: sg.line_chunks(docs(s, d)),
    f"""with recursive {_DOCS}, l as (select video_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) k from dx), o as (select video_id, t, coalesce(sum(length(t) + 1) over (partition by video_id order by k rows between unbounded preceding and 1 preceding), 0)::int at_, k from l),
n as (select *, row_number() over (partition by video_id order by k) i from o where regexp_replace(t, '{_SP}+', '', 'g') <> ''),
r as (select video_id, i, at_ s, length(t) len, length(t) <= 800 op, 0 c from n where i = 1 union all select n.video_id, n.i, case when f then r.s else n.at_ end, case when f then r.len + 1 + length(n.t) else length(n.t) end, length(n.t) <= 800, case when f then r.c else r.c + 1 end from (select r.*, n2.t nt, r.op and length(n2.t) <= 800 and r.len + 1 + length(n2.t) <= 800 f from r join n n2 on n2.video_id = r.video_id and n2.i = r.i + 1) r join n on n.video_id = r.video_id and n.i = r.i + 1),
ch as (select r.video_id, c::int chunk, min(s)::int as start, string_agg(t, chr(10) order by r.i) as text from r join n on n.video_id = r.video_id and n.i = r.i group by 1, 2)
select * from ch union all select video_id, 0, 0, text from dx where video_id not in (select video_id from n)""",
)
_TOKS = r"""pi as (select video_id, unnest(regexp_extract_all(text, '[^ \t\n\r\f]+|[ \t\n\r\f]+')) p, generate_subscripts(regexp_extract_all(text, '[^ \t\n\r\f]+|[ \t\n\r\f]+'), 1) i from dx), pa as (select *, coalesce(sum(length(p)) over (partition by video_id order by i rows between unbounded preceding and 1 preceding), 0)::int s from pi),
tk as (select video_id, (row_number() over (partition by video_id order by i) - 1)::int token_idx, s as start, (s + length(p))::int as "end", p as token from pa where not regexp_matches(p, '^[ \t\n\r\f]'))"""
_add("b6_tokens", lambda s, d: sg.tokens(docs(s, d)), f"with {_DOCS}, {_TOKS} select * from tk")


def mentions(s: SparkSession, d: str) -> DataFrame:
    """Tokens that begin with a capital, as mentions: (video_id, mention_id, start, end, label, surface)."""
    t = sg.tokens(docs(s, d)).withColumn("surface", F.regexp_extract("token", "^[A-Z][a-z]{2,}", 0)).where("surface <> ''")
    return t.select("video_id", F.format_string("m_%04d", "token_idx").alias("mention_id"), "start", (F.col("start") + F.length("surface")).alias("end"), fx._pick(fx.LABELS, F.length("surface")).alias("label"), "surface")


_MEN = f"""me as (select video_id, printf('m_%04d', token_idx) mention_id, start, (start + length(surface))::int as "end", {fx._sql_list(fx.LABELS)}[1 + length(surface) % 6] as label, surface from (select *, regexp_extract(token, '^[A-Z][a-z][a-z]+') surface from tk) where surface <> '')"""
_add("b6_token_ranges", lambda s, d: sg.token_ranges(sg.tokens(docs(s, d)), mentions(s, d).select("video_id", "start", (F.col("end") + 3).alias("end"))), f'with {_DOCS}, {_TOKS}, {_MEN}, sp as (select distinct video_id, start, "end" + 3 e from me) select sp.video_id, sp.start, sp.e::int as "end", min(token_idx)::int first_token, max(token_idx)::int last_token from sp join tk on tk.video_id = sp.video_id and sp.start < tk."end" and sp.e > tk.start group by 1, 2, 3')
_add("b13_quotes", lambda s, d: sg.quotes(mentions(s, d).select("video_id", "mention_id", "start", "end"), docs(s, d)), f"with {_DOCS}, {_TOKS}, {_MEN} select video_id, mention_id, start, \"end\", regexp_replace(regexp_replace(substr(text, greatest(start - 80, 0) + 1, \"end\" + 80 - greatest(start - 80, 0)), '{_SP}+', ' ', 'g'), '^ +| +$', '', 'g') quote from me join dx using (video_id)")
_add("b14_embedding_texts", lambda s, d: fx.table(s, d, "documents").select("doc_id", F.sha1(sg.embedding_text(F.concat(F.lit(" \x01\t"), F.coalesce("text", F.lit("")), F.lit("\x1f \n")))).alias("sha1")), r"select doc_id, sha1(substr(case when t = '' then ' ' else t end, 1, 4000)) sha1 from (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', '', 'g'), '^\s+|\s+$', '', 'g') t from documents)")
_add("b15_clock_of_long_documents", lambda s, d: fx.cues(s, d).select("video_id", "cue_idx", tx.clock(F.col("start") * 40).alias("clock")), f"with {fx.CUES} select video_id, cue_idx, printf('%02d:%02d', cue_idx * 160 // 60, cue_idx * 160 % 60) clock from cues")

# A list of terms as the scorer
TERMS = {"The": ("event", 0.9), "and": ("person", 0.4), "ing": ("location", 0.6), "der": ("person", 0.7), "que": ("facility", 0.5)}


def _scored(s: SparkSession, d: str) -> DataFrame:
    both = sg.scored_chunks(sg.line_chunks(docs(s, d)), sg.TermScorer(TERMS))
    return both.unionByName(both.withColumn("score", F.col("score") - 0.1))


_TERMS = ", ".join(f"('{t}', '{label}', {score})" for t, (label, score) in TERMS.items())
_WORD = r"[\p{L}\p{N}_]+"
_add(
    "c1_c2_scored_mentions",
    lambda s, d: sg.best_mentions(_scored(s, d)).groupBy("video_id", "label", "surface").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.max("score").alias("score")),
    rf"""with {_DOCS}, pi as (select video_id, unnest(regexp_extract_all(text, '{_WORD}|[^\p{{L}}\p{{N}}_]+')) p, generate_subscripts(regexp_extract_all(text, '{_WORD}|[^\p{{L}}\p{{N}}_]+'), 1) i from dx), pa as (select *, coalesce(sum(length(p)) over (partition by video_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint s from pi), te(t, label, score) as (values {_TERMS})
select video_id, te.label as label, p surface, count(*)::bigint n, sum(s)::bigint starts, max(score)::double score from pa join te on p = t where score >= 0.5 group by 1, 2, 3""",
)


# C7-C12, C14
def _held(s: SparkSession, d: str) -> DataFrame:
    return sg.in_windows(mentions(s, d), sg.merged_windows(sg.sentences(docs(s, d)), 200))


_WIN2 = _WIN.replace("> 500", "> 200")
_HELD = f'{_WIN2}, {_TOKS}, {_MEN}, h0 as (select wi.video_id, "window", wi.start win_start, wi."end" win_end, mention_id, me.start as start, me."end" as "end", label, surface from wi join me on me.video_id = wi.video_id and me.start >= wi.start and me."end" <= wi."end"), he as (select * from h0 qualify count(*) over (partition by video_id, "window") >= 2)'
_add("c7_mentions_in_windows", lambda s, d: _held(s, d).select("video_id", "window", "win_start", "win_end", "mention_id", "start", "end", "label", "surface"), f"{_HELD} select * from he")
_PAIR = f"""{_HELD}, pr as (select x.video_id, x."window", x.mention_id a, y.mention_id b, abs((x.start + x."end") / 2.0 - (y.start + y."end") / 2.0)::double distance, row_number() over (partition by x.video_id, x."window" order by abs((x.start + x."end") / 2.0 - (y.start + y."end") / 2.0), x.start, y.start)::int rank from he x join he y on x.video_id = y.video_id and x."window" = y."window" and x.start < y.start qualify rank <= 10)"""
_add("c8_mention_pairs", lambda s, d: sg.mention_pairs(_held(s, d)), f"{_PAIR} select * from pr")
_add("c9_participants", lambda s, d: sg.participants(sg.mention_pairs(_held(s, d))), f'{_PAIR}, u as (select video_id, "window", a m, rank * 2 k from pr union all select video_id, "window", b, rank * 2 + 1 from pr), f as (select video_id, "window", m, min(k) k from u group by 1, 2, 3) select video_id, "window", (row_number() over (partition by video_id, "window" order by k) - 1)::int as position, m mention_id from f')


def _length_scorer(subject: str, obj: str, text: str) -> list[tuple[str, float]]:
    """A stand-in for a model: likes lengths."""
    return [("works for", len(subject) / 12), ("located in", len(obj) / 10), ("met with", 0.35)]


def _relations(s: SparkSession, d: str) -> DataFrame:
    pairs = sg.mention_pairs(_held(s, d), carry=("surface",))
    inputs = pairs.select("video_id", "window", F.col("a").alias("subject_id"), F.col("b").alias("object_id"), F.col("a_surface").alias("subject"), F.col("b_surface").alias("object"), F.lit("").alias("text"))
    return sg.numbered_edges(sg.kept_relations(sg.scored_pairs(inputs, _length_scorer), {"works_for": 0.5, "located_in": 0.6}))


_add(
    "c10_c12_relations",
    lambda s, d: _relations(s, d).select("video_id", "edge_id", "window", "subject_id", "object_id", "predicate", F.round("score", 6).alias("score")),
    f"""{_PAIR}, j as (select pr.video_id, pr."window", a subject_id, b object_id, x.surface su, y.surface ob from pr join he x on x.video_id = pr.video_id and x."window" = pr."window" and x.mention_id = a join he y on y.video_id = pr.video_id and y."window" = pr."window" and y.mention_id = b),
sc as (select *, case when length(su) / 12.0 >= length(ob) / 10.0 and length(su) / 12.0 >= 0.35 then 'works_for' when length(ob) / 10.0 >= 0.35 then 'located_in' else 'met_with' end predicate, greatest(length(su) / 12.0, length(ob) / 10.0, 0.35) score from j where lower(su) <> lower(ob))
select video_id, printf('r_%04d', row_number() over (partition by video_id order by "window", subject_id, object_id, predicate)) edge_id, "window", subject_id, object_id, predicate, round(score, 6)::double score from sc where predicate = 'works_for' and score >= 0.5 or predicate = 'located_in' and score >= 0.6""",
)
_add("c14_aligned_mentions", lambda s, d: sg.aligned(mentions(s, d), docs(s, d).withColumn("rewritten", F.regexp_replace("text", " he ", " Bob ")))[0].groupBy("video_id").agg(F.count(F.lit(1)).alias("n")), f"with {_DOCS}, {_TOKS}, {_MEN} select video_id, count(*)::bigint n from me where video_id in (select video_id from dx where not contains(text, ' he ')) group by 1")


# D7, D8
def _surfaces(s: SparkSession, d: str) -> DataFrame:
    return more.surfaces(s, d).withColumn("video_id", F.concat(F.lit("v"), F.col("o_orderkey") % 50)).withColumn("start", F.col("o_orderkey").cast("int")).withColumn("end", F.col("start") + F.length("surface"))


_add("d7_derived_mentions", lambda s, d: dates.derived_mentions(_surfaces(s, d).withColumnRenamed("o_orderkey", "mention_id")).groupBy("video_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("derived_id").alias("last_id"), F.sum("start").alias("starts"), F.min("score").alias("score")), f"with v as ({more.SQL['d6_d7_derived_dates']}), n as (select *, 'v' || o_orderkey % 50 video_id, printf('d_%04d', row_number() over (partition by o_orderkey % 50 order by o_orderkey, label)) id from v) select video_id, label, count(*)::bigint n, max(id) last_id, sum(o_orderkey)::bigint starts, 1.0::double score from n group by 1, 2")
_add("d8_time_axis", lambda s, d: dates.time_axis(dates.derived_values(dates.parse_surfaces(_surfaces(s, d)))).groupBy("label", "canonical", "sort_value", "axis_label").agg(F.count(F.lit(1)).alias("n")), f"with v as ({more.SQL['d6_d7_derived_dates']}), a as (select *, case label when 'year' then canonical || '-01-01' when 'decade' then canonical[1:4] || '-01-01' when 'specific_month' then canonical || '-01' when 'specific_week' then canonical end::date y from v) select label, canonical, epoch_ms(y::timestamp) sort_value, case when y is not null then canonical end axis_label, count(*)::bigint n from a group by 1, 2, 3, 4")
