"""More registered queries, each beside its SQL: dates, jobs, neighbourhoods, terms, speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import claims as cl
from attestra.operators import dates, jobs
from attestra.operators import facets as fa
from attestra.operators import graph as gr
from attestra.operators import quality as ql
from attestra.plans import fixtures as fx
from attestra.streaming import skeptic as sk

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


_C, _D = fx.claims, fx.dependencies
_CD = f"with {fx.LI}, {fx.CLAIMS}, {fx.DEPS}"


# D: order dates written in ten ways
def surfaces(s: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    k, f = F.col("o_orderkey") % 10, lambda p: F.date_format(day, p)
    forms = [f("yyyy-MM-dd"), f("M/d/yyyy"), f("M-d-yy"), f("MMMM d, yyyy"), F.concat(F.lit("the  "), f("MMM d"), F.lit("th "), f("yyyy"), F.lit(" 4:30 p.m.")), f("MMMM yyyy"), f("yyyy"), F.concat(F.lit("'"), F.substring(f("yy"), 1, 1), F.lit("0s")), F.when(F.col("o_custkey") % 2 == 0, "Noon").otherwise("sunset"), F.concat(f("d"), F.lit("pm"))]
    form = forms[9]
    for i in range(9):
        form = F.when(k == i, forms[i]).otherwise(form)
    return fx.table(s, d, "orders").select("o_orderkey", form.alias("surface")).distinct()


_SURFACES = """o as (select *, o_orderdate::date y from orders), sf as (select distinct o_orderkey, case o_orderkey % 10 when 0 then strftime(y, '%Y-%m-%d') when 1 then strftime(y, '%-m/%-d/%Y') when 2 then strftime(y, '%-m-%-d-%y') when 3 then strftime(y, '%B %-d, %Y')
 when 4 then 'the  ' || strftime(y, '%b %-d') || 'th ' || year(y) || ' 4:30 p.m.' when 5 then strftime(y, '%B %Y') when 6 then strftime(y, '%Y') when 7 then '''' || strftime(y, '%y')[1] || '0s' when 8 then case when o_custkey % 2 = 0 then 'Noon' else 'sunset' end else strftime(y, '%-d') || 'pm' end surface from o)"""
# the SQL knows each row's form by its key, and so parses without regular expressions
_PARSED = """pd as (select o_orderkey, surface, o_orderkey % 10 k, case when o_orderkey % 10 = 0 then strptime(surface, '%Y-%m-%d') when o_orderkey % 10 = 1 then strptime(surface, '%m/%d/%Y') when o_orderkey % 10 = 2 then strptime(surface, '%m-%d-%y') when o_orderkey % 10 = 3 then strptime(surface, '%B %d, %Y')
 when o_orderkey % 10 = 4 then strptime(replace(surface[6:], 'th ', ' '), '%b %d %Y 4:30 p.m.') when o_orderkey % 10 = 5 then strptime('1 ' || surface, '%d %B %Y') when o_orderkey % 10 = 6 then strptime(surface, '%Y') end::date y,
 case when o_orderkey % 10 = 9 then try_cast(replace(surface, 'pm', '') as int) end h from sf),
ps as (select o_orderkey, surface, k, case when k <= 6 then year(y) end::int yy, case when k <= 5 then month(y) end::int mm, case when k <= 4 then day(y) end::int dd,
 case when k = 4 then 990 when surface = 'Noon' then 720 when h between 1 and 12 then (h % 12 + 12) * 60 end::int as minutes,
 case when k = 7 then case when surface[2]::int < 5 then 2000 else 1900 end + 10 * surface[2]::int when k <= 6 then year(y) // 10 * 10 end::int as decade,
 case when k = 4 then 'day' when surface = 'Noon' then 'day' when surface = 'sunset' then 'evening' when h = 12 then 'day' when h between 1 and 4 then 'day' when h between 5 and 8 then 'evening' when h between 9 and 11 then 'night' end day_part from pd)"""
_add("d1_d3_parsed_dates", lambda s, d: dates.parse_surfaces(surfaces(s, d)).fillna(-1, ["y", "m", "d", "minutes", "decade"]), f"with {_SURFACES}, {_PARSED} select o_orderkey, surface, coalesce(yy, -1) y, coalesce(mm, -1) m, coalesce(dd, -1) d, coalesce(minutes, -1) as minutes, coalesce(decade, -1) as decade, day_part from ps")
_add(
    "d6_d7_derived_dates",
    lambda s, d: dates.derived_values(dates.parse_surfaces(surfaces(s, d))),
    f"""with {_SURFACES}, {_PARSED}, v as (select o_orderkey, surface, unnest([
 {{'label': 'time_of_day', 'canonical': day_part}}, {{'label': 'specific_date_time', 'canonical': case when dd is not null and minutes is not null then printf('%d-%02d-%02dT%02d:%02d', yy, mm, dd, minutes // 60, minutes % 60) end}},
 {{'label': 'specific_week', 'canonical': case when dd is not null then strftime(make_date(yy, mm, dd) - dayofweek(make_date(yy, mm, dd))::int, '%Y-%m-%d') end}}, {{'label': 'specific_month', 'canonical': case when mm is not null then printf('%d-%02d', yy, mm) end}},
 {{'label': 'year', 'canonical': yy::varchar}}, {{'label': 'decade', 'canonical': decade || 's'}}]) x from ps) select o_orderkey, surface, x.label as label, x.canonical canonical from v where x.canonical is not null""",
)

# G, J: neighbourhoods and scopes
_add("g14_one_hop", lambda s, d: fx.relationships(s, d).where("subject_id = 'person:c7' or object_id = 'organization:s3'").select("rel_id", "subject_id", "object_id"), f"with {fx.REL} select rel_id, subject_id, object_id from rel where subject_id = 'person:c7' or object_id = 'organization:s3'")
_add("g12_induced_graph", lambda s, d: fx.relationships(s, d).where(F.split_part("subject_id", F.lit(":"), F.lit(1)).isin("person") & F.split_part("object_id", F.lit(":"), F.lit(1)).isin("organization", "person")).groupBy("predicate").agg(F.count(F.lit(1)).alias("n")), f"with {fx.REL} select predicate, count(*)::bigint n from rel where split_part(subject_id, ':', 1) = 'person' and split_part(object_id, ':', 1) in ('organization', 'person') group by 1")
_add("g7_relationship_lines", lambda s, d: gr.relation_lines(fx.relationships(s, d)).select("rel_id", "line"), f"with {fx.REL} select rel_id, subject_id || ' ' || replace(predicate, '_', ' ') || ' ' || object_id || ' [' || provenance || ']' line from rel")


def _j14(s: SparkSession, d: str) -> DataFrame:
    e = _C(s, d).select("video_id", F.explode("entities").alias("e"))
    group = F.when(F.col("e").isin("thing:p1", "thing:p2", "thing:p3", "thing:p4", "thing:p5"), 1).when(F.col("e").isin("organization:s1", "organization:s2"), 2)
    return e.withColumn("g", group).groupBy("video_id").agg(F.count_distinct("g").alias("met")).where("met = 2").select("video_id")


_J14 = "select video_id from (select video_id, case when e in ('thing:p1', 'thing:p2', 'thing:p3', 'thing:p4', 'thing:p5') then 1 when e in ('organization:s1', 'organization:s2') then 2 end g from (select video_id, unnest(entities) e from claims)) group by 1 having count(distinct g) = 2"
_add("j14_active_documents", _j14, f"{_CD} {_J14}")


def _j15(s: SparkSession, d: str) -> DataFrame:
    e = _C(s, d).join(_j14(s, d), "video_id", "left_semi").select(F.explode("entities").alias("entity_id")).where("entity_id like 'thing:%'")
    total = e.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    top = total.orderBy(F.desc("n"), "entity_id").limit(10)
    return top.union(total.where("entity_id in ('thing:p1', 'thing:p9')")).distinct()


_add("j15_j16_top_entities_in_scope", _j15, f"{_CD}, a as ({_J14}), t as (select e entity_id, count(*)::bigint n from (select unnest(entities) e from claims where video_id in (select video_id from a)) where e like 'thing:%' group by 1) select * from (select * from t order by n desc, entity_id limit 10) union select * from t where entity_id in ('thing:p1', 'thing:p9')")


def _j21(s: SparkSession, d: str) -> DataFrame:
    """Seeds of one entity, and claims one dependency away in either direction; the smaller distance wins."""
    seeds = _C(s, d).where(F.array_contains("entities", "thing:p12")).select("claim_id", F.lit(0).alias("distance"))
    deps = _D(s, d).select("source", "target")
    ends = deps.union(deps.select("target", "source")).toDF("claim_id", "other")
    near = ends.join(seeds, "claim_id", "left_semi").select(F.col("other").alias("claim_id"), F.lit(1).alias("distance"))
    return seeds.union(near).groupBy("claim_id").agg(F.min("distance").alias("distance"))


_add("j20_j22_claim_neighbourhood", _j21, f"{_CD}, s as (select claim_id from claims where list_contains(entities, 'thing:p12')) select claim_id, min(distance)::int distance from (select claim_id, 0 distance from s union all select target, 1 from deps where source in (from s) union all select source, 1 from deps where target in (from s)) group by 1")


def _j24(s: SparkSession, d: str) -> DataFrame:
    return fa.weighted_terms(fx.mentions(s, d)).select("video_id", "term", "n", "rank")


_add("j24_terms_of_documents", _j24, f"with {fx.MENTIONS} select video_id, surface[1:32] term, count(*)::bigint n, row_number() over (partition by video_id order by count(*) desc, surface[1:32])::int rank from mentions group by 1, 2 qualify rank <= 80")
_add("j25_truth_labels", lambda s, d: _C(s, d).groupBy(tx.truth_label(F.col("truth")).alias("label")).agg(F.count(F.lit(1)).alias("n")), f"{_CD} select case when truth >= 0.85 then 'very likely true' when truth >= 0.65 then 'likely true' when truth > 0.55 then 'leans true' when truth >= 0.45 then 'uncertain' when truth > 0.35 then 'leans false' when truth > 0.15 then 'likely false' when truth is not null then 'very likely false' end as label, count(*)::bigint n from claims group by 1")

# I: claims
_add(
    "i11_counter_evidence",
    lambda s, d: cl.counter_evidence(_D(s, d)).groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "subkind"))), ",").alias("against")),
    f"{_CD} select target claim_id, string_agg(source || ' ' || k, ',' order by source || ' ' || k) against from (select *, regexp_extract(rationale, '^\\[(\\w+)\\]', 1) k from deps where kind = 'contradicts') where k in ('alternative', 'undercuts') group by 1",
)
_add(
    "i25_edge_truth",
    lambda s, d: cl.edge_truth(_C(s, d).withColumn("edge", F.concat_ws("|", F.col("entities")[1], "kind", F.col("entities")[0]))).withColumns({"truth": F.round("truth", 6), "claim_ids": F.array_join("claim_ids", ",")}),
    f"{_CD} select entities[2] || '|' || kind || '|' || entities[1] edge, round(avg(truth), 6) truth, count(*)::bigint n, string_agg(claim_id, ',' order by claim_id) claim_ids from claims where truth is not null group by 1",
)
_add("i28_has_dependents", lambda s, d: cl.with_dependents(_C(s, d), _D(s, d)).select("claim_id"), f"{_CD} select claim_id from claims where claim_id in (select target from deps)")
_add("i33_documents_without_denials", lambda s, d: ql.documents_by_claims(_C(s, d).select("video_id").distinct(), _C(s, d).where("stance = 'denies' and kind = 'opinion' and l_linenumber >= 5"), having=False), f"{_CD} select distinct video_id from claims where video_id not in (select video_id from claims where stance = 'denies' and kind = 'opinion' and l_linenumber >= 5)")
# K: jobs
NEEDS = [("fetched", None), ("nlp", "fetched"), ("claims", "nlp"), ("graph", "claims"), ("graph", "nlp")]
_STAGES = {"fetched": (0, 97), "nlp": (1, 5), "claims": (2, 4), "graph": (3, 3)}


def _records(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")).dropDuplicates(["o_orderkey"])
    made = F.array(*[F.when(F.col("o_orderkey") % m != 0, F.struct(F.lit(k).alias("stage"), F.date_add("day", (F.lit(i) - F.when(F.col("o_orderkey") % 7 == i, 5).otherwise(0)).cast("int")).alias("at"))) for k, (i, m) in _STAGES.items()])
    return o.select(F.concat(F.lit("v"), "o_orderkey").alias("video_id"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("video_id", "x.stage", "x.at")


_RECORDS = "rec as (" + " union all ".join(f"select 'v' || o_orderkey video_id, '{k}' stage, o_orderdate::date + ({i} - case when o_orderkey % 7 = {i} then 5 else 0 end)::int at_ from orders where o_orderkey % {m} <> 0" for k, (i, m) in _STAGES.items()) + ")"
_NEEDS = "needs(stage, need) as (values " + ", ".join(f"('{a}', {'null' if b is None else repr(b)})" for a, b in NEEDS) + ")"
_STATE = f"with {_RECORDS}, {_NEEDS}, st as (select o.video_id, n.stage, count(n.need) = count(r.at_) satisfied, bool_or(x.at_ is null or coalesce(r.at_ > x.at_, false)) stale from (select distinct 'v' || o_orderkey video_id from orders) o cross join needs n left join rec r on r.video_id = o.video_id and r.stage = n.need left join rec x on x.video_id = o.video_id and x.stage = n.stage group by 1, 2)"


def _state(s: SparkSession, d: str) -> DataFrame:
    docs = fx.table(s, d, "orders").select(F.concat(F.lit("v"), "o_orderkey").alias("video_id"))
    return jobs.stage_state(_records(s, d), docs, s.createDataFrame(NEEDS, "stage string, need string"))


_add("k15_stage_state", _state, f"{_STATE} select * from st")
_add("k17_work_list", lambda s, d: _state(s, d).where("stale and satisfied").groupBy("stage").agg(F.count(F.lit(1)).alias("n")), f"{_STATE} select stage, count(*)::bigint n from st where stale and satisfied group by 1")
_add("k20_status_listing", lambda s, d: jobs.status_listing(_records(s, d)).withColumn("stages", F.array_join("stages", " ")), f"with {_RECORDS} select video_id, string_agg(stage || '=' || strftime(at_, '%Y-%m-%d'), ' ' order by stage || '=' || strftime(at_, '%Y-%m-%d')) stages from rec group by 1")
_add("k10_k11_reset_progress", lambda s, d: jobs.reset_failed(fx.catalog(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("last_error").alias("errors")), f"with {fx.CATALOG} select case when status like 'failed%' then 'pending' else status end status, count(*)::bigint n, count(*) filter (status not like 'failed%' and last_error is not null)::bigint errors from catalog group by 1")


# M: self-contradiction among a speaker's last 200 utterances, by equality on the negated text
def _m3(s: SparkSession, d: str) -> DataFrame:
    t = fx.table(s, d, "conversations").select("conv_id", "role", "turn", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    # a negation of every third utterance follows it, so that some speakers contradict themselves
    t = t.union(t.where("turn % 3 = 0").select("conv_id", "role", F.col("turn") + 1000, F.concat(F.lit("not "), "low")))
    t = t.withColumn("speaker", F.concat_ws("/", F.col("conv_id").cast("string"), F.coalesce("role", F.lit("?"))))
    found = sk.self_contradictions(t.select("speaker", F.col("turn").alias("seq"), F.col("low").alias("text")))
    named = t.select("speaker", "conv_id", "role").distinct()
    return found.join(named, "speaker").select("conv_id", "role", F.col("seq").alias("turn"), "n", "weight")


_add(
    "m3_self_contradictions",
    _m3,
    "with b as (select conv_id, role, turn, lower(coalesce(text, '')) low from conversations), t as (select *, row_number() over (partition by conv_id, role order by turn, low) at_ from (select * from b union all select conv_id, role, turn + 1000, 'not ' || low from b where turn % 3 = 0)) "
    "select x.conv_id, x.role, x.turn, count(*)::bigint n, round(count(*) * -0.15, 4)::double weight from t x join t y on x.conv_id = y.conv_id and x.role is not distinct from y.role and y.at_ < x.at_ and x.at_ - y.at_ <= 200 and (y.low = 'not ' || x.low or x.low = 'not ' || y.low) group by 1, 2, 3",
)
