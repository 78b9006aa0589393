"""Registered queries of facets and claim graphs, each beside its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import facets as fa
from attestra.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


_C, _D = fx.claims, fx.dependencies


def pairs(s: SparkSession, d: str) -> DataFrame:
    """Dependencies as pairs of claims, some of them pending."""
    p = _D(s, d)
    route = F.when(F.col("source").like("%3"), "pending").when(F.col("kind") == "supports", "agreement").otherwise("contradiction")
    return p.select(F.col("source").alias("left"), F.col("target").alias("right"), "kind", route.alias("route"), F.when(F.col("kind") != "elaborates", "jaccard").alias("reason"), F.lit(1).alias("shared"), F.when(F.col("source").like("%2"), F.length("source") / 20.0).alias("similarity"), F.concat_ws(" vs ", "source", "target").alias("summary"))


def _cites() -> Column:
    return F.array(F.concat(F.lit("r"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 5000))


def bundle(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    c = _C(s, d).withColumns({"truth_source": F.when(k % 11 == 0, "override").when(F.col("truth").isNotNull(), "direct").otherwise("uncalibrated"), "in_verdict": n % 4 == 0, "derived": F.when(n > 1, F.col("truth")), "relationships": _cites()})
    return fa.claim_bundle(c, _D(s, d), pairs(s, d))


_CD = f"with {fx.LI}, {fx.CLAIMS}, {fx.DEPS}"
_PR = "pr as (select source as \"left\", target as \"right\", kind, case when source like '%3' then 'pending' when kind = 'supports' then 'agreement' else 'contradiction' end route, case when kind <> 'elaborates' then 'jaccard' end reason, case when source like '%2' then length(source) / 20.0 end similarity from deps)"
_BU = f"""{_CD}, {_PR}, dg as (select c, sum(o) o, sum(i) i, sum(x) x from (select source c, 1 o, 0 i, 0 x from deps union all select target, 0, 1, 0 from deps union all select "left", 0, 0, 1 from pr where route <> 'pending' union all select "right", 0, 0, 1 from pr where route <> 'pending') group by 1),
bu as (select claims.*, coalesce(o, 0)::bigint out_degree, coalesce(i, 0)::bigint in_degree, coalesce(x, 0)::bigint contradictions, case when l_orderkey % 11 = 0 then 'override' when truth is not null then 'direct' else 'uncalibrated' end truth_source, l_linenumber % 4 = 0 in_verdict, case when l_linenumber > 1 then truth end derived, 'r' || (l_orderkey * 7 + l_linenumber) % 5000 rl from claims left join dg on c = claim_id)"""
_add("j5_claim_bundle", lambda s, d: bundle(s, d).select("claim_id", "out_degree", "in_degree", "contradictions"), f"{_BU} select claim_id, out_degree, in_degree, contradictions from bu")
_WANT = fa.ClaimFilter(q=" ECONOMY", kinds=["opinion", "historical"], stances=["denies", "uncertain"], sources=["direct", "uncalibrated"], confidence=(0.92, 1.0), date=(dt.date(1993, 1, 1), dt.date(1998, 12, 31)), verdict=["no"], has_in=["yes"])
_OTHER = fa.ClaimFilter(truth=(0.1, 0.9), contradicted=["yes"], has_out=["yes"], entities=["thing:p1", "thing:p2", "thing:p3", "thing:p4", "thing:p5", "organization:s1", "organization:s2", "organization:s3"])
_M1 = {"q": "(contains(lower(text), 'economy') or contains(lower(kind), 'economy'))", "kind": "kind in ('opinion', 'historical')", "stance": "stance in ('denies', 'uncertain')", "source": "truth_source in ('direct', 'uncalibrated')", "confidence": "confidence between 0.92 and 1", "date": "published between date '1993-01-01' and date '1998-12-31'", "verdict": "not in_verdict", "has_in": "in_degree > 0"}
_add("j1_topic_claims", lambda s, d: bundle(s, d).where(fa.matches_topic("P12")).select("claim_id"), f"{_BU} select claim_id from bu where len([e for e in entities if contains(e, 'p12')]) > 0")
_add("j2_claim_filter", lambda s, d: fa.passing(bundle(s, d), _WANT.parts()).select("claim_id"), f"{_BU} select claim_id from bu where {' and '.join(_M1.values())}")
_add("j2_claim_filter_by_entities", lambda s, d: fa.passing(bundle(s, d), _OTHER.parts()).select("claim_id"), f"{_BU} select claim_id from bu where truth between 0.1 and 0.9 and contradictions > 0 and out_degree > 0 and entities[1] in ('thing:p1', 'thing:p2', 'thing:p3', 'thing:p4', 'thing:p5') and entities[2] in ('organization:s1', 'organization:s2', 'organization:s3')")


def _but(own: str) -> str:
    return " and ".join(v for k, v in _M1.items() if k != own) or "true"


_B3 = {"kind": "kind", "stance": "stance", "source": "truth_source"}
_add(
    "j3_j9_counts_but_own",
    lambda s, d: fa.counts_but_own(bundle(s, d), _WANT.parts(), {**{k: fa.single(F.col(v)) for k, v in _B3.items()}, "entities": F.filter("entities", lambda e: e.startswith("organization"))}, {"kind": ["opinion", "fiction"]}),
    f"{_BU}, x as (" + " union all ".join([f"select '{k}' facet, {v} bucket, count(*)::bigint n from bu where {_but(k)} group by 2" for k, v in _B3.items()] + [f"select 'entities', entities[2], count(*) from bu where {_but('entities')} group by 2"]) + ") select * from x union all select 'kind', 'fiction', 0 where not exists (from x where facet = 'kind' and bucket = 'fiction') union all select 'kind', 'opinion', 0 where not exists (from x where facet = 'kind' and bucket = 'opinion')",
)


def _j4(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name in fa.CLAIM_SORTS:
        one = fa.sorted_rows(bundle(s, d), name, fa.CLAIM_SORTS, ["claim_id"], 40).select(F.lit(name).alias("sort"), "rank", "claim_id")
        out = one if out is None else out.union(one)
    return out


_ORD = {"certain": "abs(round(coalesce(truth, 0.5) - 0.5, 6)) desc", "uncertain": "abs(round(coalesce(truth, 0.5) - 0.5, 6))", "contradicted": "contradictions desc", "cited": "in_degree desc", "conf-high": "coalesce(confidence, 0) desc", "conf-low": "coalesce(confidence, 0)"}
_add("j4_claim_sorts", _j4, f"{_BU} " + " union all ".join(f"select * from (select '{k}' sort, row_number() over (order by {o}, claim_id)::int rank, claim_id from bu) where rank <= 40" for k, o in _ORD.items()))
_add("j7_integer_histogram", lambda s, d: fa.integer_histogram(bundle(s, d).withColumn("n", F.col("l_linenumber") * 2 - 3), "n", 0, 8), f"{_CD} select g::int bin, count(l_linenumber)::bigint n from range(9) t(g) left join claims on greatest(0, least(8, l_linenumber * 2 - 3)) = g group by 1")


# J10-J12
def _pairs(s: SparkSession, d: str) -> DataFrame:
    return fa.pair_bundle(pairs(s, d), _C(s, d))


_PF = fa.PairFilter(q=" Ring", kinds=["supports", "elaborates", "contradicts"], reasons=["__none__", "jaccard"], shared=(1, 3), date=(dt.date(1994, 1, 1), dt.date(1996, 12, 31)))
_PB = f"{_CD}, {_PR}, pb as (select pr.*, l.text lt, r.text rt, l.published lp, r.published rp, l.entities le, r.entities re, l.kind lk, r.kind rk, l.video_id lv from pr left join claims l on l.claim_id = \"left\" left join claims r on r.claim_id = \"right\")"
_PM = {"q": "contains(lower(concat_ws(chr(10), \"left\", \"right\", lt, rt, array_to_string(le, ' '), array_to_string(re, ' '), lk, rk)), 'ring')", "kind": "kind in ('supports', 'elaborates', 'contradicts')", "reason": "true", "date": "(lp between date '1994-01-01' and date '1996-12-31' or rp between date '1994-01-01' and date '1996-12-31')"}
_add("j10_pair_filter", lambda s, d: fa.passing(_pairs(s, d), _PF.parts()).select("left", "right"), f"{_PB} select \"left\", \"right\" from pb where {' and '.join(_PM.values())}")
_add("j10_pair_filter_by_documents", lambda s, d: fa.passing(_pairs(s, d), fa.PairFilter(documents=["v1", "v33", "v70"], similarity=(0.5, 0.75)).parts()).select("left", "right"), f"{_PB} select \"left\", \"right\" from pb where lv in ('v1', 'v33', 'v70') and similarity between 0.5 and 0.75")
_add("j11_pair_counts", lambda s, d: fa.counts_but_own(_pairs(s, d), _PF.parts(), {"kind": fa.single(F.col("kind")), "reason": fa.single(F.coalesce("reason", F.lit("__none__")))}, {"kind": ["manual"]}), f"{_PB} select 'kind' facet, kind bucket, count(*)::bigint n from pb where {_PM['q']} and {_PM['date']} group by 2 union all select 'reason', coalesce(reason, '__none__'), count(*) from pb where {_PM['q']} and {_PM['date']} and {_PM['kind']} group by 2 union all select 'kind', 'manual', 0")
_add("j12_pair_sorts", lambda s, d: fa.sorted_rows(_pairs(s, d), "similarity-desc", fa.PAIR_SORTS, ["left", "right"], 60).select("rank", "left", "right").union(fa.sorted_rows(_pairs(s, d), "kind", fa.PAIR_SORTS, ["left", "right"], 60).select("rank", "left", "right")), f"{_PB} select * from (select row_number() over (order by coalesce(similarity, -1) desc, \"left\", \"right\")::int rank, \"left\", \"right\" from pb) where rank <= 60 union all select * from (select row_number() over (order by kind, \"left\", \"right\")::int rank, \"left\", \"right\" from pb) where rank <= 60")


# J13-J19
def _facts(s: SparkSession, d: str) -> DataFrame:
    return fa.document_facts(_C(s, d).select("video_id", F.explode("entities").alias("entity_id")))[0]


_FA = f"{_CD}, fa as (select e entity_id, video_id, count(*)::bigint n from (select video_id, unnest(entities) e from claims) group by 1, 2)"
_add("j13_document_facts", lambda s, d: fa.document_facts(_C(s, d).select("video_id", F.explode("entities").alias("entity_id")))[1], f"{_FA} select split_part(entity_id, ':', 1) as type, sum(n)::bigint total from fa group by 1")
_GROUPS = [["thing:p1", "thing:p2", "thing:p3", "thing:p4", "thing:p5"], ["organization:s1", "organization:s2"]]
_ACT = "ac as (select video_id from fa where entity_id in ('thing:p1', 'thing:p2', 'thing:p3', 'thing:p4', 'thing:p5') intersect select video_id from fa where entity_id in ('organization:s1', 'organization:s2'))"
_add("j14_active_documents_of_groups", lambda s, d: fa.active_documents(_facts(s, d), _GROUPS), f"{_FA}, {_ACT} select * from ac")
_add("j15_j16_scope_totals", lambda s, d: fa.top_in_scope(_facts(s, d), fa.active_documents(_facts(s, d), _GROUPS), "thing", 8, ["thing:p1", "thing:p150"]), f"{_FA}, {_ACT}, t as (select entity_id, sum(n)::bigint n from fa where entity_id like 'thing:%' and video_id in (from ac) group by 1), u as (select * from (from t order by n desc, entity_id limit 8) union select * from t where entity_id in ('thing:p1', 'thing:p150')) select *, (select coalesce(sum(n), 0) from t)::bigint total from u")


def _j17(s: SparkSession, d: str) -> DataFrame:
    month = F.concat(F.lit("specific_month:"), F.date_format("published", "yyyy-MM"))
    scoped = _C(s, d).where("stance = 'denies'").groupBy(month.alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    from attestra.operators import dates

    times = dates.time_axis(scoped.select("entity_id", F.lit("specific_month").alias("label"), F.substring_index("entity_id", ":", -1).alias("canonical")))
    return fa.time_facet(scoped, times)


_add("j17_time_facet", _j17, f"{_CD} select 'specific_month:' || strftime(published, '%Y-%m') entity_id, count(*)::bigint n, epoch_ms(date_trunc('month', any_value(published))::timestamp) sort_value from claims where stance = 'denies' group by 1")
_add("j18_fixed_order", lambda s, d: fa.fixed_order(_C(s, d).where("kind <> 'opinion'").groupBy(F.col("kind").alias("bucket")).agg(F.count(F.lit(1)).alias("n")), ["opinion", "empirical", "historical"]), f"{_CD} select place::int place, b bucket, count(kind)::bigint n from (values (0, 'opinion'), (1, 'empirical'), (2, 'historical')) t(place, b) left join claims on kind = b and kind <> 'opinion' group by 1, 2")
_add("j19_entity_options", lambda s, d: fa.entity_options(_facts(s, d)), f"{_FA} select entity_id, sum(n)::bigint n from fa group by 1 order by n desc, entity_id limit 50")


# J20-J22, J26-J31
def _hood(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _C(s, d).withColumn("relationships", _cites())
    seeds = [fa.seeds_of(c, kind, key) for kind, key in (("entity", "thing:p12"), ("document", "v7"), ("claim", "v1:c_1_2"))]
    return fa.claim_neighbourhood(c, _D(s, d), pairs(s, d).where("route = 'contradiction'"), seeds[0].union(seeds[1]).union(seeds[2]))


_HO = f"""{_BU}, ln as (select source f, target t, kind from deps union select "left", "right", 'contradiction' from pr where route = 'contradiction' union select x.claim_id, y.claim_id, 'shared-evidence' from bu x join bu y on x.rl = y.rl and x.claim_id <> y.claim_id),
sd as (select claim_id from bu where list_contains(entities, 'thing:p12') or video_id = 'v7' or claim_id = 'v1:c_1_2'), ed as (select distinct f, t, kind from ln where f in (from sd) or t in (from sd) and kind <> 'shared-evidence'), kn as (select f, t, kind from ed where f in (select claim_id from bu) and t in (select claim_id from bu))"""
_add("j20_j22_claim_graph_nodes", lambda s, d: _hood(s, d)[0], f"{_HO} select claim_id, min(distance)::int distance from (select claim_id, 0 distance from sd union all select f, 1 from kn union all select t, 1 from kn) group by 1")
_add("j21_claim_graph_edges", lambda s, d: _hood(s, d)[1].select(F.col("from").alias("f"), F.col("to").alias("t"), "kind"), f"{_HO} select * from kn")
_add("j26_document_claim_totals", lambda s, d: fa.document_totals(bundle(s, d)), f"{_BU} select video_id, count(*)::bigint claims, count(derived)::bigint derived, sum(contradictions)::bigint contradiction_links, sum(in_degree)::bigint inbound from bu group by 1")


def _j27(s: SparkSession, d: str) -> DataFrame:
    return fa.claim_detail(_D(s, d), pairs(s, d), "v1:c_1_2").union(fa.claim_detail(_D(s, d), pairs(s, d), "v7:c_7_2"))


_ONE = "select route section, case when \"left\" = '{0}' then \"right\" else \"left\" end other, reason kind from pr where route <> 'pending' and '{0}' in (\"left\", \"right\") union all select 'out', target, kind from deps where source = '{0}' union all select 'in', source, kind from deps where target = '{0}'"
_add("j27_claim_detail", _j27, f"{_CD}, {_PR} {_ONE.format('v1:c_1_2')} union all {_ONE.format('v7:c_7_2')}")
_add(
    "j28_seed_options",
    lambda s, d: fa.seed_options(fa.entity_options(_facts(s, d), 1000).withColumn("canonical", F.substring_index("entity_id", ":", -1)), fx.catalog(s, d), _C(s, d), "p19"),
    f"{_FA}, {fx.CATALOG}, o as (select 0 s, 'entity' section, entity_id id, split_part(entity_id, ':', 2) as label, split_part(entity_id, ':', 1) sub, -n::double o from (select entity_id, sum(n) n from fa group by 1 order by n desc, entity_id limit 1000) union all select 1, 'document', video_id, coalesce(title, video_id), coalesce(published::varchar, ''), coalesce(-(published - date '1970-01-01'), 1e9)::double from catalog union all select 2, 'claim', claim_id, text, video_id, 0 from claims) select section, id, label from o where contains(lower(concat_ws(chr(10), label, id, sub)), 'p19') order by s, o, id limit 50",
)
_LAB = "case when trim(coalesce(title, '')) = '' then r.video_id when length(trim(title)) > 34 then trim(title)[1:33] || '…' else trim(title) end"
_TI = "ti as (select 'v' || o_orderkey video_id, case when o_orderkey % 4 = 0 then '  ' when o_orderkey % 4 = 1 then c_name || ' and a title that is much too long' else c_name end title from orders join customer on o_custkey = c_custkey where o_orderkey % 5 <> 0)"


def _titles(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders").join(fx.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("o_orderkey % 5 <> 0")
    k = F.col("o_orderkey") % 4
    return o.select(F.concat(F.lit("v"), "o_orderkey").alias("video_id"), F.when(k == 0, "  ").when(k == 1, F.concat("c_name", F.lit(" and a title that is much too long"))).otherwise(F.col("c_name")).alias("title"))


_add("j29_documents_in_scope", lambda s, d: fa.documents_in_scope(_C(s, d).where("stance = 'denies'"), _titles(s, d), "V1"), f"{_CD}, {_TI}, r as (select video_id, count(*)::bigint n from claims where stance = 'denies' group by 1) select r.video_id, {_LAB} as label, n from r left join ti on ti.video_id = r.video_id where contains(lower(concat_ws(chr(10), title, r.video_id)), 'v1')")
_add("j30_short_labels", lambda s, d: fa.short_labels(_C(s, d).select("video_id").distinct(), _titles(s, d)).select("video_id", "label"), f"{_CD}, {_TI}, r as (select distinct video_id from claims) select r.video_id, {_LAB} as label from r left join ti on ti.video_id = r.video_id")
_add("j31_graph_seeds", lambda s, d: fa.graph_seeds(fa.sorted_rows(_pairs(s, d), "similarity-desc", fa.PAIR_SORTS, ["left", "right"], 80).select(F.explode(F.array("left", "right")).alias("claim_id"), "rank")), f"{_PB}, r as (select row_number() over (order by coalesce(similarity, -1) desc, \"left\", \"right\") rank, \"left\" l, \"right\" r from pb), t as (select c, min(rank) rank from (select l c, rank from r where rank <= 80 union all select r, rank from r where rank <= 80) group by 1) select c claim_id, row_number() over (order by rank, c)::int place, true truncated from t qualify place <= 60")
