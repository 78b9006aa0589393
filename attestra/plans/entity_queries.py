"""Registered queries of entity curation, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import curation as cu
from attestra.operators import entities as en
from attestra.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


LABELS = ["person", "organization", "quantity", "role"]


def named(s: SparkSession, d: str) -> DataFrame:
    """Mentions (video_id, label, canonical): parts' names in seven forms."""
    j = fx.lines(s, d).join(fx.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, k = F.col("p_name"), F.col("l_linenumber")
    form = F.when(k == 1, n).when(k == 2, F.concat(F.lit("the "), n)).when(k == 3, F.split_part(n, F.lit(" "), F.lit(2))).when(k == 4, F.concat(n, F.lit("'s"))).when(k == 5, F.concat(F.lit("Dr. "), n)).when(k == 6, F.concat(F.lit("[music] "), n)).otherwise(F.upper(n))
    return j.select(F.concat(F.lit("v"), F.col("l_orderkey") % 200).alias("video_id"), fx._pick(LABELS, F.col("l_partkey")).alias("label"), form.alias("canonical"), F.col("l_orderkey").alias("start"))


_NORM = "regexp_replace(trim(lower(canonical)), '\\s+', ' ', 'g')"
_NAMED = f"""{fx.LI}, na as (select *, label || ':' || norm k from (select *, {_NORM} norm from (select 'v' || l_orderkey % 200 video_id, {fx._sql_list(LABELS)}[1 + l_partkey % 4] as label, l_orderkey as start,
  case l_linenumber when 1 then p_name when 2 then 'the ' || p_name when 3 then split_part(p_name, ' ', 2) when 4 then p_name || '''s' when 5 then 'Dr. ' || p_name when 6 then '[music] ' || p_name else upper(p_name) end canonical from li join part on l_partkey = p_partkey))),
co as (select k entity_id, label, norm, max({{'l': length(canonical), 'c': canonical}}).c canonical, count(*)::bigint total, count(distinct video_id)::bigint documents from na group by 1, 2, 3)"""


def _part(s: SparkSession, d: str, mod: int) -> DataFrame:
    return fx.table(s, d, "part").where(f"p_partkey % {mod} = 0").select(fx._pick(LABELS, F.col("p_partkey")).alias("label"), F.col("p_name").alias("n"))


def not_same(s: SparkSession, d: str) -> DataFrame:
    return _part(s, d, 6).select(F.concat_ws(":", "label", "n").alias("a"), F.concat(F.col("label"), F.lit(":the "), "n").alias("b")).distinct()


def handled(s: SparkSession, d: str) -> DataFrame:
    return _part(s, d, 9).select(F.concat(F.col("label"), F.lit(":"), F.split_part("n", F.lit(" "), F.lit(2))).alias("entity_id")).distinct()


def merges(s: SparkSession, d: str) -> DataFrame:
    """The possessive into the plain name, for some parts."""
    return _part(s, d, 5).select(F.concat(F.col("label"), F.lit(":"), "n", F.lit("'s")).alias("source"), F.concat_ws(":", "label", "n").alias("target")).distinct()


_P = f"(select {fx._sql_list(LABELS)}[1 + p_partkey % 4] lb, p_name n from part where p_partkey % {{}} = 0)"
_FIX = f"""{_NAMED}, ns as (select distinct lb || ':' || n a, lb || ':the ' || n b from {_P.format(6)}), hd as (select distinct lb || ':' || split_part(n, ' ', 2) entity_id from {_P.format(9)}), mg as (select distinct lb || ':' || n || '''s' source, lb || ':' || n target from {_P.format(5)})"""


# Overrides applied
def _p(k: F.Column) -> F.Column:
    return F.concat(F.lit("thing:p"), k)


def _chain(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "part").where("p_partkey % 5 <> 0").select(_p(F.col("p_partkey")).alias("source"), _p(F.col("p_partkey") - 1).alias("target"))


def _gone(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "part").where("p_partkey % 7 = 0").select(_p(F.col("p_partkey")).alias("entity_id"))


_add("e3_compiled_overrides", lambda s, d: cu.compiled(_chain(s, d), _gone(s, d)), "select 'thing:p' || p_partkey source, case when p_partkey % 7 <> 0 then 'thing:p' || (p_partkey - 1) end target from part where p_partkey % 5 <> 0 or p_partkey % 7 = 0")


def _e6(s: SparkSession, d: str) -> DataFrame:
    own = fx.claims(s, d).where("l_linenumber = 1").select("video_id", F.get("entities", F.lit(0)).alias("source")).distinct().withColumn("target", _p(F.split_part("source", F.lit(":p"), F.lit(2)).cast("long") + 1))
    rows = fx.claims(s, d).select("claim_id", "video_id", F.get("entities", F.lit(0)).alias("entity_id"))
    return cu.resolve_in_documents(rows, own, en.close_merges(_chain(s, d)), _gone(s, d)).select("claim_id", "entity_id")


_add(
    "e6_document_aliases",
    _e6,
    f"with {fx.LI}, {fx.CLAIMS}, c as (select claim_id, video_id, entities[1][8:]::bigint p, l_linenumber from claims), own as (select distinct video_id, p from c where l_linenumber = 1), r as (select claim_id, case when own.p is null then c.p else c.p + 1 end q from c left join own on own.video_id = c.video_id and own.p = c.p), f as (select claim_id, case when q in (select p_partkey from part) then q - q % 5 else q end q from r) select claim_id, 'thing:p' || q entity_id from f where q % 7 <> 0 or q not in (select p_partkey from part)",
)
_add("e7_display_names", lambda s, d: cu.displayed(cu.corpus(named(s, d)), handled(s, d).withColumn("name", F.upper("entity_id"))).select("entity_id", "canonical"), f"with {_FIX} select co.entity_id, case when hd.entity_id is not null then upper(hd.entity_id) else canonical end canonical from co left join hd on hd.entity_id = co.entity_id")
_add(
    "e8_deleted_relations",
    lambda s, d: cu.without_deleted_relations(fx.relationships(s, d), fx.relationships(s, d).where("predicate = 'denies' and time_start = 8").select("transcript_id", "subject_id", "predicate", "object_id", (F.col("time_start") + 0.7).alias("time")).distinct()).groupBy("predicate", "time_start").agg(F.count(F.lit(1)).alias("n")),
    f"with {fx.REL} select predicate, time_start, count(*)::bigint n from rel where not (predicate = 'denies' and time_start = 8) group by 1, 2",
)

# clusters
_CLUSTERS = f"""with recursive {_FIX}, dk as (select distinct video_id, label, norm, k from na where label <> 'quantity'),
sp as (select x.k shorter, y.k longer, count(*) together from dk x join dk y on x.video_id = y.video_id and x.label = y.label and length(x.norm) < length(y.norm) and contains(y.norm, x.norm) where length(x.norm) > 2 group by 1, 2),
pr as (select sp.* from sp where not exists (from ns where least(a, b) = least(shorter, longer) and greatest(a, b) = greatest(shorter, longer))),
ed as (select shorter u, longer v from pr union select longer, shorter from pr), rc(u, t) as (select u, u from ed union select rc.u, ed.v from rc join ed on rc.t = ed.u), rt as (select u, min(t) root from rc group by 1),
cl as (select root, string_agg(entity_id, '||' order by entity_id) as cluster, max({{'l': length(canonical), 'e': entity_id}}).e canonical_key, count(*)::bigint members from rt join co on u = entity_id group by 1), tg as (select root, sum(together)::bigint together from pr join rt on shorter = u group by 1)"""


def clusters(s: SparkSession, d: str) -> DataFrame:
    return cu.merge_clusters(named(s, d), not_same(s, d))


_add("e9_e12_merge_clusters", lambda s, d: clusters(s, d).select("cluster", "canonical_key", F.size("members").cast("long").alias("members"), "together"), f"{_CLUSTERS} select cluster, canonical_key, members, together from cl join tg using (root)")


def _e11(s: SparkSession, d: str) -> DataFrame:
    c = clusters(s, d)
    all_merged = c.where("canonical_key like 'person:%'").select(F.explode("members").alias("source"))
    return cu.cluster_status(c, merges(s, d).select("source").union(all_merged), not_same(s, d), c.where("canonical_key like 'role:%'").select("cluster"))


_add("e11_cluster_status", _e11, f"{_CLUSTERS} select cluster, case when canonical_key like 'role:%' then 'dismissed' when canonical_key like 'person:%' or not exists (from rt where rt.root = cl.root and u <> canonical_key and u not in (select source from mg) and not exists (from ns where least(a, b) = least(u, canonical_key) and greatest(a, b) = greatest(u, canonical_key))) then 'resolved' else 'pending' end status from cl")


def _e13(s: SparkSession, d: str) -> DataFrame:
    c = clusters(s, d)
    found, apart = cu.reviewed(c, c.select("cluster", F.explode("members").alias("member")).where("member like '%s'"))
    return found.select(F.lit("merge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")).union(apart.select(F.lit("not-same"), "a", "b"))


_add("e13_review_decisions", _e13, f"{_CLUSTERS}, m as (select u, canonical_key c from rt join cl using (root) where u <> canonical_key) select 'merge' kind, u a, c b from m where u like '%s' union all select 'not-same', least(u, c), greatest(u, c) from m where u not like '%s'")

# E14-E16
_LISTED = ["thing:p", "role:"]


def _deletions(s: SparkSession, d: str) -> DataFrame:
    listed = _part(s, d, 4).select(F.concat_ws(":", "label", "n").alias("entity_id")).union(handled(s, d))
    return cu.committed_deletions(cu.corpus(named(s, d)), merges(s, d), handled(s, d), ["quantity", "role"], listed)


_add("e14_e15_committed_deletions", _deletions, f"with {_FIX}, h as (select entity_id from hd union select source from mg), li2 as (select distinct lb || ':' || n entity_id from {_P.format(4)} union select entity_id from hd) select entity_id, 'label' source, case when entity_id in (from h) then 'skipped' else 'applied' end outcome from co where label in ('quantity', 'role') union all select entity_id, 'list', case when entity_id in (from h) or entity_id in (select entity_id from co where label in ('quantity', 'role')) then 'skipped' else 'applied' end from li2")


def _promotions(s: SparkSession, d: str) -> DataFrame:
    listed = _part(s, d, 2).select(F.concat(F.col("label"), F.lit(":the "), "n").alias("source"), F.concat_ws(":", "label", "n").alias("target")).union(merges(s, d))
    out, after = cu.committed_promotions(listed, cu.corpus(named(s, d)), merges(s, d), handled(s, d), not_same(s, d))
    return out.select("source", "target", "outcome").union(after.select("source", "target", F.lit("merge")))


_add("e16_committed_promotions", _promotions, f"with {_FIX}, l as (select distinct lb || ':the ' || n source, lb || ':' || n target from {_P.format(2)} union select * from mg), o as (select *, case when source in (select entity_id from co) and target in (select entity_id from co) and source not in (from hd) and target not in (from hd) and source not in (select source from mg) and not exists (from ns where least(a, b) = least(source, target) and greatest(a, b) = greatest(source, target)) then 'applied' else 'skipped' end outcome from l) select * from o union all select source, target, 'merge' from (select * from mg union all select source, target from o where outcome = 'applied') where source not in (from hd)")

# E17-E21
_COMMON = ["ring", "bolt"]
_E17 = f"""with {_FIX}, e as (select video_id, label, norm, k, count(*) n, [t for t in string_split_regex(norm, '[^a-z0-9]+') if t <> ''] toks from na group by 1, 2, 3, 4), dm as (select distinct video_id, k from na where start % 10 = 0 and norm like '%s'),
w as (select e.*, case when label not in ('person', 'organization', 'group_or_movement', 'location', 'facility', 'event') then 'label' when k in (from hd) or exists (from dm where dm.video_id = e.video_id and dm.k = e.k) then 'handled' when len(toks) = 0 or len([t for t in toks if length(t) < 3]) > 0 then 'short' when len(toks) = 1 and toks[1] in ('ring', 'bolt') then 'common' end why from e),
p as (select x.video_id, x.k source, count(*) m, min(y.k) target, bool_or(y.k in (from hd)) yh from w x join e y on x.video_id = y.video_id and x.label = y.label and x.k <> y.k and y.n >= 2 and y.toks[1] <> 'the' and contains(' ' || array_to_string(y.toks, ' ') || ' ', ' ' || array_to_string(x.toks, ' ') || ' ') where x.why is null group by 1, 2)
select video_id, source, case when m = 1 then target end target, case when m > 1 then 'ambiguous' when exists (from ns where least(a, b) = least(source, target) and greatest(a, b) = greatest(source, target)) then 'not-same' when yh then 'target-handled' else 'proposed' end outcome from p union all select video_id, k, null, why from w where why is not null"""


def _e17(s: SparkSession, d: str) -> DataFrame:
    n = named(s, d)
    own = n.where("start % 10 = 0").select("video_id", F.concat_ws(":", "label", F.regexp_replace(F.trim(F.lower("canonical")), r"\s+", " ")).alias("source")).where("source like '%s'").distinct()
    return cu.shortened(n, handled(s, d), own, not_same(s, d), _COMMON)


_add("e17_shortened_names", _e17, _E17)
_add("e18_article_merges", lambda s, d: en.article_merges(cu.corpus(named(s, d))), f"with {_FIX} select x.entity_id source, y.entity_id target from co x join co y on x.norm = 'the ' || y.norm and x.label = y.label")
_add("e19_bracketed_artifacts", lambda s, d: cu.bracketed(cu.corpus(named(s, d)), handled(s, d)).select("entity_id", "total", "documents"), f"with {_FIX} select entity_id, total, documents from co where (contains(norm, '[music]') or regexp_matches(canonical, '^\\[.+\\]$')) and entity_id not in (from hd)")
_add(
    "e20_normal_form_merges",
    lambda s, d: cu.normal_form_merges(cu.corpus(named(s, d)), not_same(s, d)),
    f"with {_FIX}, f as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(case when label = 'person' then regexp_replace(lower(canonical), '^dr\\. ', '') else lower(canonical) end, '^the ', ''), '''s$', ''), '[^a-z0-9\\s-]', '', 'g'), '\\s+', ' ', 'g') nk from co), b as (select label, nk, max({{'t': total, 'e': entity_id}}).e target from f group by 1, 2 having count(*) > 1) select entity_id source, target from f join b using (label, nk) where entity_id <> target and not exists (from ns where least(a, b) = least(entity_id, target) and greatest(a, b) = greatest(entity_id, target))",
)


def _proposals(s: SparkSession, d: str) -> DataFrame:
    p = fx.table(s, d, "part")
    k, label = F.col("p_partkey"), fx._pick(LABELS, F.col("p_partkey"))
    key = lambda before, after: F.concat(label, F.lit(":" + before), "p_name", F.lit(after))
    verdict = fx._pick(["MERGE-INTO", "DELETE-GLOBAL", "PER-VIDEO-MERGE", "KEEP", "OTHER"], k)
    source = F.when(k % 3 == 0, key("the ", "")).when(k % 3 == 1, key("", "'s")).otherwise(key("dr. ", ""))
    target = F.when(k % 11 == 0, source).when(k % 13 == 0, None).otherwise(key("", ""))
    return p.select(k.alias("seq"), verdict.alias("verdict"), F.concat(F.lit("v"), k % 3).alias("video_id"), source.alias("source"), F.when(verdict == "DELETE-GLOBAL", None).otherwise(target).alias("target"))


_PROP = f"""pp as (select p_partkey seq, ['MERGE-INTO', 'DELETE-GLOBAL', 'PER-VIDEO-MERGE', 'KEEP', 'OTHER'][1 + p_partkey % 5] verdict, 'v' || p_partkey % 3 video_id, {fx._sql_list(LABELS)}[1 + p_partkey % 4] || ':' || case p_partkey % 3 when 0 then 'the ' || p_name when 1 then p_name || '''s' else 'dr. ' || p_name end source, {fx._sql_list(LABELS)}[1 + p_partkey % 4] || ':' || p_name plain from part),
po as (select seq, verdict, video_id, source, case when verdict = 'DELETE-GLOBAL' then null when seq % 11 = 0 then source when seq % 13 = 0 then null else plain end target from pp),
dl as (select source, min(seq) at_ from po where verdict = 'DELETE-GLOBAL' and source in (select entity_id from co) and source not in (from hd) group by 1),
g as (select po.*, x.at_ as xa, y.at_ as ya from po left join dl x on x.source = po.source left join dl y on y.source = po.target),
h as (select *, case when target is null then 'missing fields' when source = target then 'source is target' when source not in (select entity_id from co) or target not in (select entity_id from co) then 'endpoint not in corpus' when source in (from hd) or target in (from hd) or coalesce(xa < seq, false) or coalesce(ya < seq, false) then 'endpoint already deleted' end com, exists (from ns where least(a, b) = least(source, target) and greatest(a, b) = greatest(source, target)) apart from g),
r as (select *, case when verdict = 'DELETE-GLOBAL' then case when source not in (select entity_id from co) then 'not in corpus' when source in (from hd) or seq > xa then 'already deleted' end when verdict = 'MERGE-INTO' then coalesce(com, case when source in (select source from mg) then 'already merged' when apart then 'marked not the same' end) when verdict = 'PER-VIDEO-MERGE' then coalesce(com, case when apart then 'marked not the same' end) when verdict = 'KEEP' then 'info' else 'unknown verdict OTHER' end reason from h)
select seq, verdict, video_id, source, target, case when reason is null and verdict = 'MERGE-INTO' and row_number() over (partition by verdict, source, reason is null order by seq) > 1 then 'already merged' when reason is null and verdict = 'PER-VIDEO-MERGE' and row_number() over (partition by verdict, source, video_id, reason is null order by seq) > 1 then 'already merged in document' else reason end reason from r"""
_add("e21_applied_proposals", lambda s, d: cu.applied_proposals(_proposals(s, d), cu.corpus(named(s, d)), merges(s, d), handled(s, d), s.createDataFrame([], "video_id string, source string"), not_same(s, d)), f"with {_FIX}, {_PROP}")

# E23-E27
_TOK = "[t for t in list_distinct(string_split_regex(norm, '[^a-z0-9]+')) if t <> '']"
_add("e23_token_neighbours", lambda s, d: cu.token_neighbours(cu.corpus(named(s, d))), f"with {_FIX}, t as (select entity_id, label, total, unnest({_TOK}) tok from co), p as (select x.entity_id, y.entity_id other, y.total, count(*)::bigint overlap from t x join t y on x.label = y.label and x.tok = y.tok and x.entity_id <> y.entity_id group by 1, 2, 3) select entity_id, other, overlap, total, row_number() over (partition by entity_id order by overlap desc, total desc, other)::int rank from p qualify rank <= 8")
_add(
    "e24_context_samples",
    lambda s, d: cu.context_samples(named(s, d).select(F.concat_ws(":", "label", F.lower("canonical")).alias("entity_id"), "video_id", "start").distinct()),
    f"with {_FIX}, m as (select distinct label || ':' || lower(canonical) entity_id, video_id, start from na), r as (select *, row_number() over (partition by entity_id, video_id order by start) rd, count(*) over (partition by entity_id, video_id) said from m) select entity_id, row_number() over (partition by entity_id order by rd, said desc, video_id)::int place, video_id, start from r where rd <= 2 qualify place <= 5",
)
_AMB = f"with {_FIX}, e as (select *, [t for t in string_split_regex(norm, '[^a-z0-9]+') if t <> ''] toks from co where label = 'person'), p as (select x.entity_id, y.entity_id candidate, y.total, row_number() over (partition by x.entity_id order by y.total desc, y.entity_id)::int rank from e x join e y on len(x.toks) = 1 and length(x.toks[1]) >= 3 and len(y.toks) > 1 and list_contains(y.toks, x.toks[1]))"
_add("e25_ambiguous_names", lambda s, d: cu.ambiguous_names(cu.corpus(named(s, d))), f"{_AMB} select * from p where rank <= 10")
_add("e26_documents_to_review", lambda s, d: cu.documents_to_review(named(s, d), cu.ambiguous_names(cu.corpus(named(s, d))).select("entity_id")), f"{_AMB} select video_id, count(distinct k)::bigint n from na where k in (select entity_id from p) group by 1 order by n desc, video_id limit 50")


def _status(s: SparkSession, d: str) -> DataFrame:
    closed = en.close_merges(merges(s, d))
    return en.status(cu.corpus(named(s, d)).select("entity_id"), closed, handled(s, d))


_add("e27_remaining_entities", lambda s, d: cu.remaining(cu.corpus(named(s, d)), _status(s, d)), f"with {_FIX} select label, row_number() over (partition by label order by total desc, entity_id)::int rank, entity_id, total, documents from co where entity_id not in (from hd) and entity_id not in (select source from mg) qualify rank <= 30")


# E28, E29, E31, E33
def _patches(s: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return fx.table(s, d, "events").select((F.col("user_id") % 50).alias("claim"), e.alias("seq"), F.when(e % 17 == 0, "remove").otherwise("set").alias("op"), F.when(e % 3 == 0, F.col("event_type")).alias("kind"), F.when(e % 5 == 0, F.round(F.col("value") / 50, 4)).alias("truth"))


_FOLD = "lo as (select user_id % 50 claim, event_id seq, event_id % 17 = 0 rm, case when event_id % 3 = 0 then event_type end kind, case when event_id % 5 = 0 then round(value / 50, 4) end truth from events), lv as (select lo.* from lo left join (select claim c, max(seq) m from lo where rm group by 1) on c = claim where not rm and seq > coalesce(m, -1)), fo as (select claim, arg_max(kind, seq) filter (kind is not null) kind, arg_max(truth, seq) filter (truth is not null) truth from lv group by 1 having count(kind) + count(truth) > 0)"
_add("e28_folded_patches", lambda s, d: cu.folded_patches(_patches(s, d), ["claim"], ["kind", "truth"]), f"with {_FOLD} select * from fo")
_add("e28_range_check", lambda s, d: cu.in_range(cu.folded_patches(_patches(s, d), ["claim"], ["kind", "truth"]), "truth")[0].select("claim", "truth"), f"with {_FOLD} select claim, truth from fo where truth between 0 and 1")
_add("e29_ordered_section", lambda s, d: cu.ordered_section(not_same(s, d), ["a", "b"]), f"with {_FIX} select a, b from ns order by a, b")
_add("e31_alias_autocomplete", lambda s, d: cu.autocomplete(cu.corpus(named(s, d)), handled(s, d), "Ing", "person").select("entity_id", "total", "documents"), f"with {_FIX} select entity_id, total, documents from co where label = 'person' and contains(lower(canonical), 'ing') and entity_id not in (from hd) order by total desc, entity_id limit 20")


def _e33(s: SparkSession, d: str) -> DataFrame:
    verdicts = fx.dependencies(s, d).where("kind = 'supports'").select(F.col("source").alias("left"), F.col("target").alias("right"), F.when(F.col("source").like("%5"), "operator").otherwise("ai").alias("by"))
    return cu.calibration_bundle({"merges": merges(s, d), "notSame": not_same(s, d)}, verdicts, 10)


_add("e33_calibration_bundle", _e33, f"""with {_FIX}, {fx.DEPS} select 'verdicts' section, '{{"left":"' || source || '","right":"' || target || '","by":"operator"}}' as row from deps where kind = 'supports' and source like '%5' union all select 'merges', '{{"source":"' || source || '","target":"' || target || '"}}' from (from mg order by source, target limit 10) union all select 'notSame', '{{"a":"' || a || '","b":"' || b || '"}}' from (from ns order by a, b limit 10)""")
