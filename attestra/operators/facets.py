"""Faceted queries over claims, pairs and documents (J), and over claim graphs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truth_of(derived: Column, direct: Column) -> Column:
    return F.coalesce(derived, direct)


def matches_topic(q: str) -> Column:
    """A claim (entities, kind) of which an entity's key or the kind holds q."""
    q = q.strip().lower()
    return F.exists("entities", lambda e: F.contains(F.lower(e), F.lit(q))) | F.contains(F.lower("kind"), F.lit(q))


def overlaps_by_type(have: Column, wanted: list[str]) -> Column:
    """Entities wanted: any of those of one type, and so for every type."""
    groups: dict[str, list[str]] = {}
    for e in wanted:
        groups.setdefault(e.split(":", 1)[0], []).append(e)
    ok: Column = F.lit(True)
    for values in groups.values():
        ok = ok & F.arrays_overlap(have, F.array(*[F.lit(v) for v in values]))
    return ok


def within(value: Column, bounds: tuple | None) -> Column:
    """Within bounds that are set; a missing value is not."""
    return F.lit(True) if bounds is None else F.coalesce(value.between(*[F.lit(b) for b in bounds]), F.lit(False))


def among(value: Column, chosen: list, none: str = "__none__") -> Column:
    return F.coalesce(value, F.lit(none)).isin(chosen) if chosen else F.lit(True)


def yes_no(flag: Column, chosen: list) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "yes").otherwise("no").isin(chosen) if chosen else F.lit(True)


@dataclass(frozen=True)
class ClaimFilter:
    """What a claim must meet; nothing chosen lets all pass."""

    q: str = ""
    kinds: list = field(default_factory=list)
    stances: list = field(default_factory=list)
    sources: list = field(default_factory=list)
    truth: tuple | None = None
    confidence: tuple | None = None
    date: tuple | None = None
    verdict: list = field(default_factory=list)
    contradicted: list = field(default_factory=list)
    has_in: list = field(default_factory=list)
    has_out: list = field(default_factory=list)
    documents: list = field(default_factory=list)
    entities: list = field(default_factory=list)

    def parts(self) -> dict[str, Column]:
        """A condition per facet over (text, entities, kind, stance, truth_source, truth, confidence, published, in_verdict, contradictions, in_degree, out_degree, video_id)."""
        q = self.q.strip().lower()
        return {
            "q": F.contains(F.lower("text"), F.lit(q)) | matches_topic(q) if q else F.lit(True),
            "kind": among(F.col("kind"), self.kinds), "stance": among(F.col("stance"), self.stances), "source": among(F.col("truth_source"), self.sources),
            "truth": within(F.col("truth"), self.truth), "confidence": within(F.col("confidence"), self.confidence), "date": within(F.col("published"), self.date),
            "verdict": yes_no(F.col("in_verdict"), self.verdict), "contradicted": yes_no(F.col("contradictions") > 0, self.contradicted),
            "has_in": yes_no(F.col("in_degree") > 0, self.has_in), "has_out": yes_no(F.col("out_degree") > 0, self.has_out),
            "documents": among(F.col("video_id"), self.documents), "entities": overlaps_by_type(F.col("entities"), self.entities),
        }


@dataclass(frozen=True)
class PairFilter:
    """What a pair of claims must meet, on its own or on either side."""

    q: str = ""
    kinds: list = field(default_factory=list)
    reasons: list = field(default_factory=list)
    shared: tuple | None = None
    similarity: tuple | None = None
    date: tuple | None = None
    documents: list = field(default_factory=list)
    entities: list = field(default_factory=list)

    def parts(self) -> dict[str, Column]:
        """A condition per facet over (kind, reason, shared, shared_entities, similarity, summary, and text, published, video_id, entities, kind of left_ and right_)."""
        q = self.q.strip().lower()
        said = F.concat_ws("\n", "summary", "left_text", "right_text", F.array_join("shared_entities", "\n"), F.array_join("left_entities", "\n"), F.array_join("right_entities", "\n"), "left_kind", "right_kind")
        either = lambda ok: ok("left_") | ok("right_")
        return {
            "q": F.contains(F.lower(said), F.lit(q)) if q else F.lit(True),
            "kind": among(F.col("kind"), self.kinds), "reason": among(F.col("reason"), self.reasons),
            "shared": within(F.col("shared"), self.shared), "similarity": within(F.col("similarity"), self.similarity),
            "date": either(lambda s: within(F.col(f"{s}published"), self.date)), "documents": either(lambda s: F.coalesce(F.col(f"{s}video_id").isin(self.documents), F.lit(False))) if self.documents else F.lit(True),
            "entities": overlaps_by_type(F.col("shared_entities"), self.entities),
        }


def passing(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Rows that meet all facets."""
    ok: Column = F.lit(True)
    for p in parts.values():
        ok = ok & p
    return rows.where(ok)


def _cell(facet: str):
    return lambda b: F.struct(F.lit(facet).alias("facet"), b.cast("string").alias("bucket"))


def counts_but_own(rows: DataFrame, parts: dict[str, Column], buckets: dict[str, Column], selected: dict[str, list] | None = None) -> DataFrame:
    """(facet, bucket, n): each facet's buckets count the rows that all other facets let pass, in one pass.

    A bucket column may be an array: a row counts once in each of its values. Selected buckets
    without rows are kept with 0.
    """
    cells = []
    for name, bucket in buckets.items():
        others: Column = F.lit(True)
        for other, ok in parts.items():
            others = others & ok if other != name else others
        cells.append(F.when(others, F.transform(bucket, _cell(name))))
    n = rows.select(F.explode(F.flatten(F.array_compact(F.array(*cells)))).alias("x")).groupBy("x.facet", "x.bucket").agg(F.count(F.lit(1)).alias("n"))
    want = [(f, str(v)) for f, vs in (selected or {}).items() for v in vs]
    if not want:
        return n
    zero = rows.sparkSession.createDataFrame(want, "facet string, bucket string")
    return n.join(zero, ["facet", "bucket"], "full").select("facet", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def single(c: Column) -> Column:
    return F.array(c)


#: Orders of claims and of pairs by name; ties by id.
CLAIM_SORTS = {"certain": ("abs(round(coalesce(truth, 0.5) - 0.5, 6))", False), "uncertain": ("abs(round(coalesce(truth, 0.5) - 0.5, 6))", True), "contradicted": ("contradictions", False), "cited": ("in_degree", False), "conf-high": ("coalesce(confidence, 0)", False), "conf-low": ("coalesce(confidence, 0)", True)}
PAIR_SORTS = {"shared-desc": ("shared", False), "similarity-desc": ("coalesce(similarity, -1)", False), "kind": ("kind", True)}


def sorted_rows(rows: DataFrame, sort: str, sorts: dict, ids: list[str], limit: int) -> DataFrame:
    """The first rows in one of the orders, with their rank."""
    expr, up = sorts[sort]
    order = [F.expr(expr).asc() if up else F.expr(expr).desc(), *ids]
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of at most limit rows


def claim_bundle(claims: DataFrame, deps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Claims with in_degree, out_degree and contradictions; pairs (left, right, route) that are pending are hidden."""
    ends = deps.select(F.col("source").alias("claim_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("c")).union(deps.select("target", F.lit(0), F.lit(1), F.lit(0)))
    shown = pairs.where("route <> 'pending'")
    ends = ends.union(shown.select("left", F.lit(0), F.lit(0), F.lit(1))).union(shown.select("right", F.lit(0), F.lit(0), F.lit(1)))
    per = ends.groupBy("claim_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("c").alias("contradictions"))
    return claims.join(per, "claim_id", "left").fillna(0, ["out_degree", "in_degree", "contradictions"])


def integer_histogram(df: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    """Counts of integers from lo to hi, values beyond counted at the ends, empty bins 0."""
    at = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(column))).cast("int")
    found = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def pair_bundle(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs with text, published, video_id, entities and kind of both sides, for J10; a missing side stays null."""
    side = lambda s: claims.select(F.col("claim_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("text", "published", "video_id", "entities", "kind")])
    j = pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")
    return j.withColumn("shared_entities", F.coalesce(F.array_intersect("left_entities", "right_entities"), F.array().cast("array<string>")))


# documents
def document_facts(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts (entity_id, video_id, n), types by total mentions)."""
    facts = mentions.groupBy("entity_id", "video_id").agg(F.count(F.lit(1)).alias("n"))
    types = facts.groupBy(F.substring_index("entity_id", ":", 1).alias("type")).agg(F.sum("n").alias("total"))
    return facts, types.orderBy(F.desc("total"), "type")


def active_documents(facts: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Documents that have an entity of every group."""
    hits = [F.when(F.col("entity_id").isin(g), F.lit(i)) for i, g in enumerate(groups)]
    e = facts.select("video_id", F.explode(F.array_compact(F.array(*hits))).alias("g"))
    return e.groupBy("video_id").agg(F.count_distinct("g").alias("met")).where(F.col("met") == len(groups)).select("video_id")


def top_in_scope(facts: DataFrame, scope: DataFrame, type_: str, limit: int = 10, pinned: list[str] | None = None) -> DataFrame:
    """(entity_id, n, total): a type's most mentioned entities within documents, pinned ones too, and the type's total there."""
    f = facts.where(F.substring_index("entity_id", ":", 1) == type_).join(scope.select("video_id"), "video_id", "left_semi")
    n = f.groupBy("entity_id").agg(F.sum("n").alias("n"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    top = n.orderBy(F.desc("n"), "entity_id").limit(limit)
    return top.union(n.where(F.col("entity_id").isin(pinned or []))).distinct().crossJoin(F.broadcast(total))  # one row


def time_facet(scoped: DataFrame, times: DataFrame) -> DataFrame:
    """(entity_id, n, sort_value) in the order of time; entities that are no time are left out."""
    return scoped.join(times.select("entity_id", "sort_value"), "entity_id").where("sort_value is not null").orderBy("sort_value", "entity_id")


def fixed_order(counts: DataFrame, order: list[str], column: str = "bucket") -> DataFrame:
    """Counts of a small facet in a fixed order, missing ones 0."""
    grid = counts.sparkSession.createDataFrame(list(enumerate(order)), f"place int, {column} string")
    return grid.join(counts, column, "left").select("place", column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def entity_options(facts: DataFrame, limit: int = 50) -> DataFrame:
    """Entities of all types by mentions."""
    return facts.groupBy("entity_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity_id").limit(limit)


# claim graphs
def seeds_of(claims: DataFrame, kind: str, key: str) -> DataFrame:
    """The claims that a document, an entity or a claim stands for."""
    hit = {"document": F.col("video_id") == key, "entity": F.array_contains("entities", key), "claim": F.col("claim_id") == key}[kind]
    return claims.where(hit).select("claim_id")


def claim_links(claims: DataFrame, deps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(from, to, kind, undirected): dependencies, contradictions (left, right) and shared evidence, by relations that two claims cite."""
    cited = claims.select("claim_id", F.explode(F.array_distinct("relationships")).alias("r"))
    shared = cited.withColumnRenamed("claim_id", "from").join(cited.withColumnRenamed("claim_id", "to"), "r").where("`from` <> `to`").select("from", "to", F.lit("shared-evidence").alias("kind")).distinct()
    return deps.select(F.col("source").alias("from"), F.col("target").alias("to"), "kind").union(pairs.select("left", "right", F.lit("contradiction"))).union(shared).distinct()


def neighbourhood(claims: DataFrame, links: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (claim_id, distance), edges (from, to, kind)) one hop around the seeds; ends that are no claims are dropped."""
    s = seeds.select("claim_id").distinct()
    out = links.join(s.withColumnRenamed("claim_id", "from"), "from", "left_semi")
    into = links.where("kind <> 'shared-evidence'").join(s.withColumnRenamed("claim_id", "to"), "to", "left_semi").select("from", "to", "kind")
    edges = out.select("from", "to", "kind").union(into).distinct()
    known = claims.select("claim_id").distinct()
    edges = edges.join(known.withColumnRenamed("claim_id", "from"), "from", "left_semi").join(known.withColumnRenamed("claim_id", "to"), "to", "left_semi").select("from", "to", "kind")
    near = edges.select(F.explode(F.array("from", "to")).alias("claim_id"), F.lit(1).alias("distance"))
    nodes = s.join(known, "claim_id", "left_semi").select("claim_id", F.lit(0).alias("distance")).union(near)
    return nodes.groupBy("claim_id").agg(F.min("distance").alias("distance")), edges


def claim_neighbourhood(claims: DataFrame, deps: DataFrame, pairs: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """neighbourhood over claim_links, of which only those of the seeds (claim_id) are made.

    Claims have one row for each claim_id, and are read for that and relationships. Shared evidence is followed from the seeds' relations; the nodes need
    no pair of claims, only the claims that cite such a relation. Seeds of several kinds may come together, as J22 merges them.
    """
    s = seeds.select("claim_id").distinct()
    known = claims.select("claim_id").distinct()
    cited = claims.select("claim_id", F.array_distinct("relationships").alias("all")).select("claim_id", "all", F.explode("all").alias("r"))
    links = deps.select(F.col("source").alias("from"), F.col("target").alias("to"), "kind").union(pairs.select("left", "right", F.lit("contradiction")))
    near = [links.join(s.withColumnRenamed("claim_id", end), end, "left_semi").select("from", "to", "kind") for end in ("from", "to")]
    near = near[0].union(near[1]).distinct()
    for end in ("from", "to"):
        near = near.join(known.withColumnRenamed("claim_id", end), end, "left_semi").select("from", "to", "kind")
    of = cited.join(s, "claim_id", "left_semi")
    # two claims that share several relations are linked once: in the least of them
    one = F.array_min(F.array_intersect("_of", "_all")) == F.col("r")
    shared = of.select(F.col("claim_id").alias("from"), "r", F.col("all").alias("_of")).join(cited.select(F.col("claim_id").alias("to"), "r", F.col("all").alias("_all")), "r").where("`from` <> `to`").where(one)
    edges = near.union(shared.select("from", "to", F.lit("shared-evidence")))
    # whoever cites a seed's relation is one step away, or a seed itself
    ends = near.select(F.explode(F.array("from", "to")).alias("claim_id")).union(cited.join(of.select("r").distinct(), "r", "left_semi").select("claim_id"))
    nodes = s.join(known, "claim_id", "left_semi").select("claim_id", F.lit(0).alias("distance")).union(ends.select("claim_id", F.lit(1).alias("distance")))
    return nodes.groupBy("claim_id").agg(F.min("distance").alias("distance")), edges


def merged_neighbourhoods(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several neighbourhoods as one: the smaller distance wins, an edge counts once."""
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.union(n), edges.union(e)
    return nodes.groupBy("claim_id").agg(F.min("distance").alias("distance")), edges.distinct()


def document_totals(bundle: DataFrame) -> DataFrame:
    """(video_id, claims, derived, contradiction_links, inbound) of claims with derived truth and degrees."""
    return bundle.groupBy("video_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("derived").isNotNull()).alias("derived"), F.sum("contradictions").alias("contradiction_links"), F.sum("in_degree").alias("inbound"))


def claim_detail(deps: DataFrame, pairs: DataFrame, claim: str) -> DataFrame:
    """(section, other, kind) of one claim: its contradictions, agreements and dependencies both ways."""
    other = F.when(F.col("left") == claim, F.col("right")).otherwise(F.col("left"))
    mine = pairs.where((F.col("left") == claim) | (F.col("right") == claim))
    out = mine.where("route in ('contradiction', 'agreement')").select(F.col("route").alias("section"), other.alias("other"), F.col("reason").alias("kind"))
    return out.union(deps.where(F.col("source") == claim).select(F.lit("out"), "target", "kind")).union(deps.where(F.col("target") == claim).select(F.lit("in"), "source", "kind"))


def seed_options(entities: DataFrame, documents: DataFrame, claims: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """(section, id, label) of what may seed a graph: entities by mentions, documents by date, claims; q within label, id or subtitle."""
    q = q.strip().lower()
    a = entities.select(F.lit(0).alias("s"), F.lit("entity").alias("section"), F.col("entity_id").alias("id"), F.col("canonical").alias("label"), F.substring_index("entity_id", ":", 1).alias("sub"), (-F.col("n")).cast("double").alias("o"))
    b = documents.select(F.lit(1), F.lit("document"), "video_id", F.coalesce("title", "video_id"), F.coalesce(F.col("published").cast("string"), F.lit("")), F.coalesce(-F.unix_date("published"), F.lit(10**9)).cast("double"))
    c = claims.select(F.lit(2), F.lit("claim"), "claim_id", "text", "video_id", F.lit(0.0))
    rows = a.union(b).union(c).where(F.contains(F.lower(F.concat_ws("\n", "label", "id", "sub")), F.lit(q)))
    return rows.orderBy("s", "o", "id").limit(limit).select("section", "id", "label")


def documents_in_scope(rows: DataFrame, titles: DataFrame, q: str = "") -> DataFrame:
    """(video_id, label, n) of the documents of rows whose title or id holds q, by count."""
    n = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    j = short_labels(n, titles)
    return j.where(F.contains(F.lower(F.concat_ws("\n", "title", "video_id")), F.lit(q.strip().lower()))).orderBy(F.desc("n"), "video_id").select("video_id", "label", "n")


def short_labels(rows: DataFrame, titles: DataFrame, cut: int = 34) -> DataFrame:
    """Rows with title and label: the title trimmed and cut, or the id; documents without a title row get the id."""
    j = rows.join(titles.select("video_id", "title"), "video_id", "left")
    t = F.trim(F.coalesce("title", F.lit("")))
    return j.withColumn("label", F.when(t == "", F.col("video_id")).when(F.length(t) > cut, F.concat(F.substring(t, 1, cut - 1), F.lit("…"))).otherwise(t))


def graph_seeds(results: DataFrame, cap: int = 60) -> DataFrame:
    """(claim_id, place, truncated): distinct claims in the order of results (claim_id, rank), at most cap, and whether more were there."""
    first = results.groupBy("claim_id").agg(F.min("rank").alias("rank"))
    top = first.orderBy("rank", "claim_id").limit(cap + 1).withColumn("place", F.row_number().over(Window.orderBy("rank", "claim_id")))  # of at most cap + 1 rows
    more = top.agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return top.where(F.col("place") <= cap).crossJoin(F.broadcast(more)).select("claim_id", "place", "truncated")  # one row


def truth_timeline(claims: DataFrame) -> DataFrame:
    """Claims with a truth with mid, 2 truth - 1, and lo, hi, a band of the root of 1 - confidence around it, within -1 and 1."""
    mid, wide = 2 * F.col("truth") - 1, F.sqrt(1 - F.col("confidence"))
    one = lambda c: F.round(c, 6) + 0.0
    return claims.where("truth is not null").withColumns({"mid": one(mid), "lo": one(F.greatest(F.lit(-1.0), mid - wide)), "hi": one(F.least(F.lit(1.0), mid + wide))})


def weighted_terms(mentions: DataFrame, top: int = 80, cut: int = 32) -> DataFrame:
    """(video_id, term, n, rank): each document's most mentioned surfaces, cut to a length; ties by the term."""
    n = mentions.groupBy("video_id", F.substring("surface", 1, cut).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("n"), "term"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)
