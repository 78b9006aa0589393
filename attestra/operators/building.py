"""Building the graph from documents (F), asking it (G), and truth from verdicts (H)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import curation as cu
from attestra.operators import graph as gr
from attestra.operators import loops as lo
from attestra.operators.components import ensure_checkpoints, stored, weak
from attestra.operators.links import PAIRS, best_pairs

# Words that begin the verdict part, and the verdicts in the order that they are tried.
MARKERS = r"(?i)\b(verdict|summary|fact[- ]check|in conclusion|to sum up|final|recap)\b"
VERDICTS = [("true", 1.0, r"(?i)\b(?:true|confirmed|verified|accurate|correct)\b"), ("false", 0.0, r"(?i)\b(?:false|debunked|wrong|incorrect|misleading|inaccurate)\b"), ("uncertain", 0.5, r"(?i)\b(?:unclear|unverified|inconclusive|uncertain|disputed)\b")]
#: Heaviest entities whose pairs give novel links their first bound.
PROBED = 200
#: Relations' ends that a task may hold where novel links are looked for.
LINK_ROWS = 1_000_000
#: Entities up to which their pages' relations are picked in place; for more, relations are shuffled.
PAGE_ENTITIES = 10_000


# F: documents to graph
def mention_entities(mentions: DataFrame, document_merges: DataFrame, closed: DataFrame, deleted: DataFrame) -> DataFrame:
    """mentions with entity_id, resolved by document and corpus; those of deleted entities go."""
    keyed = mentions.withColumn("entity_id", tx.entity_key(F.col("label"), F.coalesce("canonical", "surface")))
    return cu.resolve_in_documents(keyed, document_merges, closed, deleted)


def document_entities(resolved: DataFrame, display: DataFrame) -> DataFrame:
    """(video_id, entity_id, type, canonical, aliases, spans) of resolved mentions; the first mention names the entity unless an operator did."""
    order = F.struct("start", "mention_id")
    per = resolved.groupBy("video_id", "entity_id").agg(F.min_by("label", order).alias("type"), F.min_by(F.coalesce("canonical", "surface"), order).alias("canonical"), F.array_sort(F.collect_set(F.when(F.col("surface") != F.coalesce("canonical", "surface"), F.col("surface")))).alias("aliases"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return cu.displayed(per, display)


def document_relations(edges: DataFrame, resolved: DataFrame, deleted: DataFrame | None = None, check: bool = True) -> DataFrame:
    """F2: edges (video_id, edge_id, predicate, subject_mention_id, object_mention_id, score, char_start, char_end, time_start) between resolved mentions as relations.

    Both ends must resolve, to different entities, of labels that the predicate takes; deleted
    relations go. Without check and deletions it is F13, edge ids to graph edges.
    """
    ensure_checkpoints(resolved.sparkSession)
    ids = resolved.select("video_id", "mention_id", "entity_id").checkpoint()  # both ends meet it
    j = edges.join(ids.withColumnsRenamed({"mention_id": "subject_mention_id", "entity_id": "subject_id"}), ["video_id", "subject_mention_id"]).join(ids.withColumnsRenamed({"mention_id": "object_mention_id", "entity_id": "object_id"}), ["video_id", "object_mention_id"])
    j = j.where("subject_id <> object_id").withColumn("transcript_id", F.col("video_id"))
    j = gr.type_checked(j) if check else j
    return j if deleted is None else cu.without_deleted_relations(j, deleted)


def relation_id(rel: DataFrame) -> DataFrame:
    """relations with rel_id, subject|predicate|object|transcript:start-end."""
    return rel.withColumn("rel_id", F.concat_ws("|", "subject_id", "predicate", "object_id", F.concat(F.col("transcript_id"), F.lit(":"), "char_start", F.lit("-"), "char_end")))


def well_formed(rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, rejects): the id is that of the fields, ends exist, the span has a length, times and confidence are in order."""
    own = F.concat_ws("|", "subject_id", "predicate", "object_id", F.concat(F.col("transcript_id"), F.lit(":"), "char_start", F.lit("-"), "char_end"))
    ok = F.coalesce((F.col("rel_id") == own) & (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")) & F.col("confidence").between(0, 1), F.lit(False))
    return rel.where(ok), rel.where(~ok)


def upserted_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """entities of both (entity_id, canonical, aliases, spans): the old name, all aliases once, all spans."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    per = both.groupBy("entity_id").agg(F.min_by("canonical", F.struct("_o", "canonical")).alias("canonical"), F.flatten(F.collect_list("aliases")).alias("a"), F.flatten(F.collect_list("spans")).alias("s"))
    return per.select("entity_id", "canonical", F.array_sort(F.array_distinct("a")).alias("aliases"), F.array_sort("s").alias("spans"))


def known_evidence(rel: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, rejects) by whether their transcript is known."""
    ids = transcripts.select(F.col("video_id").alias("transcript_id")).distinct()
    return rel.join(ids, "transcript_id", "left_semi"), rel.join(ids, "transcript_id", "left_anti")


def select_relations(rel: DataFrame, entity: str | None = None, predicate: str | None = None, transcript: str | None = None) -> DataFrame:
    """F8: relations of an entity (at either end), a predicate, a transcript."""
    out = rel if entity is None else gr.by_role(rel, entity)
    out = out if predicate is None else out.where(F.col("predicate") == predicate)
    return out if transcript is None else out.where(F.col("transcript_id") == transcript)


def entity_spans(rel: DataFrame) -> DataFrame:
    """a row (entity_id, transcript_id, char_start) for each end of each relation."""
    return rel.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"), "transcript_id", "char_start")


def entity_index(rel: DataFrame) -> DataFrame:
    """(entity_id, documents, mentions) over both ends."""
    return entity_spans(rel).groupBy("entity_id").agg(F.count_distinct("transcript_id").alias("documents"), F.count(F.lit(1)).alias("mentions"))


def entity_documents(rel: DataFrame) -> DataFrame:
    """(entity_id, transcript_id, spans) over both ends, spans the distinct starts in order."""
    return entity_spans(rel).groupBy("entity_id", "transcript_id").agg(F.array_sort(F.collect_set("char_start")).alias("spans"))


def answered_edges(answers: DataFrame, predicates: list[str]) -> DataFrame:
    """(video_id, subject_id, predicate, object_id, cue_idx, confidence, fault) of each element of answers (video_id, json).

    fault says what is wrong with an element, null if nothing: ids and predicate must be JSON strings, cue and
    confidence JSON numbers. Answers that are no JSON array have no elements.
    """
    e = answers.select("video_id", F.explode(F.expr("try_variant_get(try_parse_json(json), '$', 'array<variant>')")).alias("e"))
    kind = {c: F.expr(f"schema_of_variant(variant_get(e, '$.{c}', 'variant'))") for c in ("subjectId", "objectId", "predicate", "cueIndex", "confidence")}
    text = lambda c: F.coalesce(kind[c] == "STRING", F.lit(False))
    number = lambda c: F.coalesce(kind[c].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    got = lambda c, t: F.expr(f"try_variant_get(e, '$.{c}', '{t}')")
    fault = F.when(~(text("subjectId") & text("objectId")), "ids are no text").when(~text("predicate") | ~F.coalesce(got("predicate", "string").isin(predicates), F.lit(False)), "unknown predicate")
    fault = fault.when(~number("cueIndex"), "cue is no number").when(~number("confidence"), "confidence is no number")
    return e.select("video_id", got("subjectId", "string").alias("subject_id"), got("predicate", "string").alias("predicate"), got("objectId", "string").alias("object_id"), got("cueIndex", "double").alias("cue_idx"), got("confidence", "double").alias("confidence"), fault.alias("fault"))


def external_edges(answers: DataFrame, cues: DataFrame, predicates: list[str]) -> DataFrame:
    """relations of answers (video_id, json) that name a cue: known predicates, typed fields, confidence within 0 and 1, provenance ai.

    cues: (video_id, cue_idx, start, duration, text). Answers that are no JSON array give none; answered_edges says what others lack.
    """
    e = answered_edges(answers, predicates).where("fault is null and cue_idx = floor(cue_idx)").withColumn("cue_idx", F.col("cue_idx").cast("int"))
    before = Window.partitionBy("video_id").orderBy("cue_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = cues.select("video_id", "cue_idx", F.col("start").alias("time_start"), (F.col("start") + F.col("duration")).alias("time_end"), F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int").alias("char_start"), F.length("text").alias("n"))
    j = e.join(at, ["video_id", "cue_idx"])
    out = j.select("subject_id", "predicate", "object_id", F.col("video_id").alias("transcript_id"), "char_start", (F.col("char_start") + F.col("n")).alias("char_end"), "time_start", "time_end", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), F.lit("ai").alias("provenance"))
    return relation_id(out)


def enrichment_input(entities: DataFrame, cues: DataFrame) -> DataFrame:
    """(video_id, entities, cues): what an external annotator is given of each document."""
    e = entities.groupBy("video_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    c = cues.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("cue_idx", "start", "text"))).alias("cues"))
    return c.join(e, "video_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


# G: questions
def search_entities(entities: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """G1: (entity_id, canonical, score, matched_on): the name itself 3, within it 2, within an alias 1; ties by name."""
    q = q.strip().lower()
    name = F.lower("canonical")
    alias = F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q)))
    score = F.when(name == q, 3).when(F.contains(name, F.lit(q)), 2).when(alias, 1)
    hits = entities.where(F.lit(bool(q))).withColumn("score", score).where("score is not null")
    return hits.withColumn("matched_on", F.when(F.col("score") >= 2, "canonical").otherwise("alias")).orderBy(F.desc("score"), "canonical", "entity_id").limit(limit)


def search_index(index: DataFrame, q: str = "", type_: str | None = None, hidden: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """Visible entities of a type whose name holds q: by place of q, mentions, name; limit between 1 and 200."""
    q = q.strip().lower()
    e = index.where(~F.col("type").isin(list(hidden)))
    e = e.where(F.col("type") == type_) if type_ else e
    at = F.instr(F.lower("canonical"), q) if q else F.lit(0)
    e = e.withColumn("position", at).where("position > 0") if q else e.withColumn("position", at)
    return e.orderBy("position", F.desc("mentions"), "canonical", "entity_id").limit(min(200, max(1, limit)))


def entity_page(rel: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, predicate, rel_id, counterpart, link): the relations of entities (entity_id) with the other end and where it is said.

    Up to PAGE_ENTITIES, which are counted, entities are broadcast; more are joined by a shuffle.
    """
    link = tx.deep_link(F.col("transcript_id"), F.col("time_start"))
    ends = F.array_distinct(F.array(F.struct(F.col("subject_id").alias("me"), F.col("object_id").alias("other")), F.struct(F.col("object_id").alias("me"), F.col("subject_id").alias("other"))))
    rows = rel.select("rel_id", "predicate", link.alias("link"), F.explode(ends).alias("x")).select(F.col("x.me").alias("entity_id"), "predicate", "rel_id", F.col("x.other").alias("counterpart"), "link")
    wanted = entities.select("entity_id").distinct()
    few = wanted.limit(PAGE_ENTITIES + 1).count() <= PAGE_ENTITIES
    return rows.join(F.broadcast(wanted) if few else wanted, "entity_id", "left_semi")


def lookup(entities: DataFrame, rel: DataFrame, q: str, hits: int = 5) -> DataFrame:
    """The first hits of a search with all their relations; a hit without any has one row."""
    found = search_entities(entities, q, hits).select("entity_id", "score")
    return found.join(entity_page(rel, found), "entity_id", "left")


def neighbour_edges(edges_: DataFrame, per: int = 20, offset: int = 0) -> DataFrame:
    """Of every entity its edges (entity_id, other, predicate, n, rank) by count; neighbours repeat."""
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "other", "predicate"))
    return gr.neighbours(edges_).withColumn("rank", rank).where(F.col("rank").between(offset + 1, offset + per))


def view_slice(nodes: DataFrame, edges_: DataFrame, types: list[str], predicates: list[str] | None = None, min_truth: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the types, predicates and truth wanted; an edge needs both ends, a node an edge. Edges have truth where it is known."""
    n = nodes.where(F.substring_index("entity_id", ":", 1).isin(types))
    e = edges_ if predicates is None else edges_.where(F.col("predicate").isin(predicates))
    e = e if min_truth is None else e.where(F.coalesce("truth", F.lit(0.0)) >= min_truth)
    e = gr.within(e, n)
    used = e.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
    return n.join(used, "entity_id", "left_semi"), e


def one_hop(edges_: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges that touch a seed (entity_id)."""
    s = seeds.select("entity_id").distinct()
    ends = edges_.select("*", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"))
    return ends.join(s, "entity_id", "left_semi").drop("entity_id").distinct()


def truth_overlay(edges_: DataFrame, truth: DataFrame) -> DataFrame:
    """Undirected edges (lo, predicate, hi, n) with truth: the mean of both directions, or the one that is known."""
    u = gr.undirected(edges_)
    t = truth.select(F.least("subject_id", "object_id").alias("lo"), "predicate", F.greatest("subject_id", "object_id").alias("hi"), "truth").groupBy("lo", "predicate", "hi").agg(F.avg("truth").alias("truth"))
    return u.join(t, ["lo", "predicate", "hi"], "left")


def entity_detail(rel: DataFrame, catalog: DataFrame, entity: str) -> DataFrame:
    """(video_id, published, mentions) of an entity's documents, the newest first, undated last."""
    spans = entity_spans(rel).where(F.col("entity_id") == entity).groupBy(F.col("transcript_id").alias("video_id")).agg(F.count(F.lit(1)).alias("mentions"))
    return spans.join(catalog.select("video_id", "published"), "video_id", "left").orderBy(F.desc_nulls_last("published"), "video_id")


def expanded(edges_: DataFrame, nodes: DataFrame, seeds: DataFrame, per: int = 20) -> DataFrame:
    """All edges among the seeds (entity_id) and the heaviest neighbours of each: nodes without an edge there are gone."""
    s = seeds.select("entity_id").distinct()
    near = gr.neighbours(edges_).select("entity_id", "other").distinct().join(s, "entity_id", "left_semi").join(nodes.select(F.col("entity_id").alias("other"), "weight"), "other")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("weight"), "other"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= per).select(F.col("other").alias("entity_id"))
    return gr.within(edges_, s.union(near).distinct())


def document_panel(rel: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Of every document (types with mention totals, relations by confidence, at most top)."""
    types = entity_spans(rel).groupBy("transcript_id", F.substring_index("entity_id", ":", 1).alias("type")).agg(F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("mentions"))
    rank = F.row_number().over(Window.partitionBy("transcript_id").orderBy(F.desc("confidence"), "rel_id"))
    return types, rel.withColumn("rank", rank).where(F.col("rank") <= top)


# H: truth from verdicts
def verdict_cues(cues: DataFrame, tail: float = 0.85) -> DataFrame:
    """H1, H2: (video_id, cue_idx, verdict, score, text) of the cues with a verdict, from the first marker on, or from tail of the cues."""
    w = Window.partitionBy("video_id")
    first = F.min(F.when(F.col("text").rlike(MARKERS), F.col("cue_idx"))).over(w)
    begin = F.coalesce(first, F.floor(F.count(F.lit(1)).over(w) * tail))
    verdict, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, value, pattern in reversed(VERDICTS):
        verdict, score = F.when(F.col("text").rlike(pattern), name).otherwise(verdict), F.when(F.col("text").rlike(pattern), value).otherwise(score)
    rows = cues.select("video_id", "cue_idx", "text", begin.alias("_b"), verdict.alias("verdict"), score.alias("score"))
    return rows.where("cue_idx >= _b and verdict is not null").drop("_b")


def verdict_truth(rel: DataFrame, verdicts: DataFrame, cues: DataFrame, floor: float = 0.15) -> DataFrame:
    """H3: (rel_id, truth): the last verdict of the document whose words are like those of the relation's cue.

    rel has rel_id, video_id, cue_idx. Cues meet through their shared words, so unlike ones never do.
    """
    words = lambda df, key: df.select(key, "video_id", tx.token_set(F.col("text")).alias("w")).select(key, "video_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    v = words(verdicts.withColumn("v_idx", F.col("cue_idx")), "v_idx").withColumnRenamed("n", "vn")
    c = words(cues.withColumn("c_idx", F.col("cue_idx")), "c_idx")
    shared = v.join(c, ["video_id", "t"]).groupBy("video_id", "v_idx", "c_idx", "vn", "n").agg(F.count(F.lit(1)).alias("both"))
    near = shared.where(F.col("both") / (F.col("vn") + F.col("n") - F.col("both")) >= floor)
    said = near.join(verdicts.select("video_id", F.col("cue_idx").alias("v_idx"), "score"), ["video_id", "v_idx"])
    last = said.groupBy("video_id", F.col("c_idx").alias("cue_idx")).agg(F.max_by("score", "v_idx").alias("truth"))
    return rel.join(last, ["video_id", "cue_idx"]).select("rel_id", "truth")


def conflict_report(rel: DataFrame, floor: float = 0.5) -> DataFrame:
    """H9: (kind, a, b) of truth conflicts, excluding predicates and loops of any length together; loops by derived truth where there is one."""
    one = gr.conflicts(rel).select(F.lit("truth").alias("kind"), F.col("true_rel").alias("a"), F.col("false_rel").alias("b"))
    two = gr.exclusive(rel, floor).select(F.lit("exclusive"), "left_rel", "right_rel")
    return one.union(two).union(lo.true_loops(rel, floor)[0].select(F.lit("loop"), "loop", "edges"))


def novel_links(rel: DataFrame, least: int = 2, limit: int = 50) -> DataFrame:
    """(a, b, shared_nodes, shared_transcripts, support, score, line): unlinked pairs two hops apart.

    score is 2 for each shared neighbour, 1 for each shared transcript, and a tenth of the
    confidence of the relations that support the pair. The pairs among the PROBED heaviest entities give a first bound; entities
    whose relations cannot reach it are in no pair. The others come with their relations to tasks, which count what their pairs
    share and give their first limit pairs: no pair is shuffled. Relations of the same rel_id and confidence support a pair
    once; 64 bits of rel_id tell them apart within an entity.
    """
    hashed = F.xxhash64("rel_id").alias("h")
    kept = stored(rel.where("subject_id <> object_id").select("subject_id", "object_id", F.col("transcript_id").alias("t"), hashed, F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("c")))
    both = F.array(F.struct(F.col("subject_id").alias("e"), F.col("object_id").alias("o")), F.struct(F.col("object_id").alias("e"), F.col("subject_id").alias("o")))
    ends = kept.select(F.explode(both).alias("x"), "t", "h", "c").select("x.e", "x.o", "t", "h", "c")
    # no entity has more neighbours or transcripts than relations; tasks count them
    scripts = kept.agg(F.count_distinct("t")).first()[0]
    per = ends.groupBy("e").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.greatest("c", F.lit(0.0))).alias("_sure"))
    per = stored(per.withColumn("_most", F.col("_n") * 2 + F.least("_n", F.lit(scripts))))
    surest = per.agg(F.max("_sure")).first()[0] or 0.0
    probe = _tops(ends, stored(per.orderBy(F.desc("_most"), "e").limit(PROBED)), 0.0, surest, least, limit).orderBy(F.desc("score")).limit(limit).agg(F.min("score"), F.count(F.lit(1))).first()
    floor = probe[0] - 1e-5 if probe[1] == limit else 0.0  # below any rounding of scores
    able = stored(per.where(F.col("_most") + 0.1 * (F.col("_sure") + surest) >= floor))
    out = _tops(ends, able, floor, surest, least, limit)
    line = F.format_string("%s <-?-> %s  score=%.2f  shared=%d+%d", "a", "b", "score", "shared_nodes", "shared_transcripts")
    return out.orderBy(F.desc("score"), "a", "b").limit(limit).select("a", "b", "shared_nodes", "shared_transcripts", F.round("support", 6).alias("support"), "score", line.alias("line"))


def _tops(ends: DataFrame, able: DataFrame, floor: float, surest: float, least: int, limit: int) -> DataFrame:
    """The first limit pairs of each task: entities `able` (e, _n, the number of their rows in ends) are dealt to tasks, each two of which meet in one.

    Entities of different components share nothing: where rows are many, components are packed into tasks, and only one of
    more than LINK_ROWS rows is cut into groups, each two of which meet in a task of their own.
    """
    total = able.agg(F.sum("_n")).first()[0] or 0
    rows = ends.join(able.select("e"), "e")
    dealt = able.select("e", F.lit("").alias("key"), F.lit(min(4, max(1, total // (LINK_ROWS // 8)))).alias("groups"))
    if total > LINK_ROWS:
        part = stored(able.select("e", "_n").join(weak(rows, "e", "o").select(F.col("node").alias("e"), "component"), "e"))
        sized = part.groupBy("component").agg(F.sum("_n").alias("_rows")).withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("_rows") * 2 / LINK_ROWS).cast("int")))
        packed_ = F.concat(F.lit("\0"), F.pmod(F.xxhash64("component"), F.lit(4 * total // LINK_ROWS)))
        named = sized.select("component", F.when(F.col("_rows") <= LINK_ROWS, packed_).otherwise(F.col("component")).alias("key"), F.when(F.col("_rows") <= LINK_ROWS, 1).otherwise(F.col("groups")).alias("groups"))
        dealt = stored(part.join(named, "component").select("e", "key", "groups"))
    dealt = dealt.withColumn("g", F.pmod(F.hash("e"), F.col("groups")).cast("int"))
    met = rows.join(dealt, "e").select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("_with"))
    met = met.select("e", "o", "t", "h", "c", "g", "key", F.least("g", "_with").alias("lo"), F.greatest("g", "_with").alias("hi"))

    def go(key: tuple, t: pa.Table) -> pa.Table:
        return best_pairs(t, key[1].as_py(), key[2].as_py(), floor, surest, least, limit)

    return met.groupBy("key", "lo", "hi").applyInArrow(go, PAIRS)
