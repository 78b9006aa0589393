"""Claims: dependencies, contradictions, agreements, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import STOP_WORDS, jaccard, subkind, token_set
from attestra.operators.components import ensure_checkpoints, stored

#: Distinct vectors up to which all their cosines are made once and broadcast: at most the square of it in rows.
FEW_VECTORS = 500
#: Distinct tokens up to which a claim's set of them is kept as bits, 64 to a column.
FEW_TOKENS = 512


def with_ends(deps: DataFrame, claims: DataFrame) -> DataFrame:
    """Dependencies with truth and confidence of both ends."""
    s = claims.select(F.col("claim_id").alias("source"), F.col("truth").alias("source_truth"), F.col("confidence").alias("source_confidence"))
    t = claims.select(F.col("claim_id").alias("target"), F.col("truth").alias("target_truth"))
    return deps.join(s, "source").join(t, "target")


def pair_contradictions(deps: DataFrame, claims: DataFrame) -> DataFrame:
    """Contradicting claims that are both held: logical or untyped from 0.5, debunks from 0.7; missing truth is 0."""
    j = with_ends(deps.where("kind = 'contradicts'"), claims).withColumn("subkind", F.coalesce(subkind(F.col("rationale")), F.lit("logical")))
    low = F.least(F.coalesce("source_truth", F.lit(0.0)), F.coalesce("target_truth", F.lit(0.0)))
    return j.where(((F.col("subkind") == "logical") & (low >= 0.5)) | ((F.col("subkind") == "debunks") & (low >= 0.7))).select("source", "target", "subkind")


def broken_presuppositions(deps: DataFrame, claims: DataFrame) -> DataFrame:
    """Held claims that presuppose one below 0.3."""
    return with_ends(deps.where("kind = 'presupposes'"), claims).where("target_truth < 0.3 and source_truth >= 0.5").select("source", "target", "source_truth", "target_truth")


def cross_document(claims: DataFrame, prefix: str = "", floor: float = 0.1, overlap: int = 2, block: int = 2000, carry: tuple[str, ...] = (), apart: str | None = None) -> DataFrame:
    """I16 without vectors: opposed claims of different documents that share an entity and words or entities enough.

    Entities that begin with prefix (all by default) are the join key; only asserting claims meet
    denying ones, so a hub entity pairs its two stances and never all with all. Claims of an entity
    with more than block of them are cut into blocks, and each two blocks meet in a place of their
    own. A pair counts in the least entity it shares. Token sets are made once per claim, before the join.
    Columns of claims to carry come as left_<column> and right_<column>. Claims that both have apart (a boolean column) don't meet.
    """
    kept = [*carry, *([apart] if apart else [])]
    c = claims.where("stance in ('asserts', 'denies')").select(F.struct(*[F.col(x) for x in kept]).alias("_kept") if kept else F.lit(True).alias("_kept"), "video_id", "claim_id", "stance", F.array_distinct("entities").alias("entities"), token_set(F.col("text"), 2, STOP_WORDS).alias("tokens"))
    c, words = token_bits(c)
    keys = F.filter("entities", lambda e: e.startswith(prefix))
    c = c.withColumn("_least", F.array_min(keys)).withColumn("entity", F.explode(keys))
    # a claim of two entities has one beside its key, which is compared as it is
    c = c.withColumn("_first", F.col("entity") == F.col("_least")).withColumn("_other", F.when(F.size("entities") == 2, F.when(F.get("entities", F.lit(0)) == F.col("entity"), F.get("entities", F.lit(1))).otherwise(F.get("entities", F.lit(0)))))
    heavy = c.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)  # no more than a block-th of the rows
    c = c.join(F.broadcast(heavy.select("entity", F.ceil(F.col("n") / block).cast("int").alias("blocks"))), "entity", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, others = F.pmod(F.xxhash64("claim_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(k: str, stance: str, me: str, other: str) -> DataFrame:
        return c.where(F.col("stance") == stance).select("entity", mine.alias(me), others.alias(other), F.col("video_id").alias(f"{k}v"), F.col("claim_id").alias(k), F.col("entities").alias(f"{k}e"), F.col("_kept").alias(f"{k}k"), F.col("_first").alias(f"{k}f"), F.col("_other").alias(f"{k}o"), *[F.col(x).alias(f"{k}_{x}") for x in words])

    both = F.array_intersect("ae", "de")
    j = side("a", "asserts", "p", "q").join(side("d", "denies", "q", "p"), ["entity", "p", "q"]).where("av <> dv").where(~(F.coalesce(F.col("ak")[apart], F.lit(False)) & F.coalesce(F.col("dk")[apart], F.lit(False))) if apart else F.lit(True))
    # the least entity of one claim is the least of those it shares; only others are looked for
    j = j.where(F.col("af") | F.col("df") | (F.col("entity") == F.array_min(F.filter(both, lambda e: e.startswith(prefix)))))
    shared = F.when(F.col("ao").isNotNull() & F.col("do").isNotNull(), F.when(F.col("ao") == F.col("do"), 2).otherwise(1)).otherwise(F.size(both))
    j = j.select("a", "d", "av", "dv", "ak", "dk", _likeness(words).alias("similarity"), shared.alias("shared"))
    j = j.withColumn("reason", F.when(F.col("similarity") >= floor, "jaccard").when(F.col("shared") >= overlap, "strong-overlap")).where("reason is not null")
    first = F.col("av") < F.col("dv")
    return j.select(F.when(first, F.col("a")).otherwise(F.col("d")).alias("left"), F.when(first, F.col("d")).otherwise(F.col("a")).alias("right"), "shared", F.round("similarity", 6).alias("similarity"), "reason", *_carried(carry, F.when(first, F.col("ak")).otherwise(F.col("dk")), F.when(first, F.col("dk")).otherwise(F.col("ak"))))


def token_bits(claims: DataFrame) -> tuple[DataFrame, list[str]]:
    """(claims, columns of their token sets): up to FEW_TOKENS distinct tokens as bits in whole numbers, else the sets themselves."""
    known = sorted(r[0] for r in claims.select(F.explode("tokens").alias("t")).distinct().limit(FEW_TOKENS + 1).collect())  # bounded
    if len(known) > FEW_TOKENS:
        return claims, ["tokens"]
    at = F.transform("tokens", lambda t: F.array_position(F.array(*[F.lit(x) for x in known]) if known else F.array().cast("array<string>"), t).cast("int") - 1)
    claims = claims.withColumn("_at", at)
    words = [f"bits{w}" for w in range(max(1, -(-len(known) // 64)))]
    bit = lambda w: F.aggregate(F.filter("_at", lambda n: F.floor(n / 64) == w), F.lit(0).cast("long"), lambda s, n: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), n % 64)))
    return claims.withColumns({x: bit(w) for w, x in enumerate(words)}).drop("_at", "tokens"), words


def _likeness(words: list[str]) -> Column:
    """The share of common tokens of both sides' token_bits."""
    if words == ["tokens"]:
        return jaccard(F.col("a_tokens"), F.col("d_tokens"))
    count = lambda op: sum((F.bit_count(op(F.col(f"a_{x}"), F.col(f"d_{x}"))) for x in words[1:]), F.bit_count(op(F.col(f"a_{words[0]}"), F.col(f"d_{words[0]}"))))
    common, either = count(lambda x, y: x.bitwiseAND(y)), count(lambda x, y: x.bitwiseOR(y))
    return F.when(either > 0, common / either).otherwise(F.lit(0.0))


def _carried(carry: tuple[str, ...], left: Column, right: Column) -> list[Column]:
    return [side[c].alias(f"{name}_{c}") for name, side in (("left", left), ("right", right)) for c in carry]


def opposed(a: Column, b: Column) -> Column:
    """Whether one side asserts what the other denies."""
    return F.coalesce(((a == "asserts") & (b == "denies")) | ((a == "denies") & (b == "asserts")), F.lit(False))


def routed(pairs: DataFrame, verdicts: DataFrame | None, claims: DataFrame) -> DataFrame:
    """Where a candidate pair goes by its verdict; without one it is pending.

    A verdict is found whichever way round its pair is stored. One of the same claim said twice makes
    an agreement, unless the stances are opposed: then the pair is dropped under a verdict of its own.
    Verdicts stand for the texts that they were given on: a left_hash or right_hash that verdicts
    has must be its text's sha1, a null one says nothing. Broken presuppositions (kind) are
    contradictions by themselves and take no verdict. Pairs that carry left_stance, right_stance, left_text_hash and
    right_text_hash (sha1 of the text, of null as of an empty one) don't look their claims up. Without verdicts pairs
    have a verdict already and both stances, and nothing is looked up: the verdict was given on their texts as they are, or on those of
    the left_hash and right_hash that pairs have beside left_text_hash and right_text_hash.
    """
    if verdicts is None:
        alone = F.coalesce(F.col("kind") == "broken-presupposition", F.lit(False)) if "kind" in pairs.columns else F.lit(False)
        fresh = F.lit(True)
        for s in ("left", "right"):
            if f"{s}_hash" in pairs.columns:
                fresh = fresh & F.coalesce(F.col(f"{s}_hash") == F.col(f"{s}_text_hash"), F.lit(True))
        held = _by_verdict(pairs.withColumn("verdict", F.when(fresh & ~alone, F.col("verdict"))), alone, "left_stance", "right_stance")
        return held.drop("left_stance", "right_stance", "left_hash", "right_hash", "left_text_hash", "right_text_hash")
    carried = {f"{s}_{c}" for s in ("left", "right") for c in ("stance", "text_hash")} <= set(pairs.columns)
    side = lambda s: claims.select(F.col("claim_id").alias(s), F.col("stance").alias(f"_{s}_stance"), F.sha1(F.coalesce("text", F.lit(""))).alias(f"_{s}_hash"))
    mechanical = F.coalesce(F.col("kind") == "broken-presupposition", F.lit(False)) if "kind" in pairs.columns else F.lit(False)
    turned = F.col("left") > F.col("right")
    known = verdicts if "left_hash" in verdicts.columns else verdicts.withColumn("left_hash", F.lit(None).cast("string")).withColumn("right_hash", F.lit(None).cast("string"))
    known = known.withColumn("_lo_hash", F.when(turned, F.col("right_hash")).otherwise(F.col("left_hash"))).withColumn("_hi_hash", F.when(turned, F.col("left_hash")).otherwise(F.col("right_hash")))
    known = known.withColumn("_lo", F.least("left", "right")).withColumn("_hi", F.greatest("left", "right")).drop("left", "right", "left_hash", "right_hash")
    j = pairs.withColumn("_lo", F.least("left", "right")).withColumn("_hi", F.greatest("left", "right")).join(known, ["_lo", "_hi"], "left")
    if carried:
        j = j.withColumnsRenamed({f"{s}_{c}": f"_{s}_{n}" for s in ("left", "right") for c, n in (("stance", "stance"), ("text_hash", "hash"))})
    else:
        j = j.join(side("left"), "left", "left").join(side("right"), "right", "left")
    lo, hi = F.when(turned, F.col("_right_hash")).otherwise(F.col("_left_hash")), F.when(turned, F.col("_left_hash")).otherwise(F.col("_right_hash"))
    fresh = F.coalesce(F.col("_lo_hash") == lo, F.lit(True)) & F.coalesce(F.col("_hi_hash") == hi, F.lit(True))
    j = j.withColumn("verdict", F.when(fresh & ~mechanical, F.col("verdict")))
    j = _by_verdict(j, mechanical, "_left_stance", "_right_stance")
    return j.drop("_left_stance", "_right_stance", "_left_hash", "_right_hash", "_lo_hash", "_hi_hash", "_lo", "_hi")


def _by_verdict(pairs: DataFrame, mechanical: Column, left: str, right: str) -> DataFrame:
    v = F.col("verdict")
    apart = (v == "SAME-CLAIM") & opposed(F.col(left), F.col(right))
    route = F.when(mechanical, "contradiction").when(v.isNull(), "pending").when(v.isin("LOGICAL-CONTRADICTION", "DEBUNKS", "UNDERCUTS", "ALTERNATIVE"), "contradiction").when(apart, "dropped").when(v == "SAME-CLAIM", "agreement").otherwise("dropped")
    return pairs.withColumn("route", route).withColumn("verdict", F.when(apart, "SAME-CLAIM-stance-mismatch").otherwise(v))


def dropped_totals(routes: DataFrame) -> DataFrame:
    """Pairs that are not shown as contradictions, by verdict: agreements count here too."""
    return routes.where("route in ('dropped', 'agreement')").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """The (claim_id, vec) whose vectors have components, none of them null or not finite."""
    return vectors.where("size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('inf'))")


def doubles(vectors: DataFrame) -> DataFrame:
    """The usable (claim_id, vec) in doubles, zeros without a sign."""
    return usable_vectors(vectors).select("claim_id", F.expr("transform(vec, x -> cast(x as double) + 0D)").alias("vec"))


def unit_halves(vectors: DataFrame) -> DataFrame:
    """(claim_id, n, head, rest, quarter_norm, half_norm) of usable vectors at length 1, their coordinates by falling mass.

    The mass of a coordinate is the sum of its squares over all vectors. head is the heavier half, rest the other;
    quarter_norm is the length of what lies beyond the heaviest quarter, half_norm that of rest. A zero vector stays zero.
    """
    ensure_checkpoints(vectors.sparkSession)
    v = usable_vectors(vectors).select("claim_id", F.expr("transform(vec, x -> cast(x as double))").alias("v")).withColumn("norm", F.sqrt(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")))
    # the norm is an argument, not a name inside the lambda, where the optimizer would put its sum once per coordinate
    v = v.select("claim_id", F.expr("zip_with(v, array_repeat(if(norm > 0, norm, 1D), size(v)), (x, n) -> x / n)").alias("v")).checkpoint()
    mass = v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("m")).orderBy(F.desc("m"), "i").collect()  # a row per coordinate
    width = len(mass)
    order = F.array(*[F.lit(r["i"]) for r in mass]).cast("array<int>")
    v = v.select("claim_id", F.size("v").alias("n"), F.transform(order, lambda i: F.coalesce(F.get("v", i), F.lit(0.0))).alias("v"))
    length = lambda beyond: F.sqrt(F.aggregate(F.slice("v", beyond + 1, max(0, width - beyond)), F.lit(0.0), lambda s, x: s + x * x))
    half, quarter = width // 2, width // 4
    return v.select("claim_id", "n", F.slice("v", 1, half).alias("head"), F.slice("v", half + 1, max(0, width - half)).alias("rest"), length(quarter).alias("quarter_norm"), length(half).alias("half_norm"), F.lit(quarter).alias("quarter"))


def head_pairs(claims: DataFrame, halves: DataFrame, near: float = 0.55, strict: float = 0.70, block: int = 2000, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(left, right, shared, so_far, least): pairs that may reach the cosine they need (least), by the heavier half of their coordinates.

    What the coordinates beyond a prefix add is at most the product of the two lengths beyond it. The bound at the
    heaviest quarter is looked at first, that at the half for what it leaves; so_far is the half's product.
    Heavy entities are cut into blocks as in cross_document, and a pair counts in the least entity it shares. With whole
    the other half comes along and similarity is the cosine. Columns of claims to carry come as left_<column> and right_<column>.
    """
    more = [*(["rest"] if whole else []), *(["_kept"] if carry else [])]
    claims = claims.withColumn("_kept", F.struct(*carry)) if carry else claims
    c = claims.join(halves if whole else halves.drop("rest"), "claim_id").select(*more, "video_id", "claim_id", "stance", F.array_distinct("entities").alias("entities"), "n", "head", "quarter_norm", "half_norm", "quarter").withColumn("entity", F.explode("entities"))
    heavy = c.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)  # no more than a block-th of the rows
    c = c.join(F.broadcast(heavy.select("entity", F.ceil(F.col("n") / block).cast("int").alias("blocks"))), "entity", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, others = F.pmod(F.xxhash64("claim_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(k: str, name: str, me: str, other: str) -> DataFrame:
        return c.select("entity", mine.alias(me), others.alias(other), F.col("claim_id").alias(name), *[F.col(x).alias(f"{k}_{x}") for x in (*more, "video_id", "stance", "entities", "n", "head", "quarter_norm", "half_norm")], *(["quarter"] if k == "a" else []))

    j = side("a", "left", "p", "q").join(side("b", "right", "q", "p"), ["entity", "p", "q"]).where("a_video_id < b_video_id and a_n = b_n")
    both = F.array_intersect("a_entities", "b_entities")
    j = j.where(F.col("entity") == F.array_min(both)).withColumn("least", F.when(opposed(F.col("a_stance"), F.col("b_stance")), min(near, strict)).otherwise(strict) - 1e-9)
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, z) -> s + z)"
    j = j.where(F.expr(dot.format("slice(a_head, 1, quarter)", "slice(b_head, 1, quarter)") + " + a_quarter_norm * b_quarter_norm >= least"))
    j = j.withColumn("so_far", F.expr(dot.format("a_head", "b_head"))).where("so_far + a_half_norm * b_half_norm >= least")
    total = [(F.col("so_far") + F.expr(dot.format("a_rest", "b_rest"))).alias("similarity")] if whole else []
    return j.select("left", "right", F.size(both).alias("shared"), "so_far", "least", *total, *(_carried(carry, F.col("a__kept"), F.col("b__kept")) if carry else []))


def class_pairs(claims: DataFrame, vectors: DataFrame, classes: DataFrame, near: float, strict: float, block: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """vector_pairs where few vectors differ, those of classes (vec): their cosines are made once, claims meet by class alone."""
    unit = "zip_with({0}, array_repeat(if(norm > 0, norm, 1D), size({0})), (x, n) -> x / n)"
    usable = doubles(vectors)
    classes = classes.withColumn("class", F.monotonically_increasing_id()).checkpoint()
    u = classes.withColumn("norm", F.sqrt(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)"))).select("class", F.size("vec").alias("n"), F.expr(unit.format("vec")).alias("u")).checkpoint()
    side = lambda k: u.select(F.col("class").alias(f"{k}_class"), F.col("n").alias(f"_{k}n"), F.col("u").alias(f"_{k}u"))
    met = side("a").join(F.broadcast(side("b")), F.col("_an") == F.col("_bn")).select("a_class", "b_class", F.expr("aggregate(zip_with(_au, _bu, (x, y) -> x * y), 0D, (s, z) -> s + z)").alias("similarity"))
    met = met.where(F.col("similarity") >= min(near, strict) - 1e-9).checkpoint()
    of = usable.join(F.broadcast(classes), "vec").select("claim_id", "class")
    # claims with one entity need no list of them
    alone = F.when(F.size("entities") > 1, F.col("entities")).alias("entities")
    c = claims.withColumn("_kept", F.struct(*carry) if carry else F.lit(True)).join(of, "claim_id").select("video_id", "claim_id", "stance", "class", "_kept", F.array_distinct("entities").alias("entities"))
    c = stored(c.select("video_id", "claim_id", "stance", "class", "_kept", alone, F.explode("entities").alias("entity")))
    heavy = stored(c.groupBy("entity").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > block))  # no more than a block-th of the rows
    few, many = (c, None) if not heavy.limit(1).count() else (c.join(F.broadcast(heavy.select("entity")), "entity", "left_anti"), c.join(F.broadcast(heavy.select("entity", F.ceil(F.col("_rows") / block).cast("int").alias("blocks"))), "entity"))
    mine, others = F.pmod(F.xxhash64("claim_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def dealt(rows: DataFrame, k: str, name: str, *blocks: Column) -> DataFrame:
        return rows.select("entity", *blocks, F.col("claim_id").alias(name), *[F.col(x).alias(f"{k}_{x}") for x in ("entities", "video_id", "stance", "class", "_kept")])

    # both sides of entities in one block are the same rows, which are shuffled once: pairs need all tasks, however few the rows
    j = dealt(few, "a", "left").join(dealt(few, "b", "right").hint("merge"), "entity")
    if many is not None:
        j = j.union(dealt(many, "a", "left", mine.alias("p"), others.alias("q")).join(dealt(many, "b", "right", mine.alias("q"), others.alias("p")), ["entity", "p", "q"]).drop("p", "q"))
    j = j.where("a_video_id < b_video_id")
    j = j.join(F.broadcast(met), ["a_class", "b_class"])
    both = F.coalesce(F.array_intersect("a_entities", "b_entities"), F.array("entity"))
    least = F.when(opposed(F.col("a_stance"), F.col("b_stance")), min(near, strict)).otherwise(strict) - 1e-9
    j = j.where(F.col("similarity") >= least).where(F.col("entity") == F.array_min(both))
    return j.select("left", "right", F.size(both).alias("shared"), "similarity", *_carried(carry, F.col("a__kept"), F.col("b__kept")))


def vector_pairs(claims: DataFrame, vectors: DataFrame, near: float = 0.55, strict: float = 0.70, block: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """I16 with vectors: claims of different documents that share an entity, by the cosine of their vectors.

    Opposed stances need near, others strict. vectors: (claim_id, vec), one per claim; claims without a usable one, and
    vectors of different lengths, are in no pair here. Exact: where few vectors differ, their cosines are
    made once (class_pairs); else pairs are dropped by bounds on the heavier half of the coordinates (head_pairs). Either way
    nothing is fetched for pairs: what is shuffled are claims. Columns to carry come as left_<column> and right_<column>.
    """
    ensure_checkpoints(vectors.sparkSession)
    classes = doubles(vectors).select("vec").distinct().limit(FEW_VECTORS + 1).checkpoint()
    if classes.count() <= FEW_VECTORS:
        j = class_pairs(claims, vectors, classes, near, strict, block, carry)
    else:
        j = head_pairs(claims, unit_halves(vectors), near, strict, block, carry, whole=True).where("similarity >= least")
    return j.select("left", "right", "shared", F.round("similarity", 6).alias("similarity"), F.lit("cosine").alias("reason"), *[f"{s}_{x}" for s in ("left", "right") for x in carry])


def candidate_pairs(claims: DataFrame, vectors: DataFrame, near: float = 0.55, strict: float = 0.70, floor: float = 0.1, overlap: int = 2, prefix: str = "", block: int = 2000) -> DataFrame:
    """I16: pairs of different documents' claims that share an entity, by the cosine where both have a vector, else by words.

    vectors: (claim_id, vec), unusable ones count as missing. (left, right, shared, similarity, reason) as of
    vector_pairs and cross_document. The rule is chosen for each pair: claims with a vector meet those without by their words.
    """
    has = usable_vectors(vectors).select("claim_id").distinct().withColumn("_vector", F.lit(True))
    by_vector = vector_pairs(claims.withColumn("entities", F.filter("entities", lambda e: e.startswith(prefix))), vectors, near, strict, block)
    return by_vector.unionByName(cross_document(claims.join(has, "claim_id", "left"), prefix, floor, overlap, block, apart="_vector"))


def manual_contradictions(custom: DataFrame, claims: DataFrame, dismissed: DataFrame) -> DataFrame:
    """operators' pairs (left, right) both of whose claims exist and that nobody dismissed."""
    ids = claims.select("claim_id")
    both = custom.join(ids.withColumnRenamed("claim_id", "left"), "left", "left_semi").join(ids.withColumnRenamed("claim_id", "right"), "right", "left_semi")
    return undismissed(both, dismissed).withColumn("kind", F.lit("manual"))


def undismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pairs that nobody dismissed, whichever way round."""
    d = dismissed.select(F.least("left", "right").alias("lo"), F.greatest("left", "right").alias("hi"))
    return pairs.withColumn("lo", F.least("left", "right")).withColumn("hi", F.greatest("left", "right")).join(d, ["lo", "hi"], "left_anti").drop("lo", "hi")


def degrees(deps: DataFrame) -> DataFrame:
    """Dependencies out of and into each claim."""
    both = deps.select(F.col("source").alias("claim_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(deps.select("target", F.lit(0), F.lit(1)))
    return both.groupBy("claim_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def propagate_round(claims: DataFrame, deps: DataFrame, blend: float = 0.4, ceiling: float = 0.2) -> DataFrame:
    """I7, one synchronous round over (claim_id, confidence, anchor, value): all joins are by claim."""
    src = claims.select(F.col("claim_id").alias("source"), F.col("value").alias("v"), F.col("confidence").alias("c")).where("v is not null")
    inc = deps.join(src, "source").withColumn("sk", F.coalesce(subkind(F.col("rationale")), F.lit("logical")))
    alt = (F.col("kind") == "contradicts") & (F.col("sk") == "alternative")
    w = F.when(F.col("kind") == "supports", F.col("c")).when(alt, F.col("c") / 2).when((F.col("kind") == "contradicts") & (F.col("sk") != "undercuts"), F.col("c"))
    x = F.when(F.col("kind") == "supports", F.col("v")).otherwise(1 - F.col("v"))
    under = F.when((F.col("kind") == "contradicts") & (F.col("sk") == "undercuts"), 1 - ceiling * F.col("v") * F.col("c"))
    sums = inc.groupBy(F.col("target").alias("claim_id")).agg(F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.min(under).alias("under"))
    needs = deps.where("kind = 'presupposes'").join(claims.select(F.col("claim_id").alias("target"), F.col("value").alias("tv")), "target").groupBy(F.col("source").alias("claim_id")).agg(F.min("tv").alias("cap"))
    j = claims.join(sums, "claim_id", "left").join(needs, "claim_id", "left")
    avg = F.when(F.col("sw") > 0, F.col("swx") / F.col("sw"))
    nxt = F.when(F.col("anchor").isNull(), avg).when(avg.isNull(), F.col("anchor")).otherwise((1 - blend) * F.col("anchor") + blend * avg)
    nxt = F.when(nxt.isNotNull(), F.least(nxt, F.col("cap"), F.col("under"), F.lit(1.0)))
    return j.select("claim_id", "confidence", "anchor", F.greatest(nxt, F.lit(0.0)).alias("_n"), nxt.isNull().alias("_u")).select("claim_id", "confidence", "anchor", F.when(~F.col("_u"), F.col("_n")).alias("value"))


def leave_one_out(df: DataFrame, selected: dict[str, tuple[str, list]]) -> DataFrame:
    """(facet, bucket, n): each facet's buckets count the rows that all other facets let pass.

    selected: facet -> (column, chosen values; none chosen lets all pass). Rows are read once:
    each is expanded into one row per facet whose others hold.
    """
    passes = {f: (F.col(c).isin(v) if v else F.lit(True)) for f, (c, v) in selected.items()}
    cells = []
    for f, (c, _) in selected.items():
        others: Column = F.lit(True)
        for g, ok in passes.items():
            others = others & ok if g != f else others
        cells.append(F.when(others, F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("bucket"))))
    return df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.facet", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def unit_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts of [0, 1] values in equal bins, the last one closed, empty bins 0."""
    at = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    found = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def month_histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows per month from the first to the last, empty months 0."""
    m = df.where(F.col(column).isNotNull()).select(F.trunc(column, "month").alias("month"))
    grid = m.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    found = m.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(found, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def floor_percentile(df: DataFrame, group: str, column: str, p: float) -> DataFrame:
    """The element at min(n - 1, floor(n * p)) of each group's sorted values; equal values are counted before they are ranked."""
    n = df.groupBy(group, column).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group)
    r = n.withColumn("_upto", F.sum("_c").over(w.orderBy(column))).withColumn("_n", F.sum("_c").over(w))
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))
    return r.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(group, F.col(column).alias("value"))


def gate(metrics: DataFrame, baseline: DataFrame, higher_is_better: dict[str, bool], tolerance: float = 0.05, bounds: dict[str, dict] | None = None) -> DataFrame:
    """(name, value, base, status, warning) of each metric against bounds and a baseline.

    bounds: name -> min, max (a breach is a regression), target_min, target_max (a warning only).
    A drift beyond the tolerance is regressed or improved by the metric's direction; one without
    a direction is new, for information. Metrics without a baseline are new, without a value missing, without both ok.
    """
    j = metrics.join(baseline.select("name", F.col("value").alias("base")), "name", "full")
    value, none = F.col("value"), F.lit(None).cast("boolean")

    def beyond(low: str, high: str) -> Column:
        out = none
        for name, b in (bounds or {}).items():
            out = F.when(F.col("name") == name, (value < F.lit(b.get(low)).cast("double")) | F.coalesce(value > F.lit(b.get(high)).cast("double"), F.lit(False))).otherwise(out)
        return F.coalesce(out, F.lit(False))

    better = F.lit(None).cast("boolean")
    for name, up in higher_is_better.items():
        better = F.when(F.col("name") == name, F.lit(up)).otherwise(better)
    moved = (value - F.col("base")) / F.greatest(F.lit(1.0), F.abs("base"))
    drift = F.when(F.abs(moved) <= tolerance, "ok").when(better.isNull(), "new").when((moved > 0) == better, "improved").otherwise("regressed")
    status = F.when(value.isNull(), F.when(F.col("base").isNull(), "ok").otherwise("missing")).when(beyond("min", "max"), "regressed").when(F.col("base").isNull(), "new").otherwise(drift)
    soft = F.when(beyond("min", "max") | value.isNull(), None).when(beyond("target_min", "target_max"), "beyond target")
    return j.select("name", "value", "base", status.alias("status"), soft.alias("warning"))


def counter_evidence(deps: DataFrame, subkinds: tuple[str, ...] = ("alternative", "undercuts")) -> DataFrame:
    """(claim_id, source, subkind): what other claims of a document hold against a claim."""
    against = deps.where("kind = 'contradicts'").withColumn("subkind", subkind(F.col("rationale")))
    return against.where(F.col("subkind").isin(list(subkinds))).select(F.col("target").alias("claim_id"), "source", "subkind")


def dependency_edges(deps: DataFrame, deleted: DataFrame) -> DataFrame:
    """(source, target, kind) of dependencies neither of whose targets is deleted (claim_id)."""
    return deps.join(deleted.select(F.col("claim_id").alias("target")), "target", "left_anti").select("source", "target", "kind")


def edge_truth(citing: DataFrame) -> DataFrame:
    """(edge, truth, n, claim_ids) of rows (edge, claim_id, truth): the mean truth of the claims that cite an edge; claims without truth don't count."""
    held = citing.where("truth is not null")
    return held.groupBy("edge").agg(F.avg("truth").alias("truth"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))


def with_dependents(claims: DataFrame, deps: DataFrame) -> DataFrame:
    """The claims that others depend on."""
    return claims.join(deps.select(F.col("target").alias("claim_id")), "claim_id", "left_semi")
