"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, content_key, small, stash

#: Words in a block at most, slots at least (fewer only where there are fewer words), repeats of a source at most.
BLOCK, SLOTS, REPEATS = 4096, 1 << 16, 3
#: Documents in a range of the shuffled order, slots in a run.
RANGE_ROWS, RUN_SLOTS = 4096, 8192
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text):
    """Runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, BLANKS), "")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = REPEATS) -> DataFrame:
    """Add position, weight and target to (source, source_size).

    Sources by code point, null last, take the weights in turn. All sizes together are shared
    by weight; a target stops at repeats times its source's size, and the excess is shared
    again by weight until none is above. The sources capped are those with the least size per
    weight, so the level is found from running sums. One row per source goes to one task.
    """
    line = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("position", F.row_number().over(line) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * repeats)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, mass = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (mass - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.first(open_level, ignorenulls=True).over(whole))
    return s.select("source", "source_size", "position", "weight", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), block: int | None = None, repeats: int = REPEATS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, segments).

    documents: row, doc_id, text_key, source, size, source_size, target, one row per row of docs.
    segments, the mix itself: slot, source, rank, row, doc_id, text_key, copy, first_word, n_words;
    ordered by slot it is the training order. Each source's documents, in a hashed order that
    does not change between runs, form one stream, read at most repeats times and cut into
    blocks of `block` words (by default so many that there are SLOTS slots, BLOCK at most). Slot i belongs to the
    source in whose share of the targets the point frac(i * golden ratio) falls, and takes that
    source's next block. How much a source gives is thus the number of its slots, which differs
    from its share by a few slots however many there are; the slots of a stream that has ended
    stay empty. Null and empty texts have size 0 and are in no segment. Repeated rows are
    documents of their own. No documents: no rows.
    """
    slim = docs.select("doc_id", "source", content_key(F.col("text")).alias("text_key"), word_count(F.col("text")).alias("size"))
    slim = stash(slim.select("*", F.xxhash64(F.lit(seed), "doc_id", "text_key").alias("mark"), F.monotonically_increasing_id().alias("row")), "sizes")
    sources = stash(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    targets = source_targets(sources.select("source", "source_size"), weights, repeats)
    targets = stash(targets.join(sources.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    n_sources, total = targets.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    block = block or max(1, min(BLOCK, (total or 0) // SLOTS))
    slots = stash(schedule(targets, -(-(total or 0) // block), n_sources), "slots")
    given = slots.groupBy("position").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("position", "_p")
    quotas = targets.join(given, F.col("position") == F.col("_p"), "left").drop("_p")
    quotas = quotas.withColumn("quota", F.least(F.coalesce("_n", F.lit(0)) * block, F.col("source_size") * repeats)).drop("_n")

    known = slim.join(small(quotas.withColumnRenamed("source", "_s"), n_sources), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ranges = F.ceil(F.col("rows") / RANGE_ROWS).cast("double")
    share = (F.col("mark").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    known = known.withColumn("part", F.least(F.floor(share * ranges), ranges - 1).cast("long"))
    inside = Window.partitionBy("position", "part").orderBy("mark", "doc_id", "text_key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = known.withColumn("upto", F.sum("size").over(inside))
    sums = known.groupBy("position", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("position").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("position").alias("_p"), F.col("part").alias("_part"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("base"))
    placed = placed.join(sums, (F.col("position") == F.col("_p")) & (F.col("part") == F.col("_part")))
    placed = placed.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).where("size > 0")
    turn = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"))
    turn = turn.withColumn("begin", F.col("copy") * F.col("source_size") + F.col("start")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota"))).where("begin < end")
    pieces = turn.select("*", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("rank"))
    lo, hi = F.greatest(F.col("begin"), F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    pieces = pieces.select("source", "position", "rank", "row", "doc_id", "text_key", "copy", (lo - F.col("begin")).alias("first_word"), (hi - lo).alias("n_words"))

    segments = pieces.join(slots, ["position", "rank"]).select("slot", "source", "rank", "row", "doc_id", "text_key", "copy", "first_word", "n_words")
    about = small(targets.select(F.col("source").alias("_s"), "source_size", "target"), n_sources)
    return slim.join(about, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "mark"), segments


def schedule(targets: DataFrame, n: int, n_sources: int) -> DataFrame:
    """(slot, position, rank) of n slots: golden-ratio points through the cumulative targets, slots ranked per source.

    A point finds its source by the cell of a grid that it falls in: the cells are as many as
    the sources, and each holds the sources that reach into it. Slots fall into runs of
    RUN_SLOTS; a source's rank is its count in earlier runs plus that in its run, so no task
    sees more than a run of slots or a source's run counts.
    """
    whole = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = targets.where("target > 0").select("position", F.sum("target").over(whole).alias("hi"), "target")
    everything = F.max("hi").over(Window.partitionBy(F.lit(0)))
    cum = cum.select("position", ((F.col("hi") - F.col("target")) / everything).alias("lo"), (F.col("hi") / everything).alias("hi"))
    cum = cum.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("position")), F.lit(0.0)))  # no gaps by rounding
    cells = max(1, n_sources)
    grid = cum.select("position", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    point = (F.col("id").cast("double") * GOLDEN) % 1.0
    slots = targets.sparkSession.range(n).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    slots = slots.join(small(grid, 2 * cells), "cell").where("x >= lo and x < hi").select("slot", "position", F.floor(F.col("slot") / RUN_SLOTS).alias("run"))
    counts = slots.groupBy("position", "run").agg(F.count(F.lit(1)).alias("c"))
    base = counts.select("position", "run", F.coalesce(F.sum("c").over(Window.partitionBy("position").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("position", "run").orderBy("slot")) - 1)
    return ranked.join(base, ["position", "run"]).select("slot", "position", (F.col("base") + F.col("r")).cast("long").alias("rank"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, text_key, source, size, source_size, target, taken (words, repeats counted)."""
    base, segments = mix(docs, **options)
    taken = segments.groupBy("row").agg(F.sum("n_words").alias("_taken"))
    return base.join(taken, "row", "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("row", "_taken")
