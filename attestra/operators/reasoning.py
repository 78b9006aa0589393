"""Truth by propagation: rounds until nothing moves, overrides, counterfactuals, agreements."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators import graph as gr
from attestra.operators import sweeps as sw
from attestra.operators.components import TASK_EDGES, ensure_checkpoints, weak

#: Rounds at most, change of any value below which rounds end, rounds between checkpoints.
ROUNDS, EPSILON, KEEP_EACH = 50, 0.001, 4


def settle(state: DataFrame, step: Callable[[DataFrame], DataFrame], value: str = "value", was: str = "was", rounds: int = ROUNDS, epsilon: float = EPSILON) -> tuple[DataFrame, int, float]:
    """(state, rounds taken, greatest last change): step repeated until no value changes by more than epsilon.

    step leaves the value before in the column `was`, so that a round's change needs no join. A value that appears
    changes by itself. Each round is checkpointed in the shared folder, which cuts the lineage.
    """
    ensure_checkpoints(state.sparkSession)
    state, taken, change = state.checkpoint(), 0, float("inf")
    while taken < rounds and change > epsilon:
        state = step(state).checkpoint()
        taken += 1
        change = state.agg(F.max(F.abs(F.col(value) - F.coalesce(was, F.lit(0.0))))).first()[0] or 0.0
    return state, taken, change


def relation_truth(edges: DataFrame, rounds: int = ROUNDS, epsilon: float = EPSILON) -> tuple[DataFrame, int, float]:
    """H4: rows (rel_id, subject_id, object_id, confidence, anchor) with value, the truth after synchronous rounds.

    Truth is never invented: what no anchored relation reaches stays null. Components are packed into tasks, which make all
    rounds in place; larger ones make rounds over numbers of rows and nodes.
    """
    return sw.relation_rounds(edges, rounds, epsilon)


def touched(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """H5: the relations that a change of others (rel_id) can reach, however far: those in their connected components."""
    part = weak(edges, "subject_id", "object_id").select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    named = edges.join(part, F.col("subject_id") == F.col("_n"), "left").withColumn("_c", F.coalesce("_c", "subject_id")).drop("_n")
    reached = named.join(changed.select("rel_id"), "rel_id", "left_semi").select("_c").distinct()
    return named.join(reached, "_c", "left_semi").drop("_c")


def overridden(claims: DataFrame, fields: DataFrame, deletions: DataFrame, columns: tuple[str, ...] = ("text", "kind", "stance")) -> DataFrame:
    """Claims without the deleted, with the fields that an operator set, and overridden_fields, their names.

    fields has claim_id and a column per field; null leaves the field as it is.
    """
    f = fields.select("claim_id", *[F.col(c).alias(f"_{c}") for c in columns])
    j = claims.join(deletions.select("claim_id"), "claim_id", "left_anti").join(f, "claim_id", "left")
    names = F.filter(F.array(*[F.when(F.col(f"_{c}").isNotNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return j.withColumns({**{c: F.coalesce(f"_{c}", c) for c in columns}, "overridden_fields": names}).drop(*[f"_{c}" for c in columns])


def claim_truth(claims: DataFrame, deps: DataFrame, pins: DataFrame | None = None, rounds: int = ROUNDS, epsilon: float = EPSILON, order: str | None = None) -> tuple[DataFrame, int, float]:
    """(claim_id, confidence, truth, anchor, value) after rounds; pins (claim_id, truth) stand in for the direct truth.

    With order, a column of claims, claims are renewed one after the other in that order; else all at once, when a
    round carries truth one step only. Either way components are packed into tasks, which make all rounds in place.
    """
    return sw.claim_sweeps(claims, deps, pins, order or "claim_id", rounds, epsilon, together=not order)


def claims_index(claims: DataFrame, deps: DataFrame, fields: DataFrame, pins: DataFrame, deletions: DataFrame, **options) -> tuple[DataFrame, dict]:
    """The claims with derived truth, truth_source and overridden_fields, and the index's header."""
    held = overridden(claims, fields, deletions)
    settled, taken, change = claim_truth(held, deps, pins, **options)
    derived = settled.select("claim_id", F.col("value").alias("derived"))
    out = held.join(derived, "claim_id", "left").join(pins.select("claim_id", F.lit(True).alias("_pinned")), "claim_id", "left")
    out = out.withColumn("truth_source", truth_source(F.col("_pinned").isNotNull(), F.col("derived"), F.col("truth"))).drop("_pinned")
    row = out.agg(F.count_distinct("video_id"), F.count(F.lit(1)), F.count("derived")).first()
    return out, {"documents": row[0], "claims": row[1], "iterations": taken, "max_delta": change, "derived": row[2]}


def truth_source(pinned: Column, derived: Column, direct: Column) -> Column:
    """Where a claim's truth comes from; sums that differ by rounding alone are no move."""
    moved = derived.isNotNull() & (direct.isNull() | (F.abs(derived - direct) > 1e-9))
    return F.when(pinned, "override").when(moved, "derived").when(direct.isNotNull(), "direct").otherwise("uncalibrated")


def counterfactual(claims: DataFrame, deps: DataFrame, pins: DataFrame, floor: float = 0.0005, **options) -> DataFrame:
    """(claim_id, baseline, assumed, delta) of the claims that move by floor or more when pins are assumed."""
    before = claim_truth(claims, deps, None, **options)[0].select("claim_id", F.col("value").alias("baseline"))
    after = claim_truth(claims, deps, pins, **options)[0].select("claim_id", F.col("value").alias("assumed"))
    j = after.where("assumed is not null").join(before, "claim_id", "left").withColumn("delta", F.col("assumed") - F.coalesce("baseline", "assumed"))
    return j.where(F.abs("delta") >= floor).select("claim_id", "baseline", "assumed", "delta")


def viewer_shifts(claims: DataFrame, deps: DataFrame, pins: DataFrame, include: DataFrame, floor: float = 0.0005, visible: float = 0.005, **options) -> DataFrame:
    """(claim_id, baseline, assumed, delta, row) for a viewer, without the pinned claims.

    row is appeared (a truth on one side only, measured from 0.5), shift (visible or more), small
    (counted, not shown) or included (asked for, and not shown otherwise; delta 0).
    """
    before = claim_truth(claims, deps, None, **options)[0].select("claim_id", F.col("value").alias("b"))
    after = claim_truth(claims, deps, pins, **options)[0].select("claim_id", F.col("value").alias("a"))
    j = before.join(after, "claim_id").join(pins.select("claim_id"), "claim_id", "left_anti").where("a is not null or b is not null")
    j = j.join(include.select("claim_id", F.lit(True).alias("_asked")).distinct(), "claim_id", "left")
    appeared = F.col("a").isNull() != F.col("b").isNull()
    delta = F.when(F.col("b").isNull(), F.col("a") - 0.5).when(F.col("a").isNull(), 0.5 - F.col("b")).otherwise(F.col("a") - F.col("b"))
    row = F.when(appeared, "appeared").when(F.abs("delta") >= visible, "shift").when(F.col("_asked"), "included").when(F.abs("delta") >= floor, "small")
    j = j.withColumn("delta", delta).withColumn("row", row).where("row is not null")
    return j.select("claim_id", F.col("b").alias("baseline"), F.coalesce("a", "b").alias("assumed"), F.when(F.col("row") == "included", 0.0).otherwise(F.col("delta")).alias("delta"), "row")


def agreement_cap(pairs: DataFrame, cap: int = 4, most: int = TASK_EDGES) -> DataFrame:
    """Of pairs (left, right, left_video, right_video) those that a greedy pass in pair order keeps, cap per document.

    Of two documents only the first cap pairs can be kept: one of these that is not kept has a full document, which
    stays full. The pass goes over blocks of at most `most` pairs, in order, a task each; between blocks the
    pairs of full documents go, and no document takes part in more than cap kept pairs.
    """
    ensure_checkpoints(pairs.sparkSession)
    key = F.concat_ws("|", F.least("left", "right"), F.greatest("left", "right"))
    two = F.array_sort(F.array("left_video", "right_video"))
    rank = F.row_number().over(Window.partitionBy("_two").orderBy("_key", "left", "right"))
    todo = pairs.withColumn("_key", key).withColumn("_two", two).withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_two", "_rank").checkpoint()
    kept, columns = todo.limit(0), todo.columns

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_key", "left", "right"])
        n, keep = {}, []
        for a, b, x, y in zip(rows["left_video"], rows["right_video"], rows["_left_n"], rows["_right_n"], strict=True):
            n.setdefault(a, int(x)), n.setdefault(b, int(y))
            keep.append(n[a] < cap and n[b] < cap)
            for d in {a, b} if keep[-1] else ():
                n[d] += 1
        return rows[keep][columns]

    while todo.limit(1).count():
        held = kept.select(F.explode(F.array_distinct(F.array("left_video", "right_video"))).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
        for side in ("left", "right"):
            one = held.select(F.col("_d").alias(f"_{side}_d"), F.col("_n").alias(f"_{side}_n"))
            todo = todo.join(one, F.col(f"{side}_video").eqNullSafe(F.col(f"_{side}_d")), "left").drop(f"_{side}_d").fillna(0, [f"_{side}_n"])
        todo = todo.where((F.col("_left_n") < cap) & (F.col("_right_n") < cap)).checkpoint()
        block = todo.orderBy("_key", "left", "right").limit(most).checkpoint()
        kept = kept.union(block.withColumn("_one", F.lit(True)).groupBy("_one").applyInPandas(go, pairs.withColumn("_key", key).schema)).checkpoint()
        last = block.agg(F.max(F.struct("_key", "left", "right")).alias("_last"))  # one row
        todo = todo.select(columns).crossJoin(F.broadcast(last)).where(F.struct("_key", "left", "right") > F.col("_last")).drop("_last")
    return kept.drop("_key")
