"""Connected components by repeated contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash

#: Rows that one task takes in any case; tables of more parts keep the parts they were shuffled to.
ROWS_A_PART, MOST_PARTS = 20_000, 64


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Union-find over a shuffled edge list: returns (node, root) for every node of an edge.

    Each round hooks every node to the neighbour (or itself) with the smallest hashed rank,
    replaces both ends of every edge by their parents and drops loops and repeats; ranks are
    hashed, so chains stay short whatever the identifiers are. Only the edges and each round's
    (node, parent) table move, both written to the shared folder; the parents of all rounds are
    followed at the end. Tables are counted, so that small ones take few tasks and are
    broadcast. Null ends and loops are ignored. No edges: no rows. The root is one of the
    component's nodes.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    live = stash(both.distinct(), "edges")
    n = live.count()
    steps = []
    while n:
        ends = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = ends.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("rank"), F.col("v"))).alias("m"))
        mine = F.struct(F.xxhash64("u").alias("rank"), F.col("u").alias("v"))
        parent = stash(_dealt(best.select("u", F.least(mine, F.col("m"))["v"].alias("p")), 2 * n), "parents")
        steps.append((parent, 2 * n))
        pu = small(parent.select("u", F.col("p").alias("pu")), 2 * n)
        pv = small(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), 2 * n)
        moved = live.join(pu, "u").join(pv, "v").where("pu <> pv")
        live = stash(_dealt(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), n), "edges")
        n = live.count()
    if not steps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = steps[0][0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for parent, rows in steps[1:]:
        roots = roots.join(small(parent.withColumnRenamed("u", "root"), rows), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return stash(roots, "roots")


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, in no more parts than they need."""
    parts = -(-rows // ROWS_A_PART)
    return df.coalesce(parts) if parts <= MOST_PARTS else df
