"""Components of graphs without a hop limit: weak ones by contraction, strong ones, and labels kept under changes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task may hold.
TASK_EDGES = 200_000
#: Share of the edges that a round of trimming must remove for another to follow.
TRIM_GAIN = 0.1


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(found)


def stored(rows: DataFrame) -> DataFrame:
    """rows, made once and read again from Parquet beside the checkpoints: a checkpoint keeps rows uncompressed, as they lie in memory."""
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _local(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of edges as they lie in a partition, up to TASK_EDGES at a time: root is the least node that these connect a node to."""
    held, n = [], 0
    for batch in batches:
        held.append(batch[["u", "v"]])
        n += len(batch)
        if n >= TASK_EDGES:
            yield _rooted(pd.concat(held))
            held, n = [], 0
    if n:
        yield _rooted(pd.concat(held))


def _rooted(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of some edges: roots take the least root beside them, all at once, until none is left that could."""
    both = pa.concat_arrays([pa.Array.from_pandas(edges[c]) for c in ("u", "v")]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    u, v = rank[both.indices.to_numpy()].reshape(2, -1)
    root = np.arange(len(order))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v = a[apart], b[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    names = both.dictionary.take(pa.array(order))
    return pd.DataFrame({"node": names.to_pandas(), "root": names.take(pa.array(root)).to_pandas()})


def weak(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): connected components whichever way edges point, named by their least node.

    Edges that lie beside each other are connected in place first, so that small components whose edges
    come together need no round at all; roots that share a node are the edges of what is left, which
    is contracted. Nodes with loops only, and null ends, are in no component.
    """
    ensure_checkpoints(edges.sparkSession)
    kind = edges.schema[left].dataType.simpleString()
    ends = edges.select(F.col(left).alias("u"), F.col(right).cast(kind).alias("v")).where("u <> v")
    held = ends.mapInPandas(_local, f"node {kind}, root {kind}").groupBy("node").agg(F.collect_set("root").alias("roots")).select("node", F.array_min("roots").alias("root"), "roots").checkpoint()
    open_ = held.where("size(roots) > 1").select(F.col("root").alias("u"), F.explode("roots").alias("v")).where("u <> v").checkpoint()
    if not open_.limit(1).count():
        return held.select("node", F.col("root").alias("component"))
    named = contracted(open_).select(F.col("node").alias("_n"), "component")
    return held.join(named, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("component", "root").alias("component")).checkpoint()


def contracted(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) as of weak, by rounds of contraction alone.

    Each node joins the neighbour, or itself, with the least hashed rank; edges
    are rewritten to those, repeats and loops go. A constant share of the nodes goes in a round, so
    the number of rounds grows with the logarithm of the nodes, whatever the paths are like.
    """
    ensure_checkpoints(edges.sparkSession)
    live = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().checkpoint()
    chain = None
    while live.limit(1).count():
        near = live.union(live.select("v", "u"))
        ranked = near.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("rank"), F.col("v").alias("to"))).alias("m"))
        joins = ranked.select(F.col("u").alias("node"), F.least("m", F.struct(F.xxhash64("u").alias("rank"), F.col("u").alias("to")))["to"].alias("to")).checkpoint()
        live = live.join(joins.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(joins.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        live = live.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().checkpoint()
        step = joins.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        chain = joins if chain is None else chain.join(step, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_t", "to").alias("to"))
    if chain is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = chain.groupBy("to").agg(F.min("node").alias("component"))
    return chain.join(least, "to").select("node", "component").checkpoint()


def buckets(rows: DataFrame, component: str, most: int = TASK_EDGES) -> tuple[int, DataFrame | None]:
    """(number of buckets of some `most` rows, the components of more rows, or None), where rows are dealt by bucket_of."""
    large = rows.groupBy(component).agg(F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") > most) & F.col(component).isNotNull()).select(component).checkpoint()
    total = rows.count()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-total // most), min(spread, -(-total // 1000)), min(16 * spread, -(-total // 20_000)), 1)
    return parts, large if large.limit(1).count() else None


def bucket_of(component: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(component), F.lit(parts)).cast("int")


def split_off(rows: DataFrame, component: str, large: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows of other components, rows of the large ones): these are few, so that their names come to the rows, and no row is shuffled."""
    rows = rows.where(F.col(component).isNotNull())
    if large is None:
        return rows, rows.where(F.lit(False))
    return rows.join(F.broadcast(large), component, "left_anti"), rows.join(F.broadcast(large), component, "left_semi")


def packed(rows: DataFrame, component: str, most: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """(rows of the components that have at most `most`, with a bucket of some `most` rows; rows of the larger ones); rows are read several times."""
    parts, large = buckets(rows, component, most)
    small, rest = split_off(rows, component, large)
    return small.withColumn("bucket", bucket_of(component, parts)), rest


def strong_in_task(edges: Iterable[tuple]) -> list[tuple]:
    """(node, least node) of the strong components with a cycle, by one depth-first pass with an explicit stack."""
    out: dict = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
        out.setdefault(v, [])
    index, low, open_, stack, found = {}, {}, set(), [], []
    for root in out:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        open_.add(root)
        work = [(root, iter(out[root]))]
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    open_.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in open_:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        open_.discard(members[-1])
                    if len(members) > 1:
                        least = min(members)
                        found += [(m, least) for m in members]
    return found


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those from a node that nothing leads to, or to one that leads nowhere, while that removes many."""
    before = edges.count()
    while before:
        edges = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v").checkpoint()
        after = edges.count()
        if after > (1 - TRIM_GAIN) * before:
            break
        before = after
    return edges


def _spread(state: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """state (node, value) when each node takes the greatest value of those that lead to it, again and again; only nodes that changed are followed."""
    front = state
    while True:
        came = edges.join(front.select(F.col("node").alias("u"), F.col(value).alias("_c")), "u").groupBy(F.col("v").alias("node")).agg(F.max("_c").alias("_c"))
        moved = state.join(came, "node").where(F.col("_c").isNotNull() & (F.col(value).isNull() | (F.col("_c") > F.col(value)))).select("node", F.col("_c")).checkpoint()
        if not moved.limit(1).count():
            return state
        state = state.join(moved, "node", "left").withColumn(value, F.coalesce("_c", value)).drop("_c").checkpoint()
        front = moved.select("node", F.col("_c").alias(value))


def strong(edges: DataFrame, left: str = "u", right: str = "v", most: int = TASK_EDGES) -> DataFrame:
    """(node, component): strong components that hold a cycle, named by their least node; a node with a loop is one by itself.

    Nodes without edges in or out are trimmed. Weak components of at most `most` edges are packed into
    tasks and done there; a larger one is cut by colours: every node takes the greatest node that leads
    to it, and of the nodes of a colour those that lead back to it are its strong component. Edges
    between colours go, so that what is left falls apart, until nothing is. Null ends are ignored.
    """
    ensure_checkpoints(edges.sparkSession)
    all_ = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null").distinct()
    loops = all_.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).checkpoint()
    kind = all_.schema["u"].dataType.simpleString()

    def in_task(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(strong_in_task(zip(rows["u"], rows["v"], strict=True)), columns=["node", "component"])

    found, live = loops.limit(0), _trimmed(all_.where("u <> v").checkpoint())
    while live.limit(1).count():
        part = weak(live)
        held = live.join(part.select(F.col("node").alias("u"), "component"), "u").checkpoint()
        small, large = packed(held, "component", most)
        found = found.union(small.groupBy("bucket").applyInPandas(in_task, f"node {kind}, component {kind}"))
        live = large.select("u", "v").checkpoint()
        if not live.limit(1).count():
            break
        nodes = live.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        colour = _spread(nodes.withColumn("colour", F.col("node")).checkpoint(), live, "colour")
        inside = live.join(colour.select(F.col("node").alias("u"), "colour"), "u").join(colour.select(F.col("node").alias("v"), F.col("colour").alias("c")), "v").where("colour = c").select("u", "v", "colour").checkpoint()
        back = inside.select(F.col("v").alias("u"), F.col("u").alias("v"))
        reached = _spread(colour.select("node", "colour", F.when(F.col("node") == F.col("colour"), 1).alias("hit")).checkpoint(), back, "hit").where("hit = 1")
        least = reached.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.union(reached.join(least, "colour").select("node", "component")).checkpoint()
        gone = reached.select("node")
        live = _trimmed(inside.select("u", "v").join(gone.select(F.col("node").alias("u")), "u", "left_anti").join(gone.select(F.col("node").alias("v")), "v", "left_anti").checkpoint())
    cyclic = found.checkpoint()
    return cyclic.union(loops.join(cyclic, "node", "left_anti"))


def relabelled(labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, touched): weak components after edges (u, v) were added and removed, and the components that changed.

    labels (node, component) are those before, edges all edges as they are now. Additions merge the
    labels of their ends; only components that lost an edge are labelled again, from their own edges.
    touched lists the components, as they are now, that hold an end of an added or removed edge.
    """
    ensure_checkpoints(labels.sparkSession)
    ends = lambda df: df.select(F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()
    broken = labels.join(ends(removed), "node", "left_semi").select("component").distinct().checkpoint()
    again = labels.join(broken, "component", "left_semi").select("node").checkpoint()
    kept = labels.join(broken, "component", "left_anti")
    old = edges.join(added.select(F.col("u").alias("_u"), F.col("v").alias("_v")), (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")), "left_anti").select("u", "v")
    fresh = weak(old.join(again.select(F.col("node").alias("u")), "u", "left_semi"))
    before = kept.select("node", "component").union(fresh).checkpoint()
    side = lambda c: before.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    merges = added.select("u", "v").where("u <> v").join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    joined = weak(merges).select(F.col("node").alias("_l"), F.col("component").alias("_new")).checkpoint()
    news = ends(added.where("u <> v")).join(before, "node", "left_anti").select("node", F.col("node").alias("component"))
    after = before.union(news).join(joined, F.col("component") == F.col("_l"), "left").select("node", F.coalesce("_new", "component").alias("component")).checkpoint()
    touched = after.join(ends(added).union(ends(removed)).union(again).distinct(), "node", "left_semi").select("component").distinct()
    return after, touched
