"""Merkle manifest of a dataset: trees per group under one root, with a proof for every row.

Rows are cut into superblocks of BRANCH ** DEPTH consecutive leaves. On the way up each superblock
is reduced to one node, and those nodes are the leaves of the next pass. On the way down each pass
cogroups the nodes of a superblock with what lies outside of it (the siblings on its path to the
root, one row), so that the last one finishes the local reduction, joins local and outer siblings
to proofs, and folds them in one go.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stash

#: Children of a node, and levels that one superblock spans (512 leaves).
BRANCH, DEPTH = 8, 3
DIGEST = 64


def encoded(value: Column) -> Column:
    """A value for hashing: '-' for null, else its UTF-8 byte count, ':' and its text (integers decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the encoded values."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def places(i: int, n: int, branch: int = BRANCH) -> Iterator[tuple[int, int]]:
    """Level by level, the position in its run, and the run's length, of node i of n and of the nodes above it."""
    while n > 1:
        start = i - i % branch
        yield i - start, min(branch, n - start)
        i, n = i // branch, -(-n // branch)


def fold(leaf: str, siblings: str, path: list[tuple[int, int]]) -> str:
    """The root that a leaf and the siblings of its path, in hex, left to right and bottom up, lead to."""
    at = 0
    for pos, size in path:
        own, end = at + pos * DIGEST, at + (size - 1) * DIGEST
        leaf, at = digest(siblings[at:own] + leaf + siblings[own:end]), end
    return leaf


def reduced(nodes: list[str], whole: bool, branch: int, depth: int) -> list[list[str]]:
    """The levels of a superblock, bottom up: depth levels above its nodes, or, where it is its group's whole level, up to one node."""
    levels = [nodes]
    for _ in range(depth):
        if whole and len(levels[-1]) == 1:
            break
        now = levels[-1]
        levels.append([digest("".join(now[k : k + branch])) for k in range(0, len(now), branch)])
    return levels


def siblings(levels: list[list[str]], j: int, branch: int) -> str:
    """The other nodes of the runs that lead from node j of a superblock to its top."""
    found = []
    for level in levels[:-1]:
        start = j - j % branch
        found += level[start:j] + level[j + 1 : start + branch]
        j //= branch
    return "".join(found)


def ranked(rows: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """rows with i, their place in order (from 0, nulls first) within their group, n, the group's rows, and part.

    Rows are dealt by ranges and sorted there; the places follow from the counts of the ranges.
    Equal rows take any order among themselves.
    """
    keys = [group] if group else []
    rows = rows.withColumn("_u", F.monotonically_increasing_id())
    rows = stash(rows, "unranked")
    by = [*keys, *order, "_u"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_u")
    dealt = stash(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # one row for each range that holds the group
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stash(counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("_rows").over(whole)), "offsets")
    mine = offsets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_first", "_before", "n")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = dealt.join(small(mine, offsets.count()), same)
    return out.withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_p", "_at", "_first", "_before", *[f"_{k}" for k in keys])


NODE = "gid long, i long, n long, h string"
PATH = "gid long, i long, h string, outer string, root string"


def climbed(level: DataFrame, most: int, branch: int, depth: int) -> list[DataFrame]:
    """Tables of nodes (gid, i, n, h), from the given one up to one node per group, a superblock's levels apart; most: the largest n."""
    block, levels = branch**depth, [level]

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        top = reduced(rows.sort_values("i")["h"].tolist(), n <= block, branch, depth)[-1]
        return pd.DataFrame({"gid": [key[0]], "i": [key[1]], "n": [-(-n // block)], "h": top})

    while most > 1:
        nodes = levels[-1].select("gid", F.floor(F.col("i") / block).alias("block"), "i", "n", "h")
        levels.append(stash(nodes.groupBy("gid", "block").applyInPandas(up, NODE), "nodes"))
        most = -(-most // block)
    return levels


def descended(levels: list[DataFrame], outer: DataFrame, branch: int, depth: int) -> DataFrame:
    """The siblings outside of each node (PATH) of the lowest of the levels; outer has those of the topmost."""
    block = branch**depth

    def down(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("i")
        local = reduced(nodes["h"].tolist(), int(nodes["n"].iloc[0]) <= block, branch, depth)
        paths = [siblings(local, j, branch) + above["outer"].iloc[0] for j in range(len(nodes))]
        return pd.DataFrame({"gid": key[0], "i": nodes["i"], "h": nodes["h"], "outer": paths, "root": above["root"].iloc[0]})

    for level in reversed(levels[:-1]):
        nodes = level.select("gid", F.floor(F.col("i") / block).alias("block"), "i", "n", "h")
        above = outer.select("gid", F.col("i").alias("block"), "outer", "root")
        outer = stash(nodes.groupBy("gid", "block").cogroup(above.groupBy("gid", "block")).applyInPandas(down, PATH), "outer")
    return outer


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, received: dict[str, Column] | None = None, branch: int = BRANCH, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: its leaf, its group's subroot, the root, its proof, and the check of what was received.

    A leaf is the digest of the row's columns. Per group leaves stand in the order of `order`
    (nulls first; rows that repeat it by their leaf), every run of `branch` becomes one node until
    one is left, the subroot; subroots, in the order of the group (null first), likewise lead to
    the root. `order` and `group` are of types that casts take to text and back. received: columns as they came back, by name; a row is checked by folding the
    received leaf with its proof.

    Returns `order` and `group` under their names, leaf, received_leaf, i, n (place and number in
    the group), g, n_groups (likewise of the group), subroot, root, proof (binary: the siblings of
    its path, 32 bytes each, bottom up and left to right), folded_root and verified. `fold` with
    the `places` of (i, n) and (g, n_groups) repeats the check from those alone. Nulls of any column
    are values of their own; repeated rows have leaves of their own; other columns are ignored. An
    empty table gives no rows.
    """
    block = branch**depth
    came = received or {}
    sealed, back = [F.col(c) for c in columns], [came.get(c, F.col(c)) for c in columns]
    differs = F.lit(False)
    for c, now in came.items():
        differs |= ~F.col(c).eqNullSafe(now)
    rows = docs.select(F.col(group).alias("grp"), F.col(order).alias("ord"), leaf_digest(sealed).alias("leaf"), F.when(differs, leaf_digest(back)).alias("claimed"))
    leaves = ranked(rows, ["ord", "leaf"], "grp")
    groups = stash(ranked(leaves.where("i = 0").select("grp", F.col("n").alias("size")), ["grp"]).select("grp", "size", F.col("i").alias("gid"), F.col("n").alias("n_groups")), "groups")
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("size")).first()
    mine = groups.select(F.col("grp").alias("_grp"), "gid", "n_groups")
    leaves = stash(leaves.join(small(mine, n_groups), F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp"), "leaves")

    levels = climbed(leaves.select("gid", "i", "n", F.col("leaf").alias("h")), most or 0, branch, depth)
    tops = levels[-1].select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("i"), F.lit(n_groups).cast("long").alias("n"), "h")
    heads = climbed(tops, n_groups, branch, depth)
    crown = heads[-1].select("gid", "i", "h", F.lit("").alias("outer"), F.col("h").alias("root"))
    subroots = descended(heads, crown, branch, depth).select(F.col("i").alias("gid"), F.lit(0).cast("long").alias("i"), "h", "outer", "root")
    subroots = stash(subroots, "subroots")
    outer = descended(levels[1:], subroots, branch, depth) if len(levels) > 1 else subroots
    outer = outer.select("gid", F.col("i").alias("block"), "outer", "root")

    schema = "grp string, ord string, leaf string, claimed string, i long, n long, gid long, n_groups long, root string, proof binary, folded_root string"

    def finish(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i").reset_index(drop=True)
        n, rest, start = int(rows["n"].iloc[0]), above["outer"].iloc[0], key[1] * block
        local = reduced(rows["leaf"].tolist(), n <= block, branch, depth)
        beyond = list(places(int(key[0]), int(rows["n_groups"].iloc[0]), branch))
        proofs, folded = [], []
        for j, (leaf, claimed) in enumerate(zip(rows["leaf"], rows["claimed"], strict=True)):
            path = siblings(local, j, branch) + rest
            proofs.append(bytes.fromhex(path))
            folded.append(fold(claimed or leaf, path, [*places(start + j, n, branch), *beyond]))
        return rows.assign(root=above["root"].iloc[0], proof=proofs, folded_root=folded)[["grp", "ord", "leaf", "claimed", "i", "n", "gid", "n_groups", "root", "proof", "folded_root"]]

    # as text, so that long integers beside nulls stay whole in pandas
    rows = leaves.withColumns({"grp": F.col("grp").cast("string"), "ord": F.col("ord").cast("string"), "block": F.floor(F.col("i") / block)})
    done = rows.groupBy("gid", "block").cogroup(outer.groupBy("gid", "block")).applyInPandas(finish, schema)
    named = subroots.select(F.col("gid").alias("_g"), F.col("h").alias("subroot"))
    done = done.join(small(named, n_groups), F.col("gid") == F.col("_g"))
    kinds = {f.name: f.dataType for f in docs.select(group, order).schema}
    return done.select(F.col("ord").cast(kinds[order]).alias(order), F.col("grp").cast(kinds[group]).alias(group), "leaf", F.coalesce("claimed", "leaf").alias("received_leaf"), "i", "n", F.col("gid").alias("g"), "n_groups", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
