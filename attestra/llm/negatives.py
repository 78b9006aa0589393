"""Hard-negative mining over an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own; a pair of codes is a cell. For an
anchor, a half's score is at most (anchor half . code) + |anchor half| * radius of the code, so the
sum of two such bounds holds for all vectors of a cell. A heap walks the two sorted lists of half
bounds and so visits cells by falling bound. The walk ends when the bound falls below what is
already found: then the window of results is certified, and they are those of a full scan.

Spark deals the work by (bucket, slice): buckets hold whole cells, or parts of a large one, and
slices hold anchors; both are bounded. Each phase probes a few cells, which gives a threshold, and
then visits just the cells whose bounds reach it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stash

#: Vectors that the codebooks are fitted on at most; every vector is indexed.
FIT_ROWS = 16_384
#: Vectors that a cell should hold; codes of a half at most.
CELL_ROWS, MOST_CODES = 256, 128
#: Vectors of a bucket, anchors of a slice, vectors compared at once, vectors that the first visit covers at least.
BUCKET_ROWS, SLICE_ROWS, CHUNK, PROBE = 8_192, 2_048, 1_024, 2_048
LOW, HIGH = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Index:
    """Codebooks and radii of the halves, vectors per cell, and the first bucket and number of buckets of each cell."""

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    bucket: np.ndarray
    buckets: np.ndarray


def packed(vectors: pd.Series, width: int) -> np.ndarray:
    """Packed vectors as a matrix of integers."""
    return np.frombuffer(b"".join(vectors), np.int64).reshape(len(vectors), width)


def fit_half(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k codes of points by k-means; the first distinct points are where it starts."""
    _, first = np.unique(points, axis=0, return_index=True)
    codes = points[np.sort(first)[:k]].astype(float)
    for _ in range(rounds):
        near = nearest(points, codes)[0]
        sums = np.zeros_like(codes)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(codes))
        codes = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], codes)
    return codes


def nearest(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each point, and how far it is."""
    x = points.astype(float)
    near = ((codes * codes).sum(1)[None] - 2 * (x @ codes.T)).argmin(1)
    return near, np.sqrt(((x - codes[near]) ** 2).sum(1))


def half_bounds(anchors: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """What each half can score at most with the vectors of each code; rounding is added to be safe."""
    half, out = anchors.shape[1] // 2, []
    for part, codes, radii in zip((anchors[:, :half], anchors[:, half:]), index.codes, index.radii, strict=True):
        x = part.astype(float)
        long = np.sqrt((x * x).sum(1))[:, None]
        reach = np.sqrt((codes * codes).sum(1))[None] + radii[None]
        out.append(x @ codes.T + long * radii[None] + 1e-9 * long * reach + 1e-6)
    return out[0], out[1]


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Multi-sequence walk: (bound, code, code) of all cells by falling sum of the half bounds."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))


def visits(first: np.ndarray, second: np.ndarray, index: Index, least: int | None, probe: int) -> list[tuple[int, int]]:
    """The cells that an anchor visits: without `least` the first ones, up to `probe` vectors; with it the later ones that can score so much."""
    found, seen = [], 0
    for bound, i, j in cells_by_bound(first, second):
        size = index.counts[i, j]
        if not size:
            continue
        if seen < probe:
            if least is None:
                found.append((i, j))
        elif least is None or bound < least:
            break
        else:
            found.append((i, j))
        seen += size
    return found


def best(rows: tuple[np.ndarray, ...], ids: np.ndarray, keep: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The first `keep` of (anchor, score, item) rows per anchor by score, then least id; and who has so many, with the last score."""
    who, score, item = rows
    order = np.lexsort((ids[item], -score, who))
    who, score, item = who[order], score[order], item[order]
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
    full = rank == keep - 1
    kept = rank < keep
    return (who[kept], score[kept], item[kept]), who[full], score[full]


def compare(items: pd.DataFrame, came: pd.DataFrame, width: int, same: bool, keep: int) -> list[tuple[int, int, int, int]]:
    """(anchor, window, score, item) of a bucket's vectors that lie in windows of a slice's anchors, at most `keep` a window.

    items: cell, label, q, ids. came: label, q, cells to visit, and lists lo and hi of windows. Positives
    (same) are of the anchor's label, negatives of another. Windows close from below as they fill.
    """
    x, a = packed(items["q"], width), packed(came["q"], width)
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0)) * width < 2**53
    xs, qs = (x.astype(float), a.astype(float)) if exact else (x, a)
    labels, mine = items["label"].to_numpy(), came["label"].to_numpy()
    ids = np.array([v[0] for v in items["ids"]], np.int64)
    most = max(map(len, came["lo"]))
    lo, hi = np.full((len(came), most), HIGH), np.full((len(came), most), LOW)
    for k, (a_lo, a_hi) in enumerate(zip(came["lo"], came["hi"], strict=True)):
        lo[k, : len(a_lo)], hi[k, : len(a_hi)] = a_lo, a_hi
    visitors: dict[int, list[int]] = {}
    for k, cells in enumerate(came["cells"]):
        for c in cells:
            visitors.setdefault(int(c), []).append(k)
    held: list = [None] * most
    by_cell = items.groupby("cell", sort=False).indices
    for cell, who in visitors.items():
        rows, who = by_cell.get(cell, ()), np.array(who)
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            scores = qs[who] @ xs[part].T
            fits = (mine[who][:, None] == labels[part][None]) == same
            for w in range(most):
                r, c = np.nonzero(fits & (scores >= lo[who, w][:, None]) & (scores <= hi[who, w][:, None]))
                if len(r):
                    new = (who[r], scores[r, c].astype(np.int64), part[c])
                    new = new if held[w] is None else tuple(np.r_[o, n] for o, n in zip(held[w], new, strict=True))
                    held[w], full, last = best(new, ids, keep)
                    lo[full, w] = last
    return [(int(i), w, int(s), int(t)) for w, rows in enumerate(held) if rows is not None for i, s, t in zip(*rows, strict=True)]


def _placed(items: DataFrame, width: int, n: int) -> tuple[DataFrame, Index]:
    """Items with their cell and bucket, and the index, whose codebooks are fitted on FIT_ROWS items at most, those with the least hashes."""
    sample = packed(items.orderBy(F.xxhash64("key")).limit(FIT_ROWS).select("q").toPandas()["q"], width)
    half, k = width // 2, int(min(MOST_CODES, max(1, round((n / CELL_ROWS) ** 0.5))))
    codes = (fit_half(sample[:, :half], k), fit_half(sample[:, half:], k))
    wide = len(codes[1])

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = packed(part["q"], width)
                (c1, d1), (c2, d2) = nearest(x[:, :half], codes[0]), nearest(x[:, half:], codes[1])
                yield part.assign(cell=(c1 * wide + c2).astype("int32"), d1=d1, d2=d2)

    placed = stash(items.mapInPandas(place, "key string, label int, q binary, ids array<long>, cell int, d1 double, d2 double"), "placed")
    radii, counts = (np.zeros(len(codes[0])), np.zeros(len(codes[1]))), np.zeros((len(codes[0]), wide), np.int64)
    for cell, size, d1, d2 in placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("d1"), F.max("d2")).collect():  # MOST_CODES squared at most
        i, j = divmod(cell, wide)
        counts[i, j], radii[0][i], radii[1][j] = size, max(radii[0][i], d1), max(radii[1][j], d2)
    buckets = np.maximum(1, -(-counts // BUCKET_ROWS))
    bucket, at, room = np.zeros_like(counts), -1, 0
    for i, j in np.ndindex(*counts.shape):  # small cells share a bucket
        if counts[i, j]:
            if counts[i, j] > room:
                at, room = at + 1, BUCKET_ROWS
            bucket[i, j] = at
            room -= counts[i, j]
            if buckets[i, j] > 1:
                at, room = at + int(buckets[i, j]) - 1, 0
    table = items.sparkSession.createDataFrame([(int(i * wide + j), int(bucket[i, j]), int(buckets[i, j])) for i, j in zip(*np.nonzero(counts), strict=True)], "cell int, first int, parts int")
    placed = placed.join(F.broadcast(table), "cell").withColumn("bucket", F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    return placed.select("key", "label", "q", "ids", "cell", "bucket"), Index(codes, radii, counts, bucket, buckets)


def _visited(anchors: DataFrame, items: DataFrame, index: Index, width: int, same: bool, keep: int, probe: int) -> DataFrame:
    """(key, w, score, id) found in the cells that the anchors visit; anchors: key, label, q, slice, lo, hi, and least, null for the first visit."""
    wide = index.counts.shape[1]

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            if len(part):
                first, second = half_bounds(packed(part["q"], width), index)
            for k, (key, label, q, slot, lo, hi, least) in enumerate(part.itertuples(index=False, name=None)):
                by: dict[int, list[int]] = {}
                for i, j in visits(first[k], second[k], index, None if least is None else int(least), probe):
                    for b in range(index.bucket[i, j], index.bucket[i, j] + index.buckets[i, j]):
                        by.setdefault(int(b), []).append(i * wide + j)
                rows += [(b, slot, key, label, q, lo, hi, cells) for b, cells in by.items()]
            yield pd.DataFrame(rows, columns=["bucket", "slot", "key", "label", "q", "lo", "hi", "cells"])

    came = anchors.select("key", "label", "q", "slot", "lo", "hi", F.col("least").cast("string")).mapInPandas(plan, "bucket int, slot long, key string, label int, q binary, lo array<long>, hi array<long>, cells array<int>")
    came = stash(came, "visits")
    pairs = came.select(F.col("bucket").alias("b"), F.col("slot").alias("s")).distinct()
    needed = items.join(small(pairs, pairs.count()), F.col("bucket") == F.col("b"))

    def meet(key: tuple, block: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
        found = compare(block, who, width, same, keep) if len(block) and len(who) else []
        keys, ids = who["key"].tolist(), block["ids"].tolist()
        return pd.DataFrame([(keys[i], w, s, list(ids[t])) for i, w, s, t in found], columns=["key", "w", "score", "ids"])

    met = needed.groupBy("b", "s").cogroup(came.groupBy("bucket", "slot")).applyInPandas(meet, "key string, w int, score long, ids array<long>")
    return stash(_first(met.select("key", "w", "score", F.explode("ids").alias("id")), keep), "found")


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The first rows of each anchor's window: by score, ties by the smaller id."""
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("key", "w").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= keep).drop("_r")


def _searched(anchors: DataFrame, items: DataFrame, index: Index, width: int, same: bool, keep: int, probe: int) -> DataFrame:
    """The first `keep` rows of every window: a first visit, then the cells that can still reach its last row."""
    near = _visited(anchors.withColumn("least", F.lit(None).cast("long")), items, index, width, same, keep, probe)
    last = near.groupBy("key", "w").agg(F.count(F.lit(1)).alias("rows"), F.min("score").alias("score")).where(F.col("rows") == keep)
    last = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))  # a few windows an anchor
    more = anchors.join(last, "key", "left").withColumn("lo", F.transform("lo", lambda v, w: F.greatest(v, F.coalesce(F.try_element_at("last", w), v)))).withColumn("least", F.array_min("lo")).drop("last")
    far = _visited(more, items, index, width, same, keep, probe)
    return stash(_first(near.union(far), keep), "searched")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, probe: int = PROBE) -> DataFrame:
    """Hard negatives of anchors: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: vec_id, label, embedding; anchor says which rows are anchors. Components become
    floor(scale * x); scores are integer inner products (they must fit a long). An anchor's positives
    are its first other rows of its label, by score, ties by the smaller vec_id; a positive's
    negatives the first rows of other labels that score at least low and at most high hundredths of
    its score. Results are those of a full scan.

    Rows with a null label, vector or component, or one that is not finite, take no part; a null
    vec_id is an identifier like others, after all of them. Shorter vectors count as filled up with
    zeros. Repeated rows are rows of their own; equal vectors of a label are searched once, and only
    their least identifiers can be results. Other columns are ignored; no anchors: no rows.
    """
    value = F.col("embedding")
    whole = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    held = rows.withColumn("_anchor", F.coalesce(anchor, F.lit(False))).where("label is not null and embedding is not null").where(whole)
    held = held.select(F.coalesce("vec_id", F.lit(HIGH)).alias("id"), F.col("label").cast("int").alias("label"), F.transform(value, lambda v: F.floor(v.cast("double") * scale)).alias("q"), "_anchor")
    spare = positives + 1
    width = max(2, held.agg(F.max(F.size("q"))).first()[0] or 0)
    filled = F.concat("q", F.array_repeat(F.lit(0).cast("long"), width - F.size("q")))
    held = held.withColumn("q", filled).withColumn("key", F.md5(F.concat_ws(",", "label", F.array_join(F.col("q").cast("array<string>"), ",")).cast("binary")))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(q=[np.asarray(v, np.int64).tobytes() for v in part["q"]])

    held = stash(held.select("id", "label", "q", "_anchor", "key").mapInPandas(pack, "id long, label int, q binary, _anchor boolean, key string"), "vectors")
    # of equal vectors no more rows than the longest list of results can hold
    least = held.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_r") <= max(spare, negatives))
    items = stash(least.groupBy("key").agg(F.first("label").alias("label"), F.first("q").alias("q"), F.array_sort(F.collect_list("id")).alias("ids")), "items")
    n = items.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    items, index = _placed(items, width, n)
    wide = index.counts.shape[1]

    asked = held.where("_anchor").select("key").distinct()
    asked = stash(items.join(asked, "key", "left_semi").select("key", "label", "q", F.expr(f"cast(cell div {wide} as int)").alias("code")), "anchors")
    sizes = asked.groupBy("code").count()  # MOST_CODES rows at most
    asked = asked.join(F.broadcast(sizes), "code")
    slot = F.col("code") * F.lit(2**32) + F.pmod(F.xxhash64("key"), F.ceil(F.col("count") / SLICE_ROWS))
    asked = asked.select("key", "label", "q", slot.alias("slot"))

    every = asked.withColumn("lo", F.array(F.lit(LOW))).withColumn("hi", F.array(F.lit(HIGH)))
    found = _searched(every, items, index, width, True, spare, probe)
    # integer division goes towards zero
    lo = F.expr(f"(score * {low}) div 100 + if((score * {low}) % 100 > 0, 1, 0)")
    hi = F.expr(f"(score * {high}) div 100 - if((score * {high}) % 100 < 0, 1, 0)")
    windows = found.select("key", "score").distinct().withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    windows = windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "lo", "hi"))).alias("ws"))  # one for each positive at most
    open_ = stash(asked.join(windows, "key").select("key", "label", "q", "slot", F.col("ws.lo").alias("lo"), F.col("ws.hi").alias("hi"), F.col("ws.score").alias("ps")), "windows")
    hard = _searched(open_, items, index, width, False, negatives, probe)
    hard = hard.groupBy("key", "w").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("hard"))
    hard = hard.join(open_.select("key", "ps"), "key").select("key", F.get("ps", F.col("w")).alias("score"), "hard")
    per = found.join(hard, ["key", "score"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "hard"))).alias("found"))
    per = stash(per, "results")

    def self_score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = packed(part["q"], width)
                yield pd.DataFrame({"id": part["id"], "key": part["key"], "own": -(x * x).sum(1)})

    out = held.where("_anchor").select("id", "key", "q").mapInPandas(self_score, "id long, key string, own long").join(per, "key")
    # an anchor's own row, once, is not its positive
    at = F.array_position(F.transform("found", lambda f: (f["less"] == F.col("own")) & (f["id"] == F.col("id"))), True)
    others = F.slice(F.filter("found", lambda f, i: i != at - 1), 1, positives)
    out = out.select("id", F.explode(others).alias("p")).select("id", "p", F.posexplode("p.hard").alias("at", "n"))
    named = lambda c: F.when(c != F.lit(HIGH), c)
    return out.select(named(F.col("id")).alias("anchor_id"), named(F.col("p.id")).alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), named(F.col("n.id")).alias("negative_id"), (-F.col("p.less")).alias("positive_score"), (-F.col("n.less")).alias("negative_score"))
