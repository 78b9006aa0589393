"""Truth by sweeps in row order: each row is renewed in place from what the rows before it have just become.

Rows of different components never meet, so components are packed into tasks that sweep on their
own; a component with more rows than a task may hold is swept block by block, in row order, with
the sums that lie outside of the block beside it. All components stop after the same sweep, the
first in which no row of any moves by more than epsilon, as in one pass over everything.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.text import subkind
from attestra.operators import graph as gr
from attestra.operators.claims import propagate_round
from attestra.operators.components import TASK_EDGES, bucket_of, buckets, ensure_checkpoints, packed, relabelled, split_off, stored, weak

#: Sweeps at most, the change below which they end, the share of the neighbours, the ceiling's share.
SWEEPS, EPSILON, BLEND, UNDERCUT = 50, 0.001, 0.4, 0.2
#: Rows of a component up to which the rows at one place of all such components are renewed at once.
LANES = 64
#: Relations that a task may hold in synchronous rounds, as numbers.
ROUND_ROWS = 2_000_000


def _value(x) -> float | None:
    return None if x is None or x != x else float(x)


def relation_sums(rows: list[list]) -> tuple[dict, dict]:
    """Sums (weight, weight * value, number) of the valued rows [subject, object, confidence, anchor, value] per node and per pair of nodes."""
    nodes, pairs = {}, {}
    for s, o, c, _, v in rows:
        for table, key in ((nodes, s), (nodes, o), (pairs, (min(s, o), max(s, o)))):
            table.setdefault(key, [0.0, 0.0, 0])
        if v is not None and c > 0:
            for t in [nodes[s]] if s == o else [nodes[s], nodes[o], pairs[min(s, o), max(s, o)]]:
                t[0], t[1], t[2] = t[0] + c, t[1] + c * v, t[2] + 1
    return nodes, pairs


def sweep_relations(rows: list[list], nodes: dict, pairs: dict, blend: float = BLEND) -> tuple[float, bool]:
    """Renew rows in place; returns the greatest move, and whether any value is another. A row that gets its first value does not move."""
    most, other = 0.0, False
    for row in rows:
        s, o, c, anchor, old = row
        at = [nodes[s]] if s == o else [nodes[s], nodes[o], pairs[min(s, o), max(s, o)]]
        w, wv, k = at[0] if s == o else [x + y - z for x, y, z in zip(*at, strict=True)]
        if old is not None and c > 0:
            w, wv, k = w - c, wv - c * old, k - 1
        mean = wv / w if k > 0 and w > 0 else None
        new = mean if anchor is None else anchor if mean is None else anchor * (1 - blend) + mean * blend
        if new is None:
            continue
        if old is not None:
            most = max(most, abs(new - old))
        for t in at if c > 0 else ():
            if old is None:
                t[0], t[1], t[2] = t[0] + c, t[1] + c * new, t[2] + 1
            else:
                t[1] += c * (new - old)
        row[4], other = new, other or new != old
    return most, other


def sweep_claims(rows: list[list], pulls: dict, needs: dict, values: dict, confidence: dict, blend: float = BLEND, undercut: float = UNDERCUT, together: bool = False) -> tuple[float, bool]:
    """Renew claims [id, anchor] in order; values holds theirs and those outside; returns the greatest move, a first value counting from 0, and whether any is another.

    With together all are renewed from what the values were before, and kept within 0 and 1.
    """
    most, other = 0.0, False
    seen = dict(values) if together else values
    for name, anchor in rows:
        w = wv = 0.0
        ceiling = None
        for source, kind in pulls.get(name, ()):
            v, c = seen.get(source), confidence.get(source, 0.0)
            if v is None:
                continue
            if kind == "undercuts":
                cap = 1 - undercut * v * c
                ceiling = cap if ceiling is None else min(ceiling, cap)
                continue
            weight = c / 2 if kind == "alternative" else c
            w, wv = w + weight, wv + weight * (v if kind == "supports" else 1 - v)
        new = anchor
        if w > 0:
            new = wv / w if anchor is None else anchor * (1 - blend) + wv / w * blend
        if new is None:
            continue
        for target in needs.get(name, ()):
            held = seen.get(target)
            new = new if held is None else min(new, held)
        new = new if ceiling is None else min(new, ceiling)
        new = max(0.0, min(1.0, new)) if together else new
        old = seen.get(name)
        most = max(most, abs(new - (old or 0.0)))
        values[name], other = new, other or new != old
    return most, other


def _turns(place: np.ndarray) -> list[np.ndarray]:
    """The rows at each place of their components."""
    order = np.argsort(place, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []


def _blended(anchor: np.ndarray, mean: np.ndarray, blend: float) -> np.ndarray:
    return np.where(np.isnan(anchor), mean, np.where(np.isnan(mean), anchor, anchor * (1 - blend) + mean * blend))


def relation_lanes(s: np.ndarray, o: np.ndarray, c: np.ndarray, anchor: np.ndarray, place: np.ndarray, blend: float = BLEND) -> tuple[Callable, np.ndarray]:
    """(sweep, values) as sweep_relations, side by side: rows at one place share no node, as they are of different components."""
    ends = pd.factorize(np.stack([s, o], 1).ravel())[0].reshape(-1, 2)
    lo, hi, nodes = ends.min(1), ends.max(1), int(ends.max(initial=-1)) + 1
    pair, found = pd.factorize(lo * nodes + hi)
    none = nodes + len(found)  # the other end of a loop, whose sums stay 0
    at = np.stack([ends[:, 0], np.where(lo == hi, none, ends[:, 1]), np.where(lo == hi, none, nodes + pair)])
    value = anchor.copy()
    held = ~np.isnan(value) & (c > 0)
    sums = np.stack([np.bincount(at.T[held].ravel(), np.repeat(x[held], 3), none + 1) for x in (c, c * value, np.ones(len(c)))])
    sums[:, none] = 0
    turns = _turns(place)

    def sweep() -> tuple[float, bool]:
        most, other = 0.0, False
        for r in turns:
            a, old, sure = at[:, r], value[r], c[r]
            w, wv, k = sums[:, a[0]] + sums[:, a[1]] - sums[:, a[2]]
            was = ~np.isnan(old)
            own = was & (sure > 0)
            w, wv, k = np.where(own, w - sure, w), np.where(own, wv - sure * old, wv), k - own
            some = (k > 0) & (w > 0)
            new = _blended(anchor[r], np.where(some, wv / np.where(some, w, 1), np.nan), blend)
            good = ~np.isnan(new)
            most = max(most, np.abs(new - old)[good & was].max(initial=0.0))
            other = other or bool((good & (new != old)).any())
            told = good & (sure > 0)
            first = told & ~was
            more = np.where(was, sure * (new - old), sure * new)[told]
            for x in a:
                sums[1, x[told]] += more
                sums[0, x[first]] += sure[first]
                sums[2, x[first]] += 1
            sums[:, none] = 0
            value[r] = np.where(good, new, old)
        return float(most), other

    return sweep, value


def claim_lanes(source: np.ndarray, target: np.ndarray, how: np.ndarray, confidence: np.ndarray, anchor: np.ndarray, place: np.ndarray, blend: float = BLEND, undercut: float = UNDERCUT, together: bool = False) -> tuple[Callable, np.ndarray]:
    """(sweep, values) as sweep_claims, side by side; links are between numbers of rows. With together all rows are at one place."""
    value, turns = anchor.copy(), _turns(place)
    number, local = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    for k, r in enumerate(turns):
        number[r], local[r] = k, np.arange(len(r))

    def dealt(to: np.ndarray, of: np.ndarray, *more: np.ndarray) -> list[tuple]:
        """Per turn the links to its rows."""
        order = np.argsort(number[to], kind="stable")
        cuts = np.searchsorted(number[to][order], np.arange(1, len(turns)))
        return list(zip(*[np.split(x[order], cuts) for x in (local[to], of, *more)], strict=True))

    needs, caps = how == "presupposes", how == "undercuts"
    pulls = ~needs & ~caps
    steps = list(zip(
        turns,
        dealt(target[pulls], source[pulls], np.where(how[pulls] == "alternative", 0.5, 1.0), how[pulls] == "supports"),
        dealt(target[caps], source[caps]),
        dealt(source[needs], target[needs]),
        strict=True,
    ))

    def sweep() -> tuple[float, bool]:
        most, other = 0.0, False
        for r, (to, of, share, supports), (under, by), (need, held) in steps:
            v = value[of]
            known = ~np.isnan(v)
            weight = np.where(known, confidence[of] * share, 0.0)
            w = np.bincount(to, weight, len(r))
            wv = np.bincount(to, np.where(known, weight * np.where(supports, v, 1 - v), 0.0), len(r))
            new = _blended(anchor[r], np.where(w > 0, wv / np.where(w > 0, w, 1), np.nan), blend)
            cap = np.full(len(r), np.inf)
            np.fmin.at(cap, need, value[held])
            np.fmin.at(cap, under, 1 - undercut * value[by] * confidence[by])
            new = np.minimum(new, cap)
            new = np.clip(new, 0.0, 1.0) if together else new
            good, old = ~np.isnan(new), value[r]
            most = max(most, np.abs(new - np.where(np.isnan(old), 0.0, old))[good].max(initial=0.0))
            other = other or bool((good & (new != old)).any())
            value[r] = np.where(good, new, old)
        return float(most), other

    return sweep, value


def _small(component: pd.Series) -> np.ndarray:
    """Whether a row's component has at most LANES rows."""
    code = pd.factorize(component)[0]
    return np.bincount(code)[code] <= LANES if len(code) else np.zeros(0, bool)


def _doubles(x: pd.Series) -> np.ndarray:
    return x.to_numpy(np.float64, na_value=np.nan)


def _runs(bucket: pd.DataFrame, start: Callable, sweeps: int, epsilon: float, fixed: int | None, each: bool) -> tuple[list[float], np.ndarray]:
    """(greatest moves per sweep that changed a value, the rows' values): the components of a bucket together, or, where each stops by itself, one by one.

    start(rows, lanes) gives functions that make a sweep and that tell the values.
    """
    moves, out, last = [0.0] * sweeps, np.full(len(bucket), np.nan), 0
    groups = bucket.groupby("component", sort=False).indices.values() if each else [np.arange(len(bucket))]
    for at in groups:
        sweep, values = start(bucket.iloc[at], not each)
        for k in range(sweeps if fixed is None else fixed):
            moved, other = sweep()
            moves[k] = max(moves[k], moved)
            last = max(last, k + 1 if other else 0)
            if not other or each and moved <= epsilon:  # later sweeps change nothing
                break
        out[at] = values()
    return moves[:last], out


def _started(n: int, parts: list[tuple[np.ndarray, Callable, Callable]]) -> tuple[Callable, Callable]:
    """The sweep and the values of n rows in parts (rows, sweep, values) that never meet."""

    def sweep() -> tuple[float, bool]:
        found = [go() for _, go, _ in parts]
        return max((m for m, _ in found), default=0.0), any(other for _, other in found)

    def values() -> np.ndarray:
        out = np.full(n, np.nan)
        for at, _, told in parts:
            out[at] = told()
        return out

    return sweep, values


def _with_moves(rows: pd.DataFrame, moves: list[float]) -> pd.DataFrame:
    """rows, and a row (sweep, move) for each sweep."""
    return pd.concat([rows, pd.DataFrame({"sweep": np.arange(len(moves)), "move": moves})]).astype({"sweep": "Int32"}) if moves else rows.assign(sweep=pd.array([None] * len(rows), "Int32"), move=np.nan)


def _settled(run: Callable[[int | None], DataFrame], later: Callable[[], float] | None, sweeps: int, epsilon: float, each: bool, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows.checkpoint()) -> tuple[DataFrame, int, float]:
    """(values of the small components, sweeps taken, last move); later makes one sweep of the large ones, keep holds what the tasks give.

    run(None) sweeps until nothing changes. Only if some component still changed after the last sweep
    that all take, the sweeps are made again, as many as that.
    """
    free = keep(run(None))
    moves = free.where("sweep is not null").groupBy("sweep").agg(F.max("move").alias("move")).collect()  # a row for each sweep
    most = [0.0] * sweeps
    for r in moves:
        most[r["sweep"]] = r["move"]
    taken, last = 0, float("inf")
    while taken < sweeps and last > epsilon:
        last = max(most[taken], later() if later else 0.0)
        taken += 1
    done = free if each or taken >= max((r["sweep"] + 1 for r in moves), default=0) else run(taken)
    return done.where("sweep is null"), taken, last


def relation_sweeps(edges: DataFrame, row: str = "row", sweeps: int = SWEEPS, epsilon: float = EPSILON, blend: float = BLEND, most: int = TASK_EDGES, each: bool = False, labels: DataFrame | None = None) -> tuple[DataFrame, int, float]:
    """H4 in row order: (relations with value, sweeps taken, last move).

    edges: rel_id, subject_id, object_id, confidence, anchor, and `row`, whose order is that of the
    sweep (ties by rel_id). A row's value is the mean of its neighbours' (those that share an end),
    by confidence, blended with its anchor. What no anchor reaches stays null. With `each` every
    component stops by itself, and what the others hold doesn't matter. labels: (node, component),
    if they are known. Null ends stand for themselves; a null confidence is 0. No rows: no rows.
    """
    ensure_checkpoints(edges.sparkSession)
    core = list(dict.fromkeys(["rel_id", "subject_id", "object_id", "confidence", "anchor", row]))
    alone = F.concat(F.lit("\0"), F.coalesce("rel_id", F.lit("")))
    kept = edges.select(*core, F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("_c"), F.col("anchor").cast("double").alias("_a")).checkpoint()
    ends = {"_s": F.coalesce("subject_id", alone), "_o": F.coalesce("object_id", alone)}
    part = (weak(kept.withColumns(ends), "_s", "_o") if labels is None else labels).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    kept = kept.withColumn("_s", ends["_s"]).join(part.withColumnRenamed("_c", "_k"), F.col("_s") == F.col("_n"), "left").withColumn("component", F.coalesce("_k", "_s")).drop("_n", "_k", "_s").checkpoint()
    small, large = packed(kept, "component", most)
    place = F.row_number().over(Window.partitionBy("bucket", "component").orderBy(row, "rel_id"))  # within the rows that a task takes anyway
    small = small.repartition("bucket").withColumn("place", place)

    def start(rows: pd.DataFrame, lanes: bool) -> tuple[Callable, Callable]:
        own = "\0" + rows["rel_id"].fillna("")
        s, o = (rows[c].where(rows[c].notna(), own).to_numpy() for c in ("subject_id", "object_id"))
        c, anchor, place = _doubles(rows["_c"]), _doubles(rows["_a"]), rows["place"].to_numpy()
        fit = _small(rows["component"]) if lanes else np.zeros(len(rows), bool)
        at, parts = np.flatnonzero(fit), []
        if len(at):
            sweep, value = relation_lanes(s[at], o[at], c[at], anchor[at], place[at], blend)
            parts.append((at, sweep, lambda: value))
        if len(at) < len(rows):
            rest = np.flatnonzero(~fit)
            rest = rest[np.argsort(place[rest], kind="stable")]
            held = [[x, y, z, _value(a), _value(a)] for x, y, z, a in zip(s[rest], o[rest], c[rest].tolist(), anchor[rest].tolist(), strict=True)]
            sums = relation_sums(held)
            parts.append((rest, lambda: sweep_relations(held, *sums, blend), lambda: np.array([r[4] for r in held], float)))
        return _started(len(rows), parts)

    def run(fixed: int | None) -> DataFrame:
        def go(bucket: pd.DataFrame) -> pd.DataFrame:
            moves, out = _runs(bucket, start, sweeps, epsilon, fixed, each)
            return _with_moves(bucket[core].assign(value=out), moves)[[*core, "value", "sweep", "move"]]

        types = ", ".join(f"`{c}` {small.schema[c].dataType.simpleString()}" for c in core)
        return small.groupBy("bucket").applyInPandas(go, f"{types}, value double, sweep int, move double")

    blocks = None
    if large.limit(1).count():
        rows = numbered_rows(large.withColumns({**ends, "order": F.struct(row, "rel_id")}))
        blocks = _RelationBlocks(rows.select("rel_id", F.col("_s").alias("s"), F.col("_o").alias("o"), F.col("_c").alias("c"), F.col("_a").alias("anchor"), "row"), most, blend)
    values, taken, last = _settled(run, blocks.sweep if blocks else None, sweeps, epsilon, each)
    values = values.select(*core, "value")
    values = values.union(large.select(core).join(blocks.state.select("rel_id", "value"), "rel_id", "left").select(*core, "value")) if blocks else values
    more = [c for c in edges.columns if c not in core]
    return (edges.join(values.select("rel_id", "value"), "rel_id", "left") if more else values.select(*edges.columns, "value")), taken, last


def round_of_relations(s: np.ndarray, o: np.ndarray, c: np.ndarray, anchor: np.ndarray, blend: float = BLEND) -> tuple[Callable, Callable]:
    """(sweep, values) of synchronous rounds over all rows, as graph.propagate_round makes them; ends below 0 are null.

    Rows with a null end are heard in the first round and gone from then on. A move is measured from 0 where there was no value.
    """
    whole = (s >= 0) & (o >= 0)
    lo, hi, loop = np.minimum(s, o), np.maximum(s, o), s == o
    nodes = int(hi.max(initial=-1)) + 1
    pair = np.unique(lo[whole] * nodes + hi[whole], return_inverse=True)[1]
    sure, unknown = np.nan_to_num(c), np.isnan(c)
    state = {"value": anchor.copy(), "first": True}

    def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a row's neighbours hold: both ends' sums, less the pair's and its own; and the rows' own."""
        heard = whole | state["first"]
        left, right = heard & (s >= 0), heard & (o >= 0) & ~loop
        end = np.bincount(s[left], x[left], nodes) + np.bincount(o[right], x[right], nodes)
        both = np.bincount(pair, x[whole])[pair] if len(pair) else np.zeros(0)
        return end[lo[whole]] + np.where(loop[whole], 0.0, end[hi[whole]] - both) - x[whole]

    def sweep() -> tuple[float, bool]:
        old = state["value"]
        held = ~np.isnan(old)
        w = np.where(held, sure, 0.0)
        nw, nwv, many = sums(w), sums(w * np.where(held, old, 0.0)), sums((w > 0).astype(float))
        some = (many > 0.5) & (nw != 0) & ~(unknown & held)[whole]
        new = np.full(len(s), np.nan)
        new[whole] = _blended(anchor[whole], np.where(some, nwv / np.where(some, nw, 1.0), np.nan), blend)
        state["value"], state["first"] = new, False
        good = ~np.isnan(new)
        move = np.abs(new - np.where(held, old, 0.0))[good].max(initial=0.0)
        return float(move), not np.array_equal(new, old, equal_nan=True)

    return sweep, lambda: state["value"]


def _ranked(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The columns' values as numbers of one dictionary, null as -1."""
    coded = pa.concat_arrays([pa.array(c.combine_chunks()) for c in columns]).dictionary_encode()
    return np.split(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(columns))


def relation_rounds(edges: DataFrame, rounds: int = SWEEPS, epsilon: float = EPSILON, blend: float = BLEND, most: int = ROUND_ROWS) -> tuple[DataFrame, int, float]:
    """H4, synchronous rounds: (rel_id, subject_id, object_id, confidence, anchor, value), rounds taken, last move.

    Components are packed into tasks, which make all rounds in place, so that relations are dealt once and not in every round;
    those of more than `most` relations make rounds over all tasks. All stop after the same round.
    """
    names = ["rel_id", "subject_id", "object_id", "confidence", "anchor"]
    kept = stored(edges.select(*names[:3], *[F.col(c).cast("double").alias(c) for c in names[3:]]))
    end = F.coalesce("subject_id", "object_id")
    of = kept.groupBy(end.alias("_end")).agg(F.count(F.lit(1)).alias("_n")).where("_end is not null")
    part = weak(kept, "subject_id", "object_id").select(F.col("node").alias("_end"), "component")
    of = stored(of.join(part, "_end", "left").withColumn("component", F.coalesce("component", "_end")))
    sized = of.groupBy("component").agg(F.sum("_n").alias("_rows"))
    large = stored(sized.where(F.col("_rows") > most).select("component"))
    total = of.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, -(-total // most), min(-(-total // 20_000), 16 * int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    few, rest = split_off(of, "component", large if large.limit(1).count() else None)
    small = kept.withColumn("_end", end).join(few.select("_end", bucket_of("component", parts).alias("bucket")), "_end").drop("_end")

    def run(fixed: int | None) -> DataFrame:
        def go(t: pa.Table) -> pa.Table:
            s, o = _ranked(t["subject_id"], t["object_id"])
            sweep, values = round_of_relations(s, o, *(t[x].fill_null(np.nan).to_numpy() for x in names[3:]), blend)
            moves, last = [], 0
            for k in range(rounds if fixed is None else fixed):
                move, other = sweep()
                moves.append(move)
                last = k + 1 if other else last
                if not other:  # later rounds change nothing
                    break
            value = values()
            held = (s >= 0) & (o >= 0)
            none = lambda n, kind: pa.nulls(n, kind)
            out = t.select(names).append_column("value", pa.array(value, mask=np.isnan(value))).filter(pa.array(held))
            out = out.append_column("sweep", none(len(out), pa.int32())).append_column("move", none(len(out), pa.float64()))
            told = pa.table([*(none(last, out.schema.field(x).type) for x in [*names, "value"]), pa.array(range(last), pa.int32()), pa.array(moves[:last], pa.float64())], schema=out.schema)
            return pa.concat_tables([out, told])

        types = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in names)
        return small.groupBy("bucket").applyInArrow(go, f"{types}, value double, sweep int, move double")

    wide = _RelationRounds(kept.withColumn("_end", end).join(rest.select("_end"), "_end").drop("_end"), blend) if rest.limit(1).count() else None
    values, taken, last = _settled(run, wide.sweep if wide else None, rounds, epsilon, False, stored)
    values = values.select(*names, "value")
    return values.union(wide.values().select(*names, "value")) if wide else values, taken, last


class _RelationRounds:
    """Rounds over all tasks of components that are too large for one, over numbers of rows and nodes."""

    def __init__(self, rows: DataFrame, blend: float):
        self.rows, self.blend = stored(rows.withColumn("_row", F.monotonically_increasing_id())), blend
        nodes = stored(self.rows.select(F.explode(F.array("subject_id", "object_id")).alias("_node")).distinct().withColumn("_id", F.monotonically_increasing_id()))
        side = lambda c: nodes.select(F.col("_node").alias(c), F.col("_id").alias(f"_{c}"))
        start = self.rows.join(side("subject_id"), "subject_id", "left").join(side("object_id"), "object_id", "left")
        self.state = stored(start.select(F.col("_row").alias("rel_id"), F.col("_subject_id").alias("subject_id"), F.col("_object_id").alias("object_id"), "confidence", "anchor", F.col("anchor").alias("value")))

    def sweep(self) -> float:
        self.state = stored(gr.propagate_round(self.state, self.blend, was="was"))
        return self.state.agg(F.max(F.abs(F.col("value") - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0

    def values(self) -> DataFrame:
        return self.rows.join(self.state.select(F.col("rel_id").alias("_row"), "value"), "_row").drop("_row")


def numbered_rows(rows: DataFrame) -> DataFrame:
    """rows with a row number in the order of `order`: ranges are sorted and counted, no task sees all rows."""
    dealt = rows.repartitionByRange("order").sortWithinPartitions("order").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    counts = counts.select(F.col("_part").alias("_p"), "_first", before.alias("_before"))
    return dealt.join(F.broadcast(counts), F.col("_part") == F.col("_p")).withColumn("row", F.col("_before") + F.col("_at") - F.col("_first")).drop("order", "_part", "_p", "_at", "_first", "_before")


class _RelationBlocks:
    """Large components, swept in blocks of rows: a block meets the sums of its nodes and pairs, and changes them."""

    def __init__(self, rows: DataFrame, most: int, blend: float):
        self.state = rows.select("rel_id", "s", "o", "c", "anchor", F.col("anchor").alias("value"), F.floor(F.col("row") / most).alias("block"), "row").checkpoint()
        self.blocks = [r[0] for r in self.state.select("block").distinct().orderBy("block").collect()]  # one for each `most` rows
        self.blend = blend

    def _sums(self, block: int) -> DataFrame:
        """(node, other, w, wv, k) of the nodes and pairs of a block, from the rows outside of it."""
        here, there = self.state.where(F.col("block") == block), self.state.where((F.col("block") != block) & F.col("value").isNotNull() & (F.col("c") > 0))
        weighed = there.select("s", "o", F.col("c").alias("w"), (F.col("c") * F.col("value")).alias("wv"))
        total = [F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.count(F.lit(1)).alias("k")]
        node = weighed.select(F.explode(F.array_distinct(F.array("s", "o"))).alias("node"), "w", "wv").groupBy("node").agg(*total)
        pair = weighed.where("s <> o").groupBy(F.least("s", "o").alias("node"), F.greatest("s", "o").alias("other")).agg(*total)
        nodes = here.select(F.explode(F.array("s", "o")).alias("node")).distinct()
        pairs = here.select(F.least("s", "o").alias("node"), F.greatest("s", "o").alias("other")).distinct()
        return node.join(nodes, "node", "left_semi").select("node", F.lit(None).cast("string").alias("other"), "w", "wv", "k").union(pair.join(pairs, ["node", "other"], "left_semi").select("node", "other", "w", "wv", "k"))

    def sweep(self) -> float:
        blend, greatest = self.blend, 0.0

        def go(rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("row")
            held = [[s, o, c, _value(a), _value(v)] for s, o, c, a, v in zip(rows["s"], rows["o"], rows["c"], rows["anchor"], rows["value"], strict=True)]
            nodes, pairs = relation_sums(held)
            for node, other, w, wv, k in zip(sums["node"], sums["other"], sums["w"], sums["wv"], sums["k"], strict=True):
                t = nodes[node] if other is None else pairs[node, other]
                t[0], t[1], t[2] = t[0] + w, t[1] + wv, t[2] + int(k)
            moved, _ = sweep_relations(held, nodes, pairs, blend)
            return rows.assign(value=[r[4] for r in held], moved=moved)[["rel_id", "value", "moved"]]

        for block in self.blocks:
            here = self.state.where(F.col("block") == block).withColumn("one", F.lit(1))
            new = here.groupBy("one").cogroup(self._sums(block).withColumn("one", F.lit(1)).groupBy("one")).applyInPandas(go, "rel_id string, value double, moved double").checkpoint()
            greatest = max(greatest, new.agg(F.max("moved")).first()[0] or 0.0)
            self.state = self.state.join(new.select("rel_id", F.col("value").alias("_v"), F.lit(True).alias("_here")), "rel_id", "left").withColumn("value", F.when(F.col("_here"), F.col("_v")).otherwise(F.col("value"))).drop("_v", "_here").checkpoint()
        return greatest


def claim_sweeps(claims: DataFrame, deps: DataFrame, pins: DataFrame | None = None, row: str = "claim_id", sweeps: int = SWEEPS, epsilon: float = EPSILON, blend: float = BLEND, undercut: float = UNDERCUT, most: int = TASK_EDGES, each: bool = False, together: bool = False) -> tuple[DataFrame, int, float]:
    """I7 in row order: ((claim_id, confidence, truth, anchor, value), sweeps taken, last move); values are cut to 0 to 1 at the end.

    claims: claim_id, confidence, truth, and `row`, the order of the sweep (ties by claim_id). deps:
    source, target, kind, rationale. pins (claim_id, truth) stand in for the direct truth.
    Dependencies on claims that are not there, or that have no value, don't count. The components are
    those of the dependencies, mostly far smaller than documents. With together a sweep is a synchronous round: claims
    are renewed from what the round before left, whatever their order, and values are cut to 0 to 1 in each.
    """
    ensure_checkpoints(claims.sparkSession)
    kept = claims.select("claim_id", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.col("truth").cast("double").alias("truth"), *([] if together else [F.struct(*dict.fromkeys([row, "claim_id"])).alias("order")]))
    kept = kept.withColumn("anchor", F.col("truth"))
    if pins is not None:
        kept = kept.join(pins.select("claim_id", F.col("truth").cast("double").alias("_p")), "claim_id", "left").withColumn("anchor", F.coalesce("_p", "anchor")).drop("_p")
    kind = F.when(F.col("kind") == "contradicts", F.coalesce(subkind(F.col("rationale")), F.lit("logical"))).otherwise(F.col("kind"))
    links = deps.select("source", "target", kind.alias("how")).where("kind in ('supports', 'contradicts', 'presupposes')" if together else "how <> 'elaborates'").checkpoint()
    part = weak(links, "source", "target").select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    kept = kept.join(part, F.col("claim_id") == F.col("_n"), "left").withColumn("component", F.coalesce("_c", "claim_id", F.lit(""))).drop("_n", "_c").checkpoint()
    n, huge = buckets(kept, "component", most)
    small, large = split_off(kept, "component", huge)
    place = F.lit(0) if together else F.row_number().over(Window.partitionBy("bucket", "component").orderBy("order"))  # within the rows that a task takes anyway
    small = small.withColumn("bucket", bucket_of("component", n)).repartition("bucket").withColumn("place", place).drop("order")
    # both ends of a link are in one component
    end = F.when(F.col("how") == "presupposes", F.col("source")).otherwise(F.col("target"))
    near = links.withColumn("_e", end).join(part, F.col("_e") == F.col("_n"), "left").withColumn("component", F.coalesce("_c", "_e")).select("source", "target", "how", "component")
    near = split_off(near, "component", huge)[0].withColumn("bucket", bucket_of("component", n)).select("bucket", "source", "target", "how")

    def tables(came: pd.DataFrame) -> tuple[dict, dict]:
        pulls, needs = {}, {}
        for source, target, how in zip(came["source"], came["target"], came["how"], strict=True):
            if how == "presupposes":
                needs.setdefault(source, []).append(target)
            else:
                pulls.setdefault(target, []).append((source, how))
        return pulls, needs

    def run(fixed: int | None) -> DataFrame:
        def go(bucket: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
            def start(rows: pd.DataFrame, lanes: bool) -> tuple[Callable, Callable]:
                index, parts = pd.Index(rows["claim_id"]), []
                sure, anchor, place = _doubles(rows["confidence"]), _doubles(rows["anchor"]), rows["place"].to_numpy()
                named = rows["claim_id"].notna().to_numpy()
                fit = named & (_small(rows["component"]) | together) if lanes and index.is_unique else np.zeros(len(rows), bool)
                at = np.flatnonzero(fit)
                if len(at):
                    number = np.append(np.where(fit, np.cumsum(fit) - 1, -1), -1)
                    source, target = (number[index.get_indexer(came[c])] for c in ("source", "target"))
                    both = (source >= 0) & (target >= 0)
                    sweep, value = claim_lanes(source[both], target[both], came["how"].to_numpy()[both], sure[at], anchor[at], place[at], blend, undercut, together)
                    parts.append((at, sweep, lambda: value))
                if (~fit & named).any():
                    rest = np.flatnonzero(~fit & named)
                    rest = rest[np.argsort(place[rest], kind="stable")]
                    held = [(i, _value(a)) for i, a in zip(rows["claim_id"].iloc[rest], anchor[rest].tolist(), strict=True)]
                    now, confidence = {i: a for i, a in held if a is not None}, dict(zip([i for i, _ in held], sure[rest].tolist(), strict=True))
                    pulls, needs = tables(came)
                    parts.append((rest, lambda: sweep_claims(held, pulls, needs, now, confidence, blend, undercut, together), lambda: np.array([now.get(i) for i, _ in held], float)))
                return _started(len(rows), parts)

            moves, out = _runs(bucket, start, sweeps, epsilon, fixed, each)
            return _with_moves(bucket[columns].assign(value=out), moves)

        return small.groupBy("bucket").cogroup(near.groupBy("bucket")).applyInPandas(go, "claim_id string, confidence double, truth double, anchor double, value double, sweep int, move double")

    columns = ["claim_id", "confidence", "truth", "anchor"]
    blocks = None
    if large.limit(1).count():
        blocks = _ClaimRounds(large, links, blend, undercut) if together else _ClaimBlocks(numbered_rows(large), links, tables, most, blend, undercut)
    values, taken, last = _settled(run, blocks.sweep if blocks else None, sweeps, epsilon, each)
    values = values.select(*columns, "value")
    values = values.union(large.select(columns).join(blocks.state.select("claim_id", "value"), "claim_id", "left").select(*columns, "value")) if blocks else values
    cut = F.greatest(F.least("value", F.lit(1.0)), F.lit(0.0))
    return values.withColumn("value", F.when(F.col("value").isNotNull(), cut)), taken, last


class _ClaimBlocks:
    """Large components of claims, swept in blocks of rows beside the claims outside that theirs depend on."""

    def __init__(self, rows: DataFrame, links: DataFrame, tables: Callable, most: int, blend: float, undercut: float):
        self.state = rows.select("claim_id", "confidence", "anchor", F.col("anchor").alias("value"), F.floor(F.col("row") / most).alias("block"), "row").checkpoint()
        self.blocks = [r[0] for r in self.state.select("block").distinct().orderBy("block").collect()]  # one for each `most` rows
        self.links, self.tables, self.blend, self.undercut = links, tables, blend, undercut

    def sweep(self) -> float:
        tables, blend, undercut, greatest = self.tables, self.blend, self.undercut, 0.0

        def go(rows: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("row")
            pulls, needs = tables(came)
            held = [(i, _value(a)) for i, a in zip(rows["claim_id"], rows["anchor"], strict=True)]
            now, confidence = {}, {}
            for ids, values, sure in ((came["outer"], came["outer_value"], came["outer_confidence"]), (rows["claim_id"], rows["value"], rows["confidence"])):
                for i, v, c in zip(ids, values, sure, strict=True):
                    if i is not None:
                        confidence[i] = c
                        if _value(v) is not None:
                            now[i] = float(v)
            moved, _ = sweep_claims(held, pulls, needs, now, confidence, blend, undercut)
            return pd.DataFrame({"claim_id": rows["claim_id"], "value": [now.get(i) for i in rows["claim_id"]], "moved": moved})

        for block in self.blocks:
            here = self.state.where(F.col("block") == block)
            mine = here.select(F.col("claim_id").alias("_m"))
            pulled = self.links.where("how <> 'presupposes'").join(mine, F.col("target") == F.col("_m"), "left_semi").withColumn("outer", F.col("source"))
            needed = self.links.where("how = 'presupposes'").join(mine, F.col("source") == F.col("_m"), "left_semi").withColumn("outer", F.col("target"))
            about = self.state.select(F.col("claim_id").alias("outer"), F.col("value").alias("outer_value"), F.col("confidence").alias("outer_confidence"))
            came = pulled.union(needed).join(about, "outer", "left").withColumn("one", F.lit(1))
            new = here.withColumn("one", F.lit(1)).groupBy("one").cogroup(came.groupBy("one")).applyInPandas(go, "claim_id string, value double, moved double").checkpoint()
            greatest = max(greatest, new.agg(F.max("moved")).first()[0] or 0.0)
            self.state = self.state.join(new.select("claim_id", F.col("value").alias("_v"), F.lit(True).alias("_here")), "claim_id", "left").withColumn("value", F.when(F.col("_here"), F.col("_v")).otherwise(F.col("value"))).drop("_v", "_here").checkpoint()
        return greatest


class _ClaimRounds:
    """Large components of claims in synchronous rounds, spread over all tasks."""

    def __init__(self, rows: DataFrame, links: DataFrame, blend: float, undercut: float):
        self.state = rows.select("claim_id", "confidence", "anchor", F.col("anchor").alias("value")).checkpoint()
        typed = F.col("how").isin("supports", "presupposes")
        deps = links.select("source", "target", F.when(typed, F.col("how")).otherwise("contradicts").alias("kind"), F.when(~typed, F.concat(F.lit("["), "how", F.lit("]"))).alias("rationale"))
        self.deps = deps.join(self.state.select(F.col("claim_id").alias("target")), "target", "left_semi").checkpoint()
        self.blend, self.undercut = blend, undercut

    def sweep(self) -> float:
        after = propagate_round(self.state, self.deps, self.blend, self.undercut).checkpoint()
        old = self.state.select(F.col("claim_id").alias("_k"), F.col("value").alias("_v"))
        moved = after.where("value is not null").join(old, F.col("claim_id") == F.col("_k")).agg(F.max(F.abs(F.col("value") - F.coalesce("_v", F.lit(0.0)))))
        self.state = after
        return moved.first()[0] or 0.0


class RelationTruth:
    """H5: relations with their truth in tables dealt by component, of which a change reads and writes only what it touches.

    The folder (one that all executors share) holds, per generation, labels (node, component) and the
    relations (rel_id, subject_id, object_id, confidence, anchor, row, value) of the parts that were written
    in it; `held` says in which generation each of the `parts` is. A change makes a new generation, so one that
    breaks off leaves the last as it was. Components stop by themselves, so that a change gives what a full run gives.
    """

    COLUMNS = ("rel_id", "subject_id", "object_id", "confidence", "anchor", "row")
    SCHEMA = "rel_id string, subject_id string, object_id string, confidence double, anchor double, row long, value double, component string"

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, **sweeps):
        self.spark, self.path, self.parts, self.sweeps = spark, path.rstrip("/"), parts, sweeps
        self.generation, self.held = 0, {}

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("component"), F.lit(self.parts)).cast("int")

    def _parts_of(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._part().alias("p")).distinct().collect())  # `parts` at most

    def labels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/labels-{self.generation}")

    def relations(self, components: DataFrame | None = None) -> DataFrame:
        """All relations with truth and component, or those of the given components, for which no other part is read."""
        wanted = self.held if components is None else self._parts_of(components)
        paths = [f"{self.path}/relations-{self.held[p]}/part={p}" for p in wanted if p in self.held]
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        return rows if components is None else rows.join(components.select("component").distinct(), "component", "left_semi").select(rows.columns)

    def _write(self, rows: DataFrame, labels: DataFrame, generation: int, parts: list[int]) -> None:
        """Write a generation: its labels, and the relations of the parts given, of which those without relations go."""
        labels.write.mode("overwrite").parquet(f"{self.path}/labels-{generation}")
        dealt = rows.withColumn("part", self._part())
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/relations-{generation}")
        full = self._parts_of(rows)
        self.held = {p: g for p, g in self.held.items() if p not in parts} | {p: generation for p in full}
        self.generation = generation

    def _named(self, edges: DataFrame, labels: DataFrame) -> DataFrame:
        named = edges.join(labels.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("subject_id") == F.col("_n"), "left")
        return named.withColumn("component", F.coalesce("_c", "subject_id")).drop("_n", "_c")

    def start(self, edges: DataFrame) -> DataFrame:
        """The truth of all relations, from nothing."""
        kept = edges.select(*self.COLUMNS)
        labels = weak(kept, "subject_id", "object_id")
        done = self._named(relation_sweeps(kept, each=True, labels=labels, **self.sweeps)[0], labels).select("rel_id", "subject_id", "object_id", "confidence", "anchor", "row", "value", "component").checkpoint()
        self._write(done, labels, 0, list(range(self.parts)))
        return self.relations()

    def change(self, added: DataFrame, removed: DataFrame) -> DataFrame:
        """The relations of the components that the change touched, with their new truth.

        added: rows as for start; one whose rel_id is there stands for the one before (its ends are in the
        id and so the same). removed: rel_id, subject_id, object_id. Nothing else is read or written.
        """
        news, gone = added.select(*self.COLUMNS).checkpoint(), removed.select("rel_id", "subject_id", "object_id").checkpoint()
        old = self.labels()
        nodes = news.select("subject_id", "object_id").union(gone.select("subject_id", "object_id")).select(F.explode(F.array("subject_id", "object_id")).alias("node")).distinct()
        met = nodes.join(old, "node", "left").select(F.coalesce("component", "node").alias("component")).distinct().checkpoint()
        before = self.relations(met).select(*self.COLUMNS)
        left = before.join(gone.select("rel_id").union(news.select("rel_id")), "rel_id", "left_anti").select(*self.COLUMNS).union(news).checkpoint()
        ends = lambda df: df.select(F.col("subject_id").alias("u"), F.col("object_id").alias("v"))
        labels, _ = relabelled(old, ends(left), ends(news), ends(gone))
        done = self._named(relation_sweeps(left, each=True, labels=labels, **self.sweeps)[0], labels).select("rel_id", "subject_id", "object_id", "confidence", "anchor", "row", "value", "component").checkpoint()
        # parts that held a touched component, or hold one now, are written anew with what else they hold
        parts = sorted({*self._parts_of(met), *self._parts_of(done)})
        paths = [f"{self.path}/relations-{self.held[p]}/part={p}" for p in parts if p in self.held]
        others = self.spark.read.schema(self.SCHEMA).parquet(*paths).join(met, "component", "left_anti").select(done.columns) if paths else done.limit(0)
        self._write(others.union(done).checkpoint(), labels, self.generation + 1, parts)
        return done
