"""Loops of held relations, of any length: strong components first, then the loops inside each of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators.components import TASK_EDGES, ensure_checkpoints, packed, strong

#: Loops named per component, and edges looked at for them, at most; what that cuts off is reported.
LOOPS, STEPS = 1_000, 2_000_000


def loops_in(relations: list[tuple], most: int = LOOPS, steps: int = STEPS) -> tuple[list[list], bool]:
    """(loops, complete): the simple cycles of a component's relations (id, subject, object), as lists of ids from the least node on.

    From each node in turn only nodes that it leads to and that lead back to it, none less than it,
    are walked. A node that was left without a loop stays shut until a node that it leads to opens.
    """
    out, into = {}, {}
    for i, s, o in sorted(relations, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(s, []).append((o, i))
        into.setdefault(o, []).append(s)
    found, left = [], steps
    for start in sorted(out):
        sides = []
        for step in (lambda n: [o for o, _ in out.get(n, ())], lambda n: into.get(n, ())):
            seen, todo = {start}, [start]
            while todo:
                for to in step(todo.pop()):
                    left -= 1
                    if to > start and to not in seen:
                        seen.add(to)
                        todo.append(to)
            sides.append(seen)
        inside = sides[0] & sides[1]
        ahead = {n: [(o, i) for o, i in out.get(n, ()) if o in inside] for n in inside}
        shut, waiting, ids = {start}, {n: set() for n in inside}, []
        work = [(start, iter(ahead[start]))]
        closed = set()
        while work:
            if left <= 0 or len(found) >= most:
                return found, False
            node, rest = work[-1]
            for to, i in rest:
                left -= 1
                if to == start:
                    found.append([*ids, i])
                    closed.update(n for n, _ in work)
                    break
                if to not in shut:
                    ids.append(i)
                    work.append((to, iter(ahead[to])))
                    shut.add(to)
                    closed.discard(to)
                    break
            else:
                work.pop()
                if ids:
                    ids.pop()
                if node in closed:
                    opens = [node]
                    while opens:
                        n = opens.pop()
                        if n in shut:
                            shut.discard(n)
                            opens += waiting[n]
                            waiting[n].clear()
                else:
                    for to, _ in ahead[node]:
                        waiting[to].add(node)
        if left <= 0:
            return found, False
    return found, True


def held_relations(rel: DataFrame, floor: float = 0.5) -> DataFrame:
    """Relations with truth, the derived one where there is one, else the direct one, else 0, that reaches the floor."""
    derived = F.col("derived_truth") if "derived_truth" in rel.columns else F.lit(None).cast("double")
    truth = F.col("truth") if "truth" in rel.columns else F.coalesce(derived, "direct_truth", F.lit(0.0))
    return rel.withColumn("truth", truth).where(F.col("truth") >= floor)


def in_loops(rel: DataFrame, floor: float = 0.5, most: int = TASK_EDGES) -> DataFrame:
    """H8: the held relations that lie on a loop, with component, the least node of the strong component they are in."""
    held = held_relations(rel, floor)
    part = strong(held, "subject_id", "object_id", most).checkpoint()
    at = held.join(part.select(F.col("node").alias("subject_id"), "component"), "subject_id")
    return at.join(part.select(F.col("node").alias("object_id"), F.col("component").alias("_c")), "object_id").where(F.col("component") == F.col("_c")).drop("_c")


def loop_components(rel: DataFrame, floor: float = 0.5, most: int = TASK_EDGES) -> DataFrame:
    """H8: (component, nodes, relations) of the strong components of held relations, whatever the length of their loops."""
    inside = in_loops(rel, floor, most)
    ends = inside.select("component", F.explode(F.array("subject_id", "object_id")).alias("node")).groupBy("component").agg(F.count_distinct("node").alias("nodes"))
    return inside.groupBy("component").agg(F.count_distinct("rel_id").alias("relations")).join(ends, "component").select("component", "nodes", "relations")


def true_loops(rel: DataFrame, floor: float = 0.5, loops: int = LOOPS, steps: int = STEPS, most: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """H8: (loops, report): the directed cycles of held relations, of any length, and what each component was found to hold.

    rel: rel_id, subject_id, object_id and truth, or derived_truth and direct_truth. loops: component,
    loop (its rel_ids, sorted, joined by #), edges (in walking order, joined by >), length. report:
    component, relations, loops, complete. A component is incomplete where it has more than `loops`
    loops, the search more than `steps` steps, or more than `most` relations, when no loop of it is
    named; its relations are those of in_loops all the same. Repeated relations count once; null
    ends are on no loop.
    """
    ensure_checkpoints(rel.sparkSession)
    inside = in_loops(rel, floor, most).select("component", "rel_id", "subject_id", "object_id").distinct().checkpoint()
    small, large = packed(inside, "component", most)

    def search(bucket: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for component, part in bucket.groupby("component", sort=False):
            found, complete = loops_in(list(zip(part["rel_id"], part["subject_id"], part["object_id"], strict=True)), loops, steps)
            rows += [(component, "#".join(sorted(ids)), ">".join(ids), len(ids), None, None, None) for ids in found]
            rows.append((component, None, None, None, len(part), len(found), complete))
        return pd.DataFrame(rows, columns=["component", "loop", "edges", "length", "relations", "loops", "complete"])

    kind = inside.schema["component"].dataType.simpleString()
    done = small.groupBy("bucket").applyInPandas(search, f"component {kind}, loop string, edges string, length long, relations long, loops long, complete boolean").checkpoint()
    cut = large.groupBy("component").agg(F.count(F.lit(1)).alias("relations")).select("component", "relations", F.lit(0).cast("long").alias("loops"), F.lit(False).alias("complete"))
    named = done.where("loop is not null").select("component", "loop", "edges", "length")
    return named.dropDuplicates(["loop"]), done.where("loop is null").select("component", "relations", "loops", "complete").union(cut)
