"""The best unlinked pairs of entities among the relations that a task holds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of entities, and meetings of them in a shared neighbour, that are looked at together.
CELLS, MEETINGS = 4_000_000, 8_000_000
PAIRS = "a string, b string, shared_nodes long, shared_transcripts long, support double, score double"


class Incidence:
    """Distinct (entity, column) with the sum of their weights; entities are numbered, columns below 0 are none."""

    def __init__(self, entity: np.ndarray, column: np.ndarray, weight: np.ndarray, width: int):
        some = column >= 0
        key, at = np.unique(entity[some].astype(np.int64) * max(width, 1) + column[some], return_inverse=True)
        self.entity, self.column, self.width = key // max(width, 1), key % max(width, 1), width
        self.weight = np.bincount(at, weight[some], len(key)).astype(float)

    def of(self, kept: np.ndarray) -> Incidence:
        """That of some entities, which keep their numbers."""
        out = object.__new__(Incidence)
        held = kept[self.entity]
        out.entity, out.column, out.weight, out.width = self.entity[held], self.column[held], self.weight[held], self.width
        return out

    def met(self, other: Incidence, rows: np.ndarray, na: int, nb: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(number, weights) of the columns that entities first to first + na (in rows) share with each of other's nb, which is sorted by column."""
        a, col, w = self.entity[rows] - first, self.column[rows], self.weight[rows]
        many = other.ptr[col + 1] - other.ptr[col]
        total = int(many.sum())
        if self.width and total > na * nb * self.width / 32:  # dense enough for products of matrices
            number, weight = np.zeros((na, nb)), np.zeros((na, nb))
            step = max(1, 2 * CELLS // max(na, nb, 1))
            for lo in range(0, self.width, step):
                x, y = (np.zeros((2, n, min(step, self.width - lo))) for n in (na, nb))
                r = (col >= lo) & (col < lo + step)
                x[0, a[r], col[r] - lo], x[1, a[r], col[r] - lo] = 1, w[r]
                r = slice(other.ptr[lo], other.ptr[min(lo + step, self.width)])
                y[0, other.entity[r], other.column[r] - lo], y[1, other.entity[r], other.column[r] - lo] = 1, other.weight[r]
                number += x[0] @ y[0].T
                weight += x[1] @ y[0].T + x[0] @ y[1].T
            return number, weight
        number, weight = np.zeros(na * nb), np.zeros(na * nb)
        ends = np.cumsum(many)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(MEETINGS, total, MEETINGS)), len(many)))
        for lo, hi in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            n = many[lo:hi]
            one = np.repeat(np.arange(lo, hi), n)
            two = np.arange(len(one)) + np.repeat(other.ptr[col[lo:hi]] - np.cumsum(n) + n, n)
            key = a[one] * nb + other.entity[two]
            number += np.bincount(key, minlength=na * nb)
            weight += np.bincount(key, w[one] + other.weight[two], na * nb)
        return number.reshape(na, nb), weight.reshape(na, nb)

    def by_column(self) -> Incidence:
        """The same sorted by column, with where each begins."""
        order = np.argsort(self.column, kind="stable")
        self.entity, self.column, self.weight = self.entity[order], self.column[order], self.weight[order]
        self.ptr = np.searchsorted(self.column, np.arange(self.width + 1))
        return self


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    coded = pa.array(column.combine_chunks()).dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def best_pairs(t: pa.Table, one: int, two: int, floor: float, surest: float, least: int, limit: int) -> pa.Table:
    """The first limit pairs by falling score (ties by a, b) of the entities e in rows (e, o, t, h, c, g) that reach floor.

    h stands for the relation's id, c for its confidence. A pair has an entity of group one and one of group two. Shared neighbours and
    transcripts are counted for all pairs; the confidence of the relations that support one is first bounded (a relation
    that a shared neighbour and a shared transcript both bring in counts twice), and looked up for pairs that the bound lets pass.
    """
    coded = pa.array(t["e"].combine_chunks()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    e = rank[coded.indices.to_numpy(zero_copy_only=False)]
    o, wide = _codes(t["o"])
    said, told = _codes(t["t"])
    c, h, g = (t[x].to_numpy() for x in ("c", "h", "g"))
    sure = np.maximum(c, 0.0)
    near, scripts = Incidence(e, o, sure, wide), Incidence(e, said, sure, told)
    n = len(names)
    reach = 2.0 * np.bincount(near.entity, minlength=n) + np.bincount(scripts.entity, minlength=n) + 0.1 * (np.bincount(e, sure, n) + surest)
    kept = reach >= floor
    group = np.zeros(n, np.int64)
    group[e] = g
    # relations of an entity lie together; those of one id and confidence count once for a pair
    by = np.lexsort((c, h, e))
    e, o, said, c, h = e[by], o[by], said[by], c[by], h[by]
    again = np.append(False, (e[1:] == e[:-1]) & (h[1:] == h[:-1]) & (c[1:] == c[:-1]))
    same = np.cumsum(~again)
    twice = bool(again.any())
    begin = np.searchsorted(e, np.arange(n + 1))
    other = pc.index_in(t["o"], value_set=names).fill_null(-1).to_numpy()[by]
    linked = np.unique(np.stack([np.minimum(e, other), np.maximum(e, other)], 1)[other >= 0], axis=0) if (other >= 0).any() else np.zeros((0, 2), np.int64)

    one_group = one == two
    sides = kept & (group == one), kept & (group == two)
    mine, theirs = (np.flatnonzero(s) for s in sides)
    number = np.full((2, n), -1)
    number[0, mine], number[1, theirs] = np.arange(len(mine)), np.arange(len(theirs))

    def part(table: Incidence, side: int) -> Incidence:
        out = table.of(sides[side])
        out.entity = number[side, out.entity]
        return out.by_column() if side else out

    sets = [(part(x, 0), part(x, 1)) for x in (near, scripts)]
    in_near, in_scripts = np.zeros(wide + 1, bool), np.zeros(told + 1, bool)
    best: list = []  # a heap of (score, -a, -b, ...), the worst first

    def backed(a: int, b: int) -> float:
        """The confidence of a's relations with what b knows."""
        it, me = slice(begin[b], begin[b + 1]), slice(begin[a], begin[a + 1])
        in_near[o[it]], in_scripts[said[it]] = True, True
        in_scripts[-1] = False  # no transcript
        hit = np.flatnonzero(in_near[o[me]] | in_scripts[said[me]]) + begin[a]
        in_near[o[it]], in_scripts[said[it]] = False, False
        return float(c[hit[np.unique(same[hit], return_index=True)[1]]].sum() if twice else c[hit].sum())

    nb = len(theirs)
    starts = np.searchsorted(sets[0][0].entity, np.arange(len(mine) + 1)), np.searchsorted(sets[1][0].entity, np.arange(len(mine) + 1))
    step = max(1, CELLS // max(nb, 1))
    for lo in range(0, len(mine) if nb else 0, step):
        na = min(step, len(mine) - lo)
        (sn, un), (st, ut) = (x.met(y, np.arange(s[lo], s[lo + na]), na, nb, lo) for (x, y), s in zip(sets, starts, strict=True))
        base = 2.0 * sn + st
        upper = base + 0.1 * (un + ut)
        ok = (sn > 0) & (sn + st >= least)
        for x, y in (linked.T, linked.T[::-1]):
            p, q = number[0, x] - lo, number[1, y]
            held = (p >= 0) & (p < na) & (number[0, x] >= 0) & (q >= 0)
            ok[p[held], q[held]] = False
        if one_group:
            ok &= np.arange(lo, lo + na)[:, None] < np.arange(nb)[None, :]
        ok &= upper >= max(floor, best[0][0] if len(best) == limit else floor) - 1e-6
        found = np.flatnonzero(ok)
        for k in found[np.argsort(-upper.ravel()[found], kind="stable")]:
            if len(best) == limit and upper.flat[k] < best[0][0] - 1e-6:
                break
            a, b = sorted((int(mine[lo + k // nb]), int(theirs[k % nb])))
            support = backed(a, b) + backed(b, a)
            row = (round(float(base.flat[k]) + 0.1 * support, 6), -a, -b, int(sn.flat[k]), int(st.flat[k]), support)
            heapq.heappush(best, row) if len(best) < limit else heapq.heappushpop(best, row)
    best = [r for r in best if r[0] >= floor]
    pick = lambda i, sign=1: [sign * r[i] for r in best]
    a, b = (names.take(pa.array(pick(i, -1), pa.int64())).cast(pa.string()) for i in (1, 2))
    return pa.table({"a": a, "b": b, "shared_nodes": pa.array(pick(3), pa.int64()), "shared_transcripts": pa.array(pick(4), pa.int64()), "support": pa.array(pick(5), pa.float64()), "score": pa.array(pick(0), pa.float64())})
