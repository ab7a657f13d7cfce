"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of_each, same_width, search_blocks, usable

#: Depth of the first round of sorted access; each round doubles it.
FIRST = 16
#: Queries whose lists are walked together, and rows scored at once.
TOGETHER, ROWS = 256, 8192
#: Components beyond this size leave the plain double-precision products for exact integers.
SMALL = 2.0**20
LONG = 2**63 - 1


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), whole numbers held as doubles, exactly."""
    return np.floor(v.astype(np.float64) * scale)


def whole(x: float, scale: int) -> int:
    """floor(scale * x) as an integer of any size."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def clipped(x: int) -> int:
    return max(-LONG, min(LONG, x))


def build(scale: int):
    """A block's index: rows in the order in which sorted access down both ends of all lists meets them, and the lists' frontiers.

    A row's depth is its best rank from either end in any list. Rows sorted by depth are what access to depth d has seen,
    as a prefix; ``high`` and ``low`` hold each list's values there, at depths FIRST, 2 FIRST, ... Rows with a component beyond
    SMALL stand apart and are scored in exact integers.
    """

    def index(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        x = scaled(v, scale)
        large = (np.abs(x) > SMALL).any(axis=1) if x.size else np.zeros(len(x), bool)
        out = {"large_ids": ids[large], "large": v[large].astype(np.float64)}
        ids, x, v = ids[~large], x[~large], v[~large]
        n = len(ids)
        order = np.argsort(x, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
        depth = np.minimum(rank, n - 1 - rank).min(axis=1) if v.shape[1] and n else np.zeros(n, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        stops, d = [], FIRST
        while d < n:
            stops.append(d)
            d *= 2
        at = np.array(stops, np.int64)
        # Unseen rows rank behind the first d from either end, so their values lie between these.
        high, low = (np.take_along_axis(x, order[p], axis=0) if len(p) else np.zeros((0, x.shape[1])) for p in (n - 1 - at, np.minimum(at, n - 1)))
        seen = np.searchsorted(depth[by_depth], at, "left")
        return out | {"ids": ids[by_depth], "v": v[by_depth], "seen": seen, "high": high, "low": low}

    return index


def block_search(k: int, scale: int):
    def exact(index: dict, owners: np.ndarray, own: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, found: list) -> None:
        """Integer products of these queries with these rows, of any size; outside a long's range its end stands for them."""
        numbers = lambda v: [[whole(c, scale) for c in r] for r in v.tolist()]
        held = numbers(rows)
        for o, i, q in zip(owners.tolist(), own.tolist(), numbers(queries), strict=True):
            scores = [clipped(sum(map(int.__mul__, q, r))) for r in held]
            keep = np.flatnonzero(ids != i)
            some = np.array(scores, np.int64)[keep]
            if len(keep) > k:
                keep = keep[best_of_each(np.zeros(len(keep), np.int64), ids[keep], some, k)]
            found.append((np.full(len(keep), o), ids[keep], np.array(scores, np.int64)[keep]))

    def together(index: dict, x: np.ndarray, repeated: bool, owners: np.ndarray, own: np.ndarray, q: np.ndarray, floors: np.ndarray, found: list) -> None:
        """The threshold algorithm for some queries at once: the rows that each round of sorted access meets are scored in full, by one product;
        a query is done when no unseen row's bound reaches its k-th score or its floor (an equal score could have a smaller id)."""
        n = len(x)
        at, best = 0, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        least = np.where(floors > np.iinfo(np.int64).min, floors.astype(np.float64), -np.inf)
        active = np.arange(len(q))
        for stop, high, low in zip([*index["seen"].tolist(), n], [*index["high"], None], [*index["low"], None], strict=True):
            for a in range(at, stop, ROWS):
                b = min(stop, a + ROWS)
                scores = x[a:b] @ q[active].T
                enough = least[active]
                if not repeated and b - a > 4 * (k + 1) and not np.isfinite(enough).all():  # no row below its query's (k + 1)-th here can stay
                    enough = np.maximum(enough, np.partition(scores, b - a - k - 1, axis=0)[b - a - k - 1])
                row, col = np.nonzero(scores >= enough)
                hit = index["ids"][a:b][row] != own[active[col]]
                row, col = row[hit], col[hit]
                if not len(row):
                    continue
                new = active[col], index["ids"][a:b][row], scores[row, col]
                best = [np.concatenate(p) for p in zip(best, new, strict=True)]
                keep = best_of_each(*best, k, repeated)
                best = [p[keep] for p in best]
                full = np.bincount(best[0], minlength=len(q)) >= k
                last = np.append(np.flatnonzero(np.diff(best[0])), len(best[0]) - 1)
                kth = np.full(len(q), -np.inf)
                kth[best[0][last]] = best[2][last]
                least = np.where(full, np.maximum(least, kth), least)
            at = stop
            if high is not None:
                bound = np.maximum(q[active], 0) @ high + np.minimum(q[active], 0) @ low
                active = active[least[active] <= bound]
                if not len(active):
                    break
        found.append((owners[best[0]], best[1], best[2].astype(np.int64)))

    def search(index: dict, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray):
        v, large, queries, high, low = same_width(index["v"], index["large"], queries, index["high"], index["low"])
        index = index | {"high": high, "low": low}
        x, q = scaled(v, scale), scaled(queries, scale)
        repeated = len(np.unique(index["ids"])) < len(index["ids"])
        found, places = [], np.arange(len(q))
        plain = (np.abs(q) <= SMALL).all(axis=1) if q.size else np.ones(len(q), bool)
        few = x.shape[1] <= 2**12  # products of small components and their sums are below 2**53
        plain &= few
        for a in range(0, int(plain.sum()), TOGETHER):
            p = places[plain][a : a + TOGETHER]
            together(index, x, repeated, p, query_ids[p], q[p], floors[p], found)
        if (~plain).any():
            exact(index, places[~plain], query_ids[~plain], queries[~plain], v, index["ids"], found)
        if len(large):
            exact(index, places, query_ids, queries, large, index["large_ids"], found)
        at, ids, scores = (np.concatenate(p) if found else np.zeros(0, np.int64) for p in (zip(*found, strict=True) if found else ((), (), ())))
        keep = scores >= floors[at]
        at, ids, scores = at[keep], ids[keep], scores[keep]
        keep = best_of_each(at, ids, scores, k)
        return at[keep], ids[keep], scores[keep]

    return search


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block: int = 65_536, per: int = 2048, first: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, against all other rows.

    Components become floor(scale * x), exactly, whatever their size; a product beyond +-(2**63 - 1) counts as that.
    Null and non-finite vectors take no part, nor do rows without vec_id; vectors of unequal length are compared as if zeros
    followed, an empty one scores 0; fewer than k others give fewer rows. A vec_id of several rows takes one rank, with its best score.
    """
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where("id is not null"), "v")
    return search_blocks(rows, rows.where(F.col("id") % every == 0), build(scale), block_search(k, scale), k, "long", block, per, first)
