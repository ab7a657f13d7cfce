"""Approximate nearest neighbours: random-projection trees, one shared priority queue, exact reranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of_each, same_width, search_blocks, usable

TREES, LEAF = 64, 16
#: A query looks at SCALE * n ** POWER of a block's n points: a share that falls as blocks grow.
SCALE, POWER = 2.6, 0.76
#: Points of a block that are looked at whole.
WHOLE = 256
#: Queries whose margins are computed at once.
TOGETHER = 16


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1, in single precision; the largest component goes first, so no square overflows."""
    x = v.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def depth_of(n: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n / leaf)))))


def planes_of(u: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Unit normals of split planes: each the difference of two of the node's vectors (of one of them where both point one way)."""
    d = u[pairs[..., 0]] - u[pairs[..., 1]]
    size = np.linalg.norm(d, axis=-1, keepdims=True)
    d = np.where(size > 1e-12, d, u[pairs[..., 0]])
    return (d / np.maximum(np.linalg.norm(d, axis=-1, keepdims=True), 1e-30)).astype(np.float32)


def grow(u: np.ndarray, trees: int, leaf: int, seed: int = 11) -> dict[str, np.ndarray]:
    """Trees over unit vectors, every node split at the median: pairs (the two places that give a node's plane), cuts, and order,
    each tree's places leaf by leaf. Nodes of a level are numbered in a row, so a tree is arrays without pointers."""
    rng, (n, depth) = np.random.default_rng(seed), (len(u), depth_of(len(u), leaf))
    pairs, cuts = np.zeros((trees, (1 << depth) - 1, 2), np.int32), np.zeros((trees, (1 << depth) - 1), np.float32)
    order = np.zeros((trees, n), np.int32)
    for t in range(trees):
        groups = [np.arange(n)]
        for level in range(depth):
            split = []
            for j, g in enumerate(groups):
                node, a = (1 << level) - 1 + j, int(rng.integers(len(g)))
                b = (a + 1 + int(rng.integers(max(1, len(g) - 1)))) % len(g)
                pairs[t, node] = g[a], g[b]
                side = u[g] @ planes_of(u, pairs[t, node])
                half = len(g) // 2
                at = np.argpartition(side, half)
                cuts[t, node] = side[at[half]]
                split += [g[at[:half]], g[at[half:]]]
            groups = split
        order[t] = np.concatenate(groups)
    return {"pairs": pairs, "cuts": cuts, "order": order}


def leaves_of(order: np.ndarray, depth: int) -> np.ndarray:
    """Every tree's leaves as rows of places, filled up with the number of points."""
    trees, n = order.shape
    sizes = np.array([n])
    for _ in range(depth):
        sizes = np.stack([sizes // 2, sizes - sizes // 2], 1).ravel()
    out = np.full((trees, len(sizes), int(sizes.max())), n, np.int32)
    which = np.repeat(np.arange(len(sizes)), sizes)
    out[:, which, np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = order
    return out.reshape(trees * len(sizes), -1)


class SharedQueue:
    """One priority queue over the leaves of all trees: the leaf comes first whose worst margin on its path is least.

    A margin is how far a query lies on the other side of a split plane. Worst margins never shrink on the way down, so taking leaves in
    their order is best-first search of all trees at once. The queue sorts itself a run at a time, as far as it is read.
    """

    def __init__(self, margins: np.ndarray, depth: int, run: int = 2048):
        worst = np.zeros((len(margins), 1), np.float32)
        for level in range(depth):
            m = margins[:, (1 << level) - 1 : (1 << level + 1) - 1]
            worst = np.stack([np.maximum(worst, m), np.maximum(worst, -m)], 2).reshape(len(margins), -1)
        self.worst, self.run, self.ready, self.rest = worst.ravel(), run, np.zeros(0, np.int64), None

    def take(self, n: int) -> np.ndarray:
        """The next n leaves; fewer at the end."""
        while len(self.ready) < n and (self.rest is None or len(self.rest)):
            rest = np.arange(len(self.worst)) if self.rest is None else self.rest
            if len(rest) > self.run:
                cut = np.argpartition(self.worst[rest], self.run)
                rest, self.rest = rest[cut[: self.run]], rest[cut[self.run :]]
            else:
                self.rest = rest[:0]
            self.ready = np.concatenate([self.ready, rest[np.argsort(self.worst[rest], kind="stable")]])
            self.run *= 2
        out, self.ready = self.ready[:n], self.ready[n:]
        return out


def budget(n: int, scale: float = SCALE, power: float = POWER) -> int:
    """Points that a query looks at in a block of n; all of a small one."""
    return min(n, max(WHOLE, int(np.ceil(scale * n**power))))


def build(trees: int, leaf: int):
    def index(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        """Equal vectors are one point of the forest; ``members`` has its rows in id order, an id once."""
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        key = np.ascontiguousarray(v + v.dtype.type(0)).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        members = np.argsort(inverse, kind="stable")
        copy = (np.diff(inverse[members], prepend=-1) == 0) & (np.diff(ids[members], prepend=ids[members[0]]) == 0)
        members = members[~copy]
        starts = np.append(0, np.cumsum(np.bincount(inverse[members])))
        return {"points": v[first], "starts": starts, "member_ids": ids[members]} | grow(unit(v[first]), trees, leaf)

    return index


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with q in double precision, summed row by row alike wherever a row stands, so copies score alike."""
    scale = lambda x: np.maximum(np.abs(x).max(axis=-1, keepdims=True), 1e-300)
    v, q = (v / scale(v), q / scale(q)) if not (np.abs(v).max(initial=0) < 1e100 and np.abs(q).max() < 1e100 and np.abs(q).max() > 1e-100) else (v, q)
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def gathered(queue: SharedQueue, leaves: np.ndarray, u: np.ndarray, q: np.ndarray, k: int, most: int, bounded: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places and single-precision cosines of one query's leaf candidates: ``most`` of them or a few more, or, if ``bounded``, until no
    leaf left can hold a nearer one than its k best."""
    n = len(u)
    seen = np.zeros(n + 1, bool)
    seen[n] = True
    places, near, best = [], [], np.zeros(0, np.float32)
    count = taken = 0
    while len(some := queue.take(max(32, taken // 8))):  # the leaves that are looked at together grow with those behind
        if bounded and len(best) == k and queue.worst[some[0]] > np.sqrt(max(0.0, 2 - 2 * float(best[-1]))) + 1e-4:
            break  # a point beyond a plane is at least the margin away, and so are all in the leaves that follow
        taken += len(some)
        got = leaves[some].ravel()
        got = np.unique(got[~seen[got]])
        seen[got] = True
        cos = u[got] @ q
        places.append(got)
        near.append(cos)
        count += len(got)
        best = np.sort(np.append(best, cos))[::-1][:k]
        if count >= most:
            break
    return np.concatenate(places), np.concatenate(near)


def block_search(k: int, scale: float = SCALE, power: float = POWER):
    def ready(index: dict, width: int) -> tuple:
        """What every slice of queries needs of a block, made for the first one."""
        if index.get("_width") != width:
            points = same_width(index["points"], np.zeros((0, width)))[0]
            u, depth = unit(points), (index["cuts"].shape[1] + 1).bit_length() - 1
            index["_ready"] = points, u, depth, leaves_of(index["order"], depth), planes_of(u, index["pairs"]).reshape(-1, points.shape[1])
            index["_width"] = width
        return index["_ready"]

    def search(index: dict, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray):
        queries = same_width(queries, index["points"][:0])[0]
        points, u, depth, leaves, planes = ready(index, queries.shape[1])
        w = unit(queries)
        members, starts, cuts = index["member_ids"], index["starts"], index["cuts"]
        repeated = len(np.unique(members)) < len(members)
        out = [[], [], []]
        for at in range(0, len(w), TOGETHER):
            some = w[at : at + TOGETHER]
            margins = (some @ planes.T).reshape(len(some), *cuts.shape) - cuts
            for j, margin in enumerate(margins, at):
                got, near = gathered(SharedQueue(margin, depth), leaves, u, w[j], k + 1, budget(len(u), scale, power), not repeated)
                if len(near) > 4 * (k + 1) and not repeated:  # single precision first; the margin covers its error
                    got = got[near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - 1e-5]
                # Of the rows of one point no query needs more than k + 1.
                many = np.minimum(starts[got + 1] - starts[got], k + 1) if not repeated else starts[got + 1] - starts[got]
                rows = np.repeat(starts[got] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                score = np.repeat(cosines(points[got].astype(np.float64), queries[j].astype(np.float64)), many)
                keep = (members[rows] != query_ids[j]) & (score >= floors[j])
                ids, score = members[rows[keep]], score[keep]
                best = best_of_each(np.zeros(len(ids), np.int64), ids, score, k, repeated)
                for held, value in zip(out, (np.full(len(best), j), ids[best], score[best]), strict=True):
                    held.append(value)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)

    return search


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = TREES, leaf: int = LEAF, scale: float = SCALE, power: float = POWER, block: int = 65_536, per: int = 2048, first: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for the rows whose vec_id is divisible by ``every``, against all other rows.

    Each block of rows gets a forest over all its vectors, grown once and kept with the block; every query searches every block.
    A search gathers leaves in the queue's order up to ``scale`` * n ** ``power`` of a block's n different vectors, or until the next
    leaf's margin shows that no nearer one is left, so near neighbours that stand out cost little. Null, empty, zero and
    non-finite vectors take no part, nor do rows without vec_id. Copies tie exactly, to the smaller vec_id.
    A vec_id of several rows takes one rank, with its best score.
    """
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where("id is not null"), "v", nonzero=True)
    return search_blocks(rows, rows.where(F.col("id") % every == 0), build(trees, leaf), block_search(k, scale, power), k, "double", block, per, first)
