"""Nearest neighbours in space: points sorted along a space-filling curve, searched range by range, with one exchange across borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import need
from ..session import discard, small, written
from .sequence import same

AXES = ["x", "y", "z"]
#: Rows of a range, which one task holds, and rows of the boxes that a range is searched by.
ROWS, BOX = 50_000, 64
#: Points that are looked at for a bound on a box's distances, and points that a box is compared with at once.
AHEAD, SLICE = 512, 8192
#: Neighbours that a task hands on at once.
AT_ONCE = 50_000
#: Bits of each axis in the curve's number.
BITS = 20


def curve(low: list, high: list):
    """The number of a point's cell along a Morton curve through the box between low and high (columns)."""

    def spread(c):
        # Each step moves bits apart until two empty ones follow each.
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return c

    cells = [F.floor((F.col(a) - lo) / F.greatest(hi - lo, F.lit(1e-300)) * ((1 << BITS) - 1)).cast("long") for a, lo, hi in zip(AXES, low, high, strict=True)]
    x, y, z = (spread(c) for c in cells)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def search(queries: np.ndarray, points: np.ndarray, k: int, radius: float, copies: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the k nearest points within the radius as (d, x, y, z), ties in the order of the coordinates. Both come along the curve.

    With ``copies`` each place counts as that many points.
    """
    return [near for sizes, found in searched(queries, points, k, np.full(len(queries), radius), copies) for near in np.split(found, np.cumsum(sizes)[:-1])]


def searched(queries: np.ndarray, points: np.ndarray, k: int, radius: np.ndarray, copies: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """search() with a radius for each query, box by box: how many points each of its queries found, and these points, query after query.

    Neighbours along the curve make boxes; boxes of queries look at boxes of points from the nearest on, and at no more than can matter.
    """
    cut = lambda a: [a[i : i + BOX] for i in range(0, len(a), BOX)]
    groups, counts = cut(points), cut(np.minimum(copies, k) if copies is not None else np.ones(len(points), int))
    low, high, sizes = np.array([g.min(0) for g in groups]).reshape(-1, 3), np.array([g.max(0) for g in groups]).reshape(-1, 3), np.array([len(g) for g in groups], int)
    for q, limit in zip(cut(queries), cut(radius), strict=True):
        gap = np.sqrt((np.maximum(0, np.maximum(low - q.max(0), q.min(0) - high)) ** 2).sum(1))
        order = np.lexsort((((low + high - q.max(0) - q.min(0)) ** 2).sum(1), gap))  # many boxes overlap: of these the one around the same middle first
        reached = order[gap[order] <= limit.max()]
        first = int(np.searchsorted(np.cumsum(sizes[reached]), max(k, AHEAD))) + 1  # boxes that hold k points, and some more for a tight bound
        if first < len(reached):
            reached = reached[gap[reached] <= _kth(q, np.concatenate([groups[g] for g in reached[:first]]), k).max()]
        p = np.concatenate([groups[g] for g in reached] or [points[:0]])
        times = np.concatenate([counts[g] for g in reached] or [np.zeros(0, int)])
        limit = np.minimum(_kth(q, p, k), limit)
        rows, cols, found = [], [], []
        for at in range(0, len(p), SLICE):
            d = _distances(q, p[at : at + SLICE])
            row, col = np.nonzero(d <= limit[:, None])
            rows.append(row)
            cols.append(col + at)
            found.append(d[row, col])
        row, col = (np.concatenate(x or [np.zeros(0, int)]) for x in (rows, cols))
        near = np.column_stack([np.concatenate(found or [np.zeros(0)]), p[col]])
        at = np.lexsort((*near.T[::-1], row))
        near, row, times = near[at], row[at], times[col][at]
        upto = np.concatenate([[0], np.cumsum(times)])
        ahead = upto[:-1] - upto[np.searchsorted(row, row)]  # of the same query
        times = np.clip(k - ahead, 0, times)
        yield np.bincount(row, times, len(q)).astype(int), np.repeat(near, times, axis=0)


def _kth(q: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """Each query's distance to its k-th nearest of these places, infinite if there are fewer."""
    best = np.zeros((len(q), 0))
    for at in range(0, len(p), SLICE):
        best = np.concatenate([best, _distances(q, p[at : at + SLICE])], axis=1)
        if best.shape[1] > k:
            best = np.partition(best, k - 1, axis=1)[:, :k]
    return best.max(1) if best.shape[1] == k else np.full(len(q), np.inf)


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = np.zeros((len(q), len(p)))
    for i in range(3):
        d += (q[:, i, None] - p[None, :, i]) ** 2
    return np.sqrt(d)


def nearest_points(queries: DataFrame, points: DataFrame, key: str, k: int, radius: float = float("inf"), by: list[str] | None = None, rows: int = ROWS, places: bool = True) -> DataFrame:
    """The keys (``by`` and ``key``) and near: each query's k nearest points of its dataset within the radius, nearest first, as structs (d, x, y, z); or (d) without ``places``.

    Rows are range-sorted by dataset and place on a Morton curve into ranges of some ``rows`` rows, so dense places take more ranges and no
    task holds more. First each range is searched by itself; a query whose k-th distance reaches into the boxes around other ranges'
    points is then searched there too, no farther than that distance, and its lists are merged. So a query's points are looked at twice, whatever
    the density. A range that many queries reach into is visited by several tasks, which hand on their lists in small parts. Where all rows are
    one range, that is all. Queries or points with a coordinate that is null or not finite take no part. A query without a point in reach has no row.
    Points at one place are searched as one with their number, and queries at one place once, so copies add no search.
    """
    need(k > 0 and radius > 0 and rows > 0, "count, radius and rows must be positive")
    by = by or []
    keys = [*by, key]
    sound = " and ".join(f"{a} is not null and abs({a}) < double('infinity')" for a in AXES)
    asked = queries.where(sound).select(*keys, *AXES)
    keys = [*by, *AXES]
    q = asked.select(*keys, F.lit(True).alias("_query"), F.lit(0).cast("long").alias("_copies")).distinct()
    p = points.where(sound).groupBy(*keys).agg(F.count("*").alias("_copies")).select(*keys, F.lit(False).alias("_query"), "_copies")
    both = written(q.unionByName(p), "places")
    span = both.groupBy(*by).agg(*[f(a).alias(f"_{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES], F.count("*").alias("_n")).withColumnsRenamed({b: f"_{b}" for b in by})
    span = written(span, "span")
    total = span.agg(F.sum("_n")).first()[0] or 0
    placed = both.join(small(span), same(by)) if by else both.join(F.broadcast(span))  # without datasets span is one row
    placed = placed.withColumn("_m", curve([F.col(f"_lo{a}") for a in AXES], [F.col(f"_hi{a}") for a in AXES])).select(*keys, "_query", "_copies", "_m")
    several = total >= rows
    if several:
        placed = written(placed.repartitionByRange(1 + total // rows, *by, "_m", *AXES).withColumn("_range", F.spark_partition_id()), "placed")
    else:
        placed = placed.withColumn("_range", F.lit(0))
    fields = ["d", *AXES] if places else ["d"]
    schema = ", ".join([*(f"{c} {queries.schema[c].dataType.simpleString()}" for c in by), "x double, y double, z double, _range int, _m long, _reach double", f"near array<struct<{', '.join(f'{c}:double' for c in fields)}>>"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("_m", *AXES)])
        asks = rows["_query"].to_numpy()
        xyz = np.column_stack([rows[a].to_numpy().astype(float) for a in AXES])
        q, own = xyz[asks], rows.filter(rows["_query"]).select([*by, "_range", "_m"])
        lists = searched(q, xyz[~asks], k, np.minimum(rows["_reach"].to_numpy()[asks], radius), rows["_copies"].to_numpy()[~asks])
        sizes, found, start = [], [], 0
        for n, near in lists:
            sizes.append(n)
            found.append(near)
            if sum(map(len, found)) >= AT_ONCE:
                yield handed(own, q, start, np.concatenate(sizes), np.concatenate(found))
                start, sizes, found = start + sum(map(len, sizes)), [], []
        if sizes:
            yield handed(own, q, start, np.concatenate(sizes), np.concatenate(found))

    def handed(own, q, start, sizes, found):
        upto = np.concatenate([[0], np.cumsum(sizes)])
        kth = np.full(len(sizes), np.inf)
        kth[sizes == k] = found[upto[1:][sizes == k] - 1, 0]
        near = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(fields))], fields))
        own = own.slice(start, len(sizes)).combine_chunks().to_batches()[0]
        columns = {c: own.column(c) for c in own.schema.names} | dict(zip(AXES, map(pa.array, q[start : start + len(sizes)].T), strict=True)) | {"_reach": pa.array(kth), "near": near}
        return pa.RecordBatch.from_pydict({c: columns[c] for c in (*keys, "_range", "_m", "_reach", "near")})

    whole = F.lit(float("inf")).alias("_reach")
    home = written(placed.select("*", whole).groupBy("_range", *by).applyInArrow(one, schema), "home")

    def answered(near, lists):
        here = near.select("*", lists.alias("near")).where(F.size("near") > 0)
        return asked.join(here, same(keys)).select(*by, key, "near")

    mine = home.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("near").alias("_near"))
    if not several:
        return answered(mine, F.col("_near"))
    # one row a range and dataset
    boxes = placed.where("not _query").groupBy("_range", *by).agg(*[f(a).alias(f"_{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES], F.sum("_copies").alias("_n"))
    boxes = written(boxes.withColumnsRenamed({"_range": "_there", **{b: f"_{b}" for b in by}}), "boxes")
    gap = F.sqrt(sum(F.pow(F.greatest(F.lit(0.0), F.col(f"_lo{a}") - F.col(a), F.col(a) - F.col(f"_hi{a}")), 2) for a in AXES))
    open_ = home.select(*keys, "_range", "_m", F.least("_reach", F.lit(float(radius))).alias("_reach"))
    # nothing near at home: the farthest corner of any box with k points bounds the distance
    far = F.sqrt(sum(F.pow(F.greatest(F.abs(F.col(f"_lo{a}") - F.col(a)), F.abs(F.col(f"_hi{a}") - F.col(a))), 2) for a in AXES))
    beside = boxes if by else F.broadcast(boxes)  # without datasets a row a range
    lost = open_.where(F.col("_reach") == float("inf")).join(beside, [*same(by), F.col("_n") >= k]).groupBy(*keys).agg(F.min(far).alias("_bound")).withColumnsRenamed({c: f"_{c}" for c in keys})
    reach = F.least("_reach", "_bound") * (1 + 1e-12)  # roots may be rounded otherwise there
    open_ = open_.join(lost, same(keys), "left").select(*keys, "_range", "_m", reach.alias("_reach"))
    away = open_.join(beside, [*same(by), F.col("_range") != F.col("_there"), gap <= F.col("_reach")])
    away = written(away.select(*keys, F.lit(True).alias("_query"), F.lit(0).cast("long").alias("_copies"), F.col("_there").alias("_range"), "_m", "_reach"), "away")
    dealt = away.repartitionByRange(1 + away.count() // rows, "_range", *by, "_m", *AXES)  # along the curve too: their boxes are small
    guests = written(dealt.withColumn("_part", F.spark_partition_id()), "guests")
    at = written(guests.select(*[F.col(c).alias(f"_{c}") for c in ("_range", *by)], "_part").distinct(), "hosts")
    hosts = placed.where("not _query").join(small(at), same(["_range", *by])).select(*keys, "_query", "_copies", "_range", "_m", whole, "_part")
    found = guests.unionByName(hosts).groupBy("_range", "_part", *by).applyInArrow(one, schema).where(F.size("near") > 0)
    more = written(found.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.flatten(F.collect_list("near")).alias("_more")), "more")
    for t in (both, span, placed, boxes, away, guests, at):
        discard(t)
    lists = F.when(F.col("_more").isNull(), F.col("_near")).otherwise(F.slice(F.array_sort(F.concat("_near", "_more")), 1, k))
    return answered(mine.join(more, same(keys, "_", "__"), "left"), lists)
