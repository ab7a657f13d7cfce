"""Point clouds: transforms, unions, nearest neighbours, voxels, density cuts; metric scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calibration
from ..functions.exprs import distance, transform_point
from ..schemas import need
from ..session import written
from .neighbours import nearest_points
from .sequence import numbered, quantiles

AXES = ["x", "y", "z"]


def moved(points: DataFrame, scale: float, matrix: list[list[float]], shift: list[float]) -> DataFrame:
    new = transform_point([F.col(a) for a in AXES], scale, matrix, shift)
    return points.withColumns(dict(zip(AXES, new, strict=True)))


def merged(main: DataFrame, secondary: DataFrame, meters_per_unit: float = 1.0) -> DataFrame:
    """Both clouds in metres with the component each comes from."""
    both = main.withColumn("component", F.lit("main")).unionByName(secondary.withColumn("component", F.lit("secondary")))
    return both.withColumns({a: F.col(a) * meters_per_unit for a in AXES})


def nearest(queries: DataFrame, points: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Each query's distance to the nearest point of its dataset (columns ``by``): keys, nearest. A query without any point gives no row."""
    found = nearest_points(queries, points, key, 1, by=by)
    return found.select(*(by or []), key, F.col("near")[0]["d"].alias("nearest"))


def neighbour_distance(points: DataFrame, key: str, k: int = 20, by: list[str] | None = None) -> DataFrame:
    """keys, mean_distance: each point's mean distance to the k nearest points of its dataset, itself included (all points if fewer)."""
    found = nearest_points(points, points, key, k, by=by, places=False)
    total = F.aggregate("near", F.lit(0.0), lambda t, p: t + p["d"])
    return found.select(*(by or []), key, (total / F.size("near")).alias("mean_distance"))


def without_outliers(points: DataFrame, key: str, k: int = 20, ratio: float = 2.5, by: list[str] | None = None) -> DataFrame:
    """Points whose mean neighbour distance is positive and not over their dataset's mean by ``ratio`` deviations or more."""
    by = by or []
    d = written(neighbour_distance(points, key, k, by), "distances")
    limits = d.groupBy(*by).agg((F.avg("mean_distance") + ratio * F.coalesce(F.stddev_samp("mean_distance"), F.lit(0.0))).alias("limit"))
    both = d.join(limits, by) if by else d.join(F.broadcast(limits))  # without datasets limits is one row
    kept = both.where((F.col("mean_distance") > 0) & (F.col("mean_distance") < F.col("limit")))
    return points.join(kept.select(*by, key), [*by, key], "left_semi")


#: Names of the second moments of a neighbourhood.
MOMENTS = ["xx", "xy", "xz", "yy", "yz", "zz"]


def neighbour_moments(points: DataFrame, key: str, radius: float = 0.10, most: int = 40, by: list[str] | None = None) -> DataFrame:
    """keys, neighbours and the covariance of the ``most`` nearest points within ``radius`` in the same dataset, the point itself included."""
    found = nearest_points(points, points, key, most, radius, by)
    mean = lambda f: F.aggregate("near", F.lit(0.0), lambda t, p: t + f(p)) / F.size("near")
    found = found.withColumns({f"_{a}": mean(lambda p, a=a: p[a]) for a in AXES})
    moment = lambda m: mean(lambda p: (p[m[0]] - F.col(f"_{m[0]}")) * (p[m[1]] - F.col(f"_{m[1]}")))
    return found.select(*(by or []), key, F.size("near").cast("long").alias("neighbours"), *[moment(m).alias(m) for m in MOMENTS])


def normals(points: DataFrame, key: str, radius: float = 0.10, most: int = 40) -> DataFrame:
    """key, nx, ny, nz: the direction of least variance around each point, up to sign; (0, 0, 1) with under three neighbours."""
    return with_normals(neighbour_moments(points, key, radius, most)).select(key, "nx", "ny", "nz")


def with_normals(moments: DataFrame) -> DataFrame:
    """neighbour_moments() and nx, ny, nz of each row's neighbourhood: one search gives both."""

    def run(batches):
        for pdf in batches:
            xx, xy, xz, yy, yz, zz = (pdf[m].to_numpy() for m in MOMENTS)
            matrices = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2)
            n = np.linalg.eigh(matrices)[1][:, :, 0]
            n[pdf["neighbours"].to_numpy() < 3] = (0, 0, 1)
            yield pdf.assign(nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])

    kinds = ", ".join(f"{c} {t}" for c, t in moments.dtypes)
    return moments.mapInPandas(run, f"{kinds}, nx double, ny double, nz double")


def seam_gate(distances: DataFrame, limit: float = 0.25, share: float = 0.50) -> DataFrame:
    distances = written(distances.select("nearest"), "seam")
    g = distances.agg(F.avg((F.col("nearest") <= limit).cast("double")).alias("seam_within_fraction"))
    g = quantiles(distances, [], "nearest", {"seam_median_m": 0.5}).join(F.broadcast(g))  # one row each
    return g.withColumn("seam_geometry_gate_passed", (F.col("seam_median_m") <= limit) & (F.col("seam_within_fraction") >= share))


def voxels(points: DataFrame, edge: float, keys: list[str]) -> DataFrame:
    need(edge > 0, "edge must be positive")
    cells = [F.floor(F.col(a) / edge).cast("long").alias(f"v{a}") for a in AXES]
    return points.groupBy(*keys, *cells).agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("points"))


def cropped(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Points inside a closed axis-aligned box."""
    inside = [F.col(a).between(lo, hi) for a, lo, hi in zip(AXES, low, high, strict=True)]
    return points.where(inside[0] & inside[1] & inside[2])


def spread(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spread: the median distance of a group's points from the point of their median coordinates."""
    axes = points.select(*keys, F.posexplode(F.array(*AXES)).alias("_i", "_c"))
    middle = quantiles(axes, [*keys, "_i"], "_c", {"_m": 0.5}).groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_m"))).alias(f"_{a}") for i, a in enumerate(AXES)])
    d = distance([F.col(a) for a in AXES], [F.col(f"_{a}") for a in AXES])
    return quantiles(points.join(middle, keys).select(*keys, d.alias("_d")), keys, "_d", {"spread": 0.5})


def boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, points and the box around each group's points."""
    return points.groupBy(*keys).agg(F.count("*").alias("points"), *[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES])


def dense_summary(clouds: DataFrame, key: str, voxel: float, k: int = 20, ratio: float = 2.5) -> tuple[DataFrame, DataFrame]:
    """The fused cloud, and one row for each component with its counts on the way and the box around what is left.

    ``clouds`` (component, x, y, z) are already in one frame. Each component is thinned to one point a voxel and rid of its
    outliers by itself; the fused cloud is all of them, thinned again.
    """
    by = ["component"]
    thin = voxels(clouds, voxel, by).withColumn(key, F.struct("vx", "vy", "vz"))
    thin = written(thin.select(*by, key, *AXES), "voxels")
    kept = written(without_outliers(thin, key, k, ratio, by), "cleaned")
    raw = clouds.groupBy(*by).agg(F.count("*").alias("input_points"))
    down = thin.groupBy(*by).agg(F.count("*").alias("voxel_points"))
    clean = boxes(kept, by).withColumnRenamed("points", "clean_points")
    summary = raw.join(down, by, "left").join(clean, by, "left").fillna({"voxel_points": 0, "clean_points": 0})
    return voxels(kept.drop(key), voxel, []), summary.withColumn("kept_fraction", F.col("clean_points") / F.nullif("input_points", F.lit(0)))


#: Triples of points that a floor is looked for by, the seed of their drawing, and the points or planes that are multiplied at once.
TRIALS, SEED, AT_ONCE = 5000, 9, 500


def floor_planes(points: DataFrame, key: str, order: str, trials: int = TRIALS) -> DataFrame:
    """key, points, inliers, rmse and nx, ny, nz, offset of the plane with most points near it, for each group of a cloud of any size.

    The rule is calibration.floor_plane's, in passes over the rows: medians by selection, corners drawn by their place in the order,
    counts near every triple's plane summed over tasks, and the normal from the inliers' second moments. Only planes are held whole, not points.
    """
    p = written(numbered(points.select(key, order, *AXES), [key], [order], "_at"), "floor-points")
    middle = p.select(key, F.posexplode(F.array(*AXES)).alias("_i", "_c"))
    middle = quantiles(middle, [key, "_i"], "_c", {"_m": 0.5}).groupBy(key).agg(*[F.max(F.when(F.col("_i") == i, F.col("_m"))).alias(f"_{a}") for i, a in enumerate(AXES)])
    d = distance([F.col(a) for a in AXES], [F.col(f"_{a}") for a in AXES])
    spreads = quantiles(p.join(F.broadcast(middle), key).select(key, d.alias("_d")), [key], "_d", {"spread": 0.5})
    groups = p.groupBy(key).agg(F.count("*").alias("n")).join(spreads, key).collect()  # one row a floor
    draws = []
    for g in groups:
        need(g["n"] >= calibration.LEAST_POINTS, f"a floor plane needs {calibration.LEAST_POINTS} points, not {g['n']}")
        drawn = np.random.default_rng(SEED).integers(0, g["n"], (trials, 3))
        draws += [(g[key], int(at), t, c) for t, row in enumerate(drawn) for c, at in enumerate(row)]
    draws = p.sparkSession.createDataFrame(draws, f"{key} {dict(p.dtypes)[key]}, _at long, _t int, _c int")
    corners: dict = {}
    for r in p.join(F.broadcast(draws), [key, "_at"]).select(key, "_t", "_c", *AXES).collect():  # as many as are drawn
        corners.setdefault(r[key], np.zeros((trials, 3, 3)))[r["_t"], r["_c"]] = r["x"], r["y"], r["z"]
    planes = {g[key]: (*calibration.planes_through(corners[g[key]]), max(calibration.NEAR * g["spread"], calibration.NEAR_LEAST)) for g in groups}
    held = p.sparkSession.sparkContext.broadcast(planes)

    def count(batches):
        hits = {}
        for pdf in batches:
            for k, own in pdf.groupby(key):
                normals, shift, near = held.value[k]
                total, xyz = hits.setdefault(k, np.zeros(len(normals), np.int64)), own[AXES].to_numpy(float)
                for a in range(0, len(xyz), AT_ONCE):
                    for b in range(0, len(normals), AT_ONCE):
                        total[b : b + AT_ONCE] += calibration.hits(xyz[a : a + AT_ONCE], normals[b : b + AT_ONCE], shift[b : b + AT_ONCE], near)
        for k, total in hits.items():
            yield pd.DataFrame({key: k, "_t": np.arange(len(total)), "_hits": total})

    near_by = p.repartition(4 * p.sparkSession.sparkContext.defaultParallelism, order).mapInPandas(count, f"{key} {dict(p.dtypes)[key]}, _t int, _hits long")
    near_by = near_by.groupBy(key, "_t").agg(F.sum("_hits").alias("_hits"))
    best = {r[key]: r["b"] for r in near_by.groupBy(key).agg(F.max(F.struct("_hits", -F.col("_t"))).alias("b")).collect()}
    chosen = []
    for g in groups:
        most, at = best.get(g[key], (0, 0))
        need(most >= calibration.LEAST_INLIERS, f"no plane has {calibration.LEAST_INLIERS} points near it")
        normals, shift, near = planes[g[key]]
        chosen.append((g[key], *map(float, normals[-at]), float(shift[-at]), float(near), float(g["n"])))
    chosen = p.sparkSession.createDataFrame(chosen, f"{key} {dict(p.dtypes)[key]}, _nx double, _ny double, _nz double, _shift double, _near double, _n double")
    off = F.abs(sum((F.col(a) * F.col(f"_n{a}") for a in AXES), F.lit(0.0)) - F.col("_shift"))
    inside = p.join(F.broadcast(chosen), key).where(off < F.col("_near"))
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    m = inside.groupBy(key).agg(F.max("_n").cast("long").alias("points"), F.count("*").alias("inliers"), *[F.avg(a).alias(a) for a in AXES], *[F.covar_pop(a, b).alias(a + b) for a, b in pairs])
    rows = []
    for r in m.collect():  # one row a floor
        square, axes = np.linalg.eigh(np.array([[r["".join(sorted(a + b))] for b in AXES] for a in AXES]))
        normal = axes[:, 0]
        rows.append((r[key], r["points"], r["inliers"], float(np.sqrt(max(square[0], 0.0))), *map(float, normal), -float(normal @ [r[a] for a in AXES])))
    return p.sparkSession.createDataFrame(rows, f"{key} {dict(p.dtypes)[key]}, points long, inliers long, rmse double, nx double, ny double, nz double, offset double")


def density_cut(points: DataFrame, density: str, keys: list[str], quantile: float = 0.03) -> DataFrame:
    """Points whose density is not under their group's quantile."""
    cut = quantiles(points, keys, density, {"_cut": quantile})
    return points.join(cut, keys).where(F.col(density) >= F.col("_cut")).drop("_cut")


def valid_checks(checks: DataFrame) -> DataFrame:
    """Checks with a name and positive, finite lengths; any other is an error that names it."""
    good = lambda c: F.col(c).isNotNull() & (F.col(c) > 0) & (F.col(c) < float("inf"))
    wrong = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("a check needs a name")).when(~good("actual_m"), F.concat(F.col("name"), F.lit(": the actual length must be positive"))).when(~good("units"), F.concat(F.col("name"), F.lit(": the reconstructed length must be positive")))
    return checks.withColumn("name", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("name")))


def scale_checks(checks: DataFrame, key: str) -> DataFrame:
    """Dimension errors from (key, name, actual_m, units, meters_per_unit)."""
    e = checks.withColumn("estimated_m", F.col("units") * F.col("meters_per_unit"))
    return e.withColumn("absolute_error_m", F.abs(F.col("estimated_m") - F.col("actual_m"))).withColumn("percent_error", F.col("absolute_error_m") / F.nullif("actual_m", F.lit(0.0)) * 100)


def scale_summary(results: DataFrame, key: str) -> DataFrame:
    return results.groupBy(key).agg(F.count("*").alias("checks"), F.avg("absolute_error_m").alias("mean_absolute_error_m"), F.avg("percent_error").alias("mean_percent_error"))


def best_model(models: DataFrame, key: str, registered: str, name: str) -> DataFrame:
    """For each key the model with most registered images; null counts as 0, ties go to the first name."""
    w = Window.partitionBy(key).orderBy(F.desc(F.coalesce(registered, F.lit(0))), name)
    return models.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
