"""Registered queries of the calibration and image kernels and of whole commands, on pictures, points and models made from the tables."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cli
from ..functions import calibration, kernels
from ..operators import clouds
from ..session import shared_path
from ..sources import files, sinks
from . import stitch
from . import views as V
from .queries import query, rounded
from .roundtrips import model_folder


def each(df: DataFrame, key: str, kernel, out: str) -> DataFrame:
    """key and what ``kernel(row)`` gives for each row, dealt to all cores: a table's one small file would be one task."""
    names = [key, *[c.split()[0] for c in out.split(", ")]]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(r[key], *kernel(r)) for r in pdf.to_dict("records")], columns=names)

    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key).mapInPandas(run, f"{key} long, {out}")


# Two yellow bars a picture, one at row 60 and one at row 90; their sides come from the supplier's key.
_BARS = "b AS (SELECT s_suppkey AS k, 20 + s_suppkey % 17 AS w1, 6 + s_suppkey % 5 AS h1, 25 + s_suppkey * 7 % 31 AS w2, 5 + s_suppkey * 3 % 7 AS h2 FROM supplier)"


@query(f"WITH {_BARS}, t AS (SELECT *, w2 * h2 * (CAST(w2 AS DOUBLE) / h2) >= w1 * h1 * (CAST(w1 AS DOUBLE) / h1) AS low FROM b) SELECT k, CAST(5 AS DOUBLE) AS left, CAST(CASE WHEN low THEN 5 + w2 - 1 ELSE 5 + w1 - 1 END AS DOUBLE) AS right, CASE WHEN low THEN 90 + (h2 - 1) / 2 ELSE 60 + (h1 - 1) / 2 END AS y FROM t")
def tape_ends(spark, sf_dir):
    """Of two bars the one with the larger pixel count times elongation is the tape; equal ones: the lower."""

    def kernel(r):
        k, px = int(r["k"]), np.zeros((120, 160, 3), np.uint8)
        for y, h, w in ((60, 6 + k % 5, 20 + k % 17), (90, 5 + k * 3 % 7, 25 + k * 7 % 31)):
            px[y : y + h, 5 : 5 + w] = (0, 220, 255)
        px[10:30, 10:150] = (0, 220, 255)  # above the rows that are searched
        a, b = calibration.tape_endpoints(px)
        return min(a[0], b[0]), max(a[0], b[0]), (a[1] + b[1]) / 2

    return rounded(each(V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", kernel, "left double, right double, y double"))


_FLOOR = "p AS (SELECT p_partkey % 4 AS g, p_partkey, p_size AS x, p_partkey * 13 % 41 AS y FROM part), f AS (SELECT *, 0.5 * x - 0.25 * y + 10 * g + CASE WHEN p_partkey % 7 = 0 THEN 40 + p_partkey % 3 ELSE 0 END AS z FROM p)"


@query(f"WITH {_FLOOR} SELECT g, count(*) AS points, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS inliers, CAST(0 AS DOUBLE) AS rmse, CAST(0.5 AS DOUBLE) AS slope_x, CAST(-0.25 AS DOUBLE) AS slope_y, CAST(10 * g AS DOUBLE) AS height FROM f GROUP BY g")
def floor_planes(spark, sf_dir):
    """Parts of four groups on a plane each, every seventh far above it: the search finds the plane and leaves those out."""
    p = V.table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("g"), "p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") * 13 % 41).cast("double").alias("y"))
    off = F.when(F.col("p_partkey") % 7 == 0, 40 + F.col("p_partkey") % 3).otherwise(0)
    p = p.withColumn("z", 0.5 * F.col("x") - 0.25 * F.col("y") + 10 * F.col("g") + off)

    f = clouds.floor_planes(p, "g", "p_partkey")
    up = -F.col("nz")
    f = f.select("g", "points", "inliers", "rmse", (F.col("nx") / up).alias("slope_x"), (F.col("ny") / up).alias("slope_y"), (F.col("offset") / up).alias("height"))
    return rounded(f, 5)


@query("SELECT o_orderkey AS k, round(CAST(o_orderkey % 7 - 3 AS DOUBLE), 6) AS x, round(CAST(o_custkey % 5 - 2 AS DOUBLE), 6) AS y, round(4 + CAST(0.1 AS DOUBLE) * (o_orderkey % 7 - 3), 6) AS z FROM orders")
def pixel_places(spark, sf_dir):
    """Points of a sloping plane, seen by a turned camera with distortion: each pixel's ray meets the plane in the point."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 - 3).cast("double").alias("x"), (F.col("o_custkey") % 5 - 2).cast("double").alias("y"), ((F.col("o_custkey") % 11) / 20.0).alias("turn"))
    camera, normal = (500.0, 320.0, 240.0, 0.02), np.array([-0.1, 0.0, 1.0])

    def kernel(r):
        t = float(r["turn"])
        rotation = stitch.rotation([np.cos(t / 2), 0.0, 0.0, np.sin(t / 2)])
        center, place = np.array([0.2, -0.1, -6.0]), np.array([r["x"], r["y"], 4 + 0.1 * r["x"]])
        a, b, depth = rotation @ (place - center)
        ideal = np.array([a, b]) / depth
        pixel = ideal * (1 + camera[3] * (ideal @ ideal)) * camera[0] + camera[1:3]
        return tuple(calibration.ray_on_plane(rotation, center, camera, pixel, normal, -4.0))

    return rounded(each(o, "k", kernel, "x double, y double, z double"))


def _texture(seed: int, height: int = 96, width: int = 128) -> np.ndarray:
    """Smooth noise of a supplier, wider than a picture so that it can be shifted."""
    noise = np.random.default_rng(seed).random((height, width + 32)) * 255
    return (kernels._box(noise, 3) / 9).astype(np.uint8)


@query("SELECT s_suppkey AS k, 2 + s_suppkey % 4 AS shift, true AS tracked, true AS counted FROM supplier")
def shifted_pictures(spark, sf_dir):
    """Corners followed from a picture to the same one shifted by a few pixels: the median motion is the shift, and most corners are found again."""

    def kernel(r):
        k = int(r["k"])
        shift, wide = 2 + k % 4, _texture(k)
        first, second = wide[:, 8:136], wide[:, 8 - shift : 136 - shift]
        initial, tracked, ratio, motion = kernels.pair_metrics(np.ascontiguousarray(first), np.ascontiguousarray(second), 60)
        return round(motion * float(np.hypot(96, 128))), ratio >= 0.8, 20 <= tracked <= initial <= 60

    return each(V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", kernel, "shift long, tracked boolean, counted boolean")


@query(f"WITH {V.POINTS} SELECT point3d_id FROM c WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.2 AND 0.05 AND z BETWEEN -1 AND 1")
def cropped_cloud(spark, sf_dir):
    return clouds.cropped(V.points(spark, sf_dir), (-0.1, -0.2, -1.0), (0.1, 0.05, 1.0)).select("point3d_id")


# Whole commands: their files come back as rows


def _trajectory(spark, sf_dir) -> str:
    out = shared_path(spark, "trajectory")
    cli.trajectory_report(spark, SimpleNamespace(images_txt=f"{model_folder(spark, sf_dir)}/images.txt", output_dir=out, expected_images=None))
    return out


@query("SELECT o_orderkey AS image_id, printf('frame_%05d_t%09.3f.jpg', o_orderkey, o_orderkey / 5.0) AS image_name, CAST(-o_custkey AS DOUBLE) AS cx FROM orders")
def trajectory_csv(spark, sf_dir):
    rows = spark.read.option("header", True).schema("image_id long, image_name string, cx double, cy double, cz double").csv(f"{_trajectory(spark, sf_dir)}/trajectory.csv")
    return rows.select("image_id", "image_name", "cx")


@query("SELECT CAST(1200 AS BIGINT) AS width, CAST(800 AS BIGINT) AS height, count(*) > 1 AS drawn FROM orders")
def trajectory_picture(spark, sf_dir):
    """The PNG of the whole path, by Spark's image source: its size, and that not all of it is background."""
    p = spark.read.format("image").load(f"{_trajectory(spark, sf_dir)}/trajectory.png").select("image.*")
    return p.select(F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), (F.length(F.replace(F.hex("data"), F.lit("F8"), F.lit(""))) > 1000).alias("drawn"))


@query("WITH b AS (SELECT max(o_custkey) AS c FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 1)) SELECT o_orderkey AS frame_index, 'main' AS component, round(-o_custkey * CAST(0.5 AS DOUBLE), 6) AS x_m FROM orders UNION ALL SELECT o_orderkey, 'secondary', round((-1.5 * o_custkey + 1.5 * c - c) * CAST(0.5 AS DOUBLE), 6) FROM orders, b")
def merged_camera_csv(spark, sf_dir):
    from .roundtrips import _stitched

    out = shared_path(spark, "stitched")
    cli.write_stitch(spark, out, *_stitched(spark, sf_dir))
    rows = spark.read.option("header", True).schema("frame_index long, image_name string, x_m double, y_m double, z_m double, component string").csv(f"{out}/trajectory.csv")
    return rounded(rows.select("frame_index", "component", "x_m"))


def _keyframes(spark, sf_dir) -> str:
    """Keyframes of a folder with a picture a supplier, each moved on by three pixels, five a second."""

    def picture(r):
        k = int(r["k"])
        wide = _texture(1, 64, 96 + 3 * 64)
        at = 3 * (k % 64)
        return (sinks.png(np.repeat(wide[:, at : at + 96, None], 3, axis=2)),)

    root = shared_path(spark, "keyframes")
    made = each(V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", picture, "png binary").withColumn("file", F.format_string("frame_%05d_t%09.3f.png", "k", F.col("k") / 5))
    sinks.image_files(made, f"{root}/in", "file", "png")
    cli.select_keyframes(spark, SimpleNamespace(frames_dir=f"{root}/in", output_dir=f"{root}/out", min_interval_s=0.4, max_interval_s=1.2, target_motion_ratio=0.012, min_track_ratio=0.35, min_features=5, blur_percentile=20.0))
    return f"{root}/out"


@query("SELECT s_suppkey AS source_sequence, printf('frame_%05d_t%09.3f.png', s_suppkey, s_suppkey / 5.0) AS source_filename, round(s_suppkey / 5.0, 6) AS timestamp_s, true AS tracks, true AS copied FROM supplier")
def keyframe_csv(spark, sf_dir):
    """The keyframe table of the command: every frame but the first was compared with the last keyframe, and the selected ones, and only these, have a copy."""
    out = _keyframes(spark, sf_dir)
    kinds = {"source_sequence": "long", "timestamp_s": "double", "initial_tracked_features": "long", "tracked_features": "long", "track_ratio": "double", "selected": "boolean"}
    rows = spark.read.option("header", True).schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in cli.KEYFRAME_CSV)).csv(f"{out}/keyframes.csv")
    copies = files.binary(spark, f"{out}/frames", "*.png").select(F.concat(F.lit("frames/"), F.element_at(F.split("path", "/"), -1)).alias("output_filename"), F.lit(True).alias("_copy"))
    rows = rows.join(copies, "output_filename", "left")
    tracks = (F.col("reason") == "first_frame") | ((F.col("initial_tracked_features") >= F.col("tracked_features")) & (F.abs(F.col("tracked_features") / F.greatest("initial_tracked_features", F.lit(1)) - F.col("track_ratio")) < 1e-9) & (F.col("initial_tracked_features") > 0))
    return rows.select("source_sequence", "source_filename", "timestamp_s", tracks.alias("tracks"), (F.col("selected") == F.col("_copy").isNotNull()).alias("copied"))
