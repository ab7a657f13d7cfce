"""Neighbours of clouds with many points at one place."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from panoply.operators import clouds
from panoply.operators.neighbours import nearest_points, search


def test_search_counts_copies():
    points = np.array([[0.0, 0, 0], [1.0, 0, 0], [5.0, 0, 0]])
    got = search(points[:1], points, 4, 10.0, np.array([2, 9, 1]))
    assert got[0][:, 0].tolist() == [0, 0, 1, 1]


@pytest.mark.parametrize("rows", [100, 10**6])
def test_nearest_points_with_copies(spark, rows):
    rng = np.random.default_rng(5)
    places = np.round(rng.random((60, 3)), 3)
    xyz = places[rng.integers(0, 60, 400)]
    df = spark.createDataFrame([(i, i % 2, *map(float, p)) for i, p in enumerate(xyz)], "id long, g long, x double, y double, z double")
    got = nearest_points(df, df, "id", 9, 0.4, ["g"], rows).select("id", "near.d").collect()
    assert len(got) == 400
    for r in got:
        d = np.sqrt(((xyz[r.id % 2 :: 2] - xyz[r.id]) ** 2).sum(1))
        assert np.allclose(r.d, np.sort(d[d <= 0.4])[:9]), r.id


def test_normals_come_with_their_moments(spark):
    df = spark.range(30).select("id", (F.col("id") % 6).cast("double").alias("x"), F.floor(F.col("id") / 6).cast("double").alias("y"), F.lit(2.0).alias("z"))
    for r in clouds.with_normals(clouds.neighbour_moments(df, "id", 2.0)).collect():
        assert abs(abs(r.nz) - 1) < 1e-9 and r.zz == 0 and r.neighbours >= 3


def test_a_range_is_searched_in_little_memory(tmp_path):
    """A worker that may take 1 GB finds forty neighbours of each of 40,000 points: lists are handed on in parts, not held all at once."""
    code = """
from pyspark.sql import SparkSession, functions as F
from panoply.operators.neighbours import nearest_points
spark = SparkSession.builder.master("local[1]").config("spark.executor.pyspark.memory", "1g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", FOLDER).getOrCreate()
df = spark.range(40_000).select("id", *[F.rand(s).alias(a) for s, a in enumerate("xyz")])
df.write.parquet(FOLDER + "/points")
df = spark.read.parquet(FOLDER + "/points")
print("found", nearest_points(df, df, "id", 40, rows=10**6).agg(F.sum(F.size("near"))).first()[0])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", code.replace("FOLDER", repr(str(tmp_path)))], env=env, capture_output=True, text=True, timeout=300)
    assert "found 1600000" in run.stdout, run.stderr[-2000:]


def test_a_range_that_many_queries_reach_into(spark):
    """Queries far from the few points all visit the same range, by several tasks; the lists are those of brute force."""
    rng = np.random.default_rng(8)
    points = np.round(rng.random((90, 3)), 3)
    asked = np.round(rng.random((400, 3)) * 9, 3)
    frame = lambda a: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id long, x double, y double, z double")
    got = {r.id: r.d for r in nearest_points(frame(asked), frame(points), "id", 7, rows=50).select("id", "near.d").collect()}
    assert len(got) == 400
    for i, q in enumerate(asked):
        assert np.allclose(got[i], np.sort(np.sqrt(((points - q) ** 2).sum(1)))[:7], rtol=0, atol=1e-12), i


def test_mean_distances_carry_no_places(spark):
    """The neighbours' coordinates are not sent along where only distances are asked for; the means are those of brute force."""
    xyz = np.round(np.random.default_rng(9).random((150, 3)), 2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    found = nearest_points(df, df, "id", 20, rows=40, places=False)
    assert found.schema["near"].dataType.simpleString() == "array<struct<d:double>>"
    want = {i: np.sort(np.sqrt(((xyz - p) ** 2).sum(1)))[:20] for i, p in enumerate(xyz)}
    got = {r.id: r.d for r in found.select("id", "near.d").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=0, atol=1e-12) for i in want)
    means = clouds.neighbour_distance(df, "id")
    assert all(abs(r.mean_distance - want[r.id].mean()) < 1e-12 for r in means.collect())


def test_visitors_of_one_range_are_dealt_to_several_tasks(spark, monkeypatch):
    """A thousand queries beside few points reach into the same ranges; no group of a task's visitors is much larger than a range."""
    from panoply.operators import neighbours

    held, keep = {}, neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, tag: held.setdefault(tag, keep(df, tag)))
    monkeypatch.setattr(neighbours, "discard", lambda df: None)
    places = [(i, *map(float, p)) for i, p in enumerate(np.random.default_rng(2).random((1000, 3)))]
    asked = spark.createDataFrame(places, "id long, x double, y double, z double")
    assert nearest_points(asked, asked.where("id < 60"), "id", 20, rows=100).count() == 1000
    guests = held["guests"]
    visits = [r["count"] for r in guests.groupBy(*[c for c in ("_range", "_part") if c in guests.columns]).count().collect()]
    assert sum(visits) > 2000 and max(visits) <= 300


def test_outliers_of_a_cloud_in_several_ranges(spark, monkeypatch):
    xyz = np.vstack([np.random.default_rng(3).random((200, 3)), [[4, 4, 4], [9, 0, 0], [-3, 2, 1]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    few = lambda *a, **k: nearest_points(*a, **k, rows=60)
    monkeypatch.setattr(clouds, "nearest_points", few)
    d = np.array([np.sort(np.sqrt(((xyz - p) ** 2).sum(1)))[:20].mean() for p in xyz])
    assert {r.id for r in clouds.without_outliers(df, "id").collect()} == set(np.flatnonzero(d < d.mean() + 2.5 * d.std(ddof=1)).tolist())
