"""The engine's queries against DuckDB, and sources, sinks, kernels and streams on synthetic inputs."""

import json
import sqlite3
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from panoply.functions import calibration as C
from panoply.functions import exprs as X
from panoply.functions import kernels as K
from panoply.operators import clouds, graph, keyframes, mesh, pairs, sequence, trajectory
from panoply.plans.catalog import QUERIES, SQL
from panoply.schemas import ExtractionConfig, KeyframeConfig, Manifest, MetricReference
from panoply.sources import files, ranges, sinks
from panoply.streaming import keyframes as stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    return round(float(x), 4) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    a = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    order = [want.columns.index(c) for c in columns]
    b = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert a == b


def test_pair_ids(spark):
    ids = spark.createDataFrame([(2, 7), (7, 2)], "a long, b long").select(X.pair_id(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in ids] == [4294967301, 4294967301]
    with pytest.raises(Exception, match="positive"):
        spark.createDataFrame([(3, 3)], "a long, b long").select(X.pair_id(F.col("a"), F.col("b"))).collect()


def test_targeted_and_loop_pairs(spark):
    images = spark.createDataFrame([(0, i, f"frame_{n:05d}_t0.jpg") for i, n in ((1, 10), (2, 11), (3, 13), (4, 20), (5, 11))], "model_id long, image_id long, name string")
    got = {(r.id_a, r.id_b) for r in pairs.targeted(images, 10, 13, 2).collect()}
    assert got == {(1, 2), (1, 5), (2, 5), (2, 3), (5, 3)}
    with pytest.raises(ValueError):
        pairs.targeted(images, 5, 1, 2)
    with pytest.raises(ValueError):
        pairs.cross(images, (1, 9), (9, 12))
    names = spark.createDataFrame([(0, i, f"frame_{i:03d}.jpg") for i in range(20)], "model_id long, image_id long, name string")
    loop = sorted((r.a, r.b) for r in pairs.loop(names, 3).collect())
    assert len(loop) == 9 and loop[0] == ("frame_000.jpg", "frame_017.jpg") and loop[-1] == ("frame_002.jpg", "frame_019.jpg")


POSES = "# c\n1 1 0 0 0 0 0 0 1 frame_00000.jpg\n\n2 1 0 0 0 -1 0 0 1 frame_00001.jpg\n0 0 -1 1 2 5\n3 1 0 0 0 0 0 0 1 frame_00005.jpg\n"


def test_pose_files_and_trajectory(spark, tmp_path):
    (tmp_path / "images.txt").write_text(POSES)
    p = files.poses(spark, str(tmp_path)).withColumn("model_id", F.lit(1))
    r = trajectory.gates(trajectory.report(p, expected=spark.createDataFrame([(1, 3)], "model_id int, expected_images long"))).first()
    assert (r.registered_images, r.path_length_units, r.position_closure_error_percent, r.largest_frame_index_gap) == (3, 2.0, 0.0, 4)
    assert all(r.gates.values())
    assert [(o.u, o.v, o.point3d_id) for o in files.observations(spark, str(tmp_path)).collect()] == [(0.0, 0.0, -1), (1.0, 2.0, 5)]
    with pytest.raises(Exception, match="two poses"):
        trajectory.report(p.limit(1)).collect()
    (tmp_path / "images.txt").write_text("1 2 3\n")
    with pytest.raises(Exception, match="ten fields"):
        files.poses(spark, str(tmp_path)).collect()


def two_tetrahedra():
    t = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    faces = np.array([[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]])
    return np.vstack([t, t + [10, 0, 0]]), np.vstack([faces, faces + 4])


def test_mesh_file_and_report(spark, tmp_path):
    v, f = two_tetrahedra()
    head = "\n".join(["ply", "format binary_little_endian 1.0", "element vertex 8", "element face 8", *ranges.PROPERTIES, "end_header"]) + "\n"
    body = b"".join(struct.pack("<6d3B", *p, 0, 0, 1, 1, 2, 3) for p in v) + b"".join(struct.pack("<B3I", 3, *t) for t in f)
    (tmp_path / "m.ply").write_bytes(head.encode() + body)
    vs, ts = files.ply_vertices(spark, f"{tmp_path}/m.ply"), files.ply_triangles(spark, f"{tmp_path}/m.ply")
    labels = mesh.roots(vs, ts)
    areas = mesh.triangle_areas(vs, ts)
    table = mesh.component_table(vs, areas, labels)
    assert [(r.rank, r.vertices, r.vertex_fraction) for r in table.orderBy("rank").collect()] == [(1, 4, 0.5), (2, 4, 0.5)]
    assert mesh.sampled_gap(vs, labels, table).first().gap == 9.0
    g = mesh.gates(table, areas, mesh.edge_summary(ts)).first()
    assert g.watertight and not g.single_dominant_component_at_least_95_percent and g.no_degenerate_triangles
    assert [tuple(r) for r in files.ply_vertices(spark, f"{tmp_path}/m.ply", part=120).orderBy("vid").collect()] == [(i, *p) for i, p in enumerate(v.tolist())]
    assert files.ply_vertices(spark, f"{tmp_path}/m.ply", part=120).rdd.getNumPartitions() == 4
    for wrong, what in ((body[:-1], "early"), (body[:-4] + struct.pack("<I", 8), "absent"), (struct.pack("<d", np.nan) + body[8:], "finite"), (body[: 8 * 51] + b"\x04" + body[8 * 51 + 1 :], "triangles")):
        (tmp_path / "m.ply").write_bytes(head.encode() + wrong)
        with pytest.raises(Exception, match=what):
            files.ply_vertices(spark, f"{tmp_path}/m.ply").collect(), files.ply_triangles(spark, f"{tmp_path}/m.ply").collect()


def test_mesh_files_in_three_formats(spark, tmp_path):
    v, f = two_tetrahedra()
    vs = spark.createDataFrame([(10 * i, *p) for i, p in enumerate(v.tolist())], "vid long, x double, y double, z double").repartition(3)
    ts = spark.createDataFrame([(i, *(10 * k for k in t)) for i, t in enumerate(f.tolist())], "fid long, a long, b long, c long").repartition(2)
    sinks.mesh_ply(vs, ts, f"{tmp_path}/m.ply")
    assert [tuple(r) for r in files.ply_vertices(spark, f"{tmp_path}/m.ply").orderBy("vid").collect()] == [(i, *p) for i, p in enumerate(v.tolist())]
    assert [tuple(r) for r in files.ply_triangles(spark, f"{tmp_path}/m.ply").orderBy("fid").collect()] == [(i, *t) for i, t in enumerate(f.tolist())]
    sinks.mesh_obj(vs, ts, f"{tmp_path}/m.obj")
    lines = (tmp_path / "m.obj").read_text().splitlines()
    assert len(lines) == 16 and lines[0] == "v 0.000000000 0.000000000 0.000000000" and lines[8] == "f 1 2 3" and lines[-1] == "f 6 7 8"
    sinks.mesh_glb(vs, ts, f"{tmp_path}/m.glb")
    data = (tmp_path / "m.glb").read_bytes()
    magic, version, size, n = struct.unpack_from("<4s3I", data)
    scene = json.loads(data[20 : 20 + n])
    assert (magic, version, size) == (b"glTF", 2, len(data)) and scene["accessors"][0]["max"] == [11.0, 1.0, 1.0]
    body = data[28 + n :]
    assert np.allclose(np.frombuffer(body[: 12 * 8], "<f4").reshape(8, 3), v) and (np.frombuffer(body[12 * 8 :], "<u4").reshape(8, 3) == f).all()


def test_many_meshes_and_clouds_at_once(spark):
    v, f = two_tetrahedra()
    vs = spark.createDataFrame([(d, i, *(s * x for x in p)) for d, s in (("p", 1.0), ("q", 2.0)) for i, p in enumerate(v.tolist())], "d string, vid long, x double, y double, z double")
    ts = spark.createDataFrame([(d, i, *t) for d, n in (("p", 8), ("q", 4)) for i, t in enumerate(f.tolist()[:n])], "d string, fid long, a long, b long, c long")
    areas, labels = mesh.triangle_areas(vs, ts, ["d"]), mesh.roots(vs, ts, ["d"])
    table = mesh.component_table(vs, areas, labels, ["d"])
    got = {(r.d, r["rank"]): (r.root, r.vertices, r.triangles, r.vertex_fraction) for r in table.collect()}
    assert got[("p", 1)] == (0, 4, 4, 0.5) and got[("p", 2)] == (4, 4, 4, 0.5) and got[("q", 1)] == (0, 4, 4, 0.5) and len(got) == 7 and got[("q", 5)] == (7, 1, 0, 0.125)
    assert {r.d: r.gap for r in mesh.sampled_gap(vs, labels, table, by=["d"]).collect()} == {"p": 9.0, "q": 18.0}
    assert {r.d: r.watertight for r in mesh.gates(table, areas, mesh.edge_summary(ts, ["d"]), ["d"]).collect()} == {"p": True, "q": True}
    points = vs.withColumnRenamed("vid", "id")
    near = clouds.nearest(points.where("id = 0"), points.where("id > 0"), "id", ["d"])
    assert {r.d: r.nearest for r in near.collect()} == {"p": 1.0, "q": 2.0}


EDGES = {
    "chain": [(i, i + 1) for i in range(40)],
    "star": [(7, i) for i in range(8, 60)],
    "two smaller neighbours": [(5, 1), (5, 2)],
    "loops, repeats and nulls": [(3, 3), (4, 9), (9, 4), (4, 9), (None, 1), (2, None)],
    "random": [tuple(map(int, e)) for e in np.random.default_rng(3).integers(0, 300, (200, 2))],
    "empty": [],
}


@pytest.mark.parametrize("name", EDGES)
def test_components_against_union_find(spark, name):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in EDGES[name]:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = graph.connected(spark.createDataFrame(EDGES[name], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(root))


def test_stars(spark):
    is_star = lambda links: graph.stars(spark.createDataFrame(links, "u long, v long"))
    assert is_star([(2, 1), (3, 1), (9, 8)]) and is_star([])
    assert not is_star([(3, 2), (2, 1)]) and not is_star([(3, 1), (3, 2)])


def test_large_component_is_sampled_evenly(spark, monkeypatch):
    line = spark.range(9000).selectExpr("id as vid", "double(id) as x", "0D as y", "0D as z")
    far = spark.range(3).selectExpr("id + 9000 as vid", "double(id) + 9500 as x", "0D as y", "0D as z")
    labels = line.union(far).selectExpr("vid", "if(vid < 9000, 0, 9000) as root")
    table = spark.createDataFrame([(0, 1), (9000, 2)], "root int, rank int")
    places = {j * 8999 // 3999 for j in range(4000)}
    assert mesh.sampled_gap(line.union(far), labels, table).first().gap == 9500 - max(places)
    monkeypatch.setattr(mesh, "RANKED_IN_PLACE", 0)
    ts = spark.createDataFrame([(0, 0, 1, 2), (1, 5, 6, 7)], "fid long, a long, b long, c long")
    t = mesh.component_table(line, mesh.triangle_areas(line, ts), mesh.roots(line, ts))
    assert [(r["rank"], r.root, r.vertices) for r in t.orderBy("rank").limit(3).collect()] == [(1, 0, 3), (2, 5, 3), (3, 3, 1)]


def test_bundle_and_sparse_plan(spark, tmp_path):
    from panoply.plans import sparse

    for name, n in (("main", 3), ("side", 2)):
        (tmp_path / name / "images").mkdir(parents=True)
        (tmp_path / name / "sparse").mkdir()
        for i in range(n):
            (tmp_path / name / "images" / f"frame_{i:03d}.jpg").write_bytes(b"x")
        for x in files.MODEL_FILES if name == "main" else files.MODEL_FILES[:2]:
            (tmp_path / name / "sparse" / x).write_text("# x\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"components": {"main": {"registered_images": 3}, "side": {"registered_images": 3}, "gone": {"registered_images": 1}}}))
    got = {r.component: (r.images, list(r.missing), r.ok) for r in files.bundle(spark, str(tmp_path)).collect()}
    assert got == {"main": (3, [], True), "side": (2, ["points3D.txt"], False), "gone": (0, sorted(files.MODEL_FILES), False)}
    plan = sparse.commands(spark, "/w", sparse.SparseConfig(mapper_profile="fast", use_gpu=True)).orderBy("place").collect()
    assert [r.stage for r in plan] == ["feature_extractor", "sequential_matcher", "loop_pairs", "mapper"]
    assert plan[0].argv[:4] == ["colmap", "feature_extractor", "--database_path", "/w/database.db"] and plan[3].argv[-2:] == ["--Mapper.ba_global_max_refinements", "2"]
    assert plan[1].argv[plan[1].argv.index("--SiftMatching.use_gpu") + 1] == "1" and len(sparse.commands(spark, "/w", sparse.SparseConfig(), reuse=True).collect()) == 1
    assert [tuple(r) for r in sparse.loop_plan(spark, f"{tmp_path}/main/images", 10).collect()] == [("frame_000.jpg", "frame_002.jpg")]
    for wrong in ({"mapper_profile": "slow"}, {"camera_model": " "}, {"min_num_matches": 0}):
        with pytest.raises(ValueError):
            sparse.SparseConfig(**wrong)
    assert {r.path.rsplit("/", 1)[1]: r.length for r in files.digests(spark, f"{tmp_path}/main/images").collect()} == {f"frame_{i:03d}.jpg": 1 for i in range(3)}


def test_dense_clouds_are_cleaned_and_fused(spark):
    rng = np.random.default_rng(7)
    rows = [(c, *(rng.uniform(0, 1, 3) + o).tolist()) for c, o in (("main", 0.0), ("secondary", 0.5)) for _ in range(400)] + [("main", 50.0, 0.0, 0.0)]
    fused, summary = clouds.dense_summary(spark.createDataFrame(rows, "component string, x double, y double, z double"), "voxel", 0.1, 10, 2.5)
    got = {r.component: r for r in summary.collect()}
    cells = {c: {tuple(np.floor(np.array(r[1:]) / 0.1)) for r in rows if r[0] == c} for c in ("main", "secondary")}
    assert got["main"].input_points == 401 and got["main"].voxel_points == len(cells["main"]) and got["main"].max_x < 2
    assert 0 < fused.count() <= got["main"].clean_points + got["secondary"].clean_points


def test_scale_checks_are_validated(spark):
    for bad in ((" ", 1.0, 1.0), ("door", 0.0, 1.0), ("door", 1.0, -1.0), (None, 1.0, 1.0)):
        with pytest.raises(Exception, match="name|length"):
            clouds.valid_checks(spark.createDataFrame([(0, *bad)], "k int, name string, actual_m double, units double")).collect()


def test_session_gaps(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 4, 20, 23, 59)] + [(2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k int, t string").selectExpr("k", "timestamp(t) as t")
    got = sorted((r.k, str(r.start)[14:16], r.rows) for r in sequence.session_gaps(df, ["k"], "t", "5 minutes").collect())
    assert got == [(1, "00", 2), (1, "20", 2), (1, "59", 1), (2, "00", 1)]


def test_coverage_counts_boundaries_twice(spark):
    d = spark.createDataFrame([(1, float(t), True) for t in (0, 5, 10)], "k int, t double, s boolean")
    got = sequence.coverage_bins(d, ["k"], "t", "s", 5.0).orderBy("bin").collect()
    assert [(r.candidate_count, r.end_s) for r in got] == [(2, 5.0), (2, 10.0)]


@pytest.mark.parametrize("n,limit", [(10, 4), (7, 7), (5, 9), (100, 7), (3, 1), (1, 1)])
def test_even_sample(spark, n, limit):
    got = [r.i for r in sequence.even_sample(spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i")), ["k"], ["i"], limit).orderBy("i").collect()]
    want = sorted({j * (n - 1) // (limit - 1) for j in range(limit)}) if 1 < limit < n else ([0] if limit == 1 else list(range(n)))
    assert got == want


def test_scale_example(spark):
    c = spark.createDataFrame([("d", "door", 0.9144, 0.36, 1.2192 / 0.5)], "k string, name string, actual_m double, units double, meters_per_unit double")
    r = clouds.scale_checks(c, "k").first()
    assert round(r.estimated_m, 6) == 0.877824 and round(r.percent_error, 6) == 4.0


def test_sqlite_source_and_sink(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "m.db")
    db.executescript("create table images(image_id integer primary key, name text); create table matches(pair_id integer primary key); create table two_view_geometries(pair_id integer primary key); insert into images values (1,'frame_00010.jpg'),(2,'frame_00011.jpg'),(4,'frame_00020.jpg'); insert into matches values (2147483649),(99); insert into two_view_geometries values (99)")
    db.commit()
    db.close()
    images = files.sqlite_table(spark, f"{tmp_path}/m.db", "select image_id, name from images", "image_id long, name string").withColumn("model_id", F.lit(0))
    plan = pairs.targeted(images, 10, 13, 2)
    assert sinks.delete_pairs(tmp_path / "m.db", plan) == {"planned": 1, "matches_removed": 1, "geometries_removed": 0, "integrity": "ok"}


def test_logs_points_cameras_and_reports(spark, tmp_path):
    (tmp_path / "log.txt").write_text("Registered images: 812\nPoints: 153204\nMean track length: 4.6082\nMean reprojection error: 0.842px\n")
    r = files.analyzer_log(spark, f"{tmp_path}/log.txt").first()
    assert (r.registered_images, r.points, r.observations, r.mean_reprojection_error_px) == (812, 153204, None, 0.842)
    (tmp_path / "points3D.txt").write_text("# x\n7 1.5 2 3 10 20 30 0.1 1 2\n")
    assert files.points3d(spark, f"{tmp_path}/points3D.txt").first().point3d_id == 7
    (tmp_path / "cameras.txt").write_text("1 SIMPLE_RADIAL 640 480 500 320 240 0.01\n")
    assert files.cameras(spark, f"{tmp_path}/cameras.txt").first().params == [500.0, 320.0, 240.0, 0.01]
    got = sinks.json_report(spark, spark.createDataFrame([(1, None)], "a int, b double"), f"file://{tmp_path}/r.json")
    assert got == {"a": 1, "b": None} and json.loads((tmp_path / "r.json").read_text()) == got
    with pytest.raises(FileExistsError):
        sinks.refuse_non_empty(spark, f"file://{tmp_path}")
    cloud = np.random.default_rng(1).standard_normal((300, 3)) * (9, 3, 0.1)
    df = spark.createDataFrame([(i, *p, 10, 20, i % 250) for i, p in enumerate(cloud.tolist())], "i long, x double, y double, z double, red int, green int, blue int")
    pixels = sinks.raster(df, ["red", "green", "blue"], "i", 120, 80, 10)
    u = (cloud - cloud.mean(0)) @ np.linalg.svd(cloud - cloud.mean(0), full_matrices=False)[2][:2].T
    scale = min(100 / np.ptp(u[:, 0]), 60 / np.ptp(u[:, 1]))
    want = [{tuple(q) for q in np.rint(np.column_stack([10 + (sx * u[:, 0] - (sx * u[:, 0]).min()) * scale, 70 - (sy * u[:, 1] - (sy * u[:, 1]).min()) * scale])).astype(int).tolist()} for sx in (1, -1) for sy in (1, -1)]
    assert {(r.px, r.py) for r in pixels.collect()} in want
    picture = sinks.canvas(pixels, 120, 80, 248)
    assert ((picture != 248).any(axis=2).sum() == pixels.count()) and sinks.png(picture).startswith(b"\x89PNG") and sinks.canvas(pixels, 120, 80, 248, ((1, 2, 3), (4, 5, 6), (7, 8, 9))).shape == (80, 120, 3)
    assert sinks.raster(df.limit(0), ["red", "green", "blue"], "i", 120, 80).count() == 0


def test_manifest_and_configs():
    ref = (MetricReference("tape", 1.2192, "on the floor"),)
    assert Manifest("d", "v.mov", "phone", "hall", "loop", ref).schema_version == 1
    for bad in (lambda: Manifest("d", "v", "p", "h", "l", ()), lambda: Manifest(" ", "v", "p", "h", "l", ref), lambda: MetricReference("t", 0.0, "d"), lambda: MetricReference("t", 1.0, " "), lambda: KeyframeConfig(analysis_width=63), lambda: KeyframeConfig(motion_threshold=0.0), lambda: KeyframeConfig(min_features=0), lambda: KeyframeConfig(min_features=601), lambda: ExtractionConfig(target_fps=0), lambda: KeyframeConfig(min_interval_s=2, max_interval_s=1)):
        with pytest.raises(ValueError):
            bad()


def texture(h=120, w=160, seed=4):
    rng = np.random.default_rng(seed)
    return K._box(rng.integers(0, 255, (h, w)).astype(float), 5)[:, :] / 25


def test_kernels_recover_motion_and_tape():
    t = texture(140, 180)
    a, b = t[10:130, 10:170].astype(np.uint8), t[8:128, 7:167].astype(np.uint8)
    n, tracked, ratio, motion = K.pair_metrics(a, b)
    assert n > 20 and ratio > 0.5 and abs(motion * np.hypot(120, 160) - np.hypot(2, 3)) < 0.5
    assert K.pair_metrics(np.full((60, 60), 7, np.uint8), np.full((60, 60), 7, np.uint8)) == (0, 0, 0.0, 0.0)
    assert K.laplacian_variance(np.full((9, 9), 3, np.uint8)) == 0 and K.shrink(a, 80).shape == (60, 80)
    image = np.zeros((400, 600, 3), np.uint8)
    for x in range(80, 521):
        y = 310 + round((x - 80) * 20 / 440)
        image[y - 6 : y + 6, x] = (0, 220, 255)
    ends = sorted(p[0] for p in C.tape_endpoints(image))
    assert abs(ends[0] - 80) < 8 and abs(ends[1] - 520) < 8


def test_plane_and_ray():
    rng = np.random.default_rng(3)
    p = np.vstack([np.column_stack([rng.uniform(-5, 5, (200, 2)), rng.normal(0, 0.01, 200)]), rng.uniform(-5, 5, (60, 3))])
    n, offset, inside, rmse = C.floor_plane(p, trials=500)
    assert abs(abs(n[2]) - 1) < 1e-2 and inside[:200].mean() > 0.9 and rmse < 0.05
    hit = C.ray_on_plane(np.eye(3), np.array([0, 0, -2.0]), (500, 320, 240, 0.0), np.array([320, 240]), np.array([0, 0, 1.0]), 0.0)
    assert np.allclose(hit, 0)


def riff(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def small_jpeg(data):
    """A picture by its markers alone: frame header, scan, end."""
    return b"\xff\xd8\xff\xc0\0\x0b\x08\0\x78\0\xa0\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0" + data + b"\xff\xd9"


def test_video_container(spark, tmp_path):
    avih = struct.pack("<10I", 100_000, 0, 0, 0, 30, 0, 1, 0, 160, 120) + b"\0" * 16
    strh = b"vidsMJPG" + b"\0" * 12 + struct.pack("<2I", 1, 10) + b"\0" * 28
    head = riff(b"LIST", b"hdrl" + riff(b"avih", avih) + riff(b"LIST", b"strl" + riff(b"strh", strh)))
    movi = riff(b"LIST", b"movi" + b"".join(riff(b"00dc", small_jpeg(bytes([i]) * 3)) for i in range(20)))
    more = riff(b"LIST", b"movi" + riff(b"ix00", b"\0" * 24) + b"".join(riff(b"00dc", small_jpeg(bytes([i]) * 3)) for i in range(20, 30)))
    (tmp_path / "v.avi").write_bytes(riff(b"RIFF", b"AVI " + head + movi) + riff(b"RIFF", b"AVIX" + more))
    m = files.video_metadata(spark, f"{tmp_path}/v.avi", full_decode=True).first()
    assert (m.width, m.height, m.orientation, m.fps, m.declared_frames, m.decoded_frames, m.duration_s, m.complete_decode) == (160, 120, "landscape", 10.0, 30, 30, 3.0, True)
    f = files.video_frames(spark, f"{tmp_path}/v.avi", ExtractionConfig(target_fps=2.0)).orderBy("sequence").collect()
    assert [r.source_frame for r in f] == [0, 5, 10, 15, 20, 25] and f[1].filename == "frame_00001_t00000.500.jpg"
    assert [bytes(r.jpeg) for r in f] == [small_jpeg(bytes([i]) * 3) for i in (0, 5, 10, 15, 20, 25)]
    parts = files.video_frames(spark, f"{tmp_path}/v.avi", ExtractionConfig(target_fps=10.0, start_s=1.0, end_s=2.5), part=80)
    assert [r.source_frame for r in parts.orderBy("sequence").collect()] == list(range(10, 25)) and parts.rdd.getNumPartitions() > 3
    other = files.video_frames(spark, f"{tmp_path}/v.avi", ExtractionConfig(), decoder=lambda path, cfg: [(7, 0.7, b"j"), (9, 0.9, b"k")])
    assert [(r.sequence, r.source_frame, r.filename) for r in other.collect()] == [(0, 7, "frame_00000_t00000.700.jpg"), (1, 9, "frame_00001_t00000.900.jpg")]
    assert not ranges.whole_jpeg(small_jpeg(b"a")[:-2]) and not ranges.whole_jpeg(b"\xff\xd8\xff\xd9")
    with pytest.raises(Exception, match="no frames"):
        files.video_frames(spark, f"{tmp_path}/v.avi", ExtractionConfig(start_s=9.0)).collect()


class Counted:
    """A file that notes how it is read."""

    def __init__(self, data):
        self.data, self.reads = data, []

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.reads.append((at, n))
        return self.data[at : at + n]


def indexed_video(n=40, second=25, broken=False):
    """An AVI of n pictures in two segments whose index of indexes names one index a segment; sound lies between the pictures, and picture 3 has no bytes."""
    strh = b"vidsMJPG" + b"\0" * 12 + struct.pack("<2I", 1, 10) + b"\0" * 28
    avih = struct.pack("<10I", 100_000, 0, 0, 0, n, 0, 1, 0, 160, 120) + b"\0" * 16
    body = lambda i: b"" if i == 3 else small_jpeg(bytes([i]) * (3 + i % 2))

    def head(supers):
        indx = struct.pack("<HBBI4s12x", 4, 0, 0, len(supers), b"00dc") + b"".join(struct.pack("<Q2I", *x) for x in supers)
        return riff(b"LIST", b"hdrl" + riff(b"avih", avih) + riff(b"LIST", b"strl" + riff(b"strh", strh) + riff(b"indx", indx)))

    out, supers, start = b"", [], 12 + len(head([(0, 0, 0)] * 2))
    for a, b in ((0, second), (second, n)):
        start += 12 if a else 0  # the second segment's own header
        inside, entries = b"", []
        for i in range(a, b):
            inside += riff(b"01wb", b"sound")
            entries.append((len(inside) + 8, len(body(i))))
            inside += riff(b"00dc", body(i))
        base = start + 12
        index = struct.pack("<HBBI4sQ4x", 2, 0, 1, len(entries), b"00dc", base + broken) + b"".join(struct.pack("<2I", x, size | (i % 2) << 31) for i, (x, size) in enumerate(entries))
        supers.append((base + len(inside), len(index) + 8, b - a))
        part = riff(b"LIST", b"movi" + inside + riff(b"ix00", index))
        start += len(part)
        out += riff(b"RIFF", b"AVIX" + part) if a else part
        first = len(part) if not a else first
    return riff(b"RIFF", b"AVI " + head(supers) + out[:first]) + out[first:], [body(i) for i in range(n) if i != 3]


def test_video_frames_by_index_and_filters(spark, tmp_path):
    data, pictures = indexed_video()
    f = Counted(data)
    info, frames = ranges.avi_frames(f)
    assert [data[a : a + n] for a, n in frames] == pictures and info["declared_frames"] == 40
    by_index = len(f.reads)
    g = Counted(indexed_video(broken=True)[0])
    assert [g.data[a : a + n] for a, n in ranges.avi_frames(g)[1]] == pictures and len(g.reads) > by_index + 60  # an index that points elsewhere isn't believed
    cut = Counted(data[: frames[30][0] + 2])  # the recording broke off: the second index is gone
    assert ranges.avi_frames(cut)[1][:30] == frames[:30]
    (tmp_path / "v.avi").write_bytes(data)
    kept = lambda where: files.video_frames(spark, f"{tmp_path}/v.avi", ExtractionConfig(target_fps=5.0, start_s=0.4)).where(where)
    every = [r.asDict() for r in kept("true").orderBy("sequence").collect()]
    assert [r["source_frame"] for r in every] == list(range(4, 39, 2)) and [bytes(r["jpeg"]) for r in every] == pictures[4:39:2]
    for where, test in (
        ("source_frame >= 10 and source_frame < 20", lambda r: 10 <= r["source_frame"] < 20),
        ("timestamp_s between 1.2 and 2.05 and filename like '%1.8%'", lambda r: 1.2 <= r["timestamp_s"] <= 2.05 and "1.8" in r["filename"]),
        ("sequence in (0, 3, 99) or sequence = 5", lambda r: r["sequence"] in (0, 3, 5)),
        ("sequence in (2, 3) and timestamp_s > 0.8", lambda r: r["sequence"] in (2, 3) and r["timestamp_s"] > 0.8),
        ("timestamp_s < cast('NaN' as double) and source_frame > 30", lambda r: r["source_frame"] > 30),
        ("source_frame = 11", lambda r: False),
    ):
        assert [r.asDict() for r in kept(where).orderBy("sequence").collect()] == [r for r in every if test(r)], where
    plan = kept("source_frame >= 10 and source_frame < 12")._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan and "BatchScan" in plan and "source_frame" in plan
    reader = ranges._AviReader({"path": f"{tmp_path}/v.avi", "part": 1})
    rest = [EqualTo(("filename",), "x")]
    assert list(reader.pushFilters([GreaterThanOrEqual(("source_frame",), 10), LessThan(("timestamp_s",), 1.25), *rest])) == rest
    assert [x[0] for p in reader.partitions() for x in p.frames] == [10, 11, 12]


def test_running_sums(spark):
    rows = [(k, i, (i * 7) % 5) for k in ("a", None) for i in range(40)] + [("b", 1, None), ("b", 2, 4), ("b", 3, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(4)
    got = {(r["k"], r["i"]): r["s"] for r in sequence.running(df, ["k"], ["i"], F.col("v"), "s").collect()}
    assert got == {(k, i): sum(w or 0 for q, j, w in rows if q == k and j < i) for k, i, _ in rows}
    assert sequence.running(df.limit(0), ["k"], ["i"], F.col("v"), "s").count() == 0


def test_video_sink_writes_an_index(spark, tmp_path):
    pictures = [small_jpeg(bytes([i % 250]) * (3 + i % 2)) for i in range(300)]
    df = spark.createDataFrame([(i // 2, bytearray(p) if i != 7 else None) for i, p in enumerate(pictures)], "k int, jpeg binary").repartition(5)
    sinks.avi(df, f"file://{tmp_path}/v.avi", ["k"], "jpeg", 10, 160, 120)
    f = Counted((tmp_path / "v.avi").read_bytes())
    info, frames = ranges.avi_frames(f)
    got = [f.data[a : a + n] for a, n in frames]
    assert info["declared_frames"] == 300 and len(got) == 299 and len(f.reads) < 30
    assert sorted(got) == sorted(p for i, p in enumerate(pictures) if i != 7) and [set(got[2 * k : 2 * k + 2]) for k in range(3)] == [set(pictures[2 * k : 2 * k + 2]) for k in range(3)]
    assert frames == [x for b, n in [(b, n) for k, b, n in ranges._chunks(f, 0, f.size()) if k == b"movi"] for x in ranges._walked(f, b + 4, b + n)]
    sinks.avi(df.limit(0), f"file://{tmp_path}/e.avi", ["k"], "jpeg", 10, 160, 120)
    assert ranges.avi_frames(Counted((tmp_path / "e.avi").read_bytes()))[1] == []


def test_keyframe_stream_agrees_with_the_batch_rules(spark, tmp_path):
    from panoply.plans.queries import CFG
    from panoply.plans.views import frames

    f = frames(spark, DATA).select("video_id", "sequence", "timestamp_s", "sharpness", "feature_count").where("video_id < 5").cache()
    f.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = stream.select_stream(spark.readStream.schema(f.schema).parquet(f"{tmp_path}/in"), CFG, blur=20.0)
    q = s.writeStream.format("memory").queryName("kf").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.video_id, r.sequence): r.reason for r in spark.table("kf").collect()}
    rows, last = {}, {}
    for r in sorted((r.asDict() for r in f.collect()), key=lambda r: (r["timestamp_s"], r["sequence"])):
        selected, reason, *_ = keyframes.decide(r, last.get(r["video_id"]), False, 20.0, CFG, keyframes.value_pair())
        rows[(r["video_id"], r["sequence"])] = reason
        if selected:
            last[r["video_id"]] = r
    assert got == rows


def plain_fold(rows, cfg, blur, pair):
    """reason by (time, sequence), one row after the other."""
    rows, last, out = sorted(rows, key=lambda r: (r["timestamp_s"], r["sequence"])), None, {}
    for i, r in enumerate(rows):
        d = keyframes.decide(r, last, i == len(rows) - 1, blur, cfg, pair)
        out[r["timestamp_s"], r["sequence"]] = d.selected, d.reason, round(d.elapsed_s, 6), round(d.motion_ratio, 6), d.tracked_features
        last = r if d.selected else last
    return out


@pytest.mark.parametrize("span", [2, 5, 64])
def test_keyframes_in_blocks_equal_one_fold(spark, span):
    rng = np.random.default_rng(span)
    cfg = KeyframeConfig(min_interval_s=0.4, max_interval_s=1.2, motion_threshold=10.0, min_features=20, min_track_ratio=0.35)
    rows = []
    for video in range(3):
        gaps = rng.choice([0.0, 0.1, 0.2, 0.35, 1.0, 3.0, 40.0], 300, p=[0.1, 0.3, 0.3, 0.2, 0.05, 0.04, 0.01])
        times = np.round(np.cumsum(gaps), 3)
        rows += [(video, i, float(t), float(v), int(k)) for i, (t, v, k) in enumerate(zip(times, rng.normal(100, 40, 300), rng.integers(10, 60, 300), strict=True))]
    rows.append((9, 0, 5.0, 1.0, 30))
    frames = spark.createDataFrame(rows, "video_id long, sequence long, timestamp_s double, sharpness double, feature_count long")
    pair = keyframes.value_pair()
    got = {}
    for r in keyframes.select(frames.repartition(5), cfg, span=span).collect():
        got.setdefault(r.video_id, {})[r.timestamp_s, r.sequence] = r.selected, r.reason, round(r.elapsed_s, 6), round(r.motion_ratio, 6), r.tracked_features
    names = ["video_id", "sequence", "timestamp_s", "sharpness", "feature_count"]
    for video in (0, 1, 2, 9):
        own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == video]
        blur = float(np.percentile([r["sharpness"] for r in own], cfg.blur_percentile))
        assert got[video] == plain_fold(own, cfg, blur, pair)


def test_keyframe_blocks_with_pixels(spark):
    rng = np.random.default_rng(12)
    texture = (rng.random((60, 120)) * 255).astype(np.uint8)
    shots = [np.ascontiguousarray(np.roll(texture, int(2.5 * i), 1)[:, :80]) for i in range(24)]
    rows = [(0, i, i * 0.2, float(50 + i % 7), 100, shot.tobytes(), 60, 80) for i, shot in enumerate(shots)]
    frames = spark.createDataFrame(rows, "video_id long, sequence long, timestamp_s double, sharpness double, feature_count long, gray binary, height int, width int")
    cfg, pair = KeyframeConfig(min_interval_s=0.4, max_interval_s=1.0, motion_threshold=0.03, min_features=1, blur_percentile=0.0, min_track_ratio=0.1), keyframes.pixel_pair(100)
    got = {(r.timestamp_s, r.sequence): (r.selected, r.reason, round(r.elapsed_s, 6), round(r.motion_ratio, 6), r.tracked_features) for r in keyframes.select(frames, cfg, pair=pair, span=2).collect()}
    names = ["video_id", "sequence", "timestamp_s", "sharpness", "feature_count", "gray", "height", "width"]
    assert got == plain_fold([dict(zip(names, r, strict=True)) for r in rows], cfg, 50.0, pair)


def test_quantiles_are_exact_at_any_size(spark):
    rng = np.random.default_rng(2)
    groups = {"one": [3.5], "two": [1.0, 2.0], "equal": [7.0] * 9000, "many": rng.normal(size=30_000).tolist(), "hot": [0.0] * 20_000 + rng.random(15_000).tolist(), None: [4.0, 1.0, 2.0], "odd": rng.integers(0, 5, 7001).astype(float).tolist()}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("empty", None), ("two", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: list(r)[1:] for r in sequence.quantiles(df, ["k"], "v", shares).collect()}
    assert got.pop("empty") == [None] * 5
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, list(shares.values())), rtol=0, atol=1e-12), k
    every = [v for _, v in rows if v is not None]
    assert np.allclose(list(sequence.quantiles(df, [], "v", shares).first()), np.quantile(every, list(shares.values())), rtol=0, atol=1e-12)
    assert list(sequence.quantiles(df.limit(0), [], "v", shares).first()) == [None] * 5 and sequence.quantiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_values_before_and_islands_across_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(v) if v > 2 else None) for k in ("a", None) for i, v in enumerate(rng.integers(0, 9, 3000))]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(6)
    got = {(r.k, r.i): (r.held, r.last.v if r.last else "none") for r in sequence.before(df, ["k"], ["i"], held=F.col("v"), last=F.struct("v")).collect()}
    held, last = {}, {}
    for k, i, v in rows:
        assert got[k, i] == (held.get(k), last.get(k, "none"))
        held[k], last[k] = v if v is not None else held.get(k), v
    runs = sequence.islands(df, ["k"], ["i"], F.col("v") > 4, "i")
    want = []
    for n, (k, i, v) in enumerate(rows):
        on = v is not None and v > 4
        if on and (i == 0 or not (rows[n - 1][2] or 0) > 4):
            want.append([k, i - 1 if i else None, i, i, 0])
        if on:
            want[-1][3], want[-1][4] = i, want[-1][4] + 1
    key = lambda r: (r[0] or "", r[2])
    assert sorted(map(tuple, runs.collect()), key=key) == sorted(map(tuple, want), key=key)
    assert sequence.islands(df.limit(0), ["k"], ["i"], F.col("v") > 4, "i").count() == 0


def plain_records(text):
    """(head fields, points fields) of a pose file, line by line."""
    lines, out = text.split("\n"), []
    while lines:
        head = lines.pop(0).strip()
        if head and not head.startswith("#"):
            out.append((head.split(maxsplit=9), lines.pop(0).split() if lines else []))
    return out


def test_pose_files_split_anywhere(spark, tmp_path):
    rng = np.random.default_rng(1)
    text = "# poses\n\n"
    for i in range(40):
        marks = " ".join(f"{u:.1f} {v:.1f} {p}" for u, v, p in zip(rng.random(3), rng.random(3), rng.integers(-1, 9, 3), strict=True))
        name = ["a b.jpg", "# odd.jpg", "1 2 3"][i % 3]
        points = ["", marks, f"# {i} 0", "1 1 0 0 0 0 0 0 1"][i % 4] if i % 4 != 2 else ""
        text += f"{i} 1 0 0 0 {i} 0 0 1 {name}\n{points}\n" + ["", "\n", "# note\n", "  \n\n"][i % 4]
    text += "99 1 0 0 0 7 0 0 1 last.jpg"
    (tmp_path / "images.txt").write_text(text)
    want = [(int(h[0]), h[9], float(h[5])) for h, _ in plain_records(text)]
    seen = [(int(h[0]), k, float(p[3 * k])) for h, p in plain_records(text) for k in range(len(p) // 3)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (17, 50, 64, 97, 1000, 10_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            p = files.poses(spark, str(tmp_path))
            assert size > 100 or p.rdd.getNumPartitions() > 4
            assert sorted((r.image_id, r.image_name, r.t[0]) for r in p.collect()) == sorted(want)
            assert sorted((r.image_id, r.ordinal, r.u) for r in files.observations(spark, str(tmp_path)).collect()) == sorted(seen)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    (tmp_path / "images.txt").write_text("# a\n\n" + "1 1 0 0 0 0 0 0 1 a\n\n" * 30 + "2 1 0 0\n")
    with pytest.raises(Exception, match="line 63: a pose needs ten fields"):
        files.poses(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("rows", [40, 300, 10**6])
def test_neighbours_over_many_ranges(spark, rows):
    """Dense and empty places, ties, copies, odd coordinates; two datasets; queries far from all points."""
    from panoply.operators.neighbours import nearest_points

    rng = np.random.default_rng(6)
    cloud = np.round(np.vstack([rng.normal(0, 0.01, (150, 3)), rng.random((120, 3)) * 5, np.zeros((12, 3)), np.full((30, 3), 2.0) + rng.normal(0, 1e-3, (30, 3))]), 4)
    data = [("a" if i % 3 else "b", i, *map(float, p)) for i, p in enumerate(cloud)]
    df = spark.createDataFrame([*data, ("a", 998, None, 0.0, 0.0), ("a", 999, float("inf"), 0.0, float("nan"))], "d string, id long, x double, y double, z double").repartition(3)
    queries = spark.createDataFrame([("a", i, float(i * 7), 0.0, -3.0) for i in range(40)] + [("c", 77, 0.0, 0.0, 0.0)], "d string, id long, x double, y double, z double")
    for q, q_rows, k, radius in ((df, data, 9, float("inf")), (df, data, 40, 0.05), (queries, [("a", i, i * 7.0, 0.0, -3.0) for i in range(40)], 3, float("inf"))):
        got = {(r.d, r.id): [tuple(p) for p in r.near] for r in nearest_points(q, df, "id", k, radius, ["d"], rows).collect()}
        want = {}
        for d, i, *at in q_rows:
            own = sorted((float(np.sqrt(((np.array(p) - at) ** 2).sum())), *p) for e, _, *p in data if e == d)
            near = [x for x in own if x[0] <= radius][:k]
            if near:
                want[d, i] = near
        assert got.keys() == want.keys()
        for key in want:
            assert np.allclose(got[key], want[key], rtol=0, atol=1e-12), key


def test_frame_stream_takes_each_frame_once(spark, tmp_path):
    def run(per):
        out = files.candidates_stream(spark, f"{tmp_path}/in", per).select("sequence", F.length("content").alias("size"))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["sequence"], r["size"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(5):
        (tmp_path / "in" / f"frame_{i:05d}_t00000.{i}00.jpg").write_bytes(b"x" * (i + 1))
    (tmp_path / "in" / "frame_1.gif").write_bytes(b"no")
    assert run(2) == [(i, i + 1) for i in range(5)]
    assert run(2) == [(i, i + 1) for i in range(5)]
    (tmp_path / "in" / "deep" / "FRAME_00007_t3.5.PNG").write_bytes(b"1234567")
    (tmp_path / "in" / ".frame_00008_t4.0.png").write_bytes(b"unfinished")
    assert run(1) == [*((i, i + 1) for i in range(5)), (7, 7)]
