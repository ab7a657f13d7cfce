"""Registered queries of file sources and sinks, kernels, streams and composites: tables go through the files and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import kernels, tables
from ..operators import clouds, keyframes, mesh, pairs, sequence
from ..schemas import ExtractionConfig
from ..session import shared_path, written
from ..sources import files, sinks
from ..streaming import keyframes as streams
from . import sparse, stitch
from . import views as V
from .queries import _MESH, _STORED, BINS, CFG, CHECKS, KEYFRAMES, SQL, query, rounded

# Text files of a sparse model


def model_folder(spark: SparkSession, sf_dir: str) -> str:
    """A sparse model from the tables: a pose for each order, with its lines as observations; a point for each part; one camera."""
    folder = shared_path(spark, "model")
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    marks = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", F.concat_ws(" ", "l_extendedprice", (F.col("l_quantity") * 20).cast("string"), F.when(F.col("l_partkey") % 10 == 0, -1).otherwise(F.col("l_partkey")).cast("string")).alias("mark"))
    marks = marks.groupBy("l_orderkey").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "mark"))), lambda x: x["mark"])).alias("marks"))
    poses = o.join(marks, o["o_orderkey"] == marks["l_orderkey"], "left")
    head = F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.lit("1 0 0 0"), F.col("o_custkey").cast("string"), F.lit("0 0 1"), F.format_string("frame_%05d_t%09.3f.jpg", "o_orderkey", F.col("o_orderkey") / 5.0))
    sinks.lines(poses, f"{folder}/images.txt", ["o_orderkey"], F.concat(head, F.lit("\n"), F.coalesce("marks", F.lit(""))), "# poses\n\n")
    p = V.table(spark, sf_dir, "part")
    sinks.lines(p, f"{folder}/points3D.txt", ["p_partkey"], F.concat_ws(" ", *[F.col(c).cast("string") for c in ("p_partkey", "p_size", "p_retailprice")], F.lit("0.5 10 20 30 0.25")), "# points\n")
    n = V.table(spark, sf_dir, "customer").agg(F.count("*").cast("string").alias("n"))
    sinks.lines(n, f"{folder}/cameras.txt", ["n"], F.concat(F.lit("1 SIMPLE_RADIAL "), "n", F.lit(" 480 500 320 240 0.01")), "# camera\n")
    return folder


@query("SELECT o_orderkey AS image_id, printf('frame_%05d_t%09.3f.jpg', o_orderkey, o_orderkey / 5.0) AS image_name, CAST(-o_custkey AS DOUBLE) AS cx, CAST(0 AS DOUBLE) AS cy, CAST(0 AS DOUBLE) AS cz FROM orders")
def pose_file(spark, sf_dir):
    p = files.poses(spark, f"{model_folder(spark, sf_dir)}/images.txt")
    return p.select("image_id", "image_name", *[(F.col(c) + 0.0).alias(c) for c in ("cx", "cy", "cz")])


_MARKS = "SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) - 1 AS ordinal, l_extendedprice AS u, l_quantity * 20 AS v, CASE WHEN l_partkey % 10 = 0 THEN -1 ELSE l_partkey END AS point3d_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"


@query(f"SELECT image_id, CAST(ordinal AS BIGINT) AS ordinal, u, v, point3d_id FROM ({_MARKS})")
def observation_file(spark, sf_dir):
    return rounded(files.observations(spark, f"{model_folder(spark, sf_dir)}/images.txt").drop("path", "image_name"))


@query(f"SELECT image_id, u, v, point3d_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM ({_MARKS}) JOIN part ON p_partkey = point3d_id WHERE v >= 850 AND point3d_id <> -1")
def floor_candidates(spark, sf_dir):
    folder = model_folder(spark, sf_dir)
    seen = stitch.observed(spark, folder, 0, 2**62, files.points3d(spark, f"{folder}/points3D.txt"))
    return seen.where("v >= 850").select("image_id", "u", "v", "point3d_id", "x", "y")


@query("SELECT o_orderkey AS frame, CAST(-o_custkey AS DOUBLE) AS cx FROM orders")
def poses_by_frame(spark, sf_dir):
    return stitch.by_frame(files.poses(spark, f"{model_folder(spark, sf_dir)}/images.txt")).select("frame", "cx")


@query("SELECT p_partkey AS point3d_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(0.5 AS DOUBLE) AS z, CAST(10 AS BIGINT) AS red, CAST(20 AS BIGINT) AS green, CAST(30 AS BIGINT) AS blue FROM part")
def point_file(spark, sf_dir):
    return rounded(files.points3d(spark, f"{model_folder(spark, sf_dir)}/points3D.txt"), 9)


@query("SELECT CAST(1 AS BIGINT) AS camera_id, 'SIMPLE_RADIAL' AS model, count(*) AS width, CAST(480 AS BIGINT) AS height, CAST(500 AS DOUBLE) AS f, CAST(0.01 AS DOUBLE) AS k FROM customer")
def camera_file(spark, sf_dir):
    c = files.cameras(spark, f"{model_folder(spark, sf_dir)}/cameras.txt")
    return rounded(c.select("camera_id", "model", "width", "height", F.col("params")[0].alias("f"), F.col("params")[3].alias("k")))


# The match database


@query(f"WITH {V.IMAGES} SELECT image_id, name FROM i")
def sqlite_images(spark, sf_dir):
    uri = f"{shared_path(spark, 'match')}/db.sqlite"
    sinks.sqlite_file(spark, uri, {"images": V.images(spark, sf_dir).select("image_id", "name")})
    return files.sqlite_table(spark, uri, "SELECT image_id, name FROM images", "image_id long, name string")


@query(_STORED + ", d AS (SELECT count(DISTINCT pair_id) AS planned FROM t), k AS (SELECT count(*) AS n FROM (SELECT DISTINCT pair_id FROM m) SEMI JOIN t USING (pair_id)), h AS (SELECT count(*) AS n FROM (SELECT DISTINCT pair_id FROM g) SEMI JOIN t USING (pair_id)) SELECT d.planned, k.n AS matches_removed, h.n AS geometries_removed, 'ok' AS integrity FROM d, k, h")
def sqlite_rematch(spark, sf_dir):
    import os
    import tempfile

    plan = pairs.targeted(V.images(spark, sf_dir), 0, 1_000_000_000, 12)
    stored = {t: V.stored_pairs(spark, sf_dir, n).select("pair_id").distinct() for t, n in (("matches", 3), ("two_view_geometries", 5))}
    with tempfile.TemporaryDirectory() as folder:  # a database that the driver edits, as the command does
        sinks.sqlite_file(spark, f"file://{folder}/db.sqlite", stored)
        row = sinks.delete_pairs(os.path.join(folder, "db.sqlite"), plan)
    return spark.createDataFrame([tuple(row.values())], "planned long, matches_removed long, geometries_removed long, integrity string")


# Meshes as files

_PLACES = f"WITH {V.MESH}, pl AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS place FROM v)"


def _mesh_file(spark, sf_dir) -> str:
    uri = f"{shared_path(spark, 'mesh')}/mesh.ply"
    sinks.mesh_ply(V.vertices(spark, sf_dir), V.triangles(spark, sf_dir), uri)
    return uri


@query(_PLACES + " SELECT CAST(place AS BIGINT) AS vid, x, y, z FROM v JOIN pl USING (vid)")
def mesh_file_vertices(spark, sf_dir):
    return files.ply_vertices(spark, _mesh_file(spark, sf_dir), part=4096)


@query(_PLACES + " SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, CAST(x.place AS BIGINT) AS a, CAST(y.place AS BIGINT) AS b, CAST(q.place AS BIGINT) AS c FROM t JOIN pl x ON x.vid = t.a JOIN pl y ON y.vid = t.b JOIN pl q ON q.vid = t.c")
def mesh_file_triangles(spark, sf_dir):
    return files.ply_triangles(spark, _mesh_file(spark, sf_dir), part=4096)


@query(_PLACES + " SELECT printf('v %.9f %.9f %.9f', x, y, z) AS line FROM v UNION ALL SELECT printf('f %d %d %d', x.place + 1, y.place + 1, q.place + 1) FROM t JOIN pl x ON x.vid = t.a JOIN pl y ON y.vid = t.b JOIN pl q ON q.vid = t.c")
def mesh_obj_lines(spark, sf_dir):
    uri = f"{shared_path(spark, 'mesh')}/mesh.obj"
    sinks.mesh_obj(V.vertices(spark, sf_dir), V.triangles(spark, sf_dir), uri)
    return spark.read.text(uri).select(F.col("value").alias("line"))


@query(f"WITH {V.MESH} SELECT 'glTF' AS magic, CAST(2 AS BIGINT) AS version, true AS whole, (SELECT count(*) FROM v) AS vertices, (SELECT 3 * count(*) FROM t) AS indices, (SELECT round(max(y), 2) FROM v) AS high")
def mesh_glb_header(spark, sf_dir):
    uri = f"{shared_path(spark, 'mesh')}/mesh.glb"
    sinks.mesh_glb(V.vertices(spark, sf_dir), V.triangles(spark, sf_dir), uri)
    b = files.binary(spark, uri).select("length", "content")
    number = lambda at: F.conv(F.concat(*[F.hex(F.expr(f"substring(content, {at + k}, 1)")) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    b = b.select(F.expr("substring(content, 1, 4)").cast("string").alias("magic"), number(5).alias("version"), (number(9) == F.col("length")).alias("whole"), F.col("content").substr(F.lit(21), number(13).cast("int")).cast("string").alias("j"))
    a = lambda path: F.get_json_object("j", path)
    return b.select("magic", "version", "whole", a("$.accessors[0].count").cast("long").alias("vertices"), a("$.accessors[1].count").cast("long").alias("indices"), F.round(a("$.accessors[0].max[1]").cast("double"), 2).alias("high"))


# Documents: manifests, scale files, logs, reports, lists


def one_file_a_row(df: DataFrame, tag: str, name: str, content: str) -> str:
    folder = shared_path(df.sparkSession, tag)
    sinks.image_files(df.select(name, F.encode(content, "utf-8").alias(content)), folder, name, content)
    return folder


@query("SELECT s_name AS dataset_id, 's' || s_nationkey || '.mov' AS video_path, n_name AS environment, 1 + (s_suppkey % 2) AS n_references, CAST(1.2192 AS DOUBLE) AS first_m FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def manifest_files(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").join(V.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    reference = lambda name, m: F.struct(F.lit(name).alias("name"), F.lit(m).alias("distance_m"), F.lit("on the floor").alias("description"))
    m = s.select(F.lit(1).alias("schema_version"), F.col("s_name").alias("dataset_id"), F.concat(F.lit("s"), "s_nationkey", F.lit(".mov")).alias("video_path"), F.lit("phone").alias("capture_device"), F.col("n_name").alias("environment"), F.lit("loop").alias("route_description"), F.when(F.col("s_suppkey") % 2 == 0, F.array(reference("tape", 1.2192))).otherwise(F.array(reference("tape", 1.2192), reference("door", 0.9))).alias("metric_references"))
    folder = one_file_a_row(m.select(F.concat("dataset_id", F.lit(".json")).alias("file"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("text")), "manifests", "file", "text")
    got = files.manifest(spark, folder)
    return got.select("dataset_id", "video_path", "environment", F.size("metric_references").cast("long").alias("n_references"), F.col("metric_references")[0]["distance_m"].alias("first_m"))


@query(f"WITH {CHECKS} SELECT brand, item, round(actual_m, 6) AS actual_m, round(estimated_m, 6) AS estimated_m, round(percent_error, 6) AS percent_error FROM r")
def scale_files(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    g = p.groupBy(F.col("p_brand").alias("brand")).agg(F.min_by(F.struct(F.col("p_brand").alias("name"), F.col("p_retailprice").alias("distance_m"), F.col("p_size").cast("double").alias("reconstructed_units")), "p_partkey").alias("anchor"), F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("name"), F.col("p_retailprice").alias("actual_m"), F.col("p_size").cast("double").alias("reconstructed_units"))).alias("checks"))
    folder = one_file_a_row(g.select(F.concat("brand", F.lit(".json")).alias("file"), F.to_json(F.struct("anchor", "checks")).alias("text")), "scales", "file", "text")
    got = files.scale_input(spark, folder).select("anchor", F.explode("checks").alias("c"))
    c = got.select(F.col("anchor.name").alias("brand"), F.col("c.name").alias("name"), F.col("c.actual_m").alias("actual_m"), F.col("c.reconstructed_units").alias("units"), (F.col("anchor.distance_m") / F.col("anchor.reconstructed_units")).alias("meters_per_unit"))
    done = clouds.scale_checks(clouds.valid_checks(c), "brand")
    return rounded(done.select("brand", F.col("name").cast("long").alias("item"), "actual_m", "estimated_m", "percent_error"))


_LOGS = "l AS (SELECT s_nationkey || '.log' AS name, count(*) AS registered_images, sum(s_suppkey) AS points, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE round(avg(s_acctbal), 4) END AS mean_reprojection_error_px FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey)"


def _log_files(spark, sf_dir) -> str:
    g = V.table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("p"), F.round(F.avg("s_acctbal"), 4).alias("e"))
    text = F.concat(F.lit("I0000 analyzer\nRegistered images: "), "n", F.lit("\nPoints:   "), "p", F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("\nMean reprojection error: "), "e", F.lit("px"))), F.lit("\nRegistered images: 0\n"))
    return one_file_a_row(g.select(F.concat("s_nationkey", F.lit(".log")).alias("file"), text.alias("text")), "logs", "file", "text")


@query(f"WITH {_LOGS} SELECT name, registered_images, CAST(points AS BIGINT) AS points, mean_reprojection_error_px, CAST(NULL AS BIGINT) AS observations FROM l")
def analyzer_logs(spark, sf_dir):
    return files.analyzer_log(spark, _log_files(spark, sf_dir), name=True).select("name", "registered_images", "points", "mean_reprojection_error_px", "observations")


@query(f"WITH {_LOGS} SELECT name, registered_images FROM l ORDER BY registered_images DESC, name LIMIT 1")
def sparse_report(spark, sf_dir):
    return sparse.report(spark, _log_files(spark, sf_dir)).select("name", "registered_images")


@query(f"WITH {CHECKS} SELECT count(*) AS checks, round(avg(absolute_error_m), 4) AS mean_absolute_error_m, round(avg(percent_error), 4) AS mean_percent_error, CAST(NULL AS VARCHAR) AS note FROM r")
def json_report_file(spark, sf_dir):
    uri = f"{shared_path(spark, 'report')}/report.json"
    p = V.table(spark, sf_dir, "part")
    a = p.groupBy("p_brand").agg((F.min_by("p_retailprice", "p_partkey") / F.min_by("p_size", "p_partkey")).alias("meters_per_unit"))
    c = p.join(a, "p_brand").select(F.lit(0).alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("actual_m"), F.col("p_size").alias("units"), "meters_per_unit")
    sinks.json_report(spark, clouds.scale_summary(clouds.scale_checks(c, "k"), "k").withColumn("note", F.lit(None).cast("string")).drop("k"), uri)
    return rounded(spark.read.option("multiLine", True).schema("checks long, mean_absolute_error_m double, mean_percent_error double, note string").json(uri), 4)


@query(f"WITH {V.FRAMES} SELECT video_id, sequence, source_frame, timestamp_s, sharpness, feature_count FROM f")
def csv_file(spark, sf_dir):
    uri = f"{shared_path(spark, 'csv')}/frames.csv"
    sinks.csv(V.frames(spark, sf_dir).select("video_id", "sequence", "source_frame", "timestamp_s", "sharpness", "feature_count"), uri, ["video_id", "sequence"])
    return spark.read.option("header", True).schema("video_id long, sequence long, source_frame long, timestamp_s double, sharpness double, feature_count long").csv(uri)


@query(f"WITH {V.IMAGES}, t AS (SELECT x.model_id, x.name AS a, y.name AS b, x.idx AS p, y.idx AS q FROM i x JOIN i y ON x.model_id = y.model_id AND y.idx > x.idx AND y.idx - x.idx <= 12) SELECT a || ' ' || b AS line FROM t")
def pair_list_file(spark, sf_dir):
    uri, i = f"{shared_path(spark, 'pairs')}/pairs.txt", V.images(spark, sf_dir)
    p = pairs.targeted(i, 0, 1_000_000_000, 12)
    for side in "ab":
        p = p.join(i.select(F.col("image_id").alias(f"id_{side}"), F.col("name").alias(side)), f"id_{side}")
    sinks.pair_list(p, uri)
    return spark.read.text(uri).select(F.col("value").alias("line"))


@query(f"WITH {V.IMAGES} SELECT name AS line FROM i")
def image_list_file(spark, sf_dir):
    uri = f"{shared_path(spark, 'images')}/images.txt"
    sinks.image_list(V.images(spark, sf_dir), uri, "name")
    return spark.read.text(uri).select(F.col("value").alias("line"))


@query(f"WITH {V.POINTS}, p AS (SELECT printf('%.9f %.9f %.9f %d 20 30', x, y, z, label % 256) AS line FROM c) SELECT line FROM p UNION ALL SELECT unnest(['ply', 'format ascii 1.0', 'element vertex ' || (SELECT count(*) FROM c), 'property float x', 'property float y', 'property float z', 'property uchar red', 'property uchar green', 'property uchar blue', 'end_header'])")
def ascii_ply_file(spark, sf_dir):
    uri = f"{shared_path(spark, 'cloud')}/cloud.ply"
    p = V.points(spark, sf_dir).select("*", (F.col("label") % 256).cast("int").alias("red"), F.lit(20).alias("green"), F.lit(30).alias("blue"))
    sinks.ascii_ply(p, uri, ["point3d_id"])
    return spark.read.text(uri).select(F.col("value").alias("line"))


@query("SELECT s_name || '.txt' AS name, strlen(s_name) AS length, sha256(s_name) AS sha256 FROM supplier")
def file_digests(spark, sf_dir):
    folder = one_file_a_row(V.table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(".txt")).alias("file"), F.col("s_name").alias("text")), "digests", "file", "text")
    return files.digests(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


# Pictures and videos as files


def _numbered_jpegs(spark, sf_dir) -> DataFrame:
    """A picture by its markers alone for each supplier: frame header, scan, the supplier's name as data, end; every seventh has no end."""
    # Start, frame header of 160 x 120, scan header; end.
    data = F.concat(F.lit("FFD8FFC0000B08007800A001011100FFDA0008010100003F00"), F.hex(F.encode("s_name", "utf-8")), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise("FFD9"))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.unhex(data).alias("jpeg"))


def _video(spark, sf_dir) -> str:
    uri = f"{shared_path(spark, 'video')}/v.avi"
    sinks.avi(_numbered_jpegs(spark, sf_dir), uri, ["s_suppkey"], "jpeg", 10, 160, 120)
    return uri


@query("SELECT CAST(160 AS BIGINT) AS width, CAST(120 AS BIGINT) AS height, 'landscape' AS orientation, CAST(10 AS DOUBLE) AS fps, count(*) AS declared_frames, count(*) FILTER (WHERE s_suppkey % 7 <> 0) AS decoded_frames, count(*) FILTER (WHERE s_suppkey % 7 <> 0) / 10 AS duration_s, count(*) = count(*) FILTER (WHERE s_suppkey % 7 <> 0) AS complete_decode, CAST(64 AS BIGINT) AS digits FROM supplier")
def video_probe(spark, sf_dir):
    m = files.video_metadata(spark, _video(spark, sf_dir), full_decode=True)
    return rounded(m.select("width", "height", "orientation", "fps", "declared_frames", "decoded_frames", "duration_s", "complete_decode", F.length("sha256").alias("digits")))


_JPEG = "'FFD8FFC0000B08007800A001011100FFDA0008010100003F00' || hex(encode(s_name)) || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'FFD9' END"


@query(f"WITH n AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, {_JPEG} AS jpeg FROM supplier) SELECT row_number() OVER (ORDER BY i) - 1 AS sequence, i AS source_frame, i / 10 AS timestamp_s, printf('frame_%05d_t%09.3f.jpg', row_number() OVER (ORDER BY i) - 1, i / 10) AS filename, jpeg FROM n WHERE i >= 4 AND (i - 4) % 3 = 0")
def video_frames(spark, sf_dir):
    f = files.video_frames(spark, _video(spark, sf_dir), ExtractionConfig(target_fps=3.0, start_s=0.4), part=512)
    return f.select("sequence", "source_frame", "timestamp_s", "filename", F.hex("jpeg").alias("jpeg"))


@query("WITH v AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL), f AS (SELECT c_nationkey, n, unnest(range(4, n, 3)) AS i FROM v) SELECT CAST(c_nationkey AS BIGINT) AS video_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY i) - 1 AS sequence, i AS source_frame, i / 10 AS timestamp_s FROM f")
def stride_table_function(spark, sf_dir):
    """A nation's customers are a video's frames; the table function is called for each video."""
    tables.register(spark)
    view = f"videos_{uuid.uuid4().hex[:8]}"
    V.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("video_id")).agg(F.count("*").cast("int").alias("n")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT video_id, k.* FROM {view}, LATERAL kept_frames(n, 10D, 3D, 0.4D, CAST(NULL AS DOUBLE)) k")


@query(f"SELECT s_suppkey AS sequence, s_suppkey / 8 AS timestamp_s, printf('frame_%05d_t%09.3f.JPG', s_suppkey, s_suppkey / 8) AS filename, {_JPEG} AS jpeg FROM supplier")
def frame_files(spark, sf_dir):
    folder = shared_path(spark, "frames")
    f = _numbered_jpegs(spark, sf_dir).withColumn("file", F.format_string("frame_%05d_t%09.3f.JPG", "s_suppkey", F.col("s_suppkey") / 8))
    sinks.image_files(f.union(f.where("s_suppkey = 1").withColumn("file", F.lit("notes.txt"))), folder, "file", "jpeg")
    names = files.candidates(spark, folder)
    return names.join(files.binary(spark, folder).select("path", F.hex("content").alias("jpeg")), "path").drop("path")


@query(SQL["frame_files"])
def frame_stream(spark, sf_dir):
    """The same frames from a folder that grows between two starts of one stream."""
    folder = shared_path(spark, "frames")
    f = _numbered_jpegs(spark, sf_dir).withColumn("file", F.format_string("frame_%05d_t%09.3f.JPG", "s_suppkey", F.col("s_suppkey") / 8))
    for half in (0, 1):
        sinks.image_files(f.where(F.col("s_suppkey") % 2 == half).union(f.where("s_suppkey = 1").withColumn("file", F.lit(f"notes{half}.txt"))), f"{folder}/in", "file", "jpeg")
        found = files.candidates_stream(spark, f"{folder}/in").select("sequence", "timestamp_s", "filename", F.hex("content").alias("jpeg"))
        with files.few_listings(spark):
            found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _bundle(spark, sf_dir) -> str:
    """A dense input bundle: a component a region, an image a nation; every second region's manifest names one image too many, ASIA has no points."""
    root = shared_path(spark, "bundle")
    n = V.table(spark, sf_dir, "nation").join(V.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("bytes", F.encode("n_name", "utf-8"))
    for r in V.table(spark, sf_dir, "region").orderBy("r_regionkey").toLocalIterator():  # five rows at any size
        sinks.image_files(n.where(F.col("r_regionkey") == r["r_regionkey"]).withColumn("file", F.concat("n_name", F.lit(".jpg"))), f"{root}/{r['r_name']}/images", "file", "bytes")
        for x in files.MODEL_FILES if r["r_name"] != "ASIA" else files.MODEL_FILES[:2]:
            sinks.write_bytes(spark, f"{root}/{r['r_name']}/sparse/{x}", b"# x\n")
    g = n.groupBy("r_name", "r_regionkey").agg((F.count("*") + F.max("r_regionkey") % 2).alias("registered_images"))
    sinks.json_report(spark, g.agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.struct("registered_images")))).alias("components")), f"{root}/manifest.json")
    return root


@query("SELECT r_name AS component, count(*) AS images, count(*) + max(r_regionkey) % 2 AS registered_images, CASE WHEN r_name = 'ASIA' THEN 'points3D.txt' ELSE '' END AS missing, max(r_regionkey) % 2 = 0 AND r_name <> 'ASIA' AS ok FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def bundle_check(spark, sf_dir):
    return files.bundle(spark, _bundle(spark, sf_dir)).withColumn("missing", F.concat_ws(",", "missing"))


@query("SELECT n_name || '.jpg' AS name FROM nation")
def jpg_listing(spark, sf_dir):
    return files.jpgs(spark, _bundle(spark, sf_dir)).select("name")


# Kernels on small pictures: the 64 components of a vector as the pixels of an 8 x 8 picture

_PIXELS = "px AS (SELECT vec_id, list_transform(embedding, lambda e: abs(CAST(floor(CAST(e AS DOUBLE) * 64) AS BIGINT)) % 256) AS p FROM embeddings), g AS (SELECT vec_id, p, unnest(range(64)) AS k FROM px)"


def _pictures(spark, sf_dir) -> DataFrame:
    pixels = F.transform("embedding", lambda e: (F.abs(F.floor(e.cast("double") * 64)) % 256).cast("int"))
    return V.table(spark, sf_dir, "embeddings").select("vec_id", pixels.alias("p"))


def _mapped(df: DataFrame, kernel, out: str) -> DataFrame:
    """vec_id and what ``kernel(8 x 8 picture)`` gives for each row."""
    import numpy as np
    import pandas as pd

    names = ["vec_id", *[c.split()[0] for c in out.split(", ")]]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, *kernel(np.array(p, np.uint8).reshape(8, 8))) for i, p in zip(pdf["vec_id"], pdf["p"], strict=True)], columns=names)

    return df.mapInPandas(run, f"vec_id long, {out}")


_MIRROR = "CASE WHEN {0} < 0 THEN 1 WHEN {0} > 7 THEN 6 ELSE {0} END"


@query(f"WITH {_PIXELS}, r AS (SELECT vec_id, p, k // 8 AS y, k % 8 AS x FROM g), l AS (SELECT vec_id, p[y * 8 + x + 1] AS v, " + ", ".join(f"p[({_MIRROR.format(f'(y + {dy})')}) * 8 + ({_MIRROR.format(f'(x + {dx})')}) + 1] AS n{k}" for k, (dy, dx) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)))) + " FROM r) SELECT vec_id, round(var_pop(n0 + n1 + n2 + n3 - 4 * v), 6) AS sharpness, round(avg(v), 6) AS brightness_mean FROM l GROUP BY vec_id")
def picture_quality(spark, sf_dir):
    q = _mapped(_pictures(spark, sf_dir), lambda p: (kernels.laplacian_variance(p), float(p.mean())), "sharpness double, brightness_mean double")
    return q.select("vec_id", F.round("sharpness", 6).alias("sharpness"), F.round("brightness_mean", 6).alias("brightness_mean"))


@query(SQL["picture_quality"])
def image_source_quality(spark, sf_dir):
    """The same figures of pictures that go through PNG files and Spark's image source."""
    folder = shared_path(spark, "pictures")
    made = _mapped(_pictures(spark, sf_dir), lambda p: (sinks.png(p[..., None].repeat(3, axis=2)),), "png binary")
    made = made.withColumn("file", F.concat("vec_id", F.lit(".png")))
    sinks.image_files(made, folder, "file", "png")
    q = kernels.frame_quality(spark.read.format("image").load(folder))
    return q.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), F.round("sharpness", 6).alias("sharpness"), F.round("brightness_mean", 6).alias("brightness_mean"))


@query(f"WITH {_PIXELS}, c AS (SELECT vec_id, (k // 8) // 2 AS y, (k % 8) // 2 AS x, CAST(floor(avg(p[k + 1]) + 0.5) AS BIGINT) AS v FROM g GROUP BY ALL) SELECT vec_id, string_agg(v, ' ' ORDER BY y, x) AS pixels FROM c GROUP BY vec_id")
def picture_shrunk(spark, sf_dir):
    return _mapped(_pictures(spark, sf_dir), lambda p: (" ".join(map(str, kernels.shrink(p, 4).ravel().tolist())),), "pixels string")


@query(f"WITH {_PIXELS} SELECT vec_id, string_agg((114 * p[3 * k + 1] + 587 * p[3 * k + 2] + 299 * p[3 * k + 3] + 500) // 1000, ' ' ORDER BY k) AS pixels FROM g WHERE k < 21 GROUP BY vec_id")
def picture_gray(spark, sf_dir):
    return _mapped(_pictures(spark, sf_dir), lambda p: (" ".join(map(str, kernels.gray(p.ravel()[:63].reshape(1, 21, 3)).ravel().tolist())),), "pixels string")


# Expressions and small operators


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/mnt/c/data/v' || event_id WHEN 1 THEN '/mnt/d/v' || event_id || '/x' ELSE 'v/' || event_id END AS path FROM events")
def wsl_paths(spark, sf_dir):
    m, e = F.col("event_id") % 3, F.col("event_id")
    path = F.when(m == 0, F.concat(F.lit("C:\\data\\v"), e)).when(m == 1, F.concat(F.lit("d:/v"), e, F.lit("\\x"))).otherwise(F.concat(F.lit("v\\"), e))
    return V.table(spark, sf_dir, "events").select("event_id", X.wsl_path(path).alias("path"))


_TERMS = ["1-2*(y*y+z*z)", "2*(x*y-w*z)", "2*(x*z+w*y)", "2*(x*y+w*z)", "1-2*(x*x+z*z)", "2*(y*z-w*x)", "2*(x*z-w*y)", "2*(y*z+w*x)", "1-2*(x*x+y*y)"]


@query(f"WITH {V.POSES} SELECT model_id, image_id, " + ", ".join(f"round({t}, 6) AS r{k}" for k, t in enumerate(_TERMS)) + " FROM p")
def rotations(spark, sf_dir):
    p = V.poses(spark, sf_dir)
    r = [c for row in X.rotation([F.col("q")[i] for i in range(4)]) for c in row]
    return rounded(p.select("model_id", "image_id", *[c.alias(f"r{k}") for k, c in enumerate(r)]))


@query("WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), j AS (SELECT DISTINCT l_returnflag, j * (n - 1) // 999 AS i FROM r, range(1000) x(j) WHERE n > 1000 AND r.i = 0) SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE n <= 1000 OR EXISTS (SELECT 1 FROM j WHERE j.l_returnflag = r.l_returnflag AND j.i = r.i)")
def even_samples(spark, sf_dir):
    return sequence.even_sample(V.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], 1000)


@query("SELECT p_brand, max({'score': p_retailprice * greatest(p_size, 10) / least(p_size, 10), 'label': p_partkey}).label AS label FROM part WHERE p_size >= 5 GROUP BY p_brand")
def tape_candidates(spark, sf_dir):
    score = F.col("p_retailprice") * F.greatest("p_size", F.lit(10)) / F.least("p_size", F.lit(10))
    return V.table(spark, sf_dir, "part").where("p_size >= 5").groupBy("p_brand").agg(F.max(F.struct(score.alias("score"), F.col("p_partkey").alias("label")))["label"].alias("label"))


@query(f"WITH {V.POINTS}, m AS (SELECT label, median(x) AS mx, median(y) AS my, median(z) AS mz FROM c GROUP BY label) SELECT label, round(median(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))), 6) AS spread FROM c JOIN m USING (label) GROUP BY label")
def cloud_spread(spark, sf_dir):
    return rounded(clouds.spread(V.points(spark, sf_dir), ["label"]))


@query("WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN d IS NULL OR d >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS rows, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS end_us FROM s GROUP BY user_id, k")
def capture_sessions(spark, sf_dir):
    """Sessions in append mode, over parts with late rows."""
    e, mark = _events(spark, sf_dir)
    first = e.agg(F.min(F.unix_micros("ts"))).first()[0] or 0
    plan = lambda s: sequence.session_gaps(s.withWatermark("ts", LATE), ["video_id"], "ts", "12 hours")
    out = _arrived(spark, e, (F.unix_micros("ts") - first) / 1e6, plan, True, mark).where("video_id >= 0")
    return out.select(F.col("video_id").alias("user_id"), "rows", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


#: Seconds of the parts in which a stream's rows arrive, and of the watermark's delay.
PART_S, LATE = 8 * 86400, "9 days"


def _arrived(spark, rows: DataFrame, seconds, plan, late: bool = False, mark: DataFrame | None = None) -> DataFrame:
    """What ``plan(stream)`` gives of rows that arrive in parts of some days, each part taken by a new start from the same checkpoint.

    With ``late`` every fourth row comes one part late. ``mark`` holds rows of a far time, after all others, that move the watermark past them.
    """
    folder = shared_path(spark, "stream")
    part = F.floor(seconds / PART_S) + (F.when(F.pmod(F.xxhash64(*rows.columns), F.lit(4)) == 0, 1).otherwise(0) if late else F.lit(0))
    dealt = written(rows.withColumn("_part", part.cast("long")), "arrivals")
    parts = [dealt.where(F.col("_part") == k).drop("_part") for k in range((dealt.agg(F.max("_part")).first()[0] or 0) + 1)]
    for arriving in [*parts, *[mark] * (mark is not None)]:
        arriving.select(*rows.columns).write.mode("append").parquet(f"{folder}/in")
        out = plan(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).writeStream.format("parquet").option("path", f"{folder}/out")
        out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events as a stream's rows, their time in the session's zone, and the row that ends them."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"))
    return e, e.agg(F.lit(-1).cast("long").alias("video_id"), (F.max("ts") + F.expr("interval 1000 days")).alias("ts"))


@query("SELECT user_id AS video_id, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS candidate_count FROM events GROUP BY ALL")
def tumbling_coverage(spark, sf_dir):
    """Windows of a day in append mode, over parts with late rows."""
    e, mark = _events(spark, sf_dir)
    first = e.agg(F.min(F.unix_micros("ts"))).first()[0] or 0
    out = _arrived(spark, e, (F.unix_micros("ts") - first) / 1e6, lambda s: streams.coverage_stream(s, late=LATE), True, mark)
    return out.where("video_id >= 0").select("video_id", F.unix_micros("start").alias("start_us"), "candidate_count")


_STREAM = KEYFRAMES.replace("n.sharpness < n.blur", "n.sharpness < 20.0")
_ENDLESS = _STREAM.replace("WHEN n.rn = n.cnt THEN 'last_frame'", "WHEN false THEN ''") + " SELECT video_id, sequence, selected, reason FROM w"
_FRAME = ["video_id", "sequence", "timestamp_s", "sharpness", "feature_count"]


@query(_ENDLESS)
def keyframe_stream(spark, sf_dir):
    return _arrived(spark, V.frames(spark, sf_dir).select(*_FRAME), F.col("timestamp_s"), lambda s: streams.select_stream(s, CFG, blur=20.0)).select("video_id", "sequence", "selected", "reason")


@query(_ENDLESS)
def keyframe_stream_processor(spark, sf_dir):
    with streams.rocks(spark):
        return _arrived(spark, V.frames(spark, sf_dir).select(*_FRAME), F.col("timestamp_s"), lambda s: streams.process_stream(s, CFG, blur=20.0)).select("video_id", "sequence", "selected", "reason")


@query(_STREAM + " SELECT video_id, sequence, selected, reason FROM w")
def keyframe_stream_ordered(spark, sf_dir):
    """Every fourth frame comes one part late; all are decided in the order of their times, the last ones too. Times begin a day after zero, where the watermark starts."""
    f = V.frames(spark, sf_dir).select(*_FRAME, F.timestamp_micros((F.col("timestamp_s") * 1e6).cast("long") + 86_400_000_000).alias("ts"))
    mark = f.agg(F.lit(-1).cast("long").alias("video_id"), F.lit(0).cast("long").alias("sequence"), F.lit(0.0).alias("timestamp_s"), F.lit(0.0).alias("sharpness"), F.lit(0).cast("long").alias("feature_count"), (F.max("ts") + F.expr("interval 1000 days")).alias("ts"))
    with streams.rocks(spark):
        out = _arrived(spark, f, F.col("timestamp_s"), lambda s: streams.ordered_stream(s, CFG, 20.0, late=LATE, idle_s=100 * 86400.0), True, mark)
    return out.where("video_id >= 0").select("video_id", "sequence", "selected", "reason")


# Composites


@query(KEYFRAMES + BINS + """, s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_s, sequence) AS k, sharpness - lag(sharpness) OVER (PARTITION BY video_id ORDER BY timestamp_s, sequence) AS d FROM w WHERE selected),
  t AS (SELECT video_id, median(CASE WHEN abs(d) > 150 THEN 0.0 ELSE 1.0 END) >= 0.35 AS ok, (count(*) - 0) AS n FROM s WHERE k > 1 GROUP BY video_id),
  q AS (SELECT video_id, count(*) AS n, max(timestamp_s) - min(timestamp_s) AS dur, count(*) FILTER (WHERE selected) AS c, max(blur_) AS blur FROM (SELECT w.*, n.blur AS blur_ FROM w JOIN n USING (video_id, sequence)) GROUP BY video_id)
  SELECT q.video_id, coalesce(t.ok, false) AS median_selected_track_ratio_at_least_minimum, round(CASE WHEN dur > 0 THEN (c - 1) / dur ELSE 0 END, 9) AS effective_keyframe_fps, round(q.blur, 6) AS blur_threshold FROM q LEFT JOIN t USING (video_id)""")
def keyframe_gates(spark, sf_dir):
    d = written(keyframes.select(V.frames(spark, sf_dir), CFG), "decisions")
    r = keyframes.report(d, CFG)
    return r.select("video_id", "median_selected_track_ratio_at_least_minimum", F.round("effective_keyframe_fps", 9).alias("effective_keyframe_fps"), F.round("blur_threshold", 6).alias("blur_threshold"))


@query(_MESH + """, b AS (SELECT ro.root, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM v JOIN ro USING (vid) GROUP BY ro.root)
  SELECT rank, ct.root, min_x, max_x, min_y, max_y, min_z, max_z, round(coalesce(triangles / (SELECT count(*) FROM t), 0), 9) AS triangle_fraction FROM ct JOIN b USING (root)""")
def mesh_component_boxes(spark, sf_dir):
    c = _tables(spark, sf_dir)[2]
    return c.select(F.col("rank").cast("long").alias("rank"), "root", *[f"{k}_{a}" for a in "xyz" for k in ("min", "max")], F.round("triangle_fraction", 9).alias("triangle_fraction"))


def _tables(spark, sf_dir):
    v, t = V.vertices(spark, sf_dir), V.triangles(spark, sf_dir)
    areas, labels = written(mesh.triangle_areas(v, t), "areas"), written(mesh.roots(v, t), "labels")
    return areas, labels, mesh.component_table(v, areas, labels)


@query(_MESH + """ SELECT round((SELECT sum(area) FROM ta), 2) AS surface_area, round((SELECT vertex_fraction FROM ct WHERE rank = 1), 9) AS largest_component_fraction, round((SELECT vertex_fraction FROM ct WHERE rank = 2), 9) AS second_component_fraction,
  (SELECT round(sqrt(pow(p.centroid_x - q.centroid_x, 2) + pow(p.centroid_y - q.centroid_y, 2) + pow(p.centroid_z - q.centroid_z, 2)), 5) FROM ct p, ct q WHERE p.rank = 1 AND q.rank = 2) AS centroid_distance""")
def mesh_report(spark, sf_dir):
    areas, _, c = _tables(spark, sf_dir)
    g = mesh.gates(c, areas, mesh.edge_summary(V.triangles(spark, sf_dir))).join(mesh.centroid_gap(c))
    return g.select(F.round("surface_area", 2).alias("surface_area"), *[F.round(x, 9).alias(x) for x in ("largest_component_fraction", "second_component_fraction")], F.round("centroid_distance", 5).alias("centroid_distance"))


@query(_MESH + " SELECT vid, CAST(CASE least(rank, 3) WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 30 END AS BIGINT) AS red, CAST(5 AS BIGINT) AS green, CAST(CASE least(rank, 3) WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS BIGINT) AS blue FROM ro JOIN ct USING (root)")
def component_colours(spark, sf_dir):
    _, labels, c = _tables(spark, sf_dir)
    return rounded(mesh.coloured(V.vertices(spark, sf_dir), labels, c, ((10, 5, 1), (20, 5, 2), (30, 5, 3))).drop("x", "y", "z"))


_VOXELS = "SELECT {0} avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {1} GROUP BY {2} floor(x / 0.05), floor(y / 0.05), floor(z / 0.05)"


@query(f"WITH {V.POINTS}, c2 AS (SELECT label % 2 AS component, x, y, z FROM c), t AS ({_VOXELS.format('component,', 'c2', 'component,')}), u AS (SELECT *, row_number() OVER () AS id FROM t)," + " d AS (SELECT a.id, a.component, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS d, b.id AS o FROM u a JOIN u b USING (component)), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d), m AS (SELECT id, component, avg(d) AS md FROM n WHERE r <= 20 GROUP BY ALL), l AS (SELECT component, avg(md) + 2.5 * coalesce(stddev_samp(md), 0) AS lim FROM m GROUP BY component), k AS (SELECT u.* FROM u JOIN m USING (id) JOIN l ON l.component = m.component WHERE md > 0 AND md < lim), f AS (" + _VOXELS.format("", "k", "") + ") SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM f")
def dense_fused(spark, sf_dir):
    p = V.points(spark, sf_dir).select((F.col("label") % 2).alias("component"), "x", "y", "z")
    return rounded(clouds.dense_summary(p, "voxel", 0.05)[0].select("x", "y", "z"))


@query(f"WITH {V.POINTS} SELECT point3d_id, true AS unit, true AS least FROM c")
def normal_vectors(spark, sf_dir):
    """A normal is a unit vector, and its moment about the neighbourhood's mean is the smallest principal one, by the characteristic polynomial."""
    p = V.points(spark, sf_dir)
    m = clouds.with_normals(clouds.neighbour_moments(p, "point3d_id", 1.0))
    row = lambda a, b, c: F.col(a) * F.col("nx") + F.col(b) * F.col("ny") + F.col(c) * F.col("nz")
    m = m.withColumns({"mx": row("xx", "xy", "xz"), "my": row("xy", "yy", "yz"), "mz": row("xz", "yz", "zz")})
    m = m.withColumn("moment", F.col("mx") * F.col("nx") + F.col("my") * F.col("ny") + F.col("mz") * F.col("nz"))
    few = F.col("neighbours") < 3
    off = F.sqrt(sum(((F.col(f"m{a}") - F.col("moment") * F.col(f"n{a}")) * (F.col(f"m{a}") - F.col("moment") * F.col(f"n{a}")) for a in "xyz"), F.lit(0.0)))
    trace = F.col("xx") + F.col("yy") + F.col("zz")
    return m.select("point3d_id", (F.abs(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz") - 1) < 1e-9).alias("unit"), (few | ((off < 1e-8) & (F.col("moment") <= trace / 3 + 1e-9))).alias("least"))


@query("SELECT s_name AS dataset, place, stage, replace(command, '/w/', '/w/' || s_name || '/') AS command FROM supplier, (VALUES (0, 'feature_extractor', 'colmap feature_extractor --database_path /w/database.db --image_path /w/images --ImageReader.camera_model SIMPLE_RADIAL --ImageReader.single_camera 1 --SiftExtraction.use_gpu 0 --SiftExtraction.max_num_features 4096'), (1, 'sequential_matcher', 'colmap sequential_matcher --database_path /w/database.db --SiftMatching.use_gpu 0 --SequentialMatching.overlap 40'), (2, 'loop_pairs', 'colmap matches_importer --database_path /w/database.db --match_list_path /w/loop_pairs.txt --match_type pairs --SiftMatching.use_gpu 0'), (3, 'mapper', 'colmap mapper --database_path /w/database.db --image_path /w/images --output_path /w/sparse --Mapper.min_num_matches 15 --Mapper.ba_local_max_num_iterations 25 --Mapper.ba_local_max_refinements 2 --Mapper.ba_global_images_ratio 1.1 --Mapper.ba_global_points_ratio 1.1 --Mapper.ba_global_max_num_iterations 50 --Mapper.ba_global_max_refinements 5')) t(place, stage, command)")
def sparse_commands(spark, sf_dir):
    """The command lines of every supplier's capture, each in a workspace of its own."""
    every = sparse.commands(spark, "/w", sparse.SparseConfig()).select("place", "stage", F.concat_ws(" ", "argv").alias("command"))
    names = V.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("dataset"))
    return names.crossJoin(F.broadcast(every)).withColumn("command", F.replace("command", F.lit("/w/"), F.concat(F.lit("/w/"), "dataset", F.lit("/"))))  # four commands


@query("WITH n AS (SELECT n_name || '.jpg' AS name, row_number() OVER (ORDER BY n_name) AS k, count(*) OVER () AS c FROM nation) SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.k <= least(3, x.c // 2) AND y.k > y.c - least(3, y.c // 2)")
def loop_plan(spark, sf_dir):
    return sparse.loop_plan(spark, _bundle(spark, sf_dir), 3)


def _stitched(spark, sf_dir):
    """Both models of a stitch from the tables, with given calibrations: the orders' model, and the same with other lengths as its second part."""
    folder = model_folder(spark, sf_dir)
    ids = sorted(r["o_orderkey"] for r in V.table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").take(3))
    cal = lambda m: stitch.Calibration(0, "", (), 1.0, m, m, 0, 0, 1.0, 0.0)
    return stitch.stitch(spark, folder, folder, "", main_seam=ids[1], secondary_seam=ids[1], calibrations=(cal(0.5), cal(0.75)))


_SEAM = "s AS (SELECT o_custkey AS c FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE k = 2)"


@query(f"WITH {_SEAM} SELECT o_orderkey AS frame, 'main' AS component, round(-o_custkey * CAST(0.5 AS DOUBLE), 6) AS x FROM orders UNION ALL SELECT o_orderkey, 'secondary', round((-1.5 * o_custkey + 1.5 * c - c) * CAST(0.5 AS DOUBLE), 6) FROM orders, s")
def stitched_cameras(spark, sf_dir):
    return rounded(_stitched(spark, sf_dir)[2].select("frame", "component", "x"))


@query(f"WITH {_SEAM} SELECT p_partkey AS point3d_id, 'main' AS component, round(p_size * CAST(0.5 AS DOUBLE), 6) AS x, round(p_retailprice * 0.5, 6) AS y FROM part UNION ALL SELECT p_partkey, 'secondary', round((1.5 * p_size + 1.5 * c - c) * CAST(0.5 AS DOUBLE), 6), round(1.5 * p_retailprice * 0.5, 6) FROM part, s")
def stitched_points(spark, sf_dir):
    return rounded(_stitched(spark, sf_dir)[1].select("point3d_id", "component", "x", "y"))


@query("WITH o AS (SELECT o_custkey AS c, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) SELECT round(abs(b.c - a.c) * CAST(0.75 AS DOUBLE), 6) AS incoming_step_m, round(abs(d.c - b.c) * CAST(0.5 AS DOUBLE), 6) AS outgoing_step_m, CAST(1.5 AS DOUBLE) AS secondary_to_main_scale, CAST(0 AS DOUBLE) AS seam_position_gap_m, (SELECT 2 * count(*) FROM part) AS merged_points, (SELECT 2 * count(*) FROM orders) AS merged_cameras FROM o a, o b, o d WHERE a.k = 1 AND b.k = 2 AND d.k = 3")
def stitch_report(spark, sf_dir):
    r = _stitched(spark, sf_dir)[0]
    names = ["incoming_step_m", "outgoing_step_m", "secondary_to_main_scale", "seam_position_gap_m", "merged_points", "merged_cameras"]
    return rounded(spark.createDataFrame([tuple(r[n] for n in names)], ", ".join(f"{n} {'long' if n.startswith('merged') else 'double'}" for n in names)))
