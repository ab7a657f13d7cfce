"""File sources. Bytes come through Spark's own readers, so any store that Spark reaches will do; parsing runs where the bytes are."""

from __future__ import annotations

import hashlib
import sqlite3
import tempfile
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import CANDIDATE
from ..operators.trajectory import with_centers
from ..schemas import CHECK, MANIFEST
from . import posefiles, ranges

# What a model analyzer's log says, and the type of each number.
LOG = {"registered_images": (r"Registered images:\s+(\d+)", "long"), "points": (r"Points:\s+(\d+)", "long"), "observations": (r"Observations:\s+(\d+)", "long"), "mean_track_length": (r"Mean track length:\s+([0-9.eE+-]+)", "double"), "mean_observations_per_image": (r"Mean observations per image:\s+([0-9.eE+-]+)", "double"), "mean_reprojection_error_px": (r"Mean reprojection error:\s+([0-9.eE+-]+)px", "double")}

#: Rows of a SQLite file that are taken at once.
SQLITE_ROWS = 50_000


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def poses(spark: SparkSession, path: str, glob: str = "images.txt") -> DataFrame:
    """path, image_id, image_name, q, t, cx, cy, cz from pose text files, each read in as many splits as its size asks for."""
    return with_centers(posefiles.poses(spark, path, glob))


observations = posefiles.observations


def points3d(spark: SparkSession, path: str) -> DataFrame:
    """point3d_id, x, y, z, red, green, blue; built-in functions only."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return lines.select(f[0].cast("long").alias("point3d_id"), *[f[i].cast("double").alias(a) for i, a in enumerate("xyz", 1)], *[f[i].cast("int").alias(c) for i, c in enumerate(("red", "green", "blue"), 4)])


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """The one camera (f, cx, cy, k); any other count or model is an error."""
    f = F.split(F.trim("value"), r"\s+")
    c = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(f.alias("f"))
    c = c.select(F.col("f")[0].cast("long").alias("camera_id"), F.col("f")[1].alias("model"), F.col("f")[2].cast("int").alias("width"), F.col("f")[3].cast("int").alias("height"), F.transform(F.slice("f", 5, 4), lambda x: x.cast("double")).alias("params"))
    rows = c.take(2)
    if len(rows) != 1 or rows[0]["model"] != "SIMPLE_RADIAL":
        raise ValueError("exactly one SIMPLE_RADIAL camera is expected")
    return c


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """A query's rows from each SQLite file at path. A task copies a file to its own disk in pieces and takes the rows in turns, so memory holds neither whole."""
    columns = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            for p in pdf["path"]:
                with tempfile.TemporaryDirectory() as folder:
                    with ranges.opened(p) as f, open(f"{folder}/db", "wb") as out:
                        size = f.size()
                        for at in range(0, size, ranges.READ):
                            out.write(f.read_at(min(ranges.READ, size - at), at))
                    db = sqlite3.connect(f"{folder}/db")
                    found = db.execute(query)
                    while rows := found.fetchmany(SQLITE_ROWS):
                        yield pd.DataFrame(rows, columns=columns)
                    db.close()

    return binary(spark, path).select("path").mapInPandas(run, schema)


def ply_vertices(spark: SparkSession, path: str, part: int = ranges.PART) -> DataFrame:
    """vid, x, y, z of a binary mesh, read by byte ranges."""
    return ranges.register(spark).read.format("panoply_ply").option("part", part).load(path)


def ply_triangles(spark: SparkSession, path: str, part: int = ranges.PART) -> DataFrame:
    """fid, a, b, c of a binary mesh, read by byte ranges."""
    return ranges.register(spark).read.format("panoply_ply").option("part", part).option("element", "face").load(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scale_input(spark: SparkSession, path: str) -> DataFrame:
    """anchor (name, distance_m, reconstructed_units) and checks of each scale file."""
    anchor = "anchor struct<name:string, distance_m:double, reconstructed_units:double>"
    return spark.read.schema(f"{anchor}, checks array<{CHECK.simpleString()}>").option("multiLine", True).json(path)


def analyzer_log(spark: SparkSession, path: str, name: bool = False) -> DataFrame:
    """One row a log, with its file's name if asked for; a number that isn't there is null."""
    t = spark.read.text(path, wholetext=True)
    named = [F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")] * name
    return t.select(*named, *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast(k).alias(n) for n, (p, k) in LOG.items()])


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, sequence, timestamp_s of candidate frames; the pixels are not read. No frame at all is an error."""
    f = _named(binary(spark, path).select("path"))
    if f.isEmpty():
        raise ValueError(f"no candidate frames in {path}")
    return f


def _named(f: DataFrame) -> DataFrame:
    """Rows whose path ends in a candidate frame's name, with what the name says."""
    f = f.withColumn("filename", F.element_at(F.split("path", "/"), -1)).where(F.col("filename").rlike(CANDIDATE))
    return f.withColumns({"sequence": F.regexp_extract("filename", CANDIDATE, 1).cast("long"), "timestamp_s": F.regexp_extract("filename", CANDIDATE, 2).cast("double")})


@contextmanager
def few_listings(spark: SparkSession):
    """Streams over files that start inside look up a batch's files in as many tasks as there are cores. By default each file is a task, whose result the driver receives."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def candidates_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """path, content, filename, sequence, timestamp_s of candidate frames as a stream over a folder that grows.

    The stream's checkpoint knows which files were taken, so one that starts again neither loses nor repeats a frame. Files have to
    appear whole: written elsewhere, or under a name that starts with a dot, and moved in. Empty files give no row. Start it inside
    few_listings() where folders are large.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return _named(found.select("path", "content"))


def video_metadata(spark: SparkSession, path: str, full_decode: bool = False) -> DataFrame:
    """One row a video. With ``full_decode`` decoded_frames counts the frames that are whole pictures. Files are streamed, whatever their size."""

    def run(batches):
        for pdf in batches:
            for p in pdf["path"]:
                digest, n = hashlib.sha256(), None
                with ranges.opened(p) as f:
                    size = f.size()
                    for at in range(0, size, ranges.READ):
                        digest.update(f.read_at(min(ranges.READ, size - at), at))
                    info, frames = ranges.avi_frames(f)
                    if full_decode:
                        n = sum(ranges.whole_jpeg(f.read_at(length, at)) for at, length in frames)
                declared = info["declared_frames"]
                row = {"path": p, "sha256": digest.hexdigest(), "file_size_bytes": size, "width": info["width"], "height": info["height"], "orientation": "landscape" if info["width"] >= info["height"] else "portrait", "fps": info["fps"], "declared_frames": declared, "decoded_frames": n, "duration_s": (n if n is not None else declared) / info["fps"], "complete_decode": None if n is None else declared <= 0 or n == declared}
                yield pd.DataFrame([row]).astype({"decoded_frames": "Int64", "complete_decode": "boolean"})

    return binary(spark, path).select("path").mapInPandas(run, "path string, sha256 string, file_size_bytes long, width int, height int, orientation string, fps double, declared_frames long, decoded_frames long, duration_s double, complete_decode boolean")


def video_frames(spark: SparkSession, path: str, cfg, decoder: Callable[[str, object], Iterable[tuple[int, float, bytes]]] | None = None, part: int = ranges.PART) -> DataFrame:
    """path, sequence, source_frame, timestamp_s, filename, jpeg of the frames that the stride and the interval keep.

    Motion-JPEG AVI is read by byte ranges. For other containers ``decoder(path, cfg)`` gives the kept frames as (source frame, seconds, JPEG
    bytes) in order, in one task a file.
    """
    if decoder is None:
        options = {"target_fps": cfg.target_fps, "start_s": cfg.start_s, "part": part} | ({} if cfg.end_s is None else {"end_s": cfg.end_s})
        return ranges.register(spark).read.format("panoply_avi").options(**options).load(path)

    def run(batches):
        for pdf in batches:
            for p in pdf["path"]:
                for k, (source, time, jpeg) in enumerate(decoder(p, cfg)):
                    yield pd.DataFrame([(p, k, source, time, f"frame_{k:05d}_t{time:09.3f}.jpg", jpeg)], columns=["path", "sequence", "source_frame", "timestamp_s", "filename", "jpeg"])

    return binary(spark, path).select("path").mapInPandas(run, "path string, sequence long, source_frame long, timestamp_s double, filename string, jpeg binary")


def jpgs(spark: SparkSession, folder: str) -> DataFrame:
    """path, name of a folder's JPG files; their content is not read."""
    return binary(spark, folder, "*.jpg").select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


#: The files of a component's sparse model.
MODEL_FILES = ("cameras.txt", "images.txt", "points3D.txt")


def bundle(spark: SparkSession, root: str) -> DataFrame:
    """One row a component that a dense input bundle's manifest names: component, images found, registered_images, missing (or empty) model files, ok.

    A bundle holds manifest.json, and for each component images/*.jpg and sparse/ with the model files.
    """
    said = spark.read.option("multiLine", True).schema("components map<string, struct<registered_images: long>>").json(f"{root}/manifest.json")
    said = said.select(F.explode("components").alias("component", "c")).select("component", F.col("c.registered_images").alias("registered_images"))
    part = lambda k: F.element_at(F.split("path", "/"), k)
    found = binary(spark, root).select(part(-3).alias("component"), part(-2).alias("folder"), part(-1).alias("name"))
    g = found.groupBy("component").agg(F.count_if((F.col("folder") == "images") & F.col("name").endswith(".jpg")).alias("images"), F.collect_set(F.when((F.col("folder") == "sparse") & F.col("name").isin(*MODEL_FILES), F.col("name"))).alias("_have"))
    g = said.join(g, "component", "left")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, MODEL_FILES)), F.coalesce("_have", F.array().cast("array<string>"))))
    g = g.select("component", F.coalesce("images", F.lit(0)).alias("images"), "registered_images", missing.alias("missing"))
    return g.withColumn("ok", (F.col("images") == F.col("registered_images")) & (F.size("missing") == 0))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files, each streamed in one task."""

    def run(batches):
        for pdf in batches:
            for p in pdf["path"]:
                digest = hashlib.sha256()
                with ranges.opened(p) as f:
                    size = f.size()
                    for at in range(0, size, ranges.READ):
                        digest.update(f.read_at(min(ranges.READ, size - at), at))
                yield pd.DataFrame([(p, size, digest.hexdigest())], columns=["path", "length", "sha256"])

    return binary(spark, path).select("path").mapInPandas(run, "path string, length long, sha256 string")
