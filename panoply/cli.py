"""The command line: each command reads files, runs a plan on Spark and writes its report."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels
from .operators import clouds, keyframes, mesh, pairs, sequence, trajectory
from .plans import sparse
from .plans.stitch import stitch
from .schemas import ExtractionConfig, KeyframeConfig, Manifest, MetricReference, need
from .session import session, written
from .sources import files, sinks

#: command -> (function, {option: (type, default)}); no default means that the option must be given.
COMMANDS: dict = {}
MUST = object()


def command(name: str, **options):
    def add(f):
        COMMANDS[name] = f, options
        return f

    return add


def save(spark: SparkSession, uri: str, report: dict) -> dict:
    sinks.write_bytes(spark, uri, (json.dumps(report, indent=2, allow_nan=False) + "\n").encode())
    return report


@command("init-dataset", dataset_id=(str, MUST), video=(str, MUST), output=(str, MUST), capture_device=(str, "unknown"), environment=(str, "unknown"), route=(str, "unspecified"), reference_name=(str, "tape"), reference_distance_m=(float, 1.2192), reference_description=(str, "tape measure on the floor"))
def init_dataset(spark, a) -> dict:
    reference = MetricReference(a.reference_name, a.reference_distance_m, a.reference_description)
    return save(spark, a.output, asdict(Manifest(a.dataset_id, a.video, a.capture_device, a.environment, a.route, (reference,))))


@command("inspect-video", video=(str, MUST), output=(str, MUST), full_decode=(bool, False))
def inspect_video(spark, a) -> dict:
    return sinks.json_report(spark, files.video_metadata(spark, a.video, a.full_decode), a.output)


@command("extract-frames", video=(str, MUST), output_dir=(str, MUST), target_fps=(float, 3.0), jpeg_quality=(int, 95), start_s=(float, 0.0), end_s=(float, None))
def extract_frames(spark, a) -> dict:
    """Frames keep the container's own JPEG bytes, so the quality setting is checked and has nothing to do."""
    cfg = ExtractionConfig(target_fps=a.target_fps, jpeg_quality=a.jpeg_quality, start_s=a.start_s, end_s=a.end_s)
    sinks.refuse_non_empty(spark, a.output_dir)
    info = files.video_metadata(spark, a.video).first()
    folder = f"{a.output_dir}/frames"
    kept = files.video_frames(spark, a.video, cfg)
    sinks.image_files(kept, folder, "filename", "jpeg")
    quality = kernels.frame_quality(spark.read.format("image").load(folder), cfg.analysis_width)
    rows = kept.drop("path", "jpeg").join(quality.withColumn("filename", F.element_at(F.split("path", "/"), -1)).drop("path", "feature_count"), "filename")
    rows = written(rows.select("sequence", "source_frame", "timestamp_s", "sharpness", "brightness_mean", "filename"), "frame-rows")
    sinks.csv(rows, f"{a.output_dir}/frames.csv", ["sequence"])
    span = rows.agg(F.count("*").alias("n"), (F.max("timestamp_s") - F.min("timestamp_s")).alias("s")).first()
    stride = max(1, round(info["fps"] / cfg.target_fps))
    shares = {c: sequence.distribution(rows.withColumn("_k", F.lit(0)), ["_k"], c).drop("_k").first().asDict() for c in ("sharpness", "brightness_mean")}
    return save(spark, f"{a.output_dir}/report.json", {"video": a.video, "frames": span["n"], "stride": stride, "achieved_fps": (span["n"] - 1) / span["s"] if span["s"] else info["fps"] / stride, **shares})


#: The columns of the keyframe CSV, and what they are called here.
KEYFRAME_CSV = {"source_sequence": "sequence", "source_filename": "filename", "timestamp_s": "timestamp_s", "sharpness": "sharpness", "brightness_mean": "brightness_mean", "feature_count": "feature_count", "elapsed_from_keyframe_s": "elapsed_s", "initial_tracked_features": "initial_tracked_features", "tracked_features": "tracked_features", "track_ratio": "track_ratio", "motion_ratio": "motion_ratio", "selected": "selected", "reason": "reason", "output_filename": "output_filename"}


@command("select-keyframes", frames_dir=(str, MUST), output_dir=(str, MUST), min_interval_s=(float, 0.4), max_interval_s=(float, 1.2), target_motion_ratio=(float, 0.012), min_track_ratio=(float, 0.35), min_features=(int, 80), blur_percentile=(float, 20.0))
def select_keyframes(spark, a) -> dict:
    cfg = KeyframeConfig(min_interval_s=a.min_interval_s, max_interval_s=a.max_interval_s, motion_threshold=a.target_motion_ratio, min_track_ratio=a.min_track_ratio, min_features=a.min_features, blur_percentile=a.blur_percentile)
    sinks.refuse_non_empty(spark, a.output_dir)
    found = keyframe_candidates(spark, a.frames_dir, cfg)
    decided = written(keyframes.select(found, cfg, pair=keyframes.pixel_pair(cfg.max_corners)), "decisions")
    rows = written(decided.join(found.select("sequence", "timestamp_s", "path", "filename", "brightness_mean"), ["sequence", "timestamp_s"]), "keyframes")
    chosen = sequence.numbered(rows.where("selected"), [], ["timestamp_s", "sequence"], "place")
    chosen = chosen.withColumn("output_filename", F.format_string("frame_%05d_source_%05d_t%09.3f.%s", "place", "sequence", "timestamp_s", F.lower(F.element_at(F.split("filename", r"\."), -1))))
    placed = chosen.select("sequence", "timestamp_s", F.concat(F.lit("frames/"), "output_filename").alias("output_filename"))
    named = rows.join(placed, ["sequence", "timestamp_s"], "left").fillna({"output_filename": ""})
    sinks.csv(named.withColumn("selected", F.initcap(F.col("selected").cast("string"))).select(*[F.col(c).alias(n) for n, c in KEYFRAME_CSV.items()]), f"{a.output_dir}/keyframes.csv", ["timestamp_s", "source_sequence"])
    content = files.binary(spark, a.frames_dir).select("path", "content")
    sinks.image_files(content.join(chosen.select("path", "output_filename"), "path"), f"{a.output_dir}/frames", "output_filename", "content")
    sinks.image_list(chosen, f"{a.output_dir}/image_list.txt", "filename", ["timestamp_s", "sequence"])  # the candidate folder's own names
    row = json.loads(keyframes.report(decided, cfg).drop("video_id").select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    row |= keyframe_details(decided, cfg)
    return save(spark, f"{a.output_dir}/report.json", row)


def keyframe_details(decided: DataFrame, cfg: KeyframeConfig) -> dict:
    """What one video's report adds to its counts: settings, rejections, distributions of quality and motion, the coverage bins."""
    parts = {
        "quality": {"candidate_sharpness": (decided, "sharpness"), "selected_sharpness": (decided.where("selected"), "sharpness"), "candidate_features": (decided, "feature_count"), "selected_features": (decided.where("selected"), "feature_count")},
        "motion": {f"selected_{c}": (decided.where("selected and reason <> 'first_frame'"), c) for c in ("motion_ratio", "track_ratio")},
    }
    out = {"config": asdict(cfg), "rejections": {r["reason"]: r["count"] for r in decided.where("not selected").groupBy("reason").count().orderBy("reason").collect()}}
    for name, held in parts.items():
        found = {k: sequence.distribution(df, ["video_id"], c).drop("video_id").first() for k, (df, c) in held.items()}
        out[name] = {k: r and r.asDict() for k, r in found.items()}
    bins = sequence.coverage_bins(decided, ["video_id"], "timestamp_s", "selected", cfg.coverage_bin_s).drop("video_id").orderBy("bin")
    out["bins"] = [r.asDict() for r in bins.toLocalIterator()]
    return out


def keyframe_candidates(spark: SparkSession, folder: str, cfg: KeyframeConfig) -> DataFrame:
    """Candidate frames of a folder with their quality and gray analysis image."""
    q = kernels.frame_quality(spark.read.format("image").option("recursiveFileLookup", "true").load(folder), cfg.analysis_width, cfg.max_corners, pixels=True)
    names = files.candidates(spark, folder).withColumn("_name", F.regexp_replace("path", "^file:/+", "/"))
    return written(names.join(q.withColumn("_name", F.regexp_replace("path", "^file:/+", "/")).drop("path"), "_name").drop("_name").withColumn("video_id", F.lit(0).cast("long")), "candidates")


@command("scale-report", input=(str, MUST), output=(str, MUST))
def scale_report(spark, a) -> dict:
    row = files.scale_input(spark, a.input).first()
    anchor, checks = row["anchor"], row["checks"] or []
    need(anchor["distance_m"] > 0 and anchor["reconstructed_units"] > 0, "the anchor's lengths must be positive")
    factor = anchor["distance_m"] / anchor["reconstructed_units"]
    need(bool((anchor["name"] or "").strip()), "the anchor needs a name")
    d = spark.createDataFrame([(0, c["name"], c["actual_m"], c["reconstructed_units"], factor) for c in checks], "k int, name string, actual_m double, units double, meters_per_unit double")
    done = clouds.scale_checks(clouds.valid_checks(d), "k")
    means = clouds.scale_summary(done, "k").first()
    dims = [r.asDict() for r in done.select("name", "actual_m", "estimated_m", "absolute_error_m", "percent_error").collect()]  # the file's own checks
    return save(spark, a.output, {"anchor_name": anchor["name"], "meters_per_unit": factor, "dimensions": dims, "mean_absolute_error_m": means and means["mean_absolute_error_m"], "mean_percent_error": means and means["mean_percent_error"]})


@command("trajectory-report", images_txt=(str, MUST), output_dir=(str, MUST), expected_images=(int, None))
def trajectory_report(spark, a) -> dict:
    poses = files.poses(spark, a.images_txt, glob=os.path.basename(a.images_txt))
    poses = written(poses.withColumn("model_id", F.lit(0)), "poses")  # the report, three files and their sorts read it: the text is parsed once
    expected = spark.createDataFrame([(0, a.expected_images)], "model_id int, expected_images long") if a.expected_images else None
    report = trajectory.gates(trajectory.report(poses, expected=expected)).drop("model_id")
    flat = poses.select("image_id", "image_name", "cx", "cy", "cz")
    sinks.csv(flat, f"{a.output_dir}/trajectory.csv", ["image_name"])
    points = flat.select("image_name", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), *[F.lit(v).alias(n) for n, v in (("red", 40), ("green", 140), ("blue", 255))])
    sinks.ascii_ply(points, f"{a.output_dir}/trajectory.ply", ["image_name"])
    pixels = sinks.projected(points.withColumnRenamed("image_name", "order"), ["order"], 1200, 800)
    sinks.write_bytes(spark, f"{a.output_dir}/trajectory.png", sinks.png(sinks.canvas(pixels, 1200, 800, 248, ((30, 120, 220), (30, 170, 30), (220, 30, 30)))))
    return sinks.json_report(spark, report, f"{a.output_dir}/report.json")


def _rematch(spark, a, plan: DataFrame, images: DataFrame, said: dict) -> dict:
    named = images.select(F.col("image_id").alias("id"), "name")
    p = written(plan, "plan")
    for side in "ab":
        p = p.join(named.select(F.col("id").alias(f"id_{side}"), F.col("name").alias(side)), f"id_{side}")
    sinks.pair_list(p, a.pair_list, order=["idx_a", "id_a", "idx_b", "id_b"])
    return save(spark, a.report, said | sinks.delete_pairs(a.database, p))


def _images(spark, a) -> DataFrame:
    return files.sqlite_table(spark, a.database, "SELECT image_id, name FROM images", "image_id long, name string").withColumn("model_id", F.lit(0))


def _within(images: DataFrame, first: int, last: int) -> int:
    return pairs.indexed(images).where(F.col("idx").between(first, last)).count()


@command("prepare-targeted-rematch", database=(str, MUST), pair_list=(str, MUST), report=(str, MUST), start_frame=(int, MUST), end_frame=(int, MUST), overlap=(int, 12))
def targeted_rematch(spark, a) -> dict:
    images = _images(spark, a)
    plan = pairs.targeted(images, a.start_frame, a.end_frame, a.overlap)
    said = {"start_frame": a.start_frame, "end_frame": a.end_frame, "overlap": a.overlap, "selected_images": _within(images, a.start_frame, a.end_frame)}
    return _rematch(spark, a, plan, images, said)


@command("prepare-cross-rematch", database=(str, MUST), pair_list=(str, MUST), report=(str, MUST), first_start_frame=(int, MUST), first_end_frame=(int, MUST), second_start_frame=(int, MUST), second_end_frame=(int, MUST))
def cross_rematch(spark, a) -> dict:
    images = _images(spark, a)
    plan = pairs.cross(images, (a.first_start_frame, a.first_end_frame), (a.second_start_frame, a.second_end_frame))
    said = {k: getattr(a, k) for k in ("first_start_frame", "first_end_frame", "second_start_frame", "second_end_frame")}
    said |= {"first_images": _within(images, a.first_start_frame, a.first_end_frame), "second_images": _within(images, a.second_start_frame, a.second_end_frame)}
    need(said["first_images"] > 0 and said["second_images"] > 0, "both intervals need images")
    return _rematch(spark, a, plan, images, said)


@command("stitch-metric-components", main_model_dir=(str, MUST), secondary_model_dir=(str, MUST), images_dir=(str, MUST), output_dir=(str, MUST), main_tape_frame=(int, 750), secondary_tape_frame=(int, 660), main_seam_frame=(int, 706), secondary_seam_frame=(int, 705), known_distance_m=(float, 1.2192))
def stitch_components(spark, a) -> dict:
    return write_stitch(spark, a.output_dir, *stitch(spark, a.main_model_dir, a.secondary_model_dir, a.images_dir, a.main_tape_frame, a.secondary_tape_frame, a.main_seam_frame, a.secondary_seam_frame, a.known_distance_m))


def write_stitch(spark: SparkSession, folder: str, report: dict, points: DataFrame, cameras: DataFrame) -> dict:
    sinks.ascii_ply(points, f"{folder}/map.ply", ["point3d_id"])
    sinks.csv(cameras.select(F.col("frame").alias("frame_index"), "image_name", *[F.col(x).alias(f"{x}_m") for x in "xyz"], "component"), f"{folder}/trajectory.csv", ["frame_index"])
    main = F.col("component") == "main"
    coloured = cameras.select("frame", "x", "y", "z", *[F.when(main, p).otherwise(q).alias(n) for n, p, q in (("red", 40, 255), ("green", 140, 130), ("blue", 255, 40))])
    sinks.ascii_ply(coloured, f"{folder}/trajectory.ply", ["frame"])
    return save(spark, f"{folder}/report.json", report)


#: Colours of a preview's components, largest first; the last one is for all others.
PALETTE = ((230, 105, 55), (45, 120, 230), (95, 180, 70), (190, 75, 180), (205, 185, 80))


@command("dense-qa", mesh_ply=(str, MUST), output_dir=(str, MUST))
def dense_qa(spark, a) -> dict:
    v, t = files.ply_vertices(spark, a.mesh_ply), files.ply_triangles(spark, a.mesh_ply)
    need(not v.isEmpty() and not t.isEmpty(), "the mesh needs vertices and triangles")
    areas, labels = written(mesh.triangle_areas(v, t), "areas"), written(mesh.roots(v, t), "labels")
    table = written(mesh.component_table(v, areas, labels), "ranked")
    report = {"source_mesh": a.mesh_ply, "vertices": v.count(), "triangles": areas.count()} | mesh.gates(table, areas, mesh.edge_summary(t)).first().asDict()
    report["bounding_box"] = mesh.bounding_box(v).first().asDict()
    report["largest_two_centroid_distance_m"] = mesh.centroid_gap(table).first()["centroid_distance"]
    report["largest_two_sampled_gap_m"] = mesh.sampled_gap(v, labels, table).first()["gap"]
    top = table.orderBy("rank").limit(10).withColumns({f"extent_{x}": F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"})
    report["components"] = [r.asDict() for r in top.collect()]
    pixels = sinks.raster(mesh.coloured(v, labels, table, PALETTE), ["red", "green", "blue"], "vid", 1400, 900)
    sinks.write_bytes(spark, f"{a.output_dir}/dense_components.png", sinks.png(sinks.canvas(pixels, 1400, 900, 242)))
    return save(spark, f"{a.output_dir}/report.json", report)


@command("plan-sparse", images_dir=(str, MUST), workspace=(str, MUST), camera_model=(str, "SIMPLE_RADIAL"), max_num_features=(int, 4096), sequential_overlap=(int, 40), loop_anchor_window=(int, 10), min_num_matches=(int, 15), mapper_profile=(str, "baseline"), use_gpu=(bool, False), matched_database=(str, None))
def plan_sparse(spark, a) -> dict:
    """Writes the loop pairs and the solver's command lines of a sparse run into an empty workspace; the solver itself is started by hand."""
    cfg = sparse.SparseConfig(a.camera_model, a.max_num_features, a.sequential_overlap, a.loop_anchor_window, a.min_num_matches, a.mapper_profile, a.use_gpu)
    sinks.refuse_non_empty(spark, a.workspace)
    plan, n = sparse.loop_plan(spark, a.images_dir, cfg.loop_anchor_window), files.jpgs(spark, a.images_dir).count()
    if a.matched_database:
        sparse.check_database(spark, a.matched_database, n)
    sinks.pair_list(plan, f"{a.workspace}/loop_pairs.txt")
    stages = [{"stage": r["stage"], "argv": list(r["argv"])} for r in sparse.commands(spark, a.workspace, cfg, bool(a.matched_database)).orderBy("place").collect()]
    return save(spark, f"{a.workspace}/plan.json", {"images": n, "loop_pairs": plan.count(), "config": asdict(cfg), "reused_matched_database": bool(a.matched_database), "commands": stages})


@command("sparse-report", logs_dir=(str, MUST), output=(str, MUST))
def sparse_report(spark, a) -> dict:
    """The model with most registered images among the analyzer logs of a folder."""
    return sinks.json_report(spark, sparse.report(spark, a.logs_dir), a.output)


@command("check-bundle", bundle_dir=(str, MUST), output=(str, MUST))
def check_bundle(spark, a) -> dict:
    """Whether a dense input bundle has what its manifest names; a component that hasn't is an error."""
    found = [r.asDict() for r in files.bundle(spark, a.bundle_dir).orderBy("component").collect()]  # one row a component
    save(spark, a.output, {"components": found})
    wrong = [r["component"] for r in found if not r["ok"]]
    need(bool(found) and not wrong, f"the bundle is not whole: {wrong or 'no components'}")
    return {"components": found}


@command("dense-summary", clouds=(str, MUST), output_dir=(str, MUST), voxel_size_m=(float, 0.02), neighbours=(int, 20), ratio=(float, 2.5))
def dense_summary(spark, a) -> dict:
    """Cleans and fuses the clouds of a Parquet table (component, x, y, z in metres) and writes the fused cloud."""
    points = spark.read.parquet(a.clouds).select("component", "x", "y", "z")
    fused, summary = clouds.dense_summary(points, "voxel", a.voxel_size_m, a.neighbours, a.ratio)
    fused = written(fused, "fused")
    grey = fused.select("x", "y", "z", *[F.lit(128).alias(c) for c in ("red", "green", "blue")])
    sinks.ascii_ply(grey, f"{a.output_dir}/dense.ply", ["x", "y", "z"])
    return save(spark, f"{a.output_dir}/report.json", {"dense_points": fused.count(), "voxel_size_m": a.voxel_size_m, "components": [r.asDict() for r in summary.orderBy("component").collect()]})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panoply", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        one = sub.add_parser(name, help=f.__doc__)
        for option, (kind, default) in options.items():
            flag = "--" + option.replace("_", "-")
            if kind is bool:
                one.add_argument(flag, action="store_true")
            else:
                one.add_argument(flag, type=kind, required=default is MUST, default=None if default is MUST else default)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    report = COMMANDS[a.command][0](spark or session("panoply"), a)
    print(json.dumps(report, indent=2))
    return report


if __name__ == "__main__":
    main()
