"""What the external sparse solver is asked to do: its command lines as data, the checks before it, the report after it. Nothing is started."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clouds, pairs
from ..schemas import need
from ..sources import files

# The solver's options and what each profile sets them to, baseline and fast.
PROFILES = ("baseline", "fast")
MAPPER = {
    "--Mapper.ba_local_max_num_iterations": ("25", "10"),
    "--Mapper.ba_local_max_refinements": ("2", "1"),
    "--Mapper.ba_global_images_ratio": ("1.1", "1.5"),
    "--Mapper.ba_global_points_ratio": ("1.1", "1.5"),
    "--Mapper.ba_global_max_num_iterations": ("50", "20"),
    "--Mapper.ba_global_max_refinements": ("5", "2"),
}
# Stage, solver command, and its options with the setting that each takes.
STAGES = [
    ("feature_extractor", "feature_extractor", ["--database_path database", "--image_path images", "--ImageReader.camera_model camera_model", "--ImageReader.single_camera one", "--SiftExtraction.use_gpu gpu", "--SiftExtraction.max_num_features max_num_features"]),
    ("sequential_matcher", "sequential_matcher", ["--database_path database", "--SiftMatching.use_gpu gpu", "--SequentialMatching.overlap sequential_overlap"]),
    ("loop_pairs", "matches_importer", ["--database_path database", "--match_list_path pairs", "--match_type kind", "--SiftMatching.use_gpu gpu"]),
    ("mapper", "mapper", ["--database_path database", "--image_path images", "--output_path sparse", "--Mapper.min_num_matches min_num_matches"]),
]


@dataclass(frozen=True)
class SparseConfig:
    camera_model: str = "SIMPLE_RADIAL"
    max_num_features: int = 4096
    sequential_overlap: int = 40
    loop_anchor_window: int = 10
    min_num_matches: int = 15
    mapper_profile: str = "baseline"
    use_gpu: bool = False

    def __post_init__(self):
        need(bool(self.camera_model.strip()), "camera_model must not be blank")
        for name in ("max_num_features", "sequential_overlap", "loop_anchor_window", "min_num_matches"):
            need(getattr(self, name) > 0, f"{name} must be positive")
        need(self.mapper_profile in PROFILES, f"mapper_profile is one of {', '.join(PROFILES)}")


def commands(spark: SparkSession, workspace: str, cfg: SparseConfig, reuse: bool = False) -> DataFrame:
    """place, stage, argv: the solver's command lines in order; with a matched database to reuse, the mapper's alone."""
    settings = {"one": "1", "kind": "pairs", "gpu": str(int(cfg.use_gpu)), **{k: str(v) for k, v in asdict(cfg).items()}}
    settings |= {name: f"{workspace.rstrip('/')}/{file}" for name, file in (("database", "database.db"), ("images", "images"), ("sparse", "sparse"), ("pairs", "loop_pairs.txt"))}
    rows = []
    for place, (stage, command, options) in enumerate(STAGES):
        argv = ["colmap", command]
        for option, setting in map(str.split, options):
            argv += [option, settings[setting]]
        rows.append((place, stage, argv))
    for option, values in MAPPER.items():
        rows[-1][2].extend([option, values[PROFILES.index(cfg.mapper_profile)]])
    return spark.createDataFrame(rows[-1:] if reuse else rows, "place int, stage string, argv array<string>")


def loop_plan(spark: SparkSession, images: str, window: int) -> DataFrame:
    """a, b: the first images of a folder with its last ones. Fewer than two images are an error."""
    names = files.jpgs(spark, images).select(F.lit(0).alias("model_id"), "name")
    need(len(names.take(2)) == 2, f"{images} needs two JPG images")
    return pairs.loop(names, window).select("a", "b")


def check_database(spark: SparkSession, database: str, images: int) -> None:
    """A matched database is reused only if it has as many images as the folder."""
    held = files.sqlite_table(spark, database, "SELECT count(*) FROM images", "n long").first()
    need(held is not None and held["n"] == images, f"the matched database has {held and held['n']} images, the folder {images}")


def report(spark: SparkSession, logs: str) -> DataFrame:
    """The analyzed model with most registered images among a folder's analyzer logs, ties to the first name: name and what its log says."""
    found = files.analyzer_log(spark, logs, name=True).withColumn("k", F.lit(0))
    return clouds.best_model(found, "k", "registered_images", "name").drop("k")
