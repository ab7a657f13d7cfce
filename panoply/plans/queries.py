"""The engine's registered queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import clouds, keyframes, mesh, pairs, preflight, sequence, trajectory
from ..schemas import KeyframeConfig
from ..session import written
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Parameters for event-like frames: hours instead of seconds.
CFG = KeyframeConfig(min_interval_s=21600.0, max_interval_s=86400.0, motion_threshold=10.0, min_track_ratio=0.35, min_features=20, blur_percentile=20.0, coverage_bin_s=86400.0)


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as longs, doubles to these digits as the SQL rounds: the product with a power of ten is rounded, not the decimal that a double prints as."""
    near = lambda c: F.round(F.col(c) * 10.0**digits) / 10.0**digits
    return df.select(*[near(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# Trajectories

STEPS = f"""WITH {V.POSES}, s AS (SELECT *, sqrt(pow(cx - lag(cx) OVER o, 2) + pow(cy - lag(cy) OVER o, 2) + pow(cz - lag(cz) OVER o, 2)) AS step,
    image_id - lag(image_id) OVER o AS gap FROM p WINDOW o AS (PARTITION BY model_id ORDER BY image_name))"""
REPORT = STEPS + """, g AS (SELECT model_id, count(*) AS registered_images, sum(step) AS path_length_units, median(step) AS median_step_units, quantile_cont(step, 0.95) AS p95_step_units,
    max(step) AS max_step_units, max(gap) AS largest_frame_index_gap, arg_min({'cx': cx, 'cy': cy, 'cz': cz, 'w': w, 'x': x, 'y': y, 'z': z}, image_name) AS a,
    arg_max({'cx': cx, 'cy': cy, 'cz': cz, 'w': w, 'x': x, 'y': y, 'z': z}, image_name) AS b FROM s GROUP BY model_id),
  r AS (SELECT *, sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)+pow(a.cz-b.cz,2)) AS start_end_distance_units,
    degrees(2*acos(least(1, greatest(0, abs(a.w*b.w+a.x*b.x+a.y*b.y+a.z*b.z))))) AS orientation_closure_error_deg, max_step_units / nullif(median_step_units, 0) AS max_step_to_median_ratio FROM g)"""


@query(f"WITH {V.POSES} SELECT model_id, image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM p")
def traj_centers(spark, sf_dir):
    return rounded(trajectory.with_centers(V.poses(spark, sf_dir)).select("model_id", "image_id", "cx", "cy", "cz"))


@query(STEPS + " SELECT model_id, image_id, round(step, 6) AS step FROM s WHERE step IS NOT NULL")
def traj_steps(spark, sf_dir):
    return rounded(trajectory.steps(V.poses(spark, sf_dir)).select("model_id", "image_id", "step"))


_R = ["path_length_units", "start_end_distance_units", "position_closure_error_percent", "orientation_closure_error_deg", "median_step_units", "p95_step_units", "max_step_units", "max_step_to_median_ratio"]


@query(REPORT + ", q AS (SELECT *, start_end_distance_units / path_length_units * 100 AS position_closure_error_percent FROM r) SELECT model_id, registered_images, largest_frame_index_gap, " + ", ".join(f"round({c}, 5) AS {c}" for c in _R) + " FROM q")
def traj_report(spark, sf_dir):
    return rounded(trajectory.report(V.poses(spark, sf_dir)).select("model_id", "registered_images", "largest_frame_index_gap", *_R), 5)


@query(REPORT + """ SELECT model_id, registered_images / (registered_images + model_id * 4) >= 0.8 AS registration_gate, start_end_distance_units / path_length_units * 100 <= 5 AS position_gate, orientation_closure_error_deg <= 15 AS orientation_gate, max_step_to_median_ratio <= 10 AS step_gate FROM r""")
def traj_gates(spark, sf_dir):
    poses = V.poses(spark, sf_dir)
    expected = poses.groupBy("model_id").agg((F.count("*") + F.first("model_id") * 4).alias("expected_images"))
    g = trajectory.gates(trajectory.report(poses, expected=expected))
    names = {"registration_gate": "registration_rate_at_least_80_percent", "position_gate": "position_closure_error_at_most_5_percent", "orientation_gate": "orientation_closure_error_at_most_15_deg", "step_gate": "max_step_at_most_10x_median"}
    return g.select("model_id", *[F.col("gates")[v].alias(k) for k, v in names.items()])


# Frames

@query(f"WITH {V.IMAGES} SELECT model_id, max(d) AS largest_gap FROM (SELECT model_id, idx - lag(idx) OVER (PARTITION BY model_id ORDER BY name) AS d FROM i) GROUP BY model_id")
def largest_index_gap(spark, sf_dir):
    i = V.images(spark, sf_dir).withColumn("idx", X.frame_index_loose(F.col("name")))
    return sequence.largest_gap(i, ["model_id"], ["name"], "idx")


@query(f"WITH {V.IMAGES} SELECT model_id, idx + 1 AS first, n - 1 AS last FROM (SELECT model_id, idx, lead(idx) OVER (PARTITION BY model_id ORDER BY idx) AS n FROM (SELECT DISTINCT model_id, idx FROM i)) WHERE n - idx > 1")
def missing_ranges(spark, sf_dir):
    return sequence.missing_ranges(V.images(spark, sf_dir).withColumn("idx", X.frame_index_strict(F.col("name"))), ["model_id"], "idx")


_DIST = "round(min(sharpness), 6) AS minimum, round(quantile_cont(sharpness, 0.1), 6) AS p10, round(median(sharpness), 6) AS median, round(quantile_cont(sharpness, 0.9), 6) AS p90, round(max(sharpness), 6) AS maximum"


@query(f"WITH {V.FRAMES} SELECT video_id, {_DIST} FROM f GROUP BY video_id")
def quality_distribution(spark, sf_dir):
    return rounded(sequence.distribution(V.frames(spark, sf_dir), ["video_id"], "sharpness"))


@query(f"WITH {V.FRAMES} SELECT video_id, round(quantile_cont(sharpness, 0.2), 6) AS blur_threshold FROM f GROUP BY video_id")
def blur_threshold(spark, sf_dir):
    return rounded(keyframes.blur_thresholds(V.frames(spark, sf_dir), "video_id", 20.0))


@query(f"WITH {V.FRAMES} SELECT video_id, round(avg(brightness_mean), 6) AS brightness_mean, round(var_pop(sharpness), 4) AS sharpness_variance FROM f GROUP BY video_id")
def frame_moments(spark, sf_dir):
    g = V.frames(spark, sf_dir).groupBy("video_id").agg(F.avg("brightness_mean").alias("brightness_mean"), F.var_pop("sharpness").alias("sharpness_variance"))
    return g.select("video_id", F.round("brightness_mean", 6).alias("brightness_mean"), F.round("sharpness_variance", 4).alias("sharpness_variance"))


@query(f"WITH {V.FRAMES} SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY sequence) - 1 AS BIGINT) AS sequence, sequence AS source_frame FROM f WHERE sequence >= 2 AND (sequence - 2) % 5 = 0")
def stride_extract(spark, sf_dir):
    from pyspark.sql import Window

    f = V.frames(spark, sf_dir).where("sequence >= 2 and (sequence - 2) % 5 = 0")
    return f.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("sequence")) - 1).cast("long").alias("sequence"), F.col("sequence").alias("source_frame"))


@query(r"SELECT event_id, CAST(regexp_extract(n, '(?i)^frame_(\d+)_t(\d+(?:\.\d+)?)\.(jpg|jpeg|png)$', 1) AS BIGINT) AS sequence, CAST(regexp_extract(n, '(?i)^frame_(\d+)_t(\d+(?:\.\d+)?)\.(jpg|jpeg|png)$', 2) AS DOUBLE) AS timestamp_s FROM (SELECT event_id, printf('Frame_%05d_t%09.3f.', event_id, value) || CASE WHEN event_id % 3 = 0 THEN 'gif' ELSE 'JPG' END AS n FROM events) WHERE regexp_matches(n, '(?i)^frame_(\d+)_t(\d+(?:\.\d+)?)\.(jpg|jpeg|png)$')")
def name_grammar(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", F.concat(F.format_string("Frame_%05d_t%09.3f.", "event_id", "value"), F.when(F.col("event_id") % 3 == 0, "gif").otherwise("JPG")).alias("n")).where(F.col("n").rlike(X.CANDIDATE))
    return e.select("event_id", F.regexp_extract("n", X.CANDIDATE, 1).cast("long").alias("sequence"), F.regexp_extract("n", X.CANDIDATE, 2).cast("double").alias("timestamp_s"))


_NAMES = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a/frame_' || event_id || '.png' WHEN 1 THEN 'img' || event_id || '.png' ELSE 'none' END AS n FROM events"


def _names(spark, sf_dir):
    m = F.col("event_id") % 3
    return V.table(spark, sf_dir, "events").select("event_id", F.when(m == 0, F.concat(F.lit("a/frame_"), "event_id", F.lit(".png"))).when(m == 1, F.concat(F.lit("img"), "event_id", F.lit(".png"))).otherwise("none").alias("n"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id ELSE -1 END AS idx FROM ({_NAMES})")
def frame_index_loose(spark, sf_dir):
    return _names(spark, sf_dir).select("event_id", F.coalesce(X.frame_index_loose(F.col("n")), F.lit(-1)).alias("idx"))


@query(f"SELECT event_id, event_id AS idx FROM ({_NAMES}) WHERE event_id % 3 = 0")
def frame_index_drop(spark, sf_dir):
    return _names(spark, sf_dir).select("event_id", X.frame_index_drop(F.col("n")).alias("idx")).where("idx is not null")


KEYFRAMES = f"""WITH RECURSIVE {V.FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_s, sequence) AS rn, count(*) OVER (PARTITION BY video_id) AS cnt,
    quantile_cont(sharpness, 0.2) OVER (PARTITION BY video_id) AS blur FROM f),
  w AS (SELECT video_id, sequence, rn, timestamp_s, sharpness, feature_count, true AS selected, 'first_frame' AS reason, timestamp_s AS lt, sharpness AS lv FROM n WHERE rn = 1
    UNION ALL SELECT video_id, sequence, rn, timestamp_s, sharpness, feature_count, sel, reason, CASE WHEN sel THEN timestamp_s ELSE lt END, CASE WHEN sel THEN sharpness ELSE lv END
    FROM (SELECT *, reason IN ('last_frame', 'selected_max_gap_fallback', 'selected_motion') AS sel FROM (SELECT n.*, w.lt, w.lv, CASE WHEN n.rn = n.cnt THEN 'last_frame'
      WHEN n.timestamp_s - w.lt < 21600 THEN 'reject_min_interval' WHEN n.timestamp_s - w.lt >= 86400 THEN 'selected_max_gap_fallback' WHEN n.sharpness < n.blur THEN 'reject_blur'
      WHEN n.feature_count < 20 THEN 'reject_low_features' WHEN abs(n.sharpness - w.lv) > 150 THEN 'reject_low_overlap' WHEN abs(n.sharpness - w.lv) >= 10 THEN 'selected_motion'
      ELSE 'reject_low_motion' END AS reason FROM w JOIN n ON n.video_id = w.video_id AND n.rn = w.rn + 1)))"""
BINS = """, sp AS (SELECT video_id, min(timestamp_s) AS s, max(timestamp_s) AS e FROM w GROUP BY video_id),
  bi AS (SELECT video_id, s, e, unnest(range(CAST(greatest(1, ceil(greatest(e - s, 1e-9) / 86400)) AS BIGINT))) AS bin FROM sp),
  bb AS (SELECT video_id, bin, s + bin * 86400.0 AS start_s, least(e, s + bin * 86400.0 + 86400.0) AS end_s FROM bi),
  bc AS (SELECT bb.video_id, bin, start_s, end_s, count(w.rn) AS candidate_count, count(w.rn) FILTER (WHERE w.selected) AS selected_count
    FROM bb LEFT JOIN w ON w.video_id = bb.video_id AND w.timestamp_s BETWEEN start_s AND end_s GROUP BY ALL)"""


def _decisions(spark, sf_dir):
    return keyframes.select(V.frames(spark, sf_dir), CFG)


@query(KEYFRAMES + " SELECT video_id, sequence, selected, reason FROM w")
def keyframe_select(spark, sf_dir):
    return _decisions(spark, sf_dir).select("video_id", "sequence", "selected", "reason")


@query(KEYFRAMES + " SELECT video_id, reason, count(*) AS n FROM w GROUP BY ALL")
def decision_counts(spark, sf_dir):
    return _decisions(spark, sf_dir).groupBy("video_id", "reason").agg(F.count("*").alias("n"))


@query(KEYFRAMES + " SELECT video_id, round(coalesce(max(d), 0), 6) AS max_gap_s FROM (SELECT video_id, timestamp_s - lag(timestamp_s) OVER (PARTITION BY video_id ORDER BY timestamp_s) AS d FROM w WHERE selected) GROUP BY video_id")
def selected_gaps(spark, sf_dir):
    return rounded(sequence.selected_gaps(_decisions(spark, sf_dir).where("selected"), ["video_id"], "timestamp_s"))


@query(KEYFRAMES + BINS + " SELECT video_id, bin, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, candidate_count, selected_count, selected_count > 0 AS covered FROM bc")
def coverage_bins(spark, sf_dir):
    return rounded(sequence.coverage_bins(written(_decisions(spark, sf_dir), "decisions"), ["video_id"], "timestamp_s", "selected", CFG.coverage_bin_s))


@query(KEYFRAMES + BINS + """ SELECT video_id, count(*) AS total_bins, count(*) FILTER (WHERE selected_count > 0) AS covered_bins, round(avg(CASE WHEN selected_count > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage_fraction, bool_and(selected_count > 0) AS all_covered FROM bc GROUP BY video_id""")
def coverage_report(spark, sf_dir):
    b = sequence.coverage_bins(written(_decisions(spark, sf_dir), "decisions"), ["video_id"], "timestamp_s", "selected", CFG.coverage_bin_s)
    return rounded(b.groupBy("video_id").agg(F.count("*").alias("total_bins"), F.count_if("covered").alias("covered_bins"), F.avg(F.col("covered").cast("double")).alias("coverage_fraction"), F.bool_and("covered").alias("all_covered")))


@query(KEYFRAMES + BINS + """, g AS (SELECT video_id, count(*) AS candidate_frames, count(*) FILTER (WHERE selected) AS selected_keyframes, max(timestamp_s) - min(timestamp_s) AS duration_s FROM w GROUP BY video_id),
  k AS (SELECT video_id, count(*) AS total_bins, count(*) FILTER (WHERE selected_count > 0) AS covered_bins FROM bc GROUP BY video_id),
  m AS (SELECT video_id, coalesce(max(d), 0) AS max_gap FROM (SELECT video_id, timestamp_s - lag(timestamp_s) OVER (PARTITION BY video_id ORDER BY timestamp_s) AS d FROM w WHERE selected) GROUP BY video_id)
  SELECT video_id, candidate_frames, selected_keyframes, round(selected_keyframes / candidate_frames, 6) AS selection_rate, round(duration_s, 6) AS duration_s, covered_bins, total_bins,
    covered_bins = total_bins AS all_time_bins_covered, round(max_gap, 6) AS max_selected_gap_s, max_gap <= 1.5 * 86400 AS max_gap_at_most_1_5x_target FROM g JOIN k USING (video_id) JOIN m USING (video_id)""")
def keyframe_report(spark, sf_dir):
    r = keyframes.report(_decisions(spark, sf_dir), CFG)
    return rounded(r.select("video_id", "candidate_frames", "selected_keyframes", "selection_rate", "duration_s", "covered_bins", "total_bins", "all_time_bins_covered", "max_selected_gap_s", "max_gap_at_most_1_5x_target"))


#: Parameters for one long video of each event type: half an hour to two hours between keyframes, so that a video has many blocks.
LONG = replace(CFG, min_interval_s=1800.0, max_interval_s=7200.0)


@query(KEYFRAMES.replace("user_id", "event_type").replace("21600", "1800").replace("86400", "7200") + " SELECT video_id, sequence, selected, reason FROM w")
def keyframe_long_videos(spark, sf_dir):
    """All events of a type as one video, decided block by block."""
    return keyframes.select(V.frames(spark, sf_dir, "event_type"), LONG).select("video_id", "sequence", "selected", "reason")


# Preflight

_LOW = f"""WITH {V.FRAMES}, r AS (SELECT *, row_number() OVER o AS rn, lag(timestamp_s) OVER o AS since, CASE WHEN lag(sharpness) OVER o IS NOT NULL THEN greatest(0, 1 - abs(sharpness - lag(sharpness) OVER o) / 500) END AS track FROM f WINDOW o AS (PARTITION BY video_id ORDER BY timestamp_s, sequence))"""


@query(_LOW + """ SELECT video_id, round(min(since), 6) AS since, round(min(timestamp_s), 6) AS start, round(max(timestamp_s), 6) AS end, count(*) AS rows
    FROM (SELECT *, rn - row_number() OVER (PARTITION BY video_id ORDER BY rn) AS g FROM r WHERE track < 0.5) GROUP BY video_id, g""")
def low_track_intervals(spark, sf_dir):
    f = preflight.with_tracks(V.frames(spark, sf_dir), ["video_id"], 500.0)
    return rounded(sequence.islands(f, ["video_id"], preflight.ORDER, F.col("track_ratio") < 0.5, "timestamp_s"))


@query("SELECT l_linestatus, length, count(*) AS points FROM (SELECT l_linestatus, l_partkey, count(DISTINCT l_orderkey) AS length FROM lineitem GROUP BY ALL) GROUP BY ALL")
def track_lengths(spark, sf_dir):
    """Parts as points and orders as images, for the two line states as models."""
    return preflight.track_lengths(V.table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_partkey", "l_orderkey")


@query("""SELECT l_linestatus, count(*) AS points, CAST(sum(length) AS BIGINT) AS observations, round(avg(length), 6) AS mean_length, max(length) AS longest, median(length) AS median_length, round(quantile_cont(length, 0.9), 6) AS p90_length
    FROM (SELECT l_linestatus, l_partkey, count(DISTINCT l_orderkey) AS length FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def track_summary(spark, sf_dir):
    return rounded(preflight.track_summary(V.table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_partkey", "l_orderkey"))


# Image pairs

@query(f"WITH {V.IMAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY name) AS k, count(*) OVER (PARTITION BY model_id) AS n FROM i) SELECT x.model_id, x.name AS a, y.name AS b FROM r x JOIN r y ON x.model_id = y.model_id AND x.k <= least(10, x.n // 2) AND y.k > y.n - least(10, y.n // 2)")
def loop_pairs(spark, sf_dir):
    return pairs.loop(V.images(spark, sf_dir), 10)


_PAIR = "2147483647 * least(x.image_id, y.image_id) + greatest(x.image_id, y.image_id) AS pair_id"
TARGETED = f"t AS (SELECT x.model_id, x.image_id AS id_a, y.image_id AS id_b, x.idx AS idx_a, y.idx AS idx_b, {_PAIR} FROM i x JOIN i y ON x.model_id = y.model_id AND x.idx BETWEEN 0 AND 1000000000 AND y.idx BETWEEN 0 AND 1000000000 AND y.idx > x.idx AND y.idx - x.idx <= 12)"


def _targeted(spark, sf_dir):
    return pairs.targeted(V.images(spark, sf_dir), 0, 1_000_000_000, 12)


@query(f"WITH {V.IMAGES}, {TARGETED} SELECT * FROM t")
def targeted_pairs(spark, sf_dir):
    return _targeted(spark, sf_dir)


@query(f"WITH {V.IMAGES}, h AS (SELECT (max(idx) + 1) // 2 AS half FROM i) SELECT x.model_id, x.image_id AS id_a, x.idx AS idx_a, y.image_id AS id_b, y.idx AS idx_b, {_PAIR} FROM h, i x JOIN i y ON x.model_id = y.model_id WHERE x.idx < half AND y.idx >= half")
def cross_pairs(spark, sf_dir):
    """Every image of the first half of the capture with those of the second, model by model."""
    i = V.images(spark, sf_dir)
    last = pairs.indexed(i).agg(F.max("idx")).first()[0]
    half = (last + 1) // 2
    return pairs.cross(i, (0, half - 1), (half, last))


@query(f"WITH {V.IMAGES} SELECT x.model_id, {_PAIR} FROM i x JOIN i y ON x.model_id = y.model_id AND y.image_id = x.image_id + 1")
def pair_ids(spark, sf_dir):
    i = V.images(spark, sf_dir)
    nxt = i.select("model_id", (F.col("image_id") - 1).alias("image_id"), F.col("image_id").alias("b"))
    return i.join(nxt, ["model_id", "image_id"]).select("model_id", X.pair_id(F.col("b"), F.col("image_id")).alias("pair_id"))


_STORED = f"WITH {V.IMAGES}, {TARGETED}, {V.stored_sql('m', 3)}, {V.stored_sql('g', 5)}"


@query(_STORED + " SELECT (SELECT count(*) FROM m SEMI JOIN t USING (model_id, pair_id)) AS matches_removed, (SELECT count(*) FROM g SEMI JOIN t USING (model_id, pair_id)) AS geometries_removed")
def match_invalidate_counts(spark, sf_dir):
    plan, key = _targeted(spark, sf_dir), ["model_id", "pair_id"]
    m = pairs.planned(V.stored_pairs(spark, sf_dir, 3), plan, key).agg(F.count("*").alias("matches_removed"))
    g = pairs.planned(V.stored_pairs(spark, sf_dir, 5), plan, key).agg(F.count("*").alias("geometries_removed"))
    return m.join(g)


@query(_STORED + " SELECT model_id, pair_id FROM m ANTI JOIN t USING (model_id, pair_id)")
def matches_after_delete(spark, sf_dir):
    return pairs.without_planned(V.stored_pairs(spark, sf_dir, 3), _targeted(spark, sf_dir), ["model_id", "pair_id"])


@query("WITH m AS (SELECT o_orderpriority AS run, o_orderstatus AS model, count(*) AS registered_images FROM orders GROUP BY ALL) SELECT run, model, registered_images FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY coalesce(registered_images, 0) DESC, model) AS r FROM m) WHERE r = 1")
def best_model(spark, sf_dir):
    m = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("model")).agg(F.count("*").alias("registered_images"))
    return clouds.best_model(m, "run", "registered_images", "model")


# Scale, clouds, stitching

CHECKS = """a AS (SELECT p_brand, arg_min(p_retailprice, p_partkey) / arg_min(p_size, p_partkey) AS meters_per_unit FROM part GROUP BY p_brand),
  k AS (SELECT p_brand AS brand, p_partkey AS item, p_retailprice AS actual_m, p_size * meters_per_unit AS estimated_m FROM part JOIN a USING (p_brand)),
  r AS (SELECT *, abs(estimated_m - actual_m) AS absolute_error_m, abs(estimated_m - actual_m) / actual_m * 100 AS percent_error FROM k)"""


def _checks(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    a = p.groupBy("p_brand").agg((F.min_by("p_retailprice", "p_partkey") / F.min_by("p_size", "p_partkey")).alias("meters_per_unit"))
    c = p.join(a, "p_brand").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("actual_m"), F.col("p_size").alias("units"), "meters_per_unit")
    return clouds.scale_checks(c, "brand").select("brand", "item", "actual_m", "estimated_m", "absolute_error_m", "percent_error")


@query(f"WITH {CHECKS} SELECT brand, item, round(actual_m, 6) AS actual_m, round(estimated_m, 6) AS estimated_m, round(absolute_error_m, 6) AS absolute_error_m, round(percent_error, 6) AS percent_error FROM r")
def scale_report(spark, sf_dir):
    return rounded(_checks(spark, sf_dir))


@query(f"WITH {CHECKS} SELECT brand, count(*) AS checks, round(avg(absolute_error_m), 5) AS mean_absolute_error_m, round(avg(percent_error), 5) AS mean_percent_error FROM r GROUP BY brand")
def scale_summary(spark, sf_dir):
    return rounded(clouds.scale_summary(_checks(spark, sf_dir), "brand"), 5)


@query(f"WITH {CHECKS} SELECT brand, count(*) AS checks, round(median(percent_error), 5) AS median_percent_error, round(max(percent_error), 5) AS worst_percent_error, median(percent_error) <= 5 AND max(percent_error) <= 10 AS dimensions_gate FROM r GROUP BY brand")
def dimension_gates(spark, sf_dir):
    return rounded(preflight.dimension_gates(_checks(spark, sf_dir), "brand"), 5)


TURN, SHIFT, SCALE = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [0.5, -0.25, 1.0], 1.2272


@query(f"WITH {V.POINTS} SELECT point3d_id, round(-{SCALE} * y + 0.5, 6) AS x, round({SCALE} * x - 0.25, 6) AS y, round({SCALE} * z + 1.0, 6) AS z FROM c")
def point_transform(spark, sf_dir):
    return rounded(clouds.moved(V.points(spark, sf_dir), SCALE, TURN, SHIFT).select("point3d_id", "x", "y", "z"))


@query(f"WITH {V.POINTS} SELECT point3d_id, 'main' AS component, round(x * 0.655, 6) AS x, round(y * 0.655, 6) AS y, round(z * 0.655, 6) AS z FROM c WHERE label % 2 = 0 UNION ALL SELECT point3d_id, 'secondary', round((-{SCALE} * y + 0.5) * 0.655, 6), round(({SCALE} * x - 0.25) * 0.655, 6), round(({SCALE} * z + 1.0) * 0.655, 6) FROM c WHERE label % 2 = 1")
def merged_cloud(spark, sf_dir):
    p = V.points(spark, sf_dir)
    m = clouds.merged(p.where("label % 2 = 0"), clouds.moved(p.where("label % 2 = 1"), SCALE, TURN, SHIFT), 0.655)
    return rounded(m.select("point3d_id", "component", "x", "y", "z"))


@query(f"WITH {V.POSES} SELECT row_number() OVER (ORDER BY image_id, model_id) AS place, image_id AS frame, CASE WHEN model_id % 2 = 0 THEN 'main' ELSE 'secondary' END AS component, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM p")
def merged_cameras(spark, sf_dir):
    from pyspark.sql import Window

    c = trajectory.with_centers(V.poses(spark, sf_dir)).withColumn("component", F.when(F.col("model_id") % 2 == 0, "main").otherwise("secondary"))
    c = sequence.numbered(c, [], ["image_id", "model_id"], "place")
    return rounded(c.select((F.col("place") + 1).alias("place"), F.col("image_id").alias("frame"), "component", "cx", "cy", "cz"))


_SEAM = f"WITH {V.POINTS}, d AS (SELECT s.point3d_id, min(sqrt(pow(s.x-m.x,2)+pow(s.y-m.y,2)+pow(s.z-m.z,2))) AS nearest FROM c s JOIN c m ON s.label = 1 AND m.label = 0 GROUP BY 1)"


def _seam(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return clouds.nearest(p.where("label = 1"), p.where("label = 0"), "point3d_id")


@query(_SEAM + " SELECT point3d_id, round(nearest, 6) AS nearest FROM d")
def seam_nn(spark, sf_dir):
    return rounded(_seam(spark, sf_dir))


@query(_SEAM + " SELECT round(median(nearest), 6) AS seam_median_m, round(avg(CASE WHEN nearest <= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS seam_within_fraction, median(nearest) <= 0.25 AND avg(CASE WHEN nearest <= 0.25 THEN 1.0 ELSE 0.0 END) >= 0.5 AS seam_geometry_gate_passed FROM d")
def seam_gate(spark, sf_dir):
    return rounded(clouds.seam_gate(_seam(spark, sf_dir)))


@query("SELECT l_orderkey AS image_id, l_linenumber AS ordinal, l_partkey AS point3d_id, l_extendedprice AS u, l_quantity AS v, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 40")
def observation_points(spark, sf_dir):
    o = V.table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("point3d_id"), F.col("l_extendedprice").alias("u"), F.col("l_quantity").alias("v"))
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point3d_id"), F.col("p_size").alias("size"))
    return o.join(p, "point3d_id").select("image_id", "ordinal", "point3d_id", "u", "v", "size")


@query("SELECT DISTINCT l_partkey AS point3d_id FROM lineitem, (SELECT max(l_orderkey) AS last FROM lineitem) WHERE l_orderkey BETWEEN last // 10 AND last - last // 10 AND l_partkey <> -1")
def frame_range_points(spark, sf_dir):
    """Points seen between the first and the last tenth of the frames."""
    o = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    last = o.agg(F.max("l_orderkey")).first()[0]
    o = o.where(F.col("l_orderkey").between(last // 10, last - last // 10) & (F.col("l_partkey") != -1))
    return o.select(F.col("l_partkey").alias("point3d_id")).distinct()


@query(f"WITH {V.POINTS} SELECT label, CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS points FROM c GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY label, floor(x / 0.1), floor(y / 0.1), floor(z / 0.1)"))
def voxel_downsample(spark, sf_dir):
    return rounded(clouds.voxels(V.points(spark, sf_dir), 0.1, ["label"]))


@query("SELECT user_id, event_id, value FROM events JOIN (SELECT user_id, quantile_cont(value, 0.03) AS c FROM events GROUP BY user_id) USING (user_id) WHERE value >= c")
def density_cut(spark, sf_dir):
    return clouds.density_cut(V.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", ["user_id"])


_KNN = f"WITH {V.POINTS}, d AS (SELECT a.point3d_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS d, b.x, b.y, b.z FROM c a, c b), n AS (SELECT *, row_number() OVER (PARTITION BY point3d_id ORDER BY d, x, y, z) AS r FROM d)"


@query(_KNN + ", m AS (SELECT point3d_id, avg(d) AS mean_distance FROM n WHERE r <= 20 GROUP BY 1) SELECT point3d_id, round(mean_distance, 6) AS mean_distance FROM m")
def neighbour_distances(spark, sf_dir):
    return rounded(clouds.neighbour_distance(V.points(spark, sf_dir), "point3d_id"))


@query(_KNN + ", m AS (SELECT point3d_id, avg(d) AS mean_distance FROM n WHERE r <= 20 GROUP BY 1) SELECT point3d_id FROM m WHERE mean_distance > 0 AND mean_distance < (SELECT avg(mean_distance) + 2.5 * coalesce(stddev_samp(mean_distance), 0) FROM m)")
def outlier_removal(spark, sf_dir):
    return clouds.without_outliers(V.points(spark, sf_dir), "point3d_id").select("point3d_id")


@query(_KNN + " SELECT point3d_id, count(*) AS neighbours, round(covar_pop(x, x), 8) AS xx, round(covar_pop(x, y), 8) AS xy, round(covar_pop(x, z), 8) AS xz, round(covar_pop(y, y), 8) AS yy, round(covar_pop(y, z), 8) AS yz, round(covar_pop(z, z), 8) AS zz FROM n WHERE d <= 0.1 AND r <= 40 GROUP BY 1")
def normal_moments(spark, sf_dir):
    return rounded(clouds.neighbour_moments(V.points(spark, sf_dir), "point3d_id"), 8)


# Meshes

@query(f"WITH {V.MESH} SELECT fid, round(area, 4) AS area, area <= 1e-12 AS degenerate FROM ta")
def triangle_area(spark, sf_dir):
    return mesh.triangle_areas(V.vertices(spark, sf_dir), V.triangles(spark, sf_dir)).select("fid", F.round("area", 4).alias("area"), "degenerate")


@query(f"WITH {V.MESH} SELECT count(*) FILTER (WHERE n = 1) AS boundary_edges, count(*) FILTER (WHERE n > 2) AS non_manifold_edges, count(*) FILTER (WHERE n = 1 OR n > 2) = 0 AS watertight FROM te")
def mesh_edges(spark, sf_dir):
    return mesh.edge_summary(V.triangles(spark, sf_dir))


@query(f"WITH {V.MESH} SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, round(sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)), 6) AS diagonal FROM v")
def mesh_global_bbox(spark, sf_dir):
    box = mesh.bounding_box(V.vertices(spark, sf_dir))
    return box.drop(*[c for c in box.columns if c.startswith("extent_")]).withColumn("diagonal", F.round("diagonal", 6))


_MESH = f"WITH RECURSIVE {V.MESH}, {V.ROOTS}, {V.COMPONENTS}"


def _mesh(spark, sf_dir):
    v, t = V.vertices(spark, sf_dir), V.triangles(spark, sf_dir)
    areas, labels = written(mesh.triangle_areas(v, t), "areas"), written(mesh.roots(v, t), "labels")
    return v, t, areas, labels, mesh.component_table(v, areas, labels)


@query(_MESH + " SELECT rank, root, vertices, triangles, round(vertex_fraction, 8) AS vertex_fraction, round(area, 3) AS area, round(centroid_x, 5) AS centroid_x, round(centroid_y, 5) AS centroid_y, round(centroid_z, 5) AS centroid_z FROM ct")
def mesh_components(spark, sf_dir):
    c = _mesh(spark, sf_dir)[4]
    return c.select(F.col("rank").cast("long").alias("rank"), "root", "vertices", "triangles", F.round("vertex_fraction", 8).alias("vertex_fraction"), F.round("area", 3).alias("area"), *[F.round(f"centroid_{a}", 5).alias(f"centroid_{a}") for a in "xyz"])


@query(_MESH + """ SELECT (SELECT count(*) FROM ct) AS connected_components, (SELECT count(*) FROM ct WHERE vertex_fraction >= 0.01) AS meaningful_components, (SELECT count(*) FROM te WHERE n = 1) AS boundary_edges,
  (SELECT count(*) FROM te WHERE n > 2) AS non_manifold_edges, (SELECT count(*) FROM ta WHERE area <= 1e-12) AS degenerate_triangles, (SELECT count(*) FROM te WHERE n = 1 OR n > 2) = 0 AS watertight,
  (SELECT vertex_fraction FROM ct WHERE rank = 1) >= 0.95 AS single_dominant_component_at_least_95_percent, coalesce((SELECT vertex_fraction FROM ct WHERE rank = 2), 0) <= 0.05 AS no_secondary_component_over_5_percent,
  (SELECT count(*) FROM te WHERE n > 2) = 0 AS no_non_manifold_edges, (SELECT count(*) FROM ta WHERE area <= 1e-12) = 0 AS no_degenerate_triangles""")
def mesh_gates(spark, sf_dir):
    _, t, areas, _, c = _mesh(spark, sf_dir)
    return mesh.gates(c, areas, mesh.edge_summary(t)).drop("surface_area", "largest_component_fraction", "second_component_fraction")


@query(_MESH + " SELECT round(min(sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2))), 6) AS gap FROM (SELECT * FROM v JOIN ro USING (vid) WHERE root = (SELECT root FROM ct WHERE rank = 1)) p, (SELECT * FROM v JOIN ro USING (vid) WHERE root = (SELECT root FROM ct WHERE rank = 2)) q")
def component_gap(spark, sf_dir):
    v, _, _, labels, c = _mesh(spark, sf_dir)
    return mesh.sampled_gap(v, labels, c).select(F.round("gap", 6).alias("gap"))


@query("SELECT rank, root, vertices FROM (" + _MESH + " SELECT rank, root, vertices FROM ct) WHERE rank <= 10")
def mesh_top_components(spark, sf_dir):
    return _mesh(spark, sf_dir)[4].orderBy("rank").limit(10).select(F.col("rank").cast("long").alias("rank"), "root", "vertices")


# Digests and JSON

@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def sha256_documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def manifest_json(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
