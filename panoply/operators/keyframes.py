"""Adaptive keyframe selection: an ordered fold for each video, and its report."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KeyframeConfig, need
from ..session import discard, small, written
from .sequence import coverage_bins, quantiles, same, selected_gaps



class Motion(NamedTuple):
    """A frame against the last selected one."""

    motion_ratio: float
    track_ratio: float
    initial_tracked_features: int = 0
    tracked_features: int = 0


class Decision(NamedTuple):
    selected: bool
    reason: str
    elapsed_s: float = 0.0
    motion_ratio: float = 0.0
    track_ratio: float = 0.0
    initial_tracked_features: int = 0
    tracked_features: int = 0


Pair = Callable[[dict, dict], Motion]


def blur_thresholds(frames: DataFrame, key: str, percentile: float) -> DataFrame:
    return quantiles(frames, [key], "sharpness", {"blur_threshold": percentile / 100})


def value_pair(scale: float = 1.0, reach: float = 150.0) -> Pair:
    """Motion from the change in sharpness; the one track is lost beyond ``reach``. For tables without pixels."""

    def pair(last: dict, now: dict) -> Motion:
        d = abs(now["sharpness"] - last["sharpness"])
        held = int(d <= reach)
        return Motion(d / scale, float(held), 1, held)

    return pair


def _settled(frame: dict, elapsed: float, is_last: bool, blur: float, cfg: KeyframeConfig) -> tuple[bool, str] | None:
    """What the rules before those on the pair decide; none if they leave it open."""
    rules = (
        (is_last, True, "last_frame"),
        (elapsed < cfg.min_interval_s, False, "reject_min_interval"),
        (elapsed >= cfg.max_interval_s, True, "selected_max_gap_fallback"),
        (frame["sharpness"] < blur, False, "reject_blur"),
        (frame["feature_count"] < cfg.min_features, False, "reject_low_features"),
    )
    return next(((s, r) for hit, s, r in rules if hit), None)


def decide(frame: dict, last: dict | None, is_last: bool, blur: float, cfg: KeyframeConfig, pair: Pair) -> Decision:
    """The order of the rules is their meaning."""
    if last is None:
        return Decision(True, "first_frame")
    elapsed = frame["timestamp_s"] - last["timestamp_s"]
    seen = pair(last, frame)
    rules = ((seen.track_ratio < cfg.min_track_ratio, False, "reject_low_overlap"), (seen.motion_ratio >= cfg.motion_threshold, True, "selected_motion"))
    selected, reason = _settled(frame, elapsed, is_last, blur, cfg) or next(((s, r) for hit, s, r in rules if hit), (False, "reject_low_motion"))
    return Decision(selected, reason, elapsed, *seen)


OUT = "sequence long, timestamp_s double, sharpness double, feature_count long, blur_threshold double, elapsed_s double, motion_ratio double, track_ratio double, initial_tracked_features long, tracked_features long, selected boolean, reason string"


#: State of a block whose first frame is selected whatever came before: nothing was selected within the longest interval.
OLD = (-1e300, -1)
#: A block's length in longest intervals.
SPAN = 64


def place(r: dict) -> tuple[float, int]:
    return r["timestamp_s"], r["sequence"]


def _following(rows: list[dict], last: dict, start: int, blur: float, cfg: KeyframeConfig, pair: Pair) -> int | None:
    """Which row from ``start`` on is selected next after ``last``. Frames are compared only where no other rule decides."""
    for i in range(start, len(rows)):
        settled = _settled(rows[i], rows[i]["timestamp_s"] - last["timestamp_s"], False, blur, cfg)
        if settled[0] if settled else decide(rows[i], last, False, blur, cfg, pair).selected:
            return i
    return None


def _exits(rows: list[dict], entries: list[dict], blur: float, cfg: KeyframeConfig, pair: Pair) -> list[tuple]:
    """For each frame that may be the last selected one when a block begins, and for OLD: the last selected one when it ends.

    Ways that meet go on together, so each row's successor is looked for once.
    """
    ends: dict[int, int] = {}

    def end(i: int) -> dict:
        way = []
        while i not in ends:
            way.append(i)
            j = _following(rows, rows[i], i + 1, blur, cfg, pair)
            if j is None:
                ends[i] = i
            else:
                i = j
        ends.update(dict.fromkeys(way, ends[i]))
        return rows[ends[i]]

    found = [(OLD, place(end(0)))]
    for e in entries:
        i = _following(rows, e, 0, blur, cfg, pair)
        found.append((place(e), place(e if i is None else end(i))))
    return found


def _split(pdf: pd.DataFrame) -> tuple[list[dict], list[dict]]:
    """A block's own frames in order, and those sent to it from earlier blocks."""
    pdf = pdf.sort_values(["timestamp_s", "sequence"])
    return tuple(pdf[m].to_dict("records") for m in (pdf["_own"], ~pdf["_own"]))


def _blocks(frames: DataFrame, key: str, cfg: KeyframeConfig, span: int) -> tuple[DataFrame, int]:
    """Frames with their video's threshold, whether they are its last (_last), the number of their block among its non-empty ones
    (_k), and whether they lie within the longest interval before the next one's first frame (_near); and the most blocks of a video."""
    f = written(frames.withColumn("_b", F.floor(F.col("timestamp_s") / (span * cfg.max_interval_s)).cast("long")), "frames")
    b = f.where("_b is not null").groupBy(F.col(key).alias(f"_{key}"), F.col("_b").alias("__b")).agg(F.min("timestamp_s").alias("_from"), F.max(F.struct("timestamp_s", "sequence")).alias("_end"))
    w = Window.partitionBy(f"_{key}").orderBy("__b")  # one row a block
    b = b.withColumns({"_next": F.lead("_from").over(w), "_k": (F.row_number().over(w) - 1).cast("long")})
    b = written(b.join(blur_thresholds(f, key, cfg.blur_percentile), F.col(f"_{key}").eqNullSafe(F.col(key))).drop(key), "blocks")
    most = (b.agg(F.max("_k")).first()[0] or 0) + 1
    f = f.join(small(b), same([key, "_b"])).drop(f"_{key}", "__b")
    f = f.withColumns({"_last": F.col("_next").isNull() & (F.struct("timestamp_s", "sequence") == F.col("_end")), "_near": F.coalesce(F.col("_next") - F.col("timestamp_s") < cfg.max_interval_s, F.lit(False))})
    return f.drop("_b", "_from", "_end", "_next"), most


def _lasts(rows: DataFrame, key: str, cfg: KeyframeConfig, pair: Pair, blocks: int, tasks: int | None = None) -> DataFrame:
    """The key, _k, _t, _s: the frame selected last before each block but a video's first.

    All blocks are followed at once, each from every frame that could be that one: a successor for each pair of block and frame.
    The way from a video's start is then marked by doubling: the states 1, 2, 4, ... blocks on from those already on it.
    """
    near = rows.where("_near").withColumns({"_k": F.col("_k") + 1, "_own": F.lit(False)})

    def run(pdf):
        own, held = _split(pdf)
        out = [(own[0][key], own[0]["_k"], *a, *b) for a, b in _exits(own, held, own[0]["blur_threshold"], cfg, pair)]
        return pd.DataFrame(out, columns=[key, "_k", "_t", "_s", "_et", "_es"]).drop_duplicates()

    every = rows.withColumn("_own", F.lit(True)).unionByName(near)
    if tasks:
        every = every.repartition(tasks, key, "_k")
    exits = every.groupBy(key, "_k").applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, _k long, _t double, _s long, _et double, _es long")
    exits = written(exits, "exits")
    known = near.select(F.col(key).alias(f"_{key}"), F.col("_k").alias("_nk"), F.col("timestamp_s").alias("_nt"), F.col("sequence").alias("_ns")).distinct()
    nexts = exits.join(known, [*same([key]), F.col("_k") + 1 == F.col("_nk"), F.col("_et") == F.col("_nt"), F.col("_es") == F.col("_ns")], "left")
    state, to, far = ("_k", "_t", "_s"), ("_zk", "_zt", "_zs"), ("_yk", "_yt", "_ys")
    jump = nexts.select(key, *state, (F.col("_k") + 1).alias("_zk"), F.coalesce("_nt", F.lit(OLD[0])).alias("_zt"), F.coalesce("_ns", F.lit(OLD[1])).alias("_zs"))
    named = lambda d, old, new: d.select(F.col(key).alias(f"_{key}"), *[F.col(a).alias(b) for a, b in zip(old, new, strict=True)])
    equal = lambda x, y: [*same([key]), *[F.col(a) == F.col(b) for a, b in zip(x, y, strict=True)]]
    seen = written(exits.where((F.col("_k") == 0) & (F.col("_t") == OLD[0])).select(key, *state), "marked")
    jump, reached = written(jump, "jump"), 1
    while reached < blocks:
        on = named(jump, (*state, *to), (*far, *to))
        seen_more = seen.join(on, equal(state, far)).select(key, *[F.col(a).alias(b) for a, b in zip(to, state, strict=True)])
        more = written(seen.union(seen_more), "marked")
        twice = jump.join(named(jump, (*state, *to), (*far, "_xk", "_xt", "_xs")), equal(to, far))
        twice = written(twice.select(key, *state, *[F.col(a).alias(b) for a, b in zip(("_xk", "_xt", "_xs"), to, strict=True)]), "jump")
        discard(seen), discard(jump)
        seen, jump, reached = more, twice, 2 * reached
    found = exits.join(named(seen, state, far), equal(state, far)).select(key, (F.col("_k") + 1).alias("_k"), F.col("_et").alias("_t"), F.col("_es").alias("_s"))
    return written(found, "lasts")


def select(frames: DataFrame, cfg: KeyframeConfig, key: str = "video_id", pair: Pair | None = None, span: int = SPAN) -> DataFrame:
    """One decision for each frame, by as many tasks for a video as it has blocks of ``span`` longest intervals.

    After a longest interval the next frame is selected whatever came before, so what a block decides depends on the few frames of
    that time before it. Where videos have several blocks, the frame selected last before each block is found first; then all
    blocks are folded at once, each from that frame. Frames without a time are left out.
    """
    need(span >= 2, "a block is two longest intervals long or more")
    spark = frames.sparkSession
    # pictures are few bytes for the work they make, so blocks of them are dealt to this many tasks, which aren't put together by their bytes
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) if pair else None
    pair = pair or value_pair()
    rows, blocks = _blocks(frames, key, cfg, span)
    every = rows.withColumn("_own", F.lit(True))
    if blocks > 1:
        lasts = _lasts(rows, key, cfg, pair, blocks, tasks).select(F.col(key).alias(f"_{key}"), F.col("_k").alias("_at"), "_t", "_s")
        held = rows.join(lasts, [*same([key]), F.col("timestamp_s") == F.col("_t"), F.col("sequence") == F.col("_s")])
        every = every.unionByName(held.withColumns({"_k": F.col("_at"), "_own": F.lit(False)}).select(*every.columns))
    names = [key, *[c.split()[0] for c in OUT.split(", ")]]

    def fold(batches):
        last, waiting = None, None

        def settle(r: dict, ends: bool) -> dict:
            nonlocal last
            d = decide(r, last, ends and r["_last"], r["blur_threshold"], cfg, pair)
            last = r if d.selected else last
            return {**{k: r[k] for k in names if k in r}, **d._asdict()}

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                other = waiting is None or (r[key], r["_k"]) != (waiting[key], waiting["_k"])
                if waiting is not None and waiting["_own"]:
                    out.append(settle(waiting, other))
                if other:
                    last = None
                if not r["_own"]:  # it comes before its block's own frames
                    last = r
                waiting = r
            yield pd.DataFrame(out, columns=names)
        if waiting is not None and waiting["_own"]:
            yield pd.DataFrame([settle(waiting, True)], columns=names)

    dealt = (every.repartition(tasks, key, "_k") if tasks else every.repartition(key, "_k")).sortWithinPartitions(key, "_k", "_own", "timestamp_s", "sequence")
    return dealt.mapInPandas(fold, f"{key} {dict(frames.dtypes)[key]}, {OUT}")


def pixel_pair(most: int = 600) -> Pair:
    """Motion and track ratio by optical flow between two records' gray images (columns gray, height, width)."""
    from ..functions.kernels import pair_metrics

    def image(r: dict) -> np.ndarray:
        return np.frombuffer(r["gray"], np.uint8).reshape(int(r["height"]), int(r["width"]))

    def pair(last: dict, now: dict) -> Motion:
        initial, tracked, ratio, motion = pair_metrics(image(last), image(now), most)
        return Motion(motion, ratio, initial, tracked)

    return pair


def report(decisions: DataFrame, cfg: KeyframeConfig, key: str = "video_id") -> DataFrame:
    """One row a video: counts, rate, coverage, gaps, gates. Four branches read the decisions, so they are written once: the fold runs once."""
    decisions = written(decisions, "decisions")
    paired = decisions.where("selected and reason <> 'first_frame'")  # the first keyframe has no pair
    g = decisions.groupBy(key).agg(F.count("*").alias("candidate_frames"), F.count_if("selected").alias("selected_keyframes"), (F.max("timestamp_s") - F.min("timestamp_s")).alias("duration_s"), F.first("blur_threshold").alias("blur_threshold"))
    g = g.join(quantiles(paired, [key], "track_ratio", {"median_track": 0.5}), key, "left")
    bins = coverage_bins(decisions, [key], "timestamp_s", "selected", cfg.coverage_bin_s).groupBy(key).agg(F.count_if("covered").alias("covered_bins"), F.count("*").alias("total_bins"))
    g = g.join(bins, key).join(selected_gaps(decisions.where("selected"), [key], "timestamp_s"), key)
    return g.select(key, "candidate_frames", "selected_keyframes", (F.col("selected_keyframes") / F.col("candidate_frames")).alias("selection_rate"), "duration_s", F.when(F.col("duration_s") > 0, (F.col("selected_keyframes") - 1) / F.col("duration_s")).otherwise(0.0).alias("effective_keyframe_fps"), "blur_threshold", "covered_bins", "total_bins", (F.col("covered_bins") / F.col("total_bins")).alias("coverage_fraction"), F.col("max_gap_s").alias("max_selected_gap_s"), (F.col("covered_bins") == F.col("total_bins")).alias("all_time_bins_covered"), (F.col("max_gap_s") <= 1.5 * cfg.max_interval_s).alias("max_gap_at_most_1_5x_target"), F.coalesce(F.col("median_track") >= cfg.min_track_ratio, F.lit(False)).alias("median_selected_track_ratio_at_least_minimum"))
