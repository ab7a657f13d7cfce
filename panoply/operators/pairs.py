"""Image-pair plans and the invalidation of stored matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import frame_index_drop, pair_key
from ..schemas import need


def indexed(images: DataFrame) -> DataFrame:
    """Adds idx from the name; images without one, or without a positive id, are dropped."""
    return images.where("image_id > 0").withColumn("idx", frame_index_drop(F.col("name"))).where("idx is not null")


def targeted(images: DataFrame, first: int, last: int, overlap: int, key: str = "model_id") -> DataFrame:
    """Pairs of images in the closed interval whose indices differ by at most overlap: key, id_a, id_b, idx_a, idx_b, pair_id.

    A band join as an equi-join: the left side goes into its own and the next bucket of width overlap, the right
    side into its own; the order (idx, image_id) keeps each pair once and pairs images of one index too.
    """
    need(0 <= first <= last, "the interval must be ordered and not negative")
    need(overlap > 0, "overlap must be positive")
    rows = indexed(images).where(F.col("idx").between(first, last)).select(key, "image_id", "idx")
    a = rows.select(F.col(key), F.col("image_id").alias("id_a"), F.col("idx").alias("idx_a"), F.explode(F.array(F.expr(f"idx div {overlap}"), F.expr(f"idx div {overlap} + 1"))).alias("_b"))
    b = rows.select(F.col(key), F.col("image_id").alias("id_b"), F.col("idx").alias("idx_b"), F.expr(f"idx div {overlap}").alias("_b"))
    after = (F.col("idx_b") > F.col("idx_a")) | ((F.col("idx_b") == F.col("idx_a")) & (F.col("id_b") > F.col("id_a")))
    out = a.join(b, [key, "_b"]).where(after & (F.col("idx_b") - F.col("idx_a") <= overlap))
    return out.select(key, "id_a", "id_b", "idx_a", "idx_b", pair_key(F.col("id_a"), F.col("id_b")).alias("pair_id"))


def cross(images: DataFrame, first: tuple[int, int], second: tuple[int, int], key: str = "model_id") -> DataFrame:
    """Every image of the first interval with every one of the second, inside a model."""
    need(first[0] <= first[1] < second[0] <= second[1], "intervals must be ordered and disjoint")
    rows = indexed(images)
    side = lambda r, s: rows.where(F.col("idx").between(*r)).select(key, F.col("image_id").alias(f"id_{s}"), F.col("idx").alias(f"idx_{s}"))
    return side(first, "a").join(side(second, "b"), key).withColumn("pair_id", pair_key(F.col("id_a"), F.col("id_b")))


def loop(images: DataFrame, window: int, key: str = "model_id") -> DataFrame:
    """The first k images by name with the last k, k = min(window, n div 2): key, a, b."""
    need(window > 0, "window must be positive")
    w = Window.partitionBy(key)
    r = images.select(key, "name").withColumn("_i", F.row_number().over(w.orderBy("name"))).withColumn("_n", F.count("*").over(w))
    k = F.least(F.lit(window), F.expr("_n div 2"))
    head = r.where(F.col("_i") <= k).select(key, F.col("name").alias("a"))
    tail = r.where(F.col("_i") > F.col("_n") - k).select(key, F.col("name").alias("b"))
    return head.join(tail, key)


def planned(matches: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    return matches.join(plan.select(*keys).distinct(), keys, "left_semi")


def without_planned(matches: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    return matches.join(plan.select(*keys).distinct(), keys, "left_anti")
