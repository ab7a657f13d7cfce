"""Ordered analytics inside each key: steps, gaps, missing ranges, bins, even samples, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import need
from ..session import small, written


#: Accuracy of the sketch that bounds a quantile, and the group size up to which all values are looked at instead.
SKETCH = 10_000


def same(keys: list[str], left: str = "", right: str = "_") -> list:
    """Join conditions on keys, nulls equal, whose right side has the prefix."""
    return [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys]


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The keys and, under each name, the exact quantile of a share by linear interpolation. Null values don't count; a group without any gives nulls.

    A mergeable sketch bounds each wanted place, with room for its error; one more aggregate counts the values between the
    bounds and, in one sum, those outside. So no task holds a group's values: of a group of n rows some n / 1,000 distinct values
    at most meet, whatever the group's size.
    """
    need(bool(shares) and all(0 <= p <= 1 for p in shares.values()), "shares lie between 0 and 1")
    places, room = list(shares.values()), 3 / SKETCH
    d = df.select(*keys, F.col(value).cast("double").alias("_v"))
    lows, highs = ([min(1.0, max(0.0, p + s * room)) for p in places] for s in (-1, 1))
    b = d.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", [*lows, *highs], SKETCH).alias("_b"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    whole = F.col("_n") <= SKETCH // 2  # few rows: their places lie too close for shares of the sketch
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", *[F.when(whole, F.col("_min")).otherwise(F.col("_b")[i]).alias(f"_lo{i}") for i in range(len(places))], *[F.when(whole, F.col("_max")).otherwise(F.col("_b")[len(places) + i]).alias(f"_hi{i}") for i in range(len(places))])
    b = small(written(b, "bounds"))
    both = d.join(b, same(keys)) if keys else d.join(b)  # without keys b is one row
    inside = reduce(lambda x, y: x | y, [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(places))])
    under = F.array_max(F.array(*[F.when(F.col(f"_hi{i}") < F.col("_v"), F.col(f"_hi{i}")) for i in range(len(places))]))
    found = both.groupBy(*keys, "_n", F.when(inside, F.col("_v")).otherwise(under).alias("_at"), (~inside).alias("_gap")).agg(F.count("_v").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at", "_gap"))
    found = found.withColumn("_upto", upto)
    picks = []
    for i, p in enumerate(places):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        for side, k in (("l", F.floor(place)), ("h", F.ceil(place))):
            picks.append(F.min(F.when(F.col("_upto") > k, F.struct("_at", "_gap"))).alias(f"_{side}{i}"))
    found = found.groupBy(*keys, "_n").agg(*picks)

    def result(i, p):
        place, lo, hi = F.lit(float(p)) * (F.col("_n") - 1), F.col(f"_l{i}"), F.col(f"_h{i}")
        # the mean is rounded as SQL engines round it, by a fused multiply-add: once less than by two products and a sum. Of equal neighbours
        # it is their value, but for places under a half, where the upper share is rounded too: there it may be off in its last bit, in SQL as well
        given = [F.coalesce(x["_at"], F.lit(0.0)) for x in (lo, hi)]  # the call takes no nulls
        mean = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), given[0], F.ceil(place) - place, (place - F.floor(place)) * given[1]).cast("double")
        x = F.when(F.ceil(place) == F.floor(place), lo["_at"]).when(hi["_at"].isNotNull(), mean)
        return F.when(lo["_gap"] | hi["_gap"], F.raise_error(F.lit("a quantile lies outside its bounds")).cast("double")).otherwise(x)

    if not keys:  # no rows give a row of nulls
        found = df.sparkSession.range(1).drop("id").join(found, F.lit(True), "left")
    return found.select(*keys, *[result(i, p).alias(name) for i, (name, p) in enumerate(shares.items())])


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, p10, median, p90, max by linear interpolation."""
    return quantiles(df, keys, value, {"minimum": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "maximum": 1.0})


def before(df: DataFrame, keys: list[str], order: list[str], **values) -> DataFrame:
    """df and, under each name, the last value that isn't null among the rows before each row in its group's order.

    A struct is never null: of one, it is the row right before. Rows are range-sorted by group and order; inside a range a window
    looks back, and a range's first rows take the last values of the ranges before, of which there is one row each. So no task
    sees a whole group, however large. Rows of one place in the order come in any order.
    """
    rows = df.withColumns({f"_of_{n}": v for n, v in values.items()}).repartitionByRange(*keys, *order)
    rows = written(rows.withColumn("_range", F.spark_partition_id()), "ranges")
    last = [F.max_by(f"_of_{n}", F.when(F.col(f"_of_{n}").isNotNull(), F.struct(*order))).alias(f"_at_{n}") for n in values]
    ends = rows.groupBy("_range", *keys).agg(*last)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_range").alias("__range"), *[F.col(k).alias(f"_{k}") for k in keys], *[F.last(f"_at_{n}", True).over(earlier).alias(f"_at_{n}") for n in values])
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in_{n}": F.last(f"_of_{n}", True).over(inside) for n in values}).join(ends, same(["_range", *keys]), "left")
    return rows.select(*df.columns, *[F.coalesce(f"_in_{n}", f"_at_{n}").alias(n) for n in values])


#: Rows of a range: what one task sorts at a time.
RANGE = 1_000_000


def ranged(df: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, int]:
    """df with the number of each row's range by group and order (_range), written; and how many ranges there are at most.

    Large tables have more of them than the session's shuffle partitions, so that a task's rows don't grow with the table.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = -(-df.count() // RANGE)
    dealt = df.repartitionByRange(ranges, *keys, *order) if ranges > usual else df.repartitionByRange(*keys, *order)
    return written(dealt.withColumn("_range", F.spark_partition_id()), "ranges"), max(ranges, usual)


def largest_gap(df: DataFrame, keys: list[str], order: list[str], index: str) -> DataFrame:
    """The largest difference of successive known indices in the given order; null with fewer than two."""
    d = before(df.where(F.col(index).isNotNull()).select(*dict.fromkeys([*keys, *order, index])), keys, order, _was=F.col(index))
    return d.groupBy(*keys).agg(F.max(F.col(index) - F.col("_was")).alias("largest_gap"))


def missing_ranges(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """first, last of each run of absent indices between present ones."""
    d = before(df.select(*keys, index).where(F.col(index).isNotNull()).distinct(), keys, [index], _was=F.col(index))
    return d.where(F.col(index) - F.col("_was") > 1).select(*keys, (F.col("_was") + 1).alias("first"), (F.col(index) - 1).alias("last"))


def selected_gaps(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The longest time between successive rows, 0 with one row."""
    d = before(df.select(*keys, time), keys, [time], _was=F.col(time))
    return d.groupBy(*keys).agg(F.coalesce(F.max(F.col(time) - F.col("_was")), F.lit(0.0)).alias("max_gap_s"))


def islands(df: DataFrame, keys: list[str], order: list[str], flag, time: str) -> DataFrame:
    """keys, since, start, end, rows of each run of successive rows for which the flag holds (a null flag doesn't). since is the
    time of the row before the run, null if there is none.

    The rows of a run share the last row before them that isn't flagged: that one carry names the run.
    """
    on = F.coalesce(flag, F.lit(False))
    d = before(df.select(*dict.fromkeys([*keys, *order, time]), on.alias("_on")), keys, order, _break=F.when(~F.col("_on"), F.struct(*order, F.col(time).alias("_since"))))
    runs = d.where("_on").groupBy(*keys, "_break").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("rows"))
    return runs.select(*keys, F.col("_break._since").alias("since"), "start", "end", "rows")


def coverage_bins(df: DataFrame, keys: list[str], time: str, selected: str, size: float) -> DataFrame:
    """Counts for each time bin, closed at both ends: a row on an inner boundary counts in two bins.

    A row names its bins itself, so the counting is one aggregate; a small table of all bins supplies the empty ones.
    """
    span = df.groupBy(*keys).agg(F.min(time).alias("_s"), F.max(time).alias("_e"))
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("_e") - F.col("_s"), F.lit(1e-9)) / size)).cast("long")
    bins = span.withColumn("_n", n).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    bins = bins.withColumn("start_s", F.col("_s") + F.col("bin") * F.lit(size)).withColumn("end_s", F.least("_e", F.col("start_s") + F.lit(size)))
    rows = df.join(span, keys).withColumn("_b", F.floor((F.col(time) - F.col("_s")) / size).cast("long"))
    near = rows.withColumn("bin", F.explode(F.array(F.col("_b") - 1, "_b", F.col("_b") + 1)))
    start = F.col("_s") + F.col("bin") * F.lit(size)
    near = near.where((F.col(time) >= start) & (F.col(time) <= F.least("_e", start + F.lit(size))))
    counts = near.groupBy(*keys, "bin").agg(F.count("*").alias("_c"), F.count_if(F.col(selected)).alias("_k"))
    out = bins.join(counts, [*keys, "bin"], "left")
    return out.select(*keys, "bin", "start_s", "end_s", F.coalesce("_c", F.lit(0)).alias("candidate_count"), F.coalesce("_k", F.lit(0)).alias("selected_count"), (F.coalesce("_k", F.lit(0)) > 0).alias("covered"))


def even_sample(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows of each group at the truncated places of an even spacing from its first to its last row. Groups may have any size."""
    if limit < 1:
        raise ValueError("limit must be positive")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = numbered(df, keys, order, "_i")
    ranked = ranked.join(sizes, keys) if keys else ranked.join(F.broadcast(sizes))  # without keys sizes is one row
    # place j is floor(j (n-1) / (limit-1)): row i is taken if some j lands on it
    steps, last = F.lit(limit - 1), F.col("_n") - 1
    j = F.expr(f"cast(ceil(cast(_i as double) * {limit - 1} / greatest(_n - 1, 1)) as bigint)")
    hit = (F.col("_n") <= limit) | ((F.floor(j * last / steps) == F.col("_i")) & (j <= steps) if limit > 1 else F.col("_i") == 0)
    return ranked.where(hit).drop("_i", "_n")


def running(df: DataFrame, keys: list[str], order: list, value, name: str) -> DataFrame:
    """df with the sum of a column of whole numbers over the rows before each row in its group's order, 0 at its start.

    Rows are range-sorted by group and order, and each group's rows in each range summed first, so no task sees a whole group.
    """
    rows, ranges = ranged(df.withColumn("_value", value), keys, order)
    sums = rows.groupBy("_range", *keys).agg(F.sum("_value").alias("_sum"))  # one row a range and group in it
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_at_{k}") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    window = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.repartition(ranges, "_range", *keys) if ranges > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
    inside = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(window), F.lit(0)))
    here = F.col("_range") == F.col("_at")
    for k in keys:
        here = here & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    return inside.join(base, here).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """df with each row's place (from 0) in its group's order."""
    return running(df, keys, order, F.lit(1), name)


def session_gaps(df: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """keys, start, end, rows of each session: rows that follow one another by less than ``gap``. end is the last row's time plus the gap."""
    g = df.groupBy(*keys, F.session_window(time, gap).alias("_s")).agg(F.count("*").alias("rows"))
    return g.select(*keys, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "rows")
