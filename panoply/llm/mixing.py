"""Weighted fair queueing over document sources, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize

#: Rows that a bucket of a running sum holds on average, and buckets that a group of them holds.
ROWS_PER_BUCKET, BUCKETS_PER_GROUP = 2_000, 2_000
#: Copies that a range of the sorted queue holds on average.
COPIES_PER_RANGE = 250_000
#: Sources up to which their limits are broadcast.
SOURCES_TO_SEND = 100_000
#: Characters other than the six ASCII white-space characters, in runs: the words that make a document's size.
WORD = "[^\\x20\\x09-\\x0D]+"
#: What orders a source's shuffled queue.
PLACE = ["_h", "_id"]


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, repeats: int) -> DataFrame:
    """source, source_size, target from (source, source_size): weights by code point order, the excess over
    ``repeats`` times a source's size shared again by weight.

    The fair level is closed-form: with sources ordered by size/weight, the first ones are capped, and the others share
    what is left. One row a source goes through the windows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("k", F.row_number().over(order) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("k") % len(weights) + 1).cast("double"))
    s = s.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "k")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.lit(share) * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Capped sources are a prefix of that order; the first one below its cap sets the level for all after it.
    s = s.withColumn("fair", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("k"), F.col("level")))).over(every)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("fair") * F.col("w")), F.col("cap")).alias("target"), "budget")


@dataclass
class Mix:
    """rows, one for each document: doc_id, source, size, source_size, target, finish (the virtual time at which its first copy ends; null if none is queued), taken.
    limits, one for each source with a taken copy: source and limit (r, _h, _id), its last place in the queue that the budget reaches."""

    rows: DataFrame
    limits: DataFrame
    repeats: int
    seed: int
    text: str


def _place(docs: DataFrame, seed: int, text: str) -> tuple[Column, Column]:
    """A document's place in its source's shuffled order: a hash of id and text, then the id."""
    return F.xxhash64(F.lit(seed), docs["doc_id"], docs[text]), docs["doc_id"].cast("long")


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 7, text: str = "text") -> Mix:
    """What the mix takes of each document, worked out on ids, hashes and sizes alone: no text is shuffled or written.

    Each source's documents are shuffled by a hash and queued ``repeats`` times over. A copy's virtual finish time is
    the source's words up to its end, divided by the source's target, so at any time all sources have given the same
    part of their targets. All copies are range-sorted by that time, and the queue is cut where its running size would pass the budget.
    Documents without words (null or empty) are never queued; rows with one source, id and text share a place, and are taken
    alike; a null source is a source. Nothing is random, so reruns agree.

    Running sums go over buckets of the hash inside a source, and over groups of buckets, so no task sees a source: each has a
    bucket's rows, a group's buckets or a source's groups.
    """
    n = max(1, -(-docs.count() // ROWS_PER_BUCKET))
    h, own = _place(docs, seed, text)
    slim = docs.select(own.alias("_id"), docs["source"].cast("string").alias("_source"), word_count(docs[text]).alias("size"), h.alias("_h"))
    slim = materialize(slim.withColumn("_b", F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * n).cast("long")), "sizes")
    sums = materialize(slim.groupBy("_source", "_b").agg(F.sum("size").alias("_sum")), "bucket-sums")
    targets = materialize(source_targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size")), list(weights), share, repeats), "targets")
    budget = (targets.agg(F.max("budget")).first()[0]) or 0.0
    inside = Window.partitionBy("_source", "_b").orderBy(*PLACE).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    info = _bases(sums).join(targets, F.col("_source").eqNullSafe(F.col("source"))).select(F.col("_source").alias("_s"), F.col("_b").alias("_t"), "_base", "source_size", "target")
    timed = slim.withColumn("_run", F.sum("size").over(inside)).join(info, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_t")))
    finish = [F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("_base") + F.col("_run") + F.lit(r) * F.col("source_size")) / F.col("target")).alias(f"_f{r}") for r in range(repeats)]
    timed = materialize(timed.select("_source", "size", "source_size", "target", *PLACE, *finish), "finish-times")
    for t in (slim, sums, targets):
        drop(t)
    reached = _reached(timed, repeats, n * ROWS_PER_BUCKET, budget)
    taken = sum((F.when(reached(F.col(f"_f{r}"), F.lit(r)), F.col("size")).otherwise(0) for r in range(repeats)), F.lit(0))
    rows = timed.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "size", "source_size", "target", F.col("_f0").alias("finish"), taken.cast("long").alias("taken"))
    copies = timed.select("_source", *PLACE, F.explode(F.array(*[F.struct(reached(F.col(f"_f{r}"), F.lit(r)).alias("taken"), F.lit(r).alias("r")) for r in range(repeats)])).alias("c"))
    limits = copies.where("c.taken").groupBy(F.col("_source").alias("source")).agg(F.max(F.struct("c.r", *PLACE)).alias("limit"))
    return Mix(rows, limits, repeats, seed, text)


def _bases(sums: DataFrame) -> DataFrame:
    """_source, _b, _base: the words of a source's buckets before each bucket, by groups of buckets first."""
    upto = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_g", F.expr(f"_b div {BUCKETS_PER_GROUP}"))
    groups = sums.groupBy(F.col("_source").alias("_gs"), F.col("_g").alias("_gg")).agg(F.sum("_sum").alias("_sum"))
    groups = groups.select("_gs", "_gg", upto(Window.partitionBy("_gs").orderBy("_gg")).alias("_before"))
    within = sums.select("_source", "_b", "_g", upto(Window.partitionBy("_source", "_g").orderBy("_b")).alias("_within"))
    both = within.join(groups, F.col("_source").eqNullSafe(F.col("_gs")) & (F.col("_g") == F.col("_gg")))
    return both.select("_source", "_b", (F.col("_before") + F.col("_within")).alias("_base"))


def _reached(timed: DataFrame, repeats: int, documents: int, budget: float):
    """(finish time, repeat) -> whether such a copy of the row lies before the place where the sorted copies' running size would pass the budget.

    The copies are range-sorted and written; sums by range find the range with that place, and only that range is summed row by row.
    """
    key = ["f", "r", *PLACE]
    copies = timed.select("size", *PLACE, F.explode(F.array(*[F.struct(F.col(f"_f{r}").alias("f"), F.lit(r).alias("r")) for r in range(repeats)])).alias("c")).where("c.f is not null").select("size", "c.f", "c.r", *PLACE)
    parts = int(timed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-documents * repeats // COPIES_PER_RANGE), min(parts, documents * repeats // ROWS_PER_BUCKET))
    queue = materialize(copies.repartitionByRange(ranges, *key).sortWithinPartitions(*key).withColumn("_p", F.spark_partition_id()), "queue")
    totals = queue.groupBy("_p").agg(F.sum("size").alias("n")).withColumn("total", F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))  # one row a range
    found = totals.where(F.col("total") > budget).agg(F.min(F.struct("_p", F.col("total") - F.col("n"))).alias("x")).first()["x"]
    last = F.max(F.struct(*key)).alias("x")
    if found is None:
        drop(queue)
        return lambda f, r: f.isNotNull()
    p, done = found
    running = F.sum("size").over(Window.partitionBy("_p").orderBy(*key).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at = queue.where(F.col("_p") == p).withColumn("_run", running + done).where(F.col("_run") <= budget).agg(last).first()["x"]
    at = at or queue.where(F.col("_p") < p).agg(last).first()["x"]
    drop(queue)
    if at is None:
        return lambda f, r: F.lit(False)
    cut = F.struct(F.lit(at["f"]).alias("f"), F.lit(at["r"]).alias("r"), F.lit(at["_h"]).cast("long").alias("_h"), F.lit(at["_id"]).cast("long").alias("_id"))
    return lambda f, r: f.isNotNull() & (F.struct(f.alias("f"), r.alias("r"), *PLACE) <= cut)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 7, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, finish and taken, the words that the mix takes, for each row of docs. See plan()."""
    return plan(docs, weights, share, repeats, seed, text).rows


def take(docs: DataFrame, made: Mix) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns whatever their names.

    A source's taken copies are the first ones of its queue, so one limit for each source says it all: rows meet it where
    they are read, and no text is shuffled. More than SOURCES_TO_SEND sources are joined, not broadcast.
    """
    limits = materialize(made.limits, "limits")
    name = next(x for x in (f"_copy{k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns)
    h, own = _place(docs, made.seed, made.text)
    few = limits.count() <= SOURCES_TO_SEND
    held = limits.select(F.col("source").alias(f"{name}_source"), F.col("limit").alias(f"{name}_limit"))
    both = docs.join(F.broadcast(held) if few else held, docs["source"].cast("string").eqNullSafe(held[f"{name}_source"]))
    limit = held[f"{name}_limit"]
    place, at = F.struct(h.alias("_h"), own.alias("_id")), F.struct(limit["_h"].alias("_h"), limit["_id"].alias("_id"))
    copies = F.when(docs[made.text].rlike(WORD), limit["r"] + F.when(place <= at, 1).otherwise(0)).otherwise(0)
    return both.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias(name)).drop(name)
