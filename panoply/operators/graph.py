"""Connected components by alternating stars, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def stars(links: DataFrame) -> bool:
    """Whether every u has one smaller v and no v is a u: then each v is the smallest node of its component."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    mixed = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0")
    return mixed.agg(F.count("*")).first()[0] == 0


def connected(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node, root: for each node that an edge names, the smallest node it reaches. Self loops, repeats and nulls are ignored.

    A round first links each node's larger neighbours to its smallest one, then its smaller neighbours and itself; the
    number of rounds grows with the logarithm of the longest path. Each round is a partial aggregate and a
    join, written to the shared folder, so no group is gathered and no lineage builds up. Rounds end once the links are stars.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = written(links, "edges")
    for _ in range(most):
        if stars(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        discard(links)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.union(low.select("u", "m")).where("u <> v").distinct(), "edges")
        discard(large)
    raise RuntimeError(f"components did not settle in {most} rounds")


def components(vertices: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The keys, vid and root, the smallest vertex reachable inside one graph. Vertices without an edge are their own root.

    ``keys`` name the graph that a vertex and an edge belong to; many graphs go through the same rounds.
    """
    keys = keys or []
    node = lambda c: F.struct(*keys, F.col(c).alias("vid"))
    found = connected(edges.select(node("a").alias("a"), node("b").alias("b")))
    found = found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.vid").alias("vid"), F.col("root.vid").alias("root"))
    return vertices.select(*keys, "vid").join(found, [*keys, "vid"], "left").select(*keys, "vid", F.coalesce("root", "vid").alias("root"))
