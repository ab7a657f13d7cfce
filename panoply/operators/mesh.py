"""Mesh quality: areas, edges, components, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import distance
from ..session import written
from .graph import components
from .sequence import even_sample, numbered

#: Components up to which a dataset's are ranked in one window.
RANKED_IN_PLACE = 200_000
AXES = ["x", "y", "z"]


def triangle_areas(vertices: DataFrame, triangles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The dataset's columns ``by``, fid, a, b, c, area, degenerate."""
    by, t = by or [], triangles
    for k in "abc":
        t = t.join(vertices.select(*by, F.col("vid").alias(k), *[F.col(x).alias(k + x) for x in AXES]), [*by, k])
    u, v = ([F.col(k + x) - F.col("a" + x) for x in AXES] for k in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = 0.5 * F.sqrt(sum((c * c for c in cross[1:]), cross[0] * cross[0]))
    return t.select(*by, "fid", "a", "b", "c", area.alias("area")).withColumn("degenerate", F.col("area") <= 1e-12)


def edges(triangles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """lo, hi, n: how many triangles of a dataset have each edge."""
    by = by or []
    e = triangles.select(*by, F.explode(F.array(*[F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in ("ab", "bc", "ca")])).alias("e"))
    return e.groupBy(*by, "e.lo", "e.hi").agg(F.count("*").alias("n"))


def edge_summary(triangles: DataFrame, by: list[str] | None = None) -> DataFrame:
    g = edges(triangles, by).groupBy(*(by or [])).agg(F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("non_manifold_edges"))
    return g.withColumn("watertight", (F.col("boundary_edges") == 0) & (F.col("non_manifold_edges") == 0))


def bounding_box(vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    b = vertices.groupBy(*(by or [])).agg(*[f(x).alias(f"{n}_{x}") for n, f in (("min", F.min), ("max", F.max)) for x in AXES])
    b = b.withColumn("diagonal", distance([F.col(f"max_{x}") for x in AXES], [F.col(f"min_{x}") for x in AXES]))
    return b.withColumns({f"extent_{x}": F.col(f"max_{x}") - F.col(f"min_{x}") for x in AXES})


def roots(vertices: DataFrame, triangles: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    links = triangles.select(*by, F.explode(F.array(F.struct("a", F.col("b").alias("b")), F.struct("a", F.col("c").alias("b")))).alias("e")).select(*by, "e.a", "e.b")
    return components(vertices, links, by)


def component_table(vertices: DataFrame, areas: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a component, ranked in its dataset by vertices and then smallest vertex: sizes, fractions, area, centroid, bounds. ``areas`` are triangle_areas()."""
    by = by or []
    v = vertices.join(labels, [*by, "vid"])
    each = v.groupBy(*by, "root").agg(F.count("*").alias("vertices"), *[F.avg(x).alias(f"centroid_{x}") for x in AXES], *[F.min(x).alias(f"min_{x}") for x in AXES], *[F.max(x).alias(f"max_{x}") for x in AXES])
    faces = areas.join(labels.withColumnRenamed("vid", "a"), [*by, "a"]).groupBy(*by, "root").agg(F.count("*").alias("triangles"), F.sum("area").alias("area"))
    each = written(each.join(faces, [*by, "root"], "left").fillna({"triangles": 0, "area": 0.0}), "components")
    sums = each.groupBy(*by).agg(F.sum("vertices").alias("_v"), F.sum("triangles").alias("_t"))
    if each.count() <= RANKED_IN_PLACE:
        ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("vertices"), "root")))
    else:
        ranked = numbered(each, by, [F.desc("vertices"), F.col("root")], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    ranked = ranked.join(sums, by) if by else ranked.join(F.broadcast(sums))  # without datasets sums is one row
    return ranked.withColumn("vertex_fraction", F.col("vertices") / F.col("_v")).withColumn("triangle_fraction", F.col("triangles") / F.nullif(F.col("_t"), F.lit(0))).drop("_v", "_t")


def gates(table: DataFrame, areas: DataFrame, summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a dataset: the four gates with what they rest on."""
    by = by or []
    share = lambda r: F.max(F.when(F.col("rank") == r, F.col("vertex_fraction")))
    t = table.groupBy(*by).agg(F.count("*").alias("connected_components"), F.count_if(F.col("vertex_fraction") >= 0.01).alias("meaningful_components"), share(1).alias("f1"), F.coalesce(share(2), F.lit(0.0)).alias("f2"))
    d = areas.groupBy(*by).agg(F.count_if("degenerate").alias("degenerate_triangles"), F.sum("area").alias("surface_area"))
    t = t.join(d, by).join(summary, by) if by else t.join(d).join(summary)
    return t.select(*by, "connected_components", "meaningful_components", "boundary_edges", "non_manifold_edges", "degenerate_triangles", "watertight", (F.col("f1") >= 0.95).alias("single_dominant_component_at_least_95_percent"), (F.col("f2") <= 0.05).alias("no_secondary_component_over_5_percent"), (F.col("non_manifold_edges") == 0).alias("no_non_manifold_edges"), (F.col("degenerate_triangles") == 0).alias("no_degenerate_triangles"), "surface_area", F.col("f1").alias("largest_component_fraction"), F.col("f2").alias("second_component_fraction"))


def coloured(vertices: DataFrame, labels: DataFrame, table: DataFrame, palette) -> DataFrame:
    """vid, x, y, z, red, green, blue: each vertex in the colour of its component's rank; ranks beyond the palette share its last colour."""
    ranked = table.select("root", F.least(F.col("rank"), F.lit(len(palette))).cast("int").alias("rank"))
    v = vertices.join(labels, "vid").join(ranked, "root")
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in palette]), F.col("rank"))
    return v.select("vid", *AXES, *[pick(i).alias(n) for i, n in enumerate(("red", "green", "blue"))])


def centroid_gap(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The distance between the centroids of each dataset's two largest components; null with one."""
    at = lambda r, x: F.max(F.when(F.col("rank") == r, F.col(f"centroid_{x}")))
    g = table.where("rank <= 2").groupBy(*(by or [])).agg(*[at(r, x).alias(f"{x}{r}") for r in (1, 2) for x in AXES])
    return g.select(*(by or []), distance([F.col(f"{x}1") for x in AXES], [F.col(f"{x}2") for x in AXES]).alias("centroid_distance"))


def sampled_gap(vertices: DataFrame, labels: DataFrame, table: DataFrame, limit: int = 4000, by: list[str] | None = None) -> DataFrame:
    """The least distance between even samples (at most ``limit`` points each) of each dataset's two largest components."""
    by = by or []
    v = vertices.join(labels, [*by, "vid"]).join(table.where("rank <= 2").select(*by, "root", "rank"), [*by, "root"])
    s = even_sample(v, [*by, "rank"], ["vid"], limit)
    a, b = (s.where(F.col("rank") == k).select(*by, *[F.col(x).alias(f"{x}{k}") for x in AXES]) for k in (1, 2))
    pairs = a.join(b, by) if by else a.crossJoin(F.broadcast(b))  # limit x limit rows a dataset at most
    return pairs.groupBy(*by).agg(F.min(distance([F.col(f"{x}1") for x in AXES], [F.col(f"{x}2") for x in AXES])).alias("gap"))
