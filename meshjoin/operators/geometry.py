"""Vertices, triangles and boxes of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BOX, MESH_BOX

AXES = "xyz"


def vertices(elements: DataFrame) -> DataFrame:
    """gi, v_idx, x, y, z of all vertices, whether a face uses them or not."""
    return elements.select("gi", F.posexplode("verts").alias("v_idx", "v")).select("gi", "v_idx", "v.*")


def triangles(elements: DataFrame, prefix: str = "t") -> DataFrame:
    """gi, tri_idx, corners {prefix}0x .. {prefix}2z and the triangle's box tx0 .. tz1; gathered per row, without a shuffle."""
    rows = elements.select("gi", "verts", F.posexplode("faces").alias("tri_idx", "f"))
    corner = {f"{prefix}{k}{x}": F.expr(f"get(verts, f.i{k}).{x}") for k in range(3) for x in AXES}
    rows = rows.select("gi", "tri_idx", *[c.alias(n) for n, c in corner.items()])
    ends = {f"t{x}{e}": f(*[F.col(f"{prefix}{k}{x}") for k in range(3)]) for x in AXES for e, f in (("0", F.least), ("1", F.greatest))}
    return rows.withColumns(ends)


def element_boxes(elements: DataFrame) -> DataFrame:
    """gi and the box over all vertices."""
    return elements.select("gi", *BOX)


def mesh_boxes(elements: DataFrame) -> DataFrame:
    """gi and the box over the vertices that faces use."""
    return elements.select("gi", *MESH_BOX)


def sweep_axis(a: DataFrame, b: DataFrame) -> DataFrame:
    """Population variances of the box centres of both sides together, and the axis (0, 1, 2) with the largest one."""
    centres = [((F.col(f"v{x}0") + F.col(f"v{x}1")) / 2).alias(x) for x in AXES]
    v = a.select(*centres).unionByName(b.select(*centres)).agg(*[F.var_pop(x).alias(f"var_{x}") for x in AXES])
    axis = F.when((F.col("var_x") >= F.col("var_y")) & (F.col("var_x") >= F.col("var_z")), 0).when(F.col("var_y") >= F.col("var_z"), 1).otherwise(2)
    return v.withColumn("axis", axis)


def centroids(elements: DataFrame) -> DataFrame:
    """gi, tri_idx, the centroid cx, cy, cz of each triangle and its radius, the largest distance of a corner from there."""
    t = triangles(elements)
    rows = t.withColumns({f"c{x}": (F.col(f"t0{x}") + F.col(f"t1{x}") + F.col(f"t2{x}")) / 3 for x in AXES})
    away = [F.sqrt(sum(((F.col(f"t{k}{x}") - F.col(f"c{x}")) * (F.col(f"t{k}{x}") - F.col(f"c{x}")) for x in AXES), F.lit(0.0))) for k in range(3)]
    return rows.select("gi", "tri_idx", *[f"c{x}" for x in AXES], F.greatest(*away).alias("radius"))


def mesh_radii(elements: DataFrame) -> DataFrame:
    """gi, n_triangles, the mean of the centroids (cx, cy, cz) and the largest radius: how far a search by centroids has to reach beyond its own bound."""
    return centroids(elements).groupBy("gi").agg(F.count("*").alias("n_triangles"), *[F.avg(f"c{x}").alias(f"c{x}") for x in AXES], F.max("radius").alias("radius"))


def bbox_mm(elements: DataFrame) -> DataFrame:
    """gi and the box's size in whole millimetres by axis."""
    return elements.select("gi", *[F.rint((F.col(f"v{x}1") - F.col(f"v{x}0")) * 1000).cast("long").alias(f"size_{x}_mm") for x in AXES])


def boxes_meet(a: str, b: str, slack: float = 0.0) -> Column:
    """Closed boxes {a}x0 .. and {b}x0 .. that overlap, or come within `slack` of each other on each axis."""
    tests = None
    for x in AXES:
        t = (F.col(f"{a}{x}0") - F.lit(slack) <= F.col(f"{b}{x}1")) & (F.col(f"{b}{x}0") <= F.col(f"{a}{x}1") + F.lit(slack))
        tests = t if tests is None else tests & t
    return tests
