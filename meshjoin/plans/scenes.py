"""Scenes made from the driver's tables, alike in Spark and in SQL.

boxes: a box for each row of embeddings; lattice: unit boxes on an integer lattice, one for each part, which touch
their neighbours; soup: two triangles for each row of embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.payload import with_boxes

#: Corner k has the sign of bit 0 on x, bit 1 on y, bit 2 on z; two triangles a side.
FACES = [(0, 1, 3), (0, 3, 2), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 3, 7), (1, 7, 5)]

_BOXES = (
    "SELECT vec_id AS gi, CAST(vec_id AS {string}) AS element_id, concat('m', CAST(label % 2 AS {string})) AS model_id, concat('T', CAST(label % 5 AS {string})) AS ifc_type, "
    "CAST({e0} AS DOUBLE) AS cx, CAST({e1} AS DOUBLE) AS cy, CAST({e2} AS DOUBLE) AS cz, 0.02e0 + 0.1e0 * abs(CAST({e3} AS DOUBLE)) AS h FROM embeddings"
)
_LATTICE = (
    "SELECT p_partkey AS gi, CAST(p_partkey AS {string}) AS element_id, 'm0' AS model_id, 'T0' AS ifc_type, CAST(p_partkey % 20 AS DOUBLE) + CASE WHEN p_partkey % 3 = 0 THEN 0.25e0 ELSE 0e0 END AS cx, "
    "CAST({div20} % 20 AS DOUBLE) AS cy, CAST({div400} AS DOUBLE) AS cz, 0.5e0 AS h FROM part"
)


def _centres(scene: str, duck: bool) -> str:
    if scene == "lattice":
        div = (lambda n: f"(p_partkey // {n})") if duck else (lambda n: f"(p_partkey DIV {n})")
        return _LATTICE.format(string="VARCHAR" if duck else "STRING", div20=div(20), div400=div(400))
    at = {f"e{k}": f"embedding[{k + 1}]" if duck else f"embedding[{k}]" for k in range(4)}
    return _BOXES.format(string="VARCHAR" if duck else "STRING", **at)


def elements(spark: SparkSession, sf_dir: str, scene: str = "boxes") -> DataFrame:
    """Parsed elements of a scene; coordinates are rounded to float32."""
    name = "part" if scene == "lattice" else "embeddings"
    view = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = spark.sql(_centres(scene, False).replace(f"FROM {name}", "FROM {source}"), source=view)
    return box_elements(rows)


def box_elements(rows: DataFrame) -> DataFrame:
    """Elements that are boxes: gi, element_id, model_id, ifc_type, centre cx, cy, cz and half side h."""
    corner = [
        F.struct(*[(F.col(f"c{x}") + F.lit(2.0 * (k >> b & 1) - 1.0) * F.col("h")).cast("float").cast("double").alias(x) for b, x in enumerate("xyz")]) for k in range(8)
    ]
    faces = F.array(*[F.struct(*[F.lit(i).alias(f"i{j}") for j, i in enumerate(f)]) for f in FACES])
    rows = rows.select("gi", "element_id", "model_id", "ifc_type", F.lit("").alias("name"), F.lit("").alias("storey"), F.lit("other").alias("discipline"), F.array(*corner).alias("verts"), faces.alias("faces"))
    return with_boxes(rows)


def sql_scene(scene: str = "boxes") -> str:
    """The scene as common table expressions: el, v (vertices), tri (triangles with boxes), box (of elements)."""
    corners = ", ".join(f"({k}, {', '.join(f'{2.0 * (k >> b & 1) - 1.0}e0' for b in range(3))})" for k in range(8))
    faces = ", ".join(f"({n}, {a}, {b}, {c})" for n, (a, b, c) in enumerate(FACES))
    xyz = ", ".join(f"CAST(CAST(c{x} + s{x} * h AS FLOAT) AS DOUBLE) AS {x}" for x in "xyz")
    corner_cols = ", ".join(f"p{k}.{x} AS t{k}{x}" for k in range(3) for x in "xyz")
    ends = ", ".join(f"{f}(t0{x}, t1{x}, t2{x}) AS t{x}{e}" for x in "xyz" for e, f in (("0", "least"), ("1", "greatest")))
    sides = ", ".join(f"{f}({x}) AS v{x}{e}" for x in "xyz" for e, f in (("0", "min"), ("1", "max")))
    return (
        f"el AS ({_centres(scene, True)}), corner(k, sx, sy, sz) AS (VALUES {corners}), face(tri_idx, i0, i1, i2) AS (VALUES {faces}), "
        f"v AS (SELECT gi, k AS v_idx, {xyz} FROM el, corner), "
        f"flat AS (SELECT p0.gi, tri_idx, {corner_cols} FROM face JOIN v p0 ON p0.v_idx = i0 JOIN v p1 ON p1.v_idx = i1 AND p1.gi = p0.gi JOIN v p2 ON p2.v_idx = i2 AND p2.gi = p0.gi), "
        f"tri AS (SELECT *, {ends} FROM flat), box AS (SELECT gi, element_id, model_id, ifc_type, {sides} FROM v JOIN el USING (gi) GROUP BY ALL)"
    )


#: Large meshes: seven triangles of each row's numbers, in the mesh that the row's id says; every sixteenth row's are 32 times as large. Four rows in a
#: sequence, one of each mesh, lie at one place of a lattice eight metres wide, so that hits grow with the table and not with its square.
LARGE_MESHES, LARGE_TRIANGLES = 4, 7
_LARGE_AT = {"x": "8e0 * (({row} // 4) % 64)", "y": "8e0 * (({row} // 256) % 64)", "z": "8e0 * ({row} // 16384)"}


def large_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that are meshes of all rows' triangles, which share no corners, in the order of ids; their sizes grow with the table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scale = F.when(F.col("vec_id") % 16 == 0, 4.0).otherwise(0.125)
    at = {x: F.expr(text.format(row="vec_id").replace("//", "DIV")) for x, text in _LARGE_AT.items()}
    place = lambda k, j, x: (F.col("embedding")[3 * k + j].cast("double") * scale + at[x]).cast("float").cast("double").alias(x)
    point = [F.struct(*[place(k, j, x) for j, x in enumerate("xyz")]) for k in range(3 * LARGE_TRIANGLES)]
    rows = e.groupBy((F.col("vec_id") % LARGE_MESHES).alias("gi")).agg(F.sort_array(F.collect_list(F.struct("vec_id", F.array(*point).alias("at")))).alias("rows"))
    rows = rows.withColumn("verts", F.flatten(F.col("rows.at")))
    faces = F.expr("transform(sequence(0, size(verts) DIV 3 - 1), k -> named_struct('i0', 3 * k, 'i1', 3 * k + 1, 'i2', 3 * k + 2))")
    named = {"element_id": F.col("gi").cast("string"), "model_id": F.lit("m0"), "ifc_type": F.lit("T0"), "name": F.lit(""), "storey": F.lit(""), "discipline": F.lit("other")}
    return with_boxes(rows.select("gi", *[c.alias(n) for n, c in named.items()], "verts", faces.alias("faces")))


def sql_large() -> str:
    """The same as common table expressions: tri and box."""
    size = "CASE WHEN vec_id % 16 = 0 THEN 4e0 ELSE 0.125e0 END"
    numbers = ", ".join(f"CAST(CAST(CAST(embedding[{9} * j + {3 * k + a + 1}] AS DOUBLE) * {size} + {_LARGE_AT[x].format(row='vec_id')} AS FLOAT) AS DOUBLE) AS t{k}{x}" for k in range(3) for a, x in enumerate("xyz"))
    ends = ", ".join(f"{f}(t0{x}, t1{x}, t2{x}) AS t{x}{e}" for x in "xyz" for e, f in (("0", "least"), ("1", "greatest")))
    sides = ", ".join(f"{f}(t{x}{e}) AS v{x}{e}" for x in "xyz" for e, f in (("0", "min"), ("1", "max")))
    return (
        f"flat AS (SELECT vec_id % {LARGE_MESHES} AS gi, CAST(row_number() OVER (PARTITION BY vec_id % {LARGE_MESHES} ORDER BY vec_id, j) - 1 AS INTEGER) AS tri_idx, {numbers} FROM embeddings, range({LARGE_TRIANGLES}) AS t(j)), "
        f"tri AS (SELECT *, {ends} FROM flat), box AS (SELECT gi, {sides} FROM tri GROUP BY gi)"
    )


SOUP_REACH = 20
_CORNERS = [f"{s}{k}{x}" for s in "ab" for k in range(3) for x in "xyz"]


def soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangle pairs: the first triangle of each row with the second ones of the SOUP_REACH rows from there on."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = e.select(F.col("vec_id").alias("id_a"), *[F.col("embedding")[n].cast("double").alias(c) for n, c in enumerate(_CORNERS[:9])], F.explode(F.sequence(F.col("vec_id"), F.col("vec_id") + SOUP_REACH - 1)).alias("id_b"))
    second = e.select(F.col("vec_id").alias("id_b"), *[F.col("embedding")[n].cast("double").alias(c) for n, c in enumerate(_CORNERS[9:], 9)])
    return first.join(second, "id_b").select("id_a", "id_b", *_CORNERS)


def sql_soup() -> str:
    cols = ", ".join(f"CAST({s}.embedding[{n + 1}] AS DOUBLE) AS {c}" for n, c in enumerate(_CORNERS) for s in [c[0]])
    return f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, {cols} FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id AND a.vec_id + {SOUP_REACH - 1}"
