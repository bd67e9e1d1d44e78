"""The engine's registered queries over the scenes, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import closest_kernel, hits_kernel
from ..operators import broadphase, geometry, narrow
from ..operators.lineage import cut
from ..schema import BOX, DEPTH_SEMANTICS, MESH_BOX, Rules
from ..sources.payload import explode_elements, parse_elements, payload_texts, unreadable
from . import scenes
from .kernel_sql import closest_between_segments, closest_on_triangle, sql_stages, tri_tri
from .detect import CAPABILITIES, candidates_of, capabilities, counts_in, detect_documents, found_in, named

GAP = Rules(mode="both", max_gap=10.0)
TYPES = Rules(exclude_type_pairs=("T0:T1", "T2:T2"))
CROSS = Rules(model_a="m0", model_b="m1")
ONE = Rules(model_b="m1")
ONE_SELF = Rules(model_b="m1", exclude_self=True)
SOFT = Rules(mode="soft", max_gap=20.0)
BOTH = Rules(mode="both", max_gap=20.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
XYZ = "xyz"


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _with(select: str, scene: str = "boxes", *more: str) -> str:
    return "WITH " + ", ".join([scenes.sql_scene(scene), *more]) + " " + select


def _pairs_sql(rules: Rules = Rules(), same: bool = True) -> str:
    """The broad phase as a join by its plain condition: rows gi_a, gi_b."""
    g = f"{rules.gap_m!r}"
    tests = [f"a.v{x}0 - {g} <= b.v{x}1 AND b.v{x}0 <= a.v{x}1 + {g}" for x in XYZ] if rules.gap_m else [f"a.v{x}0 <= b.v{x}1 AND b.v{x}0 <= a.v{x}1" for x in XYZ]
    tests += [f"{s}.model_id = '{m}'" for s, m in (("a", rules.model_a), ("b", rules.model_b)) if m != "all"]
    if same:
        tests.append("a.gi < b.gi")
    elif rules.exclude_self:
        tests.append("NOT (a.model_id = b.model_id AND a.element_id = b.element_id)")
    for x, y in (r.split(":") for r in rules.exclude_type_pairs):
        tests.append(f"NOT (a.ifc_type = '{x}' AND b.ifc_type = '{y}' OR a.ifc_type = '{y}' AND b.ifc_type = '{x}')")
    return f"SELECT a.gi AS gi_a, b.gi AS gi_b FROM box a JOIN box b ON {' AND '.join(tests)}"


def _count_sql(pairs: str) -> str:
    return f"SELECT gi_a, gi_b FROM ({pairs}) AS pairs"


def _broad(rules: Rules, method: str = "auto"):
    return lambda spark, sf_dir: candidates_of(scenes.elements(spark, sf_dir), rules, method)


for _name, _rules, _same, _method in (
    ("broad_all", Rules(), True, "auto"), ("broad_gap", GAP, True, "auto"), ("broad_cross_models", CROSS, False, "auto"), ("broad_all_vs_one", ONE, False, "auto"),
    ("broad_exclude_types", TYPES, True, "auto"), ("broad_exclude_self", ONE_SELF, False, "auto"), ("broad_grid", Rules(), True, "grid"), ("broad_grid_gap", GAP, True, "grid"),
    ("broad_grid_cross_models", CROSS, False, "grid"), ("broad_theta", Rules(), True, "theta"), ("broad_sweep", GAP, True, "sweep"), ("broad_sweep_all_vs_one", ONE, False, "sweep"),
):
    QUERIES[_name] = _broad(_rules, _method)
    ORACLE_SQL[_name] = _with(_pairs_sql(_rules, _same))


@_query(_with(f"SELECT gi, {', '.join(BOX)} FROM box"))
def element_bbox(spark, sf_dir):
    return geometry.element_boxes(scenes.elements(spark, sf_dir))


@_query(_with(f"SELECT gi, {', '.join(f'{f}(t{x}{e}) AS f{x}{e}' for x in XYZ for e, f in (('0', 'min'), ('1', 'max')))} FROM tri GROUP BY gi", "lattice"))
def mesh_bbox(spark, sf_dir):
    return geometry.mesh_boxes(scenes.elements(spark, sf_dir, "lattice")).select("gi", *MESH_BOX)


@_query(_with("SELECT gi, element_id, model_id, ifc_type FROM el WHERE model_id = 'm1'"))
def scope_filter(spark, sf_dir):
    return broadphase.scope(scenes.elements(spark, sf_dir), "m1").select("gi", "element_id", "model_id", "ifc_type")


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire elements from embeddings: numbers of vertices and faces vary with the id, from none on."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    text = {c: F.lit(None).cast("string") for c in ("ifcType", "name", "storey", "discipline")}
    return e.select(
        F.col("vec_id").alias("gi"), F.col("vec_id").cast("string").alias("id"), F.when(F.col("label") % 2 == 0, F.lit("even")).alias("modelId"), *[c.alias(n) for n, c in text.items()],
        F.slice(F.col("embedding").cast("array<float>"), F.lit(1), (3 * (F.col("vec_id") % 5)).cast("int")).alias("vertices"),
        F.slice(F.array(*[F.lit(i) for i in (0, 1, 2)]), F.lit(1), F.when(F.col("vec_id") % 7 == 0, 0).when(F.col("vec_id") % 5 < 3, 0).otherwise(3)).alias("indices"),
    )


@_query("SELECT vec_id AS gi, CAST(vec_id AS VARCHAR) AS element_id, CASE WHEN label % 2 = 0 THEN 'even' ELSE '' END AS model_id, 'other' AS discipline, CAST(vec_id % 5 AS INTEGER) AS n_verts, 1 AS n_faces FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 >= 3")
def valid_elements(spark, sf_dir):
    return parse_elements(_wire(spark, sf_dir)).select("gi", "element_id", "model_id", "discipline", "n_verts", "n_faces")


@_query(_with("SELECT round(var_pop((vx0 + vx1) / 2), 6) AS var_x, round(var_pop((vy0 + vy1) / 2), 6) AS var_y, round(var_pop((vz0 + vz1) / 2), 6) AS var_z, CASE WHEN var_pop((vx0 + vx1) / 2) >= var_pop((vy0 + vy1) / 2) AND var_pop((vx0 + vx1) / 2) >= var_pop((vz0 + vz1) / 2) THEN 0 WHEN var_pop((vy0 + vy1) / 2) >= var_pop((vz0 + vz1) / 2) THEN 1 ELSE 2 END AS axis FROM (SELECT * FROM box UNION ALL SELECT * FROM box) AS sides"))
def sweep_axis(spark, sf_dir):
    e = scenes.elements(spark, sf_dir)
    return geometry.sweep_axis(e, e).select(*[F.round(f"var_{x}", 6).alias(f"var_{x}") for x in XYZ], "axis")


_TRI = [f"t{k}{x}" for k in range(3) for x in XYZ]


@_query(_with(f"SELECT gi, tri_idx, {', '.join(_TRI)} FROM tri", "lattice"))
def triangulate(spark, sf_dir):
    return geometry.triangles(scenes.elements(spark, sf_dir, "lattice")).select("gi", "tri_idx", *_TRI)


@_query(_with("SELECT gi, " + ", ".join(f"CAST(round_even((v{x}1 - v{x}0) * 1000, 0) AS BIGINT) AS size_{x}_mm" for x in XYZ) + " FROM box"))
def bbox_mm(spark, sf_dir):
    return geometry.bbox_mm(scenes.elements(spark, sf_dir))


def _soup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.soup(spark, sf_dir).mapInArrow(hits_kernel(["id_a", "id_b"], only_hits=False), "id_a long, id_b long, hit boolean, px double, py double, pz double")


@_query(f"SELECT id_a, id_b, hit FROM ({sql_stages(scenes.sql_soup(), tri_tri('a', 'b'))}) AS found")
def tri_tri_hits(spark, sf_dir):
    return _soup_hits(spark, sf_dir).select("id_a", "id_b", "hit")


@_query(f"SELECT id_a, id_b, round(px, 3) AS px, round(py, 3) AS py, round(pz, 3) AS pz FROM ({sql_stages(scenes.sql_soup(), tri_tri('a', 'b'))}) AS found")
def tri_tri_midpoint(spark, sf_dir):
    """The points of all pairs, null without a hit."""
    return _soup_hits(spark, sf_dir).select("id_a", "id_b", *[F.round(c, 3).alias(c) for c in ("px", "py", "pz")])


_POINT = [(f"p{x}", f"b0{x}") for x in XYZ]


@_query(f"SELECT id_a, id_b, round(dist, 6) AS dist, round(qx, 3) AS qx, round(qy, 3) AS qy, round(qz, 3) AS qz FROM ({sql_stages(scenes.sql_soup(), [_POINT, *closest_on_triangle('p', 'a')])}) AS found")
def closest_point_on_tri(spark, sf_dir):
    pairs = scenes.soup(spark, sf_dir).select("id_a", "id_b", *[F.col(b).alias(p) for p, b in _POINT], *[F.col(f"a{c[1:]}").alias(c) for c in _TRI])
    found = pairs.mapInArrow(closest_kernel(["id_a", "id_b"]), "id_a long, id_b long, dist double, qx double, qy double, qz double")
    return found.select("id_a", "id_b", F.round("dist", 6).alias("dist"), *[F.round(c, 3).alias(c) for c in ("qx", "qy", "qz")])


def _tri_pairs_sql(pairs: str) -> str:
    """All triangle pairs of pairs with overlapping triangle boxes."""
    cols = ", ".join(f"{s}.t{k}{x} AS {s}{k}{x}" for s in "ab" for k in range(3) for x in XYZ)
    meet = " AND ".join(f"a.t{x}0 <= b.t{x}1 AND b.t{x}0 <= a.t{x}1" for x in XYZ)
    return f"SELECT gi_a, gi_b, a.tri_idx AS tri_a, b.tri_idx AS tri_b, {cols} FROM ({pairs}) AS pairs JOIN tri a ON a.gi = gi_a JOIN tri b ON b.gi = gi_b AND {meet}"


def _hits(pairs: str) -> str:
    return f"hits AS (SELECT gi_a, gi_b, tri_a, tri_b, px, py, pz FROM ({sql_stages(_tri_pairs_sql(pairs), tri_tri('a', 'b'))}) AS found WHERE hit)"


_DEPTH = "least(" + ", ".join(f"greatest(least(p.v{x}1, q.v{x}1) - greatest(p.v{x}0, q.v{x}0), 0)" for x in XYZ) + ")"
_HARD = f"hard AS (SELECT gi_a, gi_b, CAST(-round_even({_DEPTH} * 1000, 0) AS BIGINT) AS distance FROM (SELECT DISTINCT gi_a, gi_b FROM hits) AS d JOIN box p ON p.gi = gi_a JOIN box q ON q.gi = gi_b)"


def _hard(spark, sf_dir, scene):
    rows = narrow.result_rows(found_in(scenes.elements(spark, sf_dir, scene), Rules(), with_point=False))
    return rows.select("gi_a", "gi_b", "distance", "depth_semantics", "type")


_HARD_OUT = f"SELECT gi_a, gi_b, distance, '{DEPTH_SEMANTICS}' AS depth_semantics, 'hard' AS type FROM hard"


@_query(_with(_HARD_OUT, "boxes", _hits(_pairs_sql()), _HARD))
def hard_clashes(spark, sf_dir):
    return _hard(spark, sf_dir, "boxes")


@_query(_with(_HARD_OUT, "lattice", _hits(_pairs_sql()), _HARD))
def hard_flush_lattice(spark, sf_dir):
    return _hard(spark, sf_dir, "lattice")


@_query(_with("SELECT gi_a, gi_b, " + ", ".join(f"round(avg(p{x}), 3) AS p{x}" for x in XYZ) + " FROM (SELECT *, row_number() OVER (PARTITION BY gi_a, gi_b ORDER BY tri_a, tri_b) AS n FROM hits) AS ranked WHERE n <= 24 GROUP BY gi_a, gi_b", "boxes", _hits(_pairs_sql())))
def hard_points(spark, sf_dir):
    found = found_in(scenes.elements(spark, sf_dir), Rules())
    return found.select("gi_a", "gi_b", *[F.round(f"p{x}", 3).alias(f"p{x}") for x in XYZ])


def _vertex_sql(pairs: str, gap: float) -> str:
    d = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in XYZ)
    return f"nn AS (SELECT gi_a, gi_b, sqrt({d}) AS d FROM ({pairs}) AS pairs JOIN v a ON a.gi = gi_a JOIN v b ON b.gi = gi_b)"


def _face_sql(pairs: str, s: str, o: str) -> str:
    source = f"SELECT gi_a, gi_b, {', '.join(f'w.{x} AS p{x}' for x in XYZ)}, {', '.join(f't.{c}' for c in _TRI)} FROM ({pairs}) AS pairs JOIN v w ON w.gi = gi_{s} JOIN tri t ON t.gi = gi_{o}"
    return f"face_{s} AS (SELECT gi_a, gi_b, dist AS d FROM ({sql_stages(source, closest_on_triangle('p', 't'))}) AS found)"


def _clear(name: str, sources: list[str], gap: float) -> str:
    return f"{name} AS (SELECT gi_a, gi_b, CAST(round_even(min(d) * 1000, 0) AS BIGINT) AS distance FROM ({' UNION ALL '.join(f'SELECT * FROM {s}' for s in sources)}) AS every GROUP BY gi_a, gi_b HAVING min(d) <= {gap!r})"


@_query(_with("SELECT gi_a, gi_b, distance FROM near", "boxes", _vertex_sql(_pairs_sql(SOFT), SOFT.gap_m), _clear("near", ["nn"], SOFT.gap_m)))
def clearance_vertex_only(spark, sf_dir):
    return narrow.result_rows(found_in(scenes.elements(spark, sf_dir), SOFT, with_point=False, vertex_only=True)).select("gi_a", "gi_b", "distance")


@_query(_with("SELECT gi_a, gi_b, round(min(d), 6) AS d FROM nn WHERE d <= 0.5 GROUP BY gi_a, gi_b", "boxes", _vertex_sql(_pairs_sql(), 0.5)))
def vertex_nn(spark, sf_dir):
    return found_in(scenes.elements(spark, sf_dir), Rules(), with_point=False, vertex_only=True, within=0.5).select("gi_a", "gi_b", F.round("d", 6).alias("d"))


def _soft_parts(rules: Rules, pairs: str) -> list[str]:
    return [_vertex_sql(pairs, rules.gap_m), _face_sql(pairs, "a", "b"), _face_sql(pairs, "b", "a"), _clear("near", ["nn", "face_a", "face_b"], rules.gap_m)]


@_query(_with("SELECT gi_a, gi_b, distance FROM near", "boxes", *_soft_parts(SOFT, _pairs_sql(SOFT))))
def clearance(spark, sf_dir):
    return narrow.result_rows(found_in(scenes.elements(spark, sf_dir), SOFT, with_point=False)).select("gi_a", "gi_b", "distance")


def _detected(rules: Rules):
    def run(spark, sf_dir):
        return narrow.result_rows(found_in(scenes.elements(spark, sf_dir), rules, with_point=False)).select("gi_a", "gi_b", "distance", "volume", "type")

    return run


QUERIES["detect_soft"] = _detected(SOFT)
ORACLE_SQL["detect_soft"] = _with("SELECT gi_a, gi_b, distance, CAST(0 AS DOUBLE) AS volume, 'clearance' AS type FROM near", "boxes", *_soft_parts(SOFT, _pairs_sql(SOFT)))
_REST = "SELECT * FROM cand ANTI JOIN hard USING (gi_a, gi_b)"
_BOTH = [f"cand AS ({_pairs_sql(BOTH)})", _hits("SELECT * FROM cand"), _HARD, *_soft_parts(BOTH, _REST)]
QUERIES["detect_both"] = _detected(BOTH)
ORACLE_SQL["detect_both"] = _with(
    "SELECT gi_a, gi_b, distance, CAST(NULL AS DOUBLE) AS volume, 'hard' AS type FROM hard UNION ALL SELECT gi_a, gi_b, distance, CAST(0 AS DOUBLE) AS volume, 'clearance' AS type FROM near", "boxes", *_BOTH
)


@_query(_with("SELECT (SELECT count(*) FROM el) AS element_count, (SELECT count(*) FROM cand) AS candidate_pairs, (SELECT count(*) FROM hard) + (SELECT count(*) FROM near) AS clash_count", "boxes", *_BOTH))
def detect_stats(spark, sf_dir):
    e = scenes.elements(spark, sf_dir)
    return e.agg(F.count("*").alias("element_count")).crossJoin(counts_in(e, BOTH))  # one row each


_RULE_ROWS = ", ".join(f"('{k}', {str(v).lower()})" for k, v in CAPABILITIES["rules"].items())


@_query(
    f"SELECT {CAPABILITIES['protocolVersion']} AS protocol_version, '{CAPABILITIES['modelScope']}' AS model_scope, {str(CAPABILITIES['overlapVolume']).lower()} AS overlap_volume, rule, honoured, "
    "(SELECT count(DISTINCT vec_id % 40) FROM embeddings WHERE rule = 'mode' OR rule = 'maxGap' OR rule = 'excludeTypePairs' AND vec_id % 40 % 5 = 0 OR rule = 'excludeSelf' AND vec_id % 40 % 8 = 1) AS requests "
    f"FROM (VALUES {_RULE_ROWS}) AS t(rule, honoured)"
)
def capabilities_record(spark, sf_dir):
    """The advertised protocol, one row for each rule, with the number of payloads (see payload_rule_sets) that set it."""
    record = capabilities(spark)
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"rules.{k}").alias("honoured")) for k in CAPABILITIES["rules"]]))
    record = record.select(F.col("protocolVersion").alias("protocol_version"), F.col("modelScope").alias("model_scope"), F.col("overlapVolume").alias("overlap_volume"), rules.alias("r")).select("protocol_version", "model_scope", "overlap_volume", "r.*")
    sets = _payloads(spark, sf_dir, "gi % 40", _FORTY).select("rules.*")
    named = sets.select(F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in sets.columns])).alias("rule")).where("rule IS NOT NULL")
    used = named.groupBy("rule").agg(F.count("*").alias("requests"))
    return record.join(used, "rule", "left").withColumn("requests", F.coalesce("requests", F.lit(0)).cast("long"))


def _wire_of(elements: DataFrame) -> DataFrame:
    """Elements as wire structs: gi, e."""
    flat = lambda c, names: f"flatten(transform({c}, p -> array({', '.join(f'p.{n}' for n in names)})))"
    e = F.struct(
        F.col("element_id").alias("id"), F.col("model_id").alias("modelId"), F.col("ifc_type").alias("ifcType"), F.expr(flat("verts", XYZ)).cast("array<float>").alias("vertices"),
        F.expr(flat("faces", ("i0", "i1", "i2"))).alias("indices"),
    )
    return elements.select("gi", e.alias("e"))


def _payloads(spark: SparkSession, sf_dir: str, key: str, rules: str) -> DataFrame:
    """The boxes as JSON payloads, a document for each value of the key, with rules by SQL over the column k (the key)."""
    wire = _wire_of(scenes.elements(spark, sf_dir)).withColumn("k", F.expr(key))
    docs = wire.groupBy("k").agg(F.expr("transform(sort_array(collect_list(struct(gi, e))), x -> x.e)").alias("elements"))
    return payload_texts(docs.select(F.concat(F.lit("d"), F.col("k")).alias("document"), F.to_json(F.struct("elements", F.expr(rules).alias("rules"))).alias("json")))


@_query(_with(f"SELECT concat('d', gi % 40) AS document, element_id, model_id, CAST(8 AS INTEGER) AS n_verts, CAST(12 AS INTEGER) AS n_faces, {', '.join(BOX)} FROM box"))
def payload_json_roundtrip(spark, sf_dir):
    """All boxes to JSON payloads, forty of them, and back to elements."""
    back = parse_elements(explode_elements(_payloads(spark, sf_dir, "gi % 40", "named_struct('mode', 'hard')")))
    return back.select("document", "element_id", "model_id", "n_verts", "n_faces", *BOX)


#: Forty rule sets: modes in turn, gaps of their own, scopes and exclusions now and then; k is the document's number.
_FORTY = (
    "named_struct('mode', element_at(array('hard', 'soft', 'both'), cast(k % 3 + 1 as int)), 'maxGap', cast(200 + 20 * k as double), 'modelA', if(k % 4 = 1, 'm0', null), 'modelB', if(k % 4 = 1, 'm1', null), "
    "'excludeSelf', if(k % 8 = 1, true, null), 'excludeTypePairs', if(k % 5 = 0, array('T0:T1', 'T3:T2', 'T4:T4'), null))"
)
_FORTY_SQL = (
    "r AS (SELECT k, k % 3 <> 1 AS hard, CASE WHEN k % 3 > 0 THEN (200 + 20 * k) / 1000e0 ELSE 0e0 END AS gap, k % 4 = 1 AS split, k % 5 = 0 AS excludes FROM range(40) AS t(k)), "
    "cand AS (SELECT a.gi AS gi_a, b.gi AS gi_b, k, hard, gap FROM box a JOIN box b ON a.gi % 40 = b.gi % 40 JOIN r ON k = a.gi % 40 WHERE "
    + " AND ".join(f"a.v{x}0 - gap <= b.v{x}1 AND b.v{x}0 <= a.v{x}1 + gap" for x in "xyz")
    + " AND CASE WHEN split THEN a.model_id = 'm0' AND b.model_id = 'm1' ELSE a.gi < b.gi END"
    " AND NOT (excludes AND concat(least(a.ifc_type, b.ifc_type), ':', greatest(a.ifc_type, b.ifc_type)) IN ('T0:T1', 'T2:T3', 'T4:T4')))"
)


@_query(_with(
    "SELECT concat('d', k) AS document, CAST(gi_a AS VARCHAR) AS element_a, CAST(gi_b AS VARCHAR) AS element_b, distance, type FROM (SELECT gi_a, gi_b, distance, 'hard' AS type FROM hard UNION ALL"
    " SELECT gi_a, gi_b, CAST(round_even(min(d) * 1000, 0) AS BIGINT) AS distance, 'clearance' AS type FROM (SELECT * FROM nn UNION ALL SELECT * FROM face_a UNION ALL SELECT * FROM face_b) AS every"
    " JOIN cand USING (gi_a, gi_b) GROUP BY gi_a, gi_b, gap HAVING min(d) <= gap) AS rows JOIN cand USING (gi_a, gi_b)",
    "boxes", _FORTY_SQL, _hits("SELECT * FROM cand WHERE hard"), _HARD,
    *[f("SELECT * FROM (SELECT * FROM cand WHERE gap > 0) AS soft ANTI JOIN hard USING (gi_a, gi_b)", *more) for f, *more in ((_vertex_sql, 0.0), (_face_sql, "a", "b"), (_face_sql, "b", "a"))],
))
def payload_rule_sets(spark, sf_dir):
    """Forty JSON payloads with forty different rule sets, in one plan."""
    found = detect_documents(_payloads(spark, sf_dir, "gi % 40", _FORTY), with_point=False)
    return found.select("document", F.col("elementA").alias("element_a"), F.col("elementB").alias("element_b"), "distance", "type")


@_query(_with(
    "SELECT concat('d', k) AS document, CASE WHEN k % 8 = 5 THEN 'not a JSON payload' WHEN k % 8 = 6 THEN 'repeated document key' END AS fault,"
    " CASE WHEN k % 8 NOT IN (5, 6) THEN n END AS elements FROM (SELECT gi % 40 AS k, count(*) AS n FROM el GROUP BY 1) AS documents",
))
def payload_unreadable(spark, sf_dir):
    """Forty JSON payloads of which some are cut off and some come twice: what is read, and what is put aside, with the reason."""
    wire = _wire_of(scenes.elements(spark, sf_dir)).withColumn("k", F.expr("gi % 40"))
    texts = wire.groupBy("k").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("json"))
    texts = texts.withColumn("json", F.expr("if(k % 8 = 5, substring(json, 1, length(json) - 40), json)"))
    texts = texts.unionByName(texts.where("k % 8 = 6")).select(F.concat(F.lit("d"), F.col("k")).alias("document"), "json")
    kept = explode_elements(payload_texts(texts, strict=False)).groupBy("document").agg(F.lit(None).cast("string").alias("fault"), F.count("*").alias("elements"))
    return kept.unionByName(unreadable(texts).select("document", "fault", F.lit(None).cast("long").alias("elements")))


_THREE = "CASE k WHEN 0 THEN named_struct('mode', 'hard', 'maxGap', 0D, 'modelA', 'all', 'modelB', 'all') WHEN 1 THEN named_struct('mode', 'soft', 'maxGap', 20D, 'modelA', 'all', 'modelB', 'all') ELSE named_struct('mode', 'hard', 'maxGap', 0D, 'modelA', 'm0', 'modelB', 'm1') END"
_IN_DOCUMENT = lambda pairs, k: f"SELECT * FROM ({pairs}) AS d{k} WHERE gi_a % 3 = {k} AND gi_b % 3 = {k}"
_HARD_PAIRS = f"{_IN_DOCUMENT(_pairs_sql(), 0)} UNION ALL {_IN_DOCUMENT(_pairs_sql(CROSS, False), 2)}"


@_query(_with(
    "SELECT concat('d', gi_a % 3) AS document, CAST(gi_a AS VARCHAR) AS element_a, CAST(gi_b AS VARCHAR) AS element_b, distance, type FROM"
    " (SELECT gi_a, gi_b, distance, 'hard' AS type FROM hard UNION ALL SELECT gi_a, gi_b, distance, 'clearance' AS type FROM near) AS every",
    "boxes", _hits(_HARD_PAIRS), _HARD, *_soft_parts(SOFT, _IN_DOCUMENT(_pairs_sql(SOFT), 1)),
))
def payload_documents(spark, sf_dir):
    """Three JSON payloads at once, each with its own rules: hard, soft, and one model against another."""
    found = detect_documents(_payloads(spark, sf_dir, "gi % 3", _THREE), with_point=False)
    return found.select("document", F.col("elementA").alias("element_a"), F.col("elementB").alias("element_b"), "distance", "type")


@_query(_with("SELECT upper(substr(sha256(concat_ws(chr(31), p.model_id, p.element_id, q.model_id, q.element_id, 'hard', CAST(distance AS VARCHAR))), 1, 8)) AS id, p.element_id AS element_a, q.element_id AS element_b FROM hard JOIN el p ON p.gi = gi_a JOIN el q ON q.gi = gi_b", "boxes", _hits(_pairs_sql()), _HARD))
def clash_ids(spark, sf_dir):
    """Stable ids of hard clashes."""
    found = named(found_in(scenes.elements(spark, sf_dir), Rules(), with_point=False, with_ids=True), stable_ids=True)
    return found.select("id", F.col("elementA").alias("element_a"), F.col("elementB").alias("element_b"))


_MID = ", ".join(f"(a.{x} + b.{x}) / 2 AS m{x}" for x in XYZ)
_APART = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in XYZ)


@_query(_with(
    "SELECT gi_a, gi_b, round(mx, 3) AS px, round(my, 3) AS py, round(mz, 3) AS pz FROM (SELECT *, row_number() OVER (PARTITION BY gi_a, gi_b ORDER BY d, v_a, v_b) AS n FROM"
    f" (SELECT gi_a, gi_b, sqrt({_APART}) AS d, a.v_idx AS v_a, b.v_idx AS v_b, {_MID} FROM ({_pairs_sql(SOFT)}) AS pairs JOIN v a ON a.gi = gi_a JOIN v b ON b.gi = gi_b) AS every WHERE d <= {SOFT.gap_m!r}) AS ranked WHERE n = 1",
))
def clearance_points(spark, sf_dir):
    """The middle between the closest vertices, the first ones of equally close ones."""
    found = found_in(scenes.elements(spark, sf_dir), SOFT, vertex_only=True)
    return found.select("gi_a", "gi_b", *[F.round(f"p{x}", 3).alias(f"p{x}") for x in XYZ])


_EDGES = (
    "edge AS (SELECT e.gi, " + ", ".join(f"{p}.{x} AS s{k}{x}" for k, p in enumerate("pq") for x in XYZ) + " FROM (SELECT DISTINCT gi, least(i, j) AS i, greatest(i, j) AS j FROM el,"
    " (SELECT i0 AS i, i1 AS j FROM face UNION SELECT i1, i2 FROM face UNION SELECT i0, i2 FROM face) AS sides) AS e JOIN v p ON p.gi = e.gi AND p.v_idx = i JOIN v q ON q.gi = e.gi AND q.v_idx = j)"
)


def _edge_sql(pairs: str) -> str:
    source = f"SELECT gi_a, gi_b, {', '.join(f'{e}.s{k}{x} AS {s}{k}{x}' for s, e in (('s', 'a'), ('t', 'b')) for k in range(2) for x in XYZ)} FROM ({pairs}) AS pairs JOIN edge a ON a.gi = gi_a JOIN edge b ON b.gi = gi_b"
    return f"edges AS (SELECT gi_a, gi_b, dist AS d FROM ({sql_stages(source, closest_between_segments('s', 't'))}) AS found)"


@_query(_with("SELECT gi_a, gi_b, distance FROM near", "boxes", *_soft_parts(SOFT, _pairs_sql(SOFT))[:3], _EDGES, _edge_sql(_pairs_sql(SOFT)), _clear("near", ["nn", "face_a", "face_b", "edges"], SOFT.gap_m)))
def clearance_exact(spark, sf_dir):
    """Clearances with edges held against edges too."""
    return narrow.result_rows(found_in(scenes.elements(spark, sf_dir), SOFT, with_point=False, exact=True)).select("gi_a", "gi_b", "distance")


@_query(_with("SELECT gi, count(*) AS n_triangles, round(max(radius), 6) AS radius, " + ", ".join(f"round(avg(c{x}), 6) AS c{x}" for x in XYZ) + " FROM (SELECT *, greatest(" + ", ".join(
    "sqrt(" + " + ".join(f"(t{k}{x} - c{x}) * (t{k}{x} - c{x})" for x in XYZ) + ")" for k in range(3)) + ") AS radius FROM (SELECT *, " + ", ".join(f"(t0{x} + t1{x} + t2{x}) / 3 AS c{x}" for x in XYZ) + " FROM tri) AS centred) AS measured GROUP BY gi", "lattice"))
def triangle_radii(spark, sf_dir):
    """Of each mesh the mean of its triangles' centroids, and the largest distance of a corner from its triangle's centroid."""
    found = geometry.mesh_radii(scenes.elements(spark, sf_dir, "lattice"))
    return found.select("gi", "n_triangles", *[F.round(c, 6).alias(c) for c in ("radius", "cx", "cy", "cz")])


def _large_pairs() -> str:
    return "SELECT a.gi AS gi_a, b.gi AS gi_b FROM box a JOIN box b ON a.gi < b.gi AND " + " AND ".join(f"a.v{x}0 <= b.v{x}1 AND b.v{x}0 <= a.v{x}1" for x in XYZ)


@_query("WITH " + ", ".join([scenes.sql_large(), _hits(_large_pairs()), _HARD]) + (
    " SELECT gi_a, gi_b, n AS hits, distance, px, py, pz FROM hard JOIN (SELECT gi_a, gi_b, count(*) AS n FROM hits GROUP BY ALL) AS counted USING (gi_a, gi_b) JOIN (SELECT gi_a, gi_b, "
    + ", ".join(f"round(avg(p{x}), 3) AS p{x}" for x in XYZ) + " FROM (SELECT *, row_number() OVER (PARTITION BY gi_a, gi_b ORDER BY tri_a, tri_b) AS n FROM hits) AS ranked WHERE n <= 24 GROUP BY gi_a, gi_b) AS placed USING (gi_a, gi_b)"
))
def large_meshes(spark, sf_dir):
    """Four meshes of all rows' triangles, long and short ones mixed: all hits, depth, and the mean of the first 24."""
    e = cut(scenes.large_meshes(spark, sf_dir))
    pairs = candidates_of(e, Rules())
    found = narrow.counted_clashes(pairs, e)
    return found.select("gi_a", "gi_b", "hits", (-F.rint(F.col("depth") * 1000)).cast("long").alias("distance"), *[F.round(F.col("point")[k], 3).alias(f"p{x}") for k, x in enumerate(XYZ)])
