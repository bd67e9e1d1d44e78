"""Narrow phase: hard clashes by exact triangle tests, and clearances by point-to-surface distances.

Each candidate pair says what to look for: hard (test for intersection) and gap (clearance in metres, or null). Pairs of small
meshes get both meshes as flat arrays and are decided in one kernel, with no shuffle behind it. Meshes with more parts
are cut into blocks of parts alike in size and place; blocks meet by cells, on the level of the larger one, as boxes do in the
broad phase, so a block makes eight rows a level at most, however sizes vary, and no pair of meshes is one task. Blocks, and what is
known after each step about pairs of such meshes, are written to the checkpoint folder.

Work ends early: a pair leaves the kernel when it has its hits, at most 24 hits of a pair leave a batch, and distances are looked
for only below a bound, the best one known so far (of large meshes first that of the blocks' first points).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.meshes import BLOCKS, FOUND, HITS, KINDS, NEAR, block_distance_kernel, block_hits_kernel, blocks_kernel, pair_kernel
from ..schema import BOX, DEPTH_SEMANTICS, MAX_POINTS, MESH_BOX
from .broadphase import THIN, in_cells
from .geometry import AXES
from .lineage import cut

PAIR = ["gi_a", "gi_b"]
#: Meshes with more parts (triangles or vertices) than this meet by blocks.
SMALL_PARTS = 256
_ENDS = [f"{x}{e}" for e in "01" for x in AXES]


def _has_large(elements: DataFrame) -> bool:
    """Whether any mesh is too large to be taken whole."""
    most = elements.agg(F.max(F.greatest("n_verts", "n_faces"))).first()[0]
    return (most or 0) > SMALL_PARTS


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over enough partitions: a kernel's work is out of proportion to the bytes, by which adaptive plans would put them together."""
    context, session = rows.sparkSession.sparkContext, rows.sparkSession.conf
    return rows.repartition(max(2 * context.defaultParallelism, int(session.get("spark.sql.shuffle.partitions"))), *keys)


def _parts() -> Column:
    return F.greatest("n_verts", "n_faces")


def mesh_arrays(elements: DataFrame, keep: list) -> DataFrame:
    """Columns to keep, and meshes as flat arrays: xyz (coordinates are float32 values) and faces."""
    flat = lambda c, names, kind: F.expr(f"flatten(transform({c}, p -> array({', '.join(f'cast(p.{n} as {kind})' for n in names)})))")
    return elements.select(*keep, flat("verts", AXES, "float").alias("xyz"), flat("faces", ("i0", "i1", "i2"), "int").alias("faces"))


def _meshes(elements: DataFrame, s: str) -> DataFrame:
    """Meshes as flat arrays: gi_{s}, {s}_xyz, {s}_faces."""
    return mesh_arrays(elements, [F.col("gi").alias(f"gi_{s}")]).withColumnsRenamed({c: f"{s}_{c}" for c in ("xyz", "faces")})


def tested(candidates: DataFrame, elements: DataFrame, hard: bool | Column, gap: float | Column | None, with_point: bool = True, stages: int = 3, buckets: int | None = None) -> DataFrame:
    """The clashes of candidate pairs: gi_a, gi_b, is_hard, d (metres), px, py, pz.

    hard: whether a pair is tested for intersection; d is then the depth, the least overlap of the mesh boxes, and the point the mean of the
    first 24 hits by triangle numbers (null unless with_point). gap: pairs that don't intersect, or aren't tested for it, and come so near; d is the
    distance and the point the middle between the closest places. stages: 1 for vertices only, 3 with vertices to triangles both ways, 4 with
    edges too, which gives the exact distance of surfaces that don't intersect. Earlier stages win ties, then smaller numbers. buckets: how many
    the elements are stored in by gi (see sources.store); pairs are then dealt likewise, and meshes aren't shuffled.
    """
    wanted = hard is not False, gap is not None
    hard, gap = (c if isinstance(c, Column) else F.lit(c) for c in (hard, gap))
    pairs = candidates.select(*PAIR, hard.alias("hard"), gap.cast("double").alias("gap")).where(F.col("hard") | F.col("gap").isNotNull())
    pairs = pairs.repartition(buckets, "gi_a") if buckets else _spread(pairs, *PAIR)  # by both, as one element may be in very many pairs
    large = _has_large(elements)
    small = elements.where(_parts() <= SMALL_PARTS) if large else elements
    whole = pairs.join(_meshes(small, "a"), "gi_a")
    # a row of the first join has one mesh already; the second one's comes to it, or it goes to the buckets
    whole = (whole.repartition(buckets, "gi_b") if buckets else whole).join(_meshes(small, "b"), "gi_b")
    whole = whole.select(*PAIR, "hard", "gap", *[f"{s}_{c}" for s in "ab" for c in ("xyz", "faces")]).mapInArrow(pair_kernel(with_point, stages, MAX_POINTS), FOUND)
    return whole.unionByName(_tested_by_blocks(pairs, elements, with_point, stages, wanted)) if large else whole


# meshes by blocks


def mesh_blocks(elements: DataFrame, with_edges: bool = False) -> DataFrame:
    """Blocks of the parts of meshes: gi, kind (see KINDS), block, its box x0 .. z1, its first point, and its parts (ids, xyz)."""
    meshes = _meshes(elements, "m").withColumnRenamed("gi_m", "gi")
    return meshes.mapInArrow(blocks_kernel(with_edges), BLOCKS)


def with_boxes_of(pairs: DataFrame, elements: DataFrame, box: list[str] = BOX) -> DataFrame:
    """Pairs with both elements' boxes (a{column}, b{column})."""
    side = lambda s: elements.select(F.col("gi").alias(f"gi_{s}"), *[F.col(c).alias(f"{s}{c}") for c in box])
    return pairs.join(side("a"), "gi_a").join(side("b"), "gi_b")


def with_powers(blocks: DataFrame) -> DataFrame:
    """Blocks with the powers of two up to which the boxes of their mesh and kind reach (powers)."""
    width = F.greatest(*[F.col(f"{x}1") - F.col(f"{x}0") for x in AXES], F.lit(THIN))
    powers = blocks.groupBy("gi", "kind").agg(F.collect_set(F.ceil(F.log2(width)).cast("int")).alias("powers"))
    return blocks.join(powers, ["gi", "kind"])


def _levels(width: Column) -> Column:
    return F.ceil(F.log2(width)).cast("int")


def block_pairs(pairs: DataFrame, blocks: DataFrame, left: tuple[str, str], right: tuple[str, str], carry: list[str]) -> DataFrame:
    """Pairs of blocks (see with_powers) whose boxes come within the reach (a column of pairs, metres) of each other, for each pair of elements.

    pairs: gi_a, gi_b, reach and both elements' boxes. left, right: a side and a kind of parts. The result has the left block's columns as a_*, the
    right one's as b_*. A block is written to the cells of its own level and of the other mesh's coarser levels.
    """
    power = lambda p: F.pow(F.lit(2.0), p)
    rows = {}
    for (s, kind), (o, other_kind), name in ((left, right, "a"), (right, left, "b")):
        own = blocks.where(F.col("kind") == KINDS[kind]).select(F.col("gi").alias(f"gi_{s}"), *[F.col(c).alias(f"{name}_{c}") for c in blocks.columns if c not in ("gi", "kind", "powers")])
        others = blocks.where(F.col("kind") == KINDS[other_kind]).groupBy(F.col("gi").alias(f"gi_{o}")).agg(F.first("powers").alias("powers"))
        r = pairs.join(own, f"gi_{s}").join(others, f"gi_{o}")
        # away from the other element's box nothing is near
        r = r.where(reduce(lambda p, q: p & q, [(F.col(f"{name}_{x}0") - F.col("reach") <= F.col(f"{o}v{x}1")) & (F.col(f"{name}_{x}1") + F.col("reach") >= F.col(f"{o}v{x}0")) for x in AXES]))
        slack = F.col("reach") if name == "a" else F.lit(0.0)
        low, high = ({x: F.col(f"{name}_{x}{e}") + d for x in AXES} for e, d in (("0", -slack), ("1", slack)))
        level = _levels(F.greatest(*[high[x] - low[x] for x in AXES], F.lit(THIN)))
        # where the left boxes are widened, those of one power come to two levels at most
        wide = F.lit(0.0) if name == "a" else 2 * F.col("reach")
        reached = F.flatten(F.transform("powers", lambda p: F.array(_levels(power(p - 1) + wide), _levels(power(p) + wide))))
        r = r.withColumns({**{f"{name}w{x}{e}": c[x] for x in AXES for e, c in (("0", low), ("1", high))}, f"{name}level": level, "reached": reached})
        grid = F.concat(F.array(f"{name}level"), F.filter(F.array_distinct("reached"), lambda k: k > F.col(f"{name}level")))
        r = r.withColumn("grid", F.explode(grid)).drop("powers", "reached")
        r = in_cells(r, *({x: F.col(f"{name}w{x}{e}") for x in AXES} for e in "01"), power(F.col("grid")), f"{name}first")
        keep = [c for c in r.columns if c.startswith(name) and c[1] != "v"]
        rows[name] = r.select(*PAIR, "grid", "cx", "cy", "cz", *keep, *(carry if name == "a" else []))
    met = rows["a"].join(rows["b"], [*PAIR, "grid", "cx", "cy", "cz"])
    tests = [(F.col("alevel") == F.col("grid")) | (F.col("blevel") == F.col("grid"))]
    for x in AXES:
        tests += [F.col(f"c{x}") == F.greatest(f"afirst{x}", f"bfirst{x}"), F.col(f"aw{x}0") <= F.col(f"bw{x}1"), F.col(f"bw{x}0") <= F.col(f"aw{x}1")]
    met = met.where(reduce(lambda p, q: p & q, tests))
    return met.select(*PAIR, *carry, *[c for c in met.columns if c[:2] in ("a_", "b_")])


_BLOCKS = [*PAIR, "a_block", "b_block"]
_GEOMETRY = [f"{s}_{c}" for s in "ab" for c in ("ids", "xyz")]


def triangle_hits(candidates: DataFrame, elements: DataFrame, most: int | None = None) -> DataFrame:
    """Triangle pairs of candidate pairs that intersect: gi_a, gi_b, tri_a, tri_b, px, py, pz; all, or at least the first `most` of each pair."""
    pairs = with_boxes_of(candidates.select(*PAIR), elements).withColumn("reach", F.lit(0.0))
    return _hits_by_blocks(pairs, with_powers(mesh_blocks(elements)), most)


def counted_clashes(candidates: DataFrame, elements: DataFrame) -> DataFrame:
    """Candidate pairs with triangle hits: gi_a, gi_b, hits (how many), depth and point as hard_clashes gives them. Blocks meet once for all of these,
    and of a pair's hits no more than the first 24 of each batch leave the kernel."""
    pairs = cut(with_boxes_of(candidates.select(*PAIR), elements).withColumn("reach", F.lit(0.0)))
    blocks = cut(with_powers(mesh_blocks(elements).where(F.col("kind") == KINDS["triangles"])))
    met = _met_blocks(pairs, blocks, ("a", "triangles"), ("b", "triangles"), [])
    hits = cut(met.mapInArrow(block_hits_kernel(MAX_POINTS, counted=True), f"{HITS}, n long"))
    counts = hits.groupBy(*PAIR).agg(F.sum("n").alias("hits"))
    struck = _first_points(hits).join(counts, PAIR)
    return _with_depths(struck, elements).select(*PAIR, "hits", F.col("d").alias("depth"), F.array("px", "py", "pz").alias("point"))


def _first_points(hits: DataFrame) -> DataFrame:
    """The mean of each pair's first hits."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*PAIR).orderBy("tri_a", "tri_b"))).where(F.col("rank") <= MAX_POINTS)
    return ranked.groupBy(*PAIR).agg(*[F.avg(f"p{x}").alias(f"p{x}") for x in AXES])


def _with_depths(struck: DataFrame, elements: DataFrame) -> DataFrame:
    """Pairs with the least overlap of their mesh boxes (d)."""
    over = [F.greatest(F.least(F.col(f"af{x}1"), F.col(f"bf{x}1")) - F.greatest(F.col(f"af{x}0"), F.col(f"bf{x}0")), F.lit(0.0)) for x in AXES]
    return with_boxes_of(struck, elements, MESH_BOX).withColumn("d", F.least(*over))


def _met_blocks(pairs: DataFrame, blocks: DataFrame, left: tuple[str, str], right: tuple[str, str], carry: list[str]) -> DataFrame:
    """Pairs of blocks with their parts. Boxes alone go through the cells; parts are fetched for the blocks that have met."""
    met = block_pairs(pairs, blocks.drop("ids", "xyz"), left, right, carry).select(*_BLOCKS, *carry)
    for (s, kind), name in ((left, "a"), (right, "b")):
        parts = blocks.where(F.col("kind") == KINDS[kind]).select(F.col("gi").alias(f"gi_{s}"), F.col("block").alias(f"{name}_block"), F.col("ids").alias(f"{name}_ids"), F.col("xyz").alias(f"{name}_xyz"))
        met = met.join(parts, [f"gi_{s}", f"{name}_block"])
    return met.select(*PAIR, *carry, *_GEOMETRY)


def _hits_by_blocks(pairs: DataFrame, blocks: DataFrame, most: int | None) -> DataFrame:
    return _met_blocks(pairs, blocks, ("a", "triangles"), ("b", "triangles"), []).mapInArrow(block_hits_kernel(most), HITS)


def _tested_by_blocks(pairs: DataFrame, elements: DataFrame, with_point: bool, stages: int, wanted: tuple[bool, bool]) -> DataFrame:
    sizes = lambda s: elements.select(F.col("gi").alias(f"gi_{s}"), _parts().alias(f"n_{s}"))
    pairs = pairs.join(sizes("a"), "gi_a").join(sizes("b"), "gi_b").where(F.greatest("n_a", "n_b") > SMALL_PARTS).drop("n_a", "n_b")
    used = pairs.select(F.col("gi_a").alias("gi")).unionByName(pairs.select(F.col("gi_b").alias("gi"))).distinct()
    # used by every step from here on; written once
    blocks = cut(with_powers(mesh_blocks(elements.join(used, "gi", "left_semi"), stages == 4)))
    pairs = cut(with_boxes_of(pairs, elements))
    if not wanted[0]:
        return _clearance_columns(_nearest_by_blocks(pairs, blocks, stages))
    hits = _hits_by_blocks(pairs.where("hard").withColumn("reach", F.lit(0.0)), blocks, MAX_POINTS if with_point else 1)
    struck = _first_points(hits) if with_point else hits.select(*PAIR).distinct().withColumns({f"p{x}": F.lit(None).cast("double") for x in AXES})
    struck = cut(struck)
    out = _with_depths(struck, elements).select(*PAIR, F.lit(True).alias("is_hard"), "d", "px", "py", "pz")
    if not wanted[1]:
        return out
    soft = pairs.where(F.col("gap").isNotNull()).join(struck.select(*PAIR), PAIR, "left_anti")
    return out.unionByName(_clearance_columns(_nearest_by_blocks(soft, blocks, stages)))


def _clearance_columns(near: DataFrame) -> DataFrame:
    return near.select(*PAIR, F.lit(False).alias("is_hard"), "d", *[F.col(f"m{x}").alias(f"p{x}") for x in AXES])


def _nearest_by_blocks(pairs: DataFrame, blocks: DataFrame, stages: int) -> DataFrame:
    """Distances of pairs up to their gap, in two steps: the first points of near blocks bound a pair's distance, then parts are compared below it."""
    firsts = block_pairs(pairs.withColumn("reach", F.col("gap")), blocks.drop("ids", "xyz"), ("a", "vertices"), ("b", "vertices"), [])
    apart = F.sqrt(sum(((F.col(f"a_f{x}") - F.col(f"b_f{x}")) * (F.col(f"a_f{x}") - F.col(f"b_f{x}")) for x in AXES[1:]), (F.col("a_fx") - F.col("b_fx")) * (F.col("a_fx") - F.col("b_fx"))))
    bound = firsts.groupBy(*PAIR).agg(F.min(apart).alias("known"))
    pairs = cut(pairs.join(bound, PAIR, "left").withColumn("reach", F.least("gap", F.coalesce("known", "gap"))))
    out = None
    for stage, (left, right) in enumerate([(("a", "vertices"), ("b", "vertices")), (("a", "vertices"), ("b", "triangles")), (("b", "vertices"), ("a", "triangles")), (("a", "edges"), ("b", "edges"))][:stages]):
        met = _met_blocks(pairs, blocks, left, right, ["reach"]).withColumnRenamed("reach", "bound")
        found = met.mapInArrow(block_distance_kernel(stage), NEAR)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy(*PAIR).agg(F.min(F.struct("d", "stage", "v_a", "v_b", "mx", "my", "mz")).alias("best"))
    return best.select(*PAIR, "best.*")


# results


def hard_clashes(candidates: DataFrame, elements: DataFrame, with_point: bool = True) -> DataFrame:
    """One row for each candidate pair with a triangle hit: gi_a, gi_b, depth (metres, the least overlap of the mesh boxes) and point, the mean of the first
    24 hits by triangle numbers; leave it out and the first hit decides a pair."""
    found = tested(candidates, elements, True, None, with_point)
    return found.select(*PAIR, F.col("d").alias("depth"), *([F.array("px", "py", "pz").alias("point")] if with_point else []))


def clearances(candidates: DataFrame, elements: DataFrame, gap_m: float, vertex_only: bool = False, exact: bool = False) -> DataFrame:
    """Pairs whose distance is the gap at most: gi_a, gi_b, d (metres), point (the middle between the closest places).

    The distance is the least of vertex to vertex, A's vertices to B's triangles, and B's to A's; with vertex_only only the first counts, and
    with exact edges are held against edges too.
    """
    found = tested(candidates, elements, False, gap_m, stages=1 if vertex_only else 4 if exact else 3)
    return found.select(*PAIR, "d", F.array("px", "py", "pz").alias("point"))


def result_rows(found: DataFrame, carry: list[Column] = []) -> DataFrame:
    """Result columns of tested pairs, and what else is carried. A hard clash's distance is minus the depth, a clearance's the distance, in whole millimetres (half to even)."""
    hard, mm = F.col("is_hard"), F.rint(F.col("d") * 1000)
    return found.select(
        *PAIR, *carry, F.when(F.col("px").isNotNull(), F.array("px", "py", "pz")).alias("point"), F.when(hard, -mm).otherwise(mm).cast("long").alias("distance"),
        F.when(~hard, F.lit(0.0)).alias("volume"), F.when(hard, F.lit(DEPTH_SEMANTICS)).alias("depth_semantics"), F.when(hard, F.lit("hard")).otherwise(F.lit("clearance")).alias("type"),
    )


def hard_rows(found: DataFrame) -> DataFrame:
    """Result columns of hard clashes (see hard_clashes)."""
    point = [F.col("point")[k] if "point" in found.columns else F.lit(None).cast("double") for k in range(3)]
    return result_rows(found.select(*PAIR, F.lit(True).alias("is_hard"), F.col("depth").alias("d"), *[p.alias(f"p{x}") for p, x in zip(point, AXES)]))


def clearance_rows(found: DataFrame) -> DataFrame:
    """Result columns of clearances (see clearances)."""
    return result_rows(found.select(*PAIR, F.lit(False).alias("is_hard"), "d", *[F.col("point")[k].alias(f"p{x}") for k, x in enumerate(AXES)]))
