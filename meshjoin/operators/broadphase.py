"""Broad phase: pairs of elements whose boxes overlap, the first one's box widened by the gap.

The grid join is an equi-join on cells. Boxes fall into size levels with doubling cells, so a box meets two cells
an axis at most on its own level and on every coarser one, however sizes vary. A pair is found on the level of
its larger box, by joining that level's own boxes with its own and finer ones, and kept only in its reference
cell, so nothing is found twice. Few boxes (checked by a count) are joined by broadcast instead.

The theta join holds all boxes of one side against all of the other by the plain condition, without cells: few boxes by broadcast,
more in tiles, each of which takes a bounded number of boxes of both sides.

Rules are either one set for all elements, or columns: then each document's elements meet under its own rules, in one plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BOX, Rules
from .geometry import AXES
from .lineage import cut

#: At most so many boxes on the second side are broadcast, and only where both sides make at most so many pairs to test.
BROADCAST_BOXES, BROADCAST_PAIRS = 4096, 1 << 25
LEVELS = 24
#: Narrower boxes count as this wide (metres).
THIN = 1e-6
_SIDE = ["gi", "element_id", "model_id", "ifc_type", *BOX]


def _side(elements: DataFrame) -> list[str]:
    """Columns that a side needs; elements of several payloads pair within their own document."""
    return [*_SIDE, "document"] if "document" in elements.columns else _SIDE


def thin(elements: DataFrame) -> DataFrame:
    """What the broad phase needs of elements: identities and boxes, without meshes."""
    return elements.select(*_side(elements))


def scope(elements: DataFrame, model: str) -> DataFrame:
    """All elements, or those of exactly one model."""
    return elements if model == "all" else elements.where(F.col("model_id") == model)


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two selections hold equally many elements and the same (model_id, element_id) keys."""
    keys = a.select("model_id", "element_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("model_id", "element_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    by_key = keys.groupBy("model_id", "element_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = by_key.agg(F.sum("a"), F.sum("b"), F.sum(F.when((F.col("a") > 0) != (F.col("b") > 0), 1).otherwise(0))).first()
    return row[0] == row[1] and not row[2]


def blocked_types(pairs) -> list[str]:
    """Sorted types, joined by a colon, that rules block. A rule of two types blocks the unordered pair, any other text only itself."""
    two = {":".join(sorted(rule.split(":"))) for rule in pairs if rule.count(":") == 1}
    return sorted(two.union(rule for rule in pairs if rule.count(":") != 1))


def blocked_column(pairs: Column) -> Column:
    """The same for a column of rules (array of texts; null for none)."""
    key = lambda rule: F.when(F.size(F.split(rule, ":")) == 2, F.array_join(F.array_sort(F.split(rule, ":")), ":")).otherwise(rule)
    return F.coalesce(F.transform(pairs, key), F.array().cast("array<string>"))


def _sides(a: DataFrame, b: DataFrame, gap_m: float | str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with their columns named by side; a's boxes are widened by gap_m, a number or one of its columns."""
    gap = F.col(gap_m) if isinstance(gap_m, str) else F.lit(float(gap_m))
    box = lambda c: F.col(c) + (gap if c.endswith("1") else -gap)
    widened = isinstance(gap_m, str) or gap_m != 0
    left = a.select(*[(box(c) if widened and c in BOX else F.col(c)).alias(f"{c}_a") for c in _side(a)], *carry)
    return left, b.select(*[F.col(c).alias(f"{c}_b") for c in _side(b)])


def _overlap() -> list[Column]:
    return [(F.col(f"v{x}0_a") <= F.col(f"v{x}1_b")) & (F.col(f"v{x}0_b") <= F.col(f"v{x}1_a")) for x in AXES]


def _other_key() -> Column:
    return ~(F.col("model_id_a").eqNullSafe(F.col("model_id_b")) & F.col("element_id_a").eqNullSafe(F.col("element_id_b")))


def _type_key() -> Column:
    return F.array_join(F.array_sort(F.array("ifc_type_a", "ifc_type_b")), ":")


def _all(tests: list) -> Column:
    return reduce(lambda p, q: p & q, tests)


def _pair_rule(rules: Rules, same: bool) -> Column:
    tests = _overlap()
    if same:
        tests.append(F.col("gi_a") < F.col("gi_b"))
    elif rules.exclude_self:
        tests.append(_other_key())
    if rules.exclude_type_pairs:
        tests.append(~_blocked(blocked_types(rules.exclude_type_pairs)))
    return _all(tests)


def _blocked(texts: list[str]) -> Column:
    """Whether a pair's types, sorted and joined by a colon, are one of the texts, told by comparisons of the types themselves: no text is made for a pair
    unless one of its types is null."""
    cuts = [(t[:k], t[k + 1 :]) for t in texts for k, c in enumerate(t) if c == ":"]
    both = [((F.col("ifc_type_a") == x) & (F.col("ifc_type_b") == y)) | ((F.col("ifc_type_a") == y) & (F.col("ifc_type_b") == x)) for x, y in cuts if x.encode() <= y.encode()]
    null = F.col("ifc_type_a").isNull() | F.col("ifc_type_b").isNull()
    return F.when(null, _type_key().isin(texts)).otherwise(reduce(lambda p, q: p | q, both, F.lit(False)))


def _pair_rule_by_columns() -> Column:
    """The same where same, exclude_self and blocked are columns."""
    order = F.when(F.col("same"), F.col("gi_a") < F.col("gi_b")).otherwise(~F.col("exclude_self") | _other_key())
    return _all([*_overlap(), order, ~F.array_contains("blocked", _type_key())])


def _width(s: str) -> Column:
    return F.greatest(*[F.col(f"v{x}1_{s}") - F.col(f"v{x}0_{s}") for x in AXES], F.lit(THIN))


@dataclass(frozen=True)
class Census:
    """Numbers of boxes on both sides, the tenth percentile of their longest sides, and the powers of two up to which sides reach."""

    a: int
    b: int
    side: float
    powers: tuple[int, ...]


def census(left: DataFrame, right: DataFrame) -> Census:
    """Counts both sides and looks at their sizes, in one job."""
    row = lambda df, s: df.select(*[(_width(s) if s == t else F.lit(None).cast("double")).alias(t) for t in "ab"])
    power = lambda t: F.ceil(F.log2(t)).cast("int")
    got = row(left, "a").unionByName(row(right, "b")).agg(
        F.count("a").alias("a"), F.count("b").alias("b"), F.percentile_approx(F.coalesce("a", "b"), 0.1, 1000).alias("side"), F.collect_set(power(F.coalesce("a", "b"))).alias("powers"),
    ).first()
    return Census(got["a"], got["b"], got["side"] or THIN, tuple(sorted(got["powers"])))


def in_cells(rows: DataFrame, low: dict[str, Column], high: dict[str, Column], step: Column, first: str) -> DataFrame:
    """One row for each cell (cx, cy, cz; `step` wide) that a box meets, with its first cell ({first}x ..)."""
    for x in AXES:
        lo, hi = F.floor(low[x] / step), F.floor(high[x] / step)
        rows = rows.withColumn(f"{first}{x}", lo).withColumn(f"c{x}", F.explode(F.sequence(lo, hi)))
    return rows


def _cells(side: DataFrame, s: str, cell: float, levels: list[int]) -> DataFrame:
    """One row for each cell that a box meets on its own level (home) and on each coarser level in use."""
    level = F.least(F.greatest(F.ceil(F.log2(_width(s)) - F.lit(math.log2(cell))), F.lit(0)), F.lit(LEVELS)).cast("int")
    rows = side.withColumn(f"level_{s}", level)
    rows = rows.withColumn("grid", F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col(f"level_{s}"))))
    ends = ({x: F.col(f"v{x}{e}_{s}") for x in AXES} for e in "01")
    return in_cells(rows, *ends, F.lit(cell) * F.pow(F.lit(2.0), F.col("grid")), f"first_{s}_")


def _grid_join(left: DataFrame, right: DataFrame, rule: Column, seen: Census, out: list[str], documents: bool, cell: float | None = None) -> DataFrame:
    # a power of two, so that the levels in use follow from the census
    cell = cell or 2.0 ** math.ceil(math.log2(max(seen.side, THIN)))
    clip = lambda k: min(max(math.ceil(k - math.log2(cell)), 0), LEVELS)
    levels = sorted({clip(k - back) for k in seen.powers for back in ((0,) if math.log2(cell).is_integer() else (0, 1))})
    if not levels:
        return left.join(right, F.lit(False)).select(*out)
    left, right = _cells(left, "a", cell, levels), _cells(right, "b", cell, levels)
    home_a, home_b = F.col("level_a") == F.col("grid"), F.col("level_b") == F.col("grid")
    on = ["grid", "cx", "cy", "cz"]
    if documents:
        left, right = (side.withColumn("document", F.col(f"document_{s}")) for side, s in ((left, "a"), (right, "b")))
        on = ["document", *on]
    rule = _all([rule, *[F.col(f"c{x}") == F.greatest(f"first_a_{x}", f"first_b_{x}") for x in AXES]])
    met = left.where(home_a).join(right, on).where(rule).select(*out)
    return met.unionByName(left.where(~home_a).join(right.where(home_b), on).where(rule).select(*out))


# sweep along one axis


#: About so many boxes of both sides come to a range of the axis, and so many pairs are tested at once.
RANGE_BOXES, MOST_RANGES, SWEEP_PAIRS = 1 << 14, 2048, 1 << 20
#: Boxes of a range for each strip into which it falls on a second axis, and strips at most.
STRIP_BOXES, MOST_STRIPS = 1 << 11, 64
_ACROSS = ["low_1", "high_1", "low_2", "high_2"]


def _sweep_kernel(batches):
    """For mapInArrow over boxes of ranges (slab, strip, side, row, low, high of the axis and of the others; slab_low, strip_low), sorted by slab, strip and low:
    pairs of rows of both sides that meet on all axes.

    A running set of the boxes that may still be met is carried from batch to batch; a pair is told in the range and the strip in which its later starts lie.
    """
    open_rows: dict[str, np.ndarray] | None = None
    names = ["slab", "strip", "side", "row", "low", "high", "slab_low", "strip_low", *_ACROSS]
    for batch in batches:
        new = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names}
        place = new["slab"].astype(np.int64) * (MOST_STRIPS + 1) + new["strip"]
        for one in np.unique(place):
            mine = place == one
            fresh = {c: v[mine] for c, v in new.items()}
            same = open_rows is not None and len(open_rows["slab"]) and open_rows["slab"][0] == fresh["slab"][0] and open_rows["strip"][0] == fresh["strip"][0]
            kept = open_rows if same else {c: v[:0] for c, v in fresh.items()}
            rows = {c: np.concatenate((kept[c], fresh[c])) for c in names}
            first_new = len(kept["slab"])
            # every new box against those before it that end no earlier than it starts: both are in order of their starts
            for begin in range(first_new, len(rows["low"]), SWEEP_PAIRS >> 8):
                later = np.arange(begin, min(begin + (SWEEP_PAIRS >> 8), len(rows["low"])))
                active = np.flatnonzero(rows["high"][: later[-1] + 1] >= rows["low"][later[0]])
                for some in np.array_split(later, max(1, len(later) * len(active) // SWEEP_PAIRS)):
                    of = lambda c: (rows[c][active][:, None], rows[c][some])
                    meet = active[:, None] < some
                    meet &= of("high")[0] >= of("low")[1]
                    meet &= of("side")[0] != of("side")[1]
                    meet &= rows["low"][some] >= rows["slab_low"][some]
                    for x in "12":
                        (low, other_low), (high, other_high) = of(f"low_{x}"), of(f"high_{x}")
                        meet &= low <= other_high
                        meet &= other_low <= high
                    i, j = np.nonzero(meet)
                    i, j = active[i], some[j]
                    own = np.maximum(rows["low_1"][i], rows["low_1"][j]) >= rows["strip_low"][j]
                    i, j = i[own], j[own]
                    a, b = np.where(rows["side"][i] == 0, i, j), np.where(rows["side"][i] == 0, j, i)
                    yield pa.RecordBatch.from_arrays([pa.array(rows["row"][a]), pa.array(rows["row"][b])], names=["row_a", "row_b"])
            stay = rows["high"] >= rows["low"][-1]
            open_rows = {c: v[stay] for c, v in rows.items()}


def _ranges(starts: DataFrame, parts: int) -> Column:
    """Bounds by which about equally many starts (at) come to each of `parts` ranges."""
    ends = [k / parts for k in range(1, parts)]
    cuts = sorted(set(starts.agg(F.percentile_approx("at", ends, 10 * parts)).first()[0])) if ends else []
    return F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")


def _sweep_join(left: DataFrame, right: DataFrame, rule: Column, out: list[str], documents: bool) -> DataFrame:
    """The join by a sweep along the axis on which centres vary most: boxes go to the ranges that they reach into, and meet there in order of their starts.

    Ranges are as many as boxes need, and fall into strips on a second axis: in one range very many boxes may lie side by side. Pairs leave the
    kernel when they meet on all axes.
    """
    sides = {"a": left, "b": right}
    centre = lambda s: sides[s].select(*[((F.col(f"v{x}0_{s}") + F.col(f"v{x}1_{s}")) / 2).alias(x) for x in AXES])
    spread = centre("a").unionByName(centre("b")).agg(*[F.var_pop(x).alias(x) for x in AXES], F.count("*").alias("n")).first()
    if not spread["n"]:
        return left.join(right, F.lit(False)).select(*out)
    axis, *others = sorted(AXES, key=lambda x: -spread[x])
    end = lambda x, e, s: F.col(f"v{x}{e}_{s}")
    parts = min(max(spread["n"] // RANGE_BOXES, 1), MOST_RANGES)
    strips = min(max(spread["n"] // parts // STRIP_BOXES, 1), MOST_STRIPS)
    starts = lambda x: left.select(end(x, 0, "a").alias("at")).unionByName(right.select(end(x, 0, "b").alias("at")))
    bounds = {"slab": _ranges(starts(axis), parts), "strip": _ranges(starts(others[0]), strips)}
    # the number of cuts at or below a place is its range
    place = lambda name, at: F.size(F.filter(bounds[name], lambda c: c <= at))
    rows = None
    for number, s in enumerate("ab"):
        ends = {"low": end(axis, 0, s), "high": end(axis, 1, s)} | {f"{n}_{k}": end(x, e, s) for k, x in enumerate(others, 1) for e, n in enumerate(("low", "high"))}
        r = sides[s].select(F.col(f"gi_{s}").alias("row"), F.lit(number).alias("side"), *[c.alias(n) for n, c in ends.items()])
        for name, low, high in (("slab", "low", "high"), ("strip", "low_1", "high_1")):
            r = r.withColumn(name, F.explode(F.sequence(place(name, F.col(low)), place(name, F.greatest(high, low)))))
        rows = r if rows is None else rows.unionByName(r)
    rows = rows.withColumns({f"{n}_low": F.when(F.col(n) > 0, F.get(bounds[n], F.col(n) - 1)).otherwise(F.lit(float("-inf"))) for n in bounds})
    ordered = rows.repartition(max(parts * strips, 1), "slab", "strip").sortWithinPartitions("slab", "strip", "low", "side", "row")
    met = ordered.select("slab", "strip", "side", "row", "low", "high", "slab_low", "strip_low", *_ACROSS).mapInArrow(_sweep_kernel, "row_a long, row_b long")
    pairs = met.join(left, F.col("row_a") == F.col("gi_a")).join(right, F.col("row_b") == F.col("gi_b"))
    return pairs.where(rule & (F.col("document_a") == F.col("document_b")) if documents else rule).select(*out)


# all against all in tiles


#: Boxes of both sides that come to a place at most and at least, and tiles for each core where there are enough boxes.
TILE_BOXES, LEAST_TILE, TILES = 1 << 18, 1 << 13, 4
#: Boxes of a run, the other side's boxes that are held against a run at once, and bits of a place on the Morton curve, by axis.
RUN, HELD, TILE_BITS = 64, 1 << 13, 10


class _Runs:
    """One side's boxes of a tile in runs of boxes alike in size and near each other, with each run's hull."""

    def __init__(self, rows: pa.Table, carried: str):
        ends = {c: rows.column(c).to_numpy() for c in BOX}
        sides = [ends[f"v{x}1"] - ends[f"v{x}0"] for x in AXES]
        middles = [(ends[f"v{x}0"] + ends[f"v{x}1"]) / 2 for x in AXES]
        step = max(m.max() - m.min() for m in middles) / ((1 << TILE_BITS) - 1) or 1.0
        code = np.zeros(rows.num_rows, np.int64)
        for k, m in enumerate(middles):
            cell = ((m - m.min()) / step).astype(np.int64)
            for bit in range(TILE_BITS):
                code |= (cell >> bit & 1) << (3 * bit + k)
        order = np.lexsort((code, np.ceil(np.log2(np.maximum(np.max(sides, axis=0), THIN)))))
        self.box = {c: v[order] for c, v in ends.items()}
        self.gi = rows.column("gi").to_numpy()[order]
        self.carried = rows.column(carried).combine_chunks().take(pa.array(order))
        starts = np.arange(0, rows.num_rows, RUN)
        self.hull = {c: (np.minimum if c.endswith("0") else np.maximum).reduceat(v, starts) for c, v in self.box.items()}

    def near(self, hull: dict[str, float]) -> np.ndarray:
        """Places of the boxes that meet a hull: runs are looked at first."""
        meets = lambda box: _all([(box[f"v{x}0"] <= hull[f"v{x}1"]) & (hull[f"v{x}0"] <= box[f"v{x}1"]) for x in AXES])
        at = (np.flatnonzero(meets(self.hull))[:, None] * RUN + np.arange(RUN)).ravel()
        at = at[at < len(self.gi)]
        return at[meets({c: v[at] for c, v in self.box.items()})]


def _tile_kernel(carried: dict[str, str], ordered: bool):
    """For mapInArrow over the boxes of one tile (side, gi, BOX, and each side's carried column): what the second side carries, by box, with a list of what
    the first side's boxes that overlap it carry; ordered: only those of a lesser gi."""

    def kernel(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        both = [rows.filter(pc.equal(rows.column("side"), k)) for k in (0, 1)]
        if not all(r.num_rows for r in both):
            return
        a, b = (_Runs(r, carried[s]) for r, s in zip(both, "ab"))
        mixed = ordered and a.gi.max() >= b.gi.min()
        for run in range(len(b.hull[BOX[0]])):
            at = slice(run * RUN, (run + 1) * RUN)
            box = {c: v[at, None] for c, v in b.box.items()}
            near = a.near({c: v[run] for c, v in b.hull.items()})
            for some in np.array_split(near, math.ceil(len(near) / HELD)) if len(near) else ():
                meet = a.gi[some] < b.gi[at, None] if mixed else np.ones((len(b.gi[at]), len(some)), bool)
                for x in AXES:
                    meet &= a.box[f"v{x}0"][some] <= box[f"v{x}1"]
                    meet &= box[f"v{x}0"] <= a.box[f"v{x}1"][some]
                hits = [np.flatnonzero(one) for one in meet]
                ends = pa.array(np.cumsum([0, *map(len, hits)]), pa.int32())
                found = a.carried.take(pa.array(some)).take(pa.array(np.concatenate(hits)))
                yield pa.RecordBatch.from_arrays([b.carried[at], pa.ListArray.from_arrays(ends, found)], names=["b", "a"])

    return kernel


def _tile_join(left: DataFrame, right: DataFrame, rule: Column, seen: Census, out: list[str], documents: bool, plain: bool) -> DataFrame:
    """The join by its plain condition where a side is too large for a broadcast: both sides fall into ranges of gi, and each range of one meets each of the
    other in a tile, a task of its own. A box goes to as many tiles as there are ranges.

    plain: the rule is that boxes overlap and that the first one's gi is less. Tiles of later ranges against earlier ones have no pairs then and aren't made;
    the kernel's pairs are the result. Otherwise whole rows go through the kernel, and its pairs of overlapping boxes through the rule.
    """
    n, cores = seen.a + seen.b, left.sparkSession.sparkContext.defaultParallelism
    tiles = lambda parts: parts * (parts + 1) // 2 if plain else parts * parts
    parts = max(math.ceil(n / TILE_BOXES), 1)
    while tiles(parts) < TILES * cores and n // (parts + 1) >= LEAST_TILE:
        parts += 1
    at = lambda s: F.col(f"gi_{s}").cast("double")
    bounds = _ranges(left.select(at("a").alias("at")).unionByName(right.select(at("b").alias("at"))), parts)
    place = lambda s: F.size(F.filter(bounds, lambda c: c <= at(s)))
    # the columns that make up a result, as one: a pair is only made where its tile's list is unfolded
    sides = []
    for number, (s, side) in enumerate((("a", left), ("b", right))):
        first, last = (place(s), F.lit(parts - 1)) if s == "a" else (F.lit(0), place(s))
        others = F.sequence(first, last) if plain else F.sequence(F.lit(0), F.lit(parts - 1))
        rows = side.where(_all([F.col(f"{c}_{s}").isNotNull() for c in BOX])).withColumns({"own": place(s), "other": F.explode(others)})
        row, column = ("own", "other") if s == "a" else ("other", "own")
        tile = F.expr(f"{column} * ({column} + 1) DIV 2 + {row}" if plain else f"{row} * {parts} + {column}").cast("int").alias("tile")
        whole = [] if plain else [(F.struct(*side.columns) if t == s else F.lit(None)).cast(sch.schema.simpleString()).alias(t) for t, sch in (("a", left), ("b", right))]
        sides.append(rows.select(tile, F.lit(number).alias("side"), F.col(f"gi_{s}").alias("gi"), *[F.col(f"{c}_{s}").alias(c) for c in BOX], *whole))
    dealt = sides[0].unionByName(sides[1]).repartitionById(tiles(parts), "tile").drop("tile")
    if plain:
        met = dealt.mapInArrow(_tile_kernel({"a": "gi", "b": "gi"}, True), "b long, a array<long>")
        return met.select(F.explode("a").alias("gi_a"), F.col("b").alias("gi_b")).select(*out)
    met = dealt.mapInArrow(_tile_kernel({"a": "a", "b": "b"}, False), f"b {right.schema.simpleString()}, a array<{left.schema.simpleString()}>")
    pairs = met.select("b.*", F.inline("a"))
    return pairs.where(rule & (F.col("document_a") == F.col("document_b")) if documents else rule).select(*out)


def _join(left: DataFrame, right: DataFrame, rule: Column, method: str, out: list[str], documents: bool, cell: float | None = None, plain: bool = False) -> DataFrame:
    """plain: the rule is that boxes overlap and that the first one's gi is less, and nothing else."""
    if method == "sweep":
        return _sweep_join(left, right, rule, out, documents)
    seen = census(left, right)
    if method != "grid" and seen.b <= BROADCAST_BOXES and seen.a * max(seen.b, 1) <= BROADCAST_PAIRS:
        if documents:
            rule = rule & (F.col("document_a") == F.col("document_b"))
        return left.join(F.broadcast(right), rule).select(*out)
    if method == "theta":
        return _tile_join(left, right, rule, seen, out, documents, plain)
    return _grid_join(left, right, rule, seen, out, documents, cell)


def _is_plain(a: DataFrame, rules: Rules, same: bool) -> bool:
    """Whether _pair_rule is nothing but overlap and order."""
    return same and not rules.exclude_type_pairs and "document" not in a.columns


def theta_join(a: DataFrame, b: DataFrame, gap_m: float, rules: Rules, same: bool) -> DataFrame:
    """The join by its plain condition, the second side broadcast where it is small and else in tiles."""
    return broad_phase(a, b, gap_m, rules, same, "theta")


def grid_join(a: DataFrame, b: DataFrame, gap_m: float, rules: Rules, same: bool, cell: float | None = None) -> DataFrame:
    """The join by cells; `cell` is the side of the finest ones, by default a power of two around the tenth percentile of the boxes' sides."""
    return _join(*_sides(a, b, gap_m, []), _pair_rule(rules, same), "grid", ["gi_a", "gi_b"], "document" in a.columns, cell)


def broad_phase(a: DataFrame, b: DataFrame, gap_m: float = 0.0, rules: Rules | None = None, same: bool | None = None, method: str = "auto") -> DataFrame:
    """Candidate pairs (gi_a, gi_b). One set against itself gives each pair once, the earlier element first, and no self-pairs;
    two sets give every ordered pair. method: auto, grid, theta or sweep."""
    rules = rules or Rules()
    same = same_set(a, b) if same is None else same
    return _join(*_sides(a, b, gap_m, []), _pair_rule(rules, same), method, ["gi_a", "gi_b"], "document" in a.columns, plain=_is_plain(a, rules, same))


#: Columns that rules give an element's document.
RULE_COLUMNS = ["model_a", "model_b", "gap_m", "hard", "soft", "exclude_self", "blocked"]


def with_scopes(ruled: DataFrame) -> DataFrame:
    """Elements (with document and RULE_COLUMNS) with in_a and in_b, the scopes they belong to, and same: whether their document's two scopes are one set,
    that is equally many elements with the same keys."""
    within = lambda c: (F.col(c) == "all") | (F.col("model_id") == F.col(c))
    rows = ruled.withColumns({"in_a": within("model_a"), "in_b": within("model_b")})
    by_key = rows.where("model_a <> model_b").groupBy("document", "model_id", "element_id").agg(*[F.sum(F.col(f"in_{s}").cast("int")).alias(s) for s in "ab"])
    unlike = by_key.groupBy("document").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max((F.col("a") > 0) != (F.col("b") > 0)).alias("odd"))
    unlike = unlike.where((F.col("a") != F.col("b")) | F.col("odd")).select("document", F.lit(False).alias("one"))
    return rows.join(unlike, "document", "left").withColumn("same", F.coalesce("one", F.lit(True))).drop("one")


def document_pairs(ruled: DataFrame, method: str = "auto") -> DataFrame:
    """Candidate pairs of many documents, each under its own rules: gi_a, gi_b, hard and gap (metres; null: no clearance).

    Scopes, gaps, exclusions and modes are columns of one plan, so its size and its jobs don't depend on how many rules there are.
    """
    # read by both sides, the census and the join
    rows = cut(with_scopes(ruled.select(*_side(ruled), *RULE_COLUMNS))).withColumn("gap", F.when(F.col("soft"), F.col("gap_m")))
    left, right = _sides(rows.where("in_a"), rows.where("in_b"), "gap_m", ["same", "exclude_self", "blocked", "hard", "gap"])
    return _join(left, right, _pair_rule_by_columns(), method, ["gi_a", "gi_b", "hard", "gap"], True)
