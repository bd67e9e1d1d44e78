"""Tiles of the theta join against all pairs of a cross join."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meshjoin.operators import broadphase
from meshjoin.plans import queries, scenes
from meshjoin.schema import BOX, Rules

TESTDATA = "/root/testdata/sf0.001"


def _all_pairs(a, b, gap, rules, same, documents=False):
    left, right = broadphase._sides(a, b, gap, [])
    rule = broadphase._pair_rule(rules, same) & (F.col("document_a") == F.col("document_b") if documents else F.lit(True))
    return sorted(map(tuple, left.crossJoin(right).where(rule).select("gi_a", "gi_b").collect()))


def _small_tiles(monkeypatch):
    for name, value in (("BROADCAST_BOXES", 0), ("LEAST_TILE", 40), ("TILES", 5)):
        monkeypatch.setattr(broadphase, name, value)


def test_tiles_give_each_pair_once(spark, monkeypatch):
    """Several sets of rules; some boxes lie elsewhere by size, some elements have no box, sides differ in number."""
    _small_tiles(monkeypatch)
    e = broadphase.thin(scenes.elements(spark, TESTDATA)).where("gi < 300")
    e = e.withColumns({c: F.when(F.col("gi") % 29 == 3, None).when(F.col("gi") % 50 == 7, F.col(c) + (9.0 if c.endswith("1") else -9.0)).otherwise(F.col(c)) for c in BOX})
    e = e.withColumn("ifc_type", F.when(F.col("gi") % 11 > 0, F.col("ifc_type"))).cache()
    m0, some = e.where("model_id = 'm0'"), e.where("gi % 7 = 1")
    cases = [(e, e, 0.0, Rules(), True), (e, e, 0.1, Rules(), True), (e, e, 0.1, Rules(), False), (some, m0, 0.1, Rules(exclude_self=True), False), (m0, e, 0.0, Rules(exclude_type_pairs=("T1:T0", "T2:T2")), True)]
    for a, b, gap, rules, same in cases:
        want = _all_pairs(a, b, gap, rules, same)
        assert sorted(map(tuple, broadphase.theta_join(a, b, gap, rules, same).collect())) == want != []
    d = e.withColumn("document", F.col("gi") % 3).cache()
    for same in (True, False):
        assert sorted(map(tuple, broadphase.theta_join(d, d, 0.1, Rules(), same).collect())) == _all_pairs(d, d, 0.1, Rules(), same, True) != []
    nothing = e.where("gi < 0")
    assert broadphase.theta_join(e, e.where("vx0 IS NULL"), 0.0, Rules(), True).count() == broadphase.theta_join(nothing, nothing, 0.0, Rules(), True).count() == 0


def test_many_boxes_are_not_broadcast(spark, monkeypatch):
    """Before, broad_theta broadcast the second side whole at any size, and each pair of boxes was a row of the plain join."""
    want = sorted(map(tuple, queries.QUERIES["broad_theta"](spark, TESTDATA).collect()))
    _small_tiles(monkeypatch)
    found = queries.QUERIES["broad_theta"](spark, TESTDATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and "MapInArrow" in plan
    assert sorted(map(tuple, found.collect())) == want != []


def test_tile_kernel_in_runs_and_steps(monkeypatch):
    """Boxes of several sizes, runs and steps that don't come out even, lists that are empty."""
    draw = np.random.default_rng(9)
    monkeypatch.setattr(broadphase, "RUN", 5)
    monkeypatch.setattr(broadphase, "HELD", 7)

    def side(number, n, first):
        half = draw.choice([0.05, 0.3, 3.0], n, p=[0.6, 0.35, 0.05])
        at = {x: draw.uniform(-3, 3, n) for x in "xyz"}
        ends = {f"v{x}{e}": at[x] + (half if e == "1" else -half) for x in "xyz" for e in "01"}
        return {"side": np.full(n, number, np.int32), "gi": np.arange(first, first + n), **ends}

    for first, ordered in ((0, True), (0, False), (60, True)):
        a, b = side(0, 53, 0), side(1, 64, first)
        batches = [pa.RecordBatch.from_pydict(r).slice(k, 20) for r in (a, b) for k in range(0, 64, 20)]
        got = [(i, j) for out in broadphase._tile_kernel({"a": "gi", "b": "gi"}, ordered)(iter(batches)) for j, found in zip(*(c.to_pylist() for c in out.columns)) for i in found]
        meet = np.all([(a[f"v{x}0"][:, None] <= b[f"v{x}1"]) & (b[f"v{x}0"] <= a[f"v{x}1"][:, None]) for x in "xyz"], axis=0)
        if ordered:
            meet &= a["gi"][:, None] < b["gi"]
        assert sorted(got) == [(i, j + first) for i, j in np.argwhere(meet).tolist()] != []
    assert not list(broadphase._tile_kernel({"a": "gi", "b": "gi"}, True)(iter([]))) and not list(broadphase._tile_kernel({"a": "gi", "b": "gi"}, True)(iter(batches[:3])))


def test_rules_as_columns_go_through_tiles(spark, monkeypatch):
    """Whole rows, with arrays among their columns, come out of the tiles as they went in."""
    d = F.col("gi") % 3
    rules = {"model_a": F.lit("all"), "model_b": F.when(d == 0, "m1").otherwise("all"), "gap_m": d / 10.0, "hard": d < 2, "soft": d > 0, "exclude_self": d == 0, "blocked": F.when(d == 1, F.array(F.lit("T0:T1"))).otherwise(F.array().cast("array<string>"))}
    ruled = broadphase.thin(scenes.elements(spark, TESTDATA)).where("gi < 200").withColumns({"document": d.cast("string"), **rules}).cache()
    told = lambda method: sorted(map(str, broadphase.document_pairs(ruled, method).collect()))
    want = told("grid")
    _small_tiles(monkeypatch)
    assert told("theta") == want != []
