"""Packs of meshes against candidate pairs that are tested one by one."""

import pytest
from pyspark.sql import functions as F

from meshjoin.operators import narrow, packs
from meshjoin.plans import queries, scenes
from meshjoin.plans.detect import candidates_of, counts_in, found_in
from meshjoin.schema import Rules
from meshjoin.sources.payload import with_boxes

TESTDATA = "/root/testdata/sf0.001"


def _mixed(spark, n=60):
    """Boxes, single triangles and lone vertices at hashed places, one of them very large, with keys and types that repeat and are null."""
    place = lambda k: F.pmod(F.xxhash64("gi", F.lit(k)), F.lit(1000)) / 1000.0
    rows = spark.range(n).select(
        F.col("id").alias("gi"), (F.col("id") % 23).cast("string").alias("element_id"), F.concat(F.lit("m"), F.col("id") % 2).alias("model_id"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("T"), F.col("id") % 3)).alias("ifc_type"), *[place(k).alias(c) for k, c in enumerate(("cx", "cy", "cz"))],
        F.when(F.col("id") == 5, 3.0).otherwise(0.02 + 0.15 * place(3)).alias("h"),
    )
    e = scenes.box_elements(rows)
    e = e.withColumns({"faces": F.when(F.col("gi") % 4 == 1, F.slice("faces", 1, 1)).when(F.col("gi") % 9 == 2, F.slice("faces", 1, 0)).otherwise(F.col("faces")), "verts": F.when((F.col("gi") % 4 != 1) & (F.col("gi") % 9 == 2), F.slice("verts", 1, 1)).otherwise(F.col("verts"))})
    return with_boxes(e.drop(*[c for c in e.columns if c[0] in "vf" and c[-1] in "01"], "n_verts", "n_faces")).cache()


@pytest.mark.parametrize("uniform", [False, True])
def test_packs_equal_pairs(spark, monkeypatch, uniform):
    monkeypatch.setattr(packs, "LEAST", 7)
    monkeypatch.setattr(packs, "PACKS", 1 << 20)
    e = _mixed(spark)
    if uniform:
        e = e.where((F.col("gi") % 4 != 1) & (F.col("gi") % 9 != 2))
    told = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("gi_a", "gi_b", "is_hard", "d", "px", "py", "pz").collect())
    sets = [Rules(), Rules("both", 60.0), Rules("soft", 60.0), Rules("both", 60.0, "m0", "m1"), Rules("hard", 0.0, "all", "m1", True), Rules(exclude_type_pairs=("T1:T0", "T2:T2", "T1")), Rules("soft")]
    for rules in sets:
        for stages in ({}, {"vertex_only": True}, {"exact": True}) if rules.mode == "both" and rules.model_a == "all" else ({},):
            n = 1 if "vertex_only" in stages else 4 if "exact" in stages else 3
            pairs = candidates_of(e, rules, "theta")
            want = told(narrow.tested(pairs, e, rules.hard, rules.gap_m if rules.soft else None, stages=n))
            assert told(found_in(e, rules, **stages)) == want, (rules, stages)
    assert told(found_in(e, Rules("both", 60.0)))  # not all of them empty


def test_pairs_are_not_shuffled(spark):
    """What the tasks of hard_clashes exchange follows the packs; before, each pair went through two exchanges with its meshes."""
    plan = queries.QUERIES["hard_clashes"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    kernel = plan.index("MapInArrow")
    assert "Exchange" not in plan[:kernel] and "a_pack" in plan and "a_faces#" in plan[kernel:]
    assert "BroadcastHashJoin" not in plan  # meshes of a large table aren't collected


def test_large_meshes_go_by_pairs(spark, monkeypatch):
    e = _mixed(spark)
    want = sorted(map(tuple, found_in(e, Rules()).select("gi_a", "gi_b").collect()))
    monkeypatch.setattr(packs, "SMALL_PARTS", 4)
    assert sorted(map(tuple, found_in(e, Rules()).select("gi_a", "gi_b").collect())) == want != []


def test_packs_of_a_long_scene_meet_few_others(spark):
    """A lattice of 4 x 4 x 512 boxes: packs are as short as the scene is narrow; cut along all axes alike, they met some six others each."""
    row = spark.range(8192).select(F.col("id").alias("gi"), F.col("id").cast("string").alias("element_id"), F.lit("m0").alias("model_id"), F.lit("T0").alias("ifc_type"),
        (F.col("id") % 4).cast("double").alias("cx"), F.expr("id DIV 4 % 4").cast("double").alias("cy"), F.expr("id DIV 16").cast("double").alias("cz"), F.lit(0.5).alias("h"))
    ruled = packs.with_rules(scenes.box_elements(row), Rules())
    middle = {f"{x}{e}": f((F.col(f"v{x}0") + F.col(f"v{x}1")) / 2) for x in "xyz" for e, f in (("0", F.min), ("1", F.max))}
    cut_up = packs._packs(ruled, ruled.agg(F.count("*").alias("n"), *[c.alias(n) for n, c in middle.items()]).first())
    assert packs._met(cut_up).count() <= 3 * cut_up.count() > 60


def test_counts_are_taken_in_packs(spark):
    """Numbers of candidates and clashes without a row for each; before, the plan of detect_stats joined cells and counted rows of clashes."""
    e = _mixed(spark, 40)
    for rules in (Rules("both", 60.0), Rules("soft", 60.0, "m0", "m1"), Rules("soft")):
        got = counts_in(e, rules).first()
        assert (got["candidate_pairs"], got["clash_count"]) == (candidates_of(e, rules, "theta").count(), found_in(e, rules).count())
    plan = queries.QUERIES["detect_stats"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert "candidate_pairs" in plan and "is_hard" not in plan and "grid" not in plan
