"""Strips of the sweep, and blocked types without a text for each pair."""

from meshjoin.operators import broadphase
from meshjoin.plans import scenes
from meshjoin.schema import Rules

TESTDATA = "/root/testdata/sf0.001"


def test_strips_change_no_pair_and_pairs_meet_on_all_axes(spark, monkeypatch):
    """In several ranges and strips the pairs are those of the plain join; what leaves the kernel meets on all axes (before: on one)."""
    e = broadphase.thin(scenes.elements(spark, TESTDATA)).cache()
    want = sorted(map(tuple, broadphase.theta_join(e, e, 0.01, Rules(), False).collect()))
    told = []
    cut = broadphase._sweep_kernel
    assert broadphase.STRIP_BOXES < broadphase.RANGE_BOXES and want
    for ranges, strips in ((1 << 14, 40), (100, 30), (1 << 14, 1 << 11)):
        monkeypatch.setattr(broadphase, "RANGE_BOXES", ranges)
        monkeypatch.setattr(broadphase, "STRIP_BOXES", strips)
        got = sorted(map(tuple, broadphase.broad_phase(e, e, 0.01, Rules(), False, "sweep").collect()))
        assert got == want
        told.append(got)
    import numpy as np
    import pyarrow as pa

    apart = {"slab": [0, 0], "strip": [0, 0], "side": [0, 1], "row": [1, 2], "low": [0.0, 0.5], "high": [1.0, 1.5], "slab_low": [-np.inf] * 2, "strip_low": [-np.inf] * 2, "low_1": [0.0, 5.0], "high_1": [1.0, 6.0], "low_2": [0.0, 0.0], "high_2": [1.0, 1.0]}
    assert sum(b.num_rows for b in cut([pa.RecordBatch.from_pydict(apart)])) == 0


def test_blocked_types_as_comparisons(spark):
    types = [None, "A", "B", "A:B", "B:C", "C", ""]
    rows = spark.createDataFrame([(x, y) for x in types for y in types], "ifc_type_a string, ifc_type_b string")
    for texts in (["A:B"], ["B:A", "A"], ["A:B:C", "A:A"], ["", ":", ":A"], ["C:A:B", "B:C:A:B"]):
        texts = broadphase.blocked_types(texts)
        blocked = broadphase._blocked(texts)
        assert rows.where(blocked != broadphase._type_key().isin(texts)).count() == 0
    # before, a text was made for each pair
    assert "array_sort" not in rows.where("ifc_type_a IS NOT NULL AND ifc_type_b IS NOT NULL").where(broadphase._blocked(["A:B"]))._jdf.queryExecution().analyzed().toString().split("ELSE")[-1]
