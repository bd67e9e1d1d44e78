import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshjoin.functions.kernels import closest_between_segments, closest_on_triangle, tri_tri
from meshjoin.operators import broadphase, narrow
from meshjoin.plans.detect import CAPABILITIES, candidates_of, capabilities, clashes_of, detect, detect_documents, percent, status
from meshjoin.plans.scenes import FACES
from meshjoin.schema import PAYLOAD, Rules
from meshjoin.sources.payload import explode_elements, parse_elements, payload_frame, quarantine, read_payload, wire_frame
from meshjoin.streaming import increments


def box(i, centre, half, model="m", kind="T"):
    v = [c + (half if k >> b & 1 else -half) for k in range(8) for b, c in enumerate(centre)]
    return {"id": i, "modelId": model, "ifcType": kind, "vertices": v, "indices": [j for f in FACES for j in f]}


def found(spark, elements, **rules):
    d = detect(spark, {"elements": elements, "rules": rules})
    r = d.response()
    d.unpersist()
    return r


def rows(r):
    return sorted((c["elementA"], c["elementB"], c["type"], c["distance"]) for c in r["clashes"])


# triangle kernels


def tri(*corners):
    return np.array([corners], float)


FLAT = tri((0, 0, 0), (2, 0, 0), (0, 2, 0))


@pytest.mark.parametrize(
    "other, hit",
    [
        (tri((0.5, 0.5, -1), (0.5, 0.5, 1), (1, 0.5, 1)), True),
        (tri((10, 10, 10), (11, 10, 10), (10, 11, 10)), False),
        (tri((5, 5, 0), (6, 5, 0), (5, 6, 0)), False),
        (tri((0.2, 0.2, 0), (1, 0.2, 0), (0.2, 1, 0)), False),
        (tri((0, 0, 1e-9), (2, 0, 1e-9), (0, 2, 1e-9)), False),
        (tri((0, 0, -1), (0.5, 0.5, 0), (1, 1, 1)), False),
        (tri((0.5, 0.5, 0), (0.5, 0.5, 1), (1, 1, 1)), True),
    ],
    ids=["crossing", "far", "coplanar apart", "coplanar overlapping", "nearly coplanar", "degenerate", "touching corner"],
)
def test_tri_tri(other, hit):
    assert tri_tri(FLAT, other)[0][0] == hit
    if hit:
        assert np.isfinite(tri_tri(FLAT, other)[1]).all()


def test_tri_tri_agrees_with_segments_through_triangles():
    """Random pairs away from touching: two triangles meet if and only if an edge of one goes through the other."""
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=(2, 4000, 3, 3))

    def pierced(t, s):
        out = np.zeros(len(t), bool)
        n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
        for k in range(3):
            p, q = s[:, k], s[:, (k + 1) % 3]
            dp, dq = ((n * (p - t[:, 0])).sum(1)), ((n * (q - t[:, 0])).sum(1))
            x = p + (q - p) * (dp / (dp - dq))[:, None]
            inside = np.ones(len(t), bool)
            for j in range(3):
                inside &= (np.cross(t[:, (j + 1) % 3] - t[:, j], x - t[:, j]) * n).sum(1) >= 0
            out |= (dp * dq < 0) & inside
        return out

    want = pierced(a, b) | pierced(b, a)
    assert 500 < want.sum() < 3500
    assert (tri_tri(a, b)[0] == want).all()
    assert (tri_tri(b, a)[0] == want).all()


def test_closest_point_is_the_best_of_many():
    draw = np.random.default_rng(4)
    p, t = draw.normal(size=(300, 3)), draw.normal(size=(300, 3, 3))
    q, d = closest_on_triangle(p, t)
    w = draw.dirichlet((0.4, 0.4, 0.4), size=4000)
    best = np.linalg.norm(np.einsum("sk,nkx->nsx", w, t) - p[:, None], axis=2).min(1)
    assert (d <= best + 1e-9).all() and (best - d < 0.2).all()
    assert np.allclose(np.linalg.norm(q - p, axis=1), d)


# detection


def test_overlapping_boxes(spark):
    r = found(spark, [box(1, (0, 0, 0), 1), box(2, (0.5, 0, 0), 1)])
    assert rows(r) == [("1", "2", "hard", -1500)]
    assert r["stats"]["candidatePairs"] == 1 and r["stats"]["elementCount"] == 2 and r["stats"]["clashCount"] == 1
    c = r["clashes"][0]
    assert c["volume"] is None and c["depth_semantics"] and len(c["point"]) == 3 and len(c["id"]) == 8


def test_depth_flush_contained_and_separate(spark):
    assert rows(found(spark, [box(1, (0, 0, 0), 1), box(2, (1.5, 0, 0), 1)])) == [("1", "2", "hard", -500)]
    assert rows(found(spark, [box(1, (0, 0, 0), 1), box(2, (0, 0, 1.5), 0.5)])) == [("1", "2", "hard", 0)]
    inside = found(spark, [box(1, (0, 0, 0), 1), box(2, (0, 0, 0), 0.25)])
    assert rows(inside) == [] and inside["stats"]["candidatePairs"] == 1
    assert rows(found(spark, [box(1, (0, 0, 0), 0.5), box(2, (5, 5, 5), 0.5)])) == []


def test_empty_payload_and_phases(spark):
    said = []
    r = detect(spark, {"elements": [], "rules": {}}, on_phase=said.append).response()
    assert r["clashes"] == [] and r["stats"]["elementCount"] == 0 and said == []
    detect(spark, {"elements": [box(1, (0, 0, 0), 1), box(2, (0.5, 0, 0), 1)]}, on_phase=said.append).response()
    assert said == ["Building BVH", "Narrow phase", "Finalising"]


def test_modes(spark):
    three = [box(1, (0, 0, 0), 1), box(2, (0.5, 0, 0), 1), box(3, (2.55, 0, 0), 1)]
    assert rows(found(spark, three, mode="both", maxGap=100)) == [("1", "2", "hard", -1500), ("2", "3", "clearance", 50)]
    assert rows(found(spark, three, mode="soft", maxGap=0)) == []
    soft = found(spark, three[:2], mode="soft", maxGap=2000)
    assert rows(soft) == [("1", "2", "clearance", 0)] and "depth_semantics" not in soft["clashes"][0] and soft["clashes"][0]["volume"] == 0
    assert rows(found(spark, three, mode="unheard of")) == [("1", "2", "hard", -1500)]


def test_scopes(spark):
    e = [box(1, (0, 0, 0), 1, "m1"), box(2, (0.5, 0, 0), 1, "m1"), box(3, (50, 0, 0), 1, "m2")]
    pairs = lambda elements, **r: sorted(map(tuple, candidates_of(parse_elements(wire_frame(spark, elements)), Rules.of(r)).collect()))
    assert pairs(e, modelB="m1") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert pairs(e, modelB="m1", excludeSelf=True) == [(0, 1), (1, 0)]
    assert pairs(e[:2], modelB="m1") == [(0, 1)]
    assert pairs(e, modelA="m1", modelB="m2") == []


def test_excluded_types(spark):
    for order in (("IfcWall", "IfcDuct"), ("IfcDuct", "IfcWall")):
        e = [box(1, (0, 0, 0), 1, kind=order[0]), box(2, (0.5, 0, 0), 1, kind=order[1])]
        assert rows(found(spark, e, excludeTypePairs=["IfcWall:IfcDuct"])) == []
    assert broadphase.blocked_types(["a:b", "b:a", "d:c", "x"]) == ["a:b", "c:d", "x"]


def test_faulty_elements(spark):
    short = {"id": "s", "vertices": [0, 0, 0, 1, 0, 0], "indices": [0, 1, 0]}
    ragged = {"id": "r", "vertices": [0] * 7, "indices": [0, 1, 0]}
    outside = {"id": "o", "vertices": [0] * 9, "indices": [0, 1, 9]}
    good = box("g", (0, 0, 0), 1)
    bare = {"id": "n"}
    wire = wire_frame(spark, [short, ragged, outside, good, bare])
    assert [r.element_id for r in parse_elements(wire, strict=False).collect()] == ["g"]
    assert {r.id: r.fault for r in quarantine(wire).collect()}.keys() == {"r", "o"}
    with pytest.raises(Exception, match="multiple of 3|out of range"):
        parse_elements(wire).collect()


def test_both_boxes(spark):
    b = box(1, (0, 0, 0), 1)
    b["vertices"] = [*b["vertices"], 9.0, 9.0, 9.0]
    r = parse_elements(wire_frame(spark, [b])).first()
    assert (r.vx1, r.fx1) == (9.0, 1.0) and r.discipline == "other" and r.model_id == "m"


def test_grid_equals_theta(spark):
    draw = np.random.default_rng(5)
    e = [box(i, tuple(draw.uniform(-3, 3, 3)), float(draw.choice([0.05, 0.3, 4.0], p=[0.6, 0.35, 0.05]))) for i in range(150)]
    a = parse_elements(wire_frame(spark, e)).cache()
    for gap in (0.0, 0.2):
        want = sorted(map(tuple, broadphase.theta_join(a, a, gap, Rules(), True).collect()))
        for cell in (None, 0.07, 1.3):
            got = sorted(map(tuple, broadphase.grid_join(a, a, gap, Rules(), True, cell).collect()))
            assert got == want and len(set(got)) == len(got)
    want = sorted(map(tuple, broadphase.theta_join(a, a, 0.1, Rules(), False).collect()))
    assert sorted(map(tuple, broadphase.grid_join(a, a, 0.1, Rules(), False).collect())) == want


def test_sweep_equals_theta(spark, monkeypatch):
    """Flat boxes, long ones among them, in one range and in many; small batches carry the boxes that are still open."""
    draw = np.random.default_rng(15)
    e = [box(i, tuple(draw.uniform(-3, 3, 3)), float(draw.choice([0.05, 0.3, 4.0], p=[0.6, 0.35, 0.05]))) for i in range(120)]
    for b in e[::2]:
        b["vertices"][2::3] = [0.0] * 8
    e += [dict(b, id=f"again {b['id']}") for b in e[:10]]
    a = parse_elements(wire_frame(spark, e)).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for ranges in (1 << 14, 20):
            monkeypatch.setattr(broadphase, "RANGE_BOXES", ranges)
            for gap, rules, same in ((0.0, Rules(), True), (0.2, Rules(), False), (0.1, Rules(exclude_self=True), False)):
                want = sorted(map(tuple, broadphase.theta_join(a, a, gap, rules, same).collect()))
                got = sorted(map(tuple, broadphase.broad_phase(a, a, gap, rules, same, "sweep").collect()))
                assert got == want and len(set(got)) == len(got)
        none = a.where("gi < 0")
        assert broadphase.broad_phase(none, none, 0.0, Rules(), True, "sweep").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_swapping_sides_keeps_hits_and_distances(spark):
    e = [box(1, (0, 0, 0), 1), box(2, (1.2, 0.3, 0.1), 1), box(3, (3.3, 0, 0), 1)]
    back = [e[2], e[1], e[0]]
    sorted_pairs = lambda r: sorted((*sorted(x[:2]), *x[2:]) for x in rows(r))
    assert sorted_pairs(found(spark, e, mode="both", maxGap=200)) == sorted_pairs(found(spark, back, mode="both", maxGap=200))


def test_json_files_and_capabilities(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"elements": [box(7, (0, 0, 0), 1), box("a", (0.5, 0, 0), 1)], "rules": {"mode": "hard"}}))
    p = read_payload(spark, str(tmp_path / "p.json"))
    assert p.columns[0] == "document" and p.select(*PAYLOAD.names).schema == PAYLOAD and parse_elements(explode_elements(p)).count() == 2
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed|failfast|json"):
        read_payload(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception, match="(?i)malformed|failfast|json"):
        payload_frame(spark, "{").collect()
    assert capabilities(spark).first().rules.asDict() == CAPABILITIES["rules"]


def test_stream_increments(spark, tmp_path):
    e = [box(i, (0.5 * i, 0, 0), 0.4) for i in range(6)]
    want = rows(found(spark, e))
    wire = wire_frame(spark, e)
    src = str(tmp_path / "src")
    wire.where("gi < 3").coalesce(1).write.mode("append").parquet(src)
    args = [str(tmp_path / n) for n in ("elements", "clashes", "checkpoint")]
    for part in ("gi < 3", "gi >= 3"):
        if part == "gi >= 3":
            wire.where(part).coalesce(1).write.mode("append").parquet(src)
        q = increments.start(spark, spark.readStream.schema(wire.schema).parquet(src), *args, Rules())
        q.awaitTermination(120)
    got = spark.read.parquet(args[1])
    assert sorted(map(tuple, got.select("elementA", "elementB", "type", F.col("distance")).collect())) == want


def test_store_by_place_reads_only_near_folders(spark, tmp_path):
    """Two new elements far apart: of a store along the way between them only the folders near them are read."""
    e = [box(i, (100.0 * i, 0, 0), 0.4) for i in range(40)] + [box("wide", (2000, 0, 0), 300.0)]
    stored = increments.with_place(parse_elements(wire_frame(spark, e)))
    stored.write.partitionBy("place").parquet(str(tmp_path / "store"))
    known = spark.read.parquet(str(tmp_path / "store"))
    new = parse_elements(wire_frame(spark, [box("p", (0.3, 0, 0), 0.4), box("q", (3900.3, 0, 0), 0.4)]))
    near = increments.near_known(new, known, 0.05)
    # the one before the last lies in the next place
    assert sorted(r.element_id for r in near.collect()) == ["0", "38", "39"]
    files = near.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 3 and "PartitionFilters: [(place" in near._jdf.queryExecution().toString()
    beside = parse_elements(wire_frame(spark, [box("r", (2301.0, 0, 0), 1.5)]))
    assert {r.element_id for r in increments.near_known(beside, known, 0.05).collect()} == {"23", "wide"}


def test_stream_replaces_changed_elements(spark, tmp_path):
    """An element that comes again, moved, is matched at its new place only, and its older clashes are no longer current."""
    first = [box("a", (0, 0, 0), 0.5), box("b", (0.8, 0, 0), 0.5), box("c", (200, 0, 0), 0.5)]
    second = [box("b", (200.8, 0, 0), 0.5), box("d", (0.8, 0, 0), 0.4)]
    args = [str(tmp_path / n) for n in ("elements", "clashes", "checkpoint")]
    src = str(tmp_path / "src")
    for k, part in enumerate((first, second)):
        wire = wire_frame(spark, part).withColumn("gi", F.col("gi") + 10 * k)
        wire.coalesce(1).write.mode("append").parquet(src)
        increments.start(spark, spark.readStream.schema(wire.schema).parquet(src), *args, Rules()).awaitTermination(120)
    clashes = spark.read.parquet(args[1])
    pairs = lambda df: sorted(tuple(sorted((r.elementA, r.elementB))) for r in df.collect())
    assert pairs(clashes) == [("a", "b"), ("a", "d"), ("b", "c")]
    assert pairs(increments.current_clashes(clashes, spark.read.parquet(args[0] + "-keys"))) == [("a", "d"), ("b", "c")]


def test_soft_mode_without_candidates(spark):
    a = parse_elements(wire_frame(spark, [box(1, (0, 0, 0), 1)]))
    assert clashes_of(candidates_of(a, Rules(mode="soft", max_gap=5)), a, Rules(mode="soft", max_gap=5)).count() == 0


# several payloads


def test_payload_files_each_with_own_rules(spark, tmp_path):
    """Elements of different files don't meet, though their places, ids and coordinates are alike."""
    pair = [box("p", (0, 0, 0), 1), box("q", (0.5, 0, 0), 1)]
    near = [box("p", (0, 0, 0), 1), box("q", (2.01, 0, 0), 1)]
    for name, payload in (("a", {"elements": pair}), ("b", {"elements": near, "rules": {"mode": "soft", "maxGap": 20}}), ("c", {"elements": near, "rules": {"mode": "hard"}}), ("d", {"elements": []})):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
    payloads = read_payload(spark, str(tmp_path))
    elements = parse_elements(explode_elements(payloads))
    assert sorted(r.gi for r in elements.collect()) == sorted(k * (1 << 31) + i for k in range(3) for i in range(2))
    got = sorted((r.document[-6:], r.elementA, r.elementB, r.type, r.distance) for r in detect_documents(payloads).collect())
    assert got == [("a.json", "p", "q", "hard", -1500), ("b.json", "p", "q", "clearance", 10)]
    with pytest.raises(ValueError, match="several payloads"):
        from meshjoin.sources.payload import payload_rules

        payload_rules(payloads)


def test_documents_decide_on_their_own_whether_scopes_are_one_set(spark, tmp_path):
    """All against m1: one set in a document that holds m1 only, two sets, with ordered and self-pairs, in the other one."""
    m1 = [box("p", (0, 0, 0), 1, "m1"), box("q", (0.5, 0, 0), 1, "m1")]
    rules = {"modelB": "m1"}
    (tmp_path / "a.json").write_text(json.dumps({"elements": m1, "rules": rules}))
    (tmp_path / "b.json").write_text(json.dumps({"elements": [*m1, box("far", (50, 0, 0), 1, "m2")], "rules": rules}))
    for method in ("theta", "grid"):
        got = sorted((r.document[-6], r.elementA, r.elementB) for r in detect_documents(read_payload(spark, str(tmp_path)), method=method).collect())
        assert got == [("a", "p", "q"), ("b", "p", "p"), ("b", "p", "q"), ("b", "q", "p"), ("b", "q", "q")]


def test_documents_without_rows(spark):
    none = spark.createDataFrame([], "document string, json string")
    from meshjoin.sources.payload import payload_texts

    got = detect_documents(payload_texts(none))
    assert got.count() == 0 and got.columns[0:2] == ["id", "document"]


# events


def test_progress_and_completion(spark):
    phases, steps, ended = [], [], []
    boxes = [box(i, (0.9 * i, 0, 0), 0.5) for i in range(40)]
    d = detect(spark, {"elements": boxes, "rules": {}}, on_progress=lambda k, n: steps.append((k, n)), on_phase=phases.append, on_complete=ended.append)
    stats = d.stats
    d.unpersist()
    assert phases == ["Building BVH", "Narrow phase", "Finalising"] and ended == [stats]
    assert steps[-1] == (39, 39) and steps == sorted(set(steps)) and all(0 < k <= 39 for k, _ in steps)
    assert [percent(k, n) for k, n in ((0, 0), (1, 3), (39, 39))] == [0, 33, 100]
    record = status(spark)
    assert record["status"] == "ready" and record["cores"] >= 1 and record["protocolVersion"] == CAPABILITIES["protocolVersion"] and record["capabilities"]["rules"] == CAPABILITIES["rules"]


# large meshes


def ball(i, centre, rings, radius=1.0):
    """A sphere of 2 * rings * (rings - 1) triangles or so."""
    lat, lon = np.meshgrid(np.linspace(0.02, np.pi - 0.02, rings), np.linspace(0, 2 * np.pi, rings, endpoint=False), indexing="ij")
    v = np.stack((np.sin(lat) * np.cos(lon), np.sin(lat) * np.sin(lon), np.cos(lat)), axis=-1).reshape(-1, 3) * radius + centre
    at = lambda r, c: r * rings + c % rings
    f = [x for r in range(rings - 1) for c in range(rings) for x in (at(r, c), at(r + 1, c), at(r, c + 1), at(r, c + 1), at(r + 1, c), at(r + 1, c + 1))]
    return {"id": i, "modelId": "m", "ifcType": "T", "vertices": v.reshape(-1).tolist(), "indices": f}


def test_blocks_change_no_result(spark, monkeypatch):
    """Spheres that cross and that come close, and boxes among them, by blocks and whole."""
    scene = [ball("a", (0, 0, 0), 24), ball("b", (1.7, 0.1, 0), 24), ball("c", (0.1, 2.03, 0), 20), box("d", (0, 0, 1.2), 0.3), box("e", (3.03, 0, 0), 0.3)]
    elements = parse_elements(wire_frame(spark, scene)).cache()
    rules = Rules(mode="both", max_gap=50.0)
    candidates = candidates_of(elements, rules).cache()
    got = {}
    for most in (10**9, 64):
        monkeypatch.setattr(narrow, "SMALL_PARTS", most)
        for exact in (False, True):
            rows = clashes_of(candidates, elements, rules, exact=exact).collect()
            got[most, exact] = sorted((r.gi_a, r.gi_b, r.type, r.distance, tuple(round(x, 6) for x in r.point)) for r in rows)
        near = narrow.clearances(candidates, elements, rules.gap_m, vertex_only=True)
        got[most, "vertices"] = sorted((r.gi_a, r.gi_b, r.d) for r in near.collect())
        quick = clashes_of(candidates, elements, rules, with_point=False).collect()
        assert sorted((r.gi_a, r.gi_b, r.type, r.distance) for r in quick) == [r[:4] for r in got[most, False]]
    for kind in (False, True, "vertices"):
        assert got[64, kind] == got[10**9, kind]
    assert {(a, b) for a, b, *_ in got[64, False]} >= {(0, 1), (0, 2), (0, 3), (1, 4)} and {t for _, _, t, *_ in got[64, False]} == {"hard", "clearance"}


def brute_hits(elements, a, b):
    """All pairs of triangles of two elements through the kernel."""
    rows = {r.gi: r for r in elements.collect()}
    corners = lambda r: np.array([[tuple(r.verts[i]) for i in f] for f in r.faces])
    ta, tb = corners(rows[a]), corners(rows[b])
    out = set()
    for i in range(len(ta)):
        hit = tri_tri(np.repeat(ta[i : i + 1], len(tb), axis=0), tb)[0]
        out |= {(i, int(j)) for j in np.flatnonzero(hit)}
    return out


def test_first_hits_and_all_hits(spark):
    """All hits by blocks equal those of every pair of triangles; the first 24 are the first by their numbers."""
    elements = parse_elements(wire_frame(spark, [ball("a", (0, 0, 0), 16), ball("b", (0.9, 0.2, 0), 16)])).cache()
    candidates = candidates_of(elements, Rules())
    want = brute_hits(elements, 0, 1)
    found = narrow.triangle_hits(candidates, elements).collect()
    assert {(r.tri_a, r.tri_b) for r in found} == want and len(found) == len(want) > 24
    first = sorted((r.tri_a, r.tri_b, r.px, r.py, r.pz) for r in found)[:24]
    point = narrow.hard_clashes(candidates, elements).first().point
    assert np.allclose(point, np.mean([r[2:] for r in first], axis=0))
    assert narrow.triangle_hits(candidates, elements, 1).count() >= 1


def test_large_meshes_meet_in_bounded_numbers(spark):
    """Two meshes of 20,000 triangles: triangles of blocks that meet are a small share of the 4e8 pairs."""
    elements = parse_elements(wire_frame(spark, [ball("a", (0, 0, 0), 100), ball("b", (0.6, 0, 0), 100)])).cache()
    candidates = candidates_of(elements, Rules())
    assert [r.n_faces for r in elements.collect()] == [19_800] * 2
    pairs = narrow.with_boxes_of(candidates, elements).withColumn("reach", F.lit(0.0))
    met = narrow.block_pairs(pairs, narrow.with_powers(narrow.mesh_blocks(elements)), ("a", "triangles"), ("b", "triangles"), [])
    joined, made = met.agg(F.count("*"), F.sum(F.size("a_ids") * F.size("b_ids"))).first()
    assert joined < 10_000 and made < 5_000_000
    found = narrow.hard_clashes(candidates, elements).collect()
    assert len(found) == 1 and abs(found[0].depth - 1.4) < 0.01
    assert narrow.triangle_hits(candidates, elements).count() > 100


def test_uneven_triangles_write_few_rows(spark):
    """A slab of twelve long triangles against a sphere of 100,000: blocks write at most eight rows a level, and few pairs of blocks meet."""
    slab = box("slab", (0, 0, 0), 1.0)
    slab["vertices"] = [c * s for c, s in zip(slab["vertices"], [40.0, 0.01, 0.5] * 8)]
    elements = parse_elements(wire_frame(spark, [slab, ball("ball", (0, 0, 0), 224)])).cache()
    blocks = narrow.with_powers(narrow.mesh_blocks(elements)).cache()
    counted = {(r.gi, r.kind): r for r in blocks.groupBy("gi", "kind").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("parts")).collect()}
    assert counted[0, 1].parts == 12 and counted[1, 1].parts == 2 * 224 * 223 and counted[1, 1].n < 1.2 * counted[1, 1].parts / 32 + 40
    assert {tuple(sorted(r.ids)) for r in blocks.where("kind = 1 and gi = 0").collect()}  # every part is in one block
    assert blocks.where("kind = 1 and gi = 1").select(F.explode("ids").alias("i")).distinct().count() == counted[1, 1].parts
    candidates = candidates_of(elements, Rules())
    pairs = narrow.with_boxes_of(candidates, elements).withColumn("reach", F.lit(0.0))
    met = narrow.block_pairs(pairs, blocks, ("a", "triangles"), ("b", "triangles"), [])
    assert 0 < met.count() <= counted[0, 1].n * counted[1, 1].n
    level = F.ceil(F.log2(F.greatest(*[F.col(f"{x}1") - F.col(f"{x}0") for x in "xyz"])))
    cells = lambda x, k: F.floor(F.col(f"{x}1") / F.pow(F.lit(2.0), k)) - F.floor(F.col(f"{x}0") / F.pow(F.lit(2.0), k)) + 1
    assert blocks.where("kind = 1").select((cells("x", level) * cells("y", level) * cells("z", level)).alias("rows")).agg(F.max("rows")).first()[0] <= 8
    hard = narrow.hard_clashes(candidates, elements, with_point=False).collect()
    assert len(hard) == 1 and abs(hard[0].depth - 0.02) < 1e-6


# exact distances


def test_segments_against_sampling():
    draw = np.random.default_rng(6)
    s, t = draw.normal(size=(2, 400, 2, 3))
    s[:20, 1] = s[:20, 0]  # points
    t[10:30, 1] = t[10:30, 0] + (s[10:30, 1] - s[10:30, 0]) * 2  # parallel ones
    p, q, d = closest_between_segments(s, t)
    w = np.linspace(0, 1, 201)
    on = lambda g: g[:, 0, None] + w[None, :, None] * (g[:, 1] - g[:, 0])[:, None]
    best = np.array([np.linalg.norm(x[:, None] - y[None], axis=2).min() for x, y in zip(on(s), on(t))])
    assert (d <= best + 1e-9).all() and (best - d < 0.05).all() and np.allclose(np.linalg.norm(p - q, axis=1), d)


def test_crossing_bars_have_their_true_distance(spark):
    """Two long bars that cross at a distance: their corners are far apart, their edges aren't."""
    bars = []
    for i, (axis, z) in enumerate(((0, 0.0), (1, 0.0))):
        b = box(i, (0, 0, 0), 1.0)
        v = np.array(b["vertices"]).reshape(-1, 3)
        v[:, axis] *= 10
        v[:, 1 - axis] *= 0.05
        v[:, 2] = v[:, 2] * 0.05
        if i:  # a quarter turn about its own axis, so that an edge points at the other bar, which is turned likewise
            v[:, 2] += 0.3
        turn = np.pi / 4
        y, zc = 1 - axis, v[:, 2].mean()
        c, s_ = v[:, y].copy(), v[:, 2] - zc
        v[:, y], v[:, 2] = c * np.cos(turn) - s_ * np.sin(turn), zc + c * np.sin(turn) + s_ * np.cos(turn)
        b["vertices"] = v.reshape(-1).tolist()
        bars.append(b)
    elements = parse_elements(wire_frame(spark, bars)).cache()
    rules = Rules(mode="both", max_gap=1000.0)
    candidates = candidates_of(elements, rules)
    true = 0.3 - 2 * 0.05 * np.sqrt(2)
    exact = narrow.clearances(candidates, elements, rules.gap_m, exact=True).first()
    assert abs(exact.d - true) < 1e-6 and np.allclose(exact.point, (0, 0, 0.15), atol=1e-6)
    assert narrow.clearances(candidates, elements, rules.gap_m).count() == 0 or narrow.clearances(candidates, elements, rules.gap_m).first().d > true + 0.01


def test_stored_meshes_are_not_shuffled(spark, tmp_path):
    """With elements in buckets only pairs, and rows of the first join, go through an exchange."""
    from meshjoin.sources.store import store

    draw = np.random.default_rng(8)
    e = parse_elements(wire_frame(spark, [box(i, tuple(draw.uniform(0, 4, 3)), 0.3) for i in range(60)])).cache()
    candidates = candidates_of(e, Rules())
    want = sorted(map(tuple, narrow.tested(candidates, e, True, 0.1).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stored LOCATION '{tmp_path / 'stored'}'")
    try:
        stored = store(e, "stored.elements", 4)
        found = narrow.tested(candidates, stored, True, 0.1, buckets=4)
        assert sorted(map(tuple, found.collect())) == want and want
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # the exchanges: pairs to the buckets of gi_a, rows of the first join to those of gi_b
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert plan.count("Bucketed: true") == 2 and [x.split("hashpartitioning(")[1].split("#")[0] for x in exchanges] == ["gi_b", "gi_a"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE stored CASCADE")


# rules as data


def test_many_rule_sets_in_one_plan(spark):
    """Five hundred payloads of five hundred different rules: the jobs are as many as for two, and each document's clashes are its own rules'."""
    from meshjoin.sources.payload import payload_texts

    near = lambda d: [box("p", (0, 0, 0), 1, "m0", "A"), box("q", (2.0 + d, 0, 0), 1, "m1", "B"), box("r", (0.5, 0, 0), 1, "m1", "A")]

    def payload(k):
        rules = {"mode": ("hard", "soft", "both")[k % 3], "maxGap": 10 + k, "excludeTypePairs": [["A:B"], [], ["B:B", f"x{k}"]][k % 3]}
        if k % 4 == 1:
            rules |= {"modelA": "m0", "modelB": "m1", "excludeSelf": bool(k % 8 == 1)}
        return {"elements": near(k / 1000), "rules": rules}

    def jobs(numbers):
        texts = spark.createDataFrame([(f"d{k:03}", json.dumps(payload(k))) for k in numbers], "document string, json string").repartition(4).cache()
        spark.sparkContext.setJobGroup(f"rules-{len(numbers)}", "")
        got = sorted((r.document, r.elementA, r.elementB, r.type, r.distance) for r in detect_documents(payload_texts(texts), method="grid").collect())
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rules-{len(numbers)}"))

    many, n_many = jobs(range(500))
    few, n_few = jobs(range(2))
    spark.sparkContext._jsc.clearJobGroup()
    # adaptive plans start a few more or less jobs by the sizes they meet
    assert n_many <= n_few + 8 and {r[0] for r in many} <= {f"d{k:03}" for k in range(500)}
    for k in (0, 1, 2, 5, 9, 333, 497):
        alone = found(spark, payload(k)["elements"], **payload(k)["rules"])
        assert [r[1:] for r in many if r[0] == f"d{k:03}"] == rows(alone), k


def test_gap_counts_in_modes_with_clearance_only(spark):
    apart = [box(1, (0, 0, 0), 1), box(2, (2.05, 0, 0), 1)]
    assert found(spark, apart, mode="hard", maxGap=100)["stats"]["candidatePairs"] == 0
    assert found(spark, apart, mode="both", maxGap=100)["stats"]["candidatePairs"] == 1


def test_document_keys_are_checked(spark):
    from meshjoin.sources.payload import payload_texts, unreadable

    good = json.dumps({"elements": [box("p", (0, 0, 0), 1), box("q", (0.5, 0, 0), 1)]})
    texts = spark.createDataFrame([("a", good), ("a", good), (None, good), ("b", "{"), ("c", good), ("d", None), ("e", ""), ("f", "[1]"), ("g", '{"elements": 3}')], "document string, json string")
    for part in ([("a", good), ("a", good)], [(None, good)]):
        with pytest.raises(Exception, match="null or repeated document key"):
            detect_documents(payload_texts(spark.createDataFrame(part, "document string, json string"))).collect()
    kept = detect_documents(payload_texts(texts, strict=False)).collect()
    assert [(r.document, r.elementA, r.elementB) for r in kept] == [("c", "p", "q")]
    faults = {r.document: r.fault for r in unreadable(texts).collect()}
    assert faults == {"a": "repeated document key", None: "no document key", "b": "not a JSON payload", "d": "no text", "e": "not a JSON payload", "f": "not a JSON payload", "g": "not a JSON payload"}


def test_large_meshes_test_blocks_once(spark, monkeypatch):
    """All hits, depth and point come of one pass over the pairs of blocks (before: one for the count and one for the points), and agree with those of two."""
    from meshjoin.plans import queries, scenes

    passes, kernel = [], narrow.block_hits_kernel
    monkeypatch.setattr(narrow, "block_hits_kernel", lambda *a, **k: passes.append(a) or kernel(*a, **k))
    got = {(r.gi_a, r.gi_b): (r.hits, r.distance, r.px, r.py, r.pz) for r in queries.QUERIES["large_meshes"](spark, "/root/testdata/sf0.001").collect()}
    assert len(passes) == 1 and got
    e = scenes.large_meshes(spark, "/root/testdata/sf0.001")
    hits = narrow.triangle_hits(candidates_of(e, Rules()), e).groupBy("gi_a", "gi_b").count().collect()
    assert {(r.gi_a, r.gi_b): r["count"] for r in hits} == {k: v[0] for k, v in got.items()}
