"""Schemas and rules of the mesh-interference engine. Coordinates are metres; gaps and distances are millimetres."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ELEMENT_WIRE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("modelId", T.StringType()), T.StructField("ifcType", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("storey", T.StringType()), T.StructField("discipline", T.StringType()), T.StructField("vertices", T.ArrayType(T.FloatType())), T.StructField("indices", T.ArrayType(T.IntegerType())),
])

RULES_WIRE = T.StructType([
    T.StructField("mode", T.StringType()), T.StructField("maxGap", T.DoubleType()), T.StructField("minGap", T.DoubleType()), T.StructField("modelA", T.StringType()),
    T.StructField("modelB", T.StringType()), T.StructField("excludeSelf", T.BooleanType()), T.StructField("excludeTypePairs", T.ArrayType(T.StringType())),
])

PAYLOAD = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT_WIRE)), T.StructField("rules", RULES_WIRE)])

BOX = ["vx0", "vy0", "vz0", "vx1", "vy1", "vz1"]
MESH_BOX = ["fx0", "fy0", "fz0", "fx1", "fy1", "fz1"]

CLASH = T.StructType([
    T.StructField("elementA", T.StringType()), T.StructField("elementB", T.StringType()), T.StructField("modelAId", T.StringType()), T.StructField("modelBId", T.StringType()),
    T.StructField("point", T.ArrayType(T.DoubleType())), T.StructField("distance", T.LongType()), T.StructField("volume", T.DoubleType()),
    T.StructField("depth_semantics", T.StringType()), T.StructField("type", T.StringType()),
])

DEPTH_SEMANTICS = "aabb_overlap_estimate"
MAX_POINTS = 24


@dataclass(frozen=True)
class Rules:
    """What to look for. Any mode but soft runs the hard test; soft and both run the clearance test if max_gap is positive.

    min_gap is accepted and has no effect.
    """

    mode: str = "hard"
    max_gap: float = 0.0
    model_a: str = "all"
    model_b: str = "all"
    exclude_self: bool = False
    exclude_type_pairs: tuple[str, ...] = field(default=())
    min_gap: float = 0.0

    @staticmethod
    def of(wire: dict | None) -> Rules:
        """From the wire form; absent and null entries take the defaults, unknown ones are ignored."""
        w = {k: v for k, v in (wire or {}).items() if v is not None}
        return Rules(
            w.get("mode", "hard"), float(w.get("maxGap", 0)), w.get("modelA", "all"), w.get("modelB", "all"), bool(w.get("excludeSelf", False)),
            tuple(w.get("excludeTypePairs", ())), float(w.get("minGap", 0)),
        )

    @property
    def gap_m(self) -> float:
        """Metres by which boxes are widened; only modes that look for clearances have a gap."""
        return self.max_gap / 1000.0 if self.mode in ("soft", "both") else 0.0

    @property
    def hard(self) -> bool:
        return self.mode != "soft"

    @property
    def soft(self) -> bool:
        return self.mode in ("soft", "both") and self.max_gap > 0
