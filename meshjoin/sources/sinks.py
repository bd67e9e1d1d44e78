"""Wire forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schema import CLASH


def clash_dicts(clashes: DataFrame) -> list[dict]:
    """Collected clashes as wire dicts: hard rows carry depth_semantics, clearance rows don't."""
    out = []
    for row in clashes.select("id", *CLASH.names).collect():
        d = row.asDict()
        if d["depth_semantics"] is None:
            del d["depth_semantics"]
        out.append(d)
    return out


def write_clashes(clashes: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes clashes in any Spark format; json leaves out null fields."""
    clashes.write.mode("overwrite").format(form).save(path)
