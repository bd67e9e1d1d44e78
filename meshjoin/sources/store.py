"""Elements stored in buckets by gi, so that joins on it read meshes where they lie instead of shuffling them for each use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def store(elements: DataFrame, table: str, buckets: int) -> DataFrame:
    """Writes elements to a table of the session's catalog, bucketed and sorted by gi, and reads it back. A table of this name is replaced.

    Choose as many buckets as make some 100 MB each. Pass the number on to narrow.tested.
    """
    # dealt by gi first, so that each bucket is one file
    elements.repartition(buckets, "gi").write.mode("overwrite").bucketBy(buckets, "gi").sortBy("gi").saveAsTable(table)
    return elements.sparkSession.table(table)
