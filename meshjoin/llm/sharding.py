"""Sharding as a two-pass external shuffle, with DataFrame operations only.

Pass 1 scatters the records' handles uniformly into memory-sized buckets by a seeded hash. Pass 2 runs
Spark's `shuffle` (a Fisher-Yates shuffle with a seed) over each bucket. The buckets in order, each in
its shuffled order, are one random order of all records; shard s takes the positions p with
floor(p * shards / n) = s, so shard sizes differ by one row at most (law `rows`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

SHARDS = 40
SEED = 20_240_607
#: A bucket holds about so many bytes of records and so many handles.
BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 1 << 14


def _size():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16


def shard_plan(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, scratch: Scratch | None = None
) -> DataFrame:
    """One row per row of `docs` (doc_id, text; more columns are ignored):
    doc_id, size long, text_crc32 long, law, shard int, slot long, grown_shard int (null), bucket long, row_id long.

    The order depends on the seed, the ids and the texts, not on the input's partitioning; only rows that
    repeat an id and a text, and rows without an id, are told apart by their place in the input, so that no
    number of such rows can swell a bucket. Null texts have size 16 and a null text_crc32. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    handles = scratch.keep(docs.select(*_handle(), F.monotonically_increasing_id().alias("row_id")), "handles")
    n, buckets = _extent(handles, bucket_bytes, bucket_rows)
    shuffled = scratch.keep(_shuffled(_scattered(handles, buckets, seed), buckets, seed, ["doc_id", "size", "text_crc32"]), "shuffled")
    scratch.drop("handles")
    out = _placed(shuffled, n, shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket", "row_id",
    )


def _handle() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size"), F.crc32(F.encode(F.col("text").cast("string"), "UTF-8")).alias("text_crc32")]


def _extent(handles: DataFrame, bucket_bytes: int, bucket_rows: int) -> tuple[int, int]:
    """How many rows there are, and buckets."""
    total = handles.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    return total["n"], max(1, math.ceil((total["bytes"] or 0) / bucket_bytes), math.ceil(total["n"] / bucket_rows))


def _scattered(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Rows (doc_id, text_crc32, row_id, ...) with a seeded key and their bucket. Rows that repeat an id and a text, and rows without an id,
    differ by row_id; the counting is combined before it is shuffled."""
    again = rows.groupBy("doc_id", "text_crc32").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
    again = again.select(F.col("doc_id").alias("d"), F.col("text_crc32").alias("c"), F.lit(True).alias("again"))
    if again.isEmpty():  # the usual case: no join that would shuffle the rows
        marked = rows.withColumn("again", F.lit(False))
    else:
        marked = rows.join(again, rows["doc_id"].eqNullSafe(again["d"]) & rows["text_crc32"].eqNullSafe(again["c"]), "left").drop("d", "c")
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", F.when(F.col("again"), F.col("row_id")).otherwise(F.lit(0)))
    return marked.withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(buckets))).drop("again")


def _shuffled(rows: DataFrame, buckets: int, seed: int, columns: list[str]) -> DataFrame:
    """bucket, at (the place in its bucket after the Fisher-Yates shuffle), row_id and the columns; a bucket is in memory at once."""
    grouped = (
        rows.repartition(min(buckets, 20_000), "bucket").groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("key", "row_id", *columns))).alias("rows"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("rows", seed).alias("rows"))
    )
    return grouped.select("bucket", F.posexplode("rows").alias("at", "r")).select("bucket", "at", "r.row_id", *[f"r.{c}" for c in columns])


def _placed(shuffled: DataFrame, n: int, shards: int) -> DataFrame:
    """Adds shard int and slot long."""
    # one row for each bucket, that is for each BUCKET_BYTES or BUCKET_ROWS of input
    starts = shuffled.groupBy("bucket").agg(F.count("*").alias("rows"))
    starts = starts.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("start"))
    out = shuffled.join(F.broadcast(starts), "bucket").withColumn("shard", F.expr(f"CAST(({shards} * (start + at)) DIV {max(n, 1)} AS INT)"))
    return out.withColumn("slot", F.col("start") + F.col("at") - F.expr(f"(shard * {n}L + {shards - 1}) DIV {shards}"))


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, scratch: Scratch | None = None
) -> DataFrame:
    """Writes the whole records in shuffled order below `path`, one folder shard=N each, every file sorted by the column slot; returns what is
    written, read again.

    The two passes go over the records themselves: they are scattered into memory-sized buckets, and each bucket is shuffled in memory and
    written. The order is that of shard_plan with the same parameters. Nulls, empty and long texts and repeated rows are written like
    any other; columns of docs named shard or slot get an underscore, map columns aren't supported. An empty table writes no file.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    given = [F.col(c).alias(f"{c}_" if c.lower() in ("shard", "slot") else c) for c in docs.columns]
    # the columns go as one, so that none of theirs can clash with ours
    records = docs.select(*_handle(), F.struct(*given).alias("record")).withColumn("row_id", F.monotonically_increasing_id())
    n, buckets = _extent(records, bucket_bytes, bucket_rows)
    # records are shuffled once, by their buckets; a file holds a bucket's rows in their order, so that a reading task meets few shards
    shuffled = scratch.keep(_shuffled(_scattered(records, buckets, seed), buckets, seed, ["record"]), "shuffled-records", compression="zstd")
    placed = _placed(shuffled, n, shards).sortWithinPartitions("shard", "slot")
    placed = placed.select("record.*", "slot", "shard")
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    scratch.drop("shuffled-records")
    return spark.read.schema(placed.schema).parquet(path)


def written_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """Writes `docs` (doc_id, text) as shards to the shared folder and reads them again, a row for each record that lies there:
    doc_id, size long, text_crc32 long, law, shard int, slot long, grown_shard int (null)."""
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    written = write_shards(docs.select("doc_id", "text"), f"{scratch.root}/shards", shards, seed, scratch=scratch)
    return written.select(*_handle(), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
