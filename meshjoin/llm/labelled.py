"""Bounded samples of labelled rows and pass-through kernels, shared by the trained operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K


def remainder(modulus: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; 0 for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(text, label double) of at most about `most` labelled rows that satisfy `usable`, the first by a hash of the id.

    Null ids and labels are left out; of several labels of one id the largest counts.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most `most` rows of two numbers, so the side is small by construction
    return texts.join(F.broadcast(ids), "doc_id").select("text", "label")


def collected(rows: DataFrame, stats: Callable[[pa.Array], np.ndarray], width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a sample as arrays, computed on the executors; at most 2 * most rows of `width` numbers arrive."""

    def kernel(batches):
        for batch in batches:
            for part in K.slices(batch):
                x = stats(part.column("text")).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), K.list_array(x, np.arange(part.num_rows + 1) * width, pa.float64())], names=["label", "x"]
                )

    got = rows.mapInArrow(kernel, "label double, x array<double>").limit(2 * most).toArrow()
    if not got.num_rows:
        return np.zeros((0, width)), np.zeros(0)
    x = np.asarray(got.column("x").combine_chunks().values).reshape(-1, width)
    y = np.asarray(got.column("label").combine_chunks())
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


def with_columns(docs: DataFrame, extra: T.StructType, kernel: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None, limit: int = K.SLICE) -> DataFrame:
    """`docs` (the columns `keep`, or all) plus the columns that the kernel makes of `text`, slice by slice."""
    names = list(docs.columns) if keep is None else keep
    source = docs.select(*names, *([] if "text" in names else ["text"]))
    source = source.withColumn("text", F.col("text").cast("string"))
    fields = [source.schema[n] for n in names]

    def rows(batches):
        for batch in batches:
            for part in K.slices(batch, limit=limit):
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(n)) for n in names] + kernel(part.column(part.schema.get_field_index("text"))), names=names + extra.names
                )

    return source.mapInArrow(rows, T.StructType([*fields, *extra.fields]))
