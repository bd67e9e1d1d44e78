"""Filter interaction audit: what each of five filters removes, alone and after others, in every order.

Whole slices of texts are scanned on their Arrow buffers: byte classes and prefix sums count words, capitals and code
points; words are hashed, sorted within their document and compared byte by byte, which gives distinct words exactly.
A document becomes a mask of the filters that it fails. Masks are counted by part, and all orders are worked out from
those counts, so nothing after the scan grows with the texts.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .scratch import Scratch

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: A filter's bit in a mask.
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: The first byte of a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80
_CASED = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51)) | np.uint64(1)


def class_counts(member: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes of each document that belong to a class: a prefix sum, or for one text longer than a slice a sum of pieces."""
    if len(data) > K.SLICE and len(off) == 2:
        return np.array([sum(int(np.count_nonzero(member[data[i : i + K.SLICE]])) for i in range(0, len(data), K.SLICE))])
    return K.segment_sums(member[data].astype(np.int64), off)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the runs of `size` bytes from a and from b are equal, about SLICE bytes at once."""
    out, ends = np.ones(len(a), bool), np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + K.SLICE, side="right")))
        n = size[i:j]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        odd = data[np.repeat(a[i:j], n) + step] != data[np.repeat(b[i:j], n) + step]
        out[i:j] = np.bincount(np.repeat(np.arange(j - i), n), odd, j - i) == 0
        i = j
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Different words of each document. Equal hashes count as one word only where the bytes agree; a document in which they
    don't is counted by its words themselves."""
    size, count = ends - starts, np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    h = K.mix(K.run_hashes(data, starts, ends, _CASED) + K.mix(size.astype(np.uint64))) + K.mix(doc.astype(np.uint64))
    order = np.argsort(h)
    at = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    u, v = order[at], order[at + 1]
    same = (doc[u] == doc[v]) & (size[u] == size[v])
    same[same] = _same_bytes(data, starts[u[same]], starts[v[same]], size[u[same]])
    out = count - np.bincount(doc[v[same]], minlength=len(count))
    for d in np.unique(np.concatenate((doc[u[~same]], doc[v[~same]]))):
        out[d] = len({data[s:e].tobytes() for s, e in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])})
    return out


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    data, off = K.utf8(texts)
    starts, ends, first = K.words(data, off)
    return {
        "words": np.diff(first), "distinct": distinct_words(data, starts, ends, first),
        "capitals": class_counts(_CAPITAL, data, off), "points": class_counts(_LEAD, data, off), "symbols": class_counts(_SYMBOL, data, off),
    }


def own_failures(texts: pa.Array) -> np.ndarray:
    """Masks of the filters A to D that each text fails by itself."""
    m = measures(texts)
    fails = {
        "A": m["words"] < MIN_WORDS, "B": 100 * m["distinct"] < DISTINCT_PERCENT * m["words"],
        "C": 100 * m["capitals"] > CAPITAL_PERCENT * m["points"], "D": m["symbols"] > 0,
    }
    return sum(f.astype(np.int32) * BIT[k] for k, f in fails.items())


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """One row a document: doc_id, part (text; empty for null), digest (SHA-256 of the text) and mask, the filters A to E that it fails.

    E: an equal text has a smaller doc_id. A null text is empty. A row without an id is never smaller than another, nor is any id smaller
    than none: it doesn't fail E and makes no other row fail. Rows that repeat id and text have one place, so don't fail E by each other.
    Other columns are left aside, so their names can't clash.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    names = ["doc_id", "part", "digest"]

    def kernel(batches):
        for batch in batches:
            for piece in K.slices(batch):
                column = lambda n: piece.column(piece.schema.get_field_index(n))
                yield pa.RecordBatch.from_arrays([*[column(n) for n in names], pa.array(own_failures(column("text")), pa.int32())], names=[*names, "own"])

    scanned = rows.mapInArrow(kernel, T.StructType([*[rows.schema[n] for n in names], T.StructField("own", T.IntegerType())]))
    scanned = Scratch(docs.sparkSession, "filter-audit").keep(scanned, "scanned")  # some 50 bytes a document; read twice
    # one row for each different text; every row finds its own text's first id by its own id, so no group of copies meets in one task
    firsts = scanned.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = scanned.join(firsts, ["doc_id", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return known.select("doc_id", "part", "digest", (F.col("own") + F.when(copy, BIT["E"]).otherwise(0)).alias("mask"))


def _places() -> list[tuple[str, int, int, int]]:
    """All orders: the order's letters, the step from 1, its filter's bit and the bits of the filters before it."""
    return [("".join(p), k + 1, BIT[f], sum(BIT[g] for g in p[:k])) for p in permutations(FILTERS) for k, f in enumerate(p)]


def interactions(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of masks: a row for each part, order and step with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    Of several labels of one id the largest count; ids without a label lose nothing to good_lost or toxic_lost. No documents give no rows.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    known = found.select("doc_id", "part", "mask").join(marks, "doc_id", "left")
    counts = known.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("quality", "toxic")])
    # at most 32 rows a part from here on, each against the 600 fixed steps
    steps = ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'bit', {b}, 'before', {p})" for o, s, b, p in _places())
    rows = counts.select("*", F.inline(F.expr(f"array({steps})")))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    # among the filters that a document fails each is the first in equally many orders
    turns = F.lit(len(list(permutations(FILTERS)))) / F.greatest(F.bit_count("mask"), F.lit(1))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "quality").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * turns.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Filter interactions of whole documents (doc_id, text, and the column of parts) against labels (doc_id, quality, toxic)."""
    return interactions(masks(docs, part), labels)
