"""Benchmark decontamination by SimHash windows.

Every benchmark item has a 128-bit SimHash over its 5-word shingles, weighted by how often they occur.
In a document, a shingle that also occurs in an item anchors a window of that item's number of words at
the item's place (a window without such a shingle can't be similar, so nothing is missed by not
fingerprinting it). The window's SimHash is looked up in a multi-index: eight tables of 16-bit blocks,
each listing the items whose block differs in at most three bits. Two fingerprints within RADIUS = 31 bits
have such a block (8 * 4 > 31), so all items within the radius are found. Candidates are then verified by the
exact weighted Jaccard similarity of the shingles, which must reach SIMILARITY.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

SIMILARITY = 0.8
BITS, BLOCKS, NEAR = 128, 8, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Items to a pass over the documents; a larger benchmark takes more passes.
ITEMS = 2048

_U = np.uint64
FOUND = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType()),
    T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
])


def _patterns(shingles: np.ndarray) -> np.ndarray:
    """128 signs (-1, 1) for each shingle."""
    both = np.stack((K.mix(shingles ^ _U(0x1234567)), K.mix(shingles ^ _U(0x89ABCDEF0))), axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


def fingerprints(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SimHashes (16 bytes each) of segments of shingles."""
    out = np.zeros((len(off) - 1, BITS // 8), np.uint8)
    step = 1 << 15
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(off, off[i] + step, side="right")) - 1)
        signs = _patterns(shingles[off[i] : off[j]])
        total = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)))
        out[i:j] = np.packbits(total[off[i + 1 : j + 1] - off[i]] - total[off[i:j] - off[i]] > 0, axis=1)
        i = j
    return out


def _segments(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first[i] .. first[i] + size[i] - 1 in a row, and offsets."""
    off = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(first - off[:-1], size) + np.arange(off[-1]), off


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights of two bags of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


@dataclass
class Index:
    """The items of one pass."""

    ids: np.ndarray
    words: np.ndarray
    shingles: np.ndarray
    off: np.ndarray
    prints: np.ndarray
    keys: np.ndarray
    key_item: np.ndarray
    key_place: np.ndarray
    sieve: np.ndarray

    @staticmethod
    def build(ids: list[int], texts: list[str]) -> Index:
        data, cut = K.utf8(pa.array(texts, pa.string()))
        starts, ends, first = K.words(data, cut)
        shingles, off = K.shingles(K.word_hashes(data, starts, ends), first)
        words = np.diff(first)
        size = np.diff(off)
        item = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(shingles, kind="stable")
        sieve = np.zeros(1 << 20, bool)
        sieve[(shingles >> _U(44)).astype(np.int64)] = True
        return Index(np.array(ids, np.int64), words, shingles, off, fingerprints(shingles, off), shingles[order], item[order], (np.arange(len(shingles)) - off[item])[order], sieve)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block: offsets by block value, and the items whose block is within NEAR bits of it."""
        masks = np.array([sum(1 << b for b in bits) for r in range(NEAR + 1) for bits in combinations(range(BITS // BLOCKS), r)], np.int64)
        used = np.flatnonzero(np.diff(self.off) > 0)
        out = []
        for block in self.prints.view(np.uint16).T:
            value = (block[used].astype(np.int64)[:, None] ^ masks).reshape(-1)
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange(65537))
            out.append((start, np.repeat(used, len(masks))[order]))
        return out


def _windows(index: Index, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (document, first shingle, shingles) that anchors ask for, without repeats."""
    at = np.flatnonzero(index.sieve[(flat >> _U(44)).astype(np.int64)])
    lo, hi = np.searchsorted(index.keys, flat[at], "left"), np.searchsorted(index.keys, flat[at], "right")
    at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
    hit, cut = _segments(lo, hi - lo)
    anchor = np.repeat(at, np.diff(cut))
    doc = np.searchsorted(off, anchor, side="right") - 1
    size = np.diff(index.off)[index.key_item[hit]]
    begin = np.maximum(anchor - index.key_place[hit], off[doc])
    size = np.minimum(size, off[doc + 1] - off[doc])
    begin = np.minimum(begin, off[doc + 1] - size)
    w = np.unique(np.stack((doc, begin, size)), axis=1)
    return w[0], w[1], w[2]


def matches(index: Index, tables, texts: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
    """(document, item, similarity, distance, first word, words): the best window of each similar pair."""
    data, cut = K.utf8(texts)
    starts, ends, first = K.words(data, cut)
    flat, off = K.shingles(K.word_hashes(data, starts, ends), first)
    doc, begin, size = _windows(index, flat, off)
    if not len(doc):
        return []
    place, seg = _segments(begin, size)
    prints = fingerprints(flat[place], seg)
    pair = []
    for (start, items), block in zip(tables, prints.view(np.uint16).T, strict=True):
        lo, hi = start[block], start[block.astype(np.int64) + 1]
        hit, c = _segments(lo, hi - lo)
        pair.append(np.repeat(np.arange(len(doc)), np.diff(c)) * len(index.ids) + items[hit])
    pair = np.unique(np.concatenate(pair))
    w, item = pair // len(index.ids), pair % len(index.ids)
    distance = np.bitwise_count(prints[w] ^ index.prints[item]).sum(axis=1)
    best: dict[tuple[int, int], tuple] = {}
    for k in np.flatnonzero(distance <= RADIUS):
        i, j = int(w[k]), int(item[k])
        similarity = weighted_jaccard(flat[begin[i] : begin[i] + size[i]], index.shingles[index.off[j] : index.off[j + 1]])
        if similarity >= SIMILARITY:
            d = int(doc[i])
            row = (d, j, similarity, int(distance[k]), int(begin[i] - off[d]), int(size[i]) + K.SHINGLE - 1)
            key = (d, j)
            if key not in best or (-row[2], row[4]) < (-best[key][2], best[key][4]):
                best[key] = row
    return [best[k] for k in sorted(best)]


def _passes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of ITEMS items, by id; only one block is on the driver at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids, texts = [], []
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == ITEMS:
            yield Index.build(ids, texts)
            ids, texts = [], []
    if ids:
        yield Index.build(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id long, item_id, similarity, distance (of the SimHashes), first_word, n_words (of the best window): one row for each
    row of `docs` (doc_id, text) and benchmark item (item_id, text) that it holds.

    Null and empty texts match nothing; rows with a null item_id are left out. An item of fewer than five words is one
    shingle, which only a document of just these words has. Rows that repeat a document or an item each count; of
    windows with equal similarity the first is given. An empty table gives no rows.
    Documents shorter than an item are compared as a whole. Texts of any length are processed whole.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *FOUND.fields])
    out = None
    for index in _passes(benchmark):
        found = source.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _finder(sent):
    def rows(batches):
        tables = sent.value.tables()
        for batch in batches:
            for part in K.slices(batch):
                got = matches(sent.value, tables, part.column("text"))
                doc, item, similarity, distance, first, words = zip(*got, strict=True) if got else ((),) * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(sent.value.ids[list(item)], pa.int64()), pa.array(similarity, pa.float64()),
                        pa.array(distance, pa.int32()), pa.array(first, pa.int64()), pa.array(words, pa.int64()),
                    ], names=["doc_id", *FOUND.names],
                )

    return rows


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns whatever their names, that hold no benchmark item in the sense of `leaks`. Null and empty
    texts stay; repeated rows stay or go together; without items all rows stay; an empty table gives no rows."""
    out = docs.withColumn("text", F.col("text").cast("string"))
    for index in _passes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches, sent=sent):
            tables = sent.value.tables()
            for batch in batches:
                for part in K.slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in matches(sent.value, tables, part.column(part.schema.get_field_index("text")))]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(rows, out.schema)
    return out
