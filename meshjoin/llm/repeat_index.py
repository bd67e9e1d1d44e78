"""Suffix-array deduplication with a run-length index: every byte that a long string of earlier text covers is removed.

A string of WINDOW bytes that also starts earlier (at a smaller doc_id, or further left in the same text) is a later one;
the bytes of all later strings go, the first copy of each stays.

1. Anchors. Of the grams in a window the one with the least hash is its anchor, so equal windows have equal anchors wherever
   they are. Neighbouring windows with one anchor are a segment, the unit of all shuffles.
2. Segments meet by the anchor's hash (name) with those of the same content (body). Copies of a whole segment are decided
   there. Only segments whose anchor also has other contents are taken on, the first one of each content.
3. Those are dealt to buckets of bounded size by name. Each bucket gets a run-length compressed Burrows-Wheeler transform
   with the text positions at the ends of its runs. From these samples each position's predecessor in suffix order and
   the length of its match with it are streamed in text order, and matches of a window or more link equal windows.
4. Names with very many contents, which would not fit a bucket, get longer: their segments are halved by where the anchor
   stands in a window, and each half is named by all that its windows have in common. That parts what only shares the
   anchor; a half whose windows are all alike is one content. At most seven such rounds end it.
5. Names that a good share of all documents have aren't shuffled by name before equal contents are combined.

Nothing here is collected, but for a list of at most MOST_HOT names and some totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import kernels as K
from .scratch import Scratch

#: Bytes of a string that counts, and of the grams that anchor it.
WINDOW, GRAM = 100, 24
#: Bytes of a bucket; contents of one name that a bucket may hold.
BUCKET, WIDE = 1 << 20, 4096
#: One document in SAMPLED shows which names are hot: those that one in HOT of these and HOT_LEAST have, the MOST_HOT most frequent at most. Which
#: names these are changes the way of a segment, never its result.
SAMPLED, HOT, HOT_LEAST, MOST_HOT = 32, 25, 64, 4096

_U = np.uint64
_SPOT = _U((1 << 24) - 1)
_CODES = [K.mix(np.arange(256, dtype=_U) * _U(0x2545F4914F6CDD1D) + _U(k)) | _U(1) for k in (3, 5)]

#: Where a document stands: those without an id come last, by a hash of their text.
PLACE = ["anonymous", "key"]
_PLACE_FIELDS = [T.StructField("anonymous", T.BooleanType()), T.StructField("key", T.LongType())]
_SEGMENT = T.StructType([*_PLACE_FIELDS, T.StructField("start", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("name", T.LongType()), T.StructField("body", T.LongType()), T.StructField("seen", T.BooleanType())])
_CONTENT = T.StructType([*_SEGMENT.fields[:6], T.StructField("content", T.BinaryType())])
_MARK = T.StructType([*_PLACE_FIELDS, *[T.StructField(c, T.IntegerType()) for c in ("start", "count", "check", "low", "high")]])
_RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()),
])


# anchors and segments


def window_anchors(data: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the data the place of its anchor, and the hashes of all grams. Of equal hashes (by 40 bits) the leftmost counts."""
    n, span = len(data), window - gram + 1
    up, down = K._power(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_CODES[0][data] * up[:n], out=sums[1:])
    grams = K.mix((sums[gram:] - sums[: n + 1 - gram]) * down[: n + 1 - gram])
    least, have = (grams & ~_SPOT) | np.arange(len(grams), dtype=_U), 1
    while 2 * have <= span:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    return (least & _SPOT).astype(np.int64), grams


def _segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    length = np.diff(off)
    docs = np.flatnonzero(length >= WINDOW)
    if not len(docs):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    spots, grams = window_anchors(data)
    edge = np.zeros(len(spots) + 1, np.int8)
    edge[off[docs]] += 1
    edge[off[docs + 1] - WINDOW + 1] -= 1
    new = np.ones(len(spots), bool)
    new[1:] = spots[1:] != spots[:-1]
    new[off[docs]] = True
    first = np.flatnonzero(new & (np.cumsum(edge[:-1]) > 0))
    doc = np.searchsorted(off, first, side="right") - 1
    end = np.minimum(np.append(first[1:], len(spots)), off[doc + 1] - WINDOW + 1)
    body = bodies(data, first, end + WINDOW - 1)
    return doc, first - off[doc], end - first, grams[spots[first]], body


def bodies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of contents, which are in order and may overlap."""
    return K.mix(K.run_hashes(data, starts, ends, _CODES[1]) + K.mix((ends - starts).astype(_U)))


def _bodies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for contents in order of their starts only: those that end before an earlier one are taken by themselves."""
    out, rest = np.zeros(len(starts), _U), np.arange(len(starts))
    while len(rest):
        fits = ends[rest] >= np.maximum.accumulate(ends[rest])
        out[rest[fits]] = bodies(data, starts[rest[fits]], ends[rest[fits]])
        rest = rest[~fits]
    return out


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of a slice of documents in text order: document, first window, number of windows, name, body. A text longer than a slice is taken
    in stretches of SLICE windows; segments end there, alike in each copy of the text."""
    if len(data) <= 2 * K.SLICE or len(off) > 2:
        return _segments(data, off)
    parts = []
    for at in range(0, len(data) - WINDOW + 1, K.SLICE):
        piece = data[at : at + K.SLICE + WINDOW - 1]
        doc, start, *rest = _segments(piece, np.array([0, len(piece)]))
        parts.append((doc, start + at, *rest))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first one with its keys."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    out = np.ones(len(order), bool)
    out[order[1:][same]] = False
    return out


def _own_repeats(data, off, doc, start, count, name, body) -> tuple[np.ndarray, ...]:
    """Segments without those that their own text has further left, and the latter in runs: document, first window, number, and body of each run."""
    new = _first_of(doc, name, body)
    later = np.flatnonzero(~new)
    glued = np.zeros(len(later), bool)
    glued[1:] = (doc[later[1:]] == doc[later[:-1]]) & (start[later[1:]] == start[later[:-1]] + count[later[:-1]])
    heads = np.flatnonzero(~glued)
    tails = np.append(heads[1:], len(later)) - 1
    run_doc, run_start = doc[later[heads]], start[later[heads]]
    run_count = start[later[tails]] + count[later[tails]] - run_start if len(later) else run_start
    run_body = bodies(data, off[run_doc] + run_start, off[run_doc] + run_start + run_count + WINDOW - 1)
    return new, run_doc, run_start, run_count, run_body


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == _U else values.astype(np.int64))


def _int(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _check(body: np.ndarray) -> np.ndarray:
    """The part of a content's hash that tells apart rows which share an id."""
    return (body & _U(0x7FFFFFFF)).astype(np.int32)


def _placed(docs: DataFrame) -> DataFrame:
    """Documents with their place and their bytes as text; other columns are left aside."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.col("doc_id").isNull().alias("anonymous"), F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "text")


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).to_numpy(zero_copy_only=False)


def segment_rows(placed: DataFrame, hot: list[int]) -> DataFrame:
    """Segments of all documents but those of hot names. Runs that a text repeats itself are marked as seen and named by their place."""

    def kernel(batches):
        names = np.sort(np.array(hot, np.int64))
        for batch in batches:
            for piece in K.slices(batch):
                data, off = K.utf8(_column(piece, "text"))
                doc, start, count, name, body = segments(data, off)
                new, *runs = _own_repeats(data, off, doc, start, count, name, body)
                keep = new & ~np.isin(name.view(np.int64), names)
                at = np.concatenate((doc[keep], runs[0]))
                key = _numbers(piece, "key")[at]
                first = np.concatenate((start[keep], runs[1]))
                seen = np.concatenate((np.zeros(int(keep.sum()), bool), np.ones(len(runs[0]), bool)))
                apart = K.mix(key.astype(np.int64).view(_U) + K.mix(first.astype(_U)))
                named = np.where(seen, apart, np.concatenate((name[keep], runs[3])))
                cols = [pa.array(_numbers(piece, "anonymous")[at]), _long(key), _int(first), _int(np.concatenate((count[keep], runs[2]))), _long(named), _long(np.concatenate((body[keep], runs[3]))), pa.array(seen)]
                yield pa.RecordBatch.from_arrays(cols, names=_SEGMENT.names)

    return placed.select(*PLACE, "text").mapInArrow(kernel, _SEGMENT)


def hot_names(placed: DataFrame) -> list[int]:
    """The names that many sampled documents have."""
    sampled = placed.where(F.pmod(F.xxhash64("anonymous", "key", F.lit("sample")), F.lit(SAMPLED)) == 0)
    least = max(HOT_LEAST, sampled.count() // HOT)
    often = segment_rows(sampled, []).where(~F.col("seen")).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [r["name"] for r in often.orderBy(F.desc("n"), "name").limit(MOST_HOT).collect()]


def hot_contents(placed: DataFrame, hot: list[int]) -> DataFrame:
    """Segments of hot names with their contents, one for each that a text doesn't repeat."""

    def kernel(batches):
        names = np.sort(np.array(hot, np.int64))
        for batch in batches:
            for piece in K.slices(batch):
                data, off = K.utf8(_column(piece, "text"))
                doc, start, count, name, body = segments(data, off)
                keep = np.isin(name.view(np.int64), names) & _first_of(doc, name, body)
                yield _content_batch(piece, data, off, *[c[keep] for c in (doc, start, count, name, body)])

    return placed.select(*PLACE, "text").mapInArrow(kernel, _CONTENT)


def _content_batch(piece, data, off, doc, start, count, name, body) -> pa.RecordBatch:
    at = off[doc] + start
    content = pa.array([data[a:b].tobytes() for a, b in zip(at, at + count + WINDOW - 1)], pa.binary())
    cols = [pa.array(_numbers(piece, "anonymous")[doc]), _long(_numbers(piece, "key")[doc]), _int(start), _int(count), _long(name), _long(body), content]
    return pa.RecordBatch.from_arrays(cols, names=_CONTENT.names)


def flagged(rows: DataFrame) -> DataFrame:
    """The segments that matter: later copies (kind 'later'), and firsts of contents whose name has others (kind 'open')."""
    order = [F.col("anonymous"), F.col("key"), F.col("start")]
    met = rows.repartition("name")
    met = met.withColumn("turn", F.rank().over(Window.partitionBy("name", "body").orderBy(*order)))
    one = Window.partitionBy("name")
    met = met.withColumn("mixed", F.min("body").over(one) != F.max("body").over(one))
    later = F.col("seen") | (F.col("turn") > 1)
    return met.where(later | F.col("mixed")).select(*PLACE, "start", "count", "name", "body", later.alias("later"))


# the run-length index of a bucket


def suffix_order(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of strings, each with a place for its end behind it, in order, and the distance of each position from its string's end.

    Ends are smaller than bytes and than the ends of later strings. Orders by five bytes are doubled until all suffixes differ.
    """
    n, sizes = len(data), np.diff(off)
    string = np.repeat(np.arange(len(sizes)), sizes)
    left = off[1:][string] - 1 - np.arange(n)
    symbol = np.append(data.astype(np.int64) + 1, np.zeros(5, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(5):
        key = (key << 9) | np.where(left > k, symbol[k : n + k], 0)
    key = (key << 18) | np.where(left < 5, string + 1, 0)
    reach = 5
    while True:
        order = np.argsort(key)
        fresh = np.ones(n, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        if fresh.all():
            return order, left
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        beyond = np.zeros(n, np.int64)
        beyond[: n - reach] = rank[reach:]
        # suffixes that end within reach are alone in their rank already
        key, reach = rank * (n + 1) + beyond, 2 * reach


def run_samples(data: np.ndarray, order: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length compression of the Burrows-Wheeler transform: for each run the position at its start, and the one at the end of the run before, in text
    order. Strings' first positions are runs of their own. The first suffix has none before it and is its own."""
    before = np.where(left[order - 1] == 0, -1, data[order - 1].astype(np.int64))
    head = np.ones(len(order), bool)
    head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
    row = np.flatnonzero(head)
    start, previous = order[row], order[np.maximum(row - 1, 0)]
    by_place = np.argsort(start)
    return start[by_place], previous[by_place]


def common_lengths(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes from a and from b on that agree, within their strings."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.zeros(len(data), _U)
    for k in range(8):
        eight = (eight << _U(8)) | padded[k : len(data) + k].astype(_U)
    most = np.minimum(left[a], left[b])
    out, live, at = most.copy(), np.flatnonzero(a != b), 0
    out[a == b] = 0
    while len(live):
        live = live[most[live] > at]
        odd = eight[a[live] + at] ^ eight[b[live] + at]
        ended = odd != 0
        done = live[ended]
        # whole bytes before the first that differs
        alike = sum((odd[ended] >> _U(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
        out[done] = np.minimum(at + alike, most[done])
        live, at = live[~ended], at + 8
    return out


def equal_windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose window occurs elsewhere, and a position that stands for all equal ones.

    The samples are streamed in text order: up to the next one each position's predecessor in suffix order moves on by one and its match gets
    shorter by one. Positions with a match of a window or more are linked with that predecessor, and links are followed to their ends.
    """
    order, left = suffix_order(data, off)
    start, previous = run_samples(data, order, left)
    match = common_lengths(data, left, start, previous)
    end = np.minimum(np.append(start[1:], len(data)), start + match - WINDOW + 1)
    long = np.flatnonzero(end > start)
    n = end[long] - start[long]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, target = np.repeat(start[long], n) + step, np.repeat(previous[long], n) + step
    root = np.arange(len(data))
    root[place] = target
    while True:
        further = root[root[place]]
        if (further == root[place]).all():
            break
        root[place] = further
    ends = np.unique(root[place])
    return np.concatenate((place, ends)), np.concatenate((root[place], ends))


def later_windows(rows: pa.Table) -> pa.Table:
    """Marks of the windows of a bucket's segments that start earlier in another of them."""
    rows = rows.combine_chunks()
    number = lambda n: rows.column(n).to_numpy()
    anonymous, key, start, body = number("anonymous").astype(bool), number("key"), number("start"), number("body")
    order = np.lexsort((body, start, key, anonymous))
    fresh = np.ones(len(order), bool)
    same_doc = (anonymous[order[1:]] == anonymous[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    fresh[1:] = ~(same_doc & (start[order[1:]] == start[order[:-1]]) & (body[order[1:]] == body[order[:-1]]))
    doc = np.cumsum(np.concatenate(([True], ~same_doc)))[fresh]
    order = order[fresh]
    contents = rows.column("content").take(pa.array(order)).to_pylist()
    off = np.concatenate(([0], np.cumsum([len(c) + 1 for c in contents]))).astype(np.int64)
    data = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    place, group = equal_windows(data, off)
    string = np.searchsorted(off, place, side="right") - 1
    # rows that share an id have their places in common
    at = (doc[string] << 32) + start[order][string] + place - off[string]
    first = np.full(len(data), np.iinfo(np.int64).max)
    np.minimum.at(first, group, at)
    later = np.sort(place[at > first[group]])
    string = np.searchsorted(off, later, side="right") - 1
    new = np.ones(len(later), bool)
    new[1:] = (later[1:] != later[:-1] + 1) | (string[1:] != string[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(later)) - 1
    segment = order[string[heads]]
    low, high = (later[heads] - off[string[heads]], later[tails] - off[string[heads]] + 1) if len(later) else (heads, heads)
    return pa.table([pa.array(anonymous[segment]), _long(key[segment]), _int(start[segment]), _int(number("count")[segment]), pa.array(_check(body[segment].view(_U))), _int(low), _int(high)], names=_MARK.names)


# names with more contents than a bucket holds

_PIECE = T.StructType([*_CONTENT.fields, T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])
_WHO = [*PLACE, "start"]


def halves(contents: DataFrame) -> DataFrame:
    """Both halves of segments whose windows have from low to below high bytes before their anchor, named by the bytes that all such windows share."""

    def kernel(batches):
        for batch in batches:
            for piece in K.slices(batch, "content", K.SLICE // 4):
                data, off = K.utf8(_column(piece, "content"))
                spots, _ = window_anchors(data)
                lead = spots[off[:-1]] - off[:-1]  # bytes before the anchor, in the first window
                low, high, start, count = (_numbers(piece, c).astype(np.int64) for c in ("low", "high", "start", "count"))
                middle = (low + high) // 2
                out = []
                for l, h in ((low, middle), (middle, high)):
                    # window k has lead - k bytes before its anchor
                    begin, end = np.maximum(lead - h + 1, 0), np.minimum(lead - l + 1, count)
                    row = np.flatnonzero((begin < end) & (l < h))
                    b, e, at = begin[row], end[row], off[row]
                    name = K.mix(bodies(data, at + lead[row] - l[row], at + lead[row] + WINDOW - h[row] + 1) + K.mix((l[row] * WINDOW + h[row]).astype(_U)))
                    body = bodies(data, at + b, at + e + WINDOW - 1)
                    text = [data[x:y].tobytes() for x, y in zip(at + b, at + e + WINDOW - 1)]
                    cols = [pa.array(_numbers(piece, "anonymous")[row]), _long(_numbers(piece, "key")[row]), _int(start[row] + b), _int(e - b), _long(name), _long(body), pa.array(text, pa.binary()), _int(l[row]), _int(h[row])]
                    yield pa.RecordBatch.from_arrays(cols, names=_PIECE.names)

    return contents.select(*_PIECE.names).mapInArrow(kernel, _PIECE)


def firsts_of(rows: DataFrame) -> DataFrame:
    """The first segment of each name and content."""
    others = [c for c in rows.columns if c not in (*_WHO, "name", "body")]
    return rows.groupBy("name", "body").agg(F.min(F.struct(*_WHO, *others)).alias("first")).select("name", "body", "first.*").select(*rows.columns)


def parted(scratch: Scratch, rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame | None]:
    """Contents (firsts of their kind, with low and high) by names that have more than one and at most WIDE, and marks of segments that came out as copies
    of earlier ones when those of more had been halved."""
    narrow, later, level = None, None, rows
    for depth in range(WINDOW.bit_length() + 1):
        counted = level.join(level.groupBy("name").agg(F.count("*").alias("n")), "name")
        few = counted.where((F.col("n") > 1) & (F.col("n") <= WIDE)).select(*_CONTENT.names)
        narrow = few if narrow is None else narrow.unionByName(few)
        wide = scratch.keep(counted.where(F.col("n") > WIDE).select(*_PIECE.names), f"{label}-wide-{depth}")
        if wide.isEmpty():
            break
        pieces = scratch.keep(halves(wide), f"{label}-pieces-{depth}")
        level = scratch.keep(firsts_of(pieces), f"{label}-level-{depth}")
        first = level.select("name", "body", *[F.col(c).alias(f"first_{c}") for c in _WHO])
        copies = _marks_of(pieces.join(first, ["name", "body"]).where(~_all_equal()))
        later = copies if later is None else later.unionByName(copies)
    return narrow, later


def _all_equal() -> Column:
    return (F.col("anonymous") == F.col("first_anonymous")) & (F.col("key") == F.col("first_key")) & (F.col("start") == F.col("first_start"))


# the operator


def open_contents(placed: DataFrame, flags: DataFrame) -> DataFrame:
    """Contents of the open segments, cut from their texts."""
    spots = F.array_sort(F.transform("open", lambda s: F.struct(s["start"].alias("start"), s["count"].alias("count"), s["name"].alias("name"), s["body"].alias("body"))))
    rows = placed.drop("doc_id").join(flags.where(F.size("open") > 0).select(*PLACE, spots.alias("open")), PLACE)

    def kernel(batches):
        for batch in batches:
            for piece in K.slices(batch):
                data, off = K.utf8(_column(piece, "text"))
                spots = _column(piece, "open")
                doc = np.repeat(np.arange(len(spots)), np.asarray(spots.value_lengths()))
                start, count, name, body = (spots.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
                # of rows that share an id only those that have this content there
                fits = off[doc] + start + count + WINDOW - 1 <= off[doc + 1]
                doc, start, count, name, body = (c[fits] for c in (doc, start.astype(np.int64), count.astype(np.int64), name.view(_U), body.view(_U)))
                own = _bodies(data, off[doc] + start, off[doc] + start + count + WINDOW - 1) == body
                yield _content_batch(piece, data, off, *[c[own] for c in (doc, start, count, name, body)])

    return rows.select(*PLACE, "text", "open").mapInArrow(kernel, _CONTENT)


def _marks_of(contents: DataFrame) -> DataFrame:
    check = F.col("body").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return contents.select(*PLACE, "start", "count", check.alias("check"), F.lit(0).alias("low"), F.col("count").alias("high"))


def _by_document(marks: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return marks.groupBy(*PLACE).agg(F.collect_list(F.struct(*columns)).alias(name))


def repeats(docs: DataFrame) -> DataFrame:
    """One row a document (doc_id, text): doc_id, n_bytes, n_removed, spans (maximal removed runs, array of start and end in bytes) and kept, the
    other bytes.

    A null text is empty. Texts shorter than a window keep all. Rows that share an id have their places in common: the string at a place is never later
    than one at the same place of another row, so repeated rows fare alike. Rows without an id come after all others, by a hash of their text.
    Other columns are left aside, so their names can't clash. kept can end or begin amid a character, as matches are of bytes.
    """
    spark = docs.sparkSession
    scratch, placed = Scratch(spark, "repeat-index"), _placed(docs)
    hot = hot_names(placed)
    found = flagged(segment_rows(placed, hot))
    check = F.col("body").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    spot = F.struct("start", "count", check.alias("check"))
    # collect_list leaves out nulls; as many entries as the document has repeated segments
    flags = scratch.keep(found.groupBy(*PLACE).agg(
        F.collect_list(F.when(F.col("later"), spot)).alias("later"), F.collect_list(F.when(~F.col("later"), F.struct("start", "count", "name", "body"))).alias("open"),
    ), "flags")
    contents = scratch.keep(open_contents(placed, flags), "contents")
    whole = lambda df: df.withColumns({"low": F.lit(0), "high": F.lit(WINDOW - GRAM + 1)})
    narrow, marks = parted(scratch, whole(contents), "open")
    joined = placed.join(flags.select(*PLACE, "later"), PLACE, "left")
    if hot:
        often = scratch.keep(hot_contents(placed, hot), "hot")
        first = scratch.keep(firsts_of(often), "hot-firsts")
        few, copies = parted(scratch, whole(first), "hot")
        narrow = narrow.unionByName(few)
        marks = copies if marks is None else marks if copies is None else marks.unionByName(copies)
        # all segments of hot names, of which those that are firsts stay but for their own marks
        every = _by_document(_marks_of(often), "hot", ["start", "count", "check"])
        joined = joined.join(every, PLACE, "left").join(_by_document(_marks_of(first), "firsts", ["start", "check"]), PLACE, "left")
    else:
        joined = joined.withColumns({"hot": F.lit(None).cast("array<struct<start:int,count:int,check:int>>"), "firsts": F.lit(None).cast("array<struct<start:int,check:int>>")})
    size = narrow.agg(F.sum(F.length("content"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("name"), F.lit(size // BUCKET + 1))
    found = narrow.groupBy(bucket.alias("bucket")).applyInArrow(later_windows, _MARK)
    marks = found if marks is None else found.unionByName(marks)
    joined = joined.join(_by_document(marks, "marks", ["start", "count", "check", "low", "high"]), PLACE, "left")
    return joined.select("doc_id", "text", "later", "hot", "firsts", "marks").mapInArrow(_cut_batches, _RESULT)


def _listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The document of each entry of a column of lists of structs, and the entries' fields."""
    lists = _column(batch, name)
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), sizes), [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(flat.type.num_fields)]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in K.slices(batch):
            yield _cut(piece)


def _cut(piece: pa.RecordBatch) -> pa.RecordBatch:
    """Texts without the bytes of marked windows."""
    data, off = K.utf8(_column(piece, "text"))
    d1, (start, count, check) = _listed(piece, "later")
    d2, marks = _listed(piece, "marks")
    d3, often = _listed(piece, "hot")
    d4, firsts = _listed(piece, "firsts")
    named = lambda d, at, c: (off[d] + at) << 31 | c
    stays = np.isin(named(d3, often[0], often[2]), named(d4, *firsts))
    often = [c[~stays] for c in often]
    doc = np.concatenate((d1, d3[~stays], d2))
    whole = [np.concatenate(c) for c in zip((start, count, check), often)]
    start, count, check, low, high = (np.concatenate(c) for c in zip((*whole, np.zeros_like(whole[0]), whole[1]), marks))
    order = np.lexsort((start, doc))
    doc, start, count, check, low, high = (c[order] for c in (doc, start, count, check, low, high))
    fits = off[doc] + start + count + WINDOW - 1 <= off[doc + 1]
    doc, start, count, check, low, high = (c[fits] for c in (doc, start, count, check, low, high))
    at = off[doc] + start
    own = _check(_bodies(data, at, at + count + WINDOW - 1)) == check
    doc, at, low, high = doc[own], at[own], low[own], high[own]
    first, last = at + low + doc, at + high + doc  # windows, a place apart between documents
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order] + WINDOW - 1
    reach = np.maximum.accumulate(last) if len(last) else last
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    begin, end = first[heads], reach[np.append(heads[1:], len(first)) - 1] if len(first) else reach
    span_doc = np.searchsorted(off + np.arange(len(off)), begin, side="right") - 1
    begin, end = begin - span_doc - off[span_doc], end - span_doc - off[span_doc]
    cut = np.searchsorted(span_doc, np.arange(len(off)))
    kept = []
    for d in range(len(off) - 1):
        text, b, e = data[off[d] : off[d + 1]], begin[cut[d] : cut[d + 1]], end[cut[d] : cut[d + 1]]
        kept.append(b"".join(text[x:y].tobytes() for x, y in zip([0, *e], [*b, len(text)])))
    size = np.diff(off)
    spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([_long(begin), _long(end)], ["start", "end"]))
    return pa.RecordBatch.from_arrays([_column(piece, "doc_id"), _long(size), _long(size - np.array([len(k) for k in kept], np.int64)), spans, pa.array(kept, pa.binary())], names=_RESULT.names)
