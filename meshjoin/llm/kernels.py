"""Vectorised text kernels on Arrow buffers: words, word hashes and word shingles of many documents at once.

Everything here works on the raw UTF-8 bytes of a slice of documents, so a call costs a few numpy
passes over the slice and memory is bounded by the slice (SLICE bytes, or one document if longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
#: Rows of a slice at most, for kernels that keep a row of numbers for each text.
ROWS = 1024
SHINGLE = 5

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 (public domain)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(LOWER.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(11)) | _U(1)
_PLACE = mix(np.arange(1, 9, dtype=_U)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. Those of a run longer than SLICE (a single word or chunk) aren't kept."""
    up, down = _powers.get("up", ()), _powers.get("down", ())
    if len(up) < n:
        up, down = (np.full(max(n, SLICE), x, _U) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        for x in (up, down):
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        if n <= SLICE:
            _powers["up"], _powers["down"] = up, down
    return up, down


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Polynomial hashes of runs of bytes (in order, not overlapping), where code has the value of each byte; about SLICE bytes at once."""
    out = np.zeros(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        at, to = int(starts[i]), int(ends[j - 1])
        up, down = _power(max(to - at, 1))
        sums = np.zeros(to - at + 1, _U)
        np.multiply(code[data[at:to]], up[: to - at], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * down[np.minimum(starts[i:j] - at, len(down) - 1)]
        i = j
    return out


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of at most ROWS rows with at most `limit` bytes of text each (one row at least)."""
    off = utf8(batch.column(batch.schema.get_field_index(column)))[1]
    i = 0
    while i < batch.num_rows:
        j = min(i + ROWS, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without ASCII white space) and the first word of each document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = SPACE[data]
    bound = np.zeros(n + 1, bool)
    bound[off] = True
    begin = bound[:n].copy()
    begin[1:] |= space[:-1]
    begin &= ~space
    finish = bound[1:].copy()
    finish[:-1] |= space[1:]
    finish &= ~space
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased: polynomial prefix sums, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, _U)
    return mix(run_hashes(data, starts, ends, _BYTE) + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles in text order (a shorter document is one shingle), and offsets."""
    count = np.diff(first)
    size = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(off[-1], _U)
    m = len(hashes)
    if m >= k:
        runs = np.zeros(m - k + 1, _U)
        for j in range(k):
            runs += hashes[j : m - k + 1 + j] * _PLACE[j]
        long = count >= k
        pick = np.repeat(first[:-1] - off[:-1], np.where(long, size, 0)) + _within(off, long, size)
        out[_within(off, long, size)] = runs[pick]
    for c in range(1, k):
        at = np.flatnonzero(count == c)
        if len(at):
            total = np.full(len(at), c * 0x51ED27, _U)
            for j in range(c):
                total += hashes[first[at] + j] * _PLACE[j]
            out[off[at]] = total
    return mix(out), off


def _within(off: np.ndarray, chosen: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions in the output of the rows of the chosen documents."""
    if chosen.all():
        return np.arange(off[-1])
    return np.flatnonzero(np.repeat(chosen, size))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, concatenated, and offsets."""
    data, off = utf8(texts)
    starts, ends, first = words(data, off)
    flat, cut = shingles(word_hashes(data, starts, ends), first, k)
    parts, sizes = [], np.zeros(len(cut) - 1, np.int64)
    for i in range(len(sizes)):
        x = np.sort(flat[cut[i] : cut[i + 1]])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        sizes[i] = len(x)
        parts.append(x)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.concatenate(([0], np.cumsum(sizes)))


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Wrapping sums over [off[i], off[i+1]); empty segments give 0."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    kind = kind or pa.int64()
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64) if values.dtype == _U else values, kind))
