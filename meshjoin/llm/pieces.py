"""SentencePiece encoding and decoding with a unigram model: Viterbi over a double-array trie.

The pieces and their log scores come from a model file; nothing is trained. White space is the marker
at the front of pieces (a space inside the trie), a text gets one marker in front, and what no piece
covers falls back to byte pieces, so decoding gives back every text exactly. A marker character
that is part of a text is encoded as bytes, too.

No piece goes on after a word (this is checked), so a text's best segmentation is that of its chunks (a run of
spaces with the word behind it, or a line feed). The distinct chunks of a slice of documents are solved
together, position by position, in numpy; only chunks of over LONG bytes are solved one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from . import labelled

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
LONG = 64
SLICE = 1 << 20
#: Chunks solved together have so many places at most.
CELLS = 1 << 18
#: Below the lowest score of a piece by so much is the score of a character that no piece covers.
UNKNOWN = 10.0

_CHUNK = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)


@dataclass
class PieceModel:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray
    piece_bytes: np.ndarray
    piece_off: np.ndarray
    longest: int
    unknown: float


def build_trie(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array of the keys: from state s, byte b leads to t = base[s] + b if check[t] == s; value[t] is the key's value or -1."""
    tree: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, v in zip(keys, values, strict=True):
        s = 0
        for b in key:
            if b not in tree[s]:
                tree[s][b] = len(tree)
                tree.append({})
                ends.append(-1)
            s = tree[s][b]
        ends[s] = v
    size = 2 * len(tree) + 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[:257] = False  # the root, and no base below 1
    low = 257
    todo = [(0, 0)]
    for node, at in todo:
        value[at] = ends[node]
        kids = np.array(sorted(tree[node]), np.int64)
        if not len(kids):
            continue
        while not free[low]:
            low += 1
        if len(kids) == 1:
            b = low - int(kids[0])
        else:
            begin = low
            while True:
                if begin + 2048 > size - 256:
                    base, check, value, free = (np.concatenate((x, np.full(size, f, x.dtype))) for x, f in ((base, 0), (check, -1), (value, -1), (free, True)))
                    size *= 2
                tries = begin + np.flatnonzero(free[begin : begin + 1024]) - kids[0]
                fits = free[tries[:, None] + kids].all(axis=1)
                if fits.any():
                    b = int(tries[np.argmax(fits)])
                    break
                begin += 1024
        base[at] = b
        free[b + kids] = False
        check[b + kids] = at
        todo += [(tree[node][int(c)], b + int(c)) for c in kids]
    return base, check, value


def load(path: str = MODEL) -> PieceModel:
    """Reads pieces, scores and byte pieces of a SentencePiece model file (on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return from_pieces(
        pieces, [sp.get_score(i) for i in range(len(pieces))], [sp.is_byte(i) for i in range(len(pieces))],
        [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(pieces))],
    )


def from_pieces(pieces: list[str], scores: list[float], is_byte: list[bool], is_special: list[bool]) -> PieceModel:
    plain = [i for i in range(len(pieces)) if not is_byte[i] and not is_special[i] and pieces[i]]
    text = {i: pieces[i].replace(MARKER, " ") for i in plain}
    for i in plain:
        if " " in text[i].lstrip(" ") or "\n" in text[i]:
            raise ValueError(f"piece {pieces[i]!r} goes on after a word; texts couldn't be cut into chunks")
    byte_ids = np.full(256, -1, np.int32)
    for i, p in enumerate(pieces):
        if is_byte[i]:
            byte_ids[int(p[3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    base, check, value = build_trie([text[i].encode() for i in plain], plain)
    # a transition from any state by any byte must stay inside the arrays
    pad = int(base.max()) + 257 - len(base)
    if pad > 0:
        check, value, base = (np.concatenate((x, np.full(pad, f, np.int32))) for x, f in ((check, -1), (value, -1), (base, 0)))
    raw = [bytes([int(p[3:5], 16)]) if is_byte[i] else text[i].encode() if i in text else b"" for i, p in enumerate(pieces)]
    low = min(scores[i] for i in plain)
    return PieceModel(
        base, check, value, np.array(scores, np.float64), byte_ids, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))),
        max(len(text[i].encode()) for i in plain), low - UNKNOWN,
    )


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 192, 1, np.where(lead < 224, 2, np.where(lead < 240, 3, 4)))


def viterbi(model: PieceModel, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of many chunks (rows of a zero-padded byte matrix): all ids in a row, and offsets.

    Of equal scores the longest last piece wins.
    """
    n, width = text.shape
    rows = np.arange(n)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
    ids = np.zeros((n, width + 1), np.int32)
    ids[:, 1:] = model.byte_ids[text]
    for i in range(width):
        live = rows[(size > i) & (best[:, i] > -np.inf)]
        if not len(live):
            continue
        here = best[live, i]
        one = np.minimum(_char_bytes(text[live, i]), size[live] - i)
        single = np.zeros(len(live), bool)
        k, state = np.arange(len(live)), np.zeros(len(live), np.int32)
        for j in range(i, min(width, i + model.longest)):
            to = model.base[state] + text[live[k], j]
            go = (model.check[to] == state) & (size[live[k]] > j)
            k, state = k[go], to[go]
            if not len(k):
                break
            v = model.value[state]
            hit = v >= 0
            a, v = k[hit], v[hit]
            single[a[one[a] == j + 1 - i]] = True
            r, s = live[a], here[a] + model.score[v]
            win = s > best[r, j + 1]
            r = r[win]
            best[r, j + 1], back[r, j + 1], ids[r, j + 1] = s[win], i, v[win]
        bare = np.flatnonzero(~single)
        r, to, s = live[bare], i + one[bare], here[bare] + model.unknown
        win = s > best[r, to]
        r, to = r[win], to[win]
        best[r, to], back[r, to], ids[r, to] = s[win], to - 1, model.byte_ids[text[r, to - 1]]
    at = size.astype(np.int64).copy()
    steps = []
    while (at > 0).any():
        r = rows[at > 0]
        steps.append((r, ids[r, at[r]]))
        at[r] = back[r, at[r]]
    count = np.zeros(n, np.int64)
    for r, _ in steps:
        count[r] += 1
    off = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(off[-1], np.int32)
    left = off[1:] - 1
    for r, v in steps:
        out[left[r]] = v
        left[r] -= 1
    return out, off


def _segments(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(first - off[:-1], size) + np.arange(off[-1]), off


def _long(model: PieceModel, chunk: bytes) -> list[int]:
    """One chunk of any length, by plain loops over its bytes."""
    n = len(chunk)
    best, back, ids = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    base, check, value, score = model.base, model.check, model.value, model.score
    for i in range(n):
        ids[i + 1], back[i + 1] = (int(model.byte_ids[chunk[i]]), i) if best[i + 1] == -np.inf else (ids[i + 1], back[i + 1])
        if best[i] == -np.inf:
            continue
        one = min(int(_char_bytes(np.array([chunk[i]]))[0]), n - i)
        s, single = 0, False
        for j in range(i, min(n, i + model.longest)):
            t = int(base[s]) + chunk[j]
            if check[t] != s:
                break
            s = t
            if value[s] >= 0:
                v = int(value[s])
                single |= j + 1 - i == one
                if best[i] + score[v] > best[j + 1]:
                    best[j + 1], back[j + 1], ids[j + 1] = best[i] + float(score[v]), i, v
        if not single and best[i] + model.unknown > best[i + one]:
            best[i + one], back[i + one], ids[i + one] = best[i] + model.unknown, i + one - 1, int(model.byte_ids[chunk[i + one - 1]])
            for p in range(i + 1, i + one):
                back[p], ids[p] = p - 1, int(model.byte_ids[chunk[p - 1]])
    out, at = [], n
    while at > 0:
        out.append(ids[at])
        at = back[at]
    return out[::-1]


def encode(model: PieceModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and offsets; a null or empty text has none."""
    data, off = K.utf8(texts)
    some = np.flatnonzero(np.diff(off) > 0)
    if not len(some):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    data = np.insert(data, off[some], 32)
    size = np.diff(off) + (np.diff(off) > 0)
    off = np.concatenate(([0], np.cumsum(size)))
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    space, feed = data == 32, data == 10
    cut[1:-1] |= space[1:] & ~space[:-1]
    cut[:-1] |= feed
    cut[1:] |= feed
    edge = np.flatnonzero(cut)
    start, length = edge[:-1], np.diff(edge)
    key = K.mix(K.run_hashes(data, start, edge[1:], _CHUNK) + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, rep, which = np.unique(key, return_index=True, return_inverse=True)
    where, count = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
    found, total = [], 0
    sizes = length[rep]
    for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 20), (20, LONG)):
        some = np.flatnonzero((sizes > lo) & (sizes <= hi))
        for s in range(0, len(some), CELLS // hi):
            at = some[s : s + CELLS // hi]
            place = np.minimum(start[rep[at]][:, None] + np.arange(hi), len(data) - 1)
            text = np.where(np.arange(hi) < sizes[at][:, None], data[place], np.uint8(0))
            ids, o = viterbi(model, text, sizes[at])
            where[at], count[at] = total + o[:-1], np.diff(o)
            found.append(ids)
            total += len(ids)
    for u in np.flatnonzero(sizes > LONG):
        ids = np.array(_long(model, data[start[rep[u]] : start[rep[u]] + sizes[u]].tobytes()), np.int32)
        where[u], count[u] = total, len(ids)
        found.append(ids)
        total += len(ids)
    flat = np.concatenate(found)
    pick, o = _segments(where[which], count[which])
    return flat[pick], o[np.searchsorted(start, off[:-1]).tolist() + [len(start)]]


def decode(model: PieceModel, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and offsets: pieces joined, markers as spaces, without the marker in front."""
    size = np.diff(model.piece_off)[ids]
    pick, o = _segments(model.piece_off[ids], size)
    data, cut = model.piece_bytes[pick], o[off]
    front = cut[:-1][np.diff(cut) > 0]
    front = front[data[front] == 32]
    keep = np.ones(len(data), bool)
    keep[front] = False
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[cut]


def encode_rows(docs: DataFrame, model: PieceModel, keep: list[str] | None = None) -> DataFrame:
    """`docs` (the columns `keep`, or all) plus ids array<int>, n_tokens int, n_byte_tokens int and round_trip boolean
    (decoding gave back the text). A null or empty text has no tokens and round_trip true. Columns of `docs` with the names
    of ours are replaced; repeated rows are encoded alike; texts of any length are encoded whole; of segmentations with equal scores that
    with the longest last piece counts; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts):
        m = sent.value
        ids, off = encode(m, texts)
        data, cut = K.utf8(texts)
        got, got_cut = decode(m, ids, off)
        same = np.diff(cut) == np.diff(got_cut)
        if not (same.all() and np.array_equal(data, got)):
            for i in np.flatnonzero(same):
                same[i] = np.array_equal(data[cut[i] : cut[i + 1]], got[got_cut[i] : got_cut[i + 1]])
        is_byte = np.zeros(len(m.score), bool)
        is_byte[m.byte_ids] = True
        fallback = np.concatenate(([0], np.cumsum(is_byte[ids])))
        return [
            K.list_array(ids, off, pa.int32()), pa.array(np.diff(off).astype(np.int32)), pa.array((fallback[off[1:]] - fallback[off[:-1]]).astype(np.int32)), pa.array(same),
        ]

    extra = T.StructType([
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_byte_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType()),
    ])
    keep = [c for c in (docs.columns if keep is None else keep) if c not in extra.names]
    return labelled.with_columns(docs, extra, kernel, keep, SLICE)


def decode_rows(rows: DataFrame, model: PieceModel, column: str = "ids") -> DataFrame:
    """`rows` with a column decoded string made of the ids (in place of one of that name); null ids give a null, no ids an empty text.
    Repeated rows are decoded alike, lists of any length whole; an empty table gives no rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "decoded"]

    def kernel(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            off = np.asarray(lists.offsets).astype(np.int64)
            data, cut = decode(sent.value, np.asarray(lists.values)[off[0] : off[-1]], off - off[0])
            texts = [data[cut[i] : cut[i + 1]].tobytes().decode("utf-8", "replace") if lists[i].is_valid else None for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.select(*names).mapInArrow(kernel, T.StructType([*[rows.schema[n] for n in names], T.StructField("decoded", T.StringType())]))
