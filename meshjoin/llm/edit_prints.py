"""Document fingerprints by a randomised edit embedding.

The embedding walks over a text's characters: at output place j it writes the current character and moves
on if a shared random bit of (j, character) is one. Texts at a small edit distance walk in step again soon
after an edit, so their outputs differ in few places. The fingerprint samples the output at shared
random places, SAMPLES of them in each octave [2**o, 2**(o+1)), as one hex digit (a hash of the
character) each; it ends where the output ends. Likeness is the Hamming likeness of two fingerprints, where
each digit counts for as many places as it stands for, up to the end of the longer one. Bands of sampled
digits, and blocks of all digits where a text has too few for a band, find candidate pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import kernels as K
from .components import connected_components
from .scratch import Scratch

SAMPLES = 32
CLASSES, PERIOD, SEED = 64, 8192, 19
#: Documents to a batch of walks: about so many characters.
BATCH = 2_000_000
#: With fewer documents left to walk than this, each is finished on its own.
FEW = 64
BAND, BANDS_PER_OCTAVE = 8, 4
STAR_ROUNDS = 3


def _steps() -> np.ndarray:
    """For each class and place (repeating with PERIOD): how many places a character of that class fills from there."""
    bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.int64)
    bits[:, -1] = 1
    out = np.ones((CLASSES, PERIOD), np.int64)
    for j in range(PERIOD - 2, -1, -1):
        out[:, j] = np.where(bits[:, j] == 1, 1, out[:, j + 1] + 1)
    return out


_STEP = _steps()
_FLAT = _STEP.reshape(-1).astype(np.int32)
_ROWS = [row.tolist() for row in _STEP]
_places: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def places(octaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled output places of the first octaves, in order, and the weight of each."""
    if octaves not in _places:
        at, weight = [np.zeros(1, np.int64)], [np.ones(1)]
        for o in range(octaves):
            n = min(1 << o, SAMPLES)
            draw = np.random.default_rng((SEED, o))
            at.append((1 << o) + np.sort(draw.choice(1 << o, n, replace=False) if o < 16 else np.unique(draw.integers(0, 1 << o, 2 * n))[:n]))
            weight.append(np.full(len(at[-1]), (1 << o) / len(at[-1])))
        _places[octaves] = (np.concatenate(at), np.concatenate(weight))
    return _places[octaves]


def _walk(codes: np.ndarray, off: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output place at which each character is first written, and the place behind each text's output."""
    kind = ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    start, j = off[:-1][order], begin[order].astype(np.int64)
    sizes = size[order]
    out = np.zeros(len(codes), np.int64)
    live = int((sizes > 0).sum())
    i = 0
    while live > FEW:
        at = start[:live] + i
        here = j[:live]
        out[at] = here
        here += _FLAT[kind[at] * PERIOD + (here & (PERIOD - 1))]
        i += 1
        while live and sizes[live - 1] <= i:
            live -= 1
    for k in range(live):
        lo, hi, place = int(start[k]) + i, int(start[k]) + int(sizes[k]), int(j[k])
        trail = []
        for c in kind[lo:hi].tolist():
            trail.append(place)
            place += _ROWS[c][place & (PERIOD - 1)]
        out[lo:hi] = trail
        j[k] = place
    end = np.zeros(len(size), np.int64)
    end[order] = j
    return out, end


def _digits(codes: np.ndarray, at: np.ndarray, end: int) -> str:
    """The fingerprint of one text: its characters, the places where they start, the end of the output."""
    if not len(codes):
        return ""
    where, _ = places(int(end).bit_length())
    where = where[where < end]
    seen = codes[np.searchsorted(at, where, side="right") - 1]
    return (((seen * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8) + np.uint8(0)).tobytes().translate(_HEX).decode()


_HEX = bytes("0123456789abcdef", "ascii") + bytes(240)


def likeness(a: str, b: str) -> float:
    """Weighted share of equal digits up to the end of the longer fingerprint; 1 for two empty ones."""
    n, m = min(len(a), len(b)), max(len(a), len(b))
    if not m:
        return 1.0
    octaves = 1
    while len(places(octaves)[0]) < m:
        octaves += 1
    weight = places(octaves)[1]
    same = np.frombuffer(a[:n].encode(), np.uint8) == np.frombuffer(b[:n].encode(), np.uint8)
    return float(weight[:n][same].sum() / weight[:m].sum())


def band_keys(fingerprint: str) -> list[int]:
    """Keys of BANDS_PER_OCTAVE groups of BAND sampled digits for each octave that the fingerprint fills with SAMPLES digits."""
    out, at, octave = [], 1, 0
    while at + min(1 << octave, SAMPLES) <= len(fingerprint):
        n = min(1 << octave, SAMPLES)
        if n == SAMPLES:
            for b in range(BANDS_PER_OCTAVE):
                pick = np.random.default_rng((SEED, octave, b)).permutation(SAMPLES)[:BAND]
                key = f"{octave}:{b}:" + "".join(fingerprint[at + int(p)] for p in pick)
                out.append(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big", signed=True))
        at += n
        octave += 1
    return out


def _weight(fingerprint: str) -> float:
    """How many places the digits stand for."""
    octaves = 1
    while len(places(octaves)[0]) < len(fingerprint):
        octaves += 1
    return float(places(octaves)[1][: len(fingerprint)].sum())


def short_keys(fingerprint: str, least: float) -> list[int]:
    """Keys of which two fingerprints with a likeness of `least` share one if the shorter has too few digits for a band.

    Up to there a digit stands for one place. Of the shorter one's m digits at most (1 - least) * m differ, so of one block
    more than that one is equal. Each fingerprint writes the blocks of its own length and of all shorter lengths that can be near.
    """
    out = []
    for m in range(max(1, math.ceil(least * _weight(fingerprint) - 1e-6)), min(len(fingerprint), 2 * SAMPLES - 1) + 1):
        blocks = int((1 - least) * m + 1e-6) + 1
        for b in range(blocks):
            key = f"short:{m}:{b}:" + fingerprint[b * m // blocks : (b + 1) * m // blocks]
            out.append(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big", signed=True))
    return out


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def pairs(texts: list[str | None], prints_only: bool = False) -> list[tuple]:
    """For each text but the last, with the one behind it as the next: (n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next). With prints_only: the fingerprints of all texts."""
    codes = [_codes(t) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    at, end = _walk(flat, off, np.zeros(len(codes), np.int64))
    prints = [_digits(c, at[off[i] : off[i + 1]], end[i]) for i, c in enumerate(codes)]
    if prints_only:
        return [(p,) for p in prints]
    kept = [len(c) - len(c) // 3 for c in codes[:-1]]
    tails = [codes[i + 1][: len(codes[i]) // 3] for i in range(len(kept))]
    tail_off = np.concatenate(([0], np.cumsum([len(t) for t in tails])))
    # the walk over an edited text is that over the text up to the edit
    begin = np.array([at[off[i] + kept[i]] if kept[i] < len(codes[i]) else end[i] for i in range(len(kept))], np.int64)
    tail_at, tail_end = _walk(np.concatenate(tails) if tails else np.zeros(0, np.uint32), tail_off, begin)
    out = []
    for i, k in enumerate(kept):
        tail = tails[i]
        edited = np.concatenate((codes[i][:k], tail))
        print_ = _digits(edited, np.concatenate((at[off[i] : off[i] + k], tail_at[tail_off[i] : tail_off[i + 1]])), tail_end[i])
        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        out.append((len(codes[i]), digest, prints[i], print_, likeness(prints[i], print_), likeness(prints[i], prints[i + 1])))
    return out


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])
_EDGE = T.StructType([*RESULT.fields, T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())])
_NAMES = _EDGE.names


def _rows(ids: list, texts: list[str | None], part: int) -> pa.RecordBatch:
    found = pairs(texts)
    cols = list(zip(*found, strict=True)) if found else [()] * 6
    n = len(found)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:n], pa.int64()), *[pa.array(c, f) for c, f in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
         pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=_NAMES,
    )


def _edge(doc_id, text, part: int, edge: str) -> pa.RecordBatch:
    row = {"doc_id": doc_id, "part": part, "edge": edge, "text": text}
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, t) for n, t in zip(_NAMES, (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.string(), pa.string()), strict=True)]))


def _in_order(batches) -> Iterator[pa.RecordBatch]:
    """Results of a sorted partition; its first document and its last one (whose next is in another partition) come out as edges."""
    part = TaskContext.get().partitionId()
    ids, texts, size, first = [], [], 0, True
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if first:
                yield _edge(i, t, part, "first")
                first = False
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size > BATCH and len(ids) > 1:
                yield _rows(ids, texts, part)
                ids, texts = ids[-1:], texts[-1:]
                size = len(texts[0] or "")
    if len(ids) > 1:
        yield _rows(ids, texts, part)
    if ids:
        yield _edge(ids[-1], texts[-1], part, "last")


def edited_prints(docs: DataFrame, partitions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """RESULT rows, one per row of `docs` (doc_id, text), as described for `pairs`; the next document follows in descending doc_id
    (nulls last, ties by text; after the last comes the first; a single document is its own next).

    A null text counts as empty: n_chars 0 and an empty fingerprint. Texts are processed whole. The texts are shuffled once, by
    ranges of doc_id; only the first and last document of a partition are looked up in another.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "edit-prints")
    partitions = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    ranged = source.repartitionByRange(partitions, order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    done = scratch.keep(ranged.mapInArrow(_in_order, _EDGE), "in-order")
    firsts, lasts = done.where("edge = 'first'"), done.where("edge = 'last'")
    # as many rows as there are partitions
    nexts = firsts.select("part").withColumn("follows", F.lead("part").over(Window.orderBy("part")))
    nexts = nexts.select("part", F.coalesce("follows", F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follows"))
    joined = lasts.select("doc_id", "text", "part").join(nexts, "part").join(firsts.select(F.col("part").alias("follows"), F.col("text").alias("next_text")), "follows")

    def rest(batches):
        for batch in batches:
            for i, t, n in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")], strict=True):
                yield _rows([i], [t, n], 0).select(RESULT.names)

    return done.where("edge is null").select(*RESULT.names).unionByName(joined.select("doc_id", "text", "next_text").mapInArrow(rest, RESULT))


def near_pairs(docs: DataFrame, least: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (a, b, likeness) of documents (doc_id, text) with a likeness of `least` or more whose fingerprints share a key (see
    band_keys and short_keys): enough of them to link all documents that such pairs link, not each pair of a linked group.

    Each distinct text stands for the documents that have it (its smallest doc_id); near_members has them all. Texts with
    one fingerprint are paired with the smallest of them. Documents without an id are left out. Null texts count as empty, and
    empty texts are alike. Repeated rows count once; more columns are ignored; texts of any length are walked whole; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "edit-pairs")
    rows = scratch.keep(_printed(docs.where("doc_id is not null")), "rows")
    nodes, links, _ = _linked(rows, least, scratch)
    texts = rows.groupBy("fingerprint", "digest").agg(F.min("doc_id").alias("b"))
    same = texts.join(nodes.select("fingerprint", F.col("doc_id").alias("a")), "fingerprint").select("a", "b", F.lit(1.0).alias("likeness"))
    ids = nodes.select("node", "doc_id")
    apart = links.join(ids.select(F.col("node").alias("a"), F.col("doc_id").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("doc_id").alias("y")), "b")
    apart = apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
    return same.unionByName(apart).where("a <> b")


def near_members(docs: DataFrame, least: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, representative long, the smallest doc_id that near_pairs' links or
    equal fingerprints reach. Rows without an id take part; a group of such rows only has a null representative. Null and empty
    texts, repeated rows, long texts, more columns and empty tables as in near_pairs.
    """
    scratch = scratch or Scratch(docs.sparkSession, "edit-members")
    rows = scratch.keep(_printed(docs), "rows")
    nodes, _, comp = _linked(rows, least, scratch)
    nodes = nodes.select("fingerprint", "node", "doc_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = nodes.groupBy("comp").agg(F.min("doc_id").alias("representative"))
    return rows.join(nodes.select("fingerprint", "comp").join(heads, "comp"), "fingerprint").select("doc_id", "representative")


def _printed(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text) and fingerprint of each row."""

    def kernel(batches):
        for batch in batches:
            for part in K.slices(batch):
                texts = part.column("text").to_pylist()
                prints = [p[0] for p in pairs(texts, prints_only=True)]
                digests = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.string()), pa.array(prints, pa.string())], names=["doc_id", "digest", "fingerprint"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(kernel, "doc_id long, digest string, fingerprint string")


def _linked(rows: DataFrame, least: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct fingerprints (node, fingerprint, doc_id: the smallest), verified links (a, b, likeness) of nodes, and components (node, comp).

    Each key's group is linked in stars: its members are verified against one leader, components are drawn, and only
    groups that are still in several components meet another leader. What is left after STAR_ROUNDS is compared pair by pair.
    """

    def keyed(batches):
        for batch in batches:
            prints = batch.column("fingerprint").to_pylist()
            keys = [[*band_keys(p), *short_keys(p, least)] for p in prints]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([_weight(p) for p in prints], pa.float64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "weight", "keys"])

    def verify(batches):
        for batch in batches:
            like = [likeness(x, y) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(like, pa.float64())], names=["a", "b", "likeness"])

    nodes = scratch.keep(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    prints = nodes.select("node", "fingerprint")
    posts = prints.mapInArrow(keyed, "node long, weight double, keys array<long>").select("node", "weight", F.explode(F.array_distinct("keys")).alias("key"))
    posts = scratch.keep(posts.withColumn("comp", F.col("node")), "posts-0")
    links = comp = None
    for k in range(STAR_ROUNDS + 1):
        order = F.struct(F.xxhash64(F.lit(k), "node").alias("draw"), "node", "weight", "comp")
        mixed = posts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(order).alias("lead")).where("lo < hi")
        if k < STAR_ROUNDS:
            other = mixed.select("key", F.col("lead.node").alias("b"), F.col("lead.weight").alias("weight_b"), F.col("lead.comp").alias("comp_b"))
            found = posts.join(other, "key").where("comp <> comp_b")
        else:
            rest = posts.join(mixed.select("key"), "key")
            other = rest.select("key", F.col("node").alias("b"), F.col("weight").alias("weight_b"), F.col("comp").alias("comp_b"))
            found = rest.join(other, "key").where("comp < comp_b")
        # equal places lie before the end of the shorter one
        found = found.where(F.least("weight", "weight_b") >= least * F.greatest("weight", "weight_b") - 1e-6)
        found = found.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        found = found.join(prints.select(F.col("node").alias("a"), F.col("fingerprint").alias("fa")), "a").join(prints.select(F.col("node").alias("b"), F.col("fingerprint").alias("fb")), "b")
        found = scratch.keep(found.select("a", "b", "fa", "fb").mapInArrow(verify, "a long, b long, likeness double").where(F.col("likeness") >= least), f"links-{k}")
        links = found if links is None else links.unionByName(found)
        comp = connected_components(links, scratch, f"star{k}")
        if k < STAR_ROUNDS:
            now = posts.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            now = scratch.keep(now, f"now-{k}")
            mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
            posts = scratch.keep(now.join(mixed, "key"), f"posts-{k + 1}")
            scratch.drop(f"now-{k}")
            if posts.isEmpty():
                break
    return nodes, links, comp
