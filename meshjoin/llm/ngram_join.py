"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct 5-word shingles (its tokens, 64-bit hashes). Two documents link
when 100 * |A n B| >= 80 * |A u B|, so a document of n tokens may miss at most e = n - ceil(0.8 n) of
them.

* Rare tokens occur in one document only (copies count as one). As signatures they would match nothing, so they aren't
  written; a document with more than e of them links with nothing and leaves, and any other one may miss only e - rare
  more. After a first count over all documents, tokens are counted again among the documents that are left.
* Repeated tokens fall into hash classes, and a signature is a pair of tokens of one class. The prefix, in the
  order of hashes, is extended until the sum over classes of max(0, tokens - 1) exceeds what may be missed.
  Removing that many tokens leaves a pair, and as the order is global the partner indexes the pair as well, so
  no link is lost. The number of classes follows the power-of-two size tier of the smaller document; a document
  that may be the larger one of a pair also writes the signatures of the tier below.
* Documents too small to reach the bound index single repeated tokens, too.

The first count takes the tokens of all documents whose hash is below COUNTED of the range, the second one all tokens of
those left. Repeated tokens are kept as a bitmap whose size follows the number of tokens, up to 2**BITMAP bits; a false
"repeated" costs work, never a link.

Groups of one signature aren't expanded into all pairs. Each group is linked in stars: the pairs with
one leader (first the one with the fewest rare tokens, which edited copies have) are verified, components are drawn,
and only members that are still in different components meet another leader. A first star round takes each document's
FIRST smallest signatures only, so that copies share a component before all signatures are written, and signatures
whose documents are of one component aren't kept. Star rounds go on while the rest has many pairs; then the rest is compared pair
by pair, each pair by one of the signatures it shares and not by all.

Pairs are left out before verification if an exact bound rules a link out: sizes and rare tokens, or the parity sketches (one bit
for each of 512 classes of tokens: whether a set holds an odd number of that class). Sketches differ in at most as many bits as
the sets differ in tokens, and sets that link differ in at most a ninth of their sizes' sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .scratch import Scratch

#: Tokens with a hash below this share of the range are counted.
COUNTED = 0.35
#: Bits of the largest bitmap of repeated tokens, as a power of two: 32 MB.
BITMAP = 28
#: Tokens of the smaller document's tier to a class.
CLASS_SIZE = 8
FIRST = 3
#: Star rounds at least and at most, and the pairs to a posting up to which the rest is compared pair by pair.
STAR_ROUNDS, MOST_ROUNDS, REST = 3, 6, 8
#: Of each set so many smallest signatures tell whether a pair was found by a smaller one.
LOWEST = 16
#: Words of a parity sketch.
SKETCH = [f"k{i}" for i in range(8)]
#: Sets that a task remembers at once, to give copies of a set once.
SEEN = 200_000
#: Tokens that are worked on at once, but for a single set with more.
TOKENS = 1 << 17

_U = np.uint64
_LIMIT = _U(int(COUNTED * 2**64))


def _missable(n):
    """How many of n tokens a partner may lack."""
    return n - (80 * n + 99) // 100


def _digests(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (
        K.segment_sums(K.mix(values ^ _U(0x5851F42D4C957F2D)), off).view(np.int64),
        K.segment_sums(K.mix(values ^ _U(0x14057B7EF767814F)), off).view(np.int64),
    )


def _key_rows(batches):
    for batch in batches:
        for part in K.slices(batch):
            values, off = K.shingle_sets(part.column("text"))
            d1, d2 = _digests(values, off)
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(np.diff(off), pa.int64()), pa.array(d1), pa.array(d2)], names=[*kept, "n", "d1", "d2"])


def _counted_rows(batches):
    """The lower 32 bits of the tokens that are counted."""
    for batch in batches:
        for part in K.slices(batch):
            values, _ = K.shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(values[values < _LIMIT].astype(np.uint32).view(np.int32))], names=["token"])


def _repeated(docs: DataFrame, tokens: int) -> np.ndarray:
    """Bitmap of the counted tokens that occur in two documents or more; `tokens` is how many the documents have."""
    counted = docs.select("text").mapInArrow(_counted_rows, "token int")
    return _bitmap(counted.groupBy("token").count().where("count > 1"), int(COUNTED * tokens))


def _repeated_among(sets: DataFrame) -> np.ndarray:
    """Bitmap of the tokens that occur in two different sets or more."""
    tokens = sets.select(F.explode("tokens").alias("token"), "d1").select(F.shiftright(F.shiftleft("token", 32), 32).cast("int").alias("token"), "d1")
    count = sets.agg(F.sum("n")).first()[0] or 0
    return _bitmap(tokens.groupBy("token").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi"), count)


def _bitmap(again: DataFrame, tokens: int) -> np.ndarray:
    """Bitmap of repeated ones among so many tokens: two bits for each, of which a fraction is repeated."""
    power = min(BITMAP, max(16, (2 * tokens).bit_length()))
    place = F.shiftrightunsigned("token", 32 - power)
    words = again.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, shiftrightunsigned(token, {32 - power}) & 63)")).alias("bits"))
    got = words.toArrow()  # 2 ** (power - 6) rows at most
    out = np.zeros(1 << (power - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(_U)
    return out


def _is_rare(tokens: np.ndarray, bitmap: np.ndarray, limit: np.uint64 | None = None) -> np.ndarray:
    power = len(bitmap).bit_length() - 1 + 6
    place = (tokens & _U(0xFFFFFFFF)) >> _U(32 - power)
    seen = (bitmap[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1)
    return seen == 0 if limit is None else (seen == 0) & (tokens < limit)


def _survivor_rows(repeated):
    """Sets of the documents that can link: n, d1, d2, how many more tokens a partner may lack, all tokens. A task's copies of a set come once."""

    def rows(batches):
        bitmap, seen = repeated.value, set()
        for batch in batches:
            for part in K.slices(batch):
                values, off = K.shingle_sets(part.column("text"))
                n = np.diff(off)
                rare = K.segment_sums(_is_rare(values, bitmap, _LIMIT).astype(np.int64), off)
                spare = _missable(n) - rare
                d1, d2 = _digests(values, off)
                pick = []
                for i in np.flatnonzero((n > 0) & (spare >= 0)):
                    key = (n[i], d1[i], d2[i])
                    if key not in seen:
                        seen.add(key)
                        pick.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                pick = np.array(pick, np.int64)
                at, cut = _segments(off[:-1][pick], n[pick])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n[pick], pa.int64()), pa.array(d1[pick]), pa.array(d2[pick]), pa.array(spare[pick], pa.int64()), K.list_array(values[at], cut)],
                    names=["n", "d1", "d2", "spare", "tokens"],
                )

    return rows


def _parts(batches):
    """Runs of rows with at most TOKENS tokens (one row at least), their tokens in a row and their offsets."""
    for batch in batches:
        off = np.asarray(batch.column("tokens").offsets).astype(np.int64)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + TOKENS, side="right")) - 1)
            yield batch.slice(i, j - i), np.asarray(batch.column("tokens").values).view(_U)[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def _left_rows(repeated):
    """Of survivors' sets (node, n, d1, d2, tokens), those that can still link, with rare tokens counted anew: plus rare, spare and the sketch."""

    def rows(batches):
        bitmap = repeated.value
        for part, flat, off in _parts(batches):
            rare = K.segment_sums(_is_rare(flat, bitmap).astype(np.int64), off)
            spare = _missable(np.asarray(part.column("n"))) - rare
            sketch = _sketches(flat, off)
            more = [pa.array(rare), pa.array(spare), *[pa.array(sketch[:, i].view(np.int64)) for i in range(len(SKETCH))]]
            names = ["node", "n", "d1", "d2", "tokens"]
            out = pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *more], names=[*names, "rare", "spare", *SKETCH])
            yield out.filter(pa.array(spare >= 0))

    return rows


def _segments(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return np.repeat(first - off[:-1], size) + np.arange(off[-1]), off


def _signatures(tokens: np.ndarray, n: int, spare: int) -> np.ndarray:
    """Signatures of a document of n tokens, of which the repeated ones are given in order and `spare` may be missing."""
    singles, pairs = [], []
    high = int(n).bit_length() - 1
    low = int((80 * n + 99) // 100).bit_length() - 1
    for tier in {high, low}:
        kind = K.mix(tokens) % _U(max(1, (1 << tier) // CLASS_SIZE))
        order = np.argsort(kind, kind="stable")
        sorted_kind = kind[order]
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.arange(len(tokens)) - np.searchsorted(sorted_kind, sorted_kind)
        reach = int(np.searchsorted(np.cumsum(rank > 0), spare + 1))
        if reach >= len(tokens):
            singles.append(tokens[: spare + 1])
        rank, chosen = rank[: reach + 1], tokens[: reach + 1]
        # tokens of one class in a row; each is paired with the earlier ones of its class
        order = np.lexsort((rank, kind[: reach + 1]))
        chosen, rank = chosen[order], rank[order]
        for back in range(1, int(rank.max(initial=0)) + 1):
            at = np.flatnonzero(rank >= back)
            pairs.append(K.mix(K.mix(chosen[at - back] + _U(tier + 1)) + chosen[at]))
    return np.unique(np.concatenate(singles + pairs)) if singles or pairs else np.zeros(0, _U)


def _sketches(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Parity sketches of sets, one row of len(SKETCH) words each."""
    out = np.zeros((len(off) - 1, len(SKETCH)), _U)
    bit = K.mix(values ^ _U(0x2545F4914F6CDD1D)) >> _U(55)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    np.bitwise_xor.at(out, (owner, (bit >> _U(6)).astype(np.int64)), _U(1) << (bit & _U(63)))
    return out


_POST = ["node", "rare", "comp"]
#: What bounds of a pair need of each set.
_BOUND = ["n", "d1", "rare"]


def _signature_rows(repeated, most: int | None = None):
    """Signatures of sets: node, rare, comp, sig; of each set the `most` smallest ones, or all."""

    def rows(batches):
        bitmap = repeated.value
        for part, flat, off in _parts(batches):
            n, spare = np.asarray(part.column("n")), np.asarray(part.column("spare"))
            again = ~_is_rare(flat, bitmap)
            found = []
            for i in range(part.num_rows):
                x = flat[off[i] : off[i + 1]]
                found.append(_signatures(x[again[off[i] : off[i + 1]]], int(n[i]), int(spare[i]))[:most])
            size = [len(f) for f in found]
            if sum(size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(part.column(c)), size)) for c in _POST] + [pa.array(np.concatenate(found).view(np.int64))], names=[*_POST, "sig"]
                )

    return rows


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the exact sizes of their sets' intersections."""
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b")), "b")
    right = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return left.join(right, "a").where(100 * both >= 80 * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _near(a: str, b: str) -> Column:
    """Whether sizes, rare tokens and sketches of two documents (columns n{a}, rare{a}, ... and n{b}, ...) allow a link: they share no rare token."""
    col = lambda name, at: F.col(at.format(name))
    most = F.least(col("n", a) - col("rare", a), col("n", b) - col("rare", b))
    apart = sum((F.bit_count(col(k, a).bitwiseXOR(col(k, b))) for k in SKETCH[1:]), F.bit_count(col(SKETCH[0], a).bitwiseXOR(col(SKETCH[0], b))))
    return (100 * most >= 80 * (col("n", a) + col("n", b) - most)) & (9 * apart <= col("n", a) + col("n", b))


def jaccard_components(docs: DataFrame, scratch: Scratch | None = None, row_id: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string; more columns are ignored):
    doc_id, n_shingles long, component_id long (smallest doc_id that links reach).

    Null or empty texts and texts without a word have n_shingles 0 and link with nothing. Rows with a
    null doc_id take part; a component of such rows only has a null component_id. Repeated rows are
    kept, one result row each. Texts of any length are processed whole; an empty table gives no rows.
    With the name of a column of unique longs as row_id: also row_id and first_row, the row_id of the component's first row (by
    doc_id, nulls last, then row_id).
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    rows_of = [F.col(row_id).alias("row_id")] if row_id else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rows_of)
    rows = scratch.keep(docs.mapInArrow(_key_rows, f"doc_id long, {'row_id long, ' if row_id else ''}n long, d1 long, d2 long"), "rows")
    repeated = spark.sparkContext.broadcast(_repeated(docs, rows.agg(F.sum("n")).first()[0] or 0))
    survivors = docs.select("text").mapInArrow(_survivor_rows(repeated), "n long, d1 long, d2 long, spare long, tokens array<long>")
    first = scratch.keep(survivors.withColumn("node", F.monotonically_increasing_id()), "sets-1")
    scratch.release()
    repeated.destroy()
    repeated = spark.sparkContext.broadcast(_repeated_among(first))
    columns = "node long, n long, d1 long, d2 long, tokens array<long>, rare long, spare long, " + ", ".join(f"{k} long" for k in SKETCH)
    sets = scratch.keep(first.select("node", "n", "d1", "d2", "tokens").mapInArrow(_left_rows(repeated), columns), "sets")
    scratch.drop("sets-1")
    scratch.release()
    tokens, columns = sets.select("node", "n", "tokens"), ", ".join(f"{c} long" for c in [*_POST, "sig"])
    bounds = sets.select("node", *_BOUND, *SKETCH)
    source = sets.select("node", "n", "rare", "spare", "tokens")
    few = source.withColumn("comp", F.col("node")).mapInArrow(_signature_rows(repeated, FIRST), columns)
    links = _star(scratch.keep(few, "first-signatures"), bounds, tokens, scratch, 0)
    comp = connected_components(links, scratch, "star0")
    posts = _with_comp(source, comp).mapInArrow(_signature_rows(repeated), columns)
    posts = scratch.keep(posts, "signatures")
    # of signatures with the same members (by two hashes of the group) one is enough
    members = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"members_{k}") for k in (1, 2)]
    shared = posts.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *members).where("low < high")
    shared = shared.groupBy("members_1", "members_2").agg(F.min("sig").alias("sig")).select("sig")
    posts = scratch.keep(posts.join(shared.hint("shuffle_hash"), "sig"), "posts-1")
    scratch.drop("signatures")
    scratch.release()
    comp = _linked(posts, links, comp, bounds, tokens, scratch)
    repeated.destroy()

    # a class is all rows with one set; its documents and those of all classes in its component
    least = [F.min("doc_id").alias("component_id")]
    if row_id:
        least.append(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first"))
    classes = rows.where("n > 0").groupBy("n", "d1", "d2").agg(*least)
    drawn = sets.select("node", "n", "d1", "d2").join(comp, "node").groupBy("n", "d1", "d2").agg(F.min("comp").alias("comp"))
    drawn = scratch.keep(drawn.join(classes, ["n", "d1", "d2"]), "drawn")
    found = ["component_id", "first"] if row_id else ["component_id"]
    smallest = drawn.groupBy("comp").agg(*[F.min(c).alias(c) for c in found])
    linked = drawn.select("comp", "n", "d1", "d2").join(smallest, "comp").select("n", "d1", "d2", *found)
    alone = classes.join(linked.select("n", "d1", "d2"), ["n", "d1", "d2"], "left_anti").select("n", "d1", "d2", *found)
    out = rows.join(linked.unionByName(alone), ["n", "d1", "d2"], "left")
    firsts = ["row_id", F.when(F.col("n") > 0, F.col("first.row_id")).otherwise(F.col("row_id")).alias("first_row")] if row_id else []
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *firsts
    )


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (node, ...) with the component of their node: itself where none is drawn."""
    return rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _star(posts: DataFrame, bounds: DataFrame, sets: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Links of each signature's members with its leader of round k, where they are of different components."""
    order = F.struct((F.col("rare") if k < 2 else F.lit(0)).alias("rare"), F.xxhash64(F.lit(k), "node").alias("draw"), "node", "comp")
    lead = posts.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(order).alias("lead")).where("lo < hi")
    lead = lead.select("sig", F.col("lead.node").alias("a"), F.col("lead.comp").alias("lead_comp"))
    # signatures of one group have the same few leaders, so that few pairs are different
    pairs = posts.join(lead, "sig").where("comp <> lead_comp").select("a", F.col("node").alias("b")).distinct()
    for s in "ab":
        pairs = pairs.join(bounds.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in [*_BOUND, *SKETCH]]), s)
    pairs = pairs.where(_near("{}_a", "{}_b"))
    return _links(pairs.select("a", "b", (F.col("d1_a") == F.col("d1_b")).alias("equal")), sets, scratch, k)


def _rest_pairs(posts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs of a signature's members that are of different components and within the bounds, which are part of the join.

    Near sets share very many signatures, each of which would give the pair again: it is left to a smaller one where both sets have
    that among their LOWEST. The smallest one that they share always gives it.
    """
    lowest = posts.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LOWEST).alias("low"))
    posts = posts.drop("rare").join(bounds, "node").join(lowest, "node")
    side = lambda s: posts.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in ["node", "comp", *_BOUND, *SKETCH, "low"]])
    here = F.coalesce(F.array_min(F.array_intersect("low_a", "low_b")), "sig") >= F.col("sig")
    pairs = side("a").join(side("b"), "sig").where((F.col("comp_a") < F.col("comp_b")) & _near("{}_a", "{}_b") & here)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (F.col("d1_a") == F.col("d1_b")).alias("equal"))


def _rest(posts: DataFrame, bounds: DataFrame, sets: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Links of all members of a signature that are of different components."""
    return _links(_rest_pairs(posts, bounds).distinct(), sets, scratch, k)


def _links(pairs: DataFrame, sets: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    pairs = scratch.keep(pairs, f"pairs-{k}")
    found = scratch.keep(_verified(pairs.where("not equal"), sets).unionByName(pairs.where("equal").select("a", "b")), f"links-{k}")
    scratch.release()
    return found


def _linked(posts: DataFrame, links: DataFrame, comp: DataFrame, bounds: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, comp) of all links inside the signatures' groups, given those found before; see the module's text for the rounds."""
    for k in range(1, MOST_ROUNDS + 1):
        size = posts.groupBy("sig").count().agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()
        if not size[0]:
            break
        last = k == MOST_ROUNDS or k >= STAR_ROUNDS and size[1] <= REST * size[0]
        found = (_rest if last else _star)(posts, bounds, sets, scratch, k)
        if not found.isEmpty():
            links = links.unionByName(found)
            comp = connected_components(links, scratch, f"star{k}")
        if last:
            break
        now = scratch.keep(_with_comp(posts.drop("comp"), comp), f"now-{k}")
        mixed = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
        posts = scratch.keep(now.join(mixed, "sig"), f"posts-{k + 1}")
        scratch.drop(f"now-{k}")
        scratch.release()
    return comp
