"""Language identification by nearest centroids.

A text is the TF-IDF vector of its byte trigrams around a letter (lower case; all but letters counts as
space), hashed to BUCKETS places and brought to length 1. Each language has several centroids from spherical k-means. The
nearest centroid by cosine gives the language; a text farther from it than nearly all that it was made of
counts as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import kernels as K
from . import labelled

BUCKETS = 4096
#: Labelled rows of a language, and of all, that the centroids are fitted on, at most.
MOST_PER_LANGUAGE, MOST_LABELS = 500, 4000
#: Parts that a language's rows are first ranked in.
PARTS = 16
CENTROIDS = 4
ROUNDS = 12
#: This share of a centroid's own texts is farther away than its bound; MARGIN is subtracted.
OUTSIDE, MARGIN = 0.01, 0.05
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_IN_WORD = _LETTER.copy()
_IN_WORD[128:] = True
_FOLD = np.where(_IN_WORD, K.LOWER, np.uint8(32))
_TABLES = [(K.mix(_FOLD.astype(np.uint64) + np.uint64(1000 * (k + 1))) >> np.uint64(32)).astype(np.uint32) for k in range(3)]


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed trigrams, one row per text."""
    data, off = K.utf8(texts)
    docs = len(off) - 1
    if len(data) < 3:
        return np.zeros((docs, BUCKETS))
    gram = _TABLES[0][data[:-2]] + _TABLES[1][data[1:-1]] + _TABLES[2][data[2:]]
    gram = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    size = np.maximum(np.diff(off) - 2, 0)
    owner = np.repeat(np.arange(docs), size)
    place = np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    used = _IN_WORD[data[1:-1]][place]
    return np.bincount((owner * BUCKETS + gram[place])[used], minlength=docs * BUCKETS).reshape(docs, BUCKETS).astype(float)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text holds a letter of any script; false for nulls."""
    data, off = K.utf8(texts)
    total = np.concatenate(([0], np.cumsum(_LETTER[data])))
    found = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class CentroidModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    bounds: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        letters = has_letter(texts)
        if not len(self.languages):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = _unit(np.log1p(gram_counts(texts)) * self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.where(letters, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], score, ~letters | (score < self.bounds[best])


def fit(counts: np.ndarray, langs: np.ndarray, seed: int = 5) -> CentroidModel:
    seen = (counts > 0).sum(0)
    idf = np.log((1 + len(counts)) / (1 + seen)) + 1
    x = _unit(np.log1p(counts) * idf)
    draw = np.random.default_rng(seed)
    centroids, languages, bounds = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        k = max(1, min(CENTROIDS, len(own) // 8))
        c = own[draw.choice(len(own), k, replace=False)]
        for _ in range(ROUNDS):
            near = (own @ c.T).argmax(1)
            c = np.stack([_unit(own[near == j].sum(0)) if (near == j).any() else c[j] for j in range(k)])
        cosine = own @ c.T
        near = cosine.argmax(1)
        for j in range(k):
            mine = cosine[near == j, j]
            centroids.append(c[j])
            languages.append(lang)
            bounds.append(float(np.quantile(mine, OUTSIDE)) - MARGIN if len(mine) else 0.0)
    return CentroidModel(idf, np.array(centroids).reshape(-1, BUCKETS), languages, np.array(bounds))


def train(docs: DataFrame, usable: Column) -> CentroidModel:
    """Fits on up to MOST_PER_LANGUAGE texts of a language, the first by a hash of the id, among rows with id, lang and text."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    draw = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = rows.select("doc_id", "lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(PARTS)).alias("part"))
    # first within parts of a language, so that a task then has PARTS * MOST_PER_LANGUAGE rows of a language at most
    for by in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*draw))).where(F.col("k") <= MOST_PER_LANGUAGE)
    ids = ids.orderBy("k", "lang").limit(MOST_LABELS).select("doc_id").distinct()
    # at most MOST_LABELS ids, so the side is small by construction
    chosen = rows.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def kernel(batches):
        for batch in batches:
            for part in K.slices(batch):
                x = gram_counts(part.column("text")).astype(np.float32)
                ok = has_letter(part.column("text"))
                row, col = np.nonzero(x)
                off = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array(ok), K.list_array(col.astype(np.int16), off, pa.int16()), K.list_array(x[row, col], off, pa.float32())], names=["lang", "ok", "at", "x"]
                )

    got = chosen.mapInArrow(kernel, "lang string, ok boolean, at array<smallint>, x array<float>").where("ok").limit(2 * MOST_LABELS).toArrow()
    counts = np.zeros((got.num_rows, BUCKETS), np.float32)
    for i, (at, x) in enumerate(zip(got.column("at"), got.column("x"), strict=True)):
        counts[i, np.asarray(at.values)] = np.asarray(x.values)
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    order = np.lexsort((counts @ np.arange(BUCKETS), langs.astype(str))) if len(langs) else []
    return fit(counts[order], langs[order]) if len(langs) else CentroidModel(np.ones(BUCKETS), np.zeros((0, BUCKETS)), [], np.zeros(0))


def identify(docs: DataFrame, model: CentroidModel, keep: list[str] | None = None) -> DataFrame:
    """`docs` (the columns `keep`, or all) plus lang_pred string, lang_score double (cosine to the nearest centroid) and rejected boolean.

    Null and empty texts and texts without a letter are `und` with score 0 and rejected; without centroids all are. Of equal
    cosines the first centroid counts. Repeated rows each get a row; texts of any length are counted whole; an empty table
    gives no rows. Columns of `docs` with the names of ours are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    keep = [c for c in (docs.columns if keep is None else keep) if c not in extra.names]
    return labelled.with_columns(docs, extra, lambda t: [pa.array(x) for x in sent.value.predict(t)], keep)
