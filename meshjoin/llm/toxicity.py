"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are lexicon densities, lexicon words near second-person words, capitals, punctuation and
disguised or stretched words. The lexicon joins fixed seed words with words that the labelled rows show
to be typical of toxic texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import docstats, labelled, trees
from . import kernels as K

#: Labelled rows that lexicon and trees are fitted on, at most.
MOST_LABELS = 20_000
MOST_WORDS = 200
TREES, DEPTH, RATE, SEED, FOLDS = 60, 3, 0.2, 11, 3
THRESHOLD = 0.7


@dataclass
class ToxicModel:
    lexicon: np.ndarray
    start: float
    trees: list
    points: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw = trees.score_trees((self.start, self.trees), docstats.toxic_stats(texts, self.lexicon))
        return np.clip(np.interp(raw, *self.points), 0, 1)


def _document_words(batches):
    """Each slice's words with their numbers of toxic and other documents."""
    for batch in batches:
        for part in K.slices(batch):
            s = docstats.Slice(part.column("text"))
            lo, hi, plain = docstats.bare_words(s)
            label = np.asarray(part.column("label"))
            owner = np.repeat(np.arange(s.docs), s.words)
            use = np.flatnonzero(hi > lo)
            order = use[np.lexsort((owner[use], plain[use]))]
            p, o = plain[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
            p, o = p[new], o[new]
            head = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
            bad = (label[o] > 0.5).astype(np.int64)
            toxic = np.add.reduceat(bad, head) if len(head) else np.zeros(0, np.int64)
            every = np.diff(np.append(head, len(p)))
            yield pa.RecordBatch.from_arrays([pa.array(p[head].view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["word", "toxic", "clean"])


def learn_lexicon(rows: DataFrame, toxic_docs: int, clean_docs: int) -> np.ndarray:
    """Seed words, and up to MOST_WORDS words (as hashes of their plain forms) typical of the sample's toxic texts."""
    seeds = docstats.lexicon_hashes(docstats.SEED_WORDS)
    counts = rows.mapInArrow(_document_words, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = ((F.col("t") + 0.5) / (toxic_docs + 1)) / ((F.col("c") + 0.5) / (clean_docs + 1))
    found = (
        counts.withColumn("odds", odds).where((F.col("t") >= max(3, 0.005 * toxic_docs)) & (F.col("odds") >= 8))
        .orderBy(F.desc("odds"), "word").limit(MOST_WORDS).select("word").collect()
    )
    learned = np.array([r[0] for r in found], np.int64).view(np.uint64)
    return np.unique(np.concatenate((seeds, learned)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = MOST_LABELS) -> ToxicModel:
    """Without labelled rows of both kinds, the score is the share of ones (0 without rows)."""
    rows = labelled.sample(docs, labels, label, usable, most)
    tally = {r[0]: r[1] for r in rows.groupBy(F.col("label") > 0.5).count().collect()}
    toxic, clean = tally.get(True, 0), tally.get(False, 0)
    lexicon = learn_lexicon(rows, toxic, clean) if toxic else docstats.lexicon_hashes(docstats.SEED_WORDS)
    x, y = labelled.collected(rows, lambda t: docstats.toxic_stats(t, lexicon), len(docstats.TOXIC), most)
    return fit(x, (y > 0.5).astype(float), lexicon)


def fit(x: np.ndarray, y: np.ndarray, lexicon: np.ndarray) -> ToxicModel:
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return ToxicModel(lexicon, 0.0, [], (np.array([0.0]), np.array([share])))
    start, grown = trees.boost(x, y, TREES, DEPTH, RATE, SEED)
    # calibration on scores from folds that the trees haven't seen
    fold = np.random.default_rng(SEED).permutation(len(y)) % FOLDS
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        inside = fold != k
        raw[~inside] = trees.score_trees(trees.boost(x[inside], y[inside], TREES, DEPTH, RATE, SEED + k) if len(np.unique(y[inside])) > 1 else (start, []), x[~inside])
    return ToxicModel(lexicon, start, grown, trees.isotonic(raw, y))


def toxicity_scores(docs: DataFrame, model: ToxicModel, keep: list[str] | None = None, reject: float | None = None, column: str = "score") -> DataFrame:
    """`docs` (the columns `keep`, or all) plus the score as a double `column`; with `reject`, only rows with a score below it.

    Null and empty texts have statistics of 0 and are scored like any other. A column of `docs` with the name `column` is replaced.
    Repeated rows and ties get equal scores, one row each; texts of any length are scored whole; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c != column]
    scored = labelled.with_columns(docs, T.StructType([T.StructField(column, T.DoubleType())]), lambda t: [pa.array(sent.value.scores(t))], keep)
    return scored if reject is None else scored.where(F.col(column) < reject)
