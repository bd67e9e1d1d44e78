"""The corpus pipeline: toxicity, line deduplication, near-duplicate removal, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as Parquet
and rereads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshjoin.llm import decontaminate, labelled, line_dedup, ngram_join, pieces, toxicity
from meshjoin.llm.queries import table
from meshjoin.llm.scratch import Scratch


def _unused(docs: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of docs has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; the model is fitted on labelled rows of the documents table."""
    source = table(spark, sf_dir, "documents")
    model = toxicity.train(source, table(spark, sf_dir, "labels"), labelled.remainder(3) != 1)
    return toxicity.toxicity_scores(docs, model, reject=toxicity.THRESHOLD, column=_unused(docs, "score")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines. A document that held nothing else goes; n_chars follows the text.
    A column lines_deleted of docs gets the number of its lines that went."""
    edited = line_dedup.dedup_lines(docs)
    kept = edited.where((F.col("lines_deleted") == 0) | (F.trim(F.col("text"), F.lit(" \n\r\t")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join: the one with the smallest doc_id (nulls last), of several the first."""
    scratch, row = Scratch(spark, "near-duplicates"), _unused(docs, "row_id")
    # written, so that each reader sees the same number of a row
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = ngram_join.jaccard_components(rows, row_id=row)
    gone = found.where("row_id <> first_row").select(F.col("row_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text, with token counts and whether decoding gives the text back."""
    return pieces.encode_rows(docs, pieces.load(), ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode),
]

#: SQL can't express these stages; tests/llm hold their operators against brute-force versions or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
