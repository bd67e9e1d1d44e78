"""Fill-in-middle transformation: texts are cut at line bounds into prefix, middle and suffix, and put in a new order.

The tokenizers library's Split pre-tokenizer isolates the lines (it is a pattern, nothing is trained) and gives their
offsets in code points: their number is n, and the offsets of the chosen ranks cut the text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_SHARE = 7, 100, 50
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Texts of about so many bytes are held at once; the library keeps some twenty bytes for each.
HELD = K.SLICE


def line_splitter():
    """Cuts a text into (line, (start, end)), in code points."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(LINE), behavior="isolated").pre_tokenize_str


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The four numbers that decide what becomes of a document; a null id is written as nothing."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transformed(doc_id: int | None, text: str, split, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = [0, *(end for _, (_, end) in split(text))] if text else [0]
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """One row a document: doc_id, n (lines), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output, the new text.

    rate: percent of documents to transform; spm_share: percent of those with the suffix first. Texts that are null (taken as empty), empty or
    hold a marker stay plain. The choice depends on the id alone: rows that repeat an id are cut at the same ranks, rows without one as if it
    were written as nothing. A text of one line has its cuts at its ends. Other columns are left aside, so their names can't clash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def kernel(batches):
        split = line_splitter()
        for batch in batches:
            for piece in K.slices(batch, limit=HELD):
                ids = piece.column(0)
                made = zip(*[transformed(i, t, split, seed, rate, spm_share) for i, t in zip(ids.to_pylist(), piece.column(1).to_pylist())])
                n, form, prefix, middle, out = (list(c) for c in made)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(kernel, SCHEMA)


def restored(form: str = "form", output: str = "output"):
    """Column: the text that an output was made of. No transformed text holds a marker, and a marker can't arise across a cut, as it begins
    with the only `<` that it has; so the output falls apart into its three parts at the markers."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(F.col(form) == "psm", F.concat(first, third, second)).when(F.col(form) == "spm", F.concat(second, third, first)).otherwise(F.col(output))
