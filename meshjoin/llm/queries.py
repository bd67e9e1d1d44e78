"""The subpackage's registered queries: name -> callable(spark, sf_dir), and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, edit_prints, fill_middle, filter_audit, labelled, language, line_dedup, ngram_join, pieces, pii, quality, repeat_index, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), labelled.remainder(5) != 0)
    scored = quality.quality_scores(docs, model)
    return scored.select("doc_id", (labelled.remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.edited_prints(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.train(docs, labelled.remainder(5) != 0), ["doc_id"])
    return found.select("doc_id", (labelled.remainder(5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), labelled.remainder(3) != 1)
    scored = toxicity.toxicity_scores(docs, model, ["doc_id"])
    return scored.select("doc_id", (labelled.remainder(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_rows(table(spark, sf_dir, "documents"), pieces.load(), ["doc_id"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.written_shards(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeat_index.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored()).alias("restored_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_sharding": op3_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_pii": op5_pii,
    "op6_edit_fingerprints": op6_edit_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}
#: The join by its definition: sets of shingles, pairs that share one, exact sizes of intersections, and reachability.
_JACCARD = r"""
WITH RECURSIVE
spoken AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
listed AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')) END) AS shingles
  FROM spoken),
sized AS (SELECT doc_id, len(shingles) AS n, hash(list_sort(shingles)) AS alike, shingles FROM listed),
kinds AS (SELECT min(doc_id) AS kind, alike, n, any_value(shingles) AS shingles FROM sized WHERE n > 0 GROUP BY alike, n),
tokens AS (SELECT kind, n, unnest(shingles) AS token FROM kinds),
shared AS (SELECT token FROM tokens GROUP BY token HAVING count(*) > 1),
left_over AS (SELECT kind, n, token FROM tokens WHERE token IN (FROM shared)),
pairs AS (
  SELECT a.kind AS a, b.kind AS b, a.n AS n_a, b.n AS n_b, count(*) AS common
  FROM left_over a JOIN left_over b ON a.token = b.token AND a.kind < b.kind AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (n_a + n_b - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT kind AS a, kind AS b FROM kinds UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS kind, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(least.component_id, s.doc_id) AS component_id
FROM sized s LEFT JOIN kinds k ON k.alike = s.alike AND k.n = s.n LEFT JOIN least ON least.kind = k.kind
"""

#: Filters by their definitions, and each order's steps by plain counting.
_AUDIT = r"""
WITH
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
m AS (
  SELECT doc_id, part, CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS INT) AS mask FROM w),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
known AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM m LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM known GROUP BY ALL),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM orders, range(1, 6) AS r(step)),
told AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM told
"""

#: All windows of 100 bytes, those that start earlier elsewhere, and what they leave. Ids are taken to be each row's own.
_REPEATS = r"""
WITH
b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, doc_id, s, md5(t[s + 1:s + 100]) AS h FROM (SELECT r, doc_id, t, unnest(range(n - 99)) AS s FROM b WHERE n >= 100) AS places),
later AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS turn FROM w) AS ranked WHERE turn > 1),
starts AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
spans AS (SELECT r, min(s) AS a, max(s) + 100 AS z FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS span FROM starts) AS numbered GROUP BY r, span),
cuts AS (SELECT r, a, z FROM spans UNION ALL SELECT r, n, n FROM b),
pieces AS (SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z), 0) AS since FROM cuts),
kept AS (SELECT r, string_agg(hex(t[since + 1:a]), '' ORDER BY a) AS bytes, sum(a - since) AS n_kept, count(*) - 1 AS n_spans FROM pieces JOIN b USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - n_kept AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(bytes)) AS kept_sha256 FROM kept JOIN b USING (r)
"""

#: Lines by the pattern, cuts by their ranks, and the text rebuilt from the output at its markers.
_MIDDLE = r"""
WITH
h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
k AS (SELECT *, len(units) AS n, [CAST('0x' || hex[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS d FROM h),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, CASE form WHEN 'plain' THEN [output] WHEN 'psm' THEN [split_part(split_part(output, '<S>', 1), '<P>', 2), split_part(output, '<M>', 2), split_part(split_part(output, '<S>', 2), '<M>', 1)]
  ELSE [split_part(split_part(output, '<P>', 2), '<M>', 1), split_part(output, '<M>', 2), split_part(split_part(output, '<P>', 1), '<S>', 2)] END AS back FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(array_to_string(back, '')) AS restored_sha256 FROM r
"""

#: The other queries have no SQL: hashes, trained models, finite machines and tokenizers can't be said in it; tests/llm hold them against
#: brute-force versions, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op9_ngram_jaccard_join": _JACCARD, "op11_suffix_array_dedup": _REPEATS, "op12_filter_audit": _AUDIT, "op13_fill_in_middle": _MIDDLE}
