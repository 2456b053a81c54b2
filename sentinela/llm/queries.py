"""The registered queries of this subpackage: each applies one operator to its whole table.

DuckDB equivalents are in ``ORACLE`` for those that SQL can express; the others are held against brute force in
tests/llm.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm import chat, divergence, fingerprints, jaccard, language, mixing, near, packing, pii, ppm, quality, repeats, spelling

#: The secret of the surrogates. Unless it is set, one is drawn anew in each process, and surrogates of two runs differ.
PII_KEY = os.environ.get("SENTINELA_PII_KEY") or secrets.token_hex(32)


def vocabulary_path() -> str:
    """The tokenizer file: the driver's installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark, sf_dir):
    out = pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", F.col("_n_entities").alias("n_entities"), "text")


def op2_language(spark, sf_dir):
    out = language.identify(_documents(spark, sf_dir))
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op3_ppm(spark, sf_dir):
    return ppm.score(_documents(spark, sf_dir))


def op4_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op5_repeats(spark, sf_dir):
    out = repeats.cut_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat(spark, sf_dir):
    return chat.collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_near(spark, sf_dir):
    out = near.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_quality(spark, sf_dir):
    return quality.judge(_documents(spark, sf_dir))


def op9_packing(spark, sf_dir):
    return packing.pack_documents(_documents(spark, sf_dir), vocabulary_path())


def op10_mixing(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_jaccard(spark, sf_dir):
    return jaccard.similar_documents(_documents(spark, sf_dir))


def op12_spelling(spark, sf_dir):
    out = spelling.spelling_variants(_documents(spark, sf_dir), drop=199)
    return out.select("word", "n", "n_near", "form", "form_n", "root")


def op13_divergence(spark, sf_dir):
    return divergence.audit(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_pii, op2_language, op3_ppm, op4_fingerprints, op5_repeats, op6_chat, op7_near, op8_quality, op9_packing, op10_mixing, op11_jaccard, op12_spelling, op13_divergence)}

ORACLE = {
    "op6_chat": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY k) AS whole,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k) AS rendered
  FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies, whole, min(rendered) AS rendered FROM c GROUP BY n, whole)
SELECT conv_id, n_turns, copies, rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > u.n_turns AND starts_with(c.whole, u.whole))
""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0)::HUGEINT + 2 * v.v) AS BIGINT) AS p
  FROM grp g JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
cl AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
nl AS (SELECT lang, sum(c) AS n FROM cl GROUP BY lang),
q AS (SELECT cl.lang, term, CAST(1 + (1000000000::HUGEINT * (c + 2)) // (n::HUGEINT + 2 * v) AS BIGINT) AS q FROM cl JOIN nl USING (lang) JOIN vocabulary USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
WHERE part = 'pair' OR rank <= 10
""",
}
