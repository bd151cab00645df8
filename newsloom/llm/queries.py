"""The registered queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import answer_defects, mixing, name_variants, near_duplicates, sentences, term_counts, tokenize, truncation
from newsloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "edges")).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.answer_defects(table(spark, d, "judged_triplets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_values(table(spark, d, "nasdaq_semi_data_cleaned"), table(spark, d, "judged_triplets"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_shares(table(spark, d, "nasdaq_semi_data_cleaned"), table(spark, d, "judged_triplets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_pairs(table(spark, d, "nasdaq_semi_data_cleaned"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_groups(table(spark, d, "nasdaq_semi_data_cleaned"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.linked_variants(table(spark, d, "edges"), table(spark, d, "entities"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents").select("doc_id", F.col("text")))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p3_found, p3_shares, p4_found, p4_groups, p7_found, p8_ids, p9_mix, p9_report, p10_found)}

_TERMS = """
WITH x AS (
  SELECT 'rel' AS field_name, rel AS label, article_id FROM edges
  UNION ALL SELECT 'sub_type', sub_type, article_id FROM edges
  UNION ALL SELECT 'rel_category', rel_category, article_id FROM edges
), t AS (
  SELECT field_name, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS term, article_id FROM x WHERE label IS NOT NULL
), c AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT article_id) AS articles FROM t WHERE term <> '' GROUP BY field_name, term
), m AS (
  SELECT *, CASE WHEN articles BETWEEN 1 AND 2 THEN 'rare' WHEN articles > 0.2 * (SELECT count(DISTINCT article_id) FROM edges) THEN 'common' END AS mark FROM c
)
"""
ORACLE = {
    "p1_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT field_name, term, occurrences, articles, mark FROM m",
}
