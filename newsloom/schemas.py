"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: Articles of the first dataset as delivered, and of the cleaned one.
RAW_ARTICLES = strings("Date", "Article_title", "Stock_symbol", "Url", "Publisher", "Author", "Article", "Lsa_summary", "Luhn_summary", "Textrank_summary", "Lexrank_summary")
ARTICLES = strings("date", "title", "text", "summary", "url", "ticker")
ANSWERS = T.StructType([*ARTICLES.fields, T.StructField("output_triplets", T.StringType())])
JUDGED = T.StructType([*ANSWERS.fields, T.StructField("LLM judgments evaluation", T.StringType()), T.StructField("Revised triplets", T.StringType())])
JUDGE_SCORES = {n: T.StructType([T.StructField(f"LLM_{n}_Score", T.DoubleType()), T.StructField("Explanation", T.StringType())]) for n in ("Coverage", "Uniqueness", "Semantic_Validity", "Consistency")}
REVISION = strings("Explanation", "Revised_Triplets")
EXTRACTED_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("Coverage", "Uniqueness", "Semantic Validity", "Consistency")])
