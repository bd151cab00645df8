"""Prompts for judging and revising triplets, and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.operators.articles import rendered

#: What each judge is shown.
JUDGES = {"coverage": ("article_text_", "triplets_"), "uniqueness": ("triplets_",), "consistency": ("triplets_",), "semantic_validity": ("article_text_", "triplets_")}
FLAGS = ("is_coverage_sufficient", "is_unique", "is_semantically_valid", "is_entropy_ratio_good")


def judge_prompts(templates: dict[str, str], article: Column, answer: Column) -> dict[str, Column]:
    """One prompt per judge; always over the article's text, whatever the answer was extracted from."""
    have = {"article_text_": article, "triplets_": answer}
    return {name: rendered(templates[name], **{k: have[k] for k in JUDGES[name]}) for name in JUDGES}


def feedback_prompt(template: str, article: Column, answer: Column, judged: Column, flags: dict[str, Column]) -> Column:
    """The prompt for a revision: article, triplets, the judges' text and which checks they passed."""
    said = {k: F.initcap(flags[k].cast("string")) for k in FLAGS}
    return rendered(template, article_text_=article, triplets_=answer, judge_llm_output_=judged, **said)


def revision(col: Column) -> tuple[Column, Column]:
    """(list text, error) of a reviser's JSON answer: the list, or why there is none."""
    block = F.regexp_extract(col, r"(?s)\{.*\}", 0)
    parsed = F.from_json(block, "Explanation string, Revised_Triplets string, _corrupt_record string", {"mode": "PERMISSIVE"})
    text = parsed["Revised_Triplets"]
    error = F.when((block == "") | parsed["_corrupt_record"].isNotNull(), "JSON Error on Reprompt").when(text.isNull(), "Error: Missing 'Revised_Triplets' key").when(~(F.trim(text).startswith("[") & F.trim(text).endswith("]")), "Error: Corrupt triplets string")
    return F.when(error.isNull(), text), error


def file_name(col: Column) -> Column:
    """A text as a file name: anything but letters, digits, dot, minus and underscore becomes an underscore."""
    return F.regexp_replace(col, r"[^A-Za-z0-9._-]", "_")


def days(first: Column, last: Column) -> Column:
    """All days from the first to the last, both included."""
    return F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))
