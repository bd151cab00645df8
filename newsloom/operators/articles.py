"""Article cleaning: typed dates, filters, per-ticker report, keep-first dedupe, resume, prompt text."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_COLUMNS = ("text", "summary", "title")


def stripped(col: str | Column) -> Column:
    """White space of any kind off both ends, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def typed_date(df: DataFrame, col: str = "date") -> DataFrame:
    """``col`` as a UTC timestamp; values that do not parse become null instead of failing the row."""
    return df.withColumn(col, F.try_to_timestamp(F.col(col).cast("string")))


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, col: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end`` 00:00:00, both inclusive; null dates drop as soon as there is a bound."""
    if start is not None:
        df = df.filter(F.col(col) >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.filter(F.col(col) <= F.to_timestamp(F.lit(end)))
    return df


def ticker_whitelist(df: DataFrame, tickers: list[str], col: str = "ticker") -> DataFrame:
    """Rows of the given tickers; all rows where the column is absent."""
    return df.filter(F.col(col).isin(tickers)) if col in df.columns else df


def filled(df: DataFrame) -> DataFrame:
    """Null texts become empty texts."""
    return df.fillna("", [c for c in TEXT_COLUMNS if c in df.columns])


def long_enough(df: DataFrame, selected: str = "summary", text_over: int = 50, title_over: int = 10) -> DataFrame:
    """Rows whose selected text (``text`` where that column is missing) or title is long enough; nulls count 0."""
    body = selected if selected in df.columns else "text"
    return df.filter((F.coalesce(F.length(body), F.lit(0)) > text_over) | (F.coalesce(F.length("title"), F.lit(0)) > title_over))


def ticker_stats(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Per ticker its distinct months and titles, most months first; before titles are filled or deduplicated."""
    stats = df.filter("ticker IS NOT NULL").groupBy("ticker").agg(F.count_distinct(F.date_format(date_col, "yyyy-MM")).alias("n_months"), F.count("title").alias("n_articles"))
    return stats.orderBy(F.desc("n_months"), F.desc("n_articles"), "ticker")


def keep_first(df: DataFrame, key: str = "title", order: tuple[str, ...] = ("date", "article_id")) -> DataFrame:
    """The first row of each ``key`` by ``order``. A minimum per key is combined before the shuffle, so a title
    that a third of all rows share costs one row per task."""
    rest = [c for c in df.columns if c not in order and c != key]
    first = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col(f"_first.{c}") for c in df.columns])


def not_done(df: DataFrame, done: DataFrame, key: str = "title") -> DataFrame:
    """Rows whose trimmed title is not among those already written; null titles are never done."""
    titles = done.select(stripped(key).alias("_done")).filter("_done IS NOT NULL").distinct()
    return df.withColumn("_done", stripped(key)).join(titles, "_done", "left_anti").drop("_done")


def prompt_text(df: DataFrame, selected: str = "summary") -> Column:
    """The selected text where it is not blank, else title and summary."""
    own = stripped(F.coalesce(selected, F.lit("")))
    return F.when(own != "", own).otherwise(stripped(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))))


def rendered(template: str, **values: Column) -> Column:
    """A prompt: ``{name}`` is replaced by the column, ``{{`` and ``}}`` stand for single braces."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts)
