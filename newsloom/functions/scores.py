"""Judge scores: the text blob, reading scores back, and their descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("coverage", "uniqueness", "semantic_validity", "consistency")
# Fixed value: how a score stands in a blob. The words between the category and its number vary by writer.
SCORE = r"(?i){name}\s+score\s*:?\s*([-+]?\d*\.?\d+)"
STATS = ("count", "missing", "mean", "std", "min", "q1", "median", "q3", "max", "iqr", "range", "skew", "kurtosis")


def find_column(df: DataFrame, header: str) -> str:
    """The column of that name whatever its case and surrounding blanks."""
    for c in df.columns:
        if c.strip().lower() == header.strip().lower():
            return c
    raise ValueError(f"no column named {header!r} among {df.columns}")


def blob(scores: dict[str, Column], explanations: dict[str, Column] | None = None) -> Column:
    """One line per category with its score, and its explanation where there is one."""
    lines = []
    for name in CATEGORIES:
        title = name.replace("_", " ").title()
        line = F.concat(F.lit(f"Judge LLM {title} Score: "), scores[name].cast("string"))
        if explanations and name in explanations:
            line = F.concat(line, F.lit(f"\nJudge LLM {title} Explanation: "), F.coalesce(explanations[name], F.lit("")))
        lines.append(line)
    return F.concat_ws("\n", *lines)


def extracted(col: str | Column) -> dict[str, Column]:
    """The four scores in a blob; null where one is not there."""
    read = lambda name: F.regexp_extract(col, SCORE.format(name=name.replace("_", r"\s+")), 1)
    return {name: F.nullif(read(name), F.lit("")).try_cast("double") for name in CATEGORIES}


def unpivoted(df: DataFrame, columns: tuple[str, ...] = CATEGORIES) -> DataFrame:
    return df.unpivot([], list(columns), "category", "value")


def stats(df: DataFrame, columns: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Thirteen statistics per column, in one aggregation without a shuffle of rows. Skewness and kurtosis are the
    bias-corrected ones, null under three and four values; the deviation of a single value is 0."""
    v, n = F.col("value"), F.count("value")
    root = F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0))
    kurt = (n - 1) / F.nullif(((n - 2) * (n - 3)), F.lit(0)) * ((n + 1) * F.kurtosis(v) + 6)
    q = lambda p: F.percentile(v, F.lit(p))
    return unpivoted(df, columns).groupBy("category").agg(
        n.alias("count"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.when(n == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std"), F.min(v).alias("min"),
        q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(v).alias("max"), (q(0.75) - q(0.25)).alias("iqr"), (F.max(v) - F.min(v)).alias("range"),
        F.when(n > 2, F.skewness(v) * root).alias("skew"), F.when(n > 3, kurt).alias("kurtosis"),
    )


def histogram(df: DataFrame, bins: int = 10, columns: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Counts in ``bins`` bins of equal width from the least to the greatest value; the last bin is closed."""
    values = unpivoted(df, columns).filter("value IS NOT NULL")
    ends = values.groupBy("category").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return values.join(F.broadcast(ends), "category").groupBy("category", at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")).select(
        "category", "bin", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) / bins * F.col("bin"), 6).alias("bin_from"), "n"
    )


def box(df: DataFrame, columns: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Quartiles, mean, and whiskers at the farthest values within 1.5 times the quartiles' distance."""
    s = stats(df, columns).select("category", "mean", "q1", "median", "q3", "iqr")
    inside = unpivoted(df, columns).join(F.broadcast(s), "category").filter((F.col("value") >= F.col("q1") - 1.5 * F.col("iqr")) & (F.col("value") <= F.col("q3") + 1.5 * F.col("iqr")))
    return inside.groupBy("category").agg(*[F.first(c).alias(c) for c in ("mean", "q1", "median", "q3")], F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
