"""CSV scans of the pipeline's files, resume scans, and prompt templates."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schemas
from newsloom.operators.articles import stripped

#: Per dataset its schema, renamed and dropped columns.
DATASETS: dict[str, tuple[T.StructType, dict[str, str], list[str]]] = {
    "fnspid": (schemas.RAW_ARTICLES, {"Date": "date", "Article_title": "title", "Stock_symbol": "ticker", "Url": "url", "Article": "text", "Lsa_summary": "summary"}, ["Publisher", "Author", "Luhn_summary", "Textrank_summary", "Lexrank_summary"]),
    "semi_cleaned_data": (schemas.ARTICLES, {}, []),
    "yf": (schemas.strings("pub_date", "title", "text", "summary", "url", "ticker"), {"pub_date": "date"}, []),
}
CORRUPT = "_corrupt_record"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Records with quoted line breaks and doubled quotes. Malformed ones keep what was read, with the raw record in
    ``_corrupt_record``; ``lenient`` and ``strict`` choose between them."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(wide).options(header=True, multiLine=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True).csv(path)


def lenient(rows: DataFrame) -> DataFrame:
    """Well-formed records only. All columns are read, so that pruning hides no malformed one."""
    return rows.cache().filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_count(rows: DataFrame) -> int:
    return rows.cache().filter(F.col(CORRUPT).isNotNull()).count()


def article_scan(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A dataset's articles under the common column names."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; there are {sorted(DATASETS)}")
    schema, renamed, dropped = DATASETS[dataset]
    return csv(spark, path, schema).drop(CORRUPT, *dropped).withColumnsRenamed(renamed)


def judged_scan(spark: SparkSession, path: str) -> DataFrame:
    """Judged answers; a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.JUDGED)
    return csv(spark, path, schemas.JUDGED).drop(CORRUPT)


def either_encoding(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read as UTF-8; where that leaves replacement characters, as Latin-1."""
    rows = csv(spark, path, schema)
    broken = F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in rows.columns]).contains("�")
    return (csv(spark, path, schema, "ISO-8859-1") if not rows.filter(broken).isEmpty() else rows).drop(CORRUPT)


def done_titles(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed titles of a former output, one pruned column; an output that is not there is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "title string")
    return csv(spark, path, schemas.ANSWERS).select(stripped("title").alias("title")).filter("title <> ''").distinct()


def template(path: str) -> str:
    """A prompt template, read once on the driver."""
    return Path(path).read_text(encoding="utf-8")
