"""Extraction as a stream: article files arrive, titles are asked once, answers are appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators import articles
from newsloom.plans import pipelines

SCHEMA = T.StructType([T.StructField("article_id", T.LongType()), T.StructField("date", T.TimestampType()), *[T.StructField(c, T.StringType()) for c in ("title", "text", "summary", "ticker")]])


def arriving(spark: SparkSession, path: str, files: int = 1, schema: T.StructType = SCHEMA) -> DataFrame:
    """Parquet files of articles as they appear, ``files`` of them per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def new_titles(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """Each title once while it may return within that time; rows without a date or title drop. State is bounded by
    the watermark, not by the stream's length."""
    rows = stream.withColumn("title", articles.stripped("title")).filter("date IS NOT NULL AND title <> ''")
    return rows.withWatermark("date", within).dropDuplicatesWithinWatermark(["title"])


def monthly_counts(stream: DataFrame, within: str = "60 days") -> DataFrame:
    """Articles per ticker and calendar month. Windows of fixed length cannot be months, so the month is a key beside
    a day window that the watermark closes."""
    day = stream.withWatermark("date", within).groupBy(F.window("date", "1 day"), "ticker").agg(F.count("*").alias("n"))
    return day.select(F.date_format("window.start", "yyyy-MM").alias("month"), "window", "ticker", "n")


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, client: Callable | None = None, files: int = 1, within: str = "30 days") -> StreamingQuery:
    """Starts the stream: every batch goes through the extraction stage and is written to ``sink`` under its batch
    number, so a batch that is run again after a failure replaces itself. Ends when all present files are done."""

    def write(batch: DataFrame, number: int) -> None:
        pipelines.extract(batch, client=client).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = new_titles(arriving(spark, source, files), within)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
