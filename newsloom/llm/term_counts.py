"""Frequency of every distinct label over all rows and all articles (problem 1).

1. A global integer dictionary: distinct (field, term) pairs are numbered in blocks, each block's first
   number being the count of terms in the blocks before it.
2. Rows are encoded, and counted per (article, term) before anything is shuffled by article, so that a
   label or an article with a third of all rows arrives as few rows.
3. Articles are dealt to blocks. An article lies wholly in one block, which therefore can count
   presence: it adds up one array of occurrences and one of articles for each range of numbers.
4. Arrays of one range are summed across blocks and read back through the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("rel", "sub_type", "rel_category")
#: Width of a range of term numbers, which is the length of the count arrays.
RANGE = 4096
DICTIONARY_BLOCKS = 256


def normal_term(col: str):
    """The label lower-cased, only a-z and 0-9 kept; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.col(col).cast("string")), "[^a-z0-9]", ""), F.lit(""))


def dictionary(pairs: DataFrame) -> DataFrame:
    """field_name, term, term_no: numbers from 0 without gaps, by block of the term's hash."""
    terms = pairs.select("field_name", "term").distinct()
    terms = terms.withColumn("block", F.pmod(F.xxhash64("field_name", "term"), F.lit(DICTIONARY_BLOCKS)).cast("int"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = terms.groupBy("block").agg(F.count("*").alias("n"))
    starts = starts.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("block").orderBy("field_name", "term")
    return terms.withColumn("at", F.row_number().over(within) - 1).join(starts, "block").select("field_name", "term", (F.col("start") + F.col("at")).alias("term_no"))


def _block_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range of term numbers, this block's counts: rows, and rows of distinct (article, term)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        no = batch.column("term_no").to_numpy(zero_copy_only=False)
        rows = batch.column("rows").to_numpy(zero_copy_only=False)
        present = batch.column("present").to_numpy(zero_copy_only=False)
        part = no // RANGE
        for p in np.unique(part):
            take = part == p
            at = no[take] % RANGE
            total = sums.setdefault(int(p), np.zeros((2, RANGE), np.int64))
            total[0] += np.bincount(at, weights=rows[take], minlength=RANGE).astype(np.int64)
            total[1] += np.bincount(at, weights=present[take], minlength=RANGE).astype(np.int64)
    if sums:
        parts = sorted(sums)
        yield pa.record_batch(
            {"part": pa.array(parts, pa.int64()), "occurrences": pa.array([sums[p][0] for p in parts], pa.list_(pa.int64())), "articles": pa.array([sums[p][1] for p in parts], pa.list_(pa.int64()))}
        )


def _sum_arrays(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    add = lambda name: np.stack([np.asarray(x) for x in table.column(name).to_pylist()]).sum(axis=0)
    occurrences, articles = add("occurrences"), add("articles")
    seen = np.flatnonzero(occurrences)
    return pa.table({"term_no": pa.array(seen + key[0].as_py() * RANGE, pa.int64()), "occurrences": pa.array(occurrences[seen], pa.int64()), "articles": pa.array(articles[seen], pa.int64())})


def term_counts(edges: DataFrame, fields: tuple[str, ...] = FIELDS, article_col: str = "article_id") -> DataFrame:
    """field_name, term, occurrences, articles of every distinct term.

    ``occurrences`` counts rows, repeated rows each; ``articles`` counts distinct non-null articles, so a
    term whose rows have none has 0. Null labels and labels without a-z or 0-9 are no terms. An empty
    table gives no rows.
    """
    stacked = edges.select(
        F.col(article_col).alias("article_id"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), normal_term(f).alias("term")) for f in fields])).alias("x"),
    ).select("article_id", "x.field_name", "x.term").filter("term IS NOT NULL")
    counted = stacked.groupBy("article_id", "field_name", "term").agg(F.count("*").alias("rows"))
    words = dictionary(stacked)
    encoded = counted.join(words, ["field_name", "term"]).select(
        "article_id", "term_no", "rows", F.col("article_id").isNotNull().cast("long").alias("present")
    )
    blocks = encoded.repartition("article_id", F.when(F.col("article_id").isNull(), F.pmod(F.col("term_no"), F.lit(64))))
    arrays = blocks.select("term_no", "rows", "present").mapInArrow(_block_arrays, "part long, occurrences array<long>, articles array<long>")
    sums = arrays.groupBy("part").applyInArrow(_sum_arrays, "term_no long, occurrences long, articles long")
    return sums.join(words, "term_no").select("field_name", "term", "occurrences", "articles")


def marked_terms(edges: DataFrame, rare_below: int = 3, common_share: float = 0.2, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``term_counts`` with ``mark``: 'rare' with 1 to ``rare_below`` - 1 articles, 'common' with more than
    ``common_share`` of all distinct articles (and not rare), else null."""
    every = edges.select(F.count_distinct("article_id").alias("n")).scalar()
    mark = F.when((F.col("articles") > 0) & (F.col("articles") < rare_below), "rare").when(F.col("articles") > common_share * every, "common")
    return term_counts(edges, fields).withColumn("mark", mark)
