"""Mixing sources to target weights by weighted fair queueing (problem 9).

Every source is a flow with a weight, its target share. Its documents, in a hashed order, are packets
whose size is their number of tokens; a source that may be repeated sends its documents again, pass
after pass, up to its cap. The virtual finish time of a packet is the tokens its source has sent up to
it, divided by the weight. Serving packets by finish time keeps all sources at their shares at every
moment; the mix is what has been served when the budget is used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.bpe_automaton import TOKENIZERS
from newsloom.llm.tokenize import token_count
from newsloom.runtime import checkpointed

#: Slices of a source's hashed order. Sums over slices turn one long running sum into many short ones.
SLICES = 1024


def sized(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, size in tokens, for documents with a source and at least one token. Counted and written once:
    a filter on the count before that would have every text encoded a second time."""
    counted = docs.filter(F.col("source").isNotNull() & F.col("text").isNotNull()).select("doc_id", "source", token_count("text", tokenizer, folder).alias("size"))
    return checkpointed(counted).filter("size > 0")


def _running(df: DataFrame, by: list[str], order: list, size: str, out: str) -> DataFrame:
    """Adds the running sum of ``size`` over ``order`` in each ``by``, where ``slice`` rises with ``order``.

    Two levels: sums of slices are added up first (few rows), then each slice adds up its own rows, so
    that no task holds a whole source.
    """
    offsets = df.groupBy(*by, "slice").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(*by, "slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, [*by, "slice"]).withColumn(out, F.col("_before") + F.sum(size).over(inside)).drop("_before")


def finish_times(docs: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """Packets (doc_id, source, pass, size, finish) and sources (source, share, weight, cap, total).

    ``weight`` is the target share among the sources that have documents; sources without any can have
    no tokens, and theirs is null. Rows of ``targets`` with a null source, share or cap, or none above 0,
    take no part.
    """
    docs = sized(docs, tokenizer, folder)
    goals = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")
    )
    totals = docs.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("docs"))
    sources = goals.join(totals, "source", "left")
    live = F.sum(F.when(F.col("total").isNotNull(), F.col("share"))).over(Window.partitionBy(F.lit(1)))
    sources = checkpointed(sources.withColumn("weight", F.when(F.col("total").isNotNull(), F.col("share") / live)))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    packets = docs.join(sources.filter("total IS NOT NULL").select("source", "weight", "cap", "total"), "source")
    packets = packets.withColumn("h", h).withColumn("slice", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * SLICES).cast("int"))
    packets = _running(packets, ["source"], ["h", "doc_id"], "size", "sent")
    packets = packets.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("cap") - 1)))
    finish = (F.col("sent") + F.col("pass") * F.col("total")) / F.col("weight")
    return packets.select("doc_id", "source", F.col("pass").cast("int").alias("pass"), "size", finish.alias("finish")), sources


def largest_budget(sources: DataFrame) -> float | None:
    """The most tokens at which every source that has documents still reaches its weight within its cap."""
    return sources.agg(F.min(F.col("total") * F.col("cap") / F.col("weight"))).first()[0]


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mix (position, doc_id, source, pass, size) and the sources it was made from.

    ``budget`` in tokens; without one, ``largest_budget``. A larger budget is served from whatever
    sources still have packets, and the report then shows shares off target. Documents without text,
    tokens or a listed source are never used; a document is used at most ``max_repeats`` times. Repeated
    rows of ``docs`` count as documents of their own.
    """
    packets, sources = finish_times(docs, targets, seed, tokenizer, folder)
    if budget is None:
        budget = largest_budget(sources)
    budget = float(budget or 0)
    top = packets.agg(F.max("finish")).first()[0] or 1.0
    packets = packets.withColumn("slice", F.least(F.floor(F.col("finish") / F.lit(top) * SLICES * 16), F.lit(SLICES * 16 - 1)).cast("int"))
    offsets = packets.groupBy("slice").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n"))
    inside = Window.partitionBy("slice").orderBy("finish", "source", "doc_id", "pass").rowsBetween(Window.unboundedPreceding, 0)
    served = packets.join(offsets, "slice").withColumn("used", F.col("b") + F.sum("size").over(inside)).withColumn("position", F.col("n") + F.count("*").over(inside))
    return served.filter(F.col("used") <= F.lit(budget)).select("position", "doc_id", "source", "pass", "size"), sources


def report(mixed: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per listed source: target and actual share of the mix's tokens, tokens, documents, most repeats."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("uses"))
    got = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_repeats"))
    rows = sources.select("source", "share", "weight", "cap").join(got, "source", "left")
    every = Window.partitionBy(F.lit(1))
    return rows.select(
        "source",
        F.col("share").alias("target_share"),
        F.col("weight").alias("reachable_share"),
        (F.coalesce(F.col("tokens"), F.lit(0)) / F.sum("tokens").over(every)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.col("cap").alias("max_repeats"),
    )
