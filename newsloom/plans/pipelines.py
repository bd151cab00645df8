"""Whole stages as lazy plans of operators: extraction, judgement, link prediction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import ontology, scores, triplets
from newsloom.operators import articles, drawn, graph, linkpred, similarity
from newsloom.sources import clients

TEMPLATE = "Extract (sub, sub_type, rel, rel_category, obj, obj_type) tuples from this text as a list.\n\n{input_text_}"


def extract(rows: DataFrame, done: DataFrame | None = None, client: Callable | None = None, template: str = TEMPLATE, selected: str = "summary", start: str | None = None, end: str | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Articles to sanitised triplet lists: filter, keep the first of each title, skip titles already done, ask, clean.

    One row per asked article: article_id, title, date, output_triplets (a list literal, '[]' for nothing usable), error.
    """
    rows = articles.date_range(rows, start, end)
    if tickers:
        rows = articles.ticker_whitelist(rows, tickers)
    rows = articles.keep_first(articles.long_enough(articles.filled(rows), selected))
    if done is not None:
        rows = articles.not_done(rows, done)
    prompts = rows.select("article_id", "title", "date", articles.rendered(template, input_text_=articles.prompt_text(rows, selected)).alias("prompt"))
    got = clients.asked(prompts, "prompt", client or clients.FakeModel())
    return got.select("article_id", "title", "date", F.coalesce(triplets.literal_text(triplets.sanitized("answer")), F.lit("[]")).alias("output_triplets"), "error")


def _measured(at_least: float, embed: Callable[[str], np.ndarray]):
    @F.arrow_udf(T.StructType([T.StructField("coverage", T.DoubleType()), T.StructField("uniqueness", T.DoubleType())]))
    def measure(ranked: pa.Array, said: pa.Array) -> pa.Array:
        known: dict[str, np.ndarray] = {}

        def vectors(texts: list[str]) -> np.ndarray:
            for t in texts:
                if t not in known:
                    known[t] = embed(t)
            return np.array([known[t] for t in texts]).reshape(len(texts), -1) if texts else np.zeros((0, 1))

        out = []
        for r, s in zip(ranked.to_pylist(), said.to_pylist()):
            sources, targets = vectors([x["sentence"] for x in r or ()]), vectors(s)
            cover = similarity.best_coverage(np.array([x["weight"] for x in r or ()]), sources, targets)
            out.append({"coverage": cover, "uniqueness": similarity.clusters(targets, at_least) / len(s) if s else 0.0})
        return pa.array(out, pa.struct([("coverage", pa.float64()), ("uniqueness", pa.float64())]))

    return measure


def judge(rows: DataFrame, at_least: float = 0.7, embed: Callable[[str], np.ndarray] = clients.word_vector) -> DataFrame:
    """The measured metrics of each answer with usable triplets: coverage of the article's ranked sentences, clusters
    per triplet, ontology score, entropy ratio, and the judge's own scores where its text has them.

    The sentences of one article and of its answer stay in one row; only the ontology and the entropies are
    aggregated over rows.
    """
    base = rows.withColumn("t", triplets.sanitized("output_triplets")).filter("size(t) > 0").select("triplet_id", "text", "llm_judgments_evaluation", "t")
    own = base.select("triplet_id", _measured(at_least, embed)(similarity.textrank("text"), triplets.sentences(F.col("t"))).alias("m"), *[c.alias(f"llm_{n}") for n, c in scores.extracted("llm_judgments_evaluation").items()])
    onto = ontology.validity(triplets.exploded(base, F.col("t"), "triplet_id"), "triplet_id").select("triplet_id", F.col("score").alias("ontology"))
    ratio = similarity.entropy_ratio(base.withColumn("said", F.array_join(triplets.sentences(F.col("t")), " ")), "triplet_id", "said", "text")
    out = own.join(onto, "triplet_id", "left").join(ratio, "triplet_id", "left").withColumns({"coverage": F.col("m.coverage"), "uniqueness": F.col("m.uniqueness")})
    return out.select("triplet_id", *[F.round(c, 6).alias(c) for c in ("coverage", "uniqueness", "ontology", "entropy_ratio")], *[f"llm_{n}" for n in scores.CATEGORIES])


def agreement(metrics: DataFrame, threshold: float = 0.75, most_entropy: float = 1.0) -> DataFrame:
    """Per answer whether measured and judged scores both reach the threshold."""
    both = lambda a, b: (F.col(a) >= threshold) & (F.col(b) >= threshold)
    judged = metrics.withColumn("llm_semantic", (F.col("llm_semantic_validity") + F.col("llm_consistency")) / 2)
    return judged.select("triplet_id", both("coverage", "llm_coverage").alias("covered"), both("uniqueness", "llm_uniqueness").alias("unique"), both("ontology", "llm_semantic").alias("valid"), (F.col("entropy_ratio") <= most_entropy).alias("entropy_good"))


def link_prediction(edges: DataFrame, vectors: DataFrame, k: int = 50) -> DataFrame:
    """Rolling-window link prediction by given vectors: per period the metrics of all, seen and unseen positives."""
    pos = graph.positives(edges)
    ranked = linkpred.ranks(drawn.scored(edges, vectors, k))
    return linkpred.metrics(ranked.join(pos, ["period", "pos"]).join(graph.seen_edges(edges), ["period", "sub", "obj"]))
