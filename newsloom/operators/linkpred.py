"""Link prediction as tables: scores, ranks, metrics, leaderboard, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.similarity import dot

HITS = (1, 3, 10)
#: Exponents within a step are added up without overflow.
STEP = 256


def scored(positives: DataFrame, negatives: DataFrame, embeddings: DataFrame) -> DataFrame:
    """period, pos, nth, s_pos, s_neg for each negative of a positive; ``embeddings`` has node and vector.

    Positives are scored by themselves, once each, and only scores go on.
    """
    e = embeddings.select("node", "vector")
    of = lambda col, out: e.select(F.col("node").alias(col), F.col("vector").alias(out))
    pos = positives.join(of("sub", "vs"), "sub").join(of("obj", "vo"), "obj").select("period", "pos", dot(F.col("vs"), F.col("vo")).alias("s_pos"))
    neg = negatives.join(of("sub", "vs"), "sub").join(of("neg", "vn"), "neg").select("period", "pos", "nth", dot(F.col("vs"), F.col("vn")).alias("s_neg"))
    return neg.join(pos, ["period", "pos"])


def ranks(scores: DataFrame) -> DataFrame:
    """Rank of each positive among its own negatives; ties count against it."""
    return scores.groupBy("period", "pos").agg((F.count_if(F.col("s_neg") >= F.col("s_pos")) + 1).alias("rank"))


def metrics(ranked: DataFrame, by: tuple[str, ...] = ("period",)) -> DataFrame:
    """Count, mean reciprocal rank and hits of all, seen and unseen positives; ``ranked`` has rank and seen.

    Metrics of an empty group are null, its count 0.
    """
    r = 1 / F.col("rank")
    groups = {"": F.lit(True), "seen_": F.col("seen"), "unseen_": ~F.col("seen")}
    cols = []
    for name, cond in groups.items():
        cols.append(F.count_if(cond).alias(f"{name}count"))
        cols.append(F.avg(F.when(cond, r)).alias(f"{name}mrr"))
        cols += [F.avg(F.when(cond, (F.col("rank") <= k).cast("double"))).alias(f"{name}hits{k}") for k in HITS]
    return ranked.groupBy(*by).agg(*cols)


def averaged(per_period: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Unweighted means over periods, nulls left out, and the mean reciprocal rank weighted by positives."""
    cols = ["mrr", *[f"hits{k}" for k in HITS], "seen_mrr", "unseen_mrr"]
    return per_period.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols], (F.sum(F.col("mrr") * F.col("count")) / F.sum("count")).alias("weighted_mrr"))


def leaderboard(models: DataFrame, order: str = "model") -> DataFrame:
    """Models numbered by mean reciprocal rank; ties in the order of ``order``."""
    w = Window.orderBy(F.desc("mrr"), order)
    return models.withColumn("position", F.row_number().over(w))


def log_sigmoid(x: Column) -> Column:
    """log of the logistic function, without overflow for large negative values."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def hinge_loss(margin: float = 5.0) -> Column:
    return F.avg(F.greatest(F.lit(margin) + F.col("s_neg") - F.col("s_pos"), F.lit(0.0)))


def margin_loss(gamma: float = 1.0) -> Column:
    return -F.avg(log_sigmoid(F.col("s_pos") - gamma) + log_sigmoid(F.lit(gamma) - F.col("s_neg")))


def info_nce(scores: DataFrame, width: int, temperature: float = 0.1, by: tuple[str, ...] = ("period",)) -> DataFrame:
    """Mean over positives of the cross-entropy of the positive among itself and its negatives, by a stable log-sum-exp."""
    scale = (width**0.5) * temperature
    x = F.col("s_neg") / scale
    step = F.floor(x / STEP) * STEP  # sums are kept by steps of the exponent, mostly one or two a positive, so that no list of scores is shuffled
    part = scores.withColumn("_step", step).groupBy(*by, "pos", "_step").agg(F.max("s_pos").alias("_p"), F.sum(F.exp(x - F.col("_step"))).alias("_z"))
    p = part.groupBy(*by, "pos").agg((F.max("_p") / scale).alias("p"), F.collect_list(F.when(F.col("_z").isNotNull(), F.col("_step") + F.log("_z"))).alias("n"))
    top = F.greatest(F.col("p"), F.array_max("n"))
    total = F.exp(F.col("p") - top) + F.aggregate("n", F.lit(0.0), lambda s, y: s + F.exp(y - top))
    return p.withColumn("l", top + F.log(total) - F.col("p")).groupBy(*by).agg(F.avg("l").alias("info_nce"))


def cross_entropy(rows: DataFrame, logits: str, target: str, by: tuple[str, ...]) -> DataFrame:
    """Mean cross-entropy of integer targets (from 0) under arrays of logits."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))
    return rows.withColumn("_l", lse - F.element_at(logits, F.col(target) + 1)).groupBy(*by).agg(F.avg("_l").alias("cross_entropy"))


def hybrid(info: Column, ce: Column, weight: float = 0.5) -> Column:
    return info + weight * ce
