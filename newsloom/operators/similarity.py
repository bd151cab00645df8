"""Vectors and word statistics: cosine, coverage, uniqueness, entropy, sentence rank."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.runtime import checkpointed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Vectors scaled to length 1 once, so that pairs need only a dot product; zero vectors become null."""
    length = norm(F.col(col))
    return df.withColumn(col, F.when(length > 0, F.transform(col, lambda x: x.cast("double") / length)))


def similar_pairs(vectors: DataFrame, group: str, key: str, at_least: float, col: str = "embedding") -> DataFrame:
    """Pairs i < j within each group at least ``at_least`` similar, an equi-join on the group."""
    v = unit(vectors, col).select(group, key, col)
    a, b = v.withColumnsRenamed({key: "i", col: "va"}), v.withColumnsRenamed({key: "j", col: "vb"})
    pairs = a.join(b, group).filter("i < j").withColumn("similarity", dot(F.col("va"), F.col("vb")))
    return pairs.filter(F.col("similarity") >= at_least).select(group, "i", "j", "similarity")


def uniqueness(vectors: DataFrame, group: str, key: str, at_least: float) -> DataFrame:
    """Per group the share of pairs below ``at_least``; 1 for a single vector."""
    n = vectors.groupBy(group).agg(F.count("*").alias("n"))
    close = similar_pairs(vectors, group, key, at_least).groupBy(group).agg(F.count("*").alias("close"))
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(close, group, "left").select(group, "n", F.when(F.col("n") == 1, 1.0).otherwise(1 - F.coalesce("close", F.lit(0)) / F.nullif(all_pairs, F.lit(0.0))).alias("uniqueness"))


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """v, component (the smallest vertex connected to v): label propagation with pointer jumping, checkpointed each
    round, so a chain of n vertices takes about log n rounds."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).toDF("v", "u").distinct())
    label = checkpointed(vertices.select("v", F.col("v").alias("c")))
    while True:
        near = both.join(label.withColumnsRenamed({"v": "u"}), "u").groupBy("v").agg(F.min("c").alias("near"))
        step = label.join(near, "v", "left").select("v", "c", F.least("c", "near").alias("to"))
        over = label.select(F.col("v").alias("to"), F.col("c").alias("over"))
        new = checkpointed(step.join(over, "to", "left").select("v", "c", F.least("to", "over").alias("new")))
        if new.filter("new < c").isEmpty():
            return new.select("v", F.col("new").alias("component"))
        label = new.select("v", F.col("new").alias("c"))


def cluster_uniqueness(vectors: DataFrame, group: str, key: str, at_least: float) -> DataFrame:
    """Per group its clusters of transitively similar vectors, and clusters over vectors."""
    links = similar_pairs(vectors, group, key, at_least).select(F.col("i").alias("a"), F.col("j").alias("b"))
    comp = components(vectors.select(F.col(key).alias("v")), links)
    rows = vectors.select(group, F.col(key).alias("v")).join(comp, "v")
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct("component").alias("clusters")).withColumn("uniqueness", F.col("clusters") / F.col("n"))


def coverage(sources: DataFrame, targets: DataFrame, group: str, key: str, weight: str | None = None) -> DataFrame:
    """Per group the weighted sum over source vectors of their best cosine to any target, mapped to 0..1.

    Weights are scaled to sum 1 in each group (equal where their sum is 0); 0 where either side is empty.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    per = Window.partitionBy(group)
    s = unit(sources).select(group, key, F.col("embedding").alias("vs"), w.alias("w"))
    s = s.withColumn("w", F.when(F.sum("w").over(per) > 0, F.col("w") / F.sum("w").over(per)).otherwise(1 / F.count("*").over(per)))
    t = unit(targets).select(group, F.col("embedding").alias("vt"))
    best = s.join(t, group, "left").groupBy(group, key).agg(F.max(dot(F.col("vs"), F.col("vt"))).alias("best"), F.first("w").alias("w"))
    scored = best.groupBy(group).agg(F.sum(F.col("w") * (F.col("best") + 1) / 2).alias("coverage"))
    groups = sources.select(group).union(targets.select(group)).distinct()
    return groups.join(scored, group, "left").select(group, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def nearest(queries: DataFrame, names: list[str], matrix: np.ndarray, at_least: float, key: str, fallback: Column) -> DataFrame:
    """For each query vector the name of the most similar row of ``matrix`` (a fixed set, such as the properties of
    an ontology), the first at ties; ``fallback`` below ``at_least``. One matrix product per batch."""
    base = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    @F.arrow_udf("struct<at:int,similarity:double>")
    def best(vectors: pa.Array) -> pa.Array:
        rows = [v if v is not None else [np.nan] * base.shape[1] for v in vectors.to_pylist()]
        q = np.array(rows, np.float64).reshape(len(rows), base.shape[1])
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ base.T
        bad = np.isnan(sims).any(axis=1)
        at = np.where(bad, 0, np.argmax(np.where(np.isnan(sims), -2, sims), axis=1)).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(at, mask=bad), pa.array(sims[np.arange(len(at)), at], mask=bad)], ["at", "similarity"])

    hit = queries.withColumn("_b", best("embedding"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_b.at") + 1)
    return hit.select(key, F.when(F.col("_b.similarity") >= at_least, name).otherwise(fallback).alias("property"), (F.col("_b.similarity") >= at_least).alias("matched"), F.round("_b.similarity", 6).alias("similarity"))


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, n: tokens are what single blanks separate, empty ones among them. Blank and null texts have none."""
    rows = df.filter(F.col(text).rlike(r"\S")).select(key, F.explode(F.split(text, " ")).alias("token"))
    return rows.groupBy(key, "token").agg(F.count("*").alias("n"))


def entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy in bits of each text's tokens; 0 for blank and null texts.

    From counts c of a text of n tokens it is log2 n - sum(c log2 c) / n: one aggregation by text, no window.
    """
    c = token_counts(df, key, text).groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return df.select(key).distinct().join(c, key, "left").select(key, F.coalesce(F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n"), F.lit(0.0)).alias("entropy"))


def entropy_ratio(df: DataFrame, key: str, of: str, to: str) -> DataFrame:
    """Entropy of text ``of`` over that of ``to``; 0 where the latter is 0."""
    a, b = entropy(df, key, of).withColumnRenamed("entropy", "a"), entropy(df, key, to).withColumnRenamed("entropy", "b")
    return a.join(b, key).select(key, F.when(F.col("b") == 0, 0.0).otherwise(F.col("a") / F.col("b")).alias("entropy_ratio"))


def indel_ratio(a: str, b: str) -> float:
    """1 - insertions and deletions over both lengths: twice the longest common subsequence over the lengths' sum."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def letter_counts(words: list[str], width: int = 48) -> np.ndarray:
    """How often each letter (modulo ``width``) occurs in each word."""
    out = np.zeros((len(words), width), np.int16)
    for k, w in enumerate(words):
        for c in w:
            out[k, ord(c) % width] += 1
    return out


def resembled(want: list[str], have: list[str], ratio: float = 0.8) -> int:
    """Words of ``want`` with an indel ratio of at least ``ratio`` to some word of ``have``.

    Letters in common bound the longest common subsequence, so only few pairs are compared letter by letter.
    """
    known = set(have)
    left = [w for w in want if w not in known]
    if not left or not have:
        return len(want) - len(left)
    a, b = letter_counts(left), letter_counts(have)
    sizes = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :]
    common = np.array([np.minimum(row, b).sum(axis=1) for row in a])
    near = 2 * common >= ratio * sizes
    return len(want) - len(left) + sum(any(indel_ratio(w, have[j]) >= ratio for j in np.flatnonzero(near[k])) for k, w in enumerate(left))


@F.arrow_udf(T.DoubleType())
def topic_coverage(articles: pa.Array, answers: pa.Array) -> pa.Array:
    """Share of an article's distinct tokens that some token of the answer resembles by an indel ratio of 0.8."""
    out = []
    for a, b in zip(articles.to_pylist(), answers.to_pylist()):
        want, have = list(dict.fromkeys((a or "").lower().split())), list(dict.fromkeys((b or "").lower().split()))
        out.append(resembled(want, have) / len(want) if want else 0.0)
    return pa.array(out, pa.float64())


def sentence_ranks(tokens: list[list[str]], damping: float = 0.85, rounds: int = 100) -> np.ndarray:
    """PageRank of sentences that are linked by shared words over the logarithms of their lengths; sentences without
    any link get 0."""
    n = len(tokens)
    number: dict[str, int] = {}
    at = [(i, number.setdefault(w, len(number))) for i, ws in enumerate(tokens) for w in set(ws)]
    has = np.zeros((n, max(1, len(number))))
    if at:
        has[tuple(np.array(at).T)] = 1
    size = np.log10(np.maximum(1, [len(ws) for ws in tokens]))
    both = size[:, None] + size[None, :]
    w = np.divide(has @ has.T, both, out=np.zeros((n, n)), where=both > 0)
    np.fill_diagonal(w, 0)
    linked = w.sum(axis=1) > 0
    if not linked.any():
        return np.zeros(n)
    p = w[np.ix_(linked, linked)]
    p = p / p.sum(axis=1, keepdims=True)
    r = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        new = (1 - damping) / len(p) + damping * (r @ p)
        if np.abs(new - r).max() < 1e-9:
            break
        r = new
    out = np.zeros(n)
    out[linked] = r
    return out


# Words that rank nothing.
STOP_WORDS = frozenset("a an and are as at be but by for from has have he her his i in is it its of on or she so than that the their they this to was we were which who will with you".split())


#: Where a sentence ends: behind a mark and before a blank, or behind a full-width mark, which no blank follows, and the
#: brackets and quotation marks that close with it.
SENTENCE_END = re.compile(r"(?<=[.!?…؟۔।॥։።])\s+|(?<=[。！？｡])(?![。！？｡…」』”’）》】])\s*|(?<=[。！？｡][」』”’）》】])(?![」』”’）》】])\s*")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("weight", T.DoubleType())])))
def textrank(texts: pa.Array) -> pa.Array:
    """Sentences of a text (``SENTENCE_END``) with their rank, scaled to sum 1; equal weights where nothing is linked."""
    out = []
    for t in texts.to_pylist():
        parts = [s for s in SENTENCE_END.split((t or "").strip()) if s]
        words = [[w for w in re.findall(r"[^\W\d_]+", s.lower()) if w not in STOP_WORDS] for s in parts]
        r = sentence_ranks(words)
        r = r / r.sum() if r.sum() > 0 else np.full(len(parts), 1 / max(1, len(parts)))
        out.append([{"sentence": s, "weight": float(x)} for s, x in zip(parts, r)])
    return pa.array(out, pa.list_(pa.struct([("sentence", pa.string()), ("weight", pa.float64())])))


def clusters(vectors: np.ndarray, at_least: float) -> int:
    """Clusters of transitively similar rows, by union-find."""
    n = len(vectors)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    v = vectors / np.where(length > 0, length, 1)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(v @ v.T >= at_least, 1))):
        parent[find(int(j))] = find(int(i))
    return sum(find(k) == k for k in range(n))


def best_coverage(weights: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> float:
    """``coverage`` of one article whose vectors are at hand."""
    if not len(sources) or not len(targets):
        return 0.0
    unit_rows = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    w = weights / weights.sum() if weights.sum() > 0 else np.full(len(sources), 1 / len(sources))
    return float((w * ((unit_rows(sources) @ unit_rows(targets).T).max(axis=1) + 1) / 2).sum())
