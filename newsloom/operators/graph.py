"""Time-sliced graphs as node and edge tables: vocabularies, last-wins edges, degrees, rolling windows, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import checkpointed

UNK = "UNK"


def numbered(values: DataFrame, col: str, start: int = 0) -> DataFrame:
    """Distinct non-null values of ``col`` with dense ids in sorted order.

    Spark cuts the values into sorted ranges of about equal size; written once, each row knows its range, and ids are
    the place within the range plus the sizes of the ranges before it. No task sorts more than a range.
    """
    v = values.select(col).filter(F.col(col).isNotNull()).distinct()
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = checkpointed(v.repartitionByRange(parts, col).withColumn("_range", F.spark_partition_id()))
    return _numbers(v, [], "_range", col, start)


def _numbers(rows: DataFrame, by: list[str], part: str, col: str, start: int = 0) -> DataFrame:
    """Rows with a dense ``id`` in each ``by``, in the order of ``part`` and ``col``, counted part by part."""
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, part).agg(F.count("*").alias("_n")).select(*by, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, part).orderBy(col)
    return rows.join(offsets, [*by, part]).select(*by, col, (F.row_number().over(inside) + F.col("_before") + F.lit(start - 1)).cast("long").alias("id"))


def vocabulary(edges: DataFrame, *cols: str, start: int = 0, unk: bool = True) -> DataFrame:
    """value, id over the distinct values of all ``cols`` and UNK."""
    stacked = edges.select(F.explode(F.array_distinct(F.array(*cols))).alias("value"))
    if unk:
        stacked = stacked.union(edges.sparkSession.createDataFrame([(UNK,)], "value string"))
    return numbered(stacked, "value", start)


def lookup(df: DataFrame, vocab: DataFrame, col: str, out: str, default: int = 0) -> DataFrame:
    """``df`` with the id of ``col``; ``default`` for values that the vocabulary lacks."""
    v = vocab.select(F.col("value").alias(col), F.col("id").alias(out))
    return df.join(v, col, "left").withColumn(out, F.coalesce(out, F.lit(default).cast("long")))


def last_edges(edges: DataFrame, order: tuple[str, ...] = ("date", "edge_id"), keep: tuple[str, ...] = ("rel", "rel_category", "w")) -> DataFrame:
    """One edge per period and pair: parallel edges collapse, the last by ``order`` wins."""
    last = F.max_by(F.struct(*keep), F.struct(*order)).alias("e")
    return edges.groupBy("period", "sub", "obj").agg(last).select("period", "sub", "obj", *[f"e.{k}" for k in keep])


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """Both ends of each edge as rows: side 0 is the subject's."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("sub").alias("node"), F.col("sub_type").alias("type")), F.struct(F.lit(1).alias("side"), F.col("obj").alias("node"), F.col("obj_type").alias("type")))
    return edges.select(*keep, F.explode(ends).alias("x")).select(*keep, "x.side", "x.node", "x.type")


def last_types(edges: DataFrame, order: tuple[str, ...] = ("date", "edge_id")) -> DataFrame:
    """Per period and node the type it was last written with; of one edge's ends the object's counts."""
    e = endpoints(edges, "period", *order)
    return e.groupBy("period", "node").agg(F.max_by("type", F.struct(*order, "side")).alias("type"))


def first_types(edges: DataFrame, order: tuple[str, ...] = ("date", "edge_id")) -> DataFrame:
    """Per node the type it is first written with, subjects before objects."""
    e = endpoints(edges, *order)
    return e.groupBy("node").agg(F.min_by("type", F.struct("side", *order)).alias("type"))


def degrees(edges: DataFrame) -> DataFrame:
    """Per period and node its degree in the collapsed graph (a loop counts twice) and its log1p."""
    pairs = edges.select("period", "sub", "obj").distinct()
    ends = pairs.select("period", F.explode(F.array("sub", "obj")).alias("node"))
    return ends.groupBy("period", "node").agg(F.count("*").alias("degree")).withColumn("log_degree", F.log1p(F.col("degree").cast("double")))


def packed(edges: DataFrame, nodes: DataFrame, rels: DataFrame, cats: DataFrame, features: bool = True) -> DataFrame:
    """Collapsed edges as ids: src, dst, rel, category, log1p of the weight; zeros where features are off."""
    e = last_edges(edges)
    e = lookup(lookup(e, nodes, "sub", "src"), nodes, "obj", "dst")
    e = lookup(lookup(e, rels, "rel", "rel_id"), cats, "rel_category", "cat_id")
    z = lambda c: c if features else F.lit(0).cast("long")
    return e.select("period", "src", "dst", z(F.col("rel_id")).alias("rel_id"), z(F.col("cat_id")).alias("cat_id"), (F.log1p("w") if features else F.lit(0.0)).alias("log_w"))


def period_ranks(edges: DataFrame) -> DataFrame:
    """The observed periods with their rank from 0; calendar gaps are not padded."""
    return edges.select("period").distinct().withColumn("r", F.row_number().over(Window.orderBy("period")) - 1)


def windows(edges: DataFrame, size: int = 3) -> DataFrame:
    """period, train_period: each period from the second on with the up to ``size`` observed ones before it."""
    p = period_ranks(edges)
    ranked = p.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(size)))).withColumn("tr", F.col("r") - F.col("back"))
    return ranked.join(p.select(F.col("period").alias("train_period"), F.col("r").alias("tr")), "tr").select("period", "train_period")


def known_nodes(edges: DataFrame, size: int = 3) -> DataFrame:
    """Per period the nodes seen in its training window."""
    nodes = edges.select("period", F.explode(F.array("sub", "obj")).alias("node")).distinct().withColumnRenamed("period", "train_period")
    return windows(edges, size).join(nodes, "train_period").select("period", "node").distinct()


def seen_edges(edges: DataFrame, size: int = 3) -> DataFrame:
    """Distinct pairs of each period from the second on, with ``seen``: both ends are known from its window."""
    first = edges.agg(F.min("period")).scalar()
    pairs = edges.filter(F.col("period") > first).select("period", "sub", "obj").distinct()
    known = known_nodes(edges, size)
    a = known.select("period", F.col("node").alias("sub"), F.lit(True).alias("_s"))
    b = known.select("period", F.col("node").alias("obj"), F.lit(True).alias("_o"))
    return pairs.join(a, ["period", "sub"], "left").join(b, ["period", "obj"], "left").select("period", "sub", "obj", (F.col("_s").isNotNull() & F.col("_o").isNotNull()).alias("seen"))


def draw(pos: Column, j: Column, n: Column) -> Column:
    """A number below ``n`` that depends on the positive and the draw alone: the same in every run and engine."""
    return (pos * F.lit(48271) + j * F.lit(16807) + F.lit(12345)) % F.lit(2147483647) % n


def positives(edges: DataFrame) -> DataFrame:
    """period, sub, obj, pos: the collapsed edges, each with the smallest id of its parallel ones."""
    return edges.groupBy("period", "sub", "obj").agg(F.min("edge_id").alias("pos"))


def numbered_nodes(pairs: DataFrame) -> DataFrame:
    """period, node, id: the nodes of a period numbered in the order of a slice of their md5, slice by slice."""
    nodes = pairs.select("period", F.explode(F.array("sub", "obj")).alias("node")).distinct()
    return _numbers(nodes.withColumn("_slice", F.substring(F.md5("node"), 1, 3)), ["period"], "_slice", "node")


def negatives(edges: DataFrame, k: int = 50, tries: int = 3, pad: bool = True) -> DataFrame:
    """period, pos, src, dst, neg, n: for each collapsed edge ``k`` nodes of its period that are no neighbour of
    its source in either direction.

    Nodes are numbered in the order of a slice of their md5, slice by slice. Each positive draws ``tries`` * k nodes by number, so candidates are k times the positives and never positives
    times nodes. Where fewer than ``k`` are valid, those there are drawn again until there are ``k`` (not with ``pad``
    off). A positive with no valid draw has no negatives; its id stays on all others.
    """
    pairs = positives(edges)
    nodes = numbered_nodes(pairs).withColumnRenamed("id", "no")
    sizes = nodes.groupBy("period").agg(F.count("*").alias("n"))
    drawn = pairs.join(F.broadcast(sizes), "period").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(tries * k - 1))))
    drawn = drawn.withColumn("no", draw(F.col("pos"), F.col("j"), F.col("n"))).join(nodes, ["period", "no"])
    linked = pairs.select("period", "sub", F.col("obj").alias("node")).union(pairs.select("period", "obj", "sub")).distinct()
    free = drawn.filter("node <> sub").join(linked, ["period", "sub", "node"], "left_anti")
    nth = Window.partitionBy("period", "pos").orderBy("j")
    first = free.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k).select("period", "pos", "sub", "obj", F.col("node").alias("neg"), F.col("nth").cast("int").alias("nth"))
    return padded(first, k, tries) if pad else first


def padded(negatives: DataFrame, k: int, tries: int) -> DataFrame:
    """Negatives of one positive made ``k``: each further one is drawn from those before it, drawn ones among them."""
    own = negatives.groupBy("period", "pos", "sub", "obj").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "neg"))), lambda x: x["neg"]).alias("l"))  # at most k each
    again = F.aggregate(F.sequence(F.size("l"), F.lit(k - 1)), F.col("l"), lambda l, i: F.concat(l, F.array(F.get(l, draw(F.col("pos"), i + F.lit(tries * k), F.size(l)).cast("int")))))
    full = own.withColumn("l", F.when(F.size("l") < k, again).otherwise(F.col("l")))
    return full.select("period", "pos", "sub", "obj", F.posexplode("l").alias("nth", "neg")).select("period", "pos", "sub", "obj", "neg", (F.col("nth") + 1).cast("int").alias("nth"))


def report(edges: DataFrame) -> DataFrame:
    """Nodes, edges and periods of an edge table."""
    nodes = edges.select(F.explode(F.array("sub", "obj")).alias("node")).agg(F.count_distinct("node")).scalar()
    return edges.agg(F.count("*").alias("n_edges"), F.count_distinct("period").alias("n_periods")).select(nodes.alias("n_nodes"), "n_edges", "n_periods")


def viz_nodes(edges: DataFrame) -> DataFrame:
    return first_types(edges).select(F.col("node").alias("id"), F.col("type"))


def viz_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("sub").alias("source"), F.col("obj").alias("target"), F.col("rel").alias("label"), F.col("period").alias("time"), "w").distinct()
