"""Negatives of whole periods and their scores, without a row for each draw in any shuffle.

What is drawn and scored is what ``graph.negatives`` and ``linkpred.scored`` say. Here it comes from one stream for each
period: its nodes with what belongs to them, its links, its positives. Only these are shuffled; draws, their check
against the links and their scores stay inside a task, which a positive leaves as one row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import graph
from newsloom.runtime import checkpointed

#: Bytes of a period's nodes or links that a task holds in memory; more lie in a file without a name.
HELD_BYTES = 64_000_000
#: A period goes to one task up to so many positives, and up to so many times its nodes, since each task needs all of these.
TASK_POSITIVES, TASK_NODES = 1_000_000, 4
#: Positives whose draws are made at a time.
AT_ONCE = 512


class Held:
    """Numbers one after the other, in memory up to ``HELD_BYTES``."""

    def __init__(self, dtype):
        self.dtype, self.parts, self.bytes, self.file = np.dtype(dtype), [], 0, None

    def add(self, x: np.ndarray) -> None:
        self.parts.append(np.array(x, self.dtype))
        self.bytes += self.parts[-1].nbytes
        if self.bytes > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts = []

    def whole(self) -> np.ndarray:
        if self.file:
            self.file.flush()
            return np.memmap(self.file, self.dtype, "r")
        return np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)


class Names:
    """Names of a period's nodes by number."""

    columns = {"period": "string", "pos": "long", "sub": "string", "obj": "string", "n": "array<struct<nth: int, neg: string>>"}

    def __init__(self):
        self.letters, self.lengths = Held(np.uint8), Held(np.int64)

    def add(self, names: pa.Array, has: np.ndarray) -> None:
        said = [n.encode() for n in names.to_pylist()]
        self.letters.add(np.frombuffer(b"".join(said), np.uint8))
        self.lengths.add([len(n) for n in said])

    def ready(self) -> None:
        ends = np.r_[0, np.cumsum(self.lengths.whole())].astype(np.int64)
        self.all = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(self.letters.whole()))

    def rows(self, at: np.ndarray, sub: np.ndarray, obj: np.ndarray, negs: np.ndarray, own: dict[str, pa.Array]) -> list[pa.Array]:
        kept = pa.array(at)
        return [*(own[c].take(kept) for c in ("period", "pos", "sub", "obj")), _lists(negs >= 0, "neg", self.all.take(pa.array(negs[negs >= 0])).cast(pa.string()))]


class Vectors:
    """Scores from the vectors of a period's nodes by number. Nodes without a row of vectors have no scores; those of a
    null vector, and of two that differ in width, are null."""

    columns = {"period": "string", "pos": "long", "s_pos": "double", "n": "array<struct<nth: int, s_neg: double>>"}

    def __init__(self):
        self.flat, self.width, self.has = None, Held(np.int64), Held(bool)

    def add(self, vectors: pa.Array, has: np.ndarray) -> None:
        values = vectors.flatten()
        self.flat = self.flat or Held(values.type.to_pandas_dtype())
        self.flat.add(values.to_numpy(zero_copy_only=False))
        self.width.add(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False))
        self.has.add(has)

    def ready(self) -> None:
        self.width, self.has, flat = self.width.whole(), self.has.whole(), self.flat.whole()
        most = max(0, int(self.width.max()))
        if (self.width == most).all():
            self.v = flat.reshape(-1, most)
        else:
            self.v = np.zeros((len(self.width), most), flat.dtype)
            self.v[np.arange(most) < self.width[:, None]] = flat

    def rows(self, at: np.ndarray, sub: np.ndarray, obj: np.ndarray, negs: np.ndarray, own: dict[str, pa.Array]) -> list[pa.Array]:
        there = self.has[sub] & self.has[obj]
        at, sub, ends = at[there], sub[there], np.hstack([obj[there, None], negs[there]])
        scores = np.einsum("pkd,pd->pk", self.v[ends].astype(np.float64), self.v[sub].astype(np.float64))
        null = (self.width[ends] < 0) | (self.width[ends] != self.width[sub][:, None])
        got = (ends[:, 1:] >= 0) & self.has[ends[:, 1:]]
        kept = pa.array(at)
        return [own["period"].take(kept), own["pos"].take(kept), pa.array(scores[:, 0], mask=null[:, 0]), _lists(got, "s_neg", pa.array(scores[:, 1:][got], mask=null[:, 1:][got]))]


def _lists(got: np.ndarray, name: str, values: pa.Array) -> pa.Array:
    """For each row of ``got`` the ``values`` of its true places, with the number of the place from 1."""
    nth = pa.array((np.nonzero(got)[1] + 1).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(got.sum(axis=1))].astype(np.int32)), pa.StructArray.from_arrays([nth, values], ["nth", name]))


def _draw(pos: np.ndarray, j: np.ndarray, n) -> np.ndarray:
    """``graph.draw``; no id is too large for it."""
    return (pos % 2147483647 * 48271 + j * 16807 + 12345) % 2147483647 % n


def picked(pos: np.ndarray, sub: np.ndarray, n: int, links: np.ndarray, k: int, tries: int) -> np.ndarray:
    """Numbers of ``k`` nodes for each positive, drawn again where too few draws are valid; -1 where none is.

    ``links`` are sorted numbers: a node's times 2**32 plus that of a neighbour.
    """
    out = np.full((len(pos), k), -1)

    def valid(rows: np.ndarray, draws: int) -> tuple[np.ndarray, np.ndarray]:
        x = _draw(pos[rows, None], np.arange(draws), n)
        link = (sub[rows, None] << 32) + x
        linked = links[np.minimum(np.searchsorted(links, link), len(links) - 1)] == link
        free = (x != sub[rows, None]) & ~linked
        return x, free & (np.cumsum(free, axis=1) <= k)

    few = np.arange(len(pos))
    for draws in (min(tries, 2) * k, tries * k):  # most have enough in the first draws
        x, free = valid(few, draws)
        count = free.sum(axis=1)
        out[few[np.repeat(np.arange(len(few)), count)], np.concatenate([np.arange(c) for c in count])] = x[free]
        few, count = few[count < k], count[count < k]
        if not len(few):
            return out
    few, count = few[count > 0], count[count > 0]
    for i in range(int(count.min(initial=k)), k):
        rows = few[count <= i]
        out[rows, i] = out[rows, _draw(pos[rows], i + tries * k, i)]
    return out


def _streamed(edges: DataFrame, owned: DataFrame | None, kind: type, k: int, tries: int) -> DataFrame:
    """Rows of ``kind`` for each positive. ``owned`` has node and ``own``, what belongs to it: without it, its name.

    A task reads a period's rows in this order: nodes by number, links by number, positives. A large period is cut by
    its sources, so that links go to one task each; only nodes are copied.
    """
    pairs = checkpointed(graph.positives(edges))  # both are read several times
    nodes = checkpointed(graph.numbered_nodes(pairs))
    of = lambda c, no: nodes.select("period", F.col("node").alias(c), F.col("id").alias(no))
    met = pairs.join(of("sub", "a"), ["period", "sub"]).join(of("obj", "b"), ["period", "obj"])
    n = nodes.groupBy("period").agg(F.count("*").alias("n"))
    sizes = pairs.groupBy("period").agg(F.count("*").alias("p")).join(n, "period").select("period", F.ceil(F.col("p") / F.greatest(F.lit(TASK_POSITIVES), F.col("n") * TASK_NODES)).cast("int").alias("slices"))  # as many rows as periods
    has = nodes.join(F.broadcast(sizes), "period")
    has = has.withColumns({"own": F.col("node"), "has": F.lit(True)}) if owned is None else has.join(owned.withColumn("has", F.lit(True)), "node", "left")
    null = lambda t: F.lit(None).cast(t)
    row = lambda what, a, b, *rest: F.struct(F.lit(what).alias("what"), F.col(a).alias("a"), F.col(b).alias("b"), *[x.alias(c) for c, x in zip(("pos", "sub", "obj"), rest or (null("long"), null("string"), null("string")))])
    rows = met.join(F.broadcast(sizes), "period").select("period", "slices", F.explode(F.array(row(1, "a", "b"), row(1, "b", "a"), row(2, "a", "b", F.col("pos"), F.col("sub"), F.col("obj")))).alias("x")).select("period", (F.col("x.a") % F.col("slices")).cast("int").alias("slice"), "x.*", null(has.schema["own"].dataType).alias("own"), F.lit(False).alias("has"))
    first = has.select("period", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("what"), F.col("id").alias("a"), *[null("long").alias(c) for c in ("b", "pos")], *[null("string").alias(c) for c in ("sub", "obj")], "own", F.coalesce("has", F.lit(False)).alias("has"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, links = None, None, None
        for batch in batches:
            # numbers of the places where another period, slice or kind of row begins
            ends = [0, batch.num_rows]
            for c in ("period", "slice", "what"):
                x = batch.column(batch.schema.get_field_index(c))
                x = (x.dictionary_encode().indices if c == "period" else x).to_numpy(zero_copy_only=False)
                ends += (np.flatnonzero(np.diff(x)) + 1).tolist()
            ends = sorted(set(ends))
            for lo, hi in zip(ends, ends[1:]):
                part = batch.slice(lo, hi - lo)
                own = dict(zip(part.schema.names, part.columns))
                what, mine = own["what"][0].as_py(), (own["period"][0].as_py(), own["slice"][0].as_py())
                a = own["a"].to_numpy(zero_copy_only=False)
                if mine != key:
                    key, held, links = mine, kind(), Held(np.int64)
                    n = 0
                if what == 0:
                    held.add(own["own"], own["has"].to_numpy(zero_copy_only=False))
                    n += len(a)
                    continue
                b = own["b"].to_numpy(zero_copy_only=False)
                if what == 1:
                    links.add((a << 32) + b)
                    continue
                if isinstance(links, Held):
                    held.ready()
                    links = links.whole()
                for at in range(0, len(a), AT_ONCE):
                    s = slice(at, at + AT_ONCE)
                    pos = own["pos"].slice(at, AT_ONCE).to_numpy(zero_copy_only=False)
                    negs = picked(pos, a[s], n, links, k, tries)
                    got = np.flatnonzero(negs[:, 0] >= 0)
                    yield pa.RecordBatch.from_arrays(held.rows(at + got, a[s][got], b[s][got], negs[got], own), [*kind.columns])

    # Few bytes, much work: without a number of its own this stage would be merged into one task.
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * edges.sparkSession.sparkContext.defaultParallelism)
    both = first.unionByName(rows.filter("what < 2 OR pos IS NOT NULL"))
    return both.repartition(tasks, "period", "slice").sortWithinPartitions("period", "slice", "what", "a", "b").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kind.columns.items()))


def negatives(edges: DataFrame, k: int = 50, tries: int = 3) -> DataFrame:
    """The rows of ``graph.negatives``."""
    return _streamed(edges, None, Names, k, tries).select("period", "pos", "sub", "obj", F.inline("n")).select("period", "pos", "sub", "obj", "neg", "nth")


def scored(edges: DataFrame, embeddings: DataFrame, k: int = 50, tries: int = 3) -> DataFrame:
    """The rows of ``linkpred.scored`` for all positives and their negatives; ``embeddings`` has node and vector, of
    two of one node the smaller counts."""
    own = F.when(~F.exists("vector", lambda x: x.isNull()), F.col("vector"))
    one = embeddings.groupBy("node").agg(F.min(own).alias("own"))
    return _streamed(edges, one, Vectors, k, tries).select("period", "pos", "s_pos", F.inline("n")).select("period", "pos", "nth", "s_pos", "s_neg")
