"""Near-duplicate texts by SetSketch (problem 4).

1. Equal texts become one class, represented by its smallest id, before anything else is done.
2. A text is the set of its runs of three words. Its sketch has registers ``K = floor(1 - log_b x)``, where
   x is the least of the set's exponential hash values for that register: truncated minima on an
   exponential scale. Registers of a union are the greater of both, and two sets agree in a register
   about as often as their Jaccard similarity.
3. Bands of registers are hashed to keys. Texts that share a key in any band are candidates. In the same
   join the similarity of the two sets is estimated by maximum likelihood from one bit of each of the
   other registers, and pairs far below the threshold go no further.
4. What remains is verified exactly on the texts.

With ``BANDS`` bands of ``ROWS`` registers a pair of similarity s meets with probability
1 - (1 - s**ROWS)**BANDS: 0.92 at 0.5, 0.996 at 0.6, 0.9998 at 0.7.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import checkpointed, sized_broadcast

SHINGLE, BANDS, ROWS, BASE, SEED = 3, 40, 4, 1.001, 0x9E3779B97F4A7C15
REGISTERS = BANDS * ROWS
#: Registers whose lowest bit makes the signature of a pair estimate: two words of 64 bits.
BITS = 128
#: Rows of candidate texts up to which their ids are broadcast to the scan that fetches the texts.
TEXT_ROWS = 1_000_000
#: Copies of one text up to which each copy is written out as a pair of its own; see ``near_pairs``.
EXPANDED_COPIES = 64

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; anything else separates."""
    return WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Sketcher:
    """Hashes words once, and turns batches of texts into register values."""

    def __init__(self):
        self.known: dict[str, int] = {}
        rng = np.random.default_rng(SEED)
        self.factor = rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)

    def ids(self, text: str) -> list[int]:
        known = self.known
        out = []
        for w in words(text):
            h = known.get(w)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return out

    def shingles(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Positions of the texts with a run of ``SHINGLE`` words, the hashes of all their runs one after another, and
        where each text's runs start."""
        parts, sizes, kept = [], [], []
        for k, t in enumerate(texts):
            w = self.ids(t)
            if len(w) >= SHINGLE:
                kept.append(k)
                parts += w
                sizes.append(len(w))
        if not kept:
            return kept, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        w = np.array(parts, np.uint64)
        n = np.array(sizes)
        ends = np.cumsum(n)
        h = w[:-2] * np.uint64(0x9DDFEA08EB382D69) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9)
        inside = np.ones(len(w), bool)
        inside[ends - 1] = inside[ends - 2] = False  # runs that would reach into the next text
        return kept, _mix(h[inside[:-2]]), np.concatenate([[0], np.cumsum(n - (SHINGLE - 1))[:-1]])

    def registers(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Positions of the texts with a run of ``SHINGLE`` words, and their register values."""
        kept, h, starts = self.shingles(texts)
        out = np.empty((len(kept), REGISTERS), np.uint32)
        if not kept:
            return kept, out
        log_base = math.log(BASE)
        scratch = np.empty_like(h)
        for r in range(REGISTERS):
            np.bitwise_xor(h, self.shift[r], out=scratch)
            np.multiply(scratch, self.factor[r], out=scratch)
            least = np.minimum.reduceat(scratch, starts)
            x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)  # exponential, rate 1
            out[:, r] = np.clip(np.floor(1 - np.log(x) / log_base), 0, 2**16 - 1).astype(np.uint32)
        return kept, out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, band keys, two words of signature bits."""
    sketcher = Sketcher()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for at in range(0, len(texts), 1000):
            kept, regs = sketcher.registers(texts[at : at + 1000])
            if not len(kept):
                continue
            keys = np.full((len(kept), BANDS), SEED, np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                keys = _mix(keys + regs[:, r::ROWS].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            bits = np.packbits((regs[:, REGISTERS - BITS :] & 1).astype(np.uint8), axis=1).view(np.int64)
            offsets = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([k + at for k in kept])), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())],
                ["id", "keys", "s0", "s1"],
            )


def most_different_bits(threshold: float, bits: int = BITS, sigmas: float = 3.0) -> int:
    """The likelihood cut: bits that may differ before the estimate, (agreeing - differing) / bits, lies ``sigmas``
    standard deviations below ``threshold``."""
    differ = (1 - threshold) / 2
    return math.floor(bits * differ + sigmas * math.sqrt(bits * differ * (1 - differ)))


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b of representatives that meet in a band and whose estimate is not far too low."""
    sketches = classes.mapInArrow(_sketches, "id long, keys array<long>, s0 long, s1 long")
    rows = sketches.select(F.explode("keys").alias("key"), "id", "s0", "s1")
    left, right = rows.alias("l"), rows.alias("r")
    differing = F.bit_count(F.col("l.s0").bitwiseXOR(F.col("r.s0"))) + F.bit_count(F.col("l.s1").bitwiseXOR(F.col("r.s1")))
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")) & (differing <= most_different_bits(threshold)))
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def verified(least: float):
    """a, b and both texts -> a, b, similarity of the pairs with at least ``least``.

    Sorted hashes of runs tell the pairs that are clearly below; the rest is compared run by run.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text: dict[int, str] = {}
            for ids, column in ((a, 2), (b, 3)):
                first = {i: k for k, i in enumerate(ids)}
                text |= zip(first, batch.column(column).take(pa.array(first.values(), pa.int64())).to_pylist())
            names = list(text)
            kept, h, starts = sketcher.shingles([text[i] for i in names])
            runs = {names[k]: np.unique(x) for k, x in zip(kept, np.split(h, starts[1:]))}
            keep, found = [], []
            for k, (i, j) in enumerate(zip(a, b)):
                x, y = runs.get(i), runs.get(j)
                if x is None or y is None:
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common < (least - 0.01) * (len(x) + len(y) - common):
                    continue
                u, v = ({*zip(w, w[1:], w[2:])} for w in (words(text[i]), words(text[j])))
                common = len(u & v)
                if common >= least * (len(u) + len(v) - common):
                    keep.append(k)
                    found.append(common / (len(u) + len(v) - common))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return verify


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of every distinct text, with its smallest id. Null ids and null texts take no part."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return rows.groupBy("text").agg(F.min("id").alias("id"))


def class_pairs(docs: DataFrame, threshold: float = 0.5, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """a < b, similarity: every found pair of different texts, each by its representative."""
    met = checkpointed(candidates(text_classes(docs, id_col, text_col).select("id", "text"), threshold))
    needed = met.select(F.col("a").alias("id")).union(met.select("b")).distinct()
    n = needed.count()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    texts = rows.join(sized_broadcast(needed, n, TEXT_ROWS), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    both = met.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(verified(threshold), "a long, b long, similarity double")


def copy_members(docs: DataFrame, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """id, class_id, copies for every id of a text of at least ``SHINGLE`` words that occurs under several ids."""
    h = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("id", *h, (F.size(F.expr(r"filter(split(lower(text), '(?U)[^\\p{L}\\p{N}]+'), w -> w <> '')")) >= SHINGLE).alias("long_enough")).filter("long_enough")
    rows = rows.select("id", "h1", "h2")
    sizes = rows.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.max("id").alias("last"), F.count("*").alias("copies")).filter("class_id < last")
    return rows.join(sizes, ["h1", "h2"]).select("id", "class_id", "copies").distinct()


def near_pairs(docs: DataFrame, threshold: float = 0.5, id_col: str = "article_id", text_col: str = "text", expanded: int = EXPANDED_COPIES) -> DataFrame:
    """article_a < article_b of all pairs of texts with at least ``threshold`` of their union in common.

    Texts with one meaning of words and runs (case, marks) are pairs of similarity 1. A text that occurs
    under up to ``expanded`` ids stands for each of them, so that all pairs come out. A larger class of
    copies is written as pairs of its smallest id with every other one, and stands for itself by that id:
    no link between different texts is lost, and ``near_groups`` has the membership of every copy.

    Null texts and texts of fewer than three words are no case. Repeated rows of one id count once; of an id
    with several texts only the least is compared. An empty table gives no rows.
    """
    members = checkpointed(copy_members(docs, id_col, text_col))
    pairs = class_pairs(docs, threshold, id_col, text_col)
    own = F.col("copies") <= expanded
    wide = members.filter(own).select(F.col("class_id"), F.col("id").alias("member"))
    out = pairs
    for side in ("a", "b"):
        out = out.join(wide.withColumnsRenamed({"class_id": side, "member": f"{side}_member"}), side, "left").withColumn(side, F.coalesce(f"{side}_member", side)).drop(f"{side}_member")
    small = wide.alias("x").join(wide.alias("y"), (F.col("x.class_id") == F.col("y.class_id")) & (F.col("x.member") < F.col("y.member"))).select(F.col("x.member").alias("a"), F.col("y.member").alias("b"))
    large = members.filter(~own & (F.col("id") > F.col("class_id"))).select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    every = out.select("a", "b").union(small).union(large).filter("a <> b")
    return every.select(F.least("a", "b").alias("article_a"), F.greatest("a", "b").alias("article_b")).distinct()


def near_groups(docs: DataFrame, threshold: float = 0.5, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """One row per article with a text: article_id, class_id (its text's smallest id), group_id (the smallest id of
    all texts it is connected to by near-duplicate links) and links (other texts it is linked to).

    Groups are found by label propagation with pointer jumping, checkpointed at each round; the number of
    rounds grows with the logarithm of the longest chain.
    """
    links = checkpointed(class_pairs(docs, threshold, id_col, text_col).select("a", "b"))
    both = links.union(links.select("b", "a")).toDF("v", "u")
    label = checkpointed(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("g")))
    while True:
        low = both.join(label.withColumnsRenamed({"v": "u"}), "u").groupBy("v").agg(F.min("g").alias("near"))
        step = label.join(low, "v").select("v", "g", F.least("g", "near").alias("to"))
        jump = label.select(F.col("v").alias("to"), F.col("g").alias("over"))
        new = checkpointed(step.join(jump, "to", "left").select("v", F.least("to", F.coalesce("over", "to")).alias("g"), (F.least("to", F.coalesce("over", "to")) < F.col("g")).alias("moved")))
        label = new.select("v", "g")
        if new.filter("moved").isEmpty():
            break
    counts = both.groupBy("v").agg(F.count_distinct("u").alias("links"))
    rows = docs.select(F.col(id_col).cast("long").alias("article_id"), F.col(text_col).alias("text")).filter("article_id IS NOT NULL AND text IS NOT NULL").select("article_id").distinct()
    members = copy_members(docs, id_col, text_col).groupBy("id").agg(F.min("class_id").alias("class_id"))
    rows = rows.join(members.withColumnsRenamed({"id": "article_id"}), "article_id", "left").withColumn("class_id", F.coalesce("class_id", "article_id"))
    rows = rows.join(label.withColumnsRenamed({"v": "class_id"}), "class_id", "left").join(counts.withColumnsRenamed({"v": "class_id"}), "class_id", "left")
    return rows.select("article_id", "class_id", F.coalesce("g", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
