"""Variant spellings of names typed by people (problem 7), by a noisy-channel model.

What was meant (a canonical name) went through a channel that adds typing errors, abbreviates, drops,
reorders or decorates words, and came out as what was typed. Every distinct spelling is attached to the
canonical name of the highest posterior: the name's share among the spellings of the corpus as prior,
times the likelihood of the cheapest way from the name to the spelling. It stays unattached when no way
is likely enough, or when two names are about as likely.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Nicknames, decorations and abbreviations in use.
NICKNAMES = {
    "alexander": "alex al sandy xander sasha", "charles": "charlie chuck chas", "christopher": "chris kit topher", "deborah": "deb debbie debby", "edward": "ed eddie ted ned",
    "elizabeth": "liz beth betty eliza lizzie libby", "francesca": "fran frankie chesca franny", "gabriel": "gabe", "guadalupe": "lupe lupita", "henrietta": "hetty etta henny hattie",
    "johannes": "hans jo johann", "josephine": "josie jo", "katherine": "kathy kate katie kat kitty kay", "lawrence": "larry laurie lars", "margaret": "peggy maggie meg marge greta",
    "michael": "mike mick mickey", "nathaniel": "nate nat nathan", "patricia": "pat patty tricia trish", "richard": "rick dick rich ricky", "robert": "bob rob bobby bert",
    "samuel": "sam sammy", "thomas": "tom tommy", "victoria": "vicky vic tori vicki", "william": "bill will billy liam",
}
TITLES = set("dr mr mrs ms prof sir".split())
LEGAL = set("inc ltd co corp company group holdings holding ag sa plc llc gmbh limited incorporated corporation nv se lp spa".split())
ABBREVIATIONS = {"semiconductor": {"semi", "semis", "semicon", "sc"}, "foundry": {"fab", "fdry"}, "analog": {"analogue"}, "packaging": {"pkg", "pack"}, "management": {"mgmt", "mgt"}, "networks": {"net", "nets", "network"}, "lithography": {"litho"}, "international": {"intl"}, "technologies": {"tech", "techs"}}

# Costs: negative log likelihoods of one step of the channel.
RESTYLE, DECORATE, REORDER, ABBREVIATE, NICKNAME, INITIAL, MIDDLE, DROP, ACRONYM, TYPO, FIRST_LETTER, REAL_WORD = 0.2, 0.7, 0.8, 1.0, 1.0, 1.5, 0.8, 2.0, 2.5, 2.2, 2.0, 6.0
#: The costliest attachment, and the least posterior among the names that could have been meant.
MOST_COST, LEAST_POSTERIOR = 10.0, 0.8
#: Up to so many canonical names each task holds their index; more are met by a join on keys, with the same results.
INDEXED_NAMES = 50_000


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower().replace("s/c", "sc"))


def distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from ``a`` to ``b``; ``most`` + 1 when more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletions(word: str, most: int) -> set[str]:
    """``word`` with up to ``most`` letters left out; two words within as many edits share one of them."""
    out, ring = {word}, {word}
    for _ in range(most):
        ring = {w[:k] + w[k + 1 :] for w in ring for k in range(len(w)) if len(w) > 3}
        out |= ring
    return out


def _abbreviates(short: str, full: str) -> bool:
    if short in ABBREVIATIONS.get(full, ()):
        return True
    if len(short) >= len(full) or len(short) < 2 or short[0] != full[0]:
        return False
    if full.startswith(short):
        return True
    rest = iter(full)
    return all(c in rest for c in short) and (short[-1] in full[-2:] or len(short) <= 4) and len(short) <= 0.7 * len(full)


class Channel:
    """The canonical names with what the channel needs to know of them."""

    def __init__(self, names: list[tuple[int, str, bool, int]], real: set[str] | None = None):
        """``names``: id, name, whether a person's, and how often it is spelled exactly so. ``real``: words that are part
        of any name, where these are not all names."""
        self.names = {i: (words(n), person, n) for i, n, person, _ in names}
        self.prior = {i: math.log(1 + seen) for i, _, _, seen in names}
        self.real = {w for ws, _, _ in self.names.values() for w in ws} if real is None else real
        self.initials: dict[int, set[str]] = {}
        for i, (ws, person, _) in self.names.items():
            first = "".join(w[0] for w in ws)
            self.initials[i] = set() if person or len(ws) < 2 else {first + s for s in ("", "c", "i", "l", "g", "h") if len(first + s) >= 3}
        self.index: dict[str, set[int]] = defaultdict(set)
        for i, (ws, person, _) in self.names.items():
            for k in self.keys_of_name(ws, person):
                self.index[k].add(i)

    @staticmethod
    def keys_of_name(ws: list[str], person: bool) -> set[str]:
        """The word that tells a name apart, the name without blanks, and its initials."""
        if not ws:
            return set()
        own = ws[-1] if person else ws[0]
        keys = {"w" + d for d in deletions(own, 2)} | {"j" + d for d in deletions("".join(ws), 1)}
        if not person:
            first = "".join(w[0] for w in ws)
            keys |= {"a" + first + s for s in ("", "c", "i", "l", "g", "h")}
        return keys

    @staticmethod
    def keys_of_spelling(text: str) -> set[str]:
        ws = [w for w in words(text) if w not in TITLES]
        keys = {"w" + d for w in ws if len(w) > 3 for d in deletions(w, 2)}
        joined = "".join(w for w in ws if w not in LEGAL) or "".join(ws)
        keys |= {"j" + d for d in deletions(joined, 1)}
        if len(ws) == 1 and len(ws[0]) <= 6:
            keys.add("a" + ws[0])
        return keys

    def _word(self, typed: str, full: str) -> float:
        """Cost of typing ``typed`` for the word ``full``."""
        if typed == full:
            return 0.0
        if _abbreviates(typed, full):
            return ABBREVIATE
        d = distance(full, typed)
        if d > 2 or d > 0.34 * len(full):
            return math.inf
        return TYPO * d + FIRST_LETTER * (typed[0] != full[0] and sorted(typed[:2]) != sorted(full[:2])) + REAL_WORD * (typed in self.real)

    def _own(self, typed: str, full: str) -> float:
        """As ``_word`` for the word that tells a name apart: it is mistyped, but not abbreviated."""
        if typed == full:
            return 0.0
        if len(typed) < 4 or (d := distance(full, typed)) > 2 or d > 0.34 * len(full):
            return math.inf
        return TYPO * d + FIRST_LETTER * (typed[0] != full[0] and sorted(typed[:2]) != sorted(full[:2])) + REAL_WORD * (typed in self.real)

    def _given(self, typed: str, full: str) -> float:
        if len(typed) == 1:
            return INITIAL if typed == full[0] else math.inf
        if typed in NICKNAMES.get(full, "").split():
            return NICKNAME
        return self._word(typed, full)

    def _person(self, ts: list[str], ws: list[str]) -> float:
        cost = DECORATE * (len(ts) != len(ts := [t for t in ts if t not in TITLES]))
        titled = cost > 0
        given, family = ws[0], ws[-1]
        best = math.inf
        for k, t in enumerate(ts):
            c = self._own(t, family)
            if c == math.inf:
                continue
            rest = ts[:k] + ts[k + 1 :]
            long = [r for r in rest if len(r) > 1]
            if not rest:
                best = min(best, cost + c + DROP * (1 if titled else 1.5))
                continue
            if len(long) > 1 or len(rest) > 2:
                continue
            first = long[0] if long else rest[0]
            extra = len(rest) - 1
            moved = REORDER * (k == 0)
            best = min(best, cost + c + self._given(first, given) + moved + MIDDLE * extra)
        return best

    def _organisation(self, ts: list[str], ws: list[str]) -> float:
        cost = 0.0
        if ts and ts[0] == "the" and ws[0] != "the":
            ts, cost = ts[1:], cost + DECORATE
        while len(ts) > 1 and ts[-1] in LEGAL and ts[-1] not in ws:
            ts, cost = ts[:-1], cost + DECORATE
        if not ts or len(ts) > len(ws):
            return math.inf
        own = [self._own(t, ws[0]) for t in ts]
        k = min(range(len(ts)), key=own.__getitem__)
        if own[k] == math.inf:
            return math.inf
        cost += own[k]
        left, at, order = list(range(1, len(ws))), [], []
        for j, t in enumerate(ts):
            if j == k:
                order.append(0)
                continue
            fit = min(((self._word(t, ws[i]), i) for i in left), default=(math.inf, 0))
            if fit[0] == math.inf:
                if len(left) > 1 and t == "".join(ws[i][0] for i in left[-len(t) :]) and len(t) > 1:
                    cost += ABBREVIATE  # initials of the last words
                    order.append(left[-len(t)])
                    del left[-len(t) :]
                    continue
                return math.inf
            cost += fit[0]
            left.remove(fit[1])
            order.append(fit[1])
        if order != sorted(order):
            cost += REORDER
        return cost + DROP * min(1.5, len(left))

    def cost(self, text: str, i: int) -> float:
        ws, person, name = self.names[i]
        ts = words(text)
        if not ts or not ws:
            return math.inf
        joined, whole = "".join(ts), "".join(ws)
        if joined == whole:
            return RESTYLE
        best = self._person(ts, ws) if person else self._organisation(ts, ws)
        bare = [t for t in ts if t not in LEGAL and t not in TITLES]
        if len(whole) >= 10:
            d = distance(whole, "".join(bare), 3)
            if d <= 2 or d == 3 and (len(bare) != len(ws) or all(distance(w, t, 3) <= max(2, len(w) // 3) for w, t in zip(ws, bare))):
                best = min(best, RESTYLE + TYPO * d + DECORATE * (len(ts) - len(bare)) + REAL_WORD * (d > 0 and any(t in self.real and t not in ws for t in bare)))
        if len(ts) == 1 and joined in self.initials[i] and text.strip().isupper():
            best = min(best, ACRONYM)
        return best

    def attach(self, text: str | None) -> tuple[int, float] | None:
        """The id of the name meant by ``text`` and its posterior; None for other names."""
        if not text or not text.strip():
            return None
        found: set[int] = set()
        for k in self.keys_of_spelling(text):
            found |= self.index.get(k, set())
        return self.choose(text, found)

    def choose(self, text: str, among: set[int]) -> tuple[int, float] | None:
        return self.best(self.scored(text, among))

    def scored(self, text: str, among: set[int]) -> list[tuple[float, float, int]]:
        return [(c - 0.3 * self.prior[i], c, i) for i in among if (c := self.cost(text, i)) <= MOST_COST]

    @staticmethod
    def best(scored: list[tuple[float, float, int]]) -> tuple[int, float] | None:
        scored = sorted(scored)
        if not scored:
            return None
        top = scored[0][0]
        posterior = 1 / sum(math.exp(top - s) for s, _, _ in scored)
        return (scored[0][2], posterior) if posterior >= LEAST_POSTERIOR else None


def spellings(edges: DataFrame, sides: tuple[str, ...] = ("sub", "obj")) -> DataFrame:
    """Every distinct typed value with its number of rows over both sides."""
    stacked = edges.select(F.explode(F.array(*[F.col(s) for s in sides])).alias("spelling")).filter("spelling IS NOT NULL")
    return stacked.groupBy("spelling").agg(F.count("*").alias("rows"))


def variant_map(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """spelling, entity_id, posterior for each distinct spelling that means an entity but is not its name.

    Exact names and exact tickers are left out before anything is scored. Entities with a null or blank
    name take no part; of two rows with one id the first in order of name counts.
    """
    listed = entities.filter("entity_id IS NOT NULL AND entity_name IS NOT NULL").groupBy("entity_id").agg(
        F.min("entity_name").alias("entity_name"), F.min(F.col("entity_type") == "PERSON").alias("person")
    )
    typed = spellings(edges)
    names = listed.join(typed.withColumnRenamed("spelling", "entity_name"), "entity_name", "left").select(
        "entity_id", "entity_name", F.coalesce("person", F.lit(False)).alias("person"), F.coalesce("rows", F.lit(0)).alias("rows")
    )
    known = listed.select(F.col("entity_name").alias("spelling")).union(entities.filter("ticker IS NOT NULL").select("ticker"))
    open_ = typed.join(known.distinct(), "spelling", "left_anti").select("spelling")
    if listed.count() > INDEXED_NAMES:
        return _by_keys(open_, names)
    canon = [tuple(r) for r in names.collect()]  # at most INDEXED_NAMES rows

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(canon)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            hits = [(t, *hit) for t in texts if (hit := channel.attach(t))]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())], ["spelling", "entity_id", "posterior"])

    # Few bytes, much work: without a number of its own this stage would be merged into one task.
    tasks = 4 * max(1, entities.sparkSession.sparkContext.defaultParallelism)
    return open_.repartition(tasks).mapInArrow(attach, "spelling string, entity_id long, posterior double")


def _by_keys(open_: DataFrame, names: DataFrame) -> DataFrame:
    """The same attachment where the names are too many to hold: candidates meet on their keys.

    Each spelling brings those of its words that are part of any name, so that costs are those of the index; the names
    likely enough for one spelling are weighed in one place, as there.
    """
    name_keys = F.udf(lambda n, p: sorted(Channel.keys_of_name(words(n), p)), "array<string>")
    text_keys = F.udf(lambda t: sorted(Channel.keys_of_spelling(t)), "array<string>")
    words_of = F.udf(lambda t: sorted(set(words(t))), "array<string>")
    real = names.select(F.explode(words_of("entity_name")).alias("word")).distinct()
    own = open_.select("spelling", F.explode(words_of("spelling")).alias("word")).join(real, "word").groupBy("spelling").agg(F.collect_list("word").alias("real"))
    left = open_.select("spelling", F.explode(text_keys("spelling")).alias("key"))
    right = names.select("entity_id", "entity_name", "person", "rows", F.explode(name_keys("entity_name", "person")).alias("key"))
    pairs = left.join(right, "key").drop("key").distinct().join(own, "spelling", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                channel = Channel([(r["entity_id"], r["entity_name"], r["person"], r["rows"])], set(r["real"] or ()))
                out += [(r["spelling"], *x) for x in channel.scored(r["spelling"], {r["entity_id"]})]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))], ["spelling", "score", "cost", "entity_id"])

    @F.arrow_udf("struct<entity_id: long, posterior: double>")
    def best(lists: pa.Array) -> pa.Array:
        hits = [Channel.best([(x["score"], x["cost"], x["entity_id"]) for x in each]) for each in lists.to_pylist()]
        return pa.array([h and {"entity_id": h[0], "posterior": h[1]} for h in hits], pa.struct([("entity_id", pa.int64()), ("posterior", pa.float64())]))

    scored = pairs.mapInArrow(score, "spelling string, score double, cost double, entity_id long")
    met = scored.groupBy("spelling").agg(F.collect_list(F.struct("score", "cost", "entity_id")).alias("l"))  # only names of a cost up to MOST_COST
    return met.select("spelling", best("l").alias("b")).filter("b IS NOT NULL").select("spelling", "b.entity_id", "b.posterior")


def linked_variants(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edge_id, side, entity_id of every variant spelling, once per edge and side.

    Repeated rows of an edge count once; null and blank names are no case.
    """
    links = variant_map(edges, entities)
    sides = edges.select("edge_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("spelling")) for s in ("sub", "obj")])).alias("x"))
    rows = sides.select("edge_id", "x.side", "x.spelling").filter("spelling IS NOT NULL")
    return rows.join(links, "spelling").groupBy("edge_id", "side").agg(F.max("entity_id").alias("entity_id"))
