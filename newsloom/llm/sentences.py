"""Sentence units of documents in any language or script (problem 10).

A text falls into blocks at blank lines. In a block every place behind end marks (and the quotation marks
or brackets that close after them), and in Thai a blank between two Thai letters, is a candidate. A
semi-Markov dynamic programme then chooses whole spans between candidates. The score of a span is the sum
of four parts, in units of log odds:

* its length, by a distribution in classes (``LENGTHS``);
* its opening word, and whether it is set off from what stands before;
* its closing word and mark: abbreviations, ordinals and initials score low, but may still end a sentence
  where the other parts outweigh that;
* balance: each closed pair of quotation marks or brackets that is open at one of its ends costs ``BALANCE``.

No candidate is decided beforehand. Opening, closing and balance belong to the ends of a span and length is
constant in each class, so the best start in a class is the front of a sliding window's queue: time is the
number of candidates times the number of classes, however long the block and whatever it consists of.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations, by what they ask of the next word.
#: Always followed by the rest of their sentence.
NEVER_LAST = set(
    "e.g i.e no nos vs approx dr mr mrs ms prof st fig jan feb mar apr jun jul aug sept sep oct nov dec cf gen rep sen gov est ca bzw nr mio mrd "
    "z d u s.o u.a z.b d.h usw.z evtl ggf inkl abs p ex p.ex env n m mm mme mlle sr sra sres srta p.ej ej aprox núm pág ee art vol ed al د أ डॉ श्री सुश्री पं".split()
)
#: May end a sentence too; the next word and the lengths decide.
MAYBE_LAST = set("inc ltd co corp llc plc u.s u.k e.u u.n p.m a.m jr sr.jr etc ag gmbh s.a uu usw bros dept ph.d b.a m.a".split())
#: German months, before which a number with a full stop is a date.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Written with a capital, these seldom stand anywhere but at the start of a sentence.
OPENING_WORDS = set(
    "the a an it its this that these those he she they we you i in on at as if but and when while after before for with from what who why how will there "
    "der die das ein eine es er sie wir ihr im am bei nach mit wie was warum wann wenn doch und aber le la les un une il elle ils elles nous vous dans en au aux après avec "
    "qui que pourquoi comment et mais el los las una ella ellos nosotros tras con por para cuando pero y según los al su sus".split()
)
#: In the clause behind a closed quotation, these say that the quotation is part of its sentence.
SAYING = {"zh": ("说", "表示", "称", "道", "看法", "說", "稱", "认为"), "ja": ("と", "って"), "hi": ("कह", "बताया", "बोल")}

OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "（": "）", "(": ")", "[": "]", "‘": "’"}
OPENED_BY = {c: [o for o, cs in OPENERS.items() if c in cs] for c in "”“»›」』》）)]’"}
MARKS = re.compile(r"[“”„«»‹›「」『』《》（）()\[\]‘\"]|’(?!\w)")
ENDS = re.compile("(?:[.]{2,}|[.!?…।॥؟。！？｡])(?:[.!?…।॥؟。！？｡]|\\s*»|[”“’\"'›」』》）)\\]\u200b])*")
BLOCK = re.compile("\r?\n[^\\S\n]*(?:\r?\n[^\\S\n]*)+|\u2029")
THAI = re.compile("[ก-ฺ]")
THAI_BLANK = re.compile("(?<=[ก-ฺเ-๎])\\s*[^\\S\n]\\s*(?=[ก-ฺเ-๎])")
BETWEEN_WORDS = re.compile(r"[\s“”„«»‹›「」『』（）()\[\]¿¡,;:]")
STRONG, FULL_WIDTH = "!?।॥؟。！？｡", "。！？｡।॥؟」』》"
STOP = re.compile(r"[。！？।?!]")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
LETTER = re.compile(r"\w")
WORD = re.compile(r"\w+")
FOLLOWING = re.compile(r"\s*([^\s.,;!?\u200b]+)")

#: Length classes: below so many characters (a wide one counts ``WIDTH``) a span scores so much.
LENGTHS = ((1, -30.0), (3, -4.5), (6, -3.5), (10, -2.5), (18, -1.2), (30, -0.6), (320, 0.0), (700, -0.8), (float("inf"), -2.0))
WIDTH = 2.5
#: Cost of each closed pair that is open at an end of a span; more than any end can gain.
BALANCE = -40.0
LONGEST_ABBREVIATION = max(map(len, NEVER_LAST | MAYBE_LAST))


def _pairs(block: str) -> list[tuple[int, int]]:
    """Outermost closed pairs of quotation marks and brackets, as positions of the two marks.

    A closing mark closes the nearest opening one of its kind; what was opened in between and not closed is
    text. A straight quotation mark closes where one is open, and opens where a word follows it.
    """
    stack: list[tuple[str, int]] = []
    of_kind: dict[str, list[int]] = {}
    done: list[tuple[int, int]] = []
    n = len(block)
    for m in MARKS.finditer(block):
        ch, at = m.group(), m.start()
        level = -1
        for kind in OPENED_BY.get(ch, ('"',) if ch == '"' else ()):
            levels = of_kind.get(kind)
            if levels and levels[-1] > level:
                level = levels[-1]
        if level >= 0:
            start = stack[level][1]
            while len(stack) > level:
                of_kind[stack.pop()[0]].pop()
            while done and done[-1][0] > start:
                done.pop()
            done.append((start, at))
        elif ch in OPENERS or ch == '"' and at + 1 < n and not block[at + 1].isspace() and (at == 0 or not block[at - 1].isalnum()):
            of_kind.setdefault(ch, []).append(len(stack))
            stack.append((ch, at))
    return done


def _closing(block: str, word_from: int, at: int, end: int) -> float:
    """Score of a span whose end marks stand at ``at:end``: how well its closing word ends a sentence."""
    mark = block[at]
    if mark in STRONG:
        return 4.0
    if mark == "…" or block.startswith("..", at):
        return 1.0
    if at - word_from > LONGEST_ABBREVIATION + 4:
        return 3.0
    word = unicodedata.normalize("NFC", block[word_from:at].replace("\u200b", ""))
    low = word.lower()
    if low in MAYBE_LAST:
        return 1.0
    if low in NEVER_LAST:
        return -7.0
    if len(word) == 1 and word.isalpha():
        return -7.0 if word.isupper() else -0.5
    if word.isdigit():
        follow = FOLLOWING.match(block, end)
        if follow and unicodedata.normalize("NFC", follow.group(1)[:24]).lower() in MONTHS:
            return -7.0
        return 2.0
    return 3.0


def _opening(block: str, at: int, end: int, closed: bool, cased: bool) -> float:
    """Score of a span that starts behind ``end``: how well its opening word begins a sentence."""
    k, n = end, len(block)
    while k < n and (block[k].isspace() or block[k] == "\u200b"):
        k += 1
    if k == n:
        return 0.0
    ch = block[k]
    before = block[end - 1]
    if closed:
        hindi = "।" in block[at:end]
        if hindi or WIDE.search(block, max(0, end - 12), end):
            stop = STOP.search(block, k)
            clause = block[k : stop.start() if stop else n]
            if hindi and any(s in clause for s in SAYING["hi"]) or not hindi and (clause.startswith(SAYING["ja"]) or any(s in clause for s in SAYING["zh"])):
                return -9.0
    if k == end and not (WIDE.match(ch) or before in FULL_WIDTH or WIDE.match(block[end - 2 : end - 1] or "")):
        # no blank: only a small letter, then the mark, then a word with a capital is a sentence set too close
        small = at > 1 and (block[at - 1].islower() or block[at - 1] in "%)”") and block[at - 2] != "."
        return 0.5 if small and ch.isupper() and k + 1 < n and (block[k + 1].islower() or block[k + 1].isspace()) else -12.0
    if ch in OPENERS or ch in "¿¡\"'•*":
        return 1.5
    if ch.isdigit():
        return 1.0
    if ch.islower():
        word = WORD.match(block, k, k + 40)
        if word and any(c.isupper() for c in word.group()):
            return 0.5  # a name that is written small first
        return -9.0 if cased else 0.5
    if ch.isalpha():
        word = WORD.match(block, k, k + 12) if ch.isupper() else None
        return 3.5 if word and word.group().lower() in OPENING_WORDS else 1.2
    if ch in ",;:)]»”–—-":
        return -12.0
    return 0.5


def _block(block: str) -> list[tuple[int, int]]:
    pairs = _pairs(block)
    cased = any(c.isupper() for c in block)
    places: list[tuple[int, float]] = []
    p, word_from, looked = 0, 0, 0
    for m in ENDS.finditer(block):
        at, end = m.span()
        for b in BETWEEN_WORDS.finditer(block, looked, at):
            word_from = b.end()
        looked = at
        while p < len(pairs) and pairs[p][1] < at:
            p += 1
        closed, inside, q = False, False, p
        while q < len(pairs) and pairs[q][0] < end:
            if pairs[q][0] >= at:  # a mark that opens belongs to the next sentence
                end = pairs[q][0]
                break
            closed = True
            inside = pairs[q][1] >= end
            if inside:
                break
            q += 1
        if at < end < len(block):
            places.append((end, _closing(block, word_from, at, end) + _opening(block, at, end, closed, cased) + (2 * BALANCE if inside else 0.0)))
    if THAI.search(block):
        p = 0
        for m in THAI_BLANK.finditer(block):
            at = m.start()
            while p < len(pairs) and pairs[p][1] < at:
                p += 1
            inside = p < len(pairs) and pairs[p][0] < at
            places.append((at, 36.0 + (2 * BALANCE if inside else 0.0)))
        places.sort()
    return _best(block, places)


def _best(block: str, places: list[tuple[int, float]]) -> list[tuple[int, int]]:
    """The spans of the highest total score from the start of the block to its end."""
    if not places:
        return [(0, len(block))]
    ends = [0, *(e for e, _ in places), len(block)]
    gain = [0.0, *(g for _, g in places), 0.0]
    n = len(ends)
    width = 1 + (WIDTH - 1) * len(WIDE.findall(block)) / len(block)
    # lengths add up; a piece without any letter adds nothing
    total = [0.0] * n
    for j in range(1, n):
        total[j] = total[j - 1] + ((ends[j] - ends[j - 1]) * width if LETTER.search(block, ends[j - 1], ends[j]) else 0.0)
    best, back = [0.0] * n, [0] * n
    queues: list[deque[int]] = [deque() for _ in LENGTHS]
    entered = [0] * len(LENGTHS)
    for j in range(1, n):
        top, at, low = float("-inf"), 0, 0.0
        here = total[j]
        for c, (high, score) in enumerate(LENGTHS):
            queue, i = queues[c], entered[c]
            while i < j and here - total[i] >= low:  # starts that have become long enough for this class
                while queue and best[queue[-1]] <= best[i]:
                    queue.pop()
                queue.append(i)
                i += 1
            entered[c] = i
            while queue and here - total[queue[0]] >= high:  # and those too long for it
                queue.popleft()
            if queue and best[queue[0]] + score > top:
                top, at = best[queue[0]] + score, queue[0]
            if i == 0:
                break  # nothing is as long as the next classes ask
            low = high
        best[j], back[j] = top + gain[j], at
    spans, j = [], n - 1
    while j > 0:
        spans.append((ends[back[j]], ends[j]))
        j = back[j]
    return spans[::-1]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans (start, end) of the sentences of ``text`` in characters, without blanks at either side."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*BLOCK.finditer(text), None]:
        stop = m.start() if m else len(text)
        block = text[at:stop]
        if block and not block.isspace():
            for a, b in _block(block):
                while a < b and block[a].isspace():
                    a += 1
                while b > a and block[b - 1].isspace():
                    b -= 1
                if b > a:
                    out.append((at + a, at + b))
        at = m.end() if m else stop
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    found = [[{"start_pos": a, "end_pos": b} for a, b in sentences(t)] for t in texts.to_pylist()]
    return pa.array(found, pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())])))


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: ``id_col``, start_pos, end_pos. Null, empty and blank texts have none.

    Repeated rows yield their sentences again. No shuffle; texts of any length are cut whole.
    """
    return docs.select(F.col(id_col), F.explode(_spans(F.col(text_col))).alias("s")).select(id_col, "s.start_pos", "s.end_pos")


def sentence_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``sentence_spans``, with the sentence itself as ``sentence``."""
    cut = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.explode(_spans(F.col(text_col))).alias("s"))
    return cut.select(id_col, "s.start_pos", "s.end_pos", F.substring("_text", F.col("s.start_pos") + 1, F.col("s.end_pos") - F.col("s.start_pos")).alias("sentence"))
