"""Answers that do not properly answer their input (problem 2).

Per answer, in this order: 'empty', 'truncated', 'refusal', 'copy', 'other_language'. A pushdown parser
reads fences, brackets and quotations and yields the tuples and what was left open. Greedy string
tiling measures how much of the answer is the input's wording. Refusals are known by a small grammar
(someone who declines, a modal or negation, an act of work) in several languages. Languages are told
apart by script, by function words, and for the short labels in tuples by a classifier that is fitted on
the answers themselves: labels take the language of the inputs they are mostly used with.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words by language.
FUNCTION_WORDS = {
    "en": set("the of and to in its is are was were for said with as at by on a an that this from be has have will not it now after than before while i we you my your cannot can".split()),
    "de": set("der die das den dem des und von für im in mit auf nach eine ein einen einer wegen ich zu nicht bei trotz um aus sich ist wird diese diesem keine kann infolge dank wir".split()),
    "fr": set("le la les des de du et à pour dans une un après en sur par est ne pas je ce cette avec au aux malgré chez il se qui son l d leur plus depuis".split()),
    "es": set("el la los las de del y por para en una un con tras no se al es este esta su lo que pese puedo hacia gracias ante desde sobre entre hasta sus más".split()),
}
LANGUAGES_OF = {w: [g for g, ws in FUNCTION_WORDS.items() if w in ws] for w in set().union(*FUNCTION_WORDS.values())}
SCRIPTS = [("ja", "぀-ヿ"), ("zh", "㐀-鿿"), ("ko", "가-힯"), ("hi", "ऀ-ॿ"), ("ar", "؀-ۿ"), ("th", "฀-๿"), ("ru", "Ѐ-ӿ")]
SCRIPT_PATTERNS = [(lang, re.compile(f"[{span}]")) for lang, span in SCRIPTS]
ANY_SCRIPT = re.compile("[" + "".join(span for _, span in SCRIPTS) + "]")
LETTERS = re.compile(r"[^\W\d_]")

# The words of the refusal grammar, by category; within a category by language.
REFUSAL_WORDS = {
    # who answers
    "S": r"\bi\b|\bwe\b|\bm[ey]\b|\bour\b|\bus\b|\b(?:this|the|an)\s+(?:tool|assistant|model|system|service)\b|\bich\b|\bwir\b|\bmi[rch]+\b|\bmeine?\w?\b|\bunser\w*|\bje\b|\bj['’]|\bnous\b|\bm['’]|\bmoi\b|\bmes\b|\bnotre\b|\byo\b|\bpuedo\b|\bpodemos\b|\bdebo\b|\bquiero\b|\bdeseo\b|\bprefiero\b|\bestoy\b|\bvoy\b|\bposso\b|\bik\b|\bя\b|مكنني|مكننا|أستطيع|نستطيع|मैं|हम\b|私|我|저는|ฉัน|ผม",
    # negation
    "N": r"\b(?:can)?not\b|n['’]t\b|\bnever\b|\bno\b|\bnone\b|\bnicht\b|\bnichts\b|\bkeine?\w?\b|\bne\b|\bn['’](?=\w)|\bnon\b|\bnão\b|\bniet\b|\bне\b|\bلا\b|\bلن\b|غير|नहीं|ない|ません|不|没|無|ไม่|않|없|못",
    # verbs and words that decline by themselves
    "R": r"\b(?:declin|refus)\w*|\bunable\b|\b(?:to|must|i['’]?ll|will)\s+(?:pass|skip|abstain)\b|\bablehn\w*|\blehne\b|\bverweiger\w*|\brechaz\w*|\bme\s+niego\b|\bimposible\b|\bimpossib\w*|\baußerstande\b|\bincapa[zc]\w*|أرفض|نرفض|असमर्थ|できかね|いたしかね|断り|控え|遠慮|无法|無法|拒绝|拒絕|ปฏิเสธ|거절|불가",
    # what is asked for
    "A": r"\b(?:extract|provid|process|analy[sz]|label|help|answer|produc|turn|comment|handl|perform|complet|fulfil|assist|respond|creat|generat|generat|output|list|tag|return|support|summari[sz]|shar|giv|carry|comply|disclos|nam|treat)(?:e|es|s|ed|ing|n|ling)?\b|\btake\b|\bdo(?:ne)?\s+(?:this|that|so|it)\b|\b(?:be|get)\s+done\b|\bextrahier\w*|\bausführ\w*|\bmachen\b|\bbearbeit\w*|\bbeantwort\w*|\bantwort\w*|\bhelfen\b|\bverarbeit\w*|\banalysier\w*|\bgeben\b|\bliefer\w*|\berstell\w*|\bnennen\b|\bextrai\w*|\btraite\w*|\brépond\w*|\bfourni\w*|\bdonner\b|\baider\b|\beffectuer\b|\brespond\w*|\bextrae\w*|\bprocesar\b|\bcontest\w*|\bayud\w*|\bproporcion\w*|\brealizar\b|\bdar\b|\banali[sz]\w*|\bprocessar\b|\baiut\w*|\belabor\w*|\bhelpen\b|\bverwerken\b|обраб\w*|ответ\w*|извле\w*|معالج\w*|استخراج|المساعدة|الإجابة|कर\s*सक\w*|निकाल\w*|でき|対応|答え|提供|处理|處理|回答|完成|提取|协助|協助|สามารถ|ตอบ|ช่วย|할\s*수|답변|처리|추출",
    # what may or may not be
    "P": r"\b(?:allow|permit)\w*|\bappropriate\b|\bpossible\b|\bproper\b|\bauthori[sz]ed\b|\bavailable\b|\bable\b|\bmöglich\b|\berlaubt\b|\bgestattet\b|\bvorgesehen\b|\bzulässig\b|\bautoris\w*|\bpermis\w*|\bpermiti\w*|\bposible\b|\bautoriza\w*|\bpossibile\b|\bpossível\b|允许|可能|許可",
    # the task
    "T": r"\b(?:request|question|task|article|passage|input|prompt|query|document|material|extraction|naming|labelling|labeling|tagging)s?\b|\baufgabe\b|\banfrage\b|\bartikel\w*|\bextraktion\b|\btexte?\b|\bdemande\b|\btâche\b|\bartículo\b|\bpetición\b|\bsolicitud\b|\btarea\b|文章|请求|請求|記事|依頼|مقال\w*|طلب\w*|लेख|अनुरोध|บทความ|คำขอ|기사|요청",
    # what would have been extracted
    "E": r"\b(?:relation(?:ship)?|triplet|triple|fact|entit(?:y|ie)|edge|tuple)s?\b|\bbeziehung\w*|\btripel\b|\bentité\w*|\brelacion\w*|\btripleta\w*|\bentidad\w*|关系|三元组|関係",
    # limits of what is done
    "B": r"\boutside\b|\bbeyond\b|\bagainst\b|\baußerhalb\b|\ben\s+dehors\b|\bfuera\s+de\b|超出|範囲外",
    "D": r"\bscope\b|\bpolic(?:y|ies)\b|\brules\b|\bguidelines\b|\bcover\w*|\bremit\b|\brichtlinien?\b|\bpolitique\b|\bnormas\b|\bpolítica\b|范围|政策|範囲外",
    # switched off, or left to somebody else
    "O": r"\b(?:switch|turn)ed\s+off\b|\b(?:disabl|block|restrict|suspend|prohibit|forbid)\w*|\bdeaktiviert\b|\bgesperrt\b|\bdésactiv\w*|\bdesactivad\w*",
    "H": r"\b(?:person|human|people|colleague|expert|staff)s?\b|\bmensch\w*|\bpersonne\b|\bpersona\b",
    # regret
    "G": r"\bsorry\b|\bapolog\w*|\bregret\w*|\bunfortunately\b|\bleider\b|\bbedau\w+|\btut\s+mir\s+leid\b|\bentschuldig\w*|\bdésolée?\b|\bmalheureusement\b|\bnavrée?\b|\blo\s+siento\b|\blament\w*|\bdisculp\w*|\bperdón\b|\bdesculp\w*|\bmi\s+dispiace\b|\bspijt\b|извин\w*|抱歉|对不起|對不起|遗憾|遺憾|申し訳|恐れ入|क्षमा|माफ़|माफ|खेद|عذر|آسف|ขออภัย|ขอโทษ|죄송",
    # finding
    "F": r"\b(?:f[io]u?nd|identif\w+|detect\w*|present|contain\w*|exist\w*|mention\w*)\b|\bgefunden\b|\benthalten\b|\btrouvé\w*|\bencontr\w*|\bhallad\w*|找到|发现|見つか",
}
CATEGORY = re.compile("|".join(f"(?P<{c}>{words})" for c, words in REFUSAL_WORDS.items()), re.IGNORECASE)
#: The grammar proper: a clause, read as its categories in order, declines by one of these forms.
REFUSES = re.compile(
    "|".join(
        [
            "S.*N.*[AP]", "N.*S.*A",  # somebody does not do it, or may not
            "S.*R", "R.*[AS]", "N.*P.*A",  # declines; is unable to do it; not permitted to do it
            "T.*N.*[AP]", "N.*T.*[AP]", "T.*R",  # the task is not done, or may not be
            "A.*N.*P", "B.*S", "[TES].*B.*D", "[TE].*O", "T.*A.*H", "G.*[RBO]", "G.*N.*[AP]",  # out of bounds, switched off, left to a person, regretted
        ]
    )
)
#: There was nothing to be found, which is no refusal.
FOUND_NOTHING = re.compile("N[^AP]*F")
CLAUSE = re.compile("[^.!?;\\n。！？।؟]+")
WORD = re.compile(r"[^\W_]+")
FENCE = re.compile(r"```[a-zA-Z]*")
#: Shortest tile in words, and the covered share from which an answer is a copy.
TILE, COPIED = 4, 0.5
#: Covered share from which prose that declines nothing is a copy too.
PARTLY_COPIED = 0.25
#: At most so many different labels are taken to fit the label classifier: those in most answers.
SAMPLE_LABELS = 5000


class Parsed:
    """What the pushdown parser found: ``tuples`` (lists of strings), ``open`` (brackets or a quotation are
    unclosed, or a list goes on after a comma), ``around`` (the text before and behind), ``listed`` (any list at all)."""

    __slots__ = ("around", "listed", "open", "strings", "tuples")

    def __init__(self, text: str):
        self.tuples: list[list[str]] = []
        self.strings: list[str] = []
        self.open = self.listed = False
        body = FENCE.sub(" ", text)
        start = re.search(r"""\[\s*(?:[\[(\]'"{]|$)|\(\s*['"\])]|\(\s*$""", body)
        self.around = body if start is None else body[: start.start()] + "\n" + (body[body.rfind("]") + 1 :] if "]" in body else "")
        if start is None:
            return
        self.listed = True
        stack: list[str] = []
        row: list[str] = []
        k, n, comma, before = start.start(), len(body), False, ""
        while k < n:
            ch = body[k]
            if ch in "\"'" and (stack or comma or before in "([,"):
                end = self._close(body, k, ch)
                before = ch
                if end < 0:
                    self.open = True
                    row.append(body[k + 1 :])
                    break
                word = body[k + 1 : end]
                row.append(word)
                self.strings.append(word)
                k, comma = end + 1, False
                continue
            if ch in "([{":
                stack.append(ch)
                if ch == "(":
                    row = []
                comma = False
            elif ch in ")]}":
                if stack:
                    stack.pop()
                if ch == ")":
                    self.tuples.append(row)
                    row = []
                comma = False
            elif ch == ",":
                comma = True
            elif not ch.isspace() and ch not in ".…":
                comma = False
            if not ch.isspace():
                before = ch
            k += 1
        self.open = self.open or bool(stack) or comma

    @staticmethod
    def _close(body: str, k: int, quote: str) -> int:
        """The quotation mark that ends the string begun at ``k``: one before a comma, a closing bracket or the end."""
        at = k
        while True:
            at = body.find(quote, at + 1)
            if at < 0:
                return -1
            if body[at - 1] == "\\" and at - 1 > k:
                continue
            rest = body[at + 1 : at + 12].lstrip()
            if not rest or rest[0] in ",)]}:" or at == k + 1 and rest[0] in "\"'":
                return at


def script_of(text: str) -> str | None:
    """The language of a text whose script tells it, Latin names among its words notwithstanding; else None."""
    if not ANY_SCRIPT.search(text):
        return None
    counts = {lang: len(p.findall(text)) for lang, p in SCRIPT_PATTERNS}
    if counts["ja"]:
        counts["ja"] += counts.pop("zh")
    lang = max(counts, key=counts.__getitem__)
    return lang if counts[lang] >= 2 and 8 * counts[lang] >= len(LETTERS.findall(text)) else None


def language(text: str | None) -> str | None:
    """Language of running text by script and function words; None when nothing tells."""
    if not text:
        return None
    if (lang := script_of(text)) is not None:
        return lang
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in WORD.findall(text.lower()):
        for lang in LANGUAGES_OF.get(w, ()):
            votes[lang] += 1
    first, second = sorted(votes.values(), reverse=True)[:2]
    return max(votes, key=votes.__getitem__) if first > second else None


def refuses(text: str) -> bool:
    """Whether a clause of ``text``, of whatever length, has one of the forms of ``REFUSES``."""
    for clause in CLAUSE.findall(text):
        form = "".join(m.lastgroup for m in CATEGORY.finditer(clause))
        if len(form) > 1 and REFUSES.search(form) and not FOUND_NOTHING.search(form):
            return True
    return False


def _matches(answer: list[str], source: list[str], tile: int, used_a: list[bool], used_s: list[bool]) -> list[tuple[int, int, int]]:
    """(length, place in answer, place in source) of runs of at least ``tile`` words that both sides still have free."""
    places: dict[tuple[str, ...], list[int]] = defaultdict(list)
    free = 0
    for k, taken in enumerate(used_s):
        free = 0 if taken else free + 1
        if free >= tile:
            places[tuple(source[k - tile + 1 : k + 1])].append(k - tile + 1)
    found, k, n, m = [], 0, len(answer), len(source)
    while k <= n - tile:
        longest, at = 0, 0
        if not any(used_a[k : k + tile]):
            for s in places.get(tuple(answer[k : k + tile]), ()):
                if longest and (k + longest >= n or s + longest >= m or answer[k + longest] != source[s + longest]):
                    continue  # it cannot be longer than the longest so far
                size = tile
                while k + size < n and s + size < m and answer[k + size] == source[s + size] and not used_a[k + size] and not used_s[s + size]:
                    size += 1
                if size > longest:
                    longest, at = size, s
        if longest:
            found.append((longest, k, at))
            k += max(1, longest - tile + 1)
        else:
            k += 1
    return found


def tiles(answer: list[str], source: list[str], tile: int = TILE) -> list[bool]:
    """For each word of ``answer`` whether it lies in a tile: greedy string tiling with the words of ``source``.

    In each round the longest runs that are free on both sides are taken, the longest first; those that have lost
    words to a longer one wait for the next round. It ends when no free run of ``tile`` words is left.
    """
    used_a, used_s = [False] * len(answer), [False] * len(source)
    while found := _matches(answer, source, tile, used_a, used_s):
        lost = False
        for n, a, s in sorted(found, key=lambda t: (-t[0], t[1])):
            if used_a[a] or used_a[a + n - 1] or used_s[s] or used_s[s + n - 1] or any(used_a[a : a + n]) or any(used_s[s : s + n]):
                lost = True
                continue
            used_a[a : a + n] = used_s[s : s + n] = [True] * n
        if not lost:
            break
    return used_a


def tiled(answer: list[str], source: list[str], tile: int = TILE) -> int:
    """Words of ``answer`` in tiles."""
    return sum(tiles(answer, source, tile))


class LabelLanguages:
    """Naive Bayes over whole words and letter triples of labels, fitted on (label, language, answers)."""

    def __init__(self, sample: list[tuple[str, str, int]]):
        best: dict[str, Counter] = defaultdict(Counter)
        for label, lang, n in sample:
            best[label][lang] += n
        self.own: dict[str, str] = {}
        self.known: dict[str, str | None] = {}
        self.counts: dict[str, Counter] = defaultdict(Counter)
        totals = Counter()
        for langs in best.values():
            totals.update(langs)
        for label, langs in best.items():
            share = {g: n / totals[g] for g, n in langs.items()}
            lang = max(share, key=share.__getitem__)
            if share[lang] >= 0.5 * sum(share.values()):
                if sum(langs.values()) >= 3:
                    self.own[label] = lang
                for f in self._features(label):
                    self.counts[lang][f] += 1
        self.main = max(totals, key=totals.__getitem__) if totals else None
        self.sums = {g: sum(c.values()) for g, c in self.counts.items()}
        self.size = len({f for c in self.counts.values() for f in c}) + 1

    @staticmethod
    def _features(label: str) -> list[str]:
        ws = WORD.findall(label.lower())
        return ws + [f"^{w}$"[k : k + 3] for w in ws for k in range(len(w))]

    def scores(self, label: str) -> dict[str, float]:
        return {g: sum(math.log((c[f] + 0.3) / (self.sums[g] + 0.3 * self.size)) for f in self._features(label)) for g, c in self.counts.items()}

    def of(self, label: str) -> str | None:
        if label not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[label] = self._of(label)
        return self.known[label]

    def _of(self, label: str) -> str | None:
        if (lang := script_of(label)) is not None:
            return lang
        if label in self.own:
            return self.own[label]
        scores = sorted(((s, g) for g, s in self.scores(label).items()), reverse=True)
        return scores[0][1] if len(scores) > 1 and scores[0][0] - scores[1][0] > 4 else None


def labels(parsed: Parsed) -> list[str]:
    """Relations of tuples, and objects and subjects that are no names of firms or persons."""
    out = []
    for t in parsed.tuples:
        if len(t) >= 3 and t[2].strip():
            out.append(t[2].strip())
        if len(t) >= 6 and t[5].strip().upper() not in ("COMPANY", "PERSON", "FINANCIAL_ENTITY", "STOCK_TICKER"):
            out.append(t[4].strip())
    return out


def defect(answer: str | None, source: str | None, langs: LabelLanguages | None = None) -> str | None:
    """The kind of defect of one answer, or None."""
    if answer is None or not answer.strip() or answer.strip().lower() in ("nan", "null", "none", "n/a", "na", "{}", "-"):
        return "empty"
    p = Parsed(answer)
    filled = [t for t in p.tuples if any(x.strip() for x in t)]
    loose = [s for s in p.strings if s.strip()]
    if p.listed and p.open:
        return "truncated"
    if p.listed and not filled and not loose:
        return "refusal" if refuses(p.around) else "empty"
    six = sum(len(t) >= 2 for t in filled)
    if not six:
        said = WORD.findall(answer.lower())
        have = WORD.findall((source or "").lower())
        if not said:
            return "empty"
        covered = tiled(said, have, min(TILE, max(2, len(said))))
        if covered >= COPIED * len(said):
            return "copy"
        if refuses(answer):
            return "refusal"
        if covered >= PARTLY_COPIED * len(said) and covered >= 2 * TILE:
            return "copy"
        mine, theirs = language(answer), language(source) or (langs.main if langs else None)
        if mine and theirs and mine != theirs and not answer.rstrip().endswith(":"):
            return "other_language"
        return "empty"  # a lead-in, a word that nothing was found, or other prose: nothing is extracted
    long = [x for t in filled for x in t if len(x) > 20 and len(x.split()) >= 7]
    if long and len(long) >= 0.5 * len(filled):
        said, have = WORD.findall(" ".join(long).lower()), WORD.findall((source or "").lower())
        if tiled(said, have) >= COPIED * len(said):
            return "copy"
    if langs is not None and (theirs := language(source)):
        votes = Counter(g for x in labels(p) if (g := langs.of(x)))
        if votes and votes[theirs] * 2 < sum(votes.values()) and (sum(votes.values()) > 1 or len(labels(p)) <= 2):
            return "other_language"
    return None


@F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType()))]))
def _labelled(answers: pa.Array, sources: pa.Array) -> pa.Array:
    rows = []
    for a, s in zip(answers.to_pylist(), sources.to_pylist()):
        lang = language(s)
        rows.append({"lang": lang, "labels": sorted(set(labels(Parsed(a)))) if a and lang else []})
    return pa.array(rows, pa.struct([("lang", pa.string()), ("labels", pa.list_(pa.string()))]))


def label_sample(pairs: DataFrame, answer_col: str = "output_triplets", source_col: str = "text", most: int = SAMPLE_LABELS) -> list[tuple[str, str, int]]:
    """(label, language of the input, answers) of the ``most`` labels used in most answers."""
    rows = pairs.select(_labelled(answer_col, source_col).alias("x")).select("x.lang", F.explode("x.labels").alias("label"))
    counted = rows.groupBy("label", "lang").agg(F.count("*").alias("n"))
    return [tuple(r) for r in counted.orderBy(F.desc("n"), "label", "lang").limit(most).collect()]


def answer_defects(pairs: DataFrame, id_col: str = "triplet_id", answer_col: str = "output_triplets", source_col: str = "text", most: int = SAMPLE_LABELS) -> DataFrame:
    """``id_col`` and ``defect`` of every row with a defective answer.

    Null and blank answers are 'empty'. Where the input is null, blank or of no known language, tuples can
    not be in another one, and prose is held against the commonest language. A refusal needs a clause that the
    grammar accepts; prose without a tuple that is no refusal, no copy and in the input's language has extracted
    nothing and is 'empty'. Repeated rows come out each. No shuffle beside the counts of labels, of which at most
    ``most`` go to the driver.
    """
    langs = LabelLanguages(label_sample(pairs, answer_col, source_col, most))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [defect(a, s, langs) for a, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = [k for k, d in enumerate(kinds) if d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([kinds[k] for k in keep], pa.string())], [id_col, "defect"])

    return pairs.select(F.col(id_col).cast("long").alias(id_col), answer_col, source_col).mapInArrow(find, f"{id_col} long, defect string")
