"""Values cut off in storage or transfer (problem 3), in pure SQL.

Lists are cut when a bracket or quotation is open at their end. For prose, word trigrams are counted
inside sentences and at ends over all values; the last trigram of a value is joined to these counts, and
a value is cut when that trigram is frequent inside but almost never ends anything. Words are taken by
class (capitalised words and numbers stand for all of their kind). Where the same five words have been
seen they decide before the trigram; where a trigram is too rare its last two words, then its last word
decide. A last word that hardly ever occurs is a fragment when longer words begin with it. Copies of a
value count once, so that they cannot vouch for each other, and share its verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsloom.runtime import checkpointed

# Invitations to read on, which are no part of the value, and marks put after a cut.
INVITATION = r"(?i)[\s(\[]*\b(?:read (?:on|more)|read the (?:full|whole) \w+|continue reading|more (?:at|on) (?:the|our) (?:site|website|page)|full (?:story|text|article)(?: here)?|click here(?: for more)?|see more|learn more|weiterlesen|weiter lesen|mehr (?:dazu|lesen|auf der (?:seite|website))|lesen sie (?:mehr|weiter)|zum artikel|lire (?:la suite|plus)|en savoir plus|la suite(?: sur le site)?|voir plus|leer más|seguir leyendo|sigue leyendo|más (?:información|en (?:la|el) (?:web|sitio|página))|ver más)[\s.…>»→)\]]*$"
CUT_MARK = r"[\s]*(?:[\[(]?(?:…|\.{3,})[\])]?)$"

#: Characters at the end of a value in which an invitation or a mark is looked for.
TAIL = 48

#: Patterns, handed to the SQL as parameters.
PATTERNS = {
    "invitation": INVITATION,
    "cut_mark": CUT_MARK,
    "outer_blanks": r"(?U)^\s+|\s+$",
    "blanks": r"(?U)\s+",
    "some": r"\S",
    "list_start": r"""[\[(]\s*["'\[(]|[\[(]\s*$""",
    "from_list": r"""(?s)([\[(]\s*(?:["'\[(]|$).*)""",
    "fence": "```[a-z]*",
    "string": r"""(?s)'(?:[^'\\]++|\\.|'(?!\s*(?:[,)\]}]|$)))*+'(?=\s*[,)\]}])|"(?:[^"\\]++|\\.|"(?!\s*(?:[,)\]}]|$)))*+"(?=\s*[,)\]}])""",
    "quote": r"""["']""",
    "comma_end": r",\s*$",
    "not_word": r"(?U)^[^\w$€£]+|[^\w%]+$",
    "number": r"^[$€£]?[0-9]",
    "digits": r"[0-9][0-9.,:]*",
    "capital": r"(?U)^\p{Lu}",
    "plain": "^[a-z]+$",
    "end_mark": r"""[.!?…。！？][”“»’")\]]*$""",
    "opening": r"""(?U)^[\p{Lu}“„«"(¿¡]|^\p{Ll}+\p{Lu}""",
    "short_dotted": r"(?U)^\W*\p{Lu}\p{L}{0,4}[.]$",
    "small": r"(?U)^\p{Ll}",
    "digit_end": r"[0-9]$",
    "letter_first": r"(?U)^\p{L}",
    "open_end": r"[,;:\-–(\[“„«$€£¿¡&/]$",
}

#: One row per value: table_name, record_id, source (feed or model), body without invitation and cut mark, listed.
VALUES = f"""
WITH raw AS (
  SELECT 'nasdaq_semi_data_cleaned' AS table_name, article_id AS record_id, summary AS value FROM {{articles}}
  UNION ALL
  SELECT 'judged_triplets', triplet_id, output_triplets FROM {{triplets}}
), bare AS (
  SELECT table_name, record_id, coalesce(value RLIKE :list_start, false) AS listed, rtrim(concat(left(value, length(value) - {TAIL}), regexp_replace(regexp_replace(right(value, {TAIL}), :invitation, ''), :cut_mark, ''))) AS body
  FROM (SELECT table_name, record_id, trim(TRAILING ' \\n\\r\\t' FROM value) AS value FROM raw)
)
SELECT table_name, record_id, body, listed FROM bare
"""

#: Lists: what is left open once fences and complete strings are taken out.
LISTS = """
WITH stripped AS (
  SELECT table_name, record_id, regexp_replace(regexp_replace(regexp_extract(body, :from_list, 1), :fence, ''), :string, 's') AS rest
  FROM {values} WHERE listed
)
SELECT table_name, record_id,
  rest RLIKE :quote OR rest RLIKE :comma_end
  OR length(translate(rest, '(', '')) < length(translate(rest, ')', ''))
  OR length(translate(rest, '[', '')) < length(translate(rest, ']', '')) AS cut
FROM stripped
"""

#: Prose that ends in an open bracket or quotation, or in a mark that nothing ends with.
OPEN_END = """(
  body RLIKE :open_end
  OR CASE WHEN body LIKE '%„%' THEN length(body) - length(translate(body, '„', '')) > length(body) - length(translate(body, '“”', ''))
     ELSE length(body) - length(translate(body, '“', '')) > length(body) - length(translate(body, '”', '')) END
  OR length(body) - length(translate(body, '«', '')) > length(body) - length(translate(body, '»', ''))
  OR length(body) - length(translate(body, '「', '')) > length(body) - length(translate(body, '」', ''))
  OR length(body) - length(translate(body, '(', '')) > length(body) - length(translate(body, ')', ''))
)"""

#: Prose, one row per distinct body; ``key`` stands for the body from here on.
BODIES = "SELECT md5(body) AS key, first(body) AS body FROM {values} WHERE NOT listed AND body RLIKE :some GROUP BY md5(body)"

#: Prose: the class of each word, whether it bears an end mark, and whether it could begin a sentence.
WORDS = f"""
WITH split AS (
  SELECT key, body, split(regexp_replace(body, :outer_blanks, ''), :blanks) AS w
  FROM {{bodies}}
), marked AS (
  SELECT key, {OPEN_END} AS open_end, body = upper(body) AS shouted,
    transform(w, x -> CASE WHEN x RLIKE :plain THEN named_struct('core', x, 'plain', true, 'stop', false, 'opens', false)
      ELSE named_struct('core', if(x LIKE '%.' AND x RLIKE :short_dotted, x, regexp_replace(x, :not_word, '')), 'plain', false, 'stop', x RLIKE :end_mark, 'opens', x RLIKE :opening) END) AS t
  FROM split
)
SELECT key, open_end, size(t) AS n, transform(t.core, x -> lower(trim(TRAILING '.' FROM x))) AS e, t.stop AS stop, t.opens AS opens,
  transform(t, y -> CASE WHEN y.plain THEN y.core WHEN shouted THEN regexp_replace(lower(y.core), :digits, '0') WHEN y.core RLIKE :number THEN regexp_replace(y.core, :digits, '0')
    WHEN y.core RLIKE :capital THEN if(y.core LIKE '%.%', y.core, 'Aa') ELSE lower(y.core) END) AS c
FROM marked
"""

#: Runs of five words; runs of three, two and one are their sums.
RUNS = """
WITH at AS (
  SELECT explode(transform(sequence(0, n - 1), k -> struct(
    if(k > 3, c[k - 4], '^') AS x, if(k > 2, c[k - 3], '^') AS y, if(k > 1, c[k - 2], '^') AS a, if(k > 0, c[k - 1], '^') AS b, c[k] AS z,
    CASE WHEN stop[k] AND coalesce(get(opens, k + 1), true) THEN 1 WHEN k = n - 1 AND NOT exists(stop, t -> t) THEN 1 ELSE 0 END AS ended))) AS g
  FROM {words}
)
SELECT g.x, g.y, g.a, g.b, g.z, count(*) AS seen, sum(g.ended) AS ended FROM at GROUP BY g.x, g.y, g.a, g.b, g.z
"""
GRAMS = "SELECT a, b, z, sum(seen) AS seen, sum(ended) AS ended FROM {runs} GROUP BY a, b, z"
PAIRS = "SELECT b, z, sum(seen) AS seen, sum(ended) AS ended FROM {grams} GROUP BY b, z"
SINGLES = "SELECT z, sum(seen) AS seen, sum(ended) AS ended FROM {pairs} GROUP BY z"

#: Beginnings of words in use, with how often those words occur.
BEGINNINGS = """
WITH lexicon AS (SELECT word, count(*) AS seen FROM (SELECT explode(e) AS word FROM {words}) GROUP BY word)
SELECT word, max(own) AS own, sum(longer) AS longer FROM (
  SELECT word, seen AS own, 0 AS longer FROM lexicon
  UNION ALL
  SELECT left(word, k), 0, seen FROM lexicon LATERAL VIEW explode(sequence(2, length(word) - 1)) AS k WHERE length(word) > 2 AND seen >= {least_seen}
) GROUP BY word
"""

LAST = """
SELECT key, open_end, n, if(n > 4, c[n - 5], '^') AS x, if(n > 3, c[n - 4], '^') AS y, if(n > 2, c[n - 3], '^') AS a, if(n > 1, c[n - 2], '^') AS b,
  c[n - 1] AS z, e[n - 1] AS e, stop[n - 1] AS stop, if(stop[n - 1] OR NOT exists(stop, t -> t), 1, 0) AS own_end FROM {words}
"""

#: Longer words known behind the same word. Only last pairs that are rare take part.
FRAGMENTS = """
SELECT l.b, l.z, sum(p.seen) AS longer FROM (SELECT DISTINCT b, z FROM {rare}) l JOIN {pairs} p ON l.b = p.b AND startswith(p.z, l.z) AND p.z <> l.z GROUP BY l.b, l.z
"""

#: A value's own end is taken off each count.
JUDGED = """
SELECT l.*, coalesce(r.seen, 1) - 1 AS r_seen, greatest(coalesce(r.ended, 0) - own_end, 0) AS r_ended, coalesce(t.seen, 1) - 1 AS t_seen, greatest(coalesce(t.ended, 0) - own_end, 0) AS t_ended,
  coalesce(p.seen, 1) - 1 AS p_seen, greatest(coalesce(p.ended, 0) - own_end, 0) AS p_ended, coalesce(s.seen, 1) - 1 AS s_seen, greatest(coalesce(s.ended, 0) - own_end, 0) AS s_ended
FROM {last} l
LEFT JOIN {runs} r ON l.x = r.x AND l.y = r.y AND l.a = r.a AND l.b = r.b AND l.z = r.z
LEFT JOIN {grams} t ON l.a = t.a AND l.b = t.b AND l.z = t.z
LEFT JOIN {pairs} p ON l.b = p.b AND l.z = p.z
LEFT JOIN {singles} s ON l.z = s.z
"""

VERDICT = """
SELECT j.key,
  open_end OR n > 1 AND coalesce(CASE
    WHEN g.longer >= {least_seen} AND j.e RLIKE :letter_first AND g.own <= greatest(1, {share_fragment} * g.longer) AND (g.own <= 1 OR j.z = 'Aa' OR s_ended <= {share} * s_seen) THEN true
    WHEN f.longer >= 2 AND f.longer > 3 * p_seen THEN true
    WHEN r_seen >= if(stop, {stopped_times}, 1) * {least_trigram} AND size(filter(array(j.x, j.y, j.a, j.b, j.z), w -> w RLIKE :small)) >= 2 THEN r_ended <= if(stop, {share_stopped}, {share}) * r_seen
    WHEN t_seen >= if(stop, {stopped_times}, 1) * {least_trigram} AND exists(array(j.a, j.b, j.z), w -> w RLIKE :small) THEN t_ended <= if(stop, {share_stopped}, {share}) * t_seen
    WHEN p_seen >= if(stop, {stopped_times}, 1) * {least_pair} AND exists(array(j.b, j.z), w -> w RLIKE :small) THEN p_ended <= if(stop, {share_stopped}, {share}) * p_seen
    WHEN NOT stop AND s_seen >= {least_single} THEN s_ended <= {share_stopped} * s_seen
    ELSE false END, false) AS cut
FROM {judged} j
LEFT JOIN {fragments} f ON j.b = f.b AND j.z = f.z
LEFT JOIN {beginnings} g ON j.e = g.word
"""

#: The verdict on a body, for each of its values.
SPREAD = "SELECT v.table_name, v.record_id, p.cut FROM (SELECT table_name, record_id, md5(body) AS key FROM {values} WHERE NOT listed AND body RLIKE :some) v JOIN {prose} p ON v.key = p.key"

SHARES = """
WITH named AS (
  SELECT 'nasdaq_semi_data_cleaned' AS table_name, article_id AS record_id, feed AS source FROM {articles} WHERE summary RLIKE :some
  UNION ALL SELECT 'judged_triplets', triplet_id, model_name FROM {triplets} WHERE output_triplets RLIKE :some
)
SELECT n.table_name, n.source, count(*) AS n_values, count(c.record_id) AS n_cut, count(c.record_id) / count(*) AS cut_share
FROM named n LEFT JOIN (SELECT DISTINCT table_name, record_id FROM {cut}) c ON n.table_name = c.table_name AND n.record_id = c.record_id
GROUP BY n.table_name, n.source
"""


def _sql(query: str, **frames) -> DataFrame:
    """``query`` over data frames and numbers, with the patterns that it names."""
    spark = next(f for f in frames.values() if isinstance(f, DataFrame)).sparkSession
    return spark.sql(query, args={k: v for k, v in PATTERNS.items() if f":{k}" in query}, **frames)


def judged_values(
    articles: DataFrame, triplets: DataFrame, least_trigram: int = 4, least_pair: int = 6, least_single: int = 20, least_seen: int = 5, share_fragment: float = 0.02, share: float = 0.08, share_stopped: float = 0.04, stopped_times: int = 3
) -> DataFrame:
    """table_name, record_id, cut for every value.

    A last word is a fragment when longer words with that beginning occur ``least_seen`` times, and it itself
    nowhere else or at most ``share_fragment`` as often. Else the last five words, or else the last three, decide
    when they occur ``least_trigram`` times elsewhere, the last two when they occur ``least_pair`` times, the last
    one from ``least_single`` on; a value is cut when at most ``share`` of those occurrences end a sentence or value. A value that ends with a full stop takes ``stopped_times`` as many
    occurrences and at most ``share_stopped`` of ends, and is not cut by its last word alone.
    Null, empty and blank values are not cut. Repeated rows come out each; values of the same
    body count once and have one verdict.
    """
    values = _sql(VALUES, articles=articles, triplets=triplets)
    words = checkpointed(_sql(WORDS, bodies=_sql(BODIES, values=values)))  # read twice; also keeps the union out of the joins' plan
    runs = checkpointed(_sql(RUNS, words=words))  # read four times
    grams = _sql(GRAMS, runs=runs)
    pairs = _sql(PAIRS, grams=grams)
    judged = _sql(JUDGED, last=_sql(LAST, words=words), runs=runs, grams=grams, pairs=pairs, singles=_sql(SINGLES, pairs=pairs))
    rare = _sql("SELECT b, z FROM {judged} WHERE p_seen < {least_single} AND (z RLIKE :small OR z RLIKE :digit_end)", judged=judged, least_single=least_single)
    beginnings = _sql(BEGINNINGS, words=words, least_seen=least_seen)
    bounds = dict(least_trigram=least_trigram, least_pair=least_pair, least_single=least_single, least_seen=least_seen, share_fragment=share_fragment, share=share, share_stopped=share_stopped, stopped_times=stopped_times)
    prose = _sql(VERDICT, judged=judged, fragments=_sql(FRAGMENTS, rare=rare, pairs=pairs), beginnings=beginnings, **bounds)
    return _sql(SPREAD, values=values, prose=prose).unionByName(_sql(LISTS, values=values))


def cut_values(articles: DataFrame, triplets: DataFrame, **parameters) -> DataFrame:
    """table_name, record_id of every cut value."""
    return judged_values(articles, triplets, **parameters).filter("cut").select("table_name", "record_id")


def cut_shares(articles: DataFrame, triplets: DataFrame, **parameters) -> DataFrame:
    """Per table and source (feed or model; null is a source of its own) its values, cut values and their share."""
    return _sql(SHARES, articles=articles, triplets=triplets, cut=cut_values(articles, triplets, **parameters))
