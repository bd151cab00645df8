"""The registered queries of the core, each with the SQL that must give the same rows where SQL can give them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import instants, ontology, prompts, scores, triplets
from newsloom.operators import articles, drawn, gat, graph, linkpred, similarity
from newsloom.plans import pipelines
from newsloom.runtime import table
from newsloom.sources import csv_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, so that the order of summation does not show."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


# ---------------------------------------------------------------- damaged records and mixed dates


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return csv_records.rejected(table(spark, d, "judged_lines"))


@query()
def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return csv_records.loaded(table(spark, d, "judged_lines"))


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = instants.normalised_dates(table(spark, d, "nasdaq_semi_data_cleaned"), table(spark, d, "feeds"))
    return rows.filter("utc_micros IS NOT NULL")


# ---------------------------------------------------------------- articles

TICKERS = ["BYYYZ", "QUINZ", "PLRLZ", "SRARZ", "GLLUZ", "DYRNZ", "VEEIZ", "SOOOZ", "LEEOZ", "OVRAZ", "ITTEZ"]
_A = "WITH a AS (SELECT article_id, ticker, title, text, summary, make_timestamp(epoch_us(loaded_at)) AS date FROM nasdaq_semi_data_cleaned) "


def _articles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nasdaq_semi_data_cleaned")
    return a.select("article_id", "ticker", "title", "text", "summary", F.col("loaded_at").alias("date"))


@query("SELECT article_id, epoch_us(strptime(date, '%Y-%m-%d %H:%M:%S')) AS micros FROM nasdaq_semi_data_cleaned WHERE regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AND try_strptime(date, '%Y-%m-%d %H:%M:%S') IS NOT NULL".replace("strptime(date", "try_strptime(date", 1))
def article_typed_date(spark, d):
    a = table(spark, d, "nasdaq_semi_data_cleaned").filter(F.col("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"))
    return articles.typed_date(a).filter("date IS NOT NULL").select("article_id", F.unix_micros("date").alias("micros"))


@query()
def article_typed_date_whole(spark, d):
    """Every article with its date as read, or null; the SQL of ``article_typed_date`` knows one notation."""
    return articles.typed_date(table(spark, d, "nasdaq_semi_data_cleaned")).select("article_id", F.unix_micros("date").alias("micros"))


@query(_A + "SELECT article_id, epoch_us(date) AS micros FROM a WHERE date >= TIMESTAMP '2021-01-03' AND date <= TIMESTAMP '2023-01-18'")
def article_date_range(spark, d):
    return articles.date_range(_articles(spark, d), "2021-01-03", "2023-01-18").select("article_id", F.unix_micros("date").alias("micros"))


@query(_A + f"SELECT article_id, ticker FROM a WHERE ticker IN ({', '.join(map(repr, TICKERS))})")
def article_ticker_whitelist(spark, d):
    return articles.ticker_whitelist(_articles(spark, d), TICKERS).select("article_id", "ticker")


@query(_A + "SELECT article_id, coalesce(title, '') AS title FROM a WHERE coalesce(length(summary), 0) > 50 OR coalesce(length(title), 0) > 10")
def article_length_filter(spark, d):
    return articles.long_enough(articles.filled(_articles(spark, d))).select("article_id", "title")


@query(_A + "SELECT ticker, count(DISTINCT strftime(date, '%Y-%m')) AS n_months, count(title) AS n_articles FROM a WHERE ticker IS NOT NULL GROUP BY ticker")
def article_ticker_stats(spark, d):
    return articles.ticker_stats(_articles(spark, d))


@query(_A + "SELECT article_id, title FROM (SELECT article_id, coalesce(title, '') AS title, row_number() OVER (PARTITION BY coalesce(title, '') ORDER BY date, article_id) AS n FROM a) WHERE n = 1")
def article_dedupe_keep_first(spark, d):
    return articles.keep_first(articles.filled(_articles(spark, d))).select("article_id", "title")


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(_A + f"SELECT article_id FROM a WHERE {_TRIM.format('title')} NOT IN (SELECT {_TRIM.format('title')} FROM judged_triplets WHERE title IS NOT NULL) OR title IS NULL")
def article_resume_anti_join(spark, d):
    return articles.not_done(_articles(spark, d), table(spark, d, "judged_triplets")).select("article_id")


_PROMPT = f"CASE WHEN {_TRIM.format("coalesce(summary, '')")} <> '' THEN {_TRIM.format('summary')} ELSE {_TRIM.format("coalesce(title, '') || ' ' || coalesce(summary, '')")} END"


@query(_A + f"SELECT article_id, md5({_PROMPT}) AS prompt FROM a")
def prompt_text_fallback(spark, d):
    a = _articles(spark, d)
    return a.select("article_id", F.md5(articles.prompt_text(a)).alias("prompt"))


TEMPLATE = 'List the relations as 6-tuples. Answer like {{"list": []}}.\nText: {input_text_}\nTitle: {title_}'


@query(_A + f"""SELECT article_id, md5('List the relations as 6-tuples. Answer like {{"list": []}}.' || chr(10) || 'Text: ' || {_PROMPT} || chr(10) || 'Title: ' || coalesce(title, '')) AS prompt FROM a""")
def prompt_render(spark, d):
    a = _articles(spark, d)
    return a.select("article_id", F.md5(articles.rendered(TEMPLATE, input_text_=articles.prompt_text(a), title_=F.col("title"))).alias("prompt"))


# ---------------------------------------------------------------- triplets in text

_SAN = r"""
WITH g AS (SELECT triplet_id, list_filter(list_transform(regexp_extract_all(output_triplets, '(?s)\((.*?)\)', 1),
  lambda m: list_transform(list_filter(regexp_extract_all(m, '"[^"]*"|''[^'']*''|[^,\s]+', 0), lambda x: x <> '""' AND x <> ''''''),
    lambda x: regexp_replace(regexp_replace(x, '[^a-zA-Z0-9\s]', '', 'g'), '^\s+|\s+$', '', 'g'))), lambda a: len(a) = 6) AS t FROM judged_triplets)
"""


def _answers(spark, d):
    return table(spark, d, "judged_triplets").withColumn("t", triplets.sanitized("output_triplets"))


@query(_SAN + "SELECT triplet_id, len(t) AS n, '[' || coalesce(array_to_string(list_transform(t, lambda a: '(''' || array_to_string(a, ''', ''') || ''')'), ', '), '') || ']' AS literal FROM g WHERE t IS NOT NULL")
def triplet_sanitize(spark, d):
    return _answers(spark, d).filter("t IS NOT NULL").select("triplet_id", F.size("t").cast("long").alias("n"), triplets.literal_text(F.col("t")).alias("literal"))


@query(_SAN + "SELECT triplet_id, pos - 1 AS pos, t[pos][1] AS sub, t[pos][2] AS sub_type, t[pos][3] AS rel, t[pos][4] AS rel_category, t[pos][5] AS obj, t[pos][6] AS obj_type FROM (SELECT triplet_id, t, unnest(range(1, len(t) + 1)) AS pos FROM g)")
def triplet_explode(spark, d):
    rows = triplets.exploded(_answers(spark, d), F.col("t"), "triplet_id")
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(_SAN + "SELECT triplet_id, array_to_string(list_transform(t, lambda a: a[1] || ' ' || replace(a[3], '_', ' ') || ' ' || a[5] || '.'), ' ') AS sentences FROM g WHERE len(t) > 0")
def triplet_sentences(spark, d):
    return _answers(spark, d).filter(F.size("t") > 0).select("triplet_id", F.array_join(triplets.sentences(F.col("t")), " ").alias("sentences"))


@query(_SAN + "SELECT count(*) AS n_rows, count_if(len(t) > 0)::BIGINT AS n_valid, count_if(t IS NULL OR len(t) = 0)::BIGINT AS n_dropped FROM g")
def triplet_drop_counts(spark, d):
    kept = F.coalesce(F.size("t"), F.lit(0)) > 0
    return _answers(spark, d).agg(F.count("*").alias("n_rows"), F.count_if(kept).alias("n_valid"), F.count_if(~kept).alias("n_dropped"))


_REV = f"coalesce({_TRIM.format('revised_triplets')}, 'nan')"
_IS = f"starts_with({_REV}, '[') AND ends_with({_REV}, ']')"


def _strategy(name: str, case: str):
    @query(f"SELECT triplet_id, md5({case}) AS selected FROM judged_triplets")
    def run(spark, d):
        j = table(spark, d, "judged_triplets")
        return j.select("triplet_id", F.md5(triplets.selected(j, name)).alias("selected"))

    QUERIES[f"strategy_{name}"] = QUERIES.pop("run")
    ORACLE[f"strategy_{name}"] = ORACLE.pop("run")


_ORIG = "coalesce(output_triplets, 'nan')"
_strategy("original", _ORIG)
_strategy("fallback", f"CASE WHEN {_IS} THEN {_REV} ELSE {_ORIG} END")
_strategy("strict", f"CASE WHEN {_IS} THEN {_REV} WHEN contains(lower({_REV}), 'evaluation meets expectation') THEN {_ORIG} ELSE '[]' END")


@query()
def triplet_normalize(spark, d):
    """Any list literal to normalised triplets; a Python literal is no matter for SQL."""
    j = table(spark, d, "judged_triplets")
    return j.select("triplet_id", F.explode(triplets.parsed(triplets.selected(j, "fallback"))).alias("t")).select("triplet_id", "t.*")


@query(r"SELECT triplet_id, CASE WHEN regexp_extract(output_triplets, '(?s)\{.*\}', 0) <> '' THEN regexp_extract(output_triplets, '(?s)\{.*\}', 0) ELSE regexp_replace(regexp_replace(output_triplets, '```json|```', '', 'g'), '^\s+|\s+$', '', 'g') END AS block FROM judged_triplets WHERE output_triplets IS NOT NULL AND (contains(output_triplets, '{') OR contains(output_triplets, '```'))")
def judge_json_extract(spark, d):
    j = table(spark, d, "judged_triplets").filter(F.col("output_triplets").contains("{") | F.col("output_triplets").contains("```"))
    return j.select("triplet_id", triplets.json_object("output_triplets").alias("block"))


# ---------------------------------------------------------------- judge scores

_X = "SELECT triplet_id, " + ", ".join(rf"TRY_CAST(nullif(regexp_extract(llm_judgments_evaluation, '(?i){n}\s+score\s*:?\s*([-+]?\d*\.?\d+)', 1), '') AS DOUBLE) AS {c}" for c, n in (("coverage", "coverage"), ("uniqueness", "uniqueness"), ("semantic_validity", r"semantic\s+validity"), ("consistency", "consistency"))) + " FROM judged_triplets"


@query(_X)
def score_extract(spark, d):
    j = table(spark, d, "judged_triplets")
    return j.select("triplet_id", *[c.alias(n) for n, c in scores.extracted("llm_judgments_evaluation").items()])


@query("SELECT triplet_id, 'Judge LLM Coverage Score: ' || round(coverage * 100)::BIGINT || chr(10) || 'Judge LLM Uniqueness Score: ' || round(uniqueness * 100)::BIGINT || chr(10) || 'Judge LLM Semantic Validity Score: ' || round(semantic_validity * 100)::BIGINT || chr(10) || 'Judge LLM Consistency Score: ' || round(consistency * 100)::BIGINT AS blob FROM extracted_scores WHERE coverage IS NOT NULL AND uniqueness IS NOT NULL AND semantic_validity IS NOT NULL AND consistency IS NOT NULL")
def judge_blob_format(spark, d):
    s = table(spark, d, "extracted_scores").dropna()
    return s.select("triplet_id", scores.blob({c: F.round(F.col(c) * 100).cast("long") for c in scores.CATEGORIES}).alias("blob"))


_U = "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, {c} AS value FROM extracted_scores" for c in scores.CATEGORIES) + ")"


@query(_U + " SELECT category, count(value) AS count, count_if(value IS NULL)::BIGINT AS missing, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END, 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(max(value) - min(value), 6) AS range, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis FROM v GROUP BY category")
def score_stats(spark, d):
    s = scores.stats(table(spark, d, "extracted_scores"))
    return s.select("category", "count", "missing", *[c if c in ("min", "max") else r6(c).alias(c) for c in scores.STATS[2:]])


@query(_U + ", e AS (SELECT category, min(value) AS lo, max(value) AS hi FROM v GROUP BY category), b AS (SELECT category, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 10)), 9)::INT END AS bin, lo, hi FROM v JOIN e USING (category) WHERE value IS NOT NULL) SELECT category, bin, round(min(lo) + (min(hi) - min(lo)) / 10 * bin, 6) AS bin_from, count(*) AS n FROM b GROUP BY category, bin")
def score_histogram(spark, d):
    return scores.histogram(table(spark, d, "extracted_scores"))


@query(_U + ", s AS (SELECT category, avg(value) AS mean, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY category) SELECT category, round(any_value(mean), 6) AS mean, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(value) AS whisker_low, max(value) AS whisker_high FROM v JOIN s USING (category) WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) GROUP BY category")
def score_boxplot(spark, d):
    b = scores.box(table(spark, d, "extracted_scores"))
    return b.select("category", *[r6(c).alias(c) for c in ("mean", "q1", "median", "q3")], "whisker_low", "whisker_high")


@query("SELECT triplet_id, (semantic_validity + consistency) / 2 AS llm_semantic FROM extracted_scores WHERE semantic_validity IS NOT NULL AND consistency IS NOT NULL")
def llm_semantic_score(spark, d):
    s = table(spark, d, "extracted_scores").filter("semantic_validity IS NOT NULL AND consistency IS NOT NULL")
    return s.select("triplet_id", ((F.col("semantic_validity") + F.col("consistency")) / 2).alias("llm_semantic"))


# ---------------------------------------------------------------- words and vectors

_TOK = "WITH t AS (SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents WHERE regexp_matches(text, '\\S')) GROUP BY doc_id, token)"


@query(_TOK + " SELECT token, sum(c)::BIGINT AS n, count(*) AS n_docs FROM t GROUP BY token")
def token_frequency(spark, d):
    t = similarity.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return t.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


_ENT = ", e AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM (SELECT doc_id, c::DOUBLE AS c, sum(c) OVER (PARTITION BY doc_id) AS n FROM t) GROUP BY doc_id)"


@query(_TOK + _ENT + " SELECT doc_id, abs(round(coalesce(h, 0), 6)) AS entropy FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN e USING (doc_id)")
def doc_entropy(spark, d):
    return similarity.entropy(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.abs(r6("entropy")).alias("entropy"))


def _entropy_sql(name: str, col: str) -> str:
    return f"{name} AS (SELECT article_id, -sum(c / n * log2(c / n)) AS h FROM (SELECT article_id, c::DOUBLE AS c, sum(c) OVER (PARTITION BY article_id) AS n FROM (SELECT article_id, token, count(*) AS c FROM (SELECT article_id, unnest(string_split({col}, ' ')) AS token FROM nasdaq_semi_data_cleaned WHERE regexp_matches({col}, '\\S')) GROUP BY article_id, token)) GROUP BY article_id)"


@query(f"WITH {_entropy_sql('a', 'summary')}, {_entropy_sql('b', 'text')} SELECT article_id, round(CASE WHEN round(coalesce(b.h, 0), 9) = 0 THEN 0.0 ELSE coalesce(a.h, 0) / b.h END, 5) + 0.0 AS entropy_ratio FROM (SELECT DISTINCT article_id FROM nasdaq_semi_data_cleaned) LEFT JOIN a USING (article_id) LEFT JOIN b USING (article_id)")
def entropy_ratio(spark, d):
    e = similarity.entropy_ratio(table(spark, d, "nasdaq_semi_data_cleaned"), "article_id", "summary", "text")
    return e.select("article_id", (F.round("entropy_ratio", 5) + 0.0).alias("entropy_ratio"))


_V = "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_PAIRS = _V + ", p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)"
AT_LEAST = 0.3


@query(_PAIRS + f" SELECT label, i, j, round(s, 6) AS similarity FROM p WHERE s >= {AT_LEAST}")
def cosine_pairs(spark, d):
    return similarity.similar_pairs(table(spark, d, "embeddings"), "label", "vec_id", AT_LEAST).select("label", "i", "j", r6("similarity").alias("similarity"))


@query(_PAIRS + f", n AS (SELECT label, count(*) AS n FROM u GROUP BY label), c AS (SELECT label, count(*) AS c FROM p WHERE s >= {AT_LEAST} GROUP BY label) SELECT label, n, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - coalesce(c, 0) / (n * (n - 1) / 2) END, 6) AS uniqueness FROM n LEFT JOIN c USING (label)")
def uniqueness_pairs(spark, d):
    return similarity.uniqueness(table(spark, d, "embeddings"), "label", "vec_id", AT_LEAST).select("label", "n", r6("uniqueness").alias("uniqueness"))


_CLOSURE = _PAIRS.replace("WITH u", "WITH RECURSIVE u") + ", l AS (SELECT i AS a, j AS b FROM p WHERE s >= 0.36 UNION SELECT j, i FROM p WHERE s >= 0.36), r AS (SELECT vec_id AS v, vec_id AS c FROM u UNION SELECT r.v, l.b FROM r JOIN l ON r.c = l.a), k AS (SELECT v, min(c) AS c FROM r GROUP BY v)"


@query(_CLOSURE + " SELECT label, count(*) AS n, count(DISTINCT c) AS clusters, round(count(DISTINCT c) / count(*), 6) AS uniqueness FROM u JOIN k ON u.vec_id = k.v GROUP BY label")
def uniqueness_clusters(spark, d):
    return similarity.cluster_uniqueness(table(spark, d, "embeddings"), "label", "vec_id", 0.36).select("label", "n", "clusters", r6("uniqueness").alias("uniqueness"))


@query(_V + ", b AS (SELECT s.label, s.vec_id, max(list_dot_product(s.v, t.v)) AS m FROM u s JOIN u t ON s.label = t.label WHERE s.vec_id % 2 = 0 AND t.vec_id % 2 = 1 GROUP BY s.label, s.vec_id) SELECT label, round(sum((m + 1) / 2) / count(*), 6) AS coverage FROM b GROUP BY label")
def coverage_score(spark, d):
    e = table(spark, d, "embeddings")
    return similarity.coverage(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "label", "vec_id").select("label", r6("coverage").alias("coverage"))


_PROPS = "p AS (SELECT vec_id AS k, v FROM u WHERE vec_id < 56), n AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{p[0]}')" for k, p in enumerate(ontology.PROPERTIES)) + ") AS x(k, name))"


@query(_V + f", {_PROPS}, s AS (SELECT q.vec_id, p.k, list_dot_product(q.v, p.v) AS s FROM u q, p WHERE q.vec_id >= 56), m AS (SELECT vec_id, arg_max(k, s) AS k, max(s) AS s FROM s GROUP BY vec_id) SELECT vec_id, CASE WHEN s >= {AT_LEAST} THEN name ELSE 'relation_' || vec_id END AS property, s >= {AT_LEAST} AS matched, round(s, 6) AS similarity FROM m JOIN n USING (k)")
def nearest_property(spark, d):
    e = table(spark, d, "embeddings")
    base = e.filter("vec_id < 56").orderBy("vec_id").select("embedding").collect()  # as many as the ontology has properties
    return similarity.nearest(e.filter("vec_id >= 56"), [p[0] for p in ontology.PROPERTIES], np.array([r[0] for r in base], float), AT_LEAST, "vec_id", F.concat(F.lit("relation_"), F.col("vec_id")))


_E = "e AS (SELECT DISTINCT edge_id, article_id, sub, coalesce(sub_type, 'UNK') AS sub_type, rel, coalesce(rel_category, 'UNK') AS rel_category, obj, coalesce(obj_type, 'UNK') AS obj_type, CASE WHEN w IS NULL OR w = 0 THEN 1.0 ELSE w END AS w, epoch_us(date) AS date, strftime(make_timestamp(epoch_us(date)), '%Y-%m') AS period FROM edges WHERE sub IS NOT NULL AND rel IS NOT NULL AND obj IS NOT NULL AND date IS NOT NULL)"


def _edges(spark, d):
    return triplets.fact_edges(table(spark, d, "edges"))


def _ontology_sql() -> str:
    sides = ", ".join(f"('{n}', [{', '.join(map(repr, dom))}]::VARCHAR[], [{', '.join(map(repr, ran))}]::VARCHAR[])" for n, dom, ran in ontology.PROPERTIES)
    cats = ", ".join(f"('{a}', '{b}')" for a, b in ontology.SPELLINGS.items())
    return rf"""WITH {_E}, o AS (SELECT * FROM (VALUES {sides}) AS x(name, dom, ran)), c AS (SELECT * FROM (VALUES {cats}) AS x(spelling, class)),
    v AS (SELECT e.edge_id, e.article_id, CASE WHEN s.class IS NULL OR t.class IS NULL THEN 'unknown_class' WHEN o.name IS NULL THEN 'free'
      WHEN (len(dom) = 0 OR list_contains(dom, s.class)) AND (len(ran) = 0 OR list_contains(ran, t.class)) THEN 'valid' ELSE 'invalid' END AS verdict
      FROM e LEFT JOIN c s ON e.sub_type = s.spelling LEFT JOIN c t ON e.obj_type = t.spelling LEFT JOIN o ON regexp_replace(lower(e.rel), '[\s_]+', '_', 'g') = o.name)"""


@query(_ontology_sql() + " SELECT edge_id, verdict FROM v")
def domain_range_check(spark, d):
    return ontology.checked(_edges(spark, d)).select("edge_id", "verdict")


@query(_ontology_sql() + " SELECT article_id, count(*) AS n, count_if(verdict IN ('valid', 'free'))::BIGINT AS n_valid, round(count_if(verdict IN ('valid', 'free')) / count(*), 6) AS score, round(count_if(verdict = 'valid') / nullif(count_if(verdict IN ('valid', 'invalid')), 0), 6) AS included_score FROM v GROUP BY article_id")
def ontology_validity(spark, d):
    return ontology.validity(_edges(spark, d), "article_id").select("article_id", "n", "n_valid", r6("score").alias("score"), r6("included_score").alias("included_score"))


@query("SELECT spelling AS category, class FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ontology.SPELLINGS.items()) + ") AS x(spelling, class) WHERE spelling IN (SELECT sub_type FROM edges)")
def category_lookup(spark, d):
    return table(spark, d, "edges").select(F.col("sub_type").alias("category"), ontology.category("sub_type").alias("class")).distinct().filter("class IS NOT NULL")


@query()
def textrank_weights(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(similarity.textrank("text")).alias("s")).select("doc_id", "s.sentence", r6("s.weight").alias("weight"))


@query()
def topic_coverage(spark, d):
    j = table(spark, d, "judged_triplets").withColumn("said", F.array_join(triplets.sentences(triplets.sanitized("output_triplets")), " "))
    return j.select("triplet_id", r6(similarity.topic_coverage("text", "said")).alias("coverage"))


# ---------------------------------------------------------------- graphs


@query(f"WITH {_E} SELECT rel AS value, row_number() OVER (ORDER BY rel) - 1 AS id FROM (SELECT DISTINCT rel FROM e)")
def vocab_ids(spark, d):
    return graph.vocabulary(_edges(spark, d), "rel", unk=False)


@query(f"WITH {_E} SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT sub_type AS value FROM e UNION SELECT obj_type FROM e UNION SELECT 'UNK')")
def type_ids(spark, d):
    return graph.vocabulary(_edges(spark, d), "sub_type", "obj_type")


@query(f"WITH {_E} SELECT value, row_number() OVER (ORDER BY value) AS id FROM (SELECT sub AS value FROM e UNION SELECT obj FROM e)")
def node_ids(spark, d):
    return graph.vocabulary(_edges(spark, d), "sub", "obj", start=1, unk=False)


@query(f"WITH {_E} SELECT (SELECT count(*) FROM (SELECT sub FROM e UNION SELECT obj FROM e)) AS n_nodes, count(*) AS n_edges, count(DISTINCT period) AS n_periods FROM e")
def dataset_report(spark, d):
    return graph.report(_edges(spark, d))


@query(f"WITH {_E} SELECT period, sub, obj, rel, rel_category, w FROM (SELECT *, row_number() OVER (PARTITION BY period, sub, obj ORDER BY date DESC, edge_id DESC) AS n FROM e) WHERE n = 1")
def graph_edges_last_wins(spark, d):
    return graph.last_edges(_edges(spark, d))


_ENDS = "x AS (SELECT period, edge_id, date, 0 AS side, sub AS node, sub_type AS type FROM e UNION ALL SELECT period, edge_id, date, 1, obj, obj_type FROM e)"


@query(f"WITH {_E}, {_ENDS} SELECT period, node, type FROM (SELECT *, row_number() OVER (PARTITION BY period, node ORDER BY date DESC, edge_id DESC, side DESC) AS n FROM x) WHERE n = 1")
def graph_nodes_last_type(spark, d):
    return graph.last_types(_edges(spark, d))


@query(f"WITH {_E}, {_ENDS} SELECT node AS id, type FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY side, date, edge_id) AS n FROM x) WHERE n = 1")
def viz_nodes_keep_first(spark, d):
    return graph.viz_nodes(_edges(spark, d))


@query(f"WITH {_E} SELECT DISTINCT sub AS source, obj AS target, rel AS label, period AS time, w FROM e")
def viz_edges(spark, d):
    return graph.viz_edges(_edges(spark, d))


@query(f"WITH {_E}, p AS (SELECT DISTINCT period, sub, obj FROM e) SELECT period, node, count(*) AS degree, round(ln(1 + count(*)), 6) AS log_degree FROM (SELECT period, sub AS node FROM p UNION ALL SELECT period, obj FROM p) GROUP BY period, node")
def node_degree(spark, d):
    return graph.degrees(_edges(spark, d)).withColumn("log_degree", r6("log_degree"))


_VOCABS = "nv AS (SELECT value, row_number() OVER (ORDER BY value) AS id FROM (SELECT sub AS value FROM e UNION SELECT obj FROM e)), rv AS (SELECT rel AS value, row_number() OVER (ORDER BY rel) AS id FROM (SELECT DISTINCT rel FROM e)), cv AS (SELECT value, row_number() OVER (ORDER BY value) AS id FROM (SELECT rel_category AS value FROM e UNION SELECT 'UNK'))"


@query(f"WITH {_E}, {_VOCABS}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, sub, obj ORDER BY date DESC, edge_id DESC) AS n FROM e) WHERE n = 1) SELECT period, s.id AS src, o.id AS dst, rv.id AS rel_id, cv.id AS cat_id, round(ln(1 + w), 6) AS log_w FROM g JOIN nv s ON g.sub = s.value JOIN nv o ON g.obj = o.value JOIN rv ON g.rel = rv.value JOIN cv ON g.rel_category = cv.value")
def packed_edges(spark, d):
    e = _edges(spark, d)
    p = graph.packed(e, graph.vocabulary(e, "sub", "obj", start=1, unk=False), graph.vocabulary(e, "rel", start=1, unk=False), graph.vocabulary(e, "rel_category", start=1))
    return p.withColumn("log_w", r6("log_w"))


_WIN = "pr AS (SELECT period, row_number() OVER (ORDER BY period) AS r FROM (SELECT DISTINCT period FROM e)), w AS (SELECT v.period, t.period AS train_period FROM pr v JOIN pr t ON t.r BETWEEN v.r - 3 AND v.r - 1)"


@query(f"WITH {_E}, {_WIN} SELECT period, train_period FROM w")
def rolling_windows(spark, d):
    return graph.windows(_edges(spark, d))


_SEEN = f"{_WIN}, kn AS (SELECT DISTINCT w.period, x.node FROM w JOIN (SELECT period, sub AS node FROM e UNION SELECT period, obj FROM e) x ON x.period = w.train_period), se AS (SELECT q.period, q.sub, q.obj, a.node IS NOT NULL AND b.node IS NOT NULL AS seen FROM (SELECT DISTINCT period, sub, obj FROM e) q LEFT JOIN kn a ON q.period = a.period AND q.sub = a.node LEFT JOIN kn b ON q.period = b.period AND q.obj = b.node WHERE q.period > (SELECT min(period) FROM e))"


@query(f"WITH {_E}, {_SEEN} SELECT period, sub, obj, seen FROM se")
def seen_unseen_edges(spark, d):
    return graph.seen_edges(_edges(spark, d))


NEG = 5
_NEGS = f"""q AS (SELECT period, sub, obj, min(edge_id) AS pos FROM e GROUP BY period, sub, obj),
 nd AS (SELECT period, node, row_number() OVER (PARTITION BY period ORDER BY substr(md5(node), 1, 3), node) - 1 AS no, count(*) OVER (PARTITION BY period) AS n FROM (SELECT period, sub AS node FROM q UNION SELECT period, obj FROM q)),
 sz AS (SELECT DISTINCT period, n FROM nd),
 dr AS (SELECT q.period, q.pos, q.sub, q.obj, j, (q.pos * 48271 + j * 16807 + 12345) % 2147483647 % sz.n AS no FROM q JOIN sz USING (period), (SELECT unnest(range(0, {3 * NEG})) AS j)),
 cd AS (SELECT dr.*, nd.node FROM dr JOIN nd ON dr.period = nd.period AND dr.no = nd.no WHERE nd.node <> dr.sub AND NOT EXISTS (SELECT 1 FROM q l WHERE l.period = dr.period AND (l.sub = dr.sub AND l.obj = nd.node OR l.obj = dr.sub AND l.sub = nd.node))),
 ng AS (SELECT period, pos, sub, obj, node AS neg, nth FROM (SELECT *, row_number() OVER (PARTITION BY period, pos ORDER BY j)::INT AS nth FROM cd) WHERE nth <= {NEG})"""


@query(f"WITH {_E}, {_NEGS} SELECT period, pos, sub, obj, neg, nth FROM ng")
def negative_samples(spark, d, whole=False):
    return drawn.negatives(_edges(spark, d)) if whole else _negatives(_edges(spark, d))


def _negatives(edges: DataFrame) -> DataFrame:
    """The negatives of the SQL, ``NEG`` at most and without further draws."""
    return graph.negatives(edges, NEG, pad=False)


def _vectors(spark, d, whole=False) -> DataFrame:
    """A vector for each node: that of the node's number among all embeddings, over and over; in the SQL modulo 500."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    n = 500
    if whole:
        e = e.join(graph.numbered(e, "vec_id"), "vec_id").drop("vec_id").withColumnRenamed("id", "vec_id")
        n = e.count()
    v = graph.vocabulary(_edges(spark, d), "sub", "obj", start=0, unk=False).select(F.col("value").alias("node"), (F.col("id") % n).alias("vec_id"))
    return v.join(e, "vec_id")


_SC = f"""{_NEGS}, ev AS (SELECT n.value AS node, b.embedding::DOUBLE[] AS v, b.label FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT sub AS value FROM e UNION SELECT obj FROM e)) n JOIN embeddings b ON b.vec_id = n.id % 500),
 sc AS (SELECT ng.period, ng.pos, ng.nth, list_dot_product(s.v, o.v) AS s_pos, list_dot_product(s.v, x.v) AS s_neg FROM ng JOIN ev s ON ng.sub = s.node JOIN ev o ON ng.obj = o.node JOIN ev x ON ng.neg = x.node)"""


def _scores(spark, d, whole=False) -> DataFrame:
    e = _edges(spark, d)
    return drawn.scored(e, _vectors(spark, d, whole)) if whole else linkpred.scored(graph.positives(e), _negatives(e), _vectors(spark, d))


def _settled(df: DataFrame) -> DataFrame:
    """Scores at nine decimals: equal vectors must tie whatever the order of summation."""
    return df.withColumns({"s_pos": F.round("s_pos", 9), "s_neg": F.round("s_neg", 9)})


_SR = _SC.replace("list_dot_product(s.v, o.v) AS s_pos", "round(list_dot_product(s.v, o.v), 9) AS s_pos").replace("list_dot_product(s.v, x.v) AS s_neg", "round(list_dot_product(s.v, x.v), 9) AS s_neg")


@query(f"WITH {_E}, {_SC} SELECT period, pos, nth, round(s_pos, 6) AS s_pos, round(s_neg, 6) AS s_neg FROM sc")
def edge_dot_scores(spark, d, whole=False):
    return _scores(spark, d, whole).select("period", "pos", "nth", r6("s_pos").alias("s_pos"), r6("s_neg").alias("s_neg"))


_RK = _SR + ", rk AS (SELECT period, pos, count_if(s_neg >= s_pos)::BIGINT + 1 AS rank FROM sc GROUP BY period, pos)"


@query(f"WITH {_E}, {_RK} SELECT period, pos, rank FROM rk")
def pos_rank(spark, d, whole=False):
    return linkpred.ranks(_settled(_scores(spark, d, whole)))


def _metrics(spark, d, whole=False) -> DataFrame:
    e = _edges(spark, d)
    pos = graph.positives(e)
    ranked = linkpred.ranks(_settled(_scores(spark, d, whole))).join(pos, ["period", "pos"]).join(graph.seen_edges(e), ["period", "sub", "obj"])
    return linkpred.metrics(ranked)


def _group_sql(name: str, cond: str) -> str:
    hits = ", ".join(f"round(avg(CASE WHEN {cond} THEN (rank <= {k})::INT END), 6) AS {name}hits{k}" for k in linkpred.HITS)
    return f"count_if({cond})::BIGINT AS {name}count, round(avg(CASE WHEN {cond} THEN 1.0 / rank END), 6) AS {name}mrr, {hits}"


_MT = f"{_RK}, {_SEEN}, ms AS (SELECT rk.period, rk.rank, se.seen FROM rk JOIN q ON rk.period = q.period AND rk.pos = q.pos JOIN se ON se.period = q.period AND se.sub = q.sub AND se.obj = q.obj)"


@query(f"WITH {_E}, {_MT} SELECT period, {_group_sql('', 'true')}, {_group_sql('seen_', 'seen')}, {_group_sql('unseen_', 'NOT seen')} FROM ms GROUP BY period")
def linkpred_metrics(spark, d, whole=False):
    m = _metrics(spark, d, whole)
    return m.select(*[c if c == "period" or c.endswith("count") else r6(c).alias(c) for c in m.columns])


_AVG = ", ".join(f"avg({c}) AS {c}" for c in ("mrr", "hits1", "hits3", "hits10", "seen_mrr", "unseen_mrr"))
_PP = "pp AS (SELECT period, count(*) AS n, avg(1.0 / rank) AS mrr, avg((rank <= 1)::INT) AS hits1, avg((rank <= 3)::INT) AS hits3, avg((rank <= 10)::INT) AS hits10, avg(CASE WHEN seen THEN 1.0 / rank END) AS seen_mrr, avg(CASE WHEN NOT seen THEN 1.0 / rank END) AS unseen_mrr FROM ms GROUP BY period)"


@query(f"WITH {_E}, {_MT}, {_PP}, av AS (SELECT {_AVG}, sum(mrr * n) / sum(n) AS weighted_mrr FROM pp) SELECT 'dot' AS model, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mrr", "hits1", "hits3", "hits10", "seen_mrr", "unseen_mrr", "weighted_mrr")) + " FROM av")
def linkpred_metrics_avg(spark, d, whole=False):
    a = linkpred.averaged(_metrics(spark, d, whole).withColumn("model", F.lit("dot")))
    return a.select("model", *[r6(c).alias(c) for c in a.columns if c != "model"])


@query(f"WITH {_E}, {_MT}, by_half AS (SELECT CASE WHEN period < '2022-07' THEN 'early' ELSE 'late' END AS model, round(avg(1.0 / rank), 6) AS mrr FROM ms GROUP BY 1) SELECT model, mrr, row_number() OVER (ORDER BY mrr DESC, model)::INT AS position FROM by_half")
def leaderboard(spark, d, whole=False):
    e = _edges(spark, d)
    pos = graph.positives(e)
    ranked = linkpred.ranks(_settled(_scores(spark, d, whole))).join(pos, ["period", "pos"]).join(graph.seen_edges(e), ["period", "sub", "obj"])
    halves = ranked.withColumn("model", F.when(F.col("period") < "2022-07", "early").otherwise("late"))
    return linkpred.leaderboard(halves.groupBy("model").agg(r6(F.avg(1 / F.col("rank"))).alias("mrr")))


@query(f"WITH {_E}, {_SC} SELECT period, round(avg(greatest(5.0 + s_neg - s_pos, 0)), 6) AS bpr FROM sc GROUP BY period")
def loss_bpr(spark, d, whole=False):
    return _scores(spark, d, whole).groupBy("period").agg(r6(linkpred.hinge_loss()).alias("bpr"))


_LS = "(least({0}, 0) - ln(1 + exp(-abs({0}))))"


@query(f"WITH {_E}, {_SC} SELECT period, round(-avg({_LS.format('(s_pos - 1)')} + {_LS.format('(1 - s_neg)')}), 6) AS findkg FROM sc GROUP BY period")
def loss_findkg(spark, d, whole=False):
    return _scores(spark, d, whole).groupBy("period").agg(r6(linkpred.margin_loss()).alias("findkg"))


_NCE = "nc AS (SELECT period, avg(ln(exp(any_p / 0.8) + s) - any_p / 0.8) AS nce FROM (SELECT period, pos, any_value(s_pos) AS any_p, sum(exp(s_neg / 0.8)) AS s FROM sc GROUP BY period, pos) GROUP BY period)"


@query(f"WITH {_E}, {_SC}, {_NCE} SELECT period, round(nce, 6) AS infonce FROM nc")
def loss_infonce(spark, d, whole=False):
    return linkpred.info_nce(_scores(spark, d, whole), 64).select("period", r6("info_nce").alias("infonce"))


_CE = "ce AS (SELECT n.period, avg(ln(list_sum(list_transform(ev.v[1:10], lambda x: exp(x)))) - ev.v[ev.label + 1]) AS ce FROM (SELECT period, sub AS node FROM e UNION SELECT period, obj FROM e) n JOIN ev ON n.node = ev.node GROUP BY n.period)"


def _cross_entropy(spark, d, whole=False) -> DataFrame:
    nodes = _edges(spark, d).select("period", F.explode(F.array("sub", "obj")).alias("node")).distinct()
    rows = nodes.join(_vectors(spark, d, whole).withColumn("logits", F.slice("vector", 1, 10)), "node")
    return linkpred.cross_entropy(rows.withColumn("logits", F.transform("logits", lambda x: x.cast("double"))), "logits", "label", ("period",))


@query(f"WITH {_E}, {_SC}, {_CE} SELECT period, round(ce, 6) AS ce FROM ce")
def loss_ce(spark, d, whole=False):
    return _cross_entropy(spark, d, whole).select("period", r6("cross_entropy").alias("ce"))


@query(f"WITH {_E}, {_SC}, {_NCE}, {_CE} SELECT period, round(nce + 0.5 * ce, 6) AS hybrid FROM nc JOIN ce USING (period)")
def loss_hybrid(spark, d, whole=False):
    both = linkpred.info_nce(_scores(spark, d, whole), 64).join(_cross_entropy(spark, d, whole), "period")
    return both.select("period", r6(linkpred.hybrid(F.col("info_nce"), F.col("cross_entropy"))).alias("hybrid"))


#: The whole job beside each query whose SQL has 5 negatives and 500 vectors: 50 negatives, drawn again where too few are
#: valid, and all embeddings.
for _name in ("negative_samples", "edge_dot_scores", "pos_rank", "linkpred_metrics", "linkpred_metrics_avg", "leaderboard", "loss_bpr", "loss_findkg", "loss_infonce", "loss_ce", "loss_hybrid"):
    QUERIES[f"{_name}_whole"] = partial(QUERIES[_name], whole=True)


# ---------------------------------------------------------------- graph attention (no SQL can give these)


@query()
def name_hash_vector(spark, d):
    nodes = _edges(spark, d).select(F.explode(F.array("sub", "obj")).alias("node")).distinct()
    return nodes.select("node", gat.name_vectors("node").alias("vector"))


@query()
def node_features(spark, d):
    return gat.node_features(_edges(spark, d))


@query()
def gat_forward(spark, d):
    return gat.encoded(_edges(spark, d))


@query()
def gat_train(spark, d):
    """All ten configurations over all edges, by month."""
    return gat.experiments(_edges(spark, d), gat.grid()).drop("weights")


@query()
def gat_edge_scores(spark, d):
    e, configs = _edges(spark, d), gat.grid()
    return gat.scored_edges(e, gat.trained_or_loaded(e, configs, None), configs)


# ---------------------------------------------------------------- prompts and flags


@query("SELECT triplet_id, md5('Judge: ' || coalesce(output_triplets, '') || ' of ' || coalesce(text, '')) AS coverage, md5('Unique? {' || coalesce(output_triplets, '') || '}') AS uniqueness FROM judged_triplets")
def judge_prompts(spark, d):
    j = table(spark, d, "judged_triplets")
    p = prompts.judge_prompts({"coverage": "Judge: {triplets_} of {article_text_}", "uniqueness": "Unique? {{{triplets_}}}", "consistency": "{triplets_}", "semantic_validity": "{triplets_}"}, F.col("text"), F.col("output_triplets"))
    return j.select("triplet_id", F.md5(p["coverage"]).alias("coverage"), F.md5(p["uniqueness"]).alias("uniqueness"))


@query("SELECT triplet_id, coverage >= 0.75 AS covered, uniqueness >= 0.75 AS is_unique, semantic_validity >= 0.75 AND (semantic_validity + consistency) / 2 >= 0.75 AS valid FROM extracted_scores WHERE coverage IS NOT NULL AND uniqueness IS NOT NULL AND semantic_validity IS NOT NULL AND consistency IS NOT NULL")
def alignment_flags(spark, d):
    s = table(spark, d, "extracted_scores").dropna().withColumns({"llm_" + c: F.col(c) for c in scores.CATEGORIES}).withColumns({"ontology": F.col("semantic_validity"), "entropy_ratio": F.lit(0.5)})
    return pipelines.agreement(s).select("triplet_id", "covered", F.col("unique").alias("is_unique"), "valid")


@query("SELECT ticker, unnest(generate_series(min(make_timestamp(epoch_us(loaded_at)))::DATE, max(make_timestamp(epoch_us(loaded_at)))::DATE, INTERVAL 1 DAY))::DATE::VARCHAR AS day FROM nasdaq_semi_data_cleaned WHERE ticker IS NOT NULL GROUP BY ticker")
def ticker_days(spark, d):
    a = _articles(spark, d).filter("ticker IS NOT NULL").groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return a.select("ticker", F.explode(prompts.days(F.col("a"), F.col("b"))).alias("day")).withColumn("day", F.col("day").cast("string"))


# ---------------------------------------------------------------- whole stages


@query()
def extract_stage(spark, d):
    return pipelines.extract(_articles(spark, d), table(spark, d, "judged_triplets"))


@query()
def judge_stage(spark, d):
    return pipelines.judge(table(spark, d, "judged_triplets"))


@query()
def link_prediction_stage(spark, d):
    return pipelines.link_prediction(_edges(spark, d), _vectors(spark, d, whole=True))
