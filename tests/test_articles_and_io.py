from datetime import datetime

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import ontology, prompts
from newsloom.operators import articles
from newsloom.plans import pipelines
from newsloom.sources import clients, files, sinks
from newsloom.streaming import extraction

COLS = "article_id long, date timestamp, title string, text string, summary string, ticker string"
LONG = "Acme Corporation agreed to buy Bolt Industries for a large sum, the two said."


def rows(spark):
    t = lambda d: datetime(2024, 1, d)
    return spark.createDataFrame(
        [(1, t(3), "Same title here", "x", LONG, "A"), (2, t(1), "Same title here", "y", LONG, "A"), (3, t(1), "Same title here", "z", LONG, "B"), (4, None, "No date at all", None, None, None), (5, t(9), None, None, None, "A"), (6, t(9), "short", "t", "s", "A")], COLS
    )


def test_cleaning(spark):
    a = rows(spark)
    assert {r.article_id for r in articles.date_range(a, "2024-01-01", "2024-01-03").collect()} == {1, 2, 3}
    assert {r.article_id for r in articles.date_range(a).collect()} == {1, 2, 3, 4, 5, 6}
    assert {r.article_id for r in articles.long_enough(articles.filled(a)).collect()} == {1, 2, 3, 4}
    assert {r.article_id for r in articles.keep_first(articles.filled(a)).collect()} == {2, 4, 5, 6}
    assert [tuple(r) for r in articles.ticker_stats(a).collect()] == [("A", 1, 3), ("B", 1, 1)]
    assert articles.ticker_whitelist(a.drop("ticker"), ["A"]).count() == 6
    done = spark.createDataFrame([(" Same title here\t",), (None,)], "title string")
    assert {r.article_id for r in articles.not_done(a, done).collect()} == {4, 5, 6}
    out = {r.article_id: r.p for r in a.select("article_id", articles.rendered("{{x}} {t}", t=articles.prompt_text(a)).alias("p")).collect()}
    assert out[1] == "{x} " + LONG and out[4] == "{x} No date at all" and out[5] == "{x} "


def test_csv_round_trip(spark, tmp_path):
    p = str(tmp_path / "a")
    df = spark.createDataFrame([("2024-01-01", 'He said "no", twice', "two\nlines", "s", "u", "T"), (None, "t", None, "", "u", "T")], schemas.ARTICLES)
    sinks.overwrite(df, p)
    got = files.article_scan(spark, p, "semi_cleaned_data")
    assert {r.title: r.text for r in got.collect()} == {'He said "no", twice': "two\nlines", "t": None}
    assert files.done_titles(spark, str(tmp_path / "none")).count() == 0 and files.judged_scan(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.csv").write_text("date,title,text,summary,url,ticker\n1,2,3,4,5,6\n1,2,3,4,5,6,7\n1,2\n")
    bad = files.csv(spark, str(tmp_path / "bad.csv"), schemas.ARTICLES)
    assert files.lenient(bad).count() == 1 and files.corrupt_count(bad) == 2
    (tmp_path / "l1.csv").write_bytes("date,title,text,summary,url,ticker\n1,Zürich,3,4,5,6\n".encode("latin-1"))
    assert files.either_encoding(spark, str(tmp_path / "l1.csv"), schemas.ARTICLES).first().title == "Zürich"
    answers = spark.createDataFrame([("a", "[x]"), ("b", " nan "), ("c", None), ("d", "")], "title string, output_triplets string")
    sinks.append_answers(answers, str(tmp_path / "o"))
    sinks.append_answers(answers, str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 2
    assert sinks.stage_name("d/x.csv", "metrics_computation") == "d/x_JudgeLLM_metrics_computation.csv" and sinks.output_name("m", "d", "c") == "triplets_m_d_c.csv"


def test_graph_page(spark):
    n = spark.createDataFrame([("a", "T"), ("b</script>", "U")], "id string, type string")
    e = spark.createDataFrame([("a", "b</script>", "r", 0.5)], "source string, target string, label string, score double")
    page = sinks.graph_page(n, e, "<t>")
    assert "&lt;t&gt;" in page and "b</script>" not in page and '"score": 0.5' in page
    assert "nodes" in sinks.graph_page(n, e.limit(0))


def test_errors_stay_with_their_rows(spark):
    def client(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return clients.Answer(prompt.upper(), None, 1.5, 2, 3)

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "i int, prompt string")
    got = {r.i: r for r in clients.asked(df, "prompt", client).collect()}
    assert got[1].answer == "OK" and got[2].answer is None and got[2].error == "RuntimeError: down" and got[3].answer is None and got[3].error is None
    total = clients.asked(df, "prompt", client).agg(F.sum("seconds"), F.sum("tokens_in"), F.sum("tokens_out")).first()
    assert tuple(total) == (1.5, 2, 3)


def test_stages(spark):
    out = pipelines.extract(rows(spark)).collect()
    assert {r.article_id for r in out} == {2, 4} and all(r.output_triplets.startswith("[('") for r in out)
    j = spark.createDataFrame([(1, LONG + " It fell.", out[0].output_triplets, "Coverage score 0.9\nUniqueness score 0.8\nSemantic validity score 1\nConsistency score 0.5"), (2, None, "[]", None)], "triplet_id long, text string, output_triplets string, llm_judgments_evaluation string")
    m = pipelines.judge(j).collect()
    assert len(m) == 1 and 0 <= m[0].coverage <= 1 and 0 < m[0].uniqueness <= 1 and m[0].llm_consistency == 0.5
    assert pipelines.agreement(pipelines.judge(j)).count() == 1


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    for k, ids in enumerate(((1, 2), (3, 4))):
        rows(spark).filter(F.col("article_id").isin(*ids)).coalesce(1).write.mode("append").parquet(str(src))
    q = extraction.run(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("title").distinct().count() == got.count() == 1
    extraction.run(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert extraction.monthly_counts(extraction.arriving(spark, str(src))).isStreaming


def test_prompts(spark):
    df = spark.createDataFrame([(1, '{"Explanation": "e", "Revised_Triplets": "[1]"}'), (2, "no json"), (3, '{"Explanation": "e"}'), (4, 'x {"Revised_Triplets": "oops"} y'), (5, "{broken}"), (6, None)], "i int, t string")
    text, error = prompts.revision(F.col("t"))
    got = {r.i: (r.a, r.b) for r in df.select("i", text.alias("a"), error.alias("b")).collect()}
    assert got == {1: ("[1]", None), 2: (None, "JSON Error on Reprompt"), 3: (None, "Error: Missing 'Revised_Triplets' key"), 4: (None, "Error: Corrupt triplets string"), 5: (None, "JSON Error on Reprompt"), 6: (None, "Error: Missing 'Revised_Triplets' key")}
    p = prompts.feedback_prompt("{is_unique} {{x}} {triplets_}", F.lit("a"), F.lit("t"), F.lit("j"), {f: F.lit(True) for f in prompts.FLAGS})
    assert spark.range(1).select(p).first()[0] == "True {x} t"
    assert spark.range(1).select(prompts.file_name(F.lit("a b/ç.csv"))).first()[0] == "a_b__.csv"


def test_monthly_pages_and_ontology_file(spark, tmp_path):
    n = spark.createDataFrame([("a", "T")], "id string, type string")
    e = spark.createDataFrame([("a", "b", "r", "2024-01"), ("a", "c", "r", "2024-02")], "source string, target string, label string, time string")
    assert set(sinks.monthly_pages(n, e)) == {"2024-01", "2024-02"}
    (tmp_path / "o.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#"><owl:ObjectProperty rdf:about="http://x/o#has"><rdfs:domain rdf:resource="#A"/><rdfs:domain rdf:resource="#B"/></owl:ObjectProperty></rdf:RDF>')
    assert ontology.load(str(tmp_path / "o.rdf")) == [("has", ["A", "B"], [])]


def test_every_article_gets_a_date_or_null(spark, tmp_path):
    from newsloom import queries

    dates = ["2024-01-02 03:04:05", "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "soon", "", None]
    spark.createDataFrame([(k, x) for k, x in enumerate(dates)], "article_id int, date string").write.parquet(f"{tmp_path}/nasdaq_semi_data_cleaned.parquet")
    got = {r.article_id: r.micros for r in queries.QUERIES["article_typed_date_whole"](spark, str(tmp_path)).collect()}
    noon = 1704164645000000
    assert got == {0: noon, 1: 1704153600000000, 2: noon, 3: noon - 7200 * 10**6, 4: None, 5: None, 6: None}
