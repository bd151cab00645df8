import ast
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.functions import ontology, scores, triplets
from newsloom.sources import csv_records


def plain(text):
    """The same rules in plain Python."""
    out = []
    for g in re.findall(r"\((.*?)\)", text, re.S):
        parts = [p for p in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s]+", g) if p not in ("''", '""')]
        parts = [re.sub(r"[^a-zA-Z0-9\s]", "", p).strip() for p in parts]
        if len(parts) == 6:
            out.append(parts)
    return out


def test_sanitized(spark):
    rng = random.Random(6)
    texts = ["", "[]", "[('A', 'B', 'C d', 'SSI', 'E', 'F')]", "(a, b, c, d, e, f) and (a, b)", "('a','','b','c','d','e','f')", "('STOCK_TICKER','é','!','x','y','z')", None]
    texts += ["".join(rng.choice("ab'\",() \n_é1") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["(" + ", ".join(rng.choice(["'a b'", '"c"', "d", "''"]) for _ in range(rng.randint(4, 8))) + ")" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", triplets.sanitized("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else plain(t)), t
    lit = {r.i: r.s for r in df.select("i", triplets.literal_text(triplets.sanitized("t")).alias("s")).filter("s IS NOT NULL").collect()}
    assert all([list(x) for x in ast.literal_eval(s)] == got[i] for i, s in lit.items())


def test_strategies(spark):
    rows = [("o", "[x]"), ("o", " [x] "), ("o", "Evaluation meets expectation"), ("o", "Require Human Review"), ("o", ""), ("o", None), (None, None)]
    df = spark.createDataFrame(rows, "output_triplets string, revised_triplets string")
    run = lambda d, s: [r[0] for r in d.select(triplets.selected(d, s)).collect()]
    assert run(df, "original") == ["o"] * 6 + ["nan"]
    assert run(df, "fallback") == ["[x]", "[x]", "o", "o", "o", "o", "nan"]
    assert run(df, "strict") == ["[x]", "[x]", "o", "[]", "[]", "[]", "[]"]
    assert run(df.drop("revised_triplets"), "strict") == ["o"] * 6 + ["nan"]
    with pytest.raises(ValueError):
        triplets.selected(df, "other")


def test_normalised_forms():
    six = {"sub": "a", "sub_type": "b", "rel": "c", "rel_category": "d", "obj": "e", "obj_type": "f", "w": 1.0}
    assert triplets.parse_list("[('a','b','c','d','e','f')]") == [six]
    assert triplets.parse_list("[('a','r','o'), ('x','y'), {'s':'a','p':'r','o':'o','w':'bad'}, {'sub':'','subject':'z','rel':'r','obj':'o','w':2}, {'sub':1,'rel':'r','obj':'o'}]") == [
        {"sub": "a", "rel": "r", "obj": "o", "sub_type": "UNK", "rel_category": "UNK", "obj_type": "UNK", "w": 1.0},
        {"sub": "a", "rel": "r", "obj": "o", "sub_type": "UNK", "rel_category": "UNK", "obj_type": "UNK", "w": 1.0},
        {"sub": "z", "rel": "r", "obj": "o", "sub_type": "UNK", "rel_category": "UNK", "obj_type": "UNK", "w": 2.0},
    ]
    assert triplets.parse_list("nope") is None and triplets.parse_list(None) is None and triplets.parse_list("5") is None and triplets.parse_list("[]") == []
    assert csv_records.triplet_list("[('a','b','c','d','e',6)]") is None


def test_json_and_scores(spark):
    df = spark.createDataFrame([(1, 'x {"a": {"b": 1}} y'), (2, "```json\nq\n```"), (3, None)], "i int, t string")
    assert {r.i: r.b for r in df.select("i", triplets.json_object("t").alias("b")).collect()} == {1: '{"a": {"b": 1}}', 2: "q", 3: None}
    s = spark.createDataFrame([(0.7, 1.0, -0.5, None)], "coverage double, uniqueness double, semantic_validity double, consistency double")
    text = s.select(scores.blob({c: F.col(c) for c in scores.CATEGORIES[:3]} | {"consistency": F.lit(2)}).alias("t"))
    assert tuple(text.select(*[c.alias(n) for n, c in scores.extracted("t").items()]).first()) == (0.7, 1.0, -0.5, 2.0)
    assert scores.find_column(spark.createDataFrame([(1,)], "` LLM Judgments ` int"), "llm judgments") == " LLM Judgments "
    with pytest.raises(ValueError):
        scores.find_column(s, "x")


def test_statistics_of_few_values(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, None), (2.0, 3.0, None, None), (4.0, 3.0, None, None), (9.0, None, None, None)], "coverage double, uniqueness double, semantic_validity double, consistency double")
    got = {r.category: r for r in scores.stats(df).collect()}
    v = pd.Series([1.0, 2.0, 4.0, 9.0])
    assert abs(got["coverage"].skew - v.skew()) < 1e-9 and abs(got["coverage"].kurtosis - v.kurt()) < 1e-9 and got["uniqueness"].kurtosis is None and got["uniqueness"].skew is not None
    assert got["semantic_validity"].std == 0.0 and got["semantic_validity"].skew is None
    assert got["consistency"]["count"] == 0 and got["consistency"].missing == 4 and got["consistency"]["mean"] is None
    assert sum(r.n for r in scores.histogram(df).collect()) == 8
    assert scores.stats(df.limit(0)).count() == 0


def test_ontology(spark):
    assert len(ontology.PROPERTIES) == 56 and len(ontology.CLASSES) == 12 and len(ontology.SPELLINGS) == 18
    rows = [("COMPANY", "Acquires", "STOCK_TICKER"), ("COMPANY", "acquires", "EVENT"), ("PERSON", "Acquires", "COMPANY"), ("COMPANY", "likes", "EVENT"), ("BOND", "follows trend", "SECTOR"), (None, None, None)]
    df = spark.createDataFrame([(k % 2, *r) for k, r in enumerate(rows)], "k int, sub_type string, rel string, obj_type string")
    assert [r.verdict for r in ontology.checked(df).collect()] == ["valid", "invalid", "unknown_class", "free", "valid", "unknown_class"]
    got = {r.k: r for r in ontology.validity(df, "k").collect()}
    assert got[0].n_valid == 2 and got[0].included_score == 1.0 and got[1].score == 1 / 3
