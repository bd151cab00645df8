from newsloom.llm import answer_defects as ad
from newsloom.llm import term_counts as tc
from newsloom.llm import truncation as tr

EN = "The board at Acme kept the outlook firmer even though bookings gained 19.1%. Debt at Acme rose to $44.24 billion through the loan signed in Dunmarrow."
DE = "Der Umsatz von Acme wuchs um 5,1 % wegen der Exportprüfung. Die Analysten von Acme rechnen mit der neuen Linie für das Werk."
GOOD = "('Acme', 'COMPANY', 'Supplies', 'SSI', 'Revenue', 'CONCEPT')"
DE_GOOD = "('Acme', 'COMPANY', 'Beliefert', 'SSI', 'Umsatz', 'CONCEPT')"
ANSWERS = [
    (EN, None, "empty"), (EN, "  ", "empty"), (EN, "[]", "empty"), (EN, "Output: []", "empty"), (EN, "```python\n[]\n```", "empty"), (EN, "[()]", "empty"), (EN, "[('', '')]", "empty"), (EN, "N/A", "empty"), (EN, "Here are the triplets:", "empty"), (EN, "''", "empty"),
    (EN, f"[{GOOD}, ('Acme', 'COMP", "truncated"), (EN, f"[{GOOD}", "truncated"), (EN, f"[{GOOD},", "truncated"), (EN, "Output: [('Ac", "truncated"), (EN, f"[{GOOD}, ('Ac…", "truncated"),
    (EN, "I cannot extract relations from this passage.", "refusal"), (EN, '{"error": "Sorry, that request falls outside my scope."}', "refusal"), (EN, "Lo siento, no puedo procesar este artículo.", "refusal"), (DE, "Ich darf zu diesem Artikel keine Angaben machen.", "refusal"), (EN, "抱歉，我无法处理这篇文章。", "refusal"),
    (EN, EN, "copy"), (EN, "> " + EN.split(". ")[0], "copy"), (EN, "INPUT_TEXT: " + EN.lower(), "copy"), (EN, "['" + EN + "']", "copy"), (EN, "[('" + EN.split(". ")[0].replace(",", "") + "')]", "copy"),
    (EN, f"[{DE_GOOD}, {DE_GOOD}]", "other_language"), (DE, f"[{GOOD}, {GOOD}]", "other_language"), (EN, "[('Acme', 'COMPANY', '供应', 'SSI', '营收', 'CONCEPT')]", "other_language"), (EN, DE, "other_language"),
    (EN, f"[{GOOD}]", None), (EN, f"{GOOD}, {GOOD}", None), (EN, f"I cannot be certain of every type, but these hold:\n[{GOOD}]", None), (EN, f"```python\n[\n{GOOD}\n]\n```", None), (EN, "[('Acme', 'COMPANY', 'Supplies', 'SSI', 'Revenue')]", None), (DE, f"[{DE_GOOD}]", None), (EN, f"[{GOOD.replace('Acme', 'O’Neil')}]", None),
    (EN, "[('O'Neil Works', 'COMPANY', 'Supplies', 'SSI', 'Revenue', 'CONCEPT')]", None), (None, f"[{DE_GOOD}]", None), (EN, f"[{GOOD.replace('Supplies', 'Un')}" + "]", None),
]


def test_defects(spark):
    filler = [(EN, f"[{GOOD}]", None)] * 30 + [(DE, f"[{DE_GOOD}]", None)] * 30
    rows = [(k, t, a, "x") for k, (t, a, _) in enumerate(ANSWERS + filler)]
    df = spark.createDataFrame(rows, "triplet_id long, text string, output_triplets string, defect string")
    got = {r.triplet_id: r.defect for r in ad.answer_defects(df).collect()}
    assert {k: (got.get(k), a) for k, (_, a, w) in enumerate(ANSWERS) if got.get(k) != w} == {}
    assert ad.answer_defects(df.limit(0)).count() == 0
    assert ad.answer_defects(df.union(df)).count() == 2 * ad.answer_defects(df).count()


def test_tiling():
    a, b = "a b c d e f g".split(), "x a b c d y d e f g".split()
    assert ad.tiled(a, b) == 4 + 0 or ad.tiled(a, b) == 7
    assert ad.tiled("p q r".split(), b) == 0 and ad.tiled([], b) == 0
    assert ad.tiled("a b c d a b c d".split(), "a b c d".split()) == 4
    assert ad.defect("[" + "(" * 5000, EN) == "truncated"


def test_term_counts_against_brute_force(spark):
    import random

    rng = random.Random(9)
    labels = [None, "", " ", "SSI", "ssi.", " S.S.I", "é", "Acquires_Stake In", "acquires stake in", "ÄB1", "x" * 10_000] + [f"t{k}" for k in range(40)]
    rows = [(rng.choice([None, 1, 1, 1, 2, 3, 4, 5, 6, 7]), *[rng.choice(labels) for _ in range(3)], "z") for _ in range(2000)]
    rows += rows[:50] + [(8, "onlyonce", None, None, "z")]
    df = spark.createDataFrame(rows, "article_id long, rel string, sub_type string, rel_category string, term string")
    want = {}
    for a, *ls, _ in rows:
        for f, v in zip(tc.FIELDS, ls):
            t = "".join(c for c in (v or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
            if t:
                n, s = want.setdefault((f, t), [0, set()])
                want[f, t][0] += 1
                want[f, t][1].add(a)
    got = {(r.field_name, r.term): (r.occurrences, r.articles, r.mark) for r in tc.marked_terms(df).collect()}
    every = len({r[0] for r in rows if r[0] is not None})
    assert {k: v[:2] for k, v in got.items()} == {k: (n, len(s - {None})) for k, (n, s) in want.items()}
    for k, (_, s) in want.items():
        m = len(s - {None})
        assert got[k][2] == ("rare" if 0 < m < 3 else "common" if m > 0.2 * every else None)
    assert tc.term_counts(df.limit(0)).count() == 0
    nos = [r.term_no for r in tc.dictionary(spark.createDataFrame(list(want), "field_name string, term string")).collect()]
    assert sorted(nos) == list(range(len(want)))


def test_truncation(spark):
    names = ["Acme", "Bolt", "Corvin", "Dray", "Elm", "Fenn"]
    full = [f"The board at {a} kept the outlook firmer as rivals cut prices. {b} agreed to buy {c} for ${k}.5 million, the two firms said in Dunmarrow." for k, (a, b, c) in enumerate((x, y, z) for x in names for y in names for z in names)]
    ends = {
        1: "The board at Acme kept the outlook firmer as rivals cut prices. Bolt agreed to buy Corvin for $3.5 million, the two firms", 2: "The board at Acme kept the outlook firmer as rivals cut prices. Bolt agreed to bu", 3: "The board at Elm kept the out…", 4: "The board at Elm kept the outlook firmer as rivals cut...",
        5: "Bolt agreed to buy Corvin for $3.", 6: "The board at Dray kept the outlook,", 7: "He said “the board at Elm kept the outlook firmer as rivals cut prices.",
    }
    whole = {11: "The board at Acme kept the outlook firmer as rivals cut prices", 12: "Corvin Eyes Dunmarrow", 13: full[3] + " Read on ...", 14: full[4], 15: None, 16: "", 17: "   ", 18: full[5] + " More at the site..."}
    rows = [(1000 + k, "f", t, "x") for k, t in enumerate(full)] + [(k, "f", t, "x") for k, t in {**ends, **whole}.items()]
    a = spark.createDataFrame(rows, "article_id long, feed string, summary string, value string")
    lists = {1: f"[{GOOD}]", 2: f"[{GOOD}", 3: f"[{GOOD}, ('Ac", 4: f"{GOOD}, {GOOD}", 5: "[]", 6: None, 7: f"[{GOOD},", 8: f"```python\n[{GOOD}]\n```", 9: "Output: [('Ac…", 10: "None", 11: "[('O'Neil', 'b')]"}
    j = spark.createDataFrame([(k, "m", t) for k, t in lists.items()], "triplet_id long, model_name string, output_triplets string")
    got = {tuple(r) for r in tr.cut_values(a, j).collect()}
    assert got == {("nasdaq_semi_data_cleaned", k) for k in ends} | {("judged_triplets", k) for k in (2, 3, 7, 9)}
    shares = {(r.table_name, r.source): (r.n_values, r.n_cut) for r in tr.cut_shares(a, j).collect()}
    assert shares == {("nasdaq_semi_data_cleaned", "f"): (len(full) + len(ends) + 5, len(ends)), ("judged_triplets", "m"): (10, 4)}
    assert tr.cut_values(a.limit(0), j.limit(0)).count() == 0


def test_copies_do_not_vouch_for_each_other(spark):
    names = ["Acme", "Bolt", "Corvin", "Dray", "Elm", "Fenn"]
    full = [f"The board at {a} kept the outlook firmer as rivals cut prices. {b} agreed to buy {c} for ${k}.5 million, the two firms said in Dunmarrow." for k, (a, b, c) in enumerate((x, y, z) for x in names for y in names for z in names)]
    cut = {100: "The board at Elm kept the outlook firmer as rivals", 200: "Bolt agreed to buy Corvin for $3.5 million, the two firms", 300: "The board at Acme kept the outlook firmer as rivals cut prices. Bolt agreed to bu"}
    rows = [(1000 + k, "f", t) for k, t in enumerate(full)] + [(k + i, "f", t) for k, t in cut.items() for i in range(60)] + [(400 + i, "f", full[3]) for i in range(60)]
    a = spark.createDataFrame(rows, "article_id long, feed string, summary string")
    j = spark.createDataFrame([], "triplet_id long, model_name string, output_triplets string")
    got = sorted(r.record_id for r in tr.cut_values(a, j).collect())
    assert got == [k + i for k in cut for i in range(60)]
