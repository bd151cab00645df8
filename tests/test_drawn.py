import math
import random

import pytest

from newsloom.operators import drawn, graph, linkpred

EDGE = "edge_id long, sub string, sub_type string, rel string, rel_category string, obj string, obj_type string, w double, period string"


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(6)
    few = [(1000 + k, f"é{k}", "T", "r", "c", f"é{(k + 1) % 5}", "T", 1.0, "few") for k in range(5)]
    all_linked = [(2000, "x", "T", "r", "c", "y", "T", 1.0, "all linked"), (2001, "x", "T", "r", "c", "x", "T", 1.0, "all linked")]
    hub = [(3000 + k, "hub", "T", "r", "c", f"n{k}", "T", 1.0, "hub") for k in range(60)] + [(3100, "n7", "T", "r", "c", "", "T", 1.0, "hub")]
    chance = [(k, f"n{rng.randint(0, 90)}", "T", "r", "c", f"n{rng.randint(0, 90)}", "T", 1.0, f"p{k % 3}") for k in range(400)]
    return spark.createDataFrame(few + all_linked + hub + chance + chance[:9] + [(2**46, "n1", "T", "r", "c", "hub", "T", 1.0, "p1")], EDGE)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(7)
    said = [(f"n{k}", [rng.choice((0.5, 1.0, -2.0)) for _ in range(4)]) for k in range(88)]  # three nodes have none
    said += [("hub", [1.0, 2.0, 3.0, 4.0]), ("n88", None), ("n89", [1.0, 2.0]), ("", [1.0, None, 1.0, 1.0]), ("é0", [1.0]), ("é1", [2.0])]
    return spark.createDataFrame(said, "node string, vector array<float>")


def small(monkeypatch):
    """Everything in files, by many small tasks and steps."""
    monkeypatch.setattr(drawn, "HELD_BYTES", 8)
    monkeypatch.setattr(drawn, "TASK_POSITIVES", 7)
    monkeypatch.setattr(drawn, "TASK_NODES", 0)
    monkeypatch.setattr(drawn, "AT_ONCE", 3)


@pytest.mark.parametrize("k, tries", [(50, 3), (4, 1), (7, 2)])
def test_negatives_are_those_of_the_join(spark, edges, monkeypatch, k, tries):
    want = sorted(map(tuple, graph.negatives(edges, k, tries).collect()))
    assert want and sorted(map(tuple, drawn.negatives(edges, k, tries).collect())) == want
    small(monkeypatch)
    assert sorted(map(tuple, drawn.negatives(edges, k, tries).collect())) == want


def test_scores_are_those_of_the_join(spark, edges, vectors, monkeypatch):
    want = linkpred.scored(graph.positives(edges), graph.negatives(edges), vectors).select("period", "pos", "nth", "s_pos", "s_neg").collect()
    round9 = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert want and round9(drawn.scored(edges, vectors).collect()) == round9(want)
    assert any(r.s_neg is None for r in want)
    small(monkeypatch)
    assert round9(drawn.scored(edges, vectors).collect()) == round9(want)


def test_whole_queries_make_no_row_for_a_draw():
    from inspect import getsource

    from newsloom import queries

    assert "drawn.scored(" in getsource(queries._scores) and "drawn.negatives(" in getsource(queries.negative_samples)


def test_stage_makes_no_row_for_a_draw(spark, edges, vectors):
    """No number of draws is exploded in the plan; the metrics are those of the joins."""
    from pyspark.sql import functions as F

    from newsloom.plans import pipelines

    e = edges.withColumn("date", F.lit("2024-01-01"))
    got = pipelines.link_prediction(e, vectors)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sequence(0, 149" not in plan
    pos = graph.positives(e)
    ranked = linkpred.ranks(linkpred.scored(pos, graph.negatives(e), vectors))
    want = linkpred.metrics(ranked.join(pos, ["period", "pos"]).join(graph.seen_edges(e), ["period", "sub", "obj"]))
    near = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert near(got.collect()) == near(want.collect())


def test_info_nce_gathers_no_scores(spark):
    """A positive's scores are summed where they are, by steps of the exponent; the loss is that of the whole list."""
    rng = random.Random(8)
    rows = [("p", k, rng.uniform(-900, 900) * 10 ** rng.randint(-3, 0), rng.uniform(-900, 900) * 10 ** rng.randint(-3, 0)) for k in range(20) for _ in range(9)]
    rows = [(p, k, next(r[2] for r in rows if r[1] == k), n) for p, k, _, n in rows] + [("q", 1, 2.0, None), ("q", 2, 3.0, None), ("q", 2, 3.0, 3.0)]
    s = spark.createDataFrame(rows, "period string, pos int, s_pos double, s_neg double")
    got = linkpred.info_nce(s, 4)
    assert "collect_list(s_neg" not in got._jdf.queryExecution().optimizedPlan().toString()

    def loss(p, negatives):
        x = [y / 0.2 for y in (p, *negatives)]
        return max(x) + math.log(sum(math.exp(y - max(x)) for y in x)) - x[0]

    of = {}
    for p, k, y, n in rows:
        of.setdefault((p, k, y), []).extend([] if n is None else [n])
    for r in got.collect():
        each = [loss(y, n) for (p, _, y), n in of.items() if p == r.period]
        assert abs(r.info_nce - sum(each) / len(each)) < 1e-6
