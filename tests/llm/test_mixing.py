import os

import pytest

from newsloom.llm import mixing
from newsloom.llm.bpe_automaton import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")


def docs(spark):
    rows = [(k, "a b c d e f g h " * (1 + k % 5), "big") for k in range(600)] + [(1000 + k, "x y z " * (1 + k % 3), "small") for k in range(40)] + [(2000, None, "big"), (2001, "", "big"), (2002, "q", None), (2003, "q", "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def targets(spark):
    return spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 6), ("gone", 0.1, 3), (None, 0.1, 1), ("other", None, 1)], "source string, target_share double, max_repeats int")


def test_shares_caps_and_budget(spark):
    mixed, sources = mixing.mix(docs(spark), targets(spark))
    rows = mixed.collect()
    report = {r.source: r for r in mixing.report(mixed, sources).collect()}
    total = sum(r.size for r in rows)
    assert set(report) == {"big", "small", "gone"}
    for s, weight in (("big", 0.7 / 0.9), ("small", 0.2 / 0.9)):
        assert abs(report[s].actual_share - weight) < 0.01 and abs(sum(r.size for r in rows if r.source == s) / total - weight) < 0.01
    assert report["gone"].tokens == 0 and report["gone"].actual_share == 0 and report["gone"].reachable_share is None
    uses = {}
    for r in rows:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(n for i, n in uses.items() if i < 1000) == 1 and max(uses.values()) <= 6
    assert sorted(r.position for r in rows) == list(range(1, len(rows) + 1))
    assert not {2000, 2001, 2002, 2003} & set(uses)


def test_a_prefix_keeps_the_shares_and_runs_repeat(spark):
    once = sorted(tuple(r) for r in mixing.mix(docs(spark), targets(spark), budget=3000)[0].collect())
    again = sorted(tuple(r) for r in mixing.mix(docs(spark), targets(spark), budget=3000)[0].collect())
    assert once == again
    total = sum(r[4] for r in once)
    assert 2900 < total <= 3000 and abs(sum(r[4] for r in once if r[2] == "big") / total - 0.7 / 0.9) < 0.04


def test_order_is_by_virtual_finish_time(spark):
    packets, _ = mixing.finish_times(docs(spark), targets(spark))
    by = {}
    for r in packets.orderBy("source", "pass", "finish").collect():
        by.setdefault(r.source, []).append(r)
    for s, rows in by.items():
        w = {"big": 0.7 / 0.9, "small": 0.2 / 0.9}[s]
        sent = 0
        for r in rows:
            sent += r.size
            assert abs(r.finish - sent / w) < 1e-6


def test_nothing_to_mix(spark):
    d, t = docs(spark), targets(spark)
    assert mixing.mix(d.limit(0), t)[0].count() == 0
    assert mixing.report(*mixing.mix(d, t.limit(0))).count() == 0
