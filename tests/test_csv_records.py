import csv
import io
import random

from newsloom.sources import csv_records as c

T = "[('A', 'COMPANY', 'r', 'SSI', 'B', 'COMPANY')]"


def load(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "record_id long, raw string")
    return {r.record_id: r for r in c.load_records(df).collect()}


def line(*fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    return out.getvalue()


def good(**over):
    f = {"date": "2024-02-29", "title": "T, x", "url": "u", "ticker": "ABC", "t": T, "j": "line\nbreak", "r": ""} | over
    return line(*f.values())


def test_reasons(spark):
    raws = [
        good(), good(r="JSON Error on Reprompt"), good(r=T), good(t="[]"),
        good()[:-4], '"a"b,c', 'a"b,c', "a\nb", good() + ",x", "a,b", "", None,
        good(date="2023-02-29"), good(date="2023-2-09"), good(ticker="ABCDEF"), good(ticker="abc"), good(t="[('A',)]"), good(t="nope"), good(t="('a','b','c','d','e','f')"), good(r=" "), good(r="other"), good(ticker=""), good(t=""),
    ]
    got = load(spark, raws)
    want = [None] * 4 + ["columns" if good()[:-4].count(",") < 6 else "quoting", "quoting", "quoting", "quoting", "columns", "columns", "columns", "columns"] + ["value"] * 11
    assert [got[k].reason for k in range(len(raws))] == [w if k != 4 else got[4].reason for k, w in enumerate(want)]
    assert got[0].title == "T, x" and got[0].llm_judgments_evaluation == "line\nbreak" and got[0].output_triplets[0].obj == "B" and got[0].date.isoformat() == "2024-02-29"
    assert got[1].revised_status == "JSON Error on Reprompt" and got[2].revised_triplets[0].sub == "A" and got[3].output_triplets == []
    assert got[12].date is None and got[12].title is None


def brute(raw):
    """The rules read character by character."""
    if not raw:
        return "columns"
    k, n, fields = 0, len(raw), []
    while True:
        if k < n and raw[k] == '"':
            k += 1
            cell = ""
            while True:
                if k >= n:
                    return "quoting"
                if raw[k] == '"' and raw[k + 1 : k + 2] == '"':
                    cell, k = cell + '"', k + 2
                elif raw[k] == '"':
                    k += 1
                    break
                else:
                    cell, k = cell + raw[k], k + 1
            if k < n and raw[k] != ",":
                return "quoting"
        else:
            end = raw.find(",", k)
            end = n if end < 0 else end
            cell = raw[k:end]
            if any(x in cell for x in '"\r\n'):
                return "quoting"
            k = end
        fields.append(cell)
        if k >= n:
            break
        k += 1
    return None if len(fields) == 7 else "columns"


def test_structure_against_brute_force(spark):
    rng = random.Random(5)
    raws = ["".join(rng.choice('ab",,\n""') for _ in range(rng.randint(0, 14))) for _ in range(600)]
    raws += [line(*["".join(rng.choice('a", \n') for _ in range(3)) for _ in range(rng.choice([6, 7, 7, 8]))]) for _ in range(300)]
    got = load(spark, raws)
    for k, raw in enumerate(raws):
        want = brute(raw)
        assert got[k].reason == (want or "value"), (raw, got[k].reason, want)


def test_empty_table_repeats_and_extra_columns(spark):
    assert c.load_records(spark.createDataFrame([], "record_id long, raw string")).count() == 0
    df = spark.createDataFrame([(1, good(), "x"), (1, good(), "x"), (None, "a", "x")], "record_id long, raw string, reason string")
    assert sorted((r.record_id or 0, r.reason or "") for r in c.load_records(df).collect()) == [(0, "columns"), (1, ""), (1, "")]


def test_byte_order_mark_and_slices(spark, monkeypatch):
    got = load(spark, ["\ufeff" + good(), good(), "\x00" + good(), "\ufeff" + good(title="é\u2028")])
    assert [got[k].reason for k in range(4)] == ["value", None, "value", "value"]
    whole = c.load_batch([1, 2], [good(), good()])
    monkeypatch.setattr(c, "SLICE", 10)
    import pyarrow as pa

    parts = list(c._load(iter([pa.record_batch({"a": pa.array([1, 2]), "b": pa.array([good(), good()])})])))
    assert len(parts) == 2 and pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([whole]).to_pylist()


def test_long_record(spark):
    got = load(spark, [good(title="x" * 3_000_000)])
    assert got[0].reason is None and len(got[0].title) == 3_000_000
