"""Loading CSV records that may be damaged (problem 5).

Each row holds one record as received. Records whose quoting is broken would swallow their neighbours
in a stream, so they are told apart first, by one pattern over the record. All others of a batch go
through one pyarrow CSV read, whose callback hands over the rows with a wrong number of fields. Fields
are read as strings; whole columns are then cast, and the first failing cell names the reason.
"""

from __future__ import annotations

import ast
import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["date", "title", "url", "ticker", "output_triplets", "llm_judgments_evaluation", "revised_triplets"]
# What the revision field may hold besides a list.
STATUSES = ["Require Human Review", "Evaluation meets expectation", "Error: Missing 'Revised_Triplets' key", "JSON Error on Reprompt", "Error: Corrupt triplets string"]
FIELD = r'(?:"(?:[^"]|"")*+"|[^",\r\n]*+)'
SOUND = re.compile(rf"{FIELD}(?:,{FIELD})*+")
TRIPLETS = "array<struct<sub:string,sub_type:string,rel:string,rel_category:string,obj:string,obj_type:string>>"
SCHEMA = f"record_id long, reason string, date date, title string, url string, ticker string, output_triplets {TRIPLETS}, llm_judgments_evaluation string, revised_status string, revised_triplets {TRIPLETS}"
PARTS = ["sub", "sub_type", "rel", "rel_category", "obj", "obj_type"]
#: Characters that one CSV read takes at a time.
SLICE = 1 << 25
LIST = pa.list_(pa.struct([(p, pa.string()) for p in PARTS]))


def triplet_list(text: str | None) -> list[dict[str, str]] | None:
    """The list that ``text`` spells as a Python literal, if it is one of tuples of exactly six strings."""
    if text is None:
        return None
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if type(value) is not list or not all(type(t) is tuple and len(t) == 6 and all(type(x) is str for x in t) for t in value):
        return None
    try:
        return [dict(zip(PARTS, (x.encode("utf-8").decode("utf-8") for x in t))) for t in value]
    except UnicodeError:
        return None


def real_day(text: str) -> datetime.date | None:
    try:
        return datetime.date(int(text[:4]), int(text[5:7]), int(text[8:]))
    except ValueError:
        return None


def _read(records: list[str]) -> tuple[list[int], pa.Table | None]:
    """Positions of the records with a wrong number of fields, and the others as a table of strings."""
    wrong: list[int] = []

    def reject(row: csv.InvalidRow) -> str:
        wrong.append(row.number - 2)
        return "skip"

    # A first row of our own: a byte order mark at the start of a record must not count as that of the stream.
    data = "\n".join([",".join(COLUMNS), *records]).encode("utf-8", "replace") + b"\n"
    table = csv.read_csv(
        pa.BufferReader(data),
        read_options=csv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=COLUMNS),
        parse_options=csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in COLUMNS}, strings_can_be_null=False, quoted_strings_can_be_null=False, check_utf8=False),
    )
    return wrong, table.slice(1)


def load_batch(ids: list[int | None], raws: list[str | None]) -> pa.RecordBatch:
    n = len(ids)
    reason: list[str | None] = [None] * n
    sound: list[int] = []
    for k, raw in enumerate(raws):
        if not raw:
            reason[k] = "columns"  # no field, or the one empty field of an empty record
        elif SOUND.fullmatch(raw):
            sound.append(k)
        else:
            reason[k] = "quoting"
    cells: dict[str, list] = {c: [None] * n for c in COLUMNS}
    lists: list = [None] * n
    revised: list = [None] * n
    status: list = [None] * n
    dates: list = [None] * n
    if sound:
        wrong, table = _read([raws[k] for k in sound])
        for w in wrong:
            reason[sound[w]] = "columns"
        bad = set(wrong)
        kept = [k for j, k in enumerate(sound) if j not in bad]
        if kept:
            shaped = pc.match_substring_regex(table["date"], r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$").to_pylist()
            symbol = pc.match_substring_regex(table["ticker"], r"^[A-Z]{1,5}$").to_pylist()
            columns = {c: table[c].to_pylist() for c in COLUMNS}
            for j, k in enumerate(kept):
                for c in COLUMNS:
                    cells[c][k] = columns[c][j]
                dates[k] = real_day(columns["date"][j]) if shaped[j] and columns["date"][j][-1:] != "\n" else None
                lists[k] = triplet_list(columns["output_triplets"][j])
                word = columns["revised_triplets"][j]
                plain = word == "" or word in STATUSES
                revised[k] = None if plain else triplet_list(word)
                status[k] = word if plain and word else None
                if dates[k] is None or not symbol[j] or columns["ticker"][j][-1:] == "\n" or lists[k] is None or (not plain and revised[k] is None):
                    reason[k] = "value"
    good = [r is None for r in reason]
    only = lambda xs: [x if g else None for x, g in zip(xs, good)]
    return pa.record_batch(
        {
            "record_id": pa.array(ids, pa.int64()),
            "reason": pa.array(reason, pa.string()),
            "date": pa.array(only(dates), pa.date32()),
            "title": pa.array(only(cells["title"]), pa.string()),
            "url": pa.array(only(cells["url"]), pa.string()),
            "ticker": pa.array(only(cells["ticker"]), pa.string()),
            "output_triplets": pa.array(only(lists), LIST),
            "llm_judgments_evaluation": pa.array(only(cells["llm_judgments_evaluation"]), pa.string()),
            "revised_status": pa.array(only(status), pa.string()),
            "revised_triplets": pa.array(only(revised), LIST),
        }
    )


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raws, at, size = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 0
        for k, raw in enumerate(raws):
            size += len(raw or "")
            if size > SLICE or k == len(raws) - 1:
                yield load_batch(ids[at : k + 1], raws[at : k + 1])
                at, size = k + 1, 0


def load_records(lines: DataFrame, id_col: str = "record_id", raw_col: str = "raw") -> DataFrame:
    """Every record once: typed columns where it loads, otherwise nulls and ``reason``.

    'quoting', 'columns' and 'value' hold in this order. Null and empty records have no seven fields:
    'columns'. Repeated rows are loaded each. No shuffle.
    """
    return lines.select(F.col(id_col).cast("long").alias("record_id"), F.col(raw_col).cast("string").alias("raw")).mapInArrow(_load, SCHEMA)


def rejected(lines: DataFrame) -> DataFrame:
    return load_records(lines).filter("reason IS NOT NULL").select("record_id", "reason")


def loaded(lines: DataFrame) -> DataFrame:
    return load_records(lines).filter("reason IS NULL").drop("reason")
