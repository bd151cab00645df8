"""Timestamps in any notation to one UTC instant (problem 6).

All notations are branches of one pattern with named groups, compiled once and matched once per value.
The parts are checked against the calendar as vectors, days are counted by integer arithmetic on the
proleptic Gregorian calendar, and the wall time becomes an instant by an explicit offset or by the zone
rules of the feed. The JVM's zone rules have the wanted reading of odd wall times built in: one that
occurs twice means the first, one that is skipped is read with the offset before the change.
"""

from __future__ import annotations

import re
import unicodedata
from zoneinfo import available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names of the feeds' languages, and zone abbreviations by zone, in minutes.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "mär": 3, "okt": 10, "dez": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "janv": 1, "févr": 2, "avr": 4, "juil": 7, "déc": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}
ABBREVIATIONS = {
    "America/New_York": {"EST": -300, "EDT": -240}, "America/Chicago": {"CST": -360, "CDT": -300}, "America/Denver": {"MST": -420, "MDT": -360}, "America/Los_Angeles": {"PST": -480, "PDT": -420},
    "Europe/London": {"GMT": 0, "BST": 60}, "Europe/Berlin": {"CET": 60, "CEST": 120}, "Europe/Paris": {"CET": 60, "CEST": 120}, "Europe/Madrid": {"CET": 60, "CEST": 120},
    "Asia/Taipei": {"CST": 480}, "Asia/Shanghai": {"CST": 480}, "Asia/Tokyo": {"JST": 540}, "Asia/Seoul": {"KST": 540}, "Asia/Kolkata": {"IST": 330},
}
ANYWHERE = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0}

_WORD = "|".join(sorted(MONTHS, key=len, reverse=True))
_WEEKDAY = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"
_CLOCK = r"(?P<h>\d{1,2})(?:[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d{1,12}))?)?|\s*h\s*(?P<mi_h>\d{2})|(?=\s*[ap]\.?m))"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2})|\s*(?P<abbr>Z|[A-Z]{2,5})|\s+(?P<iana>[A-Za-z]+(?:/[A-Za-z_+-]+){1,2}))?"
_TIME = rf"(?:(?:T|\s*,?\s+(?:à\s+|um\s+|a\s+las\s+|at\s+)?){_CLOCK}(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?(?:\s+Uhr)?{_ZONE})?"
_DATES = [
    r"(?P<y1>\d{4})(?P<sep1>[-/.])(?P<m1>\d{1,2})(?P=sep1)(?P<d1>\d{1,2})",
    r"(?P<y2>\d{4})(?P<m2>\d{2})(?P<d2>\d{2})",
    r"(?P<n1>\d{1,2})(?P<sep3>[-/.])(?P<n2>\d{1,2})(?P=sep3)(?P<n3>\d{4}|\d{2})",
    rf"(?P<mon4>{_WORD})\.?\s+(?P<d4>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y4>\d{{4}})",
    rf"(?P<d5>\d{{1,2}})(?:\.|er|º|st|nd|rd|th)?[\s-]+(?:de\s+)?(?P<mon5>{_WORD})\.?,?[\s-]+(?:de\s+)?(?P<y5>\d{{4}})",
]
_COMPACT = r"(?P<y6>\d{4})(?P<m6>\d{2})(?P<d6>\d{2})T?(?P<h6>\d{2})(?P<mi6>\d{2})(?P<s6>\d{2})(?P<f6>[.,]\d{1,12})?(?P<z6>Z|[+-]\d{2}:?\d{2})?"
PATTERN = re.compile(rf"\s*(?:(?P<epoch>\d{{13}}|\d{{10}})|{_COMPACT}|{_WEEKDAY}(?:{'|'.join(_DATES)}){_TIME})\s*", re.ASCII | re.IGNORECASE)

PARTS = T.StructType([T.StructField("wall", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("zone", T.StringType())])
DAY = 86_400_000_000
ZONES = available_timezones()


def days_from_civil(y, m, d):
    """Days from 1970-01-01 of a date, by integer arithmetic over 400-year eras that begin in March."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def month_length(y, m):
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return np.where(m == 2, 28 + leap, 30 + ((m + (m > 7)) % 2))


def _minutes(off: str) -> int | None:
    digits = off[1:].replace(":", "")
    h, m = int(digits[:2]), int(digits[2:] or 0)
    if h > 18 or m > 59:
        return None
    return (h * 60 + m) * (-1 if off[0] == "-" else 1)


def _fields(text: str, home: str | None, order: str | None):
    """(year, month, day, hour, minute, second, micros, offset, zone) of one value, or None; ``micros`` alone for epochs."""
    m = PATTERN.fullmatch(text if text.isascii() else unicodedata.normalize("NFC", text))
    if m is None:
        return None
    home = home if home in ZONES else None
    g = m.groupdict()
    if g["epoch"]:
        return (1970, 1, 1, 0, 0, 0, int(g["epoch"]) * (1_000_000 if len(g["epoch"]) == 10 else 1000), 0, None)
    if g["y6"]:
        micros = int((g["f6"] or ".0")[1:7].ljust(6, "0"))
        off = 0 if (g["z6"] or "").upper() == "Z" else _minutes(g["z6"]) if g["z6"] else None
        if g["z6"] and off is None:
            return None
        return (int(g["y6"]), int(g["m6"]), int(g["d6"]), int(g["h6"]), int(g["mi6"]), int(g["s6"]), micros, off, None if g["z6"] else home)
    if g["y1"]:
        y, mo, d = int(g["y1"]), int(g["m1"]), int(g["d1"])
    elif g["y2"]:
        y, mo, d = int(g["y2"]), int(g["m2"]), int(g["d2"])
    elif g["n1"]:
        a, b, c = int(g["n1"]), int(g["n2"]), int(g["n3"])
        if order == "ymd" and len(g["n3"]) == 2:
            y, mo, d = 2000 + a, b, c
        elif order in ("mdy", "dmy"):
            mo, d = (a, b) if order == "mdy" else (b, a)
            y = c if len(g["n3"]) == 4 else 2000 + c
        else:
            return None
    elif g["mon4"]:
        y, mo, d = int(g["y4"]), MONTHS[g["mon4"].lower()], int(g["d4"])
    else:
        y, mo, d = int(g["y5"]), MONTHS[g["mon5"].lower()], int(g["d5"])
    h, mi, s = int(g["h"] or 0), int(g["mi"] or g["mi_h"] or 0), int(g["s"] or 0)
    if g["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"] in "pP" else 0)
    micros = int((g["f"] or "0")[:6].ljust(6, "0"))
    off, zone = None, home
    if g["off"]:
        off, zone = _minutes(g["off"]), None
        if off is None:
            return None
    elif g["abbr"]:
        name = g["abbr"].upper()
        off = ABBREVIATIONS.get(home or "", {}).get(name, ANYWHERE.get(name))
        zone = None
        if off is None:
            return None
    elif g["iana"]:
        zone = g["iana"]
        if zone not in ZONES:
            return None
    return (y, mo, d, h, mi, s, micros, off, zone)


@F.arrow_udf(PARTS)
def _parts(texts: pa.Array, homes: pa.Array, orders: pa.Array) -> pa.Array:
    known: dict[tuple, tuple | None] = {}
    rows = []
    for key in zip(texts.to_pylist(), homes.to_pylist(), orders.to_pylist()):
        if key not in known:
            known[key] = _fields(*key) if key[0] else None
        rows.append(known[key])
    n = len(rows)
    v = np.array([r[:7] if r else (1970, 13, 1, 0, 0, 0, 0) for r in rows], np.int64).reshape(n, 7)
    y, mo, d, h, mi, s, us = v.T
    real = (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (h < 24) & (mi < 60) & (s < 60)
    real &= d <= month_length(y, np.where(real, mo, 1))
    wall = days_from_civil(y, np.where(real, mo, 1), d) * DAY + (h * 3600 + mi * 60 + s) * 1_000_000 + us
    offset = pa.array([r[7] if r else None for r in rows], pa.int32())
    zone = pa.array([r[8] if r else None for r in rows], pa.string())
    return pa.StructArray.from_arrays([pa.array(wall, pa.int64(), mask=~real), offset, zone], ["wall", "offset", "zone"])


def parse_instant(text: Column, home_zone: Column, day_order: Column) -> Column:
    """Microseconds since 1970-01-01 UTC, or null where ``text`` names no real moment.

    Null, blank and unreadable values, days and times that do not exist, zone names that are unknown, and
    wall times without a zone of any kind give null. Digits below microseconds are dropped.
    """
    p = _parts(text, home_zone, day_order)
    return F.when(p["offset"].isNotNull(), p["wall"] - p["offset"].cast("long") * 60_000_000).when(
        p["zone"].isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(p["wall"]), p["zone"]))
    )


def normalised_dates(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """article_id and utc_micros of every row; null where the date is unreadable.

    A row whose feed is null or unlisted has no home zone: only dates that carry their own zone are
    readable. A feed listed twice counts once, by its smallest row.
    """
    one = feeds.filter("feed IS NOT NULL").groupBy("feed").agg(F.min(F.struct("home_zone", "day_order")).alias("f")).select("feed", "f.home_zone", "f.day_order")
    rows = articles.select("article_id", "date", "feed").join(one, "feed", "left")
    return rows.select("article_id", parse_instant(F.col("date"), F.col("home_zone"), F.col("day_order")).alias("utc_micros"))
