"""Business days, week crossings, rent-start parsing, month labels."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicelens.functions.dates import business_days, month_label, rent_start, week_crossings

TS = T.StructType([T.StructField("s", T.TimestampNTZType()), T.StructField("e", T.TimestampNTZType())])


def d(text):
    return dt.datetime.fromisoformat(text)


# start, end, expected (rule: days - 2*weeks - [Sun start] - [Sat start] + [later time])
BUSINESS_DAY_CASES = [
    ("2024-11-02 09:00", "2024-11-04 08:00", -1),   # Saturday start, earlier time
    ("2024-11-02 09:00", "2024-11-04 10:00", 0),    # later time adds one
    ("2024-11-03 09:00", "2024-11-03 10:00", 0),    # Sunday start, same day
    ("2024-11-01 09:00", "2024-11-15 09:00", 10),   # two weeks
    ("2024-11-04 09:00", "2024-11-08 17:00", 5),    # Monday to Friday, later
    ("2024-11-04 09:00", "2024-11-09 08:00", 5),    # Saturday end is counted
    ("2024-11-04 09:00", "2024-11-10 08:00", 4),    # Sunday end crosses a week
]


def test_business_day_fixtures(spark):
    rows = [(d(s), d(e)) for s, e, _ in BUSINESS_DAY_CASES] + [(None, d("2024-11-04 09:00"))]
    df = spark.createDataFrame(rows, TS)
    got = [r[0] for r in df.select(business_days(F.col("s"), F.col("e"))).collect()]
    assert got == [x for _, _, x in BUSINESS_DAY_CASES] + [0]


def _brute_force(s, e):
    """The same rule with weeks counted by walking the calendar."""
    if s is None or e is None:
        return 0
    a, b = s.date(), e.date()
    step = 1 if b >= a else -1
    sundays = 0
    day = a
    while day != b:
        nxt = day + dt.timedelta(days=step)
        # a Saturday->Sunday boundary lies between day and nxt
        if (step == 1 and nxt.weekday() == 6) or (step == -1 and day.weekday() == 6):
            sundays += step
        day = nxt
    value = (b - a).days - 2 * sundays
    value -= 1 if s.weekday() == 6 else 0
    value -= 1 if s.weekday() == 5 else 0
    value += 1 if e.time() > s.time() else 0
    return value


def test_business_days_match_brute_force(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(600):
        s = base + dt.timedelta(minutes=rnd.randrange(0, 366 * 24 * 60))
        e = s + dt.timedelta(minutes=rnd.randrange(-20 * 24 * 60, 60 * 24 * 60))
        rows.append((s, e))
    df = spark.createDataFrame(rows, TS)
    got = [r[0] for r in df.select(business_days(F.col("s"), F.col("e"))).collect()]
    assert got == [_brute_force(s, e) for s, e in rows]


def test_week_crossings_ignore_time_of_day(spark):
    df = spark.createDataFrame([(d("2024-11-02 23:59"), d("2024-11-03 00:01")),
                                (d("2024-11-03 00:01"), d("2024-11-09 23:59")),
                                (d("2024-11-03 00:00"), d("2024-11-02 00:00"))], TS)
    got = [r[0] for r in df.select(week_crossings(F.col("s"), F.col("e"))).collect()]
    assert got == [1, 0, -1]


@pytest.mark.parametrize("text,expected", [
    ("01/15/2024 - 02/14/2024", dt.date(2024, 1, 15)),
    ("01/15/2024", dt.date(2024, 1, 15)),
    ("*", None),
    (None, None),
    ("01/15/2024-02/14/2024", None),   # no blank before the hyphen: a year digit is lost
    ("-01/15/2024", None),             # hyphen first: empty text
    ("13/45/2024", None),              # not a date
])
def test_rent_start(spark, text, expected):
    df = spark.createDataFrame([(text,)], "b string")
    assert df.select(rent_start(F.col("b"))).first()[0] == expected


def test_month_label_is_unpadded(spark):
    df = spark.createDataFrame([(d("2024-03-05 10:00"),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(month_label(F.col("t"))).collect()] == ["2024-3", "-"]
