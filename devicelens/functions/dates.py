"""Date and time column builders (all native Catalyst expressions)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text date accepted by the rent-start parser: month/day/four-digit year.
_US_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"


def week_start_sunday(d: Column) -> Column:
    """The Sunday on or before date ``d`` (Spark's dayofweek: Sunday = 1)."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_crossings(start: Column, end: Column) -> Column:
    """Number of Saturday->Sunday week boundaries between two dates/timestamps.

    This is the "week" date difference of engines whose weeks start on
    Sunday, independent of the time of day.
    """
    s, e = F.to_date(start), F.to_date(end)
    return F.floor(F.datediff(week_start_sunday(e), week_start_sunday(s)) / F.lit(7)).cast("int")


def day_micros(ts: Column) -> Column:
    """Microseconds since midnight of a timestamp (time of day, comparable)."""
    return F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", ts), ts)


def business_days(start: Column, end: Column) -> Column:
    """Business-day duration between two timestamps.

    calendar days - 2 * weeks crossed - [start on Sunday] - [start on Saturday]
    + [end later in its day than start], and 0 when either side is NULL.
    The value can be negative or count a Saturday end; those are the rule's
    own results and are kept.
    """
    s, e = F.to_date(start), F.to_date(end)
    dow = F.dayofweek(start)
    value = (F.datediff(e, s)
             - week_crossings(start, end) * F.lit(2)
             - F.when(dow == F.lit(1), F.lit(1)).otherwise(F.lit(0))
             - F.when(dow == F.lit(7), F.lit(1)).otherwise(F.lit(0))
             + F.when(day_micros(end) > day_micros(start), F.lit(1)).otherwise(F.lit(0)))
    return F.coalesce(value, F.lit(0))


def rent_start(bill: Column) -> Column:
    """Parsed rent-start date of a billing-period text.

    ``*`` -> NULL; no hyphen -> whole text; otherwise the text before the
    hyphen minus one more character (the blank before it). A period written
    without that blank loses the last digit of its year and so does not
    parse: such text, and any other non-date, gives NULL.
    """
    pos = F.instr(bill, "-")
    text = (F.when(bill == F.lit("*"), F.lit(None).cast("string"))
            .when(pos == F.lit(0), bill)
            .when(pos >= F.lit(2), F.left(bill, pos - F.lit(2)))
            .otherwise(F.lit("")))
    return F.when(text.rlike(_US_DATE), F.try_to_date(text, "M/d/yyyy"))


def month_label(ts: Column) -> Column:
    """``<year>-<month>`` with an unpadded month, e.g. ``2024-3``; a NULL part
    is written as empty text."""
    return F.concat(F.coalesce(F.year(ts).cast("string"), F.lit("")), F.lit("-"),
                    F.coalesce(F.month(ts).cast("string"), F.lit("")))


def month_name(ts: Column) -> Column:
    return F.date_format(ts, "MMMM")


def month_range(year: int, month: int) -> tuple[dt.datetime, dt.datetime]:
    """Half-open [first instant, first instant of next month) of a month."""
    start = dt.datetime(year, month, 1)
    end = dt.datetime(year + (month == 12), month % 12 + 1, 1)
    return start, end


def ts_lit(value) -> Column:
    """Typed TIMESTAMP_NTZ literal, built from ISO text so that neither the
    Python nor the session time zone can shift it."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value) -> Column:
    if not isinstance(value, str):
        value = value.isoformat()[:10]
    return F.lit(value).cast("date")
