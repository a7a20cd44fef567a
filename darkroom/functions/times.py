"""Times and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(t: Column) -> Column:
    """Microseconds of a time with or without a zone; differences of these are what counts."""
    return F.unix_micros(t.cast("timestamp"))


def lenient(text: Column) -> Column:
    """A timestamp from ISO text, or from year:month:day, year/month/day and year-month-day hour:minute:second; null otherwise."""
    formats = ("yyyy:MM:dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def delta_ms(a: Column, b: Column) -> Column:
    """Whole milliseconds between two times; null if either is missing."""
    return F.floor(F.abs(micros(b) - micros(a)) / 1000)


def range_label(low: Column, high: Column) -> Column:
    """Of the first and last time: a day, days of a month, months of a year, or years."""
    y, m, d = F.year, F.month, F.dayofmonth
    same_year = y(low) == y(high)
    same_month = same_year & (m(low) == m(high))
    return (
        F.when(low.isNull(), "未知时间")
        .when(same_month & (d(low) == d(high)), F.concat(y(low), F.lit("年"), m(low), F.lit("月"), d(low), F.lit("日")))
        .when(same_month, F.concat(y(low), F.lit("年"), m(low), F.lit("月"), d(low), F.lit("-"), d(high), F.lit("日")))
        .when(same_year, F.concat(y(low), F.lit("年"), m(low), F.lit("-"), m(high), F.lit("月")))
        .otherwise(F.concat(y(low), F.lit("-"), y(high)))
    )


def constraint(taken: Column, years: Column, start: Column, end: Column) -> Column:
    """review without a date that is asked for, exclude outside the years or dates, match inside, none where nothing is asked."""
    asked = (F.coalesce(F.size(years), F.lit(0)) > 0) | start.isNotNull() | end.isNotNull()
    date = taken.cast("date")
    return (
        F.when(asked & date.isNull(), "review")
        .when(~asked | date.isNull(), "none")
        .when((F.size(years) > 0) & ~F.array_contains(years, F.year(date)), "exclude_year")
        .when(F.coalesce(date < start, F.lit(False)) | F.coalesce(date > end, F.lit(False)), "exclude_dates")
        .otherwise("match")
    )
