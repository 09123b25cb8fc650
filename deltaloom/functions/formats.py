"""Formats of reports: durations, sizes, moments, file names. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(n: Column, by: int) -> Column:
    """Whole division, towards zero."""
    return F.call_function("div", n, F.lit(by))


def duration(micros: Column) -> Column:
    """Microseconds as seconds, milliseconds and microseconds: 1s 2ms 3us; null for null."""
    m = micros.cast("long")
    return F.when(m.isNotNull(), F.format_string("%ds %dms %dus", _div(m, 1_000_000), _div(m, 1000) % 1000, m % 1000))


def _hundredths(n: Column, unit: int) -> Column:
    """n units with two decimals as C prints them: the exact quotient, halves to the even digit (Java's format takes halves up).

    Halves are whole bytes, so that only these are counted out.
    """
    whole = n.cast("long")
    rest = whole % unit * 100
    down, over = _div(rest, unit), rest % unit * 2
    h = _div(whole, unit) * 100 + down + ((over > unit) | ((over == unit) & (down % 2 == 1))).cast("long")
    exact = F.format_string("%d.%02d", _div(h, 100), h % 100)
    return F.when(whole.cast("double") == n, exact).otherwise(F.format_string("%.2f", n / unit))


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves a whole part, with two decimals: 1.50 MB; null for null."""
    n = n.cast("double")
    return (
        F.when(n >= 1 << 30, F.concat(_hundredths(n, 1 << 30), F.lit(" GB")))
        .when(n >= 1 << 20, F.concat(_hundredths(n, 1 << 20), F.lit(" MB")))
        .when(n >= 1 << 10, F.concat(_hundredths(n, 1 << 10), F.lit(" KB")))
        .when(n.isNotNull(), F.format_string("%d B", n.cast("long")))
    )


def moment(ts: Column) -> Column:
    """A moment as it stands in names of result files: 2024-01-31_23:59:59."""
    return F.date_format(ts, "yyyy-MM-dd_HH:mm:ss")


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, "([^/]*)$", 1)


def result_name(path: Column, tag: Column) -> Column:
    """Name of a file of measurements: the input's name and a tag."""
    return F.concat(file_name(path), F.lit("_"), tag, F.lit(".csv"))
