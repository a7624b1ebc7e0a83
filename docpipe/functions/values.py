"""Dates, times and numbers as documents show them: Column expressions and Python twins."""

from __future__ import annotations

import datetime
import math
import re
from decimal import Decimal

from pyspark.sql import Column, functions as F


def time_of_day(fraction: Column) -> Column:
    """HH:MM:SS of a fraction of a day; what rounds up to a whole day shows as 24:00:00."""
    s = F.round(fraction * 86400).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def duration(days: Column) -> Column:
    s = F.round(days * 86400).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def serial_date(serial: Column) -> Column:
    """A spreadsheet's day number as date, date and time, or time alone (day 0). Days before
    the 1900 calendar's invented 29 February count from a day later."""
    day = F.floor(serial).cast("int")
    rest = serial - F.floor(serial)
    start = F.when(day < 60, F.lit(datetime.date(1899, 12, 31))).otherwise(F.lit(datetime.date(1899, 12, 30)))
    date = F.date_format(F.date_add(start, day), "yyyy-MM-dd")
    with_time = F.concat_ws(" ", date, time_of_day(rest))
    return F.when(day == 0, time_of_day(rest)).when(F.abs(rest) < 1e-9, date).otherwise(with_time)


def number_text(value: Column) -> Column:
    """Whole numbers below 1e15 without a point, others as their shortest decimal."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def pdf_date(value: Column) -> Column:
    digits = F.regexp_extract(value, r"^(?:D:)*(\d{8})", 1)
    date = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(digits != "", date)


def half_points(size: Column) -> Column:
    """Rounded to half a point, halves away from zero."""
    return F.round(size * 2) / 2


def heading_level(size: Column, body: Column, n_lines: Column, text: Column) -> Column:
    """1 to 3 by how much larger than the body text, null for body text."""
    ratio = size / body
    level = F.when(ratio >= 1.7, 1).when(ratio >= 1.35, 2).when(ratio >= 1.15, 3)
    return F.when((body > 0) & (n_lines <= 2) & (F.length(text) <= 120), level)


# ------------------------------------------------------------------ Python --

def py_round(x: float) -> int:
    """Halves away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def _clock(seconds: int, hours: str) -> str:
    return f"{seconds // 3600:{hours}}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"


def py_duration(days: float) -> str:
    return _clock(py_round(days * 86400), "d")


def py_serial_date(serial: float, date1904: bool = False) -> str:
    days, rest = int(serial), serial - int(serial)
    clock = _clock(py_round(rest * 86400), "02d")
    if days == 0 and not date1904:
        return clock
    first = datetime.date(1904, 1, 1) if date1904 else datetime.date(1899, 12, 31 if days < 60 else 30)
    try:
        date = (first + datetime.timedelta(days)).isoformat()
    except OverflowError:
        return py_number(serial)
    return date if abs(rest) < 1e-9 else f"{date} {clock}"


def py_number(value: float) -> str:
    if value == int(value) and abs(value) < 1e15 if math.isfinite(value) else False:
        return str(int(value))
    if not math.isfinite(value):
        return {True: "NaN"}.get(value != value, "inf" if value > 0 else "-inf")
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def py_pdf_date(value: str) -> str | None:
    m = re.match(r"(?:D:)*(\d{4})(\d{2})(\d{2})", value, re.A)
    return f"{m[1]}-{m[2]}-{m[3]}" if m else None
