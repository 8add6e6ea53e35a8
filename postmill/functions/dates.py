"""Posting dates: epoch, relative wording, ISO and calendar formats.

Everything becomes a ``YYYY-MM-DD`` string. "Now" is the ``as_of`` parameter, so
a run can be repeated. No time-zone dependent function is used: an ISO date is
kept as written and epochs are divided into days.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import blank_null, capture, first_where, let, strip

# Blank wordings, wordings for today, unit lengths in seconds.
NO_DATE = ("", "none", "null", "not specified", "n/a")
TODAY_WORDS = ("just now", "today", "few hours ago", "a few hours ago", "moments ago")
RELATIVE_PATTERN = (
    r"(\d+)\s*\+?\s*(s|sec|second|m|min|minute|h|hr|hour|d|day|w|wk|week|mo|month|y|yr|year)s?(?:\s*ago)?\b"
)
UNIT_SECONDS = {
    "s": 1, "sec": 1, "second": 1,
    "m": 60, "min": 60, "minute": 60,
    "h": 3600, "hr": 3600, "hour": 3600,
    "d": 86400, "day": 86400,
    "w": 604800, "wk": 604800, "week": 604800,
    "mo": 2592000, "month": 2592000,
    "y": 31536000, "yr": 31536000, "year": 31536000,
}
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
LAST_EPOCH_SECOND = 253402300799  # 9999-12-31T23:59:59Z

_HH, _MM = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
_ZONE = rf"(?:[zZ]|[+-]{_HH}(?::?{_MM}(?::?{_MM}(?:\.\d+)?)?)?)?"
_TIME = rf"(?:.{_HH}(?::{_MM}(?::{_MM}(?:[.,]\d+)?)?|{_MM}(?:{_MM}(?:[.,]\d+)?)?)?{_ZONE})?"


def _iso(day: Column) -> Column:
    return day.cast("string")


def _day_of_epoch(seconds: Column) -> Column:
    days = F.floor(seconds / F.lit(86400)).try_cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """Calendar day, null when it does not exist. ``try_cast`` throws nothing."""
    return F.concat_ws("-", y, m, d).try_cast("date")


def _epoch_day(raw: Column) -> Column:
    number = raw.try_cast("double")
    seconds = F.when(F.length(raw) >= 12, number / F.lit(1000)).otherwise(number)
    return F.when(seconds <= F.lit(float(LAST_EPOCH_SECOND)), _day_of_epoch(seconds))


def _relative_day(clean: Column, as_of: datetime) -> Column:
    now = F.lit(int(as_of.replace(tzinfo=as_of.tzinfo or timezone.utc).timestamp())).cast("bigint")
    units = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])

    def back(g: Column) -> Column:
        seconds = F.try_multiply(F.get(g, F.lit(0)).try_cast("bigint"), units[F.get(g, F.lit(1))].cast("bigint"))
        day = F.floor(F.try_subtract(now, seconds) / F.lit(86400)).try_cast("int")
        # Years outside 1..9999 have no calendar day.
        return F.when(day >= -719162, F.date_add(F.lit("1970-01-01").cast("date"), day))

    found = F.filter(F.array(capture(clean, RELATIVE_PATTERN, 2)), lambda g: F.size(g) > 0)
    # A relative wording that matches but overflows still ends the cascade: wrap it.
    return F.try_element_at(F.transform(found, lambda g: F.struct(back(g).alias("day"))), F.lit(1))


def _iso_day(raw: Column) -> Column:
    extended = F.when(raw.rlike(rf"(?s)^\d{{4}}-\d{{2}}-\d{{2}}{_TIME}$"), F.substring(raw, 1, 10).try_cast("date"))
    basic = F.when(
        raw.rlike(rf"(?s)^\d{{8}}{_TIME}$"),
        _ymd(F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)),
    )
    def week_day(g: Column) -> Column:
        jan4 = F.concat(F.get(g, F.lit(0)), F.lit("-01-04")).try_cast("date")
        week, day = F.get(g, F.lit(1)).try_cast("int"), F.coalesce(blank_null(F.get(g, F.lit(2))), F.lit("1")).try_cast("int")
        found = F.date_add(F.trunc(jan4, "week"), (week - 1) * 7 + day - 1)
        exists = (week >= 1) & (F.weekofyear(found) == week) & day.between(1, 7)
        return F.when(exists, found)

    week = F.when(
        raw.rlike(r"^\d{4}-?W"),
        let(capture(raw, rf"^(\d{{4}})-?W(\d{{2}})(?:-?(\d))?{_TIME}$", 3, "s"), week_day),
    )
    return F.coalesce(extended, basic, week)


def _calendar_day(raw: Column) -> Column:
    """Year-first, day-first, then month-first numbers; then month names."""
    text = F.lower(F.regexp_replace(raw, r"(?U)\s+", " "))
    year_first = let(
        capture(text, r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$", 4, "s"),
        lambda g: _ymd(F.get(g, F.lit(0)), F.get(g, F.lit(2)), F.get(g, F.lit(3))),
    )
    year_last = let(
        capture(text, r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$", 4, "s"),
        lambda g: F.coalesce(
            _ymd(F.get(g, F.lit(3)), F.get(g, F.lit(2)), F.get(g, F.lit(0))),
            _ymd(F.get(g, F.lit(3)), F.get(g, F.lit(0)), F.get(g, F.lit(2))),
        ),
    )
    numbers = {name: i for i, month in enumerate(MONTHS, 1) for name in (month, month[:3])}
    month_no = F.create_map(*[F.lit(x) for n, i in numbers.items() for x in (n, str(i))])
    named_day_first = let(
        capture(text, r"^(\d{1,2})([ -])([a-z]+)\2(\d{4})$", 4, "s"),
        lambda g: _ymd(F.get(g, F.lit(3)), F.try_element_at(month_no, F.get(g, F.lit(2))), F.get(g, F.lit(0))),
    )
    named_month_first = let(
        capture(text, r"^([a-z]+) (\d{1,2}),? (\d{4})$", 3, "s"),
        lambda g: _ymd(F.get(g, F.lit(2)), F.try_element_at(month_no, F.get(g, F.lit(0))), F.get(g, F.lit(1))),
    )
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}[-/]"), year_first),
        F.when(text.rlike(r"^\d{1,2}[-/]\d"), year_last),
        F.when(text.rlike(r"^\d{1,2}[ -][a-z]"), named_day_first),
        F.when(text.rlike(r"^[a-z]"), named_month_first),
    )


def parse_date(value: Column, as_of: datetime) -> Column:
    """``YYYY-MM-DD`` for any supported wording, else null."""
    raw = strip(value)
    clean = strip(F.regexp_replace(F.lower(raw), r"(?U)^(posted|active|updated)\s*[:\-]?\s*", ""))
    today = F.lit(as_of.date().isoformat()).cast("date")
    says_today = clean.rlike("^(" + "|".join(TODAY_WORDS) + ")")
    day = (
        F.when(F.lower(raw).isin(*NO_DATE), F.lit(None).cast("date"))
        .when(raw.rlike(r"^[0-9]+$"), _epoch_day(raw))
        .when(says_today, today)
        .when(clean.startswith("yesterday"), F.date_sub(today, 1))
        .otherwise(
            first_where(
                F.array(
                    F.coalesce(
                        _relative_day(clean, as_of),
                        F.struct(F.coalesce(_iso_day(raw), _calendar_day(raw)).alias("day")),
                    )
                ),
                lambda s: s.day.isNotNull(),
            ).day
        )
    )
    return _iso(day)


def format_date(value: Column, as_of: datetime) -> Column:
    """Parsed date, else the text as it came; missing text gives ``""``."""
    return F.coalesce(parse_date(value, as_of), value, F.lit(""))
