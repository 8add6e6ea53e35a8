"""Salary text and salary bounds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import blank_null, capture, first_nonblank, let, strip

NOT_SPECIFIED = "Not specified"

# Texts that state no amount, the amount grammar, unit factors.
NO_AMOUNT = ("", "not specified", "n/a", "negotiable", "competitive")
_UNIT = r"(lpa|lakh|lac|k|cr|crore)?"
_AMOUNT = r"([\d,]+(?:\.\d+)?)"
SALARY_PATTERN = (
    r"[₹$€£]?\s*" + _AMOUNT + r"\s*" + _UNIT
    + r"(?:\s*[-–to]+\s*[₹$€£]?\s*" + _AMOUNT + r"\s*" + _UNIT + r")?"
    + r"(?:\s*(lpa|lakh|lac|k|cr|crore|\+|pa|per\s+annum|annually))?"
)
UNIT_FACTORS = {
    "lpa": 100_000.0,
    "lakh": 100_000.0,
    "lac": 100_000.0,
    "cr": 10_000_000.0,
    "crore": 10_000_000.0,
    "k": 1_000.0,
}
BOUNDS_TYPE = "struct<lo:bigint,hi:bigint>"


def _factor(unit: Column) -> Column:
    entries = [F.lit(x) for pair in UNIT_FACTORS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), unit), F.lit(1.0))


def salary_bounds(raw: Column) -> Column:
    """``struct(lo, hi)`` read from any salary text; null when it states none.

    The first amount anywhere in the text counts. A missing upper amount repeats
    the lower one, and a unit-less number below 100 is read as lakhs.
    """
    def bounds(g: Column) -> Column:
        lo, unit1, hi, unit2, unit_end = (F.get(g, F.lit(i)) for i in range(5))
        has_hi = hi != ""
        low = lo.try_cast("double")
        high = F.when(has_hi, hi.try_cast("double")).otherwise(low)
        unit_lo = F.coalesce(first_nonblank(unit1, unit2, unit_end), F.lit(""))
        unit_hi = F.coalesce(first_nonblank(unit2, unit_end, unit1), F.lit(""))
        lakhs = F.lit(100_000.0)
        factor_lo = F.when((unit_lo == "") & (low < 100), lakhs).otherwise(_factor(unit_lo))
        factor_hi = (
            F.when((unit_hi == "") & (high < 100), lakhs)
            .when(has_hi, _factor(unit_hi))
            .otherwise(_factor(unit_lo))
        )
        return F.struct(
            (low * factor_lo).try_cast("bigint").alias("lo"),
            (high * factor_hi).try_cast("bigint").alias("hi"),
        )

    def of_text(text: Column) -> Column:
        amounts = F.when(~text.isin(*NO_AMOUNT), F.regexp_replace(text, ",", ""))
        groups = F.filter(F.array(capture(amounts, SALARY_PATTERN, 5)), lambda g: F.size(g) > 0)
        return F.try_element_at(F.transform(groups, bounds), F.lit(1))

    return let(F.lower(strip(raw)), of_text)


def salary_sync(salary: Column, salary_raw: Column) -> tuple[Column, Column]:
    """Each text fills the other where it is missing."""
    return first_nonblank(salary, salary_raw), first_nonblank(salary_raw, salary)


def salary_coerce(value: Column) -> Column:
    """Whole positive amount or null; fractions are cut off."""
    amount = value.cast("string").try_cast("double").try_cast("bigint")
    return F.when(amount > 0, amount)


def salary_ordered(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Swap inverted bounds; a lone bound stays where it is."""
    inverted = lo > hi
    return F.when(inverted, hi).otherwise(lo), F.when(inverted, lo).otherwise(hi)


def salary_settled(lo: Column, hi: Column, text: Column) -> Column:
    """Coerced bounds as a struct: swapped, or parsed from text when both are null."""
    lo, hi = salary_coerce(lo), salary_coerce(hi)
    swapped_lo, swapped_hi = salary_ordered(lo, hi)
    given = F.struct(swapped_lo.alias("lo"), swapped_hi.alias("hi"))
    return F.when(lo.isNull() & hi.isNull(), salary_bounds(text)).otherwise(given)


def salary_refilled(lo: Column, hi: Column, salary_raw: Column) -> Column:
    """Fill whichever bound is missing from the raw text."""
    def fill(parsed: Column) -> Column:
        return F.struct(
            F.coalesce(F.nullif(lo, F.lit(0)), parsed.lo).alias("lo"),
            F.coalesce(F.nullif(hi, F.lit(0)), parsed.hi).alias("hi"),
        )

    missing = lo.isNull() | hi.isNull()
    given = F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    return F.when(missing & blank_null(salary_raw).isNotNull(),
                  let(salary_bounds(salary_raw), fill)).otherwise(given)


def format_salary_usd(lo: Column, hi: Column) -> Column:
    lo, hi = F.coalesce(lo, F.lit(0)), F.coalesce(hi, F.lit(0))
    low, high = F.format_number(lo, 0), F.format_number(hi, 0)
    return (
        F.when((lo > 0) & (hi > 0), F.concat(F.lit("$"), low, F.lit(" - $"), high))
        .when(lo > 0, F.concat(F.lit("$"), low, F.lit("+")))
        .when(hi > 0, F.concat(F.lit("Up to $"), high))
        .otherwise(NOT_SPECIFIED)
    )


def clean_salary_inr(value: Column) -> Column:
    """Drop one leading label or rupee mark and one trailing period wording."""
    text = F.regexp_replace(strip(value), r"(?iU)^(salary|₹|rs\.?\s*)", "")
    text = strip(F.regexp_replace(text, r"(?iU)\s*(per annum|p\.a\.|annually)$", ""))
    return F.when(blank_null(value).isNull(), F.lit(NOT_SPECIFIED)).otherwise(text)


def badge_salary(card_text: Column) -> Column:
    """Currency amount or range shown on a card, else the sentinel."""
    found = F.regexp_substr(card_text, F.lit(r"(?U)[₹$€£][\d,]+(?:\s*[-–to]+\s*[₹$€£]?[\d,]+)?"))
    return F.coalesce(found, F.lit(NOT_SPECIFIED))
