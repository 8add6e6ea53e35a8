"""Years of experience and seniority from free text.

Each cascade is a ``coalesce`` of single-regex captures, so Spark stops at the
first rule that answers. A cheap ``contains`` gate skips the regexes for texts
that cannot match any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.salary import salary_bounds
from postmill.functions.text import SEP, blank_null, capture_max, first_where, strip

# The wordings that state years, entry level and seniority.
_YEARS = r"(?:yrs?|years?)"
_DASH = r"\s*(?:-|–|to)\s*"
_AT_LEAST = r"\b(?:min(?:imum)?(?:\s+of)?|at\s+least)\s*"
_EXP_LABEL = r"(?:experience|exp)\s*(?:required|needed)?\s*[:\-]?\s*(?:of\s+)?"
_DEEP_LABEL = r"(?:experience|exp)\.?\s*(?:required|needed|preferred|:)?\s*[:\-]?\s*"

BADGE_RULES = {
    "range": (rf"(\d+){_DASH}(\d+)", 2),
    "plus": (r"(\d+)\s*\+", 1),
    "at_least": (rf"{_AT_LEAST}(\d+)", 1),
    "years": (rf"(\d+)\s*{_YEARS}", 1),
    "number": (r"\b(\d+)\b", 1),
}
BADGE_ENTRY = r"\b(freshers?|entry[\s\-]level|intern(?:ship)?|trainee|no\s+(?:prior\s+)?exp(?:erience)?)\b"

TEXT_ENTRY = r"\b(freshers?(?:\s+can\s+apply)?|entry[\s\-]level|no\s+(?:prior\s+)?experience\s+required)\b"
# Rules as (pattern, groups, parts of which the text must hold one).
TEXT_RULES = (
    (rf"(\d+){_DASH}(\d+)\s*{_YEARS}", 2, ("-", "–", "to")),
    (rf"(\d+)\s*\+\s*{_YEARS}", 1, ("+",)),
    (rf"{_AT_LEAST}(\d+)\s*(?:\+)?\s*{_YEARS}\b", 1, ("min", "least")),
    (rf"{_EXP_LABEL}(\d+){_DASH}(\d+)\s*{_YEARS}", 2, ("exp",)),
    (rf"{_EXP_LABEL}(\d+)\s*(?:\+)?\s*{_YEARS}", 1, ("exp",)),
    (rf"(\d+)\s*{_YEARS}\s+(?:of\s+)?experience", 1, ("experience",)),
)

DEEP_RULES = (
    (rf"(\d+){_DASH}(\d+)\s*(?:\+\s*)?{_YEARS}(?:\s+of)?\s*(?:experience|exp)?", 2, ("-", "–", "to")),
    (rf"(\d+)\s*\+\s*{_YEARS}(?:\s+of)?\s*(?:experience|exp)?", 1, ("+",)),
    (rf"\b(?:min(?:imum)?\.?(?:\s+of)?|at\s+least)\s*(\d+)\s*(?:\+)?\s*{_YEARS}\b", 1, ("min", "least")),
    (rf"{_DEEP_LABEL}(\d+){_DASH}(\d+)\s*{_YEARS}", 2, ("exp",)),
    (rf"{_DEEP_LABEL}(\d+)\s*(?:\+)?\s*{_YEARS}", 1, ("exp",)),
    (rf"(\d+)\s*{_YEARS}\s+(?:of\s+)?(?:experience|exp)\b", 1, ("exp",)),
    (rf"\b(\d+)\s*[-–]\s*(\d+)\s*{_YEARS}\b", 2, ("-", "–")),
)
DEEP_ENTRY = (
    r"\b(freshers?\s+(?:only|can\s+apply|welcome)|entry[\s\-]level|"
    r"no\s+(?:prior\s+)?experience\s+(?:required|needed)|"
    r"0\s+(?:yrs?|years?)\s+(?:of\s+)?experience)\b"
)
ENTRY_PARTS = ("fresher", "entry", "experience")
SNIPPET_CONTEXT = 5

DEEP_SALARY_LABELS = ("salary", "ctc", "compensation", "package", "pay")
_PAY = r"(?:lpa|lakh|lac|k|l|cr|crore|pa|per\s+annum)?"
DEEP_SALARY_RULES = (
    r"(?:salary|ctc|compensation|package|pay)\s*[:\-]?\s*([₹$€£]?\s*[\d,.]+\s*" + _PAY
    + r"(?:\s*[-–to]+\s*[₹$€£]?\s*[\d,.]+\s*" + _PAY + r")?)",
    r"[₹$€£]\s*[\d,]+(?:\.\d+)?(?:\s*[-–to]+\s*[₹$€£]?\s*[\d,]+(?:\.\d+)?)?"
    r"(?:\s*(?:lpa|lakh|lac|k|cr|pa|per\s+annum|annually))?",
    r"\b(\d+(?:\.\d+)?)\s*[-–to]*\s*(\d+(?:\.\d+)?)?\s*(?:lpa|lakh|lac|l\b|cr|crore)\b",
    r"[₹$]?\s*(\d+(?:\.\d+)?)\s*k\s*(?:[-–to]+\s*[₹$]?\s*(\d+(?:\.\d+)?)\s*k)?",
)

SENIOR_PATTERN = r"(?iU)\b(senior|sr|lead|principal|manager|architect|director|head)\b|\bsr\."
TAG_YEARS = r"(?iU)\b(\d+[\s\-\+to]*\d*\s*(?:yrs?|years?))\b"
TAG_WORDS = (
    "junior", "entry level", "entry-level", "intern", "internship",
    "senior", "lead", "staff", "principal",
)
# A word boundary by Unicode classes is dear: it is looked for only before a digit, with which every hit begins.
BADGE_EXPERIENCE = (
    r"(?iU)(?=\d)\b(\d+\s*[-–to]+\s*\d+\s*(?:yrs?|years?)|(?:\d+\+?\s*(?:yrs?|years?)\s*(?:exp|experience)?))\b"
)


def _mentions(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _states_years(text: Column) -> Column:
    """Every years rule needs a number right before ``yr`` or ``year``."""
    return _mentions(text, ("yr", "year")) & text.rlike(r"(?U)\d\s*\+?\s*(?:yr|year)")


def max_experience(experience_raw: Column, description: Column) -> Column:
    """Upper bound of the required years.

    The description is read only when the experience text is blank: an
    unreadable experience text means "unknown", not "look elsewhere".
    """
    badge = F.lower(strip(experience_raw))
    rule = {name: capture_max(badge, *spec) for name, spec in BADGE_RULES.items()}
    zero = F.lit(0).cast("bigint")
    from_badge = F.coalesce(
        rule["range"],
        rule["plus"],
        F.when(badge.rlike("(?U)" + BADGE_ENTRY), zero),
        rule["at_least"],
        rule["years"],
        rule["number"],
    )
    text = F.lower(description)
    from_text = F.coalesce(
        F.when(_mentions(text, ENTRY_PARTS) & text.rlike("(?U)" + TEXT_ENTRY), zero),
        F.when(
            _states_years(text),
            F.coalesce(*[F.when(_mentions(text, needs), capture_max(text, p, n)) for p, n, needs in TEXT_RULES]),
        ),
    )
    return F.when(blank_null(badge).isNotNull(), from_badge).otherwise(from_text)


def _deep_match(text: Column, pattern: str, groups: int) -> Column:
    """``[context + match + context, group...]`` of the first match, else empty.

    Outer groups are 1 = all text before, 2 = the match, last = context after.
    """
    after = groups + 3
    rewrite = f"{SEP}$1{SEP}$2${after}" + "".join(f"{SEP}${i}" for i in range(3, groups + 3))
    shaped = F.regexp_replace(
        text, f"(?siU)^(.*?)({pattern})(.{{0,{SNIPPET_CONTEXT}}}).*$", rewrite
    )
    return F.split(shaped, SEP)


def deep_experience(full_text: Column, low: Column) -> Column:
    """``struct(experience_raw, max_experience)`` from a posting text and its lower case."""

    def rule(pattern: str, groups: int) -> Column:
        matched = F.filter(F.array(_deep_match(full_text, pattern, groups)), lambda p: F.size(p) > 1)
        return F.try_element_at(
            F.transform(
                matched,
                lambda p: F.struct(
                    strip(F.concat(F.right(p.getItem(1), F.lit(SNIPPET_CONTEXT)), p.getItem(2))).alias("experience_raw"),
                    F.array_max(
                        F.transform(F.slice(p, 4, groups), lambda g: g.try_cast("bigint"))
                    ).alias("max_experience"),
                ),
            ),
            F.lit(1),
        )

    entry = F.struct(F.lit("Fresher").alias("experience_raw"), F.lit(0).cast("bigint").alias("max_experience"))
    return F.coalesce(
        F.when(
            _states_years(low),
            F.coalesce(*[F.when(_mentions(low, needs), rule(p, n)) for p, n, needs in DEEP_RULES]),
        ),
        F.when(_mentions(low, ENTRY_PARTS) & low.rlike("(?U)" + DEEP_ENTRY), entry),
    )


def deep_salary(full_text: Column, low: Column) -> Column:
    """First salary wording of at least three characters in a posting text."""
    gates = (
        _mentions(low, DEEP_SALARY_LABELS),
        _mentions(low, tuple("₹$€£")),
        _mentions(low, ("l", "cr")),
        low.contains("k"),
    )
    rules = [
        F.when(gate, first_where(F.array(strip(F.regexp_extract(full_text, "(?iU)" + p, 0))), lambda x: F.length(x) >= 3))
        for gate, p in zip(gates, DEEP_SALARY_RULES)
    ]
    return F.when(full_text.rlike(r"\d"), F.coalesce(*rules))


def with_deep_fields(df: DataFrame, text: str) -> DataFrame:
    """Add all a posting text can fill: ``d_experience``, ``d_salary_raw``, ``d_bounds``.

    Each step is a projection of its own, so every regex runs once per text.
    """
    lowered = df.withColumn("_low", F.lower(text))
    parsed = lowered.withColumns(
        {
            "d_experience": deep_experience(F.col(text), F.col("_low")),
            "d_salary_raw": deep_salary(F.col(text), F.col("_low")),
        }
    )
    return parsed.withColumn("d_bounds", salary_bounds(F.col("d_salary_raw"))).drop("_low")


def says_senior(title: Column, experience_raw: Column) -> Column:
    """A whole seniority word in title or experience text; null counts as none."""
    return F.coalesce(title.rlike(SENIOR_PATTERN), F.lit(False)) | F.coalesce(
        experience_raw.rlike(SENIOR_PATTERN), F.lit(False)
    )


def experience_from_tags(tags: Column) -> Column:
    """First tag, in order, that names years or a level."""
    return first_where(
        F.transform(tags, strip), lambda t: t.rlike(TAG_YEARS) | F.lower(t).isin(*TAG_WORDS)
    )


def badge_experience(card_text: Column) -> Column:
    """Years wording shown on a card."""
    return strip(F.regexp_substr(card_text, F.lit(BADGE_EXPERIENCE)))
