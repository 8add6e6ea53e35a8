"""Predicates over postings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.experience import says_senior
from postmill.functions.html import plain_text, spaced_text
from postmill.functions.text import let, strip

# Role words too general to select a posting on their own.
GENERIC_ROLE_WORDS = (
    "developer", "engineer", "dev", "senior", "junior", "lead",
    "staff", "intern", "manager", "specialist", "analyst", "architect",
)
# Regional restrictions, remote markers and accepted places.
RESTRICTED_TAGS = (
    r"(?iU)\bus\s+only\b|\bu\.s\.\s+only\b|\bunited states\s+only\b|\beurope\s+only\b|\blatam\b"
    r"|\blatin america\s+only\b|\buk\s+only\b|\bunited kingdom\s+only\b"
)
# A word boundary by Unicode classes is dear: it is looked for only where the whole word stands.
RESTRICTED_TEXT = (
    r"(?iU)(?=[uelwb])(?:(?:us(?<=\bus)|u\.s\.(?<=\bu\.s\.)|united states(?<=\bunited states)|europe(?<=\beurope)"
    r"|uk(?<=\buk))\s+only\b|latam(?<=\blatam)\b|within(?<=\bwithin)\s+germany\b|berlin(?<=\bberlin)\s+office\b)"
)
# Parts of which a restricted text holds one in lower case; no letter in them (i, k, s) has a second lower case form.
RESTRICTED_PARTS = ("only", "latam", "germany", "berl")
REMOTE_MARKERS = ("remote", "worldwide", "anywhere")
ACCEPTED_PLACES = (
    "india", "bengaluru", "bangalore", "hyderabad", "pune",
    "gurgaon", "noida", "delhi", "mumbai", "chennai",
)
BLOCKED_MARKDOWN = ("verify you are human", "access-restriction", "challenge-platform")
BLOCKED_PAGE = ("verify you are human", "access-restriction")
EXPERIENCE_CEILING = 1


def _any(checks: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, checks, F.lit(False))


def specific_words(phrase: str) -> list[str]:
    return [w for w in phrase.split() if len(w) > 2 and w not in GENERIC_ROLE_WORDS]


def _lower_tags(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)


def searchable(position: Column, tags: Column, description: Column) -> Column:
    """``struct(head, text)``: what specific words and what whole phrases look at.

    ``head`` holds the position and each tag on lines of their own, so one
    substring test covers "in the position or in any tag".
    """
    title = F.lower(F.coalesce(position, F.lit("")))
    low = _lower_tags(tags)
    return F.struct(
        F.array_join(F.concat(F.array(title), low), "\n").alias("head"),
        F.concat_ws(" ", title, F.array_join(low, " "), F.lower(plain_text(description))).alias("text"),
    )


def match_keywords(position: Column, tags: Column, description: Column, keywords: Sequence[str]) -> Column:
    """Does the posting match any keyword phrase?

    A phrase matches as a whole anywhere; by any specific word in position or
    tags; or, when it has no specific word, by all its words anywhere.
    """
    if not keywords:
        return F.lit(True)
    phrases = [p for p in (k.lower().strip() for k in keywords) if p]

    def found(where: Column) -> Column:
        checks = []
        for phrase in phrases:
            checks.append(where["text"].contains(phrase))
            specific = specific_words(phrase)
            if specific:
                checks.append(_any([where["head"].contains(w) for w in specific]))
            else:
                checks.append(reduce(lambda a, b: a & b, [where["text"].contains(w) for w in phrase.split()]))
        return _any(checks)

    return let(searchable(position, tags, description), found)


def open_to_applicants(tags: Column, description: Column) -> Column:
    """Neither tags nor description restrict the posting to another region."""
    tags_text = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")

    def restricted(text: Column) -> Column:
        gate = let(F.lower(text), lambda low: _any([low.contains(p) for p in RESTRICTED_PARTS]))
        return gate & text.rlike(RESTRICTED_TEXT)

    return ~tags_text.rlike(RESTRICTED_TAGS) & ~let(spaced_text(description), restricted)


def reachable_place(location: Column, tags: Column) -> Column:
    """Marked remote, without a place, or in an accepted place."""
    place = F.lower(strip(F.coalesce(location, F.lit(""))))
    remote_tag = F.arrays_overlap(_lower_tags(tags), F.array(*[F.lit(m) for m in REMOTE_MARKERS]))
    named = _any([place.contains(p) for p in REMOTE_MARKERS + ACCEPTED_PLACES])
    return (place == "") | named | remote_tag


def match_location(
    location: Column, tags: Column, description: Column, locations: Sequence[str]
) -> Column:
    """Regional restrictions first, then remote, accepted or requested places."""
    place = F.lower(strip(F.coalesce(location, F.lit(""))))
    requested = [w for w in (loc.strip().lower() for loc in locations) if w]
    somewhere = reachable_place(location, tags) | _any([place.contains(w) for w in requested])
    return somewhere & open_to_applicants(tags, description)


def filter_feed(df: DataFrame, keywords: Sequence[str], locations: Sequence[str]) -> DataFrame:
    """Feed items that match the search."""
    position, tags, text = F.col("position"), F.col("tags"), F.col("description")
    return df.where(
        match_location(F.col("location"), tags, text, locations) & match_keywords(position, tags, text, keywords)
    )


def block_senior(df: DataFrame) -> DataFrame:
    return df.where(~says_senior(F.col("title"), F.col("experience_raw")))


def experience_ceiling(df: DataFrame, ceiling: int = EXPERIENCE_CEILING) -> DataFrame:
    years = F.col("max_experience_required")
    return df.where(years.isNull() | (years <= ceiling))


def with_drop_reason(df: DataFrame, ceiling: int = EXPERIENCE_CEILING) -> DataFrame:
    """``senior``, ``experience`` or null for a posting that stays."""
    return df.withColumn(
        "drop_reason",
        F.when(says_senior(F.col("title"), F.col("experience_raw")), "senior").when(
            F.col("max_experience_required") > ceiling, "experience"
        ),
    )


def strict_filter(df: DataFrame, ceiling: int = EXPERIENCE_CEILING) -> DataFrame:
    return with_drop_reason(df, ceiling).where(F.col("drop_reason").isNull()).drop("drop_reason")


def shows_block(*bodies: Column, markdown: bool = False) -> Column:
    """Does a page show a human check instead of postings?"""
    terms = BLOCKED_MARKDOWN if markdown else BLOCKED_PAGE
    return let(F.lower(F.concat_ws("", *bodies)), lambda text: _any([text.contains(t) for t in terms]))


def drop_blocked_pages(df: DataFrame, *bodies: str, markdown: bool = False) -> DataFrame:
    """Pages that show a human check instead of postings are discarded."""
    return df.where(~shows_block(*[F.col(b) for b in bodies], markdown=markdown))
