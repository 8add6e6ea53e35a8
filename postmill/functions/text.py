"""String building blocks shared by every column transform.

Postings come from web pages, so "whitespace" always means Unicode whitespace:
``btrim`` with an explicit character list for strips, ``(?U)`` for ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as regex character classes. Single low characters stand in one bit table, and those above
# are looked at only inside their range, so that a letter costs two tests.
_HIGH_WS = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_ODD_WS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + _HIGH_WS
# A whitespace run that is not one plain blank already.
WS_RUN = rf" [ {_ODD_WS}]+|[{_ODD_WS}][ {_ODD_WS}]*"

# Separator put between captured groups; taken out of a text before it is used.
SEP = "\x01"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Every whitespace run becomes one space, ends trimmed."""
    return F.btrim(F.regexp_replace(c, WS_RUN, " "))


def blank_null(c: Column) -> Column:
    """Empty string counts as missing."""
    return F.nullif(c, F.lit(""))


def first_nonblank(*cols: Column) -> Column:
    return F.coalesce(*[blank_null(c) for c in cols])


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def first_where(values: Column, predicate) -> Column:
    """First array element that satisfies ``predicate``, else null."""
    return F.try_element_at(F.filter(values, predicate), F.lit(1))


def capture(c: Column, pattern: str, groups: int, flags: str = "sU") -> Column:
    """All groups of the first match as an array; empty array when there is none.

    One regex run whatever the number of groups: the whole text is rewritten to
    the separated groups and split. A group that took no part gives ``""``.
    """
    rewrite = "".join(f"{SEP}${i}" for i in range(1, groups + 1))
    # A separator in the text itself becomes a blank, so only groups are split and a text without match has none.
    joined = F.regexp_replace(F.translate(c, SEP, " "), f"(?{flags})^.*?(?:{pattern}).*$", rewrite)
    return F.slice(F.split(joined, SEP), 2, groups)


def capture_max(c: Column, pattern: str, groups: int, flags: str = "sU") -> Column:
    """Largest integer among the captured groups, null when nothing matches."""
    return F.array_max(F.transform(capture(c, pattern, groups, flags), lambda g: g.try_cast("bigint")))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Literal dictionary lookup, null for an unknown key."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def title_case(c: Column) -> Column:
    """Upper-case the first letter after every non-letter, lower-case the rest.

    ``initcap`` only restarts after a space, so hyphenated names need this.
    """
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def norm_title(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def norm_description(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def norm_company(c: Column) -> Column:
    """Collapse whitespace and drop a trailing star rating such as ``4.2 ★``."""
    name = collapse(F.coalesce(c, F.lit("")))
    return strip(F.regexp_replace(name, r"(?U)\s+\d+(\.\d+)?\s*[★*]+$", ""))


def clean_company_ratings(c: Column) -> Column:
    """Drop a trailing rating, review count or follower count."""
    name = collapse(F.coalesce(c, F.lit("")))
    name = F.regexp_replace(name, r"(?U)\s+\d+(\.\d+)?\s*\**$", "")
    name = F.regexp_replace(name, r"(?iU)\s+\d+(\.\d+)?\s*(Reviews?|Ratings?|Followers?).*$", "")
    name = F.regexp_replace(name, r"(?iU)\s+\d+k\+?\s*(Reviews?|Ratings?|Followers?).*$", "")
    return strip(name)


# Wordings that all mean a remote position.
REMOTE_SYNONYMS = ("remote", "work from home", "wfh", "telecommute", "anywhere", "worldwide")


def norm_location(c: Column) -> Column:
    loc = strip(c)
    is_remote = F.lower(loc).rlike("|".join(REMOTE_SYNONYMS))
    return F.when(blank_null(c).isNull() | is_remote, F.lit("Remote")).otherwise(loc)


def norm_tags(tags: Column) -> Column:
    """Null becomes an empty list, empty tags go, the rest is stripped."""
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return F.transform(kept, strip)


def clip(c: Column, limit: int) -> Column:
    """Cut at ``limit`` characters and mark the cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)
