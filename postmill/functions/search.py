"""Search text: roles, locations, slugs and target urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import SEP, blank_null, collapse, lookup, strip

# Place names and their canonical spelling.
LOCATION_ALIASES = {
    "bangalore": "bangalore",
    "bengaluru": "bangalore",
    "gurugram": "gurgaon",
    "gurgaon": "gurgaon",
    "mumbai": "mumbai",
    "pune": "pune",
    "delhi": "delhi",
    "noida": "noida",
    "hyderabad": "hyderabad",
    "chennai": "chennai",
    "india": "india",
}
# The search grammar.
PREPOSITION = r"(?iU)\b(?:in|at|across)\b"
LOCATION_SEPARATOR = r"(?iU)\s*(?:,|\band\b|\bor\b|&)\s*"
ROLE_STOP_WORDS = r"(?iU)\b(?:find|search|looking\s+for|jobs?|roles?|openings?)\b"

BOARD_URL = "https://www.naukri.com"
STARTUP_URL = "https://wellfound.com"


def slugify(c: Column) -> Column:
    """Lower-case words joined by single dashes, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))


def slugify_loose(c: Column) -> Column:
    """Drop other characters, then turn space and dash runs into one dash."""
    kept = F.regexp_replace(F.lower(strip(c)), r"(?U)[^a-zA-Z0-9\s-]", "")
    return F.regexp_replace(kept, r"(?U)[\s_-]+", "-")


def alias_location(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.coalesce(lookup(LOCATION_ALIASES, low), low)


def location_slug(c: Column) -> Column:
    return slugify(alias_location(F.coalesce(c, F.lit(""))))


def parse_search(text: Column) -> Column:
    """``struct(role, locations)`` of a free-text search.

    Everything before the first preposition is the role, everything after it the
    locations; distinct locations keep their order.
    """
    query = collapse(F.translate(F.coalesce(text, F.lit("")), SEP, " "))
    halves = F.split(F.regexp_replace(query, rf"(?siU)^(.*?)\b(?:in|at|across)\b(.*)$", f"$1{SEP}$2"), SEP)
    role = F.regexp_replace(halves.getItem(0), ROLE_STOP_WORDS, " ")
    role = F.btrim(collapse(role), F.lit(" ,.-"))
    places = F.transform(
        F.split(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")), LOCATION_SEPARATOR),
        lambda p: F.btrim(collapse(p), F.lit(" .")),
    )
    places = F.array_distinct(F.transform(F.filter(places, lambda p: p != ""), alias_location))
    return F.struct(role.alias("role"), places.alias("locations"))


def split_csv_setting(c: Column) -> Column:
    """Comma-separated setting to an ordered list without blanks."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda p: p != "")


def board_url(role: Column, location: Column) -> Column:
    """Search page of the API board; without a usable location the role page."""
    place = location_slug(location)
    base = F.concat(F.lit(BOARD_URL + "/"), slugify(role), F.lit("-jobs"))
    return F.when(place != "", F.concat(base, F.lit("-in-"), place)).otherwise(base)


def board_targets(roles: Column, locations: Column, limit: int | None = None) -> Column:
    """Search pages of every role in every place, role by role; role pages without a place.

    With ``limit`` only the first so many places of the list are used.
    """
    places = locations if limit is None else F.slice(locations, 1, limit)
    places = F.when(F.size(locations) == 0, F.array(F.lit(""))).otherwise(places)
    return F.flatten(F.transform(roles, lambda r: F.transform(places, lambda p: board_url(r, p))))


def parsed_search_urls(role: Column, locations: Column) -> Column:
    """One search page per parsed location; none at all without a role."""
    slug = slugify(role)
    base = F.concat(F.lit(BOARD_URL + "/"), slug, F.lit("-jobs"))
    per_place = F.transform(F.filter(F.transform(locations, slugify), lambda p: p != ""),
                            lambda p: F.concat(base, F.lit("-in-"), p))
    none = F.array().cast("array<string>")
    return F.when(slug == "", none).when(F.size(locations) == 0, F.array(base)).otherwise(per_place)


def startup_urls(role: Column, location: Column) -> Column:
    """Role-and-place page first, role page as fallback; no repeats."""
    slug = slugify_loose(role)
    place = slugify_loose(location)
    place = F.when(place == "bengaluru", "bangalore").otherwise(place)
    fallback = F.concat(F.lit(STARTUP_URL + "/role/r/"), slug)
    first = F.when(
        blank_null(location).isNotNull(),
        F.concat(F.lit(STARTUP_URL + "/role/l/"), slug, F.lit("/"), place),
    ).otherwise(fallback)
    return F.array_distinct(F.array(first, fallback))


def resolve_url(base: str, url: Column) -> Column:
    """Absolute form of a link found on ``base``."""
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(F.lit(base.split("//")[0]), url))
        .when(blank_null(url).isNull() | (url == "#"), F.lit(base))
        .when(url.startswith("/") | url.startswith("?") | url.startswith("#"), F.concat(F.lit(base), url))
        .otherwise(F.concat(F.lit(base + "/"), url))
    )


def prefix_url(base: str, url: Column) -> Column:
    """Put ``base`` before any link that does not start with ``http``."""
    return F.when((url == "") | url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))
