"""Employment type vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import first_nonblank, lookup, strip

# Spellings accepted when a posting is validated.
MODEL_TYPES = {
    "full time": "Full-time",
    "full-time": "Full-time",
    "fulltime": "Full-time",
    "part time": "Part-time",
    "part-time": "Part-time",
    "parttime": "Part-time",
    "contract": "Contract",
    "freelance": "Contract",
    "internship": "Internship",
    "intern": "Internship",
}
# Four more spellings known to normalisation only.
NORMALISED_TYPES = {
    **MODEL_TYPES,
    "permanent": "Full-time",
    "consulting": "Contract",
    "temporary": "Contract",
    "apprenticeship": "Internship",
}


def _mapped(mapping: dict[str, str], c: Column) -> Column:
    text = strip(c)
    return F.coalesce(lookup(mapping, F.lower(text)), first_nonblank(text), F.lit("Full-time"))


def model_job_type(c: Column) -> Column:
    return _mapped(MODEL_TYPES, c)


def norm_job_type(c: Column) -> Column:
    return _mapped(NORMALISED_TYPES, c)


def job_type_from_tags(tags: Column) -> Column:
    """Exact tag membership; contract beats part-time beats internship."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)

    def any_of(*words: str) -> Column:
        return F.arrays_overlap(low, F.array(*[F.lit(w) for w in words]))

    return (
        F.when(any_of("contract", "freelance"), "Contract")
        .when(any_of("part time", "part-time"), "Part-time")
        .when(any_of("internship", "junior"), "Internship")
        .otherwise("Full-time")
    )


def job_type_intern(*texts: Column) -> Column:
    """Internship when ``intern`` occurs in any of the texts."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return F.when(joined.contains("intern"), "Internship").otherwise("Full-time")
