"""Citations of the form [SOURCE n]: extraction, validation, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped, two_decimals, word_count

MARK = r"\[SOURCE\s+(\d+)\]"
WORDS_FOR_ONE, WORDS_FOR_DENSITY, WORDS_PER_CITATION = 20, 50, 100
#: Phrases that say the answer isn't in the sources.
NOT_FOUND = (
    "i could not find",
    "i couldn't find",
    "not found in the provided",
    "not available in the sources",
    "the sources do not contain",
    "there is no information",
    "the provided materials do not",
)


def cited(c: Column) -> Column:
    """Every cited number, in order, repeats included."""
    return F.transform(F.regexp_extract_all(c, F.lit(MARK), 1), lambda x: F.try_to_number(F.substring(x, 1, 9), F.lit("999999999")).cast("int"))


def source_count(c: Column) -> Column:
    """The largest cited number, 0 without any."""
    return F.coalesce(F.array_max(cited(c)), F.lit(0))


def density(c: Column) -> Column:
    """Citations per 100 words."""
    return F.size(cited(c)) / F.greatest(word_count(c), F.lit(1)) * 100


def says_not_found(c: Column) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(p) for p in NOT_FOUND]), lambda p: F.contains(low, p))


def validated(c: Column, sources: Column, strict: bool = True) -> Column:
    """Struct of is_valid, cited_sources, invalid_sources, missing_citations, citation_density and a problem code."""
    marks, words = cited(c), word_count(c)
    known = F.array_sort(F.array_distinct(F.filter(marks, lambda n: (n >= 1) & (n <= sources))))
    wrong = F.filter(marks, lambda n: (n < 1) | (n > sources))
    free, none, bad = says_not_found(c), F.size(marks) == 0, F.size(wrong) > 0
    few = F.lit(strict) & (words > WORDS_FOR_ONE) & (F.size(known) < 1)
    thin = F.lit(strict) & (words > WORDS_FOR_DENSITY) & (density(c) < 100 / WORDS_PER_CITATION)
    nothing = F.array().cast("array<int>")
    problem = F.when(free, F.lit(None)).when(none, "none").when(bad, "invalid").when(few, "few").when(thin, "thin")
    return F.struct(
        problem.isNull().alias("is_valid"),
        F.when(free | none, nothing).otherwise(known).alias("cited_sources"),
        F.when(free | none, nothing).otherwise(wrong).alias("invalid_sources"),
        F.coalesce(problem.isin("none", "few"), F.lit(False)).alias("missing_citations"),
        F.when(free | none | bad, F.lit(0.0)).otherwise(density(c)).alias("citation_density"),
        problem.alias("problem"),
    )


def problem_message(checked: Column) -> Column:
    """What to tell about a validation."""
    return (
        F.when(checked["is_valid"], F.lit("Citations are valid."))
        .when(checked["problem"] == "none", F.lit("No citations found: add [SOURCE n] after each claim."))
        .when(checked["problem"] == "invalid", F.concat(F.lit("Citations out of range: "), F.array_join(checked["invalid_sources"].cast("array<string>"), ", ")))
        .when(checked["problem"] == "few", F.lit("Too few sources cited."))
        .otherwise(F.concat(F.lit("Citation density "), two_decimals(checked["citation_density"]), F.lit(" per 100 words is too low.")))
    )


def without_invalid(c: Column, sources: Column) -> Column:
    """Marks of sources that don't exist removed."""
    wrong = F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(MARK), 1), lambda n: (n.cast("int") < 1) | (n.cast("int") > sources)))
    return F.when(F.size(wrong) == 0, c).otherwise(stripped(F.regexp_replace(c, F.concat(F.lit(r"\[SOURCE\s+(?:"), F.array_join(wrong, "|"), F.lit(r")\]")), F.lit(""))))


def uncited(c: Column, least: int = 50) -> Column:
    """Parts between marks that are longer than `least` characters."""
    return F.filter(F.transform(F.split(c, MARK.replace("(", "(?:"), -1), stripped), lambda x: F.length(x) > least)


def annotated(c: Column) -> Column:
    """Sentences without a mark get a note that one is needed."""
    parts = F.split(c, r"(?<=[.!?])\s+", -1)
    return F.array_join(F.transform(parts, lambda s: F.when(s.rlike(MARK) | (stripped(s) == ""), s).otherwise(F.concat(s, F.lit(" [CITATION NEEDED]")))), " ")


def coverage(c: Column, sources: Column) -> Column:
    """Share of the sources that are cited."""
    known = F.array_distinct(F.filter(cited(c), lambda n: (n >= 1) & (n <= sources)))
    return F.size(known) / F.greatest(sources, F.lit(1))
