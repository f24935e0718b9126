"""Person-name processors: functions from an author struct to an author struct, composed in order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesmith.functions.text import let, normalize, split_trimmed, strip_accents, trim_ends

Processor = Callable[[Column], Column]


def compound(*parts: Processor) -> Processor:
    """Applies each in turn; none is the identity. Every step's result is computed once."""
    return lambda name: reduce(lambda x, f: let(x, f), parts, name)


def identity(name: Column) -> Column:
    return name


def on(field: str, change: Callable[[Column], Column]) -> Processor:
    return lambda name: name.withField(field, change(name[field]))


def on_each(field: str, change: Callable[[Column], Column]) -> Processor:
    return lambda name: name.withField(field, F.transform(name[field], lambda x: change(x)))


trim_first, trim_last = on("firstName", trim_ends), on("lastName", trim_ends)


def split_first_middle(name: Column) -> Column:
    """Two letters that aren't Upper+lower are two initials, which replace the middle names; other first names are split on white space."""
    first, middles = name["firstName"], name["middleNames"]
    initials = (F.length(first) == 2) & ~first.rlike(r"^\p{Lu}\p{Ll}$")
    parts = split_trimmed(first, r"\s")
    split = let(parts, lambda p: F.struct(F.coalesce(F.get(p, F.lit(0)), F.lit("")).alias("first"), F.concat(middles, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))).alias("rest")))
    as_initials = F.struct(F.substring(first, 1, 1).alias("first"), F.array(F.substring(first, 2, 1)).alias("rest"))
    as_is = F.struct(first.alias("first"), middles.alias("rest"))
    new = F.when(initials, as_initials).when(F.length(first).isin(0, 2), as_is).otherwise(split)
    return let(new, lambda n: name.withField("firstName", n["first"]).withField("middleNames", n["rest"]))


def drop_overlapping_middles(name: Column) -> Column:
    """Drops middle names equal to first or last, and repeats, regardless of case."""
    middles = name["middleNames"]
    lower = F.transform(middles, lambda m: F.lower(m))
    kept = F.filter(middles, lambda m, i: (F.lower(m) != F.lower(name["firstName"])) & (F.lower(m) != F.lower(name["lastName"])) & (F.array_position(lower, F.lower(m)) == i + 1))
    return name.withField("middleNames", kept)


def split_suffixes(name: Column) -> Column:
    """What follows a comma in the last name are suffixes."""
    parts = F.transform(split_trimmed(name["lastName"], ","), lambda p: trim_ends(p))
    return let(parts, lambda p: name.withField("lastName", F.coalesce(F.get(p, F.lit(0)), F.lit(""))).withField("suffixes", F.concat(name["suffixes"], F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))))


def written_accents(x: Column) -> Column:
    """{mark over (y)} becomes y."""
    return F.regexp_replace(x, r"\{[^{}]*? over \(([^()]*)\)\}", "$1")


accents_of_last, accents_of_first = on("lastName", written_accents), on("firstName", written_accents)
unicode_of_last, unicode_of_first = on("lastName", strip_accents), on("firstName", strip_accents)


def alphabetic(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-zA-Z]", "")


alphabetic_last, alphabetic_first = on("lastName", alphabetic), on("firstName", alphabetic)
alphabetic_middles, alphabetic_suffixes = on_each("middleNames", alphabetic), on_each("suffixes", alphabetic)
alphabetic_all = compound(alphabetic_last, alphabetic_middles, alphabetic_suffixes, alphabetic_first)
lower_first, lower_last = on("firstName", F.lower), on("lastName", F.lower)
lower_middles, lower_suffixes = on_each("middleNames", F.lower), on_each("suffixes", F.lower)
lower_all = compound(lower_first, lower_last, lower_middles, lower_suffixes)
reevaluating = compound(trim_first, trim_last, split_suffixes, accents_of_last, accents_of_first, split_first_middle, drop_overlapping_middles)
case_insensitive_reevaluating = compound(
    trim_first, trim_last, split_suffixes, accents_of_last, accents_of_first, unicode_of_first, unicode_of_last, split_first_middle, drop_overlapping_middles, alphabetic_all, lower_all
)
BY_NAME: dict[str, Processor] = {"identity": identity, "caseinsensitivereevaluating": case_insensitive_reevaluating, "lowercaseallnames": lower_all, "reevaluating": reevaluating}


def from_name(name: str) -> Processor:
    """A processor by its name, in any case, with or without "NameProcessor"."""
    return BY_NAME[name.lower().replace("nameprocessor", "")]


def normalized(name: Column) -> Column:
    """First, middle and last normalised; e-mails, institutions and suffixes dropped."""
    from namesmith.schema import author

    return author(normalize(name["firstName"]), F.transform(name["middleNames"], lambda m: normalize(m)), normalize(name["lastName"]))


def formatted(name: Column) -> Column:
    """Last, First Middles."""
    return F.concat(name["lastName"], F.lit(", "), F.array_join(F.concat(F.array(name["firstName"]), name["middleNames"]), " "))


def is_empty(name: Column) -> Column:
    return (name["firstName"] == "") & (name["lastName"] == "") & (F.size(F.filter(name["middleNames"], lambda m: m != "")) == 0)


def same_name(a: Column, b: Column) -> Column:
    """Equal first and last names and equal sets of middle names; absent equals absent only."""
    middles = lambda n: F.array_sort(F.array_distinct(n["middleNames"]))
    return a["firstName"].eqNullSafe(b["firstName"]) & a["lastName"].eqNullSafe(b["lastName"]) & middles(a).eqNullSafe(middles(b))


def name_key(name: Column) -> Column:
    """A struct that two names have in common if and only if they are the same by ``same_name``; for grouping and joins."""
    return F.struct(name["firstName"].alias("first"), name["lastName"].alias("last"), F.array_sort(F.array_distinct(name["middleNames"])).alias("middles"))


def middle_initials(name: Column) -> Column:
    return F.transform(F.filter(name["middleNames"], lambda m: m != ""), lambda m: F.substring(m, 1, 1))
