"""String functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words dropped from free-text fields, and the characters of an e-mail address.
INSTITUTION_STOP_WORDS = ["dept", "department", "departments", "inst", "institute", "u", "univ", "university", "universities", "coll", "college", "ltd", "lab", "laboratory"]
EDITOR_STOP_WORDS = ["eds", "ed", "editor", "editors"]
JOURNAL_STOP_WORDS = ["proc", "proceeding", "proceedings", "international", "journal", "technical", "tech", "rep", "report", "workshop"]
KEYWORD_STOP_WORDS = ["keyword", "keywords"]
EMAIL_CHARACTERS = "a-z.@"


@lru_cache
def stop_words() -> list[str]:
    """Spark ML's English list."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def none_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def tabs_to_spaces(x: Column) -> Column:
    return F.translate(x, "\t", " ")


def newlines_to_spaces(x: Column) -> Column:
    return F.translate(x, "\n", " ")


def tabs_and_newlines_to_spaces(x: Column) -> Column:
    return F.translate(x, "\n\t", "  ")


def trim_ends(x: Column) -> Column:
    """Without white space (not only spaces) at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def remove_newlines_and_tabs(x: Column) -> Column:
    return F.translate(x, "\n\t", "")


def remove_punctuation(x: Column, by: str = "") -> Column:
    return F.regexp_replace(x, r"\p{Punct}", by)


def year_of(x: Column) -> Column:
    """The first four digits in a row, else ""."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), "[0-9]{4}", 0)


def stem_of_file(name: Column) -> Column:
    """File name before the first dot."""
    return F.split_part(F.regexp_extract(name, r"[^/]*$", 0), F.lit("."), F.lit(1))


def split_trimmed(x: Column, pattern: str) -> Column:
    """split without trailing empty strings; an empty text is one empty string."""

    def cut(parts: Column) -> Column:
        last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
        return F.slice(parts, F.lit(1), last)

    return F.when(x == "", F.array(F.lit(""))).otherwise(let(F.split(x, pattern), cut))


def non_empty(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull() & (x != ""))


def without(xs: Column, words: list[str]) -> Column:
    """Drops listed words and keeps repeats of others."""
    return F.filter(xs, lambda x: ~x.isin(words))


def first_of_each(xs: Column) -> Column:
    """Keep-first distinct."""
    return F.array_distinct(xs)


@lru_cache
def ascii_forms() -> tuple[str, str, str]:
    """From compatibility decomposition: characters with one ASCII character, those characters in that order, and 'char=ascii' pairs of characters with several."""
    single, one, pairs = [], [], []
    for i in range(0x80, 0x10000):
        if not 0xD800 <= i < 0xE000:
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if ord(c) < 128)
            if plain and not set(plain) & {"=", ";"}:
                if len(plain) == 1:
                    single.append(chr(i))
                    one.append(plain)
                else:
                    pairs.append(f"{chr(i)}={plain}")
    return "".join(single), "".join(one), ";".join(pairs)


def character_class(characters: str) -> str:
    """The inside of a regular expression's class of these characters, as ranges."""
    codes, out = sorted(map(ord, characters)), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


def strip_accents(x: Column) -> Column:
    """Compatibility decomposition, then everything outside ASCII deleted. Built in: texts of ASCII alone are passed by.

    Characters with one ASCII character are translated in one pass; only those
    with several (ligatures, fractions) are looked up, in texts that have some.
    """
    single, one, pairs = ascii_forms()
    several = character_class("".join(p[0] for p in pairs.split(";")))
    forms = F.str_to_map(F.lit(pairs), F.lit(";"), F.lit("="))
    folded = F.regexp_replace(F.translate(x, single, one), rf"[^\x00-\x7F{several}]+", "")
    looked_up = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c < "\x80", c).otherwise(F.try_element_at(forms, c))), "")
    plain = let(folded, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), looked_up(t)).otherwise(t))
    return F.when(x.rlike(r"[^\x00-\x7F]"), plain).otherwise(x)


def normalize(x: Column) -> Column:
    """Lower case, trimmed, accents stripped, white space collapsed."""
    return F.regexp_replace(strip_accents(trim_ends(F.lower(x))), r"\s+", " ")


def clean_field(xs: Column, extra: list[str]) -> Column:
    """Comma-separated pieces, lower-cased, without line breaks and punctuation; whole stop-word pieces go."""
    pieces = F.flatten(F.transform(xs, lambda x: split_trimmed(remove_newlines_and_tabs(F.lower(x)), ",")))
    return without(F.transform(pieces, lambda p: remove_punctuation(p)), [*stop_words(), *extra])


def clean_institutions(xs: Column) -> Column:
    return clean_field(xs, INSTITUTION_STOP_WORDS)


def clean_editors(xs: Column) -> Column:
    return clean_field(xs, EDITOR_STOP_WORDS)


def clean_keywords(xs: Column) -> Column:
    return clean_field(xs, KEYWORD_STOP_WORDS)


def clean_journals(xs: Column, cut_years: bool = True) -> Column:
    """As clean_field, without digits and pieces of one character; cut at "year:" (not cut_years: as if punctuation went first, never)."""
    pieces = F.flatten(F.transform(xs, lambda x: split_trimmed(remove_newlines_and_tabs(F.lower(x)), ",")))
    if cut_years:
        pieces = F.transform(pieces, lambda p: F.regexp_replace(p, r"year:[\s\S]*", ""))
    plain = F.transform(pieces, lambda p: F.regexp_replace(remove_punctuation(p), "[0-9]+", ""))
    return without(F.filter(plain, lambda p: F.length(p) > 1), [*stop_words(), *JOURNAL_STOP_WORDS])


def clean_emails(xs: Column) -> Column:
    pieces = F.flatten(F.transform(xs, lambda x: split_trimmed(F.lower(x), ",")))
    return F.transform(pieces, lambda p: F.regexp_replace(p, f"[^{EMAIL_CHARACTERS}]", ""))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def tag_values(x: Column, tag: str) -> Column:
    """All values of <tag>..</tag>, tags stripped, trimmed."""
    found = F.regexp_extract_all(x, F.lit(rf"<{tag}>((?:(?!</{tag}>)[\s\S])*)</{tag}>"), F.lit(1))
    return F.transform(found, lambda v: trim_ends(v))


def first_tag_value(x: Column, tag: str) -> Column:
    return F.get(tag_values(x, tag), F.lit(0))
