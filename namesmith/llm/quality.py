"""Quality rules: how far a document's histograms are from those of its nearest language.

Two histograms of a document, of character classes and of common words, are
compared with language references by Jensen-Shannon distance. References are
sums over the whole corpus: of each language, its most
frequent words, and the shares of all character classes. Texts too short for a
histogram to mean anything pass. Repetition rules come first.

A document's common words are counted once and compared with all references in
one expression, over the words that it has: neither plan nor work grows with
languages times vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesmith.functions.vectors import bag
from namesmith.plans.storage import cut, remove

SPACES = r"[\x20\x09-\x0D]+"
#: Fixed classes of characters; what is in none counts as lower case or other.
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "mark": r"[.,;:!?'\x22()\x2D]", "symbol": r"[#*$%&|<>]", "foreign": r"[^\x00-\x7F]"}
#: Runs that no class counts; most of a text is such.
PLAIN = r"[a-z\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the verdict.

    least_words: base rule. most_repeated: percent of words in repeated
    windows of ``window`` words. guard: words under which no histogram is
    judged. classes, common: largest Jensen-Shannon distances that pass.
    """

    least_words: int = 10
    window: int = 5
    most_repeated: int = 20
    guard: int = 50
    classes: float = 0.25
    common: float = 0.45
    top: int = 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def joined(value: Column, place: Column, bits: Column) -> Column:
    """The value's upper bits and a place in the lower ones."""
    return F.call_function("shiftleft", value, bits).bitwiseOR(place.cast("long"))


def place(packed: Column, bits: Column) -> Column:
    return packed.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")


def apart(a: Column, b: Column, bits: Column) -> Column:
    """Zero if two packed longs have equal values."""
    return F.call_function("shiftright", a.bitwiseXOR(b), bits)


def repeated_words(words: Column, n: int) -> Column:
    """How many words lie in an n-word window that is found twice or more in the text."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    wins = let(hashed, lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>")))

    def places(h: Column) -> Column:
        # Hash and place in one long: sorting longs is cheap, and equals become neighbours.
        bits = F.ceil(F.log2(F.size(h) + 1.0)).cast("int")

        def neighbours(x: Column) -> Column:
            """x: the bits, and the packed longs in order. The packed bits propose, whole hashes decide."""

            def equal(a: Column, b: Column) -> Column:
                return F.when((apart(a, b, x["b"]) == 0) & (F.get(h, place(a, x["b"])) == F.get(h, place(b, x["b"]))), F.array(place(a, x["b"]), place(b, x["b"])))

            pairs = F.zip_with(F.slice(x["s"], F.lit(1), F.size(x["s"]) - 1), F.slice(x["s"], F.lit(2), F.size(x["s"]) - 1), equal)
            return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))

        packed = let(F.struct(bits.alias("b"), h.alias("h")), lambda x: F.struct(x["b"].alias("b"), F.sort_array(F.transform(x["h"], lambda v, i: joined(v, i, x["b"]))).alias("s")))
        return let(packed, neighbours)

    def covered(h: Column) -> Column:
        start = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places(h), start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(n), i - a["last"])).alias("n")), lambda a: a["n"])

    return let(wins, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def measures(docs: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, text, words, marked and the base figures."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    seen = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words(F.col("text"))).withColumn("marked", marked(F.col("text")))
    return seen.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("marked", F.lit(CLASSES["symbol"])).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), limits.window).alias("n_repeat_words"),
    )


def marked(text: Column) -> Column:
    """What classes may count, in one pass over the text."""
    return F.regexp_replace(text, PLAIN, "")


def class_counts(marked: Column, size: Column, word_chars: Column) -> list[Column]:
    """Characters of each class, and spaces. What is not of a class is deleted in runs, which is faster than to count."""
    outside = lambda x: x.replace("[^", "[") if x.startswith("[^") else x.replace("[", "[^", 1)
    found = [F.length(F.regexp_replace(marked, outside(x) + "+", "")) for x in CLASSES.values()]
    return [x.cast("double") for x in (*found, size - word_chars)]


@dataclass(frozen=True)
class References:
    """The common words of all languages; of each language, its shares of them and of all character classes."""

    vocabulary: list[str]
    common: list[list[float]]
    classes: list[list[float]]


def references(docs: DataFrame, limits: Limits) -> References:
    """Sums over all documents with text and lang; ``top`` words and the class sums of each language reach the driver."""
    own = docs.where("lang is not null and text is not null").select("lang", "text", marked(F.col("text")).alias("marked"))
    counts = cut(own.select("lang", F.explode(words(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limits.top).select("lang", "word", "n").collect()
    remove(counts)
    kinds = [f"c{i}" for i in range(len(CLASSES) + 1)]
    sized = own.select("lang", F.length("text").alias("size"), *(x.alias(k) for k, x in zip(kinds, class_counts(F.col("marked"), F.length("text"), F.length(F.regexp_replace("text", SPACES, ""))), strict=True)))
    sums = {r["lang"]: r for r in sized.groupBy("lang").agg(F.sum("size").alias("size"), *(F.sum(k).alias(k) for k in kinds)).collect()}
    vocabulary = sorted({r["word"] for r in top})
    out = References(vocabulary, [], [])
    for lang, r in sorted(sums.items()):
        if r["size"] and totals.get(lang):
            found = {x["word"]: x["n"] for x in top if x["lang"] == lang}
            out.common.append(shares([float(found.get(w, 0)) for w in vocabulary], float(totals[lang])))
            out.classes.append(shares([r[k] for k in kinds], float(r["size"])))
    return out


def shares(counts: list[float], total: float) -> list[float]:
    """Shares of the total, the rest last."""
    return [x / total for x in counts] + [max(0.0, 1 - sum(counts) / total)]


def literal(rows: list[list[float]]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))


def term(p: Column, q: Column) -> Column:
    """What one entry adds to twice the divergence."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def distance(twice: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1)."""
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2))


def nearest_classes(marked: Column, size: Column, word_chars: Column, refs: References) -> Column:
    """Least distance of the text's character classes to a language's."""
    counted = let(F.array(*class_counts(marked, size, word_chars)), lambda c: F.transform(c, lambda x: x / size))
    own = let(counted, lambda p: F.concat(p, F.array(F.greatest(F.lit(0.0), 1 - total(p)))))
    return let(own, lambda p: F.array_min(F.transform(literal(refs.classes), lambda q: distance(total(F.zip_with(p, q, term))))))


def nearest_words(words: Column, refs: References) -> Column:
    """Least distance of the text's common words to a language's: entries that the text lacks add their share."""
    size = len(refs.vocabulary)
    listed = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(refs.vocabulary))
    places = F.array(*map(F.lit, refs.vocabulary))
    found = F.transform(F.map_entries(bag(listed)), lambda e: F.struct((F.array_position(places, e["key"]) - 1).cast("int").alias("i"), (e["value"] / F.size(words)).alias("p")))

    def apart(x: Column, q: Column) -> Column:
        met = total(F.transform(x, lambda e: term(e["p"], F.get(q, e["i"])) - F.get(q, e["i"])))
        rest = F.greatest(F.lit(0.0), 1 - total(F.transform(x, lambda e: e["p"])))
        return distance(met + 1 - F.get(q, F.lit(size)) + term(rest, F.get(q, F.lit(size))))

    return let(found, lambda x: F.array_min(F.transform(literal(refs.common), lambda q: apart(x, q))))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    base_failed: too few words, or too many in repeated windows. Others are
    kept unless one of their distances to the nearest language (rounded to six
    places) exceeds its limit; texts under the guard, and all where no language
    has a reference or docs have no lang, are kept. Distances are null where not
    judged. Null texts have no words. Rows repeat as they come.
    """
    refs = references(docs, limits) if "lang" in docs.columns else References([], [], [])
    seen = measures(docs, limits)
    base = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.most_repeated * F.col("n_words"))
    judged = ~base & (F.col("n_words") >= limits.guard)
    if refs.common:
        near_class, near_word = F.round(nearest_classes(F.col("marked"), F.length("text"), F.col("word_chars"), refs), 6), F.round(nearest_words(F.col("words"), refs), 6)
    else:
        near_class = near_word = F.lit(None).cast("double")
    out = seen.withColumn("base_failed", base).withColumn("class_distance", F.when(judged, near_class)).withColumn("word_distance", F.when(judged, near_word))
    good = (F.coalesce("class_distance", F.lit(0.0)) <= limits.classes) & (F.coalesce("word_distance", F.lit(0.0)) <= limits.common)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & good).alias("kept"))
