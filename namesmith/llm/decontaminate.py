"""Benchmark decontamination as a prefix-filtered set join.

An item is a set of windows, a window a run of words. A document can contain a
window only if it has the window's rarest word, so one prefix token suffices:
words are ordered by their count in the corpus, documents meet windows on the
rarest word, the word's place must leave room for the whole window before and
after it, and the words there must equal the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.llm.urlfilter import LOWER, UPPER
from namesmith.plans.storage import cut

#: What parts words once A-Z count as a-z.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of windows or of their vocabulary that may be broadcast; beyond it they are shuffled.
BROADCAST = 64 << 20


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and non-ASCII characters, case as it is."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """Broadcast df if its measured size allows."""
    n = df.select(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if n <= limit else df


def windows(items: DataFrame, length: int) -> DataFrame:
    """Distinct windows: window text (words joined by a space), words, n, items (ids as strings)."""
    own = items.select(F.col("item_id").cast("string"), words(folded(F.col("text"))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    each = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(length)))).alias("words"))
    return each.groupBy(F.array_join("words", " ").alias("window")).agg(F.first("words").alias("words"), F.collect_set("item_id").alias("items")).withColumn("n", F.size("words"))


def keyed(found: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """Windows with their rarest word (``token``, any case) and its place (``off``)."""
    parts = found.select("window", F.posexplode("words").alias("off", "word")).withColumn("token", F.lower("word"))
    vocabulary = small(cut(parts.select("token").distinct(), "vocabulary"), F.octet_length("token") + 16, limit)
    counted = docs.select(F.explode(words(F.col("text"))).alias("word")).select(F.lower("word").alias("token")).join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("count"))
    rarest = parts.join(counted, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "off", "token")).alias("r"))
    return found.join(rarest, "window").select("window", "n", "items", "r.off", "r.token")


def occurrences(docs: DataFrame, items: DataFrame, length: int = 10, limit: int = BROADCAST) -> DataFrame:
    """Where windows occur: doc_id, mark, lo, hi (in words, hi exclusive), items.

    mark is a hash of the text, which tells texts of one doc_id apart. Rows
    without doc_id are searched as any others.
    """
    keys = cut(keyed(windows(items, length), docs, limit), "windows")
    known = small(keys, F.octet_length("window") + F.octet_length("token") + 64 * F.size("items") + 64, limit)
    lo = F.col("pos") - F.col("off")
    fits = (lo >= 0) & (lo + F.col("n") <= F.size("words"))
    equal = folded(F.array_join(F.slice("words", lo + 1, F.col("n")), " ")) == F.col("window")
    own = ("doc_id", F.xxhash64("text").alias("mark"))
    split = docs.select(*own, words(F.col("text")).alias("words"))
    if known is not keys:
        met = split.select("doc_id", "mark", "words", F.posexplode("words").alias("pos", "word")).join(known, (F.lower("word") == F.col("token")) & fits & equal)
    else:
        places = split.select("doc_id", "mark", F.posexplode("words").alias("pos", "word")).join(keys.select("token", "window"), F.lower("word") == F.col("token"))
        places = places.select(F.col("doc_id").alias("at"), F.col("mark").alias("of"), "pos", "window")
        met = places.join(keys, "window").join(split.dropDuplicates(["doc_id", "mark"]), F.col("at").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("mark"))).where(fits & equal)
    return met.select("doc_id", "mark", lo.alias("lo"), (lo + F.col("n")).alias("hi"), "items")


def covered(spans: Column) -> Column:
    """Length of the union of an array of structs (lo, hi)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["hi"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(a["end"], x["lo"]))).alias("n"))
    return F.aggregate(F.sort_array(spans), start, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, limit: int = BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated, items.

    Words are compared with A-Z lower-cased; an item of fewer words than a
    window, but not none, is one window. Null texts and items have no words.
    Rows with equal doc_id and text have equal results, texts that share a
    doc_id but differ have each their own; rows without doc_id are left out. No
    items: nothing is contaminated.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    hits = (
        occurrences(docs, items, length, limit)
        .groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select("doc_id", "mark", covered(F.col("spans")).alias("n_hit"), "items")
    )
    met = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(words(F.col("text"))).cast("long").alias("n_words")).join(hits, ["doc_id", "mark"], "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return met.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), found.alias("items"),
    )
