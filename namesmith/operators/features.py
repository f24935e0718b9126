"""Feature rows: bags of words and mean embeddings of mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions.text import non_empty, stop_words, without
from namesmith.functions.vectors import bag


def mention_bags(mentions: DataFrame) -> DataFrame:
    """One row per mention: id, canopy, ten bags. Empty strings never count."""
    one = lambda c: bag(non_empty(F.array(c)))
    many = lambda c: bag(non_empty(c))
    return mentions.select(
        "mentionId", "canopy", one(F.col("self.firstName")).alias("firstNames"), many(F.col("self.middleNames")).alias("middleNames"), one(F.col("self.lastName")).alias("lastNames"), many(F.col("self.emails")).alias("emails"),
        many(F.col("self.institutions")).alias("institutions"), many(F.transform("coauthors", lambda a: a["lastName"])).alias("coauthors"), many(F.col("topics")).alias("topics"), many(F.col("tokenizedText")).alias("text"),
        many(F.col("keywords")).alias("keywords"), many(F.transform("venues", lambda v: v["name"])).alias("venues"),
    )


def token_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, n)."""
    return df.select(key, F.explode(non_empty(tokens)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def merged_bags(df: DataFrame, entity: str, bags: str) -> DataFrame:
    """(entity, bag): the sum of all bags of an entity, combined token by token."""
    sums = df.select(entity, F.explode(bags).alias("token", "n")).groupBy(entity, "token").agg(F.sum("n").alias("n"))
    return sums.groupBy(entity).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "n")))).alias("bag"))


def pooled(df: DataFrame, key: str, words: str, keystore: DataFrame, dim: int, mean: bool = True) -> DataFrame:
    """(key, vec): mean (or sum) of the vectors of a row's words that the keystore has; zeros if none.

    The keystore joins as any table: Spark broadcasts it where its size allows.
    """
    each = df.select(key, F.explode(words).alias("word")).join(keystore, "word")
    # A row per key and word, not one for each dimension too.
    pool = F.avg if mean else F.sum
    found = each.groupBy(key).agg(*(pool(F.get("vec", F.lit(i))).alias(f"x{i}") for i in range(dim))).select(key, F.array(*(F.col(f"x{i}") for i in range(dim))).alias("vec"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def title_vectors(mentions: DataFrame, keystore: DataFrame, dim: int) -> DataFrame:
    words = mentions.select("mentionId", without(F.col("titleEmbeddingKeywords"), stop_words()).alias("words"))
    return pooled(words, "mentionId", "words", keystore, dim)


def nearest(keystore: DataFrame, word: str, n: int) -> DataFrame:
    """(word, similarity): the n nearest words by cosine, the word itself included; an unknown word has none."""
    from namesmith.functions.vectors import cosine

    found = keystore.where(F.col("word") == word).select("vec").limit(1).first()
    if not found:
        return keystore.select("word", F.lit(0.0).alias("similarity")).limit(0)
    query = F.array(*(F.lit(float(x)) for x in found["vec"]))
    return keystore.select("word", cosine(F.col("vec"), query).alias("similarity")).where(~F.isnan("similarity")).orderBy(F.desc("similarity"), "word").limit(n)
