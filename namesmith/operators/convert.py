"""Records to mentions, and records to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions.names import is_empty, normalized, same_name
from namesmith.functions.text import non_empty, none_if_empty, remove_punctuation, split_trimmed, stop_words, trim_ends, without
from namesmith.schema import complete, no_strings


def looked_up(df: DataFrame, side: DataFrame | None, key: str, name: str) -> DataFrame:
    """Left join of a (key, values) frame; absent keys have no values."""
    if side is None:
        return df.withColumn(name, no_strings())
    lists = side.select(F.col(side.columns[0]).alias(key), F.col(side.columns[1]).alias(name))
    return df.join(lists, key, "left").withColumn(name, F.coalesce(name, no_strings()))


def title_tokens(title: Column, drop_stop_words: bool = False) -> Column:
    tokens = F.transform(split_trimmed(F.coalesce(title, F.lit("")), r"\s+"), lambda t: F.lower(remove_punctuation(t)))
    return without(tokens, stop_words()) if drop_stop_words else tokens


def text_tokens(text: Column) -> Column:
    return non_empty(F.split(remove_punctuation(F.lower(F.coalesce(text, F.lit(""))), " "), " "))


def paper_to_mention(rows: DataFrame, topics: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Author rows of papers to mentions: names normalised, title and text tokens, topics and keywords by mentionId, the paper's venue."""
    df = looked_up(looked_up(rows, topics, "mentionId", "topics"), keywords, "mentionId", "keywords")
    text = none_if_empty(trim_ends(F.coalesce("abstractText", F.lit(""))))
    return complete(
        df.select(
            "mentionId", normalized(F.col("self")).alias("self"), F.transform("coauthors", lambda a: normalized(a)).alias("coauthors"), "title", title_tokens(F.col("title")).alias("titleEmbeddingKeywords"), "topics", text.alias("text"),
            text_tokens(text).alias("tokenizedText"), F.transform(non_empty(F.col("venues")), lambda v: F.struct(v.alias("name"))).alias("venues"), "keywords",
        )
    )


def others(self: Column, people: Column) -> Column:
    """Normalised non-empty people other than self, each name once."""
    names = F.filter(F.transform(people, lambda a: normalized(a)), lambda a: ~is_empty(a) & ~same_name(a, self))
    start = F.slice(names, F.lit(1), F.lit(0))
    return F.aggregate(names, start, lambda seen, a: F.when(F.exists(seen, lambda b: same_name(a, b)), seen).otherwise(F.concat(seen, F.array(a))))


def record_to_mention(rows: DataFrame, topics: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Tagged-text records to mentions; gold entity and canopy come along."""
    df = looked_up(looked_up(rows, topics, "id", "topics"), keywords, "id", "found")
    self = normalized(F.col("authorInFocus")).withField("emails", non_empty(F.transform("emails", lambda x: trim_ends(x)))).withField("institutions", non_empty(F.transform("institutions", lambda x: trim_ends(x))))
    title = F.coalesce("title", "altTitle", F.lit(""))
    text = none_if_empty(trim_ends(F.coalesce("abstractText", F.lit(""))))
    venues = F.transform(non_empty(F.concat("venue", "journal")), lambda v: F.struct(v.alias("name")))
    return complete(
        df.where("authorInFocus is not null").select(
            F.col("id").alias("mentionId"), F.col("groundTruth").alias("goldEntityId"), self.alias("self"), others(self, F.concat("authorlist", "altAuthorlist")).alias("coauthors"), title.alias("title"), title_tokens(title, True).alias("titleEmbeddingKeywords"),
            "topics", text.alias("text"), text_tokens(text).alias("tokenizedText"), venues.alias("venues"), non_empty(F.transform(F.concat("keyword", "found"), lambda x: trim_ends(x))).alias("keywords"), "canopy",
        )
    )


def record_text(*fields: Column, lower: bool = True, punctuation: str | None = " ") -> Column:
    """Fields joined by a space, punctuation replaced (None: kept), lower-cased if asked for."""
    text = F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields))
    text = remove_punctuation(text, punctuation) if punctuation is not None else text
    return F.lower(text) if lower else text


def training_text(df: DataFrame) -> DataFrame:
    """Title and text of mentions as lines: trimmed, without punctuation, lower-cased, none empty."""
    joined = trim_ends(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    return df.select(joined.alias("t")).where("t <> ''").select(F.lower(remove_punctuation(F.col("t"))).alias("text"))


def record_lines(rows: DataFrame) -> DataFrame:
    """Up to four training lines a record: title, altTitle, abstract, body."""
    return rows.select(F.explode(F.array_compact(F.array("title", "altTitle", "abstractText", "body"))).alias("t")).select(F.lower(remove_punctuation(trim_ends(F.col("t")))).alias("text")).where("text <> ''")
