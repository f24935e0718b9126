"""Record types. One rule for absent values: names default to "", lists to [], other fields to null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
AUTHOR = T.StructType(
    [
        T.StructField("firstName", T.StringType()),
        T.StructField("middleNames", STRINGS),
        T.StructField("lastName", T.StringType()),
        T.StructField("suffixes", STRINGS),
        T.StructField("emails", STRINGS),
        T.StructField("institutions", STRINGS),
    ]
)
VENUE = T.StructType([T.StructField("name", T.StringType())])
MENTION = T.StructType(
    [
        T.StructField("mentionId", T.StringType()),
        T.StructField("entityId", T.StringType()),
        T.StructField("goldEntityId", T.StringType()),
        T.StructField("self", AUTHOR),
        T.StructField("coauthors", T.ArrayType(AUTHOR)),
        T.StructField("title", T.StringType()),
        T.StructField("titleEmbeddingKeywords", STRINGS),
        T.StructField("topics", STRINGS),
        T.StructField("text", T.StringType()),
        T.StructField("tokenizedText", STRINGS),
        T.StructField("venues", T.ArrayType(VENUE)),
        T.StructField("keywords", STRINGS),
        T.StructField("canopies", STRINGS),
        T.StructField("canopy", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
GENERIC_CANOPY, UNKNOWN_SOURCE = "GENERIC_CANOPY", "UNK_SOURCE"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def author(first: Column | None = None, middles: Column | None = None, last: Column | None = None, suffixes: Column | None = None, emails: Column | None = None, institutions: Column | None = None) -> Column:
    """An author struct; what is missing or null becomes "" or []."""
    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    many = lambda c: F.coalesce(c, no_strings()) if c is not None else no_strings()
    return F.struct(text(first).alias("firstName"), many(middles).alias("middleNames"), text(last).alias("lastName"), many(suffixes).alias("suffixes"), many(emails).alias("emails"), many(institutions).alias("institutions"))


def complete_author(a: Column) -> Column:
    return author(a["firstName"], a["middleNames"], a["lastName"], a["suffixes"], a["emails"], a["institutions"])


def complete(df: DataFrame) -> DataFrame:
    """A frame with all mention columns, typed, absent values by the rule above."""
    have, out = set(df.columns), []
    for f in MENTION.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name == "self":
            c = complete_author(c)
        elif f.name == "coauthors":
            c = F.transform(F.coalesce(c, F.array().cast(f.dataType)), complete_author)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif f.name in ("canopy", "source"):
            c = F.coalesce(c, F.lit(GENERIC_CANOPY if f.name == "canopy" else UNKNOWN_SOURCE))
        out.append(c.alias(f.name))
    return df.select(*out, *(c for c in df.columns if c not in MENTION.fieldNames()))
