"""Profiles of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_values(mentions: DataFrame, attributes: dict[str, Column], entity: str = "goldEntityId", mention: str = "mentionId") -> DataFrame:
    """(attribute, values, shared): how many (value, entity) groups an attribute has, and how many of them have more than one mention."""
    parts = []
    for name, values in attributes.items():
        each = mentions.select(entity, mention, F.explode(values).alias("value")).where("value <> ''")
        groups = each.groupBy("value", entity).agg(F.countDistinct(mention).alias("n"))
        parts.append(groups.agg(F.lit(name).alias("attribute"), F.count("*").alias("values"), F.count_if(F.col("n") > 1).alias("shared")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_profile(pairs: DataFrame, document: str, field: str) -> DataFrame:
    """(field, occurrences, repeated): occurrences in all documents, and documents that have it more than once."""
    each = pairs.groupBy(document, field).agg(F.count("*").alias("n"))
    return each.groupBy(F.col(field).alias("field")).agg(F.sum("n").alias("occurrences"), F.count_if(F.col("n") > 1).alias("repeated"))
