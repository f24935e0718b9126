"""Blocks of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesmith.functions.canopies import Canopy
from namesmith.functions.names import Processor, identity


def assign(mentions: DataFrame, canopy: Canopy, processor: Processor = identity, column: str = "canopy") -> DataFrame:
    """Adds a mention's block, from its processed name."""
    return mentions.withColumn("_name", processor(F.col("self"))).withColumn(column, canopy(F.col("_name"))).drop("_name")


def restrict(mentions: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Only the listed ids, if a list is given."""
    return mentions if ids is None else mentions.join(ids.select(F.col(ids.columns[0]).alias("mentionId")), "mentionId", "left_semi")


def tasks(mentions: DataFrame, canopy: Canopy, processor: Processor = identity, ids: DataFrame | None = None) -> DataFrame:
    """(canopy, mention_ids ascending, n), largest first. A task file lists ids, so each block is one row by definition; clustering never reads blocks this way."""
    named = assign(restrict(mentions, ids), canopy, processor)
    grouped = named.groupBy("canopy").agg(F.sort_array(F.collect_list("mentionId")).alias("mention_ids"), F.count("*").alias("n"))
    return grouped.orderBy(F.desc("n"), "canopy")


def fetch(task_rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """The mentions of tasks, one row per task and id; an unknown id has none, of a repeated one any row counts."""
    ids = task_rows.select("canopy", F.explode("mention_ids").alias("mentionId"))
    return ids.join(mentions.dropDuplicates(["mentionId"]).drop("canopy"), "mentionId")


def block_sizes(mentions: DataFrame, canopy: Canopy) -> DataFrame:
    """(canopy, n, pairs): what pairing each block would cost."""
    return assign(mentions, canopy).groupBy("canopy").agg(F.count("*").alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2"))
