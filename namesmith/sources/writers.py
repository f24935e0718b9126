"""Writers. Folders are overwritten, so results of an earlier run never mix in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.plans.storage import cut, remove


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def store(df: DataFrame, path: str, key: str = "mentionId") -> None:
    """Parquet store of mentions, one row per id; a repeated id fails the write. The input is evaluated once."""
    rows = cut(df, "store")
    twice = rows.groupBy(key).count().where("count > 1").first()
    if twice:
        remove(rows)
        raise ValueError(f"repeated {key}: {twice[key]}")
    rows.write.mode("overwrite").parquet(path)
    remove(rows)


def bucketed_store(df: DataFrame, name: str, path: str, buckets: int, key: str = "mentionId") -> None:
    """A store as the table ``name`` at ``path``, dealt to buckets by id: joins on the id read it as it lies, without a shuffle. A repeated id fails the write."""
    rows = cut(df, "store")
    twice = rows.groupBy(key).count().where("count > 1").first()
    if twice:
        remove(rows)
        raise ValueError(f"repeated {key}: {twice[key]}")
    # Dealt before the write, so that each bucket is one file.
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    remove(rows)


def task_lines(tasks: DataFrame) -> DataFrame:
    """name, tab, comma-joined ids; names with a tab and ids with a comma fail."""
    bad = F.col("canopy").contains("\t") | F.exists("mention_ids", lambda x: x.contains(","))
    line = F.concat_ws("\t", "canopy", F.array_join("mention_ids", ","))
    return tasks.select(F.when(bad, F.raise_error(F.concat(F.lit("not a task name: "), F.col("canopy")))).otherwise(line).alias("value"))


def write_tasks(tasks: DataFrame, path: str) -> None:
    task_lines(tasks).write.mode("overwrite").text(path)


def prefix(name: Column) -> Column:
    """Folder of a result: the first seven characters of a name safe in paths, else misc."""
    return F.when(name.rlike(r"^[A-Za-z0-9_.-]+$"), F.substring(name, 1, 7)).otherwise("misc")


def write_clusters(clusters: DataFrame, path: str, by: str | None = None) -> None:
    """mention_id, entity_id as TSV; by: a column whose prefix becomes the folder."""
    if by:
        clusters.select("mention_id", "entity_id", prefix(F.col(by)).alias("prefix")).write.mode("overwrite").partitionBy("prefix").csv(path, sep="\t")
    else:
        clusters.select("mention_id", "entity_id").orderBy("mention_id").write.mode("overwrite").csv(path, sep="\t")


def keyword_lines(df: DataFrame, key: str, values: str) -> DataFrame:
    return df.select(F.concat_ws("\t", F.concat(F.array(F.col(key)), F.col(values))).alias("value"))


def text_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def debug_columns(m: DataFrame) -> DataFrame:
    """First, middles, last, coauthors, institutions, title, keywords as joined text."""
    some = lambda c: F.filter(c, lambda x: x != "")
    return m.select(
        "mentionId", F.col("self.firstName").alias("first"), F.array_join(some("self.middleNames"), ",").alias("middles"), F.col("self.lastName").alias("last"), F.array_join(some(F.transform("coauthors", lambda a: a["lastName"])), ",").alias("coauthors"),
        F.array_join(some("self.institutions"), ",").alias("institutions"), F.coalesce("title", F.lit("")).alias("title"), F.array_join(some("keywords"), ",").alias("keywords"),
    )
