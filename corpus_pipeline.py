"""From raw documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesmith.llm import decontaminate, minhash, packing, substring_dedup, toxicity
from namesmith.llm.langid import fold
from namesmith.plans.storage import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all else in one column, so that no name can clash with an operator's."""
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("rest"))


def restored(df: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of documents; n_chars follows the text where that has changed."""
    own = {"doc_id": F.col("doc_id"), "text": F.col(text)}
    if text != "text":
        own["n_chars"] = F.length(text).cast("long")
    return df.select(*(own.get(c, F.col("rest").getField(c)).alias(c) for c in columns))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it learns on labels outside the held-out fold.

    Null and empty texts are kept, as is every document if no label is toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
    return restored(toxicity.score(bundled(docs), toxicity.fit(docs, labels)).where("predicted = 0"), docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near duplicates.

    Near duplicates share 80 % of their shingles. Rows with equal doc_id and
    text are one document, of which one row is kept; of linked texts with one
    doc_id too. Documents without words stand alone and are kept; rows without
    doc_id go.
    """
    rows = bundled(docs).withColumn("mark", F.xxhash64("text"))
    kept = minhash.near_duplicates(rows, percent=80).where("kept")
    alone = kept.where("component is null").select("doc_id", "mark")
    grouped = kept.where("component is not null").groupBy("doc_id", "component").agg(F.min("mark").alias("mark")).select("doc_id", "mark")
    left = rows.join(alone.union(grouped).hint("merge"), ["doc_id", "mark"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("rest"))
    return restored(left.withColumn("nth", first).where("nth = 1"), docs.columns)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents that are all such passages go.

    Texts that lose nothing stay as they are; a null text becomes empty.
    """
    left = substring_dedup.dedup_words(bundled(docs), carry=("rest",)).where("n_removed < n_words or n_words = 0")
    return restored(left, docs.columns, "kept")


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark window; without items none goes.

    Texts that share a doc_id are judged each on its own, and so are rows
    without doc_id.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.occurrences(docs, items).select(F.col("doc_id").alias("id"), "mark").distinct()
    rows = bundled(docs).withColumn("own", F.xxhash64("text"))
    return restored(rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("mark")), "left_anti"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes and packs what is left; an empty text is an end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("substrings", passages_out),
    ("benchmark", benchmark_out),
    ("packing", packed),
]

#: The stages learn a model, hash and tokenize; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
