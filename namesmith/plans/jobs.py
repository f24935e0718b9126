"""End-to-end jobs: ingest, block, resolve, experiment. Parameters are a dataclass."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import canopies as canopy_functions
from namesmith.functions import names
from namesmith.operators import blocking, convert, evaluate, hierarchy, pairwise, report
from namesmith.sources import bibtex, readers, writers


@dataclass(frozen=True)
class Options:
    """What the jobs read. Canopies go from fine to coarse."""

    canopies: tuple[str, ...] = canopy_functions.DEFAULT
    processor: str = "CaseInsensitiveReEvaluating"
    model: hierarchy.Model = field(default_factory=hierarchy.Model)
    rule: str = "hierarchical"
    largest_block: int = 2000


#: Weights for records of publications with e-mails and institutions, as an example of tuning.
TUNED = hierarchy.Model(
    names={"firstNames": hierarchy.Name(20, 10, 1, 40, 25), "middleNames": hierarchy.Name(10, 10, 1, 40, 0)},
    bags={"emails": hierarchy.Bag(20), "institutions": hierarchy.Bag(4, -0.2, 2), "coauthors": hierarchy.Bag(2, -0.5, 0.7), "keywords": hierarchy.Bag(2, -0.5, 1)},
    title=hierarchy.Bag(6, -0.4),
    most_steps=400_000,
)


def ingest_json(spark: SparkSession, paths: str, store: str) -> None:
    writers.store(readers.json_mentions(spark, paths), store)


def ingest_papers(spark: SparkSession, folder: str, store: str, topics: str | None = None, keywords: str | None = None, encoding: str | None = None) -> None:
    side = lambda p: readers.tsv_lists(spark, p) if p else None
    rows = readers.paper_mentions(readers.tei_papers(spark, folder, encoding))
    writers.store(convert.paper_to_mention(rows, side(topics), side(keywords)), store)


def convert_papers(spark: SparkSession, folder: str, out: str, topics: str | None = None, keywords: str | None = None, encoding: str | None = None) -> None:
    """Paper headers to mention JSON, a line per mention."""
    side = lambda p: readers.tsv_lists(spark, p) if p else None
    writers.json_lines(convert.paper_to_mention(readers.paper_mentions(readers.tei_papers(spark, folder, encoding)), side(topics), side(keywords)), out)


def convert_bibtex(spark: SparkSession, folder: str, out: str, pattern: str = "*.bib") -> None:
    """BibTeX files to mention JSON, a line per mention; files that don't parse are left out (``bibtex.failures`` lists them)."""
    writers.json_lines(bibtex.mentions(bibtex.entries(spark, folder, pattern)), out)


def ingest_bibtex(spark: SparkSession, folder: str, store: str) -> None:
    writers.store(bibtex.mentions(bibtex.entries(spark, folder)), store)


def make_tasks(mentions: DataFrame, options: Options = Options(), ids: DataFrame | None = None) -> DataFrame:
    """Blocks of the coarsest canopy, largest first."""
    return blocking.tasks(mentions, canopy_functions.from_name(options.canopies[-1]), names.from_name(options.processor), ids)


def resolve(mentions: DataFrame, options: Options = Options(), keystore: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """(mention_id, entity_id), renumbered. rule: hierarchical, baseline or deterministic."""
    levels = [canopy_functions.from_name(c) for c in options.canopies]
    process = names.from_name(options.processor)
    if options.rule == "hierarchical":
        return evaluate.renumber(hierarchy.resolve(mentions, levels, options.model, process, keystore, dim, options.largest_block))
    rule = {"baseline": pairwise.baseline, "deterministic": pairwise.deterministic}[options.rule]
    named = mentions.withColumn("self", process(F.col("self"))).withColumn("coauthors", F.transform("coauthors", lambda a: process(a)))
    return evaluate.renumber(pairwise.resolve_pairwise(blocking.assign(named, levels[-1]), rule))


def experiment(mentions: DataFrame, out: str, options: Options = Options(), keystore: DataFrame | None = None, dim: int = 0, html: bool = False) -> DataFrame:
    """Resolve mentions that have goldEntityId; write clusterings, scores and times to ``out``; returns the scores row."""
    spark, began = mentions.sparkSession, time.time()
    writers.write_clusters(resolve(mentions, options, keystore, dim), f"{out}/predicted")
    taken = time.time() - began
    predicted = readers.tsv_pairs(spark, f"{out}/predicted", ("mention_id", "entity_id"))
    gold = mentions.where("goldEntityId is not null").select(F.col("mentionId").alias("mention_id"), F.col("goldEntityId").alias("entity_id"))
    writers.write_clusters(gold, f"{out}/gold")
    own = evaluate.restricted(predicted, gold)
    scores = evaluate.side_by_side(evaluate.pairwise_scores(own, gold), evaluate.cluster_scores(own, gold))
    scores.write.mode("overwrite").json(f"{out}/scores")
    writers.text_lines(spark.createDataFrame([(f"coreference\t{int(1000 * taken)}",)], "value string"), f"{out}/timing")
    if html:
        report.cluster_page(own, mentions).write.mode("overwrite").json(f"{out}/clusters-html")
        outcomes = evaluate.pair_outcomes(own, gold)
        for kind in ("fp", "fn"):
            report.pair_page(outcomes, mentions, kind).write.mode("overwrite").json(f"{out}/{kind}-html")
    return spark.read.json(f"{out}/scores")


def score_files(spark: SparkSession, predicted: str, gold: str) -> DataFrame:
    """Scores of two clustering files, predictions restricted to gold points."""
    p, g = (readers.tsv_pairs(spark, x, ("mention_id", "entity_id")) for x in (predicted, gold))
    own = evaluate.restricted(p, g)
    return evaluate.side_by_side(evaluate.pairwise_scores(own, g), evaluate.cluster_scores(own, g))
