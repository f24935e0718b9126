"""Repeated windows of a corpus, found without a row per window.

A document's n-token windows are packed into runs that share their least
k-token seed (``kernels.winnow``). Equal windows share a seed and their
distance from it, and runs with equal tokens hold equal windows, so three
passes find every repeated window, each finer than the last:

1. Runs are sorted by seed. A seed that occurs once ends here.
2. Under a seed, runs are sorted by all their tokens. All but the earliest of
   equal runs are repeats as a whole. Where a seed has unequal runs, the
   earliest of each kind go on.
3. These are split into blocks of windows and sorted by the tokens that all
   windows of a block share (skipped for blocks of one); blocks that meet no
   equal are done, the others are split into windows, which are sorted too.

Equality is decided on two 64-bit hashes of different bases: in the second pass
those of the seed and of the run, in the third two of the same tokens. Every
pass is one shuffle and a sort; groups are read as streams, so a group need not
fit in memory, and no pass makes more rows than it reads.

A seed that fills much of a shuffle partition (``hot_seeds``) is spread: its
runs go by all their tokens and a salt of the document, and what each salt
can't settle, one document's rows at most, is compared once more without it.

Rows with equal doc_id and text are one document and share its spans. Texts
that share a doc_id but differ are documents of their own, in order of the hash
of their text (``mark``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from namesmith.llm import kernels
from namesmith.plans.storage import cut, remove, small_batches

RUNS = "seed long, whole long, doc_id long, mark long, lo int, hi int, at int, more array<int>"
BLOCKS = "h1 long, h2 long, doc_id long, mark long, lo int, hi int, at int, hot int"
PLACE = ["doc_id", "mark", "lo"]
#: One of SAMPLED documents is looked at for hot seeds: those with LEAST rows there that fill one in HOT of a shuffle partition.
SAMPLED, LEAST, HOT, SALTS = 64, 64, 4, 32


def texts(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, text and mark, a hash that tells texts of one doc_id apart (0 where no doc_id repeats). Rows without doc_id name no document and are left out."""
    own = small_batches(docs).select(F.col("doc_id").cast("long"), "text", *carry).where(F.col("doc_id").isNotNull())
    unique = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return own.withColumn("mark", F.lit(0).cast("long") if unique else F.xxhash64("text"))


def ints(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(x.astype(np.int32)) for x in columns]


def runs(docs: DataFrame, kind: str, n: int, k: int, apart: bool) -> DataFrame:
    """One row per distinct run of a document; ``more`` has the further starts of equal runs in it, if any.

    Without this, a text that repeats one word would put all its rows under one
    seed. apart: these further starts come in rows of their own, under seeds
    that nothing else has, for where they repeat their document anyway.
    """
    names = RUNS.replace(",", "").split()[::2]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text"))):
                one, two, at, _ = kernels.tokens_of(kind, buf, offs)
                seed, whole, doc, lo, hi, start = kernels.winnow(one, two, at, n, k)
                if len(seed):
                    keep, more = kernels.first_of_equal(kernels.mix(whole + kernels.mix(doc.astype(np.uint64))), lo)
                    seed, whole, own, mark, lo, hi, start = seed[keep], whole[keep], ids[first + doc[keep]], marks[first + doc[keep]], lo[keep], hi[keep], start[keep]
                    row = lambda m, seed: pa.RecordBatch.from_arrays([kernels.signed(seed[m]), kernels.signed(whole[m]), pa.array(own[m]), pa.array(mark[m]), *ints(lo[m], hi[m], start[m]), more], names=names)  # noqa: B023, E731
                    if apart and more.null_count < len(more):
                        m = np.flatnonzero(more.is_valid().to_numpy(zero_copy_only=False))
                        more = more.filter(more.is_valid())
                        yield row(m, kernels.mix(seed ^ kernels.mix((own ^ mark).view(np.uint64) + kernels.mix(whole.copy()))))
                        more = pa.nulls(len(keep), pa.list_(pa.int32()))
                    yield row(slice(None), seed)

    return docs.mapInArrow(emit, RUNS)


def blocks(docs: DataFrame, places: DataFrame, kind: str, n: int, block: int) -> DataFrame:
    """The blocks of the given runs (doc_id, mark, lo, hi, at, hot), by what their windows share."""
    names = BLOCKS.replace(",", "").split()[::2]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            cuts, lo, hi, seed, hot = kernels.structs(batch.column("spans"), "lo", "hi", "at", "hot")
            for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text"))):
                own = cuts[first : first + len(offs)]
                rows = slice(own[0], own[-1])
                if own[-1] > own[0]:
                    one, two, at, _ = kernels.tokens_of(kind, buf, offs)
                    doc = np.repeat(np.arange(len(offs) - 1), np.diff(own))
                    h1, h2, doc, *found = kernels.cores(one, two, at, doc, (lo[rows], hi[rows], seed[rows], hot[rows]), n, block)
                    yield pa.RecordBatch.from_arrays([kernels.signed(h1), kernels.signed(h2), pa.array(ids[first + doc]), pa.array(marks[first + doc]), *ints(*found)], names=names)

    return docs.join(by_document(places, "lo", "hi", "at", "hot"), ["doc_id", "mark"]).mapInArrow(emit, BLOCKS)


def by_document(found: DataFrame, *columns: str) -> DataFrame:
    """A document's spans in one row; their number is bounded by its length, as repeated rows add none."""
    return found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct(*columns)).alias("spans"))


def hot_seeds(docs: DataFrame, kind: str, n: int, k: int) -> DataFrame | None:
    """Seeds that fill much of a shuffle partition, by a sample of documents; none if there are none.

    Only how work is dealt depends on them. There are at most HOT a partition.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(SAMPLED)) == 0)
    counts = cut(runs(some, kind, n, k, False).groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST), "seeds")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where(F.col("n") * HOT * partitions > total).select("seed", F.lit(1).alias("hot"))
    return None if hot.isEmpty() else hot


def later(window: WindowSpec, earlier: str) -> Column:
    """Whether a row has an earlier equal: any in place order, or one of a smaller document. Rows of one place aren't later than each other."""
    if earlier == "place":
        return ~reduce(and_, (F.col(c) == F.first(c).over(window) for c in PLACE))
    return F.col("doc_id") > F.first("doc_id").over(window)


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + 1).otherwise(0))


def several(rows: DataFrame, any_hot: bool) -> DataFrame:
    """Those rows whose core (h1, h2) is found in other rows too."""
    own = Window.partitionBy("h1", "h2", "salt")
    local = salted(rows).withColumn("n", F.count("*").over(own))
    if not any_hot:
        return local.where("n > 1")
    local = cut(local.withColumn("head", F.row_number().over(own.orderBy(*PLACE)) == 1).where("n > 1 or hot = 1"), "blocks")
    over = local.where("hot = 1 and head").withColumn("m", F.count("*").over(Window.partitionBy("h1", "h2"))).where("m > 1 or n > 1").drop("m")
    return local.where("hot = 0 or not head").unionByName(over)


def repeated(rows: DataFrame, earlier: str, any_hot: bool) -> DataFrame:
    """Those rows (windows h1, h2) that have an earlier equal."""
    local = salted(rows).withColumn("again", later(Window.partitionBy("h1", "h2", "salt").orderBy(*PLACE), earlier))
    if not any_hot:
        return local.where("again")
    local = cut(local.where("again or hot = 1"), "windows")
    over = local.where("not again").withColumn("again", later(Window.partitionBy("h1", "h2").orderBy(*PLACE), earlier))
    return local.where("again").unionByName(over.where("again"))


def spans(docs: DataFrame, kind: str, n: int, k: int, earlier: str, block: int = 1) -> DataFrame:
    """Token spans [lo, hi) covered by windows that also start earlier, with doc_id and mark.

    docs are ``texts``. earlier is 'place' (a smaller document, or an earlier
    start in the same one) or 'document' (a smaller doc_id only).
    """
    found = runs(docs, kind, n, k, earlier == "place")
    hot = hot_seeds(docs, kind, n, k)
    if hot is None:
        found = found.withColumn("hot", F.lit(0)).withColumn("spread", F.lit(0).cast("long"))
    else:
        found = found.join(F.broadcast(hot), "seed", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
        found = found.withColumn("spread", F.when(F.col("hot") == 1, F.xxhash64("whole", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))).otherwise(0))
    seed = Window.partitionBy("seed", "spread")
    equal = Window.partitionBy("seed", "spread", "whole").orderBy(*PLACE)
    # A hot seed has unequal runs, or has few runs left to look at.
    mixed = (F.min("whole").over(seed) != F.max("whole").over(seed)) | (F.col("hot") == 1)
    met = cut(
        found.withColumn("again", later(equal, earlier))
        .withColumn("head", F.row_number().over(equal) == 1)
        .withColumn("mixed", mixed)
        .where(F.col("again") | F.col("more").isNotNull() | F.col("head") & F.col("mixed"))
        .select(*PLACE, "hi", "at", "again", "more", "hot", (F.col("head") & F.col("mixed") & ~F.col("again")).alias("open"), *(F.when(F.col("hot") == 1, F.col(c)).alias(c) for c in ("seed", "whole"))),
        f"{kind}-runs",
    )
    if hot is not None:
        over = Window.partitionBy("seed", "whole").orderBy(*PLACE)
        top = met.where("hot = 1 and not again").withColumn("again", later(over, earlier)).withColumn("open", ~F.col("again") & (F.row_number().over(over) == 1))
        first, met = met, cut(met.where("hot = 0 or again").unionByName(top), f"{kind}-runs")
        remove(first)
    none = F.array().cast("array<int>")
    more = F.coalesce("more", none)
    every = F.concat(F.array("lo"), more)
    # Equal runs of one document: the later ones repeat it, or share the first one's fate.
    known = F.when(F.col("again"), every).otherwise(more if earlier == "place" else none)
    gone = met.select("doc_id", "mark", F.explode(known).alias("start"), (F.col("hi") - F.col("lo") + n).alias("size")).select("doc_id", "mark", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
    still = met.where("open").select("doc_id", "mark", "hot", F.explode(F.array("lo") if earlier == "place" else every).alias("start"), "lo", "hi", "at")
    heads = still.select("doc_id", "mark", F.col("start").alias("lo"), (F.col("start") + F.col("hi") - F.col("lo")).alias("hi"), (F.col("start") + F.col("at") - F.col("lo")).alias("at"), "hot")
    if block > 1:
        heads = several(blocks(docs, heads, kind, n, block), hot is not None).select("doc_id", "mark", "lo", "hi", "at", "hot")
    single = repeated(blocks(docs, heads, kind, n, 1), earlier, hot is not None)
    return gone.unionByName(single.select("doc_id", "mark", "lo", (F.col("lo") + n).alias("hi")))
