"""Nearest words for many words at once, by cosine: exact in blocks, or by an index of inverted lists.

The exact way reads the store once for each block of queries and keeps the best
of each partition. The index deals all vectors to lists by their nearest centre;
a query looks at the lists of its nearest centres only, where similarities are
exact. Centres, and how many lists make the recall asked for, are fitted on a
bounded sample. Lists are cut into segments, and the queries of a list into
blocks, so a task never holds a list, however many vectors share it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesmith.plans.storage import cut

FOUND = "query string, word string, similarity double"
#: Queries that go to all tasks at once, vectors compared at once, most vectors of a sample, and rows of a segment.
QUERIES, CHUNK, SAMPLE, SEGMENT = 1 << 14, 1024, 1 << 14, 4096


def matrix(column) -> np.ndarray:
    """Unit vectors; zero vectors, and those with null or non-finite entries, become NaN."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.where(np.isfinite(n) & (n > 0), x / n, np.nan)


def top(near: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best of each row, ties by word; words has a row per query or one for all, in ascending order."""
    near = np.where(np.isnan(near), -np.inf, near)
    words = np.broadcast_to(words, near.shape)
    order = np.lexsort((words, -near), axis=-1)[:, :n] if words.strides[0] else np.argsort(-near, axis=-1, kind="stable")[:, :n]
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(words, order, axis=1)


class Best:
    """The n best words of each query so far."""

    def __init__(self, vectors: np.ndarray, n: int) -> None:
        self.vectors, self.n, self.near, self.words = vectors, n, None, None

    def see(self, x: np.ndarray, words: np.ndarray) -> None:
        for at in range(0, len(x), CHUNK):
            order = np.argsort(words[at : at + CHUNK], kind="stable")
            # Rounded, so that equal directions tie whatever the order of additions.
            near, found = top(np.round(self.vectors @ x[at : at + CHUNK][order].T, 12), words[at : at + CHUNK][order], self.n)
            if self.near is not None:
                near, found = top(np.c_[self.near, near], np.c_[self.words, found], self.n)
            self.near, self.words = near, found

    def rows(self, queries: np.ndarray) -> pa.RecordBatch:
        if self.near is None:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.float64())], names=["query", "word", "similarity"])
        q, k = np.nonzero(np.isfinite(self.near))
        return pa.RecordBatch.from_arrays([pa.array(queries[q], pa.string()), pa.array(self.words[q, k].astype(str), pa.string()), pa.array(self.near[q, k])], names=["query", "word", "similarity"])


def strings(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=str)


def ranked(found: DataFrame, n: int) -> DataFrame:
    """(query, rank, word, similarity)."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "word"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select("query", "rank", "word", "similarity")


def usable(store: DataFrame) -> DataFrame:
    return store.select(F.col("word").cast("string").alias("word"), F.col("vec").cast("array<double>").alias("vec")).where("word is not null and vec is not null and size(vec) > 0")


def nearest_exact(queries: DataFrame, keystore: DataFrame, n: int = 10, block: int = QUERIES) -> DataFrame:
    """(query, rank, word, similarity): the n nearest words of each word in queries (word, vec), itself included.

    Equal similarities rank by word. Words without a vector, zero vectors and those
    with null or non-finite entries are neither found nor have neighbours; a word
    that queries repeat counts once. Vectors are all of one length. The store is
    read once for each ``block`` queries.
    """
    asked = cut(usable(queries).dropDuplicates(["word"]), "queries")
    parts = max(1, -(-asked.count() // block))
    found = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part).orderBy("word").toArrow()
        names, vectors = strings(own["word"]), matrix(own["vec"].combine_chunks())
        held = keystore.sparkSession.sparkContext.broadcast((names, vectors))

        def emit(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, vectors = held.value
            best = Best(vectors, n)
            for batch in batches:
                if len(names):
                    best.see(matrix(batch.column("vec")), strings(batch.column("word")))
            yield best.rows(names)

        some = usable(keystore).mapInArrow(emit, FOUND)
        found = some if found is None else found.unionByName(some)
    return ranked(found, n)


@dataclass(frozen=True)
class Index:
    """Centres, how many lists a query looks at, and all vectors as (list, segment, word, vec)."""

    centres: np.ndarray
    probes: int
    rows: DataFrame

    def search(self, queries: DataFrame, n: int = 10, probes: int | None = None) -> DataFrame:
        """As ``nearest_exact``, with what the lists of the ``probes`` nearest centres hold; as many as there are centres: exact."""
        probes = min(probes or self.probes, len(self.centres))
        near = assigned(usable(queries).dropDuplicates(["word"]), self.centres, probes)
        sizes = self.rows.groupBy("list").agg((F.max("segment") + 1).alias("segments"))
        asked = near.groupBy("list").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("blocks"))
        plan = sizes.join(asked, "list")
        q = near.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"), F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "word", "vec")
        x = self.rows.join(plan, "list").select("list", "segment", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "vec")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            best = Best(matrix(left["vec"].combine_chunks()), n)
            if len(left) and len(right):
                best.see(matrix(right["vec"].combine_chunks()), strings(right["word"]))
            return pa.Table.from_batches([best.rows(strings(left["word"]))])

        keys = ["list", "segment", "block"]
        return ranked(q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(meet, FOUND), n)


def assigned(rows: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(list, word, vec): each row with its nearest centres; rows without direction are left out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = matrix(batch.column("vec")) @ centres.T
            good = np.flatnonzero(np.isfinite(near[:, 0]))
            lists = np.argsort(-near[good], axis=1, kind="stable")[:, :probes]
            some = pa.array(np.repeat(good, lists.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column("word").take(some), batch.column("vec").take(some)], names=["list", "word", "vec"])

    return rows.mapInArrow(emit, "list int, word string, vec array<double>")


def centred(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means: unit centres."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, recall: float, n: int) -> int:
    """How many lists hold the share ``recall`` of the n nearest of sampled vectors."""
    own, order = (x @ centres.T).argmax(axis=1), np.argsort(-(x @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(x), axis=0), axis=1)
    held = np.zeros(len(centres))
    for at in range(0, len(x), CHUNK):
        near = np.argpartition(-(x[at : at + CHUNK] @ x.T), min(n, len(x)) - 1, axis=1)[:, :n]
        held += np.bincount(np.take_along_axis(place[at : at + CHUNK], own[near], axis=1).ravel(), minlength=len(centres))
    return int(np.searchsorted(np.cumsum(held) / held.sum(), recall) + 1)


def build(keystore: DataFrame, lists: int | None = None, recall: float = 0.97, n: int = 10, sample: int = SAMPLE, rounds: int = 8, seed: int = 1) -> Index | None:
    """An index of all of (word, vec); none if no vector has a direction.

    Centres (by default the root of the sample's size) come from at most
    ``sample`` vectors, those of least hash. ``recall`` is what the lists that a
    query looks at hold of the sample's n nearest.
    """
    rows = usable(keystore)
    some = matrix(rows.orderBy(F.xxhash64("word"), "word").limit(sample).toArrow()["vec"].combine_chunks())
    some = some[np.isfinite(some).all(axis=1)]
    if not len(some):
        return None
    centres = centred(some, min(len(some), lists or max(1, round(len(some) ** 0.5))), rounds, seed)
    dealt = cut(assigned(rows, centres), "lists")
    sizes = dealt.groupBy("list").agg(F.ceil(F.count("*") / SEGMENT).alias("n"))
    # One row per centre: at most the root of the sample's bound.
    segments = dealt.join(F.broadcast(sizes), "list").withColumn("segment", F.pmod(F.xxhash64("word"), F.col("n")).cast("int")).drop("n")
    return Index(centres, probes_for(some, centres, recall, n), segments)
