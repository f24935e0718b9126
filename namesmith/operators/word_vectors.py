"""Word vectors by continuous bag of words with negative sampling.

Each iteration every part of the corpus trains its own copy of the model on the
lines it reads, and the copies are averaged by word, weighted by how often a part
updated it. What tasks hand on are blocks of words, added up in two steps, so
neither a task nor the driver holds more than a model. Lines are dealt to parts by
their content and copies evenly, and random numbers follow from seed, iteration and
part: results don't depend on how the input is partitioned or on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesmith.plans.storage import cut, remove, small_batches

#: Words of a block, words of the corpus in a part, most parts (longer corpora make longer parts), places trained at once, changes of one row that these may add up to, and groups in which parts are added up first.
BLOCK, PART, MOST_PARTS, BATCH, CROWD, GROUPS = 256, 1 << 22, 1024, 128, 8, 32
SUMS = "block int, part int, times array<double>, inner array<float>, outer array<float>"


def contexts(line: np.ndarray, window: int, rng: np.random.Generator) -> np.ndarray:
    """Places around each place, up to a window that is drawn for each; -1 where the line ends or the window does."""
    reach = rng.integers(1, window + 1, len(line))
    steps = np.r_[np.arange(-window, 0), np.arange(1, window + 1)]
    at = np.arange(len(line))[:, None] + steps
    inside = (at >= 0) & (at < len(line)) & (np.abs(steps) <= reach[:, None])
    at = np.where(inside, at, 0)
    return np.where(inside & (line[at] == line[:, None]), at, -1) if len(line) else at


def scatter(matrix: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """matrix[rows] += change, where rows repeat; of a row that more than CROWD changes meet, as much as that many."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    times = np.diff(np.r_[first, len(rows)])
    # Few changes are added one by one, each to many rows at once; sums are made only of the many.
    few = times <= CROWD
    for turn in range(min(CROWD, times.max(initial=0))):
        at = first[few & (times > turn)] + turn
        matrix[rows[at]] += change[order[at]]
    if not few.all():
        ends = np.r_[first[1:], len(rows)]
        for lo, hi in zip(first[~few].tolist(), ends[~few].tolist(), strict=True):
            matrix[rows[lo]] += change[order[lo:hi]].sum(axis=0) * np.float32(CROWD / (hi - lo))


def step(inner: np.ndarray, outer: np.ndarray, around: np.ndarray, words: np.ndarray, rate: float) -> None:
    """One update: rows of around are context words (-1: none), of words the word that stands there and then drawn ones."""
    known = around >= 0
    n = known.sum(axis=1, keepdims=True)
    mean = np.matmul(known[:, None, :].astype(inner.dtype), inner[np.where(known, around, 0)])[:, 0] / n.astype(inner.dtype)
    out = outer[words]
    odds = 1 / (1 + np.exp(-np.clip(np.matmul(out, mean[:, :, None])[:, :, 0], -30, 30)))
    pull = -odds
    pull[:, 0] += 1
    # A drawn word that is the one that stands there teaches nothing.
    pull[:, 1:][words[:, 1:] == words[:, :1]] = 0
    pull = (rate * pull).astype(np.float32)
    back = np.matmul(pull[:, None, :], out)[:, 0]
    scatter(outer, words.ravel(), (pull[:, :, None] * mean[:, None, :]).reshape(-1, mean.shape[1]))
    rows, _ = np.nonzero(known)
    scatter(inner, around[known], back[rows])


def encoded(lines: DataFrame, tokens: str, least: int, vocabulary: int, parts: int | None) -> tuple[DataFrame, list[tuple[str, int]], int]:
    """(part, ids, copies): distinct lines as word numbers, the words with their counts, most frequent first, and how many parts there are.

    The copies of a line are dealt to all parts alike.
    """
    counts = lines.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("word") != ""))
    words = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    parts = parts or min(MOST_PARTS, max(1, -(-sum(n for _, n in words) // PART)))
    # The vocabulary is bounded by the parameter: so is what is broadcast.
    index = lines.sparkSession.sparkContext.broadcast([w for w, _ in words])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(index.value, pa.string())
        for batch in batches:
            line = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(line), 0).to_numpy(zero_copy_only=False)
            ids = pc.index_in(line.flatten(), known)
            on = ids.is_valid().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(on)][np.r_[0, np.cumsum(sizes)]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), ids.drop_null())], names=["ids"])

    found = small_batches(lines).select(F.col(tokens)).mapInArrow(numbered, "ids array<int>")
    kinds = found.where(F.size("ids") > 1).groupBy("ids").agg(F.count("*").alias("n"))
    dealt = kinds.select("ids", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(parts)).cast("int") - 1)).alias("j"))
    copies = F.expr(f"n div {parts}") + (F.col("j") < F.col("n") % parts).cast("int")
    return cut(dealt.select(F.pmod(F.xxhash64("ids") + F.col("j"), F.lit(parts)).cast("int").alias("part"), "ids", copies.alias("copies")), "lines"), words, parts


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and line numbers of about ``most`` words at a time, copies one after the other."""
    held, size = [], 0
    for batch in batches:
        for ids, copies in zip(batch.column("ids").to_numpy(zero_copy_only=False), batch.column("copies").to_pylist(), strict=True):
            for _ in range(copies):
                held.append(ids)
                size += len(ids)
                if size >= most:
                    yield np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
                    held, size = [], 0
    if held:
        yield np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])


def train(lines: DataFrame, parts: int, model: tuple[np.ndarray, np.ndarray], counts: np.ndarray, window: int, negative: int, sample: float, rate: float, seed: int, turn: int, turns: int) -> DataFrame:
    """SUMS of what the parts made of the model in one iteration. A part reads its lines as a stream, in an order that differs from turn to turn."""
    held = lines.sparkSession.sparkContext.broadcast(model)
    share = counts / counts.sum()
    keep = np.minimum(1, np.sqrt(sample / share) + sample / share) if sample else np.ones(len(counts))
    drawn = np.cumsum(counts**0.75)
    expected = counts.sum() / parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = next(batches, None)
        if top is None:
            return
        part, seen = top.column("part")[0].as_py(), 0
        rng = np.random.default_rng((seed, turn, part))
        first, last = (m.copy() for m in held.value)
        times = np.zeros(len(first))
        for ids, line in chunks(chain([top], batches), 256 * BATCH):
            seen += len(ids)
            on = rng.random(len(ids)) < keep[ids]
            ids, line = ids[on], line[on]
            around = contexts(line, window, rng)
            around = np.where(around >= 0, ids[around], -1) if len(ids) else around
            places = np.flatnonzero((around >= 0).any(axis=1))
            words = np.c_[ids, np.searchsorted(drawn, rng.random((len(ids), negative)) * drawn[-1], "right").clip(0, len(counts) - 1)]
            speed = rate * max(1e-4, 1 - (turn + min(1, seen / expected)) / turns)
            for b in range(0, len(places), BATCH):
                step(first, last, around[places[b : b + BATCH]], words[places[b : b + BATCH]], speed)
            times += np.bincount(ids, minlength=len(times)) + np.bincount(words[places].ravel(), minlength=len(times))
        if times.any():
            for b in range(0, len(first), BLOCK):
                own = times[b : b + BLOCK]
                sums = [(m[b : b + BLOCK] * own[:, None]).astype(np.float32).ravel() for m in (first, last)]
                if turn == turns - 1:  # nothing learns from this any more
                    sums[1] = sums[1][:0]
                flat = [pa.array([x], pa.list_(pa.float32())) for x in sums]
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([own]), *flat], names=["block", "part", "times", "inner", "outer"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        sums = [table[c].combine_chunks().flatten().to_numpy().reshape(len(table), -1).astype(float).sum(axis=0) for c in ("times", "inner", "outer")]
        first = table.slice(0, 1)
        return pa.table([first["block"], first["part"], pa.array([sums[0]]), *(pa.array([s.astype(np.float32)], pa.list_(pa.float32())) for s in sums[1:])], names=["block", "part", "times", "inner", "outer"])

    order = [F.xxhash64("ids", F.lit(turn)), F.col("ids")]
    made = lines.repartitionById(parts, F.col("part")).sortWithinPartitions(*order).mapInArrow(run, SUMS)
    return cut(made.groupBy("block", F.pmod("part", F.lit(GROUPS))).applyInArrow(add, SUMS).groupBy("block").applyInArrow(add, SUMS), "model")


def vectors(model: DataFrame, words: list[str], before: np.ndarray) -> DataFrame:
    """(word, vec) from an iteration's SUMS; words that it didn't train keep what they had before."""
    spark = model.sparkSession
    held = spark.sparkContext.broadcast((words, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, old = held.value
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                own = old[block * BLOCK : (block + 1) * BLOCK].copy()
                if batch.column("times")[i].is_valid:
                    times, sums = (batch.column(c)[i].values.to_numpy() for c in ("times", "inner"))
                    seen = times > 0
                    own[seen] = sums.reshape(own.shape)[seen] / times[seen, None]
                yield pa.RecordBatch.from_arrays([pa.array(names[block * BLOCK : (block + 1) * BLOCK]), pa.array(list(own.astype(float)), pa.list_(pa.float64()))], names=["word", "vec"])

    blocks = spark.range(-(-len(words) // BLOCK)).select(F.col("id").cast("int").alias("block"))
    return cut(blocks.join(model.select("block", "times", "inner"), "block", "left").mapInArrow(run, "word string, vec array<double>"), "vectors")


def word_vectors(
    lines: DataFrame, tokens: str, size: int = 200, window: int = 5, negative: int = 7, sample: float = 1e-5, least: int = 50, iterations: int = 5, vocabulary: int = 1 << 17, parts: int | None = None, rate: float = 0.05, seed: int = 1
) -> DataFrame:
    """(word, vec): vectors of words that come ``least`` times, of which the ``vocabulary`` most frequent have one.

    A word is learned from the mean of those around it (up to ``window``, drawn
    for each place), against ``negative`` drawn words; frequent words are left out
    at random where their share is over ``sample`` (0: none). Empty tokens and null
    lines don't count. No such words: no rows. The model is the only thing of any
    size that tasks and driver hold: ``vocabulary`` bounds it. It goes to the driver
    after each iteration but the last, whose sums tasks make the vectors of.
    """
    spark = lines.sparkSession
    dealt, words, parts = encoded(lines, tokens, least, vocabulary, parts)
    if not words:
        return spark.createDataFrame([], "word string, vec array<double>")
    counts = np.array([n for _, n in words], float)
    inner = ((np.random.default_rng(seed).random((len(words), size)) - 0.5) / size).astype(np.float32)
    outer = np.zeros_like(inner)
    model = spark.createDataFrame([], SUMS)
    for turn in range(iterations):
        model = train(dealt, parts, (inner, outer), counts, window, negative, sample, rate, seed, turn, iterations)
        if turn == iterations - 1:
            break
        for r in model.toLocalIterator():
            at, times = r["block"] * BLOCK, np.array(r["times"])
            seen = times > 0
            for matrix, found in ((inner, r["inner"]), (outer, r["outer"])):
                mean = np.array(found).reshape(len(times), size)[seen] / times[seen, None]
                matrix[np.flatnonzero(seen) + at] = mean
        remove(model)
    out = vectors(model, [w for w, _ in words], inner)
    remove(model, dealt)
    return out
