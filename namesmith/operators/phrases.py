"""Phrases of a vocabulary found in texts, by a trie over words.

The vocabulary's phrases share their beginnings in a trie whose edges are one
sorted array of (node, word). A task looks up the words of a batch once and then
follows all places of the batch along the trie a word at a time, so the work
follows the words that begin phrases, not the slices of the texts. Texts are
never shuffled or exploded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions.text import remove_punctuation, split_trimmed, trim_ends
from namesmith.plans.storage import cut, small_batches

#: Bytes of a vocabulary that go to all tasks at once.
BROADCAST = 64 << 20
#: Words that a task follows at once: what it holds for each is some hundred bytes.
WORDS = 1 << 17
FOUND = "array<struct<i:long,n:long,phrase:string>>"


def phrase_text(*fields: Column) -> Column:
    return trim_ends(F.lower(remove_punctuation(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields)), " ")))


class Trie:
    """Phrases (words joined by _): the words, edges (node * words + word, sorted), and which phrase ends at a node."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = pa.array(phrases, pa.string())
        tokens = pc.split_pattern(self.phrases, "_")
        sizes = tokens.value_lengths().to_numpy()
        coded = tokens.flatten().dictionary_encode()
        self.words, flat = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        first = np.cumsum(sizes) - sizes
        self.depth, width = int(sizes.max(initial=0)), max(1, len(self.words))
        node, known, edges, ends = np.zeros(len(sizes), np.int64), 1, [], [np.full(1, -1)]
        rows = np.arange(len(sizes))
        for d in range(self.depth):
            rows = rows[sizes[rows] > d]
            made, which = np.unique(node[rows] * width + flat[first[rows] + d], return_inverse=True)
            node[rows] = known + which
            edges.append(made)
            known += len(made)
            end = np.full(len(made), -1)
            last = sizes[rows] == d + 1
            end[which[last]] = rows[last]
            ends.append(end)
        # Nodes are numbered by depth, so edges of one depth are all below those of the next.
        self.edges, self.ends, self.width = np.concatenate(edges or [np.zeros(0, np.int64)]), np.concatenate(ends), width

    def found(self, ids: np.ndarray, left: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(places, size in words, phrases) for phrases that begin at the given places; ids are -1 for words that no phrase has."""
        at = begins[ids[begins] >= 0]
        node = np.zeros(len(at), np.int64)
        for d in range(self.depth):
            on = left[at] > d
            at, node = at[on], node[on]
            word = ids[at + d]
            key = node * self.width + word
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = (word >= 0) & (self.edges[edge] == key)
            at, node = at[hit], edge[hit] + 1
            end = self.ends[node]
            yield at[end >= 0], d + 1, end[end >= 0]


def tag_batch(trie: Trie, words: pa.Array, most: int, inclusive: bool) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(offsets of rows, place, length, phrase): the phrases of each row of words, in order of place, then length."""
    rows = len(words)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    # Words that hold _ are several words of the trie; phrases begin and end with whole ones.
    pieces = pc.split_pattern(flat, "_")
    width = pieces.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pieces.flatten().dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, trie.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    word_of = np.repeat(np.arange(len(flat)), width)
    begins = np.cumsum(width) - width
    stops = np.cumsum(sizes)  # the end of each row, in words
    row_of = np.repeat(np.arange(rows), sizes)
    bounds = np.r_[begins, len(ids)]
    left = bounds[stops[row_of[word_of]]] - np.arange(len(ids)) if len(ids) else ids
    last = np.zeros(len(ids), bool)
    last[begins + width - 1] = True
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at, size, phrase in trie.found(ids, left, begins) if len(trie.edges) else ():
        first, end = word_of[at], word_of[at + size - 1] + 1
        fits = last[at + size - 1] & (end - first <= most) & (end <= stops[row_of[first]] - (0 if inclusive else 1))
        out.append((first[fits], (end - first)[fits], phrase[fits]))
    first, n, phrase = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
    order = np.lexsort((n, first))
    counts = np.bincount(row_of[first], minlength=rows)
    place = (first - (stops - sizes)[row_of[first]])[order]
    return pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(place), pa.array(n[order]), trie.phrases.take(pa.array(phrase[order]))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about WORDS words together; a longer row is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def tag_phrases(texts: DataFrame, vocabulary: DataFrame, longest: int, key: str = "id", inclusive: bool = True, limit: int = BROADCAST) -> DataFrame:
    """(key, phrases): vocabulary phrases (words joined by _) in order of place, then length.

    A row per row of texts; a null text has no phrases. not inclusive: as if
    phrases of the longest length, and those that end at the last word, were out
    of bounds. Phrases of more than ``longest`` words never match. A vocabulary of
    up to ``limit`` bytes (measured) goes to all tasks as one trie; a larger one in
    parts of that size, by a hash, each with a pass over the texts of its own.
    """
    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    most = longest if inclusive else longest - 1
    own = small_batches(texts).select(F.col(key), split_trimmed(F.col("text"), r"\s+").alias("words"))
    known = vocabulary.select(F.lower(F.col(vocabulary.columns[0])).alias("phrase")).where("phrase is not null").distinct()
    size = known.select(F.coalesce(F.sum(F.octet_length("phrase") + 16), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // limit))

    def tagged(rows: DataFrame, part: int) -> DataFrame:
        some = known.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).orderBy("phrase")
        trie = spark.sparkContext.broadcast(Trie(some.toArrow()["phrase"].to_pylist()))
        names = [key, "words", "before", "found"]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch):
                    offsets, place, n, phrase = tag_batch(trie.value, some.column("words"), most, inclusive)
                    found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([place, n, phrase], names=["i", "n", "phrase"]))
                    yield pa.RecordBatch.from_arrays([some.column(key), some.column("words"), some.column("before"), found], names=names)

        found = rows.mapInArrow(emit, f"`{key}` {kind}, words array<string>, before {FOUND}, found {FOUND}")
        return found.select(key, "words", F.concat("before", "found").alias("before"))

    rows = tagged(own.withColumn("before", F.array().cast(FOUND)), 0)
    for part in range(1, parts):
        rows = tagged(cut(rows, "phrases"), part)
    ordered = F.col("before") if parts == 1 else F.sort_array("before")
    return rows.select(key, F.transform(ordered, lambda x: x["phrase"]).alias("phrases"))
