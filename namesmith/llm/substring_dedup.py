"""Removal of long word passages that an earlier document already has: seed and extend.

Documents meet on winnowed anchors (the least 4-word seed of each window).
From an anchor a match is extended both ways as far as windows hold the anchor:
as a whole where the surroundings are equal, word by word where they are not.
Longer matches go on at their next anchor, at most a window away, and what
overlaps is joined into maximal repeats. Documents meet an anchor's earliest
occurrences, not each other, so no anchor makes pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesmith.llm import kernels, repeats

EXTRA = "n_words long, n_removed long, kept_sha256 string, kept string"


def repeated_words(docs: DataFrame, length: int = 13, seed: int = 4) -> DataFrame:
    """Word spans (doc_id, mark, lo, hi) covered by a window that also starts in a document of smaller doc_id.

    Words are maximal runs of bytes other than space and tab to carriage
    return. Null texts and texts under ``length`` words have no windows. Rows
    with equal doc_id and text share their spans; texts that share a doc_id but
    differ have each their own, told apart by mark (0 where no doc_id repeats).
    Rows without doc_id are left out.
    """
    return repeats.spans(repeats.texts(docs), "words", length, seed, "document")


def maximal_repeats(docs: DataFrame, length: int = 13, seed: int = 4) -> DataFrame:
    """doc_id, mark, lo, hi: the spans of ``repeated_words`` that overlap or adjoin, joined into maximal ones."""
    place = Window.partitionBy("doc_id", "mark").orderBy("lo", "hi")
    reach = F.max("hi").over(place.rowsBetween(Window.unboundedPreceding, -1))
    begun = repeated_words(docs, length, seed).withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "mark", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def dedup_words(docs: DataFrame, length: int = 13, seed: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the remaining words joined by one space), kept.

    ``kept`` is the text as it is if no word goes, else the remaining words
    joined by one space. ``carry`` names further columns of docs to hand on. An
    empty table gives no rows.
    """
    texts = repeats.texts(docs, *carry)
    spans = repeats.by_document(repeats.spans(texts.select("doc_id", "text", "mark"), "words", length, seed, "document"), "lo", "hi")
    kinds = dict(docs.dtypes)
    schema = "doc_id long, " + EXTRA + "".join(f", `{x}` {kinds[x]}" for x in carry)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, lo, hi = kernels.structs(batch.column("spans"), "lo", "hi")
            out = []
            for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text"))):
                starts, ends, at = kernels.words(buf, offs)
                flat = buf.tobytes()
                for i in range(len(offs) - 1):
                    n, row = at[i + 1] - at[i], first + i
                    keep = np.zeros(n + 1, np.int64)
                    a, b = np.minimum(lo[cuts[row] : cuts[row + 1]], n), np.minimum(hi[cuts[row] : cuts[row + 1]], n)
                    np.add.at(keep, a, 1)
                    np.add.at(keep, b, -1)
                    left = at[i] + np.flatnonzero(np.cumsum(keep[:-1]) == 0)
                    rest = b" ".join([flat[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
                    out.append((n, n - len(left), hashlib.sha256(rest).hexdigest(), (rest if len(left) < n else flat[offs[i] : offs[i + 1]]).decode()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, types, strict=True)), *(batch.column(x) for x in carry)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *carry],
            )

    return texts.join(spans, ["doc_id", "mark"], "left").mapInArrow(emit, schema)
