"""Exact substring dedup over bytes by a depth-limited suffix sort.

Suffixes are grouped only through the first ``depth`` bytes, most significant
digit first, and equal groups are the repeated strings. A digit is a run of
bytes, sorted by its hash: groups are those of a suffix array, the order
between them is not its alphabetical one, which nothing here needs. Writing a row per
suffix would be many times the corpus, so suffixes travel packed: neighbours
that share their least ``seed``-byte digit are one row, and rows are taken
apart only where a group of equal digits still holds different suffixes. The
digits are, in order: the seed; all bytes of the packed row; the bytes that
eight neighbouring suffixes share; the suffix itself through ``depth``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from namesmith.llm import kernels, repeats


def repeated_bytes(docs: DataFrame, depth: int = 100, seed: int = 40, block: int = 8) -> DataFrame:
    """Byte spans (doc_id, mark, lo, hi) covered by a depth-byte string that also starts earlier.

    Earlier means in a smaller doc_id, or before in the same document; strings
    may overlap and never cross documents. Null and empty texts have none, as
    have texts of fewer than ``depth`` bytes. Rows with equal doc_id and text are
    one document: none repeats the other. Texts that share a doc_id but differ
    are documents of their own, in order of their hash (mark, 0 where no doc_id
    repeats). Rows without doc_id are left out.
    """
    return spans_of(repeats.texts(docs), depth, seed, block)


def spans_of(texts: DataFrame, depth: int, seed: int, block: int = 8) -> DataFrame:
    return repeats.spans(texts, "bytes", depth, seed, "place", block)


def dedup_bytes(docs: DataFrame, depth: int = 100, seed: int = 40) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    A cut can split a character: ``kept`` is binary. Spans are as in
    ``repeated_bytes``; an empty table gives no rows.
    """
    texts = repeats.texts(docs)
    spans = repeats.by_document(spans_of(texts, depth, seed), "lo", "hi")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, lo, hi = kernels.structs(batch.column("spans"), "lo", "hi")
            buf, offs = kernels.utf8(batch.column("text"))
            rows = []
            for i in range(len(offs) - 1):
                text = buf[offs[i] : offs[i + 1]]
                a, b = kernels.merged(lo[cuts[i] : cuts[i + 1]], np.minimum(hi[cuts[i] : cuts[i + 1]], len(text)))
                rest = text.tobytes()
                if len(a):
                    rest = b"".join(rest[x:y] for x, y in zip(np.r_[0, b], np.r_[a, len(text)], strict=True))
                rows.append((len(text), len(text) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=names)

    return texts.join(spans, ["doc_id", "mark"], "left").mapInArrow(emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
