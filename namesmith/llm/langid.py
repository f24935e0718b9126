"""Language identification by rank-order n-gram profiles.

A profile is the most frequent n-grams (1 to 3 letters, word ends marked by a
space) in order of frequency. A document gets the language whose profile is
nearest by the out-of-place distance: over the document's profile, the sum of
rank differences, with the profile length for n-grams that a language lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesmith.llm import kernels
from namesmith.plans.storage import small_batches

#: N-grams in a profile, counts that a task holds before it hands them on, and documents that are counted at once (with all letters there are, their trigrams fit 63 bits).
PROFILE, HELD, MANY = 300, 1 << 21, 2048


def fold(column: str, buckets: int) -> Column:
    """The document's fold: crc32 of its id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def letters() -> np.ndarray:
    """Which code points are letters; made once per Python worker."""
    store = kernels.worker_store()
    if not hasattr(store, "letters"):
        store.letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return store.letters


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of documents."""
    for first, buf, offs in kernels.slices(*kernels.utf8(column)):
        for a in range(0, len(offs) - 1, MANY):
            part = offs[a : a + MANY + 1]
            yield first + a, buf[part[0] : part[-1]], part - part[0]


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The space and the letters of a slice of documents, by code point, and the trigram around each letter of the texts.

    Letters are lower-cased; runs of other characters are one space. With n places
    in the alphabet, a trigram of places a, b, c in document d is ((d * n + a) * n + b) * n + c.
    """
    kernels.release()
    text = buf.tobytes()
    parts = [text[a:b].decode().lower() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    points = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(points.max(initial=32)) + 1, bool)
    seen[points] = True
    alphabet = np.r_[32, np.flatnonzero(seen & letters()[: len(seen)])]
    n = len(alphabet)
    kind = np.uint32 if len(parts) * n**3 < 1 << 32 else np.int64
    place = np.zeros(len(seen), kind)
    place[alphabet[1:]] = np.arange(1, n)
    places = place[points]
    docs = np.repeat(np.arange(len(parts)).astype(kind), [len(x) + 1 for x in parts])
    found = ((docs[: len(places) - 2] * n + places[:-2]) * n + places[1:-1]) * n + places[2:]
    return alphabet, found[places[1:-1] > 0]


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact codes of all n-grams of a slice of documents, and each one's document.

    An n-gram may begin or end with a space but has none inside; a bigram that begins
    with a space belongs to the word after it.
    """
    alphabet, found = trigrams(buf, offs)
    n = len(alphabet)
    doc, codes = found.astype(np.int64) // n**3, coded(alphabet, found.astype(np.int64) % n**3)
    every, _, which = spread(codes, np.ones(len(codes), np.int64))
    return every, doc[which]


def coded(alphabet: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Codes of trigrams (places in the alphabet)."""
    n = len(alphabet)
    return alphabet[found // n**2] << 42 | alphabet[found // n % n] << 21 | alphabet[found % n]


def spread(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the n-grams that trigrams stand for (letters in the middle, bigrams from there on, bigrams from a space on), their counts, and where each came from."""
    every = np.arange(len(codes))
    heads = np.flatnonzero(codes >> 42 == 32)
    which = np.concatenate([every, every, heads, every])
    return np.concatenate([codes >> 21 & (1 << 21) - 1, codes & (1 << 42) - 1 | 1 << 62, codes[heads] >> 21 | 1 << 62, codes]), counts[which], which


def added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts (without any: how often each comes)."""
    if counts is None:
        keys = np.sort(keys)
    elif len(keys) and keys.max() < 8 * len(keys):  # few cells: nothing to sort
        sums = np.bincount(keys, counts)
        keys = np.flatnonzero(sums)
        return keys, sums[keys].astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    return keys[edges[:-1]], np.diff(edges) if counts is None else np.add.reduceat(counts, edges[:-1]) if len(keys) else counts


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams over whole texts, most frequent first (size per language)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        pending = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, counts, _ = spread(*added(*(np.concatenate(x) for x in zip(*parts, strict=True))))
                codes, counts = added(codes, counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            which = names.indices.to_numpy(zero_copy_only=False)
            for first, buf, offs in runs(batch.column("text")):
                alphabet, found = trigrams(buf, offs)
                cells = len(alphabet) ** 3
                found, counts = added(found)
                doc, found = np.divmod(found.astype(np.int64), cells)
                lang, codes = which[first + doc], coded(alphabet, found)
                for x in np.unique(lang):
                    own = added(codes[lang == x], counts[lang == x])
                    held.setdefault(names.dictionary[int(x)].as_py(), []).append(own)
                    pending += len(own[0])
            if pending > HELD:
                held = {name: [added(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for name, parts in held.items()}
                pending = sum(len(parts[0][0]) for parts in held.values())
                if pending > HELD // 2:
                    yield from out()
                    held, pending = {}, 0
        yield from out()

    counted = small_batches(docs).where("lang is not null and text is not null").select("lang", "text").mapInArrow(emit, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(out.items())}


def leading(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, rank from 0, code) of each document's most frequent n-grams, by document and rank; ties by code."""
    alphabet, found = trigrams(buf, offs)
    n = len(alphabet)
    found, counts = added(found)
    doc, found = np.divmod(found.astype(np.int64), n**3)
    left, middle, right = found // n**2, found // n % n, found % n
    heads = left == 0
    pairs, of_pairs = added(np.concatenate([doc * n**2 + middle * n + right, (doc * n**2 + middle)[heads]]), np.concatenate([counts, counts[heads]]))
    ones, of_ones = added(doc * n + middle, counts)
    # In the order of codes: letters, trigrams, bigrams.
    docs = np.concatenate([ones // n, doc, pairs // n**2])
    places = np.concatenate([ones % n, n + found, n + n**3 + pairs % n**2])
    counts = np.concatenate([of_ones, counts, of_pairs])
    top, every = int(counts.max(initial=0)) + 1, n + n**2 + n**3
    if (len(offs) * top * every).bit_length() < 63:
        docs, places = np.divmod(np.sort((docs * top + top - counts) * every + places), every)
        docs = docs // top
    else:
        order = np.lexsort((places, -counts, docs))
        docs, places = docs[order], places[order]
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
    rank = np.arange(len(docs)) - np.repeat(starts, np.diff(np.r_[starts, len(docs)]))
    kept = rank < size
    docs, rank, places = docs[kept], rank[kept], places[kept]
    codes = np.empty(len(places), np.int64)
    one, three = places < n, (places >= n) & (places < n + n**3)
    two = ~(one | three)
    codes[one], codes[three] = alphabet[places[one]], coded(alphabet, places[three] - n)
    pairs = places[two] - n - n**3
    codes[two] = alphabet[pairs // n] << 21 | alphabet[pairs % n] | 1 << 62
    return docs, rank, codes


def identify(docs: DataFrame, learned: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score.

    Score is the lead over the second nearest language as a share of its
    distance (with one language: closeness). Null texts, texts without a
    letter, and all texts when no language was learned, are ``und`` with score
    0. Ties go to the first language by name. Rows repeat as they come.
    """
    langs = list(learned)
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *learned.values()]))
    ranks = np.full((len(langs), len(known)), -1, np.int64)
    for i, x in enumerate(langs):
        ranks[i, np.searchsorted(known, learned[x])] = np.arange(len(learned[x]))

    def judge(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's language (the number of languages: und) and score."""
        said, score = np.full(len(offs) - 1, len(langs)), np.zeros(len(offs) - 1)
        doc, rank, codes = leading(buf, offs, size) if langs else (np.zeros(0, np.int64),) * 3
        if not len(doc):
            return said, score
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        own = np.where(known[at] == codes, ranks[:, at], -1)
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        apart = np.add.reduceat(np.where(own < 0, size, np.abs(own - rank)), starts, axis=1)
        order, which = np.argsort(apart, axis=0, kind="stable"), np.arange(len(starts))
        best = apart[order[0], which]
        other = apart[order[1], which] if len(langs) > 1 else size * np.diff(np.r_[starts, len(doc)])
        said[doc[starts]] = order[0]
        score[doc[starts]] = np.where(other > 0, (other - best) / np.maximum(other, 1), 0.0)
        return said, score

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*langs, "und"], pa.string())
        for batch in batches:
            found = [judge(buf, offs) for _, buf, offs in runs(batch.column("text"))]
            said, score = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0)), *found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names.take(pa.array(said)), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, "doc_id long, lang_pred string, score double")


def identify_held_out(docs: DataFrame, buckets: int = 4, held: int = 2, size: int = PROFILE) -> DataFrame:
    """Learn on the documents outside the held-out fold, then judge all of them."""
    learned = profiles(docs.where(fold("doc_id", buckets) != held), size)
    return identify(docs, learned, size).select("doc_id", (F.coalesce(fold("doc_id", buckets), F.lit(-1)) == held).alias("held_out"), "lang_pred", "score")
