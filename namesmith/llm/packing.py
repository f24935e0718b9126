"""Best-fit packing of tokenized documents into fixed-length sequences.

A sequence has three capacities: tokens, documents, and attention cost (the
sum of squared piece lengths). Pieces come longest first, and each goes into
the open sequence that fits best over what is left of all three: the smallest
weighted residual norm after placement, or the largest weighted dot product of
demand and room. What fits nowhere opens a new one.

Whole corpora are packed by counting: pieces of one length are alike, and so
are sequences with the same room, so the plan is made on a histogram of at most
``size`` lengths and lists runs of ranks with runs of sequences. Pieces then
look their place up by length and rank. The plan's size follows ``size``, never
the corpus; ranks come from salted counts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesmith.llm import kernels
from namesmith.plans.storage import cut, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Distinct words whose ids a Python worker keeps; beyond it forgets all and starts anew.
REMEMBERED = 400_000
SALTS = 64
#: Texts by which a vocabulary shows whether words can be tokenized one by one, whatever their case.
PROBES = [
    "The cat's hat, isn't it?  Two  spaces\tand a tab\n\nnew paragraph. End", " leading, trailing ", "MiXeD Case WORDS and word Word wORD", "x1 y2z 3.14 1,000 a-b_c d/e f@g.h #tag $5 50% (paren) [br] {cu} \"q\" 'q'",
    "\u00c9t\u00e9 na\u00efve \u00dcber stra\u00dfe \u017c\u00f3\u0142w", "\u706b\u6c34 \u65e5\u672c\u8a9e text", "don't DON'T we'll WE'LL I'm they've", "a\u00a0b\u200bc\u0301 e\u0301", "\x0bvertical\x0cfeed\rreturn\r\n", "!!! ??? ... --- === ***",
]
#: Bytes of text tokenized at once: the more, the more words are equal.
SLICE = 1 << 20


def grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` put after its used part, doubled if it has no room."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros(used + 2 * len(more), array.dtype)])
    array[used : used + len(more)] = more
    return array


class WordIds:
    """Token ids word by word.

    The vocabulary's pre-tokenizer never joins across ASCII white space, nor
    from a letter to an ASCII sign or digit after it, so texts are cut there
    and each distinct piece is tokenized once. Where all bytes are below
    U+0100, lower-casing A-Z first changes nothing and makes more pieces equal.
    That is a property of some vocabularies: ``PROBES`` are tokenized both ways
    when one is loaded, and with one that differs whole texts are tokenized.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()
        self.whole = False
        raw = [p.encode() for p in PROBES]
        ids, at = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
        self.whole = any(ids[at[i] : at[i + 1]].tolist() != self.tokenizer.encode(p, add_special_tokens=False).ids for i, p in enumerate(PROBES))

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, tokenizing new ones."""
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        numbers = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(numbers) if x is None]
        if missing:
            new, first, ids = [words[i] for i in missing], len(self.known), []
            for at in range(0, len(new), 8192):
                ids += [code.ids for code in self.tokenizer.encode_batch_fast([w.decode() for w in new[at : at + 8192]], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.cumsum(sizes)
            self.flat = grown(self.flat, self.used, np.fromiter(chain.from_iterable(ids), np.uint32, ends[-1]))
            self.begins = grown(self.begins, first, self.used + ends - sizes)
            self.sizes = grown(self.sizes, first, sizes)
            self.used += int(ends[-1])
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            for i, x in zip(missing, range(first, first + len(new)), strict=True):
                numbers[i] = x
        return np.array(numbers, np.int64)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each one's begin."""
        whole = buf.tobytes()
        if self.whole or any(s in whole for s in self.special):
            rows = [self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            return np.array([x for r in rows for x in r], np.uint32), np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]
        folded = kernels.lower_ascii(buf)
        letter = (folded >= 97) & (folded <= 122)
        inside = kernels.SPACES[buf]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (letter[:-1] & ~letter[1:] & (buf[1:] < 128))
        edge = offs[:-1][offs[:-1] < len(buf)]
        begin[edge] = inside[edge]
        starts = np.flatnonzero(begin)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        cuts = np.r_[starts, len(buf)]
        kept = np.r_[0, np.cumsum(inside)]
        wide = np.r_[0, np.cumsum(buf >= 0xC4)]
        plain = wide[cuts[1:]] == wide[cuts[:-1]]
        fold = np.repeat(plain, np.diff(cuts))
        text = buf.copy()
        text[starts[0] :] = np.where(fold, folded[starts[0] :], buf[starts[0] :])
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(kept[cuts].astype(np.int32)), pa.py_buffer(text[inside])])
        coded = column.dictionary_encode()
        numbers = self.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.sizes[numbers]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(self.begins[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, offs)]


def pieces(docs: DataFrame, vocabulary: str, size: int, end: int, with_ids: bool = False) -> DataFrame:
    """Documents as ids plus ``end``, cut only where longer than ``size``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = kernels.worker_store()
        if getattr(store, "words", None) is None or store.vocabulary != vocabulary:
            store.vocabulary, store.words = vocabulary, WordIds(vocabulary)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text")), SLICE):
                ids, at = store.words.encode(buf, offs)
                rows = []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), size)):
                        part = own[start : start + size]
                        rows.append((doc_ids[first + i], piece, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.mapInArrow(emit, PIECES + (", ids array<long>" if with_ids else ""))


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weight of each part in the choice of pieces."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def plan(counts: dict[int, int], room: Capacity) -> dict[str, np.ndarray]:
    """Places for ``counts[length]`` pieces of each length, as segments of ranks.

    Sequences with equal room are a group (first number, how many, room). For
    each length, longest first, the best fitting group takes what it can: its
    first sequences are filled with as many of the pieces as fit, one gets the
    rest, the others stay as they are. A length that no group can take opens a
    group of sequences filled with it. Each step ends a length or a group's use
    for it, so the plan has few segments whatever the counts.
    """
    full = np.array([room.tokens, room.documents, room.attention], np.int64)
    weights = np.array(room.weights)
    begin, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.zeros((0, 3), np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError("a piece exceeds a sequence's capacity")
        rank, todo = 0, counts[length]
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if room.rule == "norm":
                    best = fits[np.argmin((((left[fits] - need) / full) ** 2 * weights).sum(axis=1))]
                else:
                    best = fits[np.argmax((left[fits] / full * (need / full) * weights).sum(axis=1))]
                start, wide, own = int(begin[best]), int(many[best]), left[best].copy()
                keep = np.arange(len(begin)) != best
                begin, many, left = begin[keep], many[keep], left[keep]
            else:
                start, wide, own = bins, -(-todo // int((full // need).min())), full.copy()
                bins += wide
            uses = int((own // need).min())
            filled, rest = divmod(min(todo, uses * wide), uses)
            offset = room.tokens - int(own[0])
            groups = [(start, filled, own - uses * need), (start + filled, int(rest > 0), own - rest * need), (start + filled + (rest > 0), wide - filled - (rest > 0), own)]
            if filled:
                rows.append((length, rank, uses, start, offset, filled))
            if rest:
                rows.append((length, rank + filled * uses, rest, start + filled, offset, 1))
            rank, todo = rank + filled * uses + rest, todo - filled * uses - rest
            # Sequences without room for a token and a document are closed.
            groups = [g for g in groups if g[1] and (g[2] > 0).all()]
            if groups:
                begin = np.r_[begin, [g[0] for g in groups]]
                many = np.r_[many, [g[1] for g in groups]]
                left = np.concatenate([left, [g[2] for g in groups]])
    rows.sort()
    names = ("length", "rank", "uses", "bin", "offset", "times")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def ranked(found: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length, without a task for a whole length."""
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return salted.withColumn("r", F.row_number().over(own) - 1).join(sums.select("length", "salt", before.alias("before")), ["length", "salt"]).select(*found.columns, (F.col("before") + F.col("r")).alias("rank"))


def pack(docs: DataFrame, vocabulary: str, room: Capacity = Capacity(), end: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A document is its token ids and ``end``; only one longer than a sequence is
    cut, into full pieces and a rest. Null and empty texts are the end token
    alone. Repeated rows are packed as often as they come; rows without doc_id
    are left out; an empty table gives no rows.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    found = cut(pieces(rows, vocabulary, room.tokens, end, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments = plan(counts, room)
    kinds = PIECES + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = segments["length"] << np.int64(44) | segments["rank"]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            i = np.searchsorted(order, length << np.int64(44) | rank, "right") - 1
            nth, uses = rank - segments["rank"][i], segments["uses"][i]
            keep = [x for x in batch.schema.names if x != "rank"]
            places = [pa.array(segments["bin"][i] + nth // uses), pa.array(segments["offset"][i] + nth % uses * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), *places], names=[*keep, "sequence_id", "offset"])

    return ranked(found).mapInArrow(place, kinds)
