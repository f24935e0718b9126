"""Phrases that words form more often than chance: counts from word-id suffix arrays.

A shard is a run of whole documents. Its words get ids, the suffixes of its
pieces are sorted by numpy prefix doubling through the longest phrase, and the
intervals of the LCP array are its n-grams with their counts. Spark sums these
by language and phrase. As a phrase is no more frequent than its parts, shards
count up in lengths: a longer n-gram is only sent on where its shorter parts are
frequent, told by a bitmap of bounded size that may let others through but keeps
none back. Pairs and triples, of which most are rare, are first counted by hash;
only those whose hash is frequent go on as text, and the text's count is what
holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesmith.llm import kernels
from namesmith.llm.decontaminate import BROADCAST, small
from namesmith.plans.storage import cut

COUNTS = "lang string, phrase string, h long, f long"
#: Bytes of text in a shard, and the most bits of a bitmap (bitmaps go to all tasks).
SHARD, MOST_BITS = 1 << 21, 1 << 29
#: What ends a piece, and what parts words in it.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_INSIDE = np.ones(256, bool)
_INSIDE[list(ENDS + BLANKS)] = False
_END = np.zeros(256, bool)
_END[list(ENDS)] = True


def sorted_places(keys: np.ndarray) -> np.ndarray:
    """argsort of non-negative keys: key and place are sorted as one number where both fit."""
    bits = max(1, len(keys).bit_length())
    if len(keys) and int(keys.max()).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    return np.sort((keys.astype(np.int64) << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def dense(keys: np.ndarray) -> np.ndarray:
    """Ids from 1 in the order of the keys; equal keys, equal ids."""
    order = sorted_places(keys)
    own = keys[order]
    ids = np.empty(len(keys), np.int64)
    ids[order] = np.cumsum(np.r_[True, own[1:] != own[:-1]]) if len(keys) else 0
    return ids


def ids_of(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Ids from 1 for pairs of hashes; equal pairs, equal ids."""
    if not len(one):
        return np.zeros(0, np.int64)
    # Sorted by as much of one hash as leaves room for the place; both are compared in full.
    bits = np.uint64(len(one).bit_length())
    order = (np.sort((one >> bits << bits) | np.arange(len(one), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    for attempt in (0, 1):
        a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        if attempt or np.array_equal(new[1:], (a[1:] >> bits) != (a[:-1] >> bits)):
            break
        order = np.lexsort((two, one))
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new)
    return ids


class Shard:
    """The words of some documents: normal bytes (one space between words), word spans, what is left of each piece, and languages."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lang: np.ndarray, keys: np.ndarray) -> None:
        low = kernels.lower_ascii(buf)
        starts, ends, at = kernels.words(low, offs, _INSIDE)
        n = len(starts)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        stops = np.r_[0, np.cumsum(_END[low])]
        same = (doc[1:] == doc[:-1]) & (stops[ends[:-1]] == stops[starts[1:]]) if n else np.zeros(0, bool)
        last = np.flatnonzero(np.r_[~same, True]) if n else np.zeros(0, np.int64)
        self.left = np.repeat(last + 1, np.diff(np.r_[-1, last])) - np.arange(n)
        self.lang, self.salts = lang[doc], keys[lang[doc]]
        sizes = ends - starts
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.flat = np.full(int(sizes.sum() + n), 32, np.uint8)
        self.flat[ranges(self.starts, sizes)] = low[ranges(starts, sizes)]
        self.sums = kernels.prefix(kernels.BYTES[0][self.flat], 0)

    def reduced(self, places: np.ndarray, most: int) -> np.ndarray:
        """Gives ids to the words that phrases of up to ``most`` words at the given places hold; returns these words' places."""
        size = np.minimum(self.left[places], most)
        edges = np.zeros(len(self.left) + 1, np.int64)
        np.add.at(edges, places, 1)
        np.add.at(edges, places + size, -1)
        live = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        self.ids = np.zeros(len(self.left), np.int64)
        lo, hi = self.starts[live], self.ends[live]
        one = kernels.stretch(self.sums, lo, hi, 0)
        for i in np.flatnonzero(hi - lo > kernels.LONG).tolist():
            one[i] = xxhash.xxh3_64_intdigest(self.flat[lo[i] : hi[i]].tobytes())
        two = kernels.word_hashes(self.flat, lo, hi, 1)
        self.ids[live] = ids_of(one ^ self.salts[live], two ^ kernels.mix(self.salts[live].copy()))
        return live

    def ranks(self, live: np.ndarray, most: int) -> dict[int, np.ndarray]:
        """Ids of the phrases of 1, 2, 4 ... words at live places, shorter where the piece ends: prefix doubling."""
        out, size = {1: self.ids}, 1
        while size < most:
            rank = out[size]
            after = np.zeros_like(rank)
            has = live[self.left[live] > size]
            after[has] = rank[has + size]
            out[2 * size] = np.zeros_like(rank)
            out[2 * size][live] = dense(rank[live] * (int(after.max(initial=0)) + 1) + after[live])
            size *= 2
        return out

    def intervals(self, lengths: tuple[int, ...], allowed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, places, counts): each phrase of m words at allowed places once, with how often it starts there."""
        at = np.flatnonzero(allowed & (self.left >= min(lengths)))
        if not len(at):
            return
        ranks = self.ranks(self.reduced(at, max(lengths)), max(lengths))
        sizes = sorted(ranks, reverse=True)
        array = at[sorted_places(ranks[sizes[0]][at])]
        a, b = array[:-1], array[1:]
        lcp = np.zeros(len(a), np.int64)
        for size in sizes:
            fits = np.flatnonzero((self.left[a] - lcp >= size) & (self.left[b] - lcp >= size))
            lcp[fits] += size * (ranks[size][a[fits] + lcp[fits]] == ranks[size][b[fits] + lcp[fits]])
        for m in lengths:
            long = self.left[array] >= m
            heads = np.flatnonzero(np.r_[True, lcp < m] & long)
            if len(heads):
                # Shorter suffixes lie before the phrases of m words that they begin, never among equal ones.
                yield m, array[heads], np.add.reduceat(long.astype(np.int64), heads)

    def hashes(self, places: np.ndarray, m: int) -> np.ndarray:
        """Hashes of the phrases of m words at the given places, with their language."""
        return salted(kernels.stretch(self.sums, self.starts[places], self.ends[places + m - 1], 0), self.salts[places])

    def phrases(self, places: np.ndarray, m: int) -> pa.Array:
        lo, hi = self.starts[places], self.ends[places + m - 1]
        sizes = hi - lo
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(self.flat[ranges(lo, sizes)])])


def ranges(lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of [lo, lo + size), one stretch after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(lo - np.r_[0, np.cumsum(sizes)[:-1]], sizes)


def salted(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return kernels.mix(hashes + salts)


def lang_key(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Shard, np.ndarray]]:
    """The shards of the batches, with the names of the languages."""
    kernels.release()
    for which in (0, 1):  # tables that would otherwise be made anew for each longer shard
        kernels.powers(which, size + (1 << 19))
    for batch in batches:
        names, lang = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        keys = lang_key(list(names))
        for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text")), size):
            yield Shard(buf, offs, lang[first : first + len(offs) - 1], keys), names


def counted(docs: DataFrame, named: tuple[int, ...], hashed: tuple[int, ...] = (), part: int = 0, bitmap: np.ndarray | None = None, size: int = SHARD) -> DataFrame:
    """(lang, phrase, h, f): phrases of which the bitmap has all parts of ``part`` words.

    Those of the lengths ``named`` come as text (h is 0), those of ``hashed`` as
    a hash h, which takes a third of the room. Without a bitmap all phrases count,
    and a language's words in all, as the phrase "".
    """
    held = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)
    lengths = tuple(sorted({*named, *hashed}))
    names_of = ["lang", "phrase", "h", "f"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, names in shards(batches, size):
            good = shard.left >= max(part, 1)
            if held:
                bits, at = held.value, np.flatnonzero(good)
                slots = shard.hashes(at, part) & np.uint64(8 * len(bits) - 1)
                good[at] = (bits[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
            else:
                n = np.bincount(shard.lang, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([""] * len(names)), pa.array(np.zeros(len(names), np.int64)), pa.array(n.astype(np.int64))], names=names_of)
            starts, whole = good, {}
            for m in range(max(part, 1), lengths[-1] + 1):
                if part and m > part:  # The last part of the phrase that starts here.
                    starts = starts & np.r_[good[m - part :], np.zeros(min(m - part, len(good)), bool)]
                whole[m] = starts & (shard.left >= m)
            for m, places, f in shard.intervals(lengths, whole[lengths[0]]):
                keep = whole[m][places]
                places, f = places[keep], pa.array(f[keep].astype(np.int64))
                if len(places) and m in named:
                    yield pa.RecordBatch.from_arrays([pa.array(names[shard.lang[places]], pa.string()), shard.phrases(places, m), pa.array(np.zeros(len(places), np.int64)), f], names=names_of)
                elif len(places):
                    none = pa.nulls(len(places), pa.string())
                    yield pa.RecordBatch.from_arrays([none, none, kernels.signed(shard.hashes(places, m)), f], names=names_of)

    return docs.mapInArrow(emit, COUNTS).groupBy("lang", "phrase", "h").agg(F.sum("f").alias("f"))


def passes(longest: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(part, named, hashed) of each pass: words; pairs by hash; pairs, and triples by hash; triples and longer ones."""
    every = [(0, (1,), ()), (1, (), (2,)), (2, (2,), (3,)), (3, tuple(range(3, longest + 1)), ())]
    return [(part, named, tuple(m for m in hashed if m <= longest)) for part, named, hashed in every if part <= longest and (named or hashed)]


def frequent(docs: DataFrame, longest: int = 5, least: int = 100, size: int = SHARD, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, m, phrase, f): words and phrases of up to ``longest`` words that come ``least`` times in their language, and each language's words in all (m = 0, phrase "")."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bitmap, out = None, None
    for part, named, hashed in passes(max(2, longest)):
        if part and bitmap is None:
            break
        found = counted(own, named, hashed, part, bitmap, size)
        table = cut(found.where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")
        if named:
            some = table.where("phrase is not null").select("lang", "phrase", "f")
            out = some if out is None else out.unionByName(some)
        hashes = table.where("phrase is null").select("h") if hashed else hashes_of(table.where("phrase <> ''"))
        bitmap = bitmap_of(hashes, most_bits)
    return out.withColumn("m", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))).where(F.col("m") <= longest)


def hashes_of(phrases: DataFrame) -> DataFrame:
    """(h): as a shard hashes them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = kernels.utf8(batch.column("phrase"))
            hashes = kernels.stretch(kernels.prefix(kernels.BYTES[0][buf], 0), offs[:-1], offs[1:], 0)
            yield pa.RecordBatch.from_arrays([kernels.signed(salted(hashes, lang_key(batch.column("lang").to_pylist())))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(emit, "h long")


def bitmap_of(hashes: DataFrame, most_bits: int) -> np.ndarray | None:
    """A bit per slot of a hash; none if there are no hashes. At most ``most_bits`` bits come to the driver, whatever the number of phrases."""
    n = hashes.count()
    if not n:
        return None
    bits = min(most_bits, 1 << max(16, (16 * n).bit_length()))
    slots = hashes.select((F.col("h").bitwiseAND(F.lit(bits - 1)) + 1).alias("slot"))
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[(r.bucket - 1) * 4096 :][:4096] = np.frombuffer(r.bits, np.uint8)[: len(out)]
    return out


def part_of(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, size: int = SHARD, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    A phrase of 2 to ``longest`` words (A-Z lower-cased) with a >= least
    occurrences scores floor(1000 a n / (l r)) at the cut where that is least;
    n are its language's words, l and r the occurrences of the parts. Phrases
    inside a longer one with f * 100 >= share * a go. Null languages count as
    ``und``, null and empty texts have no words; repeated rows count each.
    Nothing frequent, or an empty table: no rows.
    """
    known = frequent(docs, longest, least, size, most_bits)
    phrases = known.where("m > 1").withColumn("words", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "m", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part_of(F.col("words"), F.lit(1), F.col("k")).alias("head"), part_of(F.col("words"), F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    counts = known.where("m > 0")
    heads, tails = (counts.select("lang", F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("head", "l"), ("tail", "r")))
    totals = small(known.where("m = 0").select("lang", F.col("f").alias("n")), F.octet_length("lang") + 16, BROADCAST)
    score = F.expr("(cast(1000 * a as decimal(18, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inside = phrases.where("m > 2").select("lang", "f", "words", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("n")).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n") + 1)))
    covers = inside.select("lang", part_of(F.col("words"), F.col("start"), F.col("n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(covers, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < share * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
