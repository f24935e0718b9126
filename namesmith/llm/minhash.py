"""Near-duplicate documents by b-bit MinHash with exact confirmation.

1. A document's signature is 128 minima over its distinct word shingles. Bands
   of minima propose candidates; of each minimum two bits are kept, packed
   into four words, from which a collision-corrected similarity follows by
   counting bits.
2. Documents with equal shingle sets are one class, so copies are never paired.
3. In each band bucket all members meet the bucket's head, the member that
   meets most others over all bands, which links the bulk of a group of near
   copies. Links are confirmed on full shingle sets.
4. Members of one head that are still in different components meet where they
   share differences from the head. If a is linked to b but b not to the head,
   then of what a and the head don't share, much is the same for b
   (``least_shared``), so a prefix of these differences, rarest first, must
   meet a prefix of b's. Differences that only one component has meet nothing,
   and what is left of both lists bounds what a pair can share.
   Pairs are checked by the bit estimate and confirmed on full sets.

No step depends on the size of a bucket, and no bucket is paired as a whole.
Bands and the least bit estimate follow from the threshold (``layout``): a pair
at the threshold is missed by all bands with probability 5e-7 at most, and its
bit estimate falls short with 2e-7 at most. At 85 % that makes 25 bands of 5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.llm import kernels
from namesmith.operators.components import components
from namesmith.plans.storage import cut, small_batches

MINIMA = 128
#: Members of one difference that a task compares at once; longer lists are cut into blocks that meet pairwise.
BLOCK = 256
SIGNATURE = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, bits array<long>"

_rng = np.random.default_rng(85)
_A = _rng.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_C = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)


def layout(percent: int) -> tuple[int, int, int]:
    """Bands, minima in a band, and the least number of equal two-bit entries of 128 for a pair to be confirmed."""
    p = percent / 100
    rows = max((r for r in range(1, 9) if (1 - p**r) ** (MINIMA // r) <= 5e-7), default=1)
    same = p + (1 - p) / 4
    short, least = 0.0, 0
    while (short := short + comb(MINIMA, least) * same**least * (1 - same) ** (MINIMA - least)) <= 2e-7:
        least += 1
    return MINIMA // rows, rows, least


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and where each begins.

    Fewer words than ``size`` make one shingle; no words make none.
    """
    kernels.release()
    buf = kernels.lower_ascii(buf)
    starts, ends, at = kernels.words(buf, offs)
    sums = kernels.prefix(kernels.word_hashes(buf, starts, ends, 0), 0)
    every = kernels.rolling(sums, size, 0)
    out, sizes = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(every[a : b - size + 1])
            if len(found) > 1:
                found = found[np.r_[True, found[1:] != found[:-1]]]
        elif b > a:
            found = kernels.stretch(sums, np.array([a]), np.array([b]), 0)
        else:
            found = every[:0]
        out.append(found)
        sizes.append(len(found))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def minima(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MINIMA x documents; documents must not be empty."""
    short = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((MINIMA, len(at) - 1), np.uint32)
    for j in range(MINIMA):
        out[j] = np.minimum.reduceat(short * _A[j] + _B[j], at[:-1])
    return out


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Documents x bands."""
    terms = (least[: bands * rows].astype(np.uint64) + np.uint64(1)) * _C[: bands * rows, None]
    keys = terms.reshape(bands, rows, -1).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(kernels.BASE[0])
    return kernels.mix(np.ascontiguousarray(keys.T))


def low_bits(least: np.ndarray) -> np.ndarray:
    """Documents x 4: two bits of every minimum."""
    two = ((least * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64)
    shifts = (2 * np.arange(32, dtype=np.uint64))[None, :, None]
    return np.bitwise_or.reduce(two.reshape(4, 32, -1) << shifts, axis=1).T.copy()


def lists(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    """An array<long> column with a row of ``rows`` where present, else an empty one."""
    sizes = np.where(present, rows.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), kernels.signed(rows.reshape(-1)))


def signatures(docs: DataFrame, size: int = 5, percent: int = 85, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: set size, set fingerprint (128 bits), band keys, packed low bits, carried columns."""
    n_bands, n_rows, _ = layout(percent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text"))):
                flat, at = shingle_sets(buf, offs, size)
                n = np.diff(at)
                present = n > 0
                begins = np.r_[at[:-1][present], at[-1]]
                if present.any():
                    least = minima(flat, begins)
                    one = np.add.reduceat(kernels.mix(flat + np.uint64(kernels.BASE[0])), begins[:-1])
                    two = np.add.reduceat(kernels.mix(flat ^ np.uint64(kernels.BASE[1])), begins[:-1])
                    bands, bits = band_keys(least, n_bands, n_rows), low_bits(least)
                else:
                    one = two = np.zeros(0, np.uint64)
                    bands, bits = np.zeros((0, n_bands), np.uint64), np.zeros((0, 4), np.uint64)
                sets = np.zeros((2, len(n)), np.uint64)
                sets[0, present], sets[1, present] = one, two
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), pa.array(n), kernels.signed(sets[0]), kernels.signed(sets[1]), lists(bands, present), lists(bits, present), *(batch.column(c).slice(first, len(n)) for c in carry)],
                    names=["doc_id", "n_shingles", "set1", "set2", "bands", "bits", *carry],
                )

    return docs.mapInArrow(emit, ", ".join([SIGNATURE, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)]))


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles array<long>) of (node, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text"))):
                flat, at = shingle_sets(buf, offs, size)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(at) - 1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), kernels.signed(flat))], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(emit, "node long, shingles array<long>")


def equal_bits(a: str, b: str) -> Column:
    """How many of the 128 two-bit entries agree."""

    def differ(i: int) -> str:
        x = f"({a}.bits[{i}] ^ {b}.bits[{i}])"
        return f"bit_count(({x} | shiftrightunsigned({x}, 1)) & 6148914691236517205L)"

    return F.expr(f"{MINIMA} - ({' + '.join(differ(i) for i in range(4))})")


def possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes leave room for the threshold, and the bit estimate is near it."""
    sizes = F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)")
    return sizes & (equal_bits(a, b) >= layout(percent)[2])


def least_shared(percent: int) -> Column:
    """How many differences from the head a member (columns n, head_n, apart) shares at least with a partner in another component.

    Sets of x and y elements are linked if they differ by no more than
    (100 - p) / (100 + p) * (x + y) elements. A partner has at most 100 n / p
    elements, so all but n (100 - p) / p of the differences are shared. If the
    member is linked to the head, its partner isn't, and more than
    p / (100 + p) of them are shared. If it isn't, at least half of what keeps
    it from the head is.
    """
    p = percent
    by_size = F.expr(f"apart - n * {100 - p} div {p}")
    near = F.expr(f"apart * {p} div {100 + p} + 1")
    far = F.expr(f"({100 + p} * apart - {100 - p} * (n + head_n)) div {2 * (100 + p)}")
    return F.greatest(F.lit(1).cast("long"), by_size, F.when(F.expr(f"{100 + p} * apart <= {100 - p} * (n + head_n)"), near).otherwise(far))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("left") + F.size("right")).alias("n"), F.size(F.array_intersect("left", "right")).alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("a", "b")


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (head, node) with apart, n, head_n and tokens: shingles that only one of both has, those of the head as complements."""
    own = members.join(sets.select("node", "shingles"), "node").join(sets.select(F.col("node").alias("head"), F.col("shingles").alias("known")), "head")
    tokens = F.concat(F.array_except("shingles", "known"), F.transform(F.array_except("known", "shingles"), lambda x: F.bitwise_not(x)))
    told = own.withColumn("n", F.size("shingles").cast("long")).withColumn("head_n", F.size("known").cast("long")).withColumn("tokens", tokens)
    return told.select(*members.columns, "n", "head_n", F.size("tokens").cast("long").alias("apart"), "tokens")


def meetings(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members in different parts whose prefixes of differences meet and whose bits are near enough."""
    tokens = members.select("head", "node", "part", F.explode("tokens").alias("token"))
    # Nothing crosses parts at a token that one part has alone.
    common = tokens.groupBy("head", "token").agg(F.count("*").alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("head", "token", "n")
    met = tokens.join(common, ["head", "token"]).groupBy("head", "node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("found"))
    facts = members.select("head", "node", "part", "bits", "n", "apart", least_shared(percent).alias("least"))
    prefix = F.slice("found", F.lit(1), F.greatest(F.lit(0), F.size("found") - F.col("least").cast("int") + 1))
    # rest: how many differences, this one included, can be shared if this one is the first that is.
    rows = met.join(facts, ["head", "node"]).select("head", "node", "part", "bits", "n", "apart", F.size("found").alias("size"), F.posexplode(prefix).alias("at", "x"))
    rows = rows.select("head", F.col("x.token").alias("token"), F.ceil(F.col("x.n") / BLOCK).alias("blocks"), "node", "part", "bits", "n", "apart", (F.col("size") - F.col("at")).alias("rest"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # Every two blocks of a list meet once: key (i, j) with i <= j.
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = cut(dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other"), "prefixes")
    u, v = dealt.alias("u"), dealt.alias("v")
    same = F.expr("u.head = v.head and u.token = v.token and u.i = v.i and u.j = v.j and u.node < v.node and u.part <> v.part and (u.i = u.j or u.own <> v.own)")
    within = F.expr(f"{100 + percent} * (u.apart + v.apart - 2 * least(u.rest, v.rest)) <= {100 - percent} * (u.n + v.n)")
    return u.join(v, same & within & possible("u", "v", percent)).select(F.col("u.node").alias("a"), F.col("v.node").alias("b")).distinct()


def links(texts: Callable[[DataFrame], DataFrame], classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes (node), enough to join their components. texts gives (node, text) of some nodes."""
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = cut(keys.join(shared, "key"), "buckets")
    reach = buckets.groupBy("node").agg(F.sum("members").alias("reach"))
    sets = cut(full_sets(texts(reach.select("node")), size), "sets")
    facts = reach.join(classes, "node").select("node", F.col("n_shingles").alias("n"), "bits")
    heads = buckets.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node")).getField("node").alias("head"))
    stars = cut(buckets.join(heads, "key").where("node <> head").select("head", "node").distinct(), "stars")
    x, y = facts.alias("x"), facts.alias("y")
    tried = stars.alias("s").join(x, F.expr("s.head = x.node")).join(y, F.expr("s.node = y.node"))
    first = cut(confirmed(tried.where(possible("x", "y", percent)).select(F.col("s.head").alias("a"), F.col("s.node").alias("b")), sets, percent), "links")
    parts = components(first, "a", "b")
    apart = stars.join(parts, "node", "left").select("head", "node", F.coalesce("component", "node").alias("part"))
    split = apart.groupBy("head").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("head")
    members = apart.join(split, "head").join(classes.select("node", "bits"), "node").select("head", "node", "part", "bits")
    open_members = cut(differences(members, sets), "differences")
    second = confirmed(meetings(open_members, percent), sets, percent)
    return first.union(cut(second, "links"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept, n_equal, mark, component.

    Documents are linked at 100 * intersection >= percent * union of their
    distinct lower-cased word shingles; texts under ``size`` words are one
    shingle. Null, empty and blank texts have no shingles and stand alone.

    n_equal counts the rows with its shingle set, mark is the hash of the text,
    component the least set in its component (null without shingles). Equal rows
    are equal documents; texts that share a doc_id but differ are documents of
    their own, linked only if their sets are. Rows without doc_id are left out.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).where(F.col("doc_id").isNotNull())
    signed = cut(signatures(rows, size, percent, ("mark",)), "signatures")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "mark", "n_shingles", "bands", "bits")).alias("r"), F.count("*").alias("n_equal"))
    # A class goes by the first half of its fingerprint.
    classes = cut(classes.select("set2", "n_equal", "r.*", F.col("set1").alias("node")), "classes")

    def texts(nodes: DataFrame) -> DataFrame:
        # The hint keeps one plan at all sizes: the list of candidates follows the corpus.
        wanted = classes.select("doc_id", "mark", "node").join(nodes, "node", "left_semi")
        return rows.join(wanted.hint("merge"), ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.first("text").alias("text"), F.first("node").alias("node")).select("node", "text")

    parts = components(links(texts, classes, size, percent), "a", "b")
    named = classes.join(parts, "node", "left").select("node", "set2", "n_equal", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    told = named.drop("doc_id").join(least, "component").withColumnRenamed("node", "set1")
    own = full.select("doc_id", "n_shingles", "set1", "set2", "mark").join(told, ["set1", "set2"])
    columns = ["doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "n_equal", "mark", "component"]
    none = signed.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_equal", F.lit(1).cast("long")).withColumn("component", F.lit(None).cast("long"))
    return own.select(*columns).union(none.select(*columns))
