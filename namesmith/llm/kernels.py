"""Numpy helpers that run inside Spark tasks on the raw Arrow text buffers.

Everything here sees one slice of a batch at a time: ``slices`` cuts a batch
into runs of whole documents of about ``SLICE`` bytes, so memory follows the
slice (or one very long document), never the partition.
"""

from __future__ import annotations

import gc
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 18
#: Bytes from which a word isn't hashed as a polynomial.
LONG = 512

_rng = np.random.default_rng(20240229)
BYTES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
SPACES = np.ones(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = False


def worker_store() -> types.ModuleType:
    """A module made in the Python worker, so that what it holds outlives a task."""
    return sys.modules.setdefault("namesmith_worker_store", types.ModuleType("namesmith_worker_store"))


def release() -> None:
    """Lets go of the large table that another operator left in this worker."""
    if worker_store().__dict__.pop("words", None) is not None:
        gc.collect()
        pa.default_memory_pool().release_unused()


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value begins; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(buf: np.ndarray, offs: np.ndarray, size: int = SLICE):
    """(first row, bytes, offsets) of runs of whole documents."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; one copy per Python worker."""
    made = worker_store().__dict__.setdefault("powers", {})
    if which not in made or len(made[which][0]) < n:
        size = max(n, SLICE + (1 << 17))
        up, down = np.full(size, BASE[which], np.uint64), np.full(size, pow(BASE[which], -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return made[which][0][:n], made[which][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix(tokens: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums from which the hash of any stretch of tokens follows."""
    up, _ = powers(which, len(tokens))
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up, out=out[1:], dtype=np.uint64)
    return out


def stretch(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the stretches [lo, hi)."""
    _, down = powers(which, len(sums))
    return mix((sums[hi] - sums[lo]) * down[lo])


def rolling(sums: np.ndarray, n: int, which: int) -> np.ndarray:
    """Hashes of all stretches of n tokens."""
    if len(sums) <= n:
        return np.zeros(0, np.uint64)
    _, down = powers(which, len(sums))
    return mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def words(buf: np.ndarray, offs: np.ndarray, letters: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each document's words begin."""
    inside = letters[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty_like(inside)
    if len(buf):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    if len(buf):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hashes; of words too long for those (equal powers of two in the modulus collide) another kind."""
    found = stretch(prefix(BYTES[which][buf], which), starts, ends, which)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        found[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed=which)
    return found


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    up = (buf >= 65) & (buf <= 90)
    return buf + (up.astype(np.uint8) << 5)


def tokens_of(kind: str, buf: np.ndarray, offs: np.ndarray):
    """Two independent hash streams of the tokens ('bytes' or 'words'), document offsets and byte spans."""
    release()
    if kind == "bytes":
        return BYTES[0][buf], BYTES[1][buf], offs, None
    starts, ends, at = words(buf, offs)
    return word_hashes(buf, starts, ends, 0), word_hashes(buf, starts, ends, 1), at, (starts, ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def winnow(one: np.ndarray, two: np.ndarray, at: np.ndarray, n: int, k: int):
    """Runs of consecutive n-token windows that share their least k-token seed.

    Returns per run: seed hash, hash of all its tokens, document index, first
    and last window start and the seed's start, all inside the document. The
    seed that a window has follows from its tokens alone, so equal windows
    always meet under one seed, at one distance from it.
    """
    size = len(one)
    empty = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)]
    if size < n:
        return empty
    sums, sums2 = prefix(one, 0), prefix(two, 1)
    seeds = rolling(sums, k, 0)
    bits = np.uint64(max(1, int(size).bit_length()))
    key = (seeds >> bits << bits) | np.arange(len(seeds), dtype=np.uint64)
    least = (sliding_min(key, n - k + 1) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    counts = np.maximum(np.diff(at) - n + 1, 0)
    valid = np.zeros(size + 1, np.int8)
    has = counts > 0
    np.add.at(valid, at[:-1][has], 1)
    np.add.at(valid, (at[:-1] + counts)[has], -1)
    start = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    if not len(start):
        return empty
    own = least[start]
    cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(start) != 1)) + 1
    lo, hi = start[np.r_[0, cut]], start[np.r_[cut - 1, len(start) - 1]]
    least = own[np.r_[0, cut]]
    seed = seeds[least]
    whole = stretch(sums2, lo, hi + n, 1)
    whole = mix(whole + (hi - lo).astype(np.uint64))
    doc = np.searchsorted(at, lo, "right") - 1
    return seed, whole, doc, lo - at[doc], hi - at[doc], least - at[doc]


def cores(one: np.ndarray, two: np.ndarray, at: np.ndarray, doc: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], n: int, block: int):
    """What all windows of a block share, for the blocks of windows in the given runs.

    Blocks hold ``block`` window starts, counted from the run's seed, so equal
    windows lie in equal blocks; with 1 the core is the window. Returns two
    hashes of each core, document index, first and last start, seed, and the
    run's mark.
    """
    lo, hi, seed, mark = runs
    low, high = (lo - seed) // block, (hi - seed) // block
    count = high - low + 1
    j = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    doc, lo, hi, seed, mark = (np.repeat(x, count) for x in (doc, lo, hi, seed, mark))
    first = seed + block * j
    a, b = at[doc] + first + block - 1, at[doc] + first + n
    h1, h2 = stretch(prefix(one, 0), a, b, 0), stretch(prefix(two, 1), a, b, 1)
    return h1, h2, doc, np.maximum(lo, first), np.minimum(hi, first + block - 1), seed, mark


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the spans [lo, hi) as maximal runs."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]]


def structs(column, *fields: str) -> list[np.ndarray]:
    """Row offsets and the given integer fields of an array<struct> column; nulls have no entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return [np.r_[0, np.cumsum(sizes, dtype=np.int64)], *(flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in fields)]


def first_of_equal(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Rows that are the first of their key, and the values of each one's later equals (null if none)."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    if new.all():
        return np.arange(len(keys)), pa.nulls(len(keys), pa.list_(pa.int32()))
    keep = order[new]
    sizes = np.diff(np.r_[np.flatnonzero(new), len(keys)]) - 1
    rows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values[order[~new]].astype(np.int32)))
    return keep, pc.if_else(pa.array(sizes > 0), rows, pa.nulls(len(rows), rows.type))
