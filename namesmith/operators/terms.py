"""The model's score terms of single mentions, and of two under a new root, for many pairs at once.

Bags meet as lists of tokens and counts. A few numbers of each bag and of what two
bags share, and the terms from them, are numpy's, a batch at a time. They are those of
``hierarchy``'s nodes, which a test holds them against.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from namesmith.operators.hierarchy import Model, Name, name_score

KINDS = ("emails", "institutions", "coauthors", "topics", "text", "keywords", "venues")
NAMES = ("firstNames", "middleNames")


def weighed(n: np.ndarray) -> np.ndarray:
    return n * np.log(n)


def measured(rows: DataFrame) -> DataFrame:
    """rows (bags in columns), with each bag's tokens and counts in two arrays, so that batches of them are flat."""
    lists = [f(F.col(k)).alias(f"{k}_{n}") for k in KINDS for n, f in (("tokens", F.map_keys), ("counts", F.map_values))]
    return rows.select(*(c for c in rows.columns if c not in KINDS), *lists)


def flattened(tokens: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(kinds of each bag; row, token and count of each entry); null is an empty bag."""
    kinds = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return kinds, np.repeat(np.arange(len(kinds)), kinds), tokens.flatten(), counts.flatten().to_numpy(zero_copy_only=False)


def numbers(one: tuple[pa.Array, pa.Array], other: tuple[pa.Array, pa.Array]) -> dict[str, np.ndarray]:
    """Of two columns of bags, row by row: (kinds, sum, square, weighed) of each one's counts n, and (kinds, dot, more) of the tokens that both have.

    ``weighed`` is the sum of n ln n, and ``more`` is what that gains where the bags are added.
    """
    found, sides = {}, (flattened(*one), flattened(*other))
    size = len(sides[0][0])
    added = lambda row, x: np.bincount(row, x, size).astype(float)  # noqa: E731 (of nothing it is whole numbers)
    for x, (kinds, row, _, n) in zip(("", "2"), sides, strict=True):
        found |= {f"kinds{x}": kinds.astype(float), f"sum{x}": added(row, n), f"square{x}": added(row, n * n), f"weighed{x}": added(row, weighed(n))}
    (_, row, tokens, n), (_, row2, tokens2, m) = sides
    codes = pa.concat_arrays([tokens, tokens2]).dictionary_encode()
    ids, most = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(codes.dictionary))
    _, at, at2 = np.intersect1d(row * most + ids[: len(row)], row2 * most + ids[len(row) :], assume_unique=True, return_indices=True)
    row, n, m = row[at], n[at], m[at2]
    return found | {"kinds_both": added(row, np.ones(len(row))), "dot_both": added(row, n * m), "more_both": added(row, weighed(n + m) - weighed(n) - weighed(m))}


NUMBERS = (*(f"{n}{x}" for x in ("", "2") for n in ("kinds", "sum", "square", "weighed")), *(f"{n}_both" for n in ("kinds", "dot", "more")))


def paired(pairs: DataFrame) -> DataFrame:
    """Flat columns for ``scores`` of (one, other): measured rows as structs, other may be null."""
    plain = [F.col("one.id").alias("id"), F.col("other").isNotNull().alias("two"), F.col("one.vec").alias("vec"), F.col("other.vec").alias("vec2")]
    for k in NAMES:
        plain += [F.array_sort(F.map_keys(f"one.{k}")).alias(k), F.array_sort(F.map_keys(f"other.{k}")).alias(f"{k}2")]
    lists = [F.col(f"{side}.{k}_{n}").alias(f"{k}_{n}{x}") for k in KINDS for x, side in (("", "one"), ("2", "other")) for n in ("tokens", "counts")]
    kept = pairs.select(*plain).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: batch.column(c) for c in kept.names}
            for k in KINDS:
                sides = ((batch.column(f"{k}_tokens{x}"), batch.column(f"{k}_counts{x}")) for x in ("", "2"))
                found |= {f"{k}_{n}": pa.array(v) for n, v in numbers(*sides).items()}
            yield pa.RecordBatch.from_pydict(found)

    schema = StructType([*kept.fields, *(StructField(f"{k}_{n}", DoubleType()) for k in KINDS for n in NUMBERS)])
    return pairs.select(*plain, *lists).mapInArrow(run, schema)


@lru_cache(1 << 16)
def name_term(names: tuple[str, ...], is_root: bool, w: Name) -> float:
    return name_score(names, is_root, w) - (w.missing if is_root and not names else 0.0)


def spread_of(weights: np.ndarray) -> np.ndarray:
    """``hierarchy.spread`` of each row's absolute values."""
    weights = np.abs(weights)
    whole = weights.sum(axis=1, keepdims=True)
    share = weights / np.where(whole > 0, whole, 1.0)
    return -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1) / np.log(max(2, weights.shape[1]))


def crowd(kinds: np.ndarray, whole: np.ndarray, weighed: np.ndarray, entropy: float, prior: float) -> np.ndarray:
    """A root's terms for a bag: entropy over its maximum, and distinct tokens over all."""
    safe = np.maximum(whole, 1.0)
    spread = np.where(kinds > 1, (np.log(safe) - weighed / safe) / np.log(np.maximum(kinds, 2.0)), 0.0)
    return -(entropy * spread + prior * kinds / safe)


def scores(rows: pd.DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each row's score alone, and what it gains with the other under a new root (NaN without one)."""
    two = rows["two"].to_numpy(bool)
    alone, other = (np.full(len(rows), model.size_weight) for _ in range(2))
    pair = np.full(len(rows), model.size_weight * 2**model.size_exponent)  # a root of both, with two children
    for k, w in model.names.items():
        for i, (a, b) in enumerate(zip(rows[k], rows[f"{k}2"], strict=True)):
            a, b = tuple(a), () if b is None else tuple(b)
            alone[i] += name_term(a, True, w)
            other[i] += name_term(b, True, w)
            pair[i] += name_term(tuple(sorted({*a, *b})), True, w) + name_term(a, False, w) + name_term(b, False, w)
    for k, w in model.bags.items():
        kinds, whole, square, weighed, kinds2, whole2, square2, weighed2 = (rows[f"{k}_{n}{x}"].to_numpy(float) for x in ("", "2") for n in ("kinds", "sum", "square", "weighed"))
        common, dot, more = (rows[f"{k}_{n}_both"].to_numpy(float) for n in ("kinds", "dot", "more"))
        alone += crowd(kinds, whole, weighed, w.entropy, w.prior)
        other += crowd(kinds2, whole2, weighed2, w.entropy, w.prior)
        pair += crowd(kinds + kinds2 - common, whole + whole2, weighed + weighed2 + more, w.entropy, w.prior)
        cosine = dot / np.sqrt(np.maximum(square * square2, 1.0))
        pair += np.where((kinds > 0) & (kinds2 > 0), 2 * w.weight * (cosine + w.shift), 0.0)
    if model.title.weight and len(rows) and len(rows["vec"].iloc[0]):
        a = np.stack(rows["vec"].to_list())
        b = np.stack([np.zeros(a.shape[1]) if v is None else v for v in rows["vec2"]])
        alone -= model.title.entropy * spread_of(a)
        other -= model.title.entropy * spread_of(b)
        pair -= model.title.entropy * spread_of(a + b)
        norms = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        cosine = (a * b).sum(axis=1) / np.where(norms > 0, norms, 1.0)
        pair += np.where(norms > 0, 2 * model.title.weight * (cosine + model.title.shift), 0.0)
    return alone, np.where(two, pair - alone - other, np.nan)
