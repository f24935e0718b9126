"""Nearest words for many words: the exact way against numpy, the index against the exact way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesmith.operators import neighbours

EMBEDDINGS = "/root/testdata/sf0.1/embeddings.parquet"


def plain(rows, queries, n):
    usable = sorted((w, np.array(v)) for w, v in rows if v and None not in v and np.isfinite(v).all() and any(v))
    out = set()
    for q, v in queries:
        if not v or None in v or not np.isfinite(v).all() or not any(v):
            continue
        v = np.array(v)
        near = sorted((-round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 12), w) for w, x in usable)
        out |= {(q, k + 1, w, round(-s, 6)) for k, (s, w) in enumerate(near[:n])}
    return out


def odd(n=300, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"w{i}", [float(x) for x in rng.integers(-3, 4, dim)]) for i in range(n)]
    rows += [(f"same{i}", [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(40)]
    return rows + [("zero", [0.0] * dim), ("nan", [float("nan")] * dim), ("inf", [float("inf")] + [0.0] * (dim - 1)), ("hole", [1.0, None] + [0.0] * (dim - 2))]


@pytest.mark.parametrize("block", [1 << 14, 7])
def test_exact_way(spark, block):
    """Ties, copies, zero and broken vectors, and queries in several blocks."""
    rows = odd()
    store = spark.createDataFrame([*rows, (None, [1.0] * 6), ("null", None)], "word string, vec array<double>").repartition(3)
    asked = rows[:20] + rows[-6:]
    got = neighbours.nearest_exact(spark.createDataFrame(asked + asked[:3], "word string, vec array<double>"), store, 5, block).collect()
    assert {(r.query, r["rank"], r.word, round(r.similarity, 6)) for r in got} == plain(rows, asked, 5)


def test_index_with_all_lists_is_exact(spark):
    rows = odd()
    store = spark.createDataFrame(rows, "word string, vec array<double>").repartition(3)
    index = neighbours.build(store, lists=8)
    got = index.search(store, 5, probes=8).collect()
    assert {(r.query, r["rank"], r.word, round(r.similarity, 6)) for r in got} == plain(rows, rows, 5)
    assert index.rows.count() == 340


def test_recall_of_the_index(spark):
    """Ids divisible by 100 against all rows: 0.9 or more of the ten nearest."""
    store = spark.read.parquet(EMBEDDINGS).select(F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").alias("vec"), "vec_id")
    asked = store.where("vec_id % 100 = 0")
    exact = {(r.query, r.word) for r in neighbours.nearest_exact(asked, store).collect()}
    index = neighbours.build(store)
    found = {(r.query, r.word) for r in index.search(asked).collect()}
    assert len(exact) == 200
    assert len(exact & found) / len(exact) >= 0.9


def test_a_list_of_copies_is_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SEGMENT", 16)
    rows = [(f"c{i:03d}", [1.0, 1.0]) for i in range(200)] + [("x", [1.0, -1.0]), ("y", [-1.0, 0.5])]
    store = spark.createDataFrame(rows, "word string, vec array<double>")
    index = neighbours.build(store, lists=3)
    assert index.rows.groupBy("list", "segment").count().agg(F.max("count")).first()[0] < 60
    got = index.search(store, 3, probes=3).collect()
    assert {(r.query, r["rank"], r.word, round(r.similarity, 6)) for r in got} == plain(rows, rows, 3)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "word string, vec array<double>")
    some = spark.createDataFrame([("a", [1.0, 0.0])], "word string, vec array<double>")
    assert neighbours.nearest_exact(some, none).collect() == []
    assert neighbours.nearest_exact(none, some).collect() == []
    assert neighbours.build(none) is None
