"""Shards by permuted row numbers: the permutation, its inverse, and odd tables."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from namesmith.llm import sharding
from tests.llm.helpers import corpus, frame


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 1000])
def test_permutation_and_inverse(spark, n):
    x = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("x"))
    rows = x.withColumn("back", sharding.permuted(F.col("x"), n, 7, back=True)).collect()
    assert sorted(r.x for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


def test_place_and_row_at(spark):
    n, shards = 333, 7
    at = spark.range(n).select("id", sharding.place(F.col("id"), n, shards).alias("at")).select("id", "at.*")
    back = at.withColumn("row", sharding.row_at(F.col("shard"), F.col("slot"), n, shards))
    assert all(r.row == r.id for r in back.collect())
    none = spark.range(1).select(sharding.row_at(F.lit(6), F.lit(n), n, shards).alias("a"), sharding.row_at(F.lit(-1), F.lit(0), n, shards).alias("b")).first()
    assert none.a is None and none.b is None


def test_it_shuffles_and_seeds_differ(spark):
    n = 4096
    both = spark.range(n).select("id", *(sharding.permuted(F.col("id"), n, s).alias(f"x{s}") for s in (1, 2))).collect()
    assert sum(r.x1 == r.x2 for r in both) < 12
    assert abs(sum(r.x1 < r.id for r in both) - n / 2) < 200
    assert sum(abs(r.x1 - s.x1) == 1 for r, s in zip(both, both[1:], strict=False)) < 20


def test_rows_law_whatever_the_layout(spark):
    rows = corpus() + [(None, "no id"), (None, None), (5, "two"), (5, "texts"), (6, "copy"), (6, "copy"), (6, "copy")]
    found = sharded = {}
    for parts in (1, 5):
        got = sharding.sharded(frame(spark, rows).repartition(parts), 16).collect()
        assert len(got) == len(rows)
        counts = Counter(r.shard for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
        for s in counts:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
        assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
        sharded = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got)
        assert not found or found == sharded
        found = sharded
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter(k[:3] for k in found.elements()) == want


def test_equal_rows_do_not_share_a_range(spark):
    """One row repeated makes even ranges, and any number of them is numbered once each."""
    same = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.numbered(same, ["doc_id", "text"])
    assert sorted(r.row for r in rows.select("row").collect()) == list(range(5000))
    assert sharding.sharded(same, 3).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_empty(spark):
    empty = frame(spark, corpus()[:1]).limit(0)
    assert sharding.sharded(empty).collect() == []


def test_written_shards_hold_all_columns(spark, tmp_path):
    docs = frame(spark, corpus()).withColumn("shard", F.lit("other"))
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == set(docs.columns) | {"slot"}
    assert Counter(map(tuple, back.select("doc_id", "text", "score", "n").collect())) == Counter(map(tuple, docs.select("doc_id", "text", "score", "n").collect()))
    want = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(docs, 4).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want
