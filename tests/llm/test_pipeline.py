from collections import Counter

import pytest

import corpus_pipeline
from namesmith.llm import queries

from .helpers import corpus, frame
from .test_minhash import by_hand

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, corpus_pipeline.cut(stage(spark, docs, SF), name)
        assert docs.columns == before
        sizes.append(docs.count())
        assert docs.count() == docs.select("doc_id").distinct().count()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    room = Counter()
    for r in rows:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096
    assert len(room) == -(-sum(room.values()) // 4096)


def test_names():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{i}" for i in range(1, 14)]


@pytest.fixture
def odd(spark, tmp_path):
    """Documents with the awkward cases, repeated rows, a row without id, and clashing columns."""
    rows = corpus()
    docs = frame(spark, [*rows, rows[15], (None, "no id"), (9000, "idiot scum moron " * 3)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = [t for _, t in rows if t]
    spark.createDataFrame([(1, " ".join(texts[12].split()[:12])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(rows[9][0], None), (None, 1), (rows[10][0], 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut(stage(spark, docs, odd), name)
        assert after.columns == docs.columns and [t.simpleString() for t in after.schema] == [t.simpleString() for t in docs.schema], name
        docs = after
    left = {r.doc_id: r for r in docs.collect()}
    assert None not in left
    blank = [i for i, t in corpus() if not (t or "").strip()]
    assert set(blank) <= set(left)
    assert all(r.n_chars == len(r.text) for r in left.values())
    assert corpus_pipeline.run(spark, odd).count() >= len(left)


def test_empty_documents(spark, odd, tmp_path):
    none = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, odd).count() == 0


def test_near_duplicates_at_80_and_repeated_rows(spark):
    """Pairs of Jaccard 0.80 to 0.85 as brute force links them; one row of each set of repeated rows."""
    rows = []
    for k in range(40):
        text = [f"d{k}x{i}" for i in range(104)]
        other = [*text[: -15 - k % 6], *(f"e{k}x{i}" for i in range(2))]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    want = sorted(i for i, (_, _, kept) in by_hand(rows, percent=80).items() if kept)
    assert 40 < len(want) < 80
    copies = [rows[0], rows[0], (900, rows[0][1]), (900, "another text of this id")]
    left = corpus_pipeline.near_duplicates_out(spark, frame(spark, rows + copies), SF)
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == [*want, 900]
    assert left.where("doc_id = 900").first().text == "another text of this id"
