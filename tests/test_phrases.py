"""Phrase tagging by a trie against looking up every slice."""

import random

import pyarrow as pa
import pytest

from namesmith.operators import phrases


def plain(text, vocabulary, longest, inclusive):
    words = text.split() if text is not None else []
    words = words or ([""] if text is not None else [])
    most, end = (longest, len(words)) if inclusive else (longest - 1, len(words) - 1)
    out = []
    for i in range(len(words)):
        for n in range(1, most + 1):
            if i + n <= end and "_".join(words[i : i + n]) in vocabulary:
                out.append("_".join(words[i : i + n]))
    return out


def case(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "c", "d", "a_b", "_", "x", "über", "火", "e"]
    vocabulary = {"_".join(rng.choice(pool) for _ in range(rng.randint(1, 5))) for _ in range(60)}
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(50)] + [None, "", "a", "zzz " * 10, "a " * 4000]
    return vocabulary, texts


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("limit", [64 << 20, 500])
def test_against_all_slices(spark, inclusive, limit):
    """In one part and in several, with words that hold the joining sign."""
    vocabulary, texts = case(3)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    known = spark.createDataFrame([(v.upper(),) for v in sorted(vocabulary)] + [(None,), ("a",), ("a",)], "v string")
    got = dict(map(tuple, phrases.tag_phrases(rows, known, 4, inclusive=inclusive, limit=limit).collect()))
    want = {i: plain(t, vocabulary | {"a"}, 4, inclusive) for i, t in enumerate(texts)}
    assert {i: p for i, p in got.items()} == want
    assert sum(map(len, want.values())) > 100


def test_no_vocabulary_no_texts_and_repeated_ids(spark):
    rows = spark.createDataFrame([("r", "a b"), ("r", "a b"), (None, "b")], "id string, text string")
    none = spark.createDataFrame([], "v string")
    assert [r.phrases for r in phrases.tag_phrases(rows, none, 3).collect()] == [[], [], []]
    known = spark.createDataFrame([("a_b",), ("b",)], "v string")
    assert sorted((r.id or "", r.phrases) for r in phrases.tag_phrases(rows, known, 3).collect()) == [("", ["b"]), ("r", ["a_b", "b"]), ("r", ["a_b", "b"])]
    assert phrases.tag_phrases(rows.limit(0), known, 3).collect() == []
    assert [r.phrases for r in phrases.tag_phrases(rows, known, 0).collect()] == [[], [], []]


def test_texts_are_not_shuffled(spark):
    vocabulary, texts = case(4)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = phrases.tag_phrases(rows, spark.createDataFrame([(v,) for v in vocabulary], "v string"), 4)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_batches_are_followed_in_slices(spark, monkeypatch):
    """A task holds some words at a time, and slices of a batch give what the whole gives."""
    sizes = [0, 3, 4, None, 9, 1, 1, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array([None if n is None else ["w"] * n for n in sizes], pa.list_(pa.string()))], names=["words"])
    monkeypatch.setattr(phrases, "WORDS", 5)
    assert [x.num_rows for x in phrases.slices(batch)] == [2, 2, 1, 4]
    vocabulary, texts = case(4)
    got = [phrases.tag_batch(phrases.Trie(sorted(vocabulary)), x.column("words"), 4, True) for x in phrases.slices(pa.RecordBatch.from_arrays([pa.array([t.split() if t else [] for t in texts])], names=["words"]))]
    whole = phrases.tag_batch(phrases.Trie(sorted(vocabulary)), pa.array([t.split() if t else [] for t in texts]), 4, True)
    assert [p for g in got for p in g[3].to_pylist()] == whole[3].to_pylist() and len(got) > 5
