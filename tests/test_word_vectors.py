"""Word vectors on a planted corpus: words of one subject are each other's nearest."""

import random

import numpy as np
from pyspark.sql import functions as F

from namesmith.operators import features
from namesmith.operators import word_vectors as cbow

SUBJECTS = {s: [f"{s}{i}" for i in range(8)] for s in "abc"}


def planted(spark, lines=900, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(lines):
        words = SUBJECTS[rng.choice("abc")]
        rows.append((i, [rng.choice(words) if rng.random() < 0.8 else rng.choice(["the", "of"]) for _ in range(12)]))
    return spark.createDataFrame([*rows, (-1, None), (-2, []), (-3, ["rare", None, ""])], "id int, tokens array<string>")


def vectors(df, **options):
    return cbow.word_vectors(df, "tokens", **({"size": 16, "least": 20, "sample": 0, "iterations": 6, "negative": 5} | options))


def purity(found):
    """Of the seven nearest words of each subject word, the share of its own subject."""
    rows = {r.word: np.array(r.vec) for r in found.collect()}
    words = [w for s in SUBJECTS.values() for w in s]
    x = np.array([rows[w] / np.linalg.norm(rows[w]) for w in words])
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:8]
    return np.mean([[words[j][0] == words[i][0] for j in row] for i, row in enumerate(near)])


def test_planted_subjects_are_neighbours(spark):
    df = planted(spark)
    found = vectors(df)
    assert {r.word for r in found.collect()} == {w for s in SUBJECTS.values() for w in s} | {"the", "of"}
    assert purity(found) > 0.95
    store = found.select("word", "vec")
    assert {r.word[0] for r in features.nearest(store, "a3", 6).collect()} == {"a"}


def test_several_parts_learn_the_same_subjects(spark):
    assert purity(vectors(planted(spark), parts=3, iterations=10)) > 0.9


def test_repeatable_whatever_the_partitions(spark):
    df = planted(spark, 200)
    one, other = (sorted(map(str, vectors(df.repartition(n), parts=2, iterations=2, least=5).collect())) for n in (1, 6))
    assert one == other


def test_frequent_words_are_thinned_and_nothing_frequent_gives_nothing(spark):
    df = planted(spark, 300)
    assert vectors(df, sample=1e-3, iterations=1).count() == 26
    assert vectors(df, least=10**6).collect() == []
    assert vectors(df.limit(0)).collect() == []


def test_copies_of_a_line_go_to_all_parts(spark):
    same = spark.range(1000).select(F.array(F.lit("x"), F.lit("y")).alias("tokens"))
    dealt, words, parts = cbow.encoded(same.unionByName(spark.createDataFrame([(["y", "x", "z"],)], "tokens array<string>")), "tokens", 1, 100, 4)
    assert words == [("x", 1001), ("y", 1001), ("z", 1)]
    got = sorted((tuple(r.ids), r.part, r.copies) for r in dealt.collect())
    assert [(p, n) for ids, p, n in got if ids == (0, 1)] == [(p, 250) for p in range(4)]
    assert sum(n for ids, _, n in got if len(ids) == 3) == 1


def test_contexts_stay_in_their_line():
    line = np.array([0, 0, 0, 1, 1, 2])
    around = cbow.contexts(line, 3, np.random.default_rng(0))
    for i, row in enumerate(around):
        assert all(line[j] == line[i] and j != i for j in row[row >= 0])
    assert (around[5] == -1).all() and set(around[3]) <= {-1, 4}


def test_one_step_follows_the_gradient():
    """Against the loss's numerical gradient."""
    rng = np.random.default_rng(1)
    inner, outer = (rng.normal(size=(6, 4)) for _ in range(2))
    around, words = np.array([[1, 2, -1, 5]]), np.array([[0, 3, 4]])

    def loss(a, b):
        mean = a[[1, 2, 5]].mean(axis=0)
        odds = 1 / (1 + np.exp(-b[words[0]] @ mean))
        return -np.log(odds[0]) - np.log(1 - odds[1:]).sum()

    a, b = inner.copy(), outer.copy()
    cbow.step(a, b, around, words, 1e-3)
    for which, (old, new) in enumerate(((inner, a), (outer, b))):
        for i in range(6):
            for j in range(4):
                up = [inner.copy(), outer.copy()]
                up[which][i, j] += 1e-6
                slope = (loss(*up) - loss(inner, outer)) / 1e-6
                # Context words share the whole pull of their mean, as is customary.
                want = -1e-3 * slope * (3 if which == 0 else 1)
                assert abs((new - old)[i, j] - want) < 1e-6


def test_the_last_model_does_not_go_to_the_driver(spark, monkeypatch):
    df, kind, read = planted(spark, 200), type(spark.range(1)), []
    fetch = kind.toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, **k: read.append(1) or fetch(self, *a, **k))
    for iterations in (1, 3):
        read.clear()
        found = vectors(df, iterations=iterations, least=5)
        assert len(read) == iterations - 1
        assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
        assert all(len(r.vec) == 16 and any(r.vec) for r in found.collect())


def test_words_that_the_last_iteration_left_out_keep_their_vectors(spark):
    before = np.arange(600, dtype=np.float32).reshape(300, 2)
    times = [0.0] * 44
    times[3] = 4.0
    model = spark.createDataFrame([(1, 0, times, [2.0] * 88, [])], cbow.SUMS)
    found = {r.word: r.vec for r in cbow.vectors(model, [f"w{i}" for i in range(300)], before).collect()}
    assert found == {f"w{i}": [0.5, 0.5] if i == 259 else [2.0 * i, 2.0 * i + 1] for i in range(300)}


def test_scattered_changes_are_the_plain_sums():
    """Rows that come once, up to CROWD times, and more often, against adding one by one."""
    rng = np.random.default_rng(5)
    rows = np.r_[np.arange(40), rng.integers(40, 45, 25), np.full(60, 45)]
    rng.shuffle(rows)
    change = rng.normal(size=(len(rows), 6)).astype(np.float32)
    matrix = rng.normal(size=(50, 6)).astype(np.float32)
    want = matrix.astype(float)
    for r in np.unique(rows):
        own = change[rows == r].astype(float)
        want[r] += own.sum(axis=0) * min(1, cbow.CROWD / len(own))
    cbow.scatter(matrix, rows, change)
    assert np.allclose(matrix, want, atol=1e-5)
    cbow.scatter(matrix, rows[:0], change[:0])


def test_tokens_get_numbers_without_a_shuffle_of_tokens(spark, monkeypatch):
    plans, write = [], cbow.cut
    monkeypatch.setattr(cbow, "cut", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    lines = spark.createDataFrame([(["b", "x", "a", None, "", "b"],), (None,), ([],), (["a", "b"],), (["b", "a"],)], "tokens array<string>")
    dealt, words, _ = cbow.encoded(lines, "tokens", 2, 10, 1)
    assert words == [("b", 4), ("a", 3)]
    assert sorted((tuple(r.ids), r.copies) for r in dealt.collect()) == [((0, 1), 1), ((0, 1, 0), 1), ((1, 0), 1)]
    assert "Join" not in plans[0] and "posexplode" not in plans[0]
