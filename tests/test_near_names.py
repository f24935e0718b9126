"""Edit distance inside blocks against every pair."""

import random

import pytest

from namesmith.operators import near_names
from namesmith.operators.hierarchy import edits


def blocks(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß火") for _ in range(rng.randint(0, 12))) for _ in range(25)]
    rows = []
    for _ in range(140):
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z", "é"])
        rows.append((rng.choice(["p", "q"]), "".join(x)))
    return rows + rows[:5] + [(None, "abc"), ("p", None), ("p", ""), ("p", "a" * 300), ("p", "a" * 299 + "b")]


@pytest.mark.parametrize("d", [0, 1, 2, 4])
def test_against_all_pairs(spark, d):
    rows = blocks(d)
    got = {tuple(r) for r in near_names.near_names(spark.createDataFrame(rows, "b string, n string").repartition(3), "b", "n", d).collect()}
    names = sorted({r for r in rows if None not in r})
    want = {(b, x, y, edits(x, y)) for b, x in names for c, y in names if b == c and x < y and abs(len(x) - len(y)) <= d and edits(x, y) <= d}
    assert got == want
    assert d == 0 or len(want) > 20


def test_nothing(spark):
    assert near_names.near_names(spark.createDataFrame([], "b string, n string"), "b", "n", 2).collect() == []


def test_far_fewer_meetings_than_pairs(spark):
    """Names that share nothing don't meet."""
    rng = random.Random(9)
    rows = [("p", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))) for _ in range(400)]
    df = spark.createDataFrame(rows, "block string, name string")
    keys = lambda f, as_: df.select("block", df.name.alias(as_), near_names.F.explode(f(df.name, 2)).alias("key"))
    met = keys(near_names.segments, "s").join(keys(near_names.substrings, "t"), ["block", "key"]).where("s <> t").count()
    assert met < 400 * 399 / 20


def test_keys_are_not_sent_through_the_driver(spark):
    """Keys are many times the names: no side is broadcast, whatever the estimated size of the names."""
    df = near_names.near_names(spark.createDataFrame([("p", "abcdef"), ("p", "abcdeg")], "b string, n string"), "b", "n", 2)
    assert [tuple(r) for r in df.collect()] == [("p", "abcdef", "abcdeg", 1)]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
