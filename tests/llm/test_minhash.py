import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from namesmith.llm import minhash

from .helpers import WORD, corpus, frame, lower_ascii


def by_hand(rows, size=5, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower_ascii(t))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_components(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == by_hand(rows)


def test_crowd_with_outliers(spark):
    """A group in which most are linked to the middle and some only to each other."""
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        text = list(base)
        for e in range(k % 6):
            text[(k * 17 + e * 31) % 150] = f"e{k // 2 if k % 6 > 3 else k}x{e}"
        rows.append((k, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == by_hand(rows)


def test_empty_and_repeated_rows(spark):
    none = frame(spark, corpus()).limit(0)
    assert minhash.near_duplicates(none).count() == 0
    same = frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (7, "A B C D E F"), (None, "a b"), (9, None), (8, "")])
    got = sorted((r.doc_id, r.component_id, r.kept, r.n_equal) for r in minhash.near_duplicates(same).collect())
    assert got == [(5, 5, True, 3), (5, 5, True, 3), (7, 5, False, 3), (8, 8, True, 1), (9, 9, True, 1)]


def pairs_on_a_template(n, words=200, edits=(1, 1), seed=3):
    """Pairs of near copies; half of each text is the same template."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(words // 2)]
    rows = []
    for k in range(n):
        own = [f"d{k}x{i}" for i in range(words - words // 2)]
        for side in range(2):
            text = template + own
            for e in range(edits[side]):
                text[rng.randrange(len(text))] = f"e{k}x{side}x{e}"
            rows.append((2 * k + side, " ".join(text)))
    return rows


def test_one_of_a_pair_is_crowded(spark):
    """What a crowded document shares only with documents in small buckets isn't its own."""
    rows = pairs_on_a_template(150)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == by_hand(rows)


def test_distance_measured_for_one_only(spark):
    """Two copies meet in a small bucket; only one of them is also in a crowded bucket of the same head."""
    head = [f"h{i}" for i in range(60)]
    copy = [f"c{i}" for i in range(200)]
    rows = [(0, " ".join(head)), (1, " ".join(copy)), (2, " ".join([*copy, "end"]))]
    rows += [(k, " ".join(head + [f"f{k}x{i}" for i in range(300)] + copy * (k == 3))) for k in range(3, 13)]
    buckets = {0: [100, 200], 1: [100, 200], 2: [200]} | {k: [100] for k in range(3, 13)}
    facts = [(i, len(t.split()) - 4, buckets[i], [0, 0, 0, 0]) for i, t in rows]
    classes = spark.createDataFrame(facts, "node long, n_shingles long, bands array<long>, bits array<long>")
    texts = frame(spark, rows).select(F.col("doc_id").alias("node"), "text")
    got = minhash.links(lambda nodes: texts.join(nodes, "node"), classes, 5, 85).collect()
    assert [(min(r), max(r)) for r in got] == [(1, 2)]


@pytest.mark.parametrize("edits", [(1, 1), (1, 2)])
def test_boilerplate_of_half_the_text(spark, edits):
    """600 pairs near the threshold that share half of their text with all others: the links of an inverted index, none missing."""
    rows = pairs_on_a_template(600, edits=edits)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    want = by_hand(rows)
    assert sum(not kept for _, _, kept in want.values()) > 200
    assert got == want


def test_lists_longer_than_a_block(spark, monkeypatch):
    """Differences shared by many members in many components are cut into blocks, and lose nothing."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 80):
        text = list(base)
        for e in range(0, 24, 1 + k % 3):
            text[e * 5] = f"s{k % 5}x{e}"
        for _ in range(k % 4):
            text[rng.randrange(120)] = f"o{k}"
        rows.append((k, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == by_hand(rows)


def test_one_doc_id_with_two_texts(spark):
    rows = [(5, "a b c d e f g"), (5, "t u v w x y z"), (6, "t u v w x y z"), (7, "a b c d e f g"), (5, "q")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept, r.n_equal) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(5, 1, 5, True, 1), (5, 3, 5, True, 2), (5, 3, 5, True, 2), (6, 3, 5, False, 2), (7, 3, 5, False, 2)]
