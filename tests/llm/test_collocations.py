"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from namesmith.llm import collocations
from tests.llm.helpers import corpus, lower_ascii


def plain(rows, longest=5, least=100, share=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    known = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, words), f in known.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                part = (lang, words[i : i + n])
                if part in known and 100 * f >= share * known[part]:
                    dropped.add(part)
    out = []
    for (lang, words), a in known.items():
        if (lang, words) in dropped:
            continue
        n = totals[lang]
        score, _, l, r = min((1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), l, r, n))
    got, seen = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            got.append((lang, seen[lang], phrase.decode(), -a, l, r, n, -score))
    return got


def mixed(n=400, seed=5):
    rng = random.Random(seed)
    words = "the of and river Stone über 火 ab\x00c w1 w2".split(" ")
    phrases = ["new york city hall", "a b c d e f", "the the the the", "über den wolken"]
    rows = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "\x0c"]) for p in parts)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, ""), ("en", " .,;\n"), ("en", "x" * 3000 + " y"), ("en", "x" * 3000 + " y")] + [("de", t) for _, t in corpus()]


def frame(spark, rows):
    full = [(i, t, lang, "n", 1, "p", 2.0) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, n string, m int, phrase string, score double").repartition(3)


@pytest.mark.parametrize(("least", "share", "longest"), [(2, 100, 5), (5, 100, 5), (3, 60, 4), (4, 100, 7), (3, 100, 2)])
def test_against_plain_counting(spark, least, share, longest):
    rows = mixed()
    got = collocations.collocations(frame(spark, rows), longest, least, share, 10_000, size=3000).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, longest, least, share, 10_000))
    assert len(got) > 20


def test_top_and_ties(spark):
    rows = mixed(100)
    got = collocations.collocations(frame(spark, rows), least=2, top=7).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, least=2, top=7))


def test_a_full_bitmap_only_lets_more_through(spark):
    rows = mixed(150)
    got = collocations.collocations(frame(spark, rows), least=3, top=10_000, most_bits=1 << 5).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, least=3, top=10_000))


def test_long_text_repeated_rows_and_empty_table(spark):
    rows = [("en", "one two " * 30_000), ("en", "one two"), ("en", "one two")]
    assert [tuple(r) for r in collocations.collocations(frame(spark, rows)).orderBy("rank").collect()] == plain(rows)
    assert collocations.collocations(frame(spark, rows).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [("en", None), (None, "a b")])).collect() == []


def test_big_products(spark):
    """Scores whose products pass 64 bits are exact."""
    n, a, l, r = 6_000_000_000_001, 5_999_999_999_999, 6_000_000_000_000, 5_999_999_999_999
    score = spark.sql(f"select (cast(1000 * {a} as decimal(18, 0)) * cast({n} as decimal(18, 0))) div (cast({l} as decimal(18, 0)) * cast({r} as decimal(18, 0))) as s").first().s
    assert score == 1000 * a * n // (l * r)


def test_suffixes_are_sorted_and_lcp_counts(spark):
    """Intervals of one shard hold each phrase once, with its occurrences."""
    text = b"a b a b a, b a b\na b"
    shard = collocations.Shard(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(1, np.int64), np.zeros(1, np.uint64))
    for m, places, f in shard.intervals((1, 2, 3, 4, 5), np.ones(len(shard.left), bool)):
        got = dict(zip(shard.phrases(places, m).to_pylist(), f.tolist(), strict=True))
        want = Counter(" ".join(w[i : i + m]) for w in ("a b a b a".split(), "b a b".split(), "a b".split()) for i in range(len(w) - m + 1))
        assert got == dict(want)
