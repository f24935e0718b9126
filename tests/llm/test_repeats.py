import hashlib
import random
import re

import pytest

from namesmith.llm import repeats, substring_dedup, suffix_dedup

from .helpers import WORD, corpus, frame


def bytes_by_hand(rows, depth):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if b[p : p + depth] in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(b[p : p + depth])
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), len(b) - len(rest), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    return out


def words_by_hand(rows, n):
    first, words, out = {}, {i: WORD.findall(t or "") for i, t in rows}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][p : p + n]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("depth", "seed"), [(100, 20), (30, 8)])
def test_bytes(spark, depth, seed):
    rows = corpus()
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup_bytes(frame(spark, rows), depth, seed).collect()}
    assert got == bytes_by_hand(rows, depth)


def test_bytes_kept_is_what_remains(spark):
    rows = corpus()
    for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert len(r.kept) == r.n_bytes - r.n_removed


@pytest.mark.parametrize(("length", "seed"), [(13, 4), (6, 2)])
def test_words(spark, length, seed):
    rows = corpus()
    got = {r.doc_id: tuple(r)[1:4] for r in substring_dedup.dedup_words(frame(spark, rows), length, seed).collect()}
    assert got == words_by_hand(rows, length)


def test_words_leave_untouched_texts_as_they_are(spark):
    rows = corpus()
    texts = dict(rows)
    for r in substring_dedup.dedup_words(frame(spark, rows), carry=("lang", "source")).collect():
        if r.n_removed == 0:
            assert r.kept == (texts[r.doc_id] or "")


def test_empty_and_repeated_rows(spark):
    none = frame(spark, corpus()).limit(0)
    assert suffix_dedup.dedup_bytes(none).count() == 0
    assert substring_dedup.dedup_words(none).count() == 0
    assert substring_dedup.maximal_repeats(none).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    twice = frame(spark, [(1, text), (1, text), (2, text), (None, text)])
    got = sorted(tuple(r)[:3] for r in substring_dedup.dedup_words(twice).collect())
    assert got == [(1, 60, 0), (1, 60, 0), (2, 60, 60)]
    size = len(text)
    assert sorted(tuple(r)[:4] for r in suffix_dedup.dedup_bytes(twice).collect()) == [(1, size, 0, 0), (1, size, 0, 0), (2, size, size, 1)]


def test_repeated_rows_change_nothing(spark):
    rows = corpus()
    again = [rows[i] for i in range(0, len(rows), 2)] + [rows[14]] * 5
    got = suffix_dedup.dedup_bytes(frame(spark, rows + again)).collect()
    want = bytes_by_hand(rows, 100)
    assert len(got) == len(rows) + len(again) and all(tuple(r)[1:5] == want[r.doc_id] for r in got)
    got = substring_dedup.dedup_words(frame(spark, rows + again)).collect()
    want = words_by_hand(rows, 13)
    assert len(got) == len(rows) + len(again) and all(tuple(r)[1:4] == want[r.doc_id] for r in got)


def test_one_doc_id_with_two_texts(spark):
    """They are documents of their own: spans of one are not cut from the other, and in bytes only the later one loses what both have."""
    shared, a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "sab")
    both = [(3, f"{a} {shared}"), (3, f"{shared} {b}")]
    words = substring_dedup.dedup_words(frame(spark, [*both, (9, shared)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in words) == [(3, 80, 0), (3, 80, 0), (9, 40, 40)]
    found = {r.n_removed for r in suffix_dedup.dedup_bytes(frame(spark, both)).collect()}
    assert len(found) == 2 and min(found) == 0 and max(found) >= len(shared)


@pytest.mark.parametrize("least", [1, 8])
def test_hot_seeds(spark, monkeypatch, least):
    """With every document sampled, seeds that many have are salted; results don't change."""
    monkeypatch.setattr(repeats, "SAMPLED", 1)
    monkeypatch.setattr(repeats, "LEAST", least)
    monkeypatch.setattr(repeats, "SALTS", 3)
    monkeypatch.setattr(repeats, "HOT", 4000)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(400)}"
    notice = "this notice of twenty words is found in every text of the corpus at some place or other and says nothing".split()
    rows = [(i, " ".join([word() for _ in range(rng.randrange(30))] + notice[: 14 + i % 8] + [word() for _ in range(rng.randrange(30))])) for i in range(120)]
    rows += [(200 + i, " ".join(notice)) for i in range(40)] + corpus()[:0]
    texts = repeats.texts(frame(spark, rows))
    assert repeats.hot_seeds(texts.select("doc_id", "text", "mark"), "words", 13, 4) is not None
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect()} == bytes_by_hand(rows, 100)
    assert {r.doc_id: tuple(r)[1:4] for r in substring_dedup.dedup_words(frame(spark, rows)).collect()} == words_by_hand(rows, 13)


def test_maximal_repeats(spark):
    rows = corpus()
    spans = {}
    for r in substring_dedup.maximal_repeats(frame(spark, rows)).collect():
        spans.setdefault(r.doc_id, []).append((r.lo, r.hi))
    for i, (_, removed, _) in words_by_hand(rows, 13).items():
        own = sorted(spans.get(i, []))
        assert sum(b - a for a, b in own) == removed and all(b - a >= 13 for a, b in own)
        assert all(x[1] < y[0] for x, y in zip(own, own[1:]))
