import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from namesmith.llm import packing

from .helpers import corpus, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(PATH)


@lru_cache
def both():
    return Tokenizer.from_file(PATH), packing.WordIds(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abzAZ'sdmt .,!?1\n\t\x0b#é ÉßÀ×\u0301\u0130\u212a\u00a0ΣΣς火"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=5))
def test_ids_by_words(texts):
    tokenizer, words = both()
    raw = [t.encode() for t in texts]
    ids, at = words.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_special_strings(words, tokenizer):
    text = "a <|endoftext|> b<|startoftext|>"
    ids, _ = words.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, texts, tokenizer, size):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(p, a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), size))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_bin), sum(r.length for r in rows)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_pack(spark, tokenizer, rule):
    rows = corpus()
    room = packing.Capacity(256, 256, 256 * 256, rule=rule)
    got = packing.pack(frame(spark, rows), PATH, room, with_ids=True).collect()
    bins, tokens = check(got, rows, tokenizer, 256)
    assert bins <= 1.15 * tokens / 256 + 1
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_all_capacities_hold(spark):
    rows = [(i, "a " * (i % 40)) for i in range(200)]
    room = packing.Capacity(64, 3, 1600, (1.0, 1.0, 1.0))
    bins = {}
    for r in packing.pack(frame(spark, rows), PATH, room).collect():
        bins.setdefault(r.sequence_id, []).append(r.length)
    for lengths in bins.values():
        assert sum(lengths) <= 64 and len(lengths) <= 3 and sum(x * x for x in lengths) <= 1600


def test_plan_uses_every_piece():
    rng = np.random.default_rng(3)
    counts = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 4097), 400, replace=False), rng.integers(1, 10**9, 400))}
    plan = packing.plan(counts, packing.Capacity())
    placed = {}
    for length, uses, times in zip(plan["length"], plan["uses"], plan["times"]):
        placed[int(length)] = placed.get(int(length), 0) + int(uses * times)
    assert placed == counts
    assert len(plan["length"]) < 5000


def best_fit_by_hand(lengths, room):
    """Piece by piece, longest first, into the best of all open sequences."""
    full, bins = np.array([room.tokens, room.documents, room.attention]), []
    for x in sorted(lengths, reverse=True):
        need = np.array([x, 1, x * x])
        fits = [b for b in bins if (b[0] >= need).all()]
        if room.rule == "norm":
            best = min(fits, key=lambda b: ((((b[0] - need) / full) ** 2) * room.weights).sum(), default=None)
        else:
            best = max(fits, key=lambda b: (b[0] / full * (need / full) * room.weights).sum(), default=None)
        if best is None:
            bins.append(best := [full.copy(), []])
        best[0] = best[0] - need
        best[1].append(x)
    return sorted(tuple(b[1]) for b in bins)


@pytest.mark.parametrize("room", [packing.Capacity(64, 5, 1600, (1.0, 1.0, 1.0)), packing.Capacity(100, 100, 10_000), packing.Capacity(64, 4, 2000, (1.0, 0.5, 2.0))])
def test_plan_is_best_fit(room):
    """With capacities that bind, and counted by groups, sequences are those of piece-by-piece best fit."""
    rng = np.random.default_rng(4)
    for n in (1, 7, 60, 300):
        lengths = rng.integers(1, 41, n).tolist()
        counts = {int(x): lengths.count(x) for x in set(lengths)}
        p, bins = packing.plan(counts, room), {}
        for i in range(len(p["length"])):
            for b in range(int(p["times"][i])):
                bins.setdefault(int(p["bin"][i]) + b, []).extend([int(p["length"][i])] * int(p["uses"][i]))
        assert sorted(tuple(sorted(v, reverse=True)) for v in bins.values()) == best_fit_by_hand(lengths, room)


def test_other_vocabularies(spark):
    """Where words can't be tokenized one by one, whole texts are."""
    texts = [t for _, t in corpus() if t] + ["Two  spaces\n\nand THIS."]
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    other = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = packing.WordIds(other), Tokenizer.from_file(other)
    assert words.whole and not packing.WordIds(PATH).whole
    ids, at = words.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_empty_and_repeated_rows(spark):
    assert packing.pack(frame(spark, corpus()).limit(0), PATH).count() == 0
    got = packing.pack(frame(spark, [(1, None), (1, None), (2, ""), (None, "a")]), PATH).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(1, 1), (1, 1), (2, 1)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 3
