import re
from collections import Counter

from namesmith.llm import quality

from .helpers import WORD, corpus, frame


def test_base_figures(spark):
    rows = [*corpus(), (9001, "a b c d e\n\na b c d e\n \nx\nx"), (9002, "#$% & | < > * \n#$%")]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        n = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        cover = [False] * len(w)
        for p in range(len(w) - 4):
            if n[tuple(w[p : p + 5])] > 1:
                cover[p : p + 5] = [True] * 5
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(cover))
        assert r.base_failed == (len(w) < 10 or 100 * sum(cover) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_strange_histograms_are_rejected(spark):
    prose = "the cat sat on the mat and it was in the house with a dog of the man who is to go "
    rows = [(i, f"Then {prose}{i} " + " ".join(f"{w}{i}" for w in ("tree", "lamp", "stone") * 12) + " " + prose) for i in range(40)]
    rows.append((999, " ".join(f"q{i}%%%$$$###" for i in range(80))))
    rows.append((998, "%%% ### $$$ &&& *** one two three four five"))
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert not got[999].kept and not got[999].base_failed and got[999].class_distance > 0.25
    assert got[998].kept, "too short to judge"
    assert all(got[i].kept for i in range(40) if not got[i].base_failed)


def test_empty_and_null_languages(spark):
    none = frame(spark, corpus()).limit(0)
    assert quality.judge(none).count() == 0
    alone = spark.createDataFrame([(1, None, None), (2, "a b " * 40, None)], "doc_id long, lang string, text string")
    assert {r.doc_id: r.kept for r in quality.judge(alone).collect()} == {1: False, 2: False}
