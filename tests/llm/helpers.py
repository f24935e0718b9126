"""A small corpus with the awkward cases, and plain versions of the text rules."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: doc_id and text, and columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, n_words long, lo int, hi int, key string, seed long, spans string, words string, toxic int, n int"


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    rng = random.Random(7)
    vocabulary = [w for w in "the of and to in is on for with river stone green über été niño ß żółw 火 mountain lake paper window seven lamp cloud".split()] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(9)
    base = prose(150).split()
    rows = [None, "", " \n\t ", "one", "two words", "!!! ???", "a", "Über", "x" * 5000]
    rows += [prose(n) for n in (4, 5, 6, 12, 13, 14, 40, 200, 900)]
    rows += [prose(50) + " " + passage + " " + prose(30), passage, prose(20) + "\n" + passage, line + "\n" + prose(40), line + "\n" + prose(80), line]
    rows += [" ".join(base)] * 4
    for _ in range(14):
        edited = list(base)
        for _ in range(rng.randint(1, 4)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        rows.append(" ".join(edited))
    rows += [" ".join(base).upper(), "Osas " * 300, "Osas " * 120 + prose(30), "ab" * 400, "ab" * 300 + prose(10), prose(30) + " , , , " + prose(30)]
    rows += [prose(3000) + passage + prose(2000)]
    return [(i * 3 % 101 + 1000 * (i // 101), t) for i, t in enumerate(rows)]


def frame(spark, rows):
    """Rows of (doc_id, text) with all the other columns filled with noise."""
    full = [(i, t, None if k % 5 == 0 else "en", None, len(t or ""), k % 2 == 0, 0.5, k, k, k, "k", k, "s", "w", None, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
