import hashlib

import pytest

from namesmith.llm import decontaminate

from .helpers import ALNUM, corpus, frame, lower_ascii


def by_hand(rows, items, n):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower_ascii(t))
        for p in range(max(1, len(w) - n + 1)) if w else []:
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower_ascii(t))
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit[p : p + size] = [True] * size
                    found |= windows[tuple(w[p : p + size])]
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_contamination(spark, limit):
    rows = corpus()
    shared = rows[0][0]
    rows += [(shared, "x River, stone! y"), (shared, "clean text"), (shared, "clean text"), (shared, rows[12][1])]
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[12].split()[:25])), (2, "River, stone!"), (10, None), (11, " ,"), (12, texts[-1][300:700]), (13, texts[12].upper()), (13, "lamp"), (14, "osas osas osas osas osas osas osas osas osas osas osas")]
    frame_of_items = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, words string")
    got = sorted(tuple(r)[:6] for r in decontaminate.contamination(frame(spark, rows), frame_of_items, limit=limit).collect())
    assert all(r[2] <= r[1] for r in got)
    assert got == by_hand(rows, items, 10)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, corpus()), none).collect()
    assert len(got) == len(corpus()) and not any(r.contaminated for r in got)
    assert decontaminate.contamination(frame(spark, corpus()).limit(0), none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, [(1, "x a b c"), (1, "x a b c"), (None, "a b c")]), one).collect()
    assert [(r.doc_id, r.n_hit) for r in got] == [(1, 3), (1, 3)]
