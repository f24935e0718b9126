"""Language, toxicity, licences: accuracy on what was held out."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from namesmith.llm import langid, licenses, sql, toxicity

from .helpers import corpus, frame

WORDS = {"aa": "the of and that with this from have river".split(), "bb": "der die und das nicht mit von straße über".split(), "cc": "les des une dans pour été être avec".split()}


def documents(spark, n=300):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spark):
    docs = documents(spark)
    rows = langid.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    learned = langid.profiles(documents(spark))
    got = {r.doc_id: r for r in langid.identify(frame(spark, [(1, None), (2, ""), (3, "12 !? 7"), (4, "der"), (5, "火")]), learned).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert got[4].lang_pred == "bb" and got[5].lang_pred in WORDS
    assert {r.lang_pred for r in langid.identify(frame(spark, corpus()), {}).collect()} == {"und"}
    assert langid.identify_held_out(frame(spark, corpus()).limit(0)).count() == 0


def test_languages_equal_the_sql(spark, tmp_path):
    """Mixed texts of few words, so that counts and distances tie; odd documents among them."""
    rng = random.Random(6)
    every = [w for x in WORDS.values() for w in x]
    rows = [(i, " ".join(rng.choice(every) for _ in range(rng.randint(0, 12))), rng.choice([None, *WORDS])) for i in range(200)]
    rows += [(i + 200, t, None) for i, (_, t) in enumerate(corpus())]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    got = [tuple(r) for r in langid.identify_held_out(spark.read.parquet(path)).collect()]
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/*.parquet'")
    want = c.sql(sql.LANGUAGE).fetchall()
    assert sorted(got) == sorted(want)
    assert len({r[2] for r in want}) > 2 and any(r[3] == 0 and r[2] != "und" for r in want)


def test_gram_counts_by_hand():
    texts = ["Ab, b\u00c9!", "", "c"]
    raw = [t.encode() for t in texts]
    codes, own = langid.grams(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert np.bincount(own, minlength=3).tolist() == [4 + 6 + 4, 0, 1 + 2 + 1]


def test_leading_grams_are_those_of_a_plain_count(monkeypatch):
    """Odd letters, an alphabet too large for small keys, empty texts, and many documents at once."""
    monkeypatch.setattr(langid, "MANY", 5)
    many = "".join(map(chr, range(0x4E00, 0x6E00)))
    texts = ["Ab, b\u00c9!", "", "c", "\u706b \u6c34\u706b", "\u0130STANBUL \u03a3\u0391\u03a3", "12 !?", "a\x00b", "\U00010400z", many, many[5:] + many[:9], "the cat and the hat " * 9] * 2
    code = {1: lambda g: ord(g), 2: lambda g: ord(g[0]) << 21 | ord(g[1]) | 1 << 62, 3: lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])}
    got = {}
    for first, buf, offs in langid.runs(pa.array(texts)):
        for d, r, c in zip(*(x.tolist() for x in langid.leading(buf, offs, 40)), strict=True):
            assert len(got.setdefault(first + d, [])) == r
            got[first + d].append(c)
    for i, t in enumerate(texts):
        plain = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        found = Counter(code[k](plain[j : j + k]) for k in (1, 2, 3) for j in range(len(plain) - k + 1) if " " not in (plain[j + 1 : j + k - 1] if k == 3 else "") and plain[j : j + k].strip())
        assert got.get(i, []) == sorted(found, key=lambda g: (-found[g], g))[:40]


def test_profiles_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    whole = langid.profiles(documents(spark))
    monkeypatch.setattr(langid, "HELD", 50)
    parts = langid.profiles(documents(spark).repartition(3))
    assert whole.keys() == parts.keys() and all((whole[x] == parts[x]).all() for x in whole)


def toxic_corpus(spark, n=900):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(300)]
    stems = ["grumbo", "zorkli", "vexqua"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "Scum", rng.choice(stems) + rng.choice("abcdefg") + rng.choice("xyz")])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    rows = toxicity.score_held_out(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    bad = [r for r in held if r.toxic]
    assert np.mean([r.predicted for r in bad]) > 0.9
    assert np.mean([r.predicted for r in held if not r.toxic]) < 0.03
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in rows)


def caught(spark, change=None, monkeypatch=None):
    """Held-out (share of toxic ones caught, share of others flagged) on sf0.1, with the label model's posterior changed."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    if change:
        real = toxicity.label_model
        monkeypatch.setattr(toxicity, "label_model", lambda *a: (change(real(*a)[0]), (0.9, 0.9)))
    held = toxicity.score_held_out(docs, labels).join(labels, "doc_id").where("held_out").collect()
    share = lambda of: float(np.mean([r.predicted for r in held if r.toxic == of]))
    return share(1), share(0)


def test_the_result_comes_through_the_label_model(spark, monkeypatch):
    """A constant posterior catches nothing, an inverted one the wrong ones."""
    good, bad = caught(spark)
    assert good > 0.87 and bad < 0.005
    with monkeypatch.context() as m:
        assert caught(spark, lambda p: np.full(len(p), 0.5), m)[0] < 0.1
    with monkeypatch.context() as m:
        good, bad = caught(spark, lambda p: 1 - p, m)
        assert good < 0.3 and bad > 0.7


def test_votes_overrule_labels_and_labels_are_estimated():
    """Of documents that all voters call toxic, those with a wrong label come out toxic; the estimated accuracies show how many labels are wrong."""
    rng = np.random.default_rng(5)
    n, k = 4000, 12
    toxic = rng.random(n) < 0.2
    votes = (rng.random((n, k)) < np.where(toxic[:, None], 0.55, 0.03)).astype(float)
    labels = np.where(rng.random(n) < 0.5, toxic.astype(float), np.nan)
    wrong = rng.choice(np.flatnonzero(~np.isnan(labels)), 200, replace=False)
    labels[wrong] = 1 - labels[wrong]
    post, trust = toxicity.label_model(votes, np.ones(k), labels, toxicity.Training())
    assert np.mean((post > 0.5) == toxic) > 0.97
    assert np.mean((post[wrong] > 0.5) == toxic[wrong]) > 0.7
    known = ~np.isnan(labels)
    real = [np.mean(labels[known & toxic] == 1), np.mean(labels[known & ~toxic] == 0)]
    assert np.allclose(trust, real, atol=0.08)


def test_scores_by_hand(spark):
    """Words, beginnings and signs counted plainly, and the model's weights."""
    docs, labels = toxic_corpus(spark, 400)
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model.voters.tolist(), model.weights, strict=False))
    rows = corpus() + [(900 + r.doc_id, r.text) for r in docs.limit(40).collect()] + [(5000, "IDIOT!! Idiot?! you MORON, scum " * 3)]

    def by_hand(text):
        data = (text or "").encode()
        low = toxicity.folded(np.frombuffer(data, np.uint8)).tobytes()
        words, times, hits = re.findall(rb"[a-z\x80-\xff]+", low), Counter(), 0
        for w in words:
            marks = [w, *(w[:n] for n in toxicity.STEMS if len(w) > n)]
            found = [h for h in (int(toxicity.kernels.word_hashes(np.frombuffer(m, np.uint8), np.array([0]), np.array([len(m)]), 0)[0]) for m in marks) if h in weights]
            times.update(found)
            hits += bool(found)
        size = max(1, len(data))
        dense = [np.log1p(hits), hits >= 2, sum(65 <= b <= 90 for b in data) / size, sum(a in b"!?" and b in b"!?" for a, b in zip(data, data[1:], strict=False)) / size]
        z = sum(weights[h] * np.log1p(n) for h, n in times.items()) + np.dot(dense, model.weights[len(model.voters) : -1]) + model.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), model).collect()}
    for i, text in rows:
        assert abs(got[i] - by_hand(text)) < 1e-9
    assert got[5000] > 0.7


def test_toxicity_of_odd_texts(spark):
    docs, labels = toxic_corpus(spark, 300)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(frame(spark, corpus()), model).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    blank = [r.score for r in got if not r.text]
    assert len(set(blank)) == 1
    nothing = toxicity.score_held_out(frame(spark, corpus()), labels.limit(0)).collect()
    assert len(nothing) == len(corpus()) and not any(r.predicted for r in nothing)
    assert toxicity.score_held_out(docs.limit(0), labels).count() == 0


def test_licences(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "released under the MIT License": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "You lost your license in Boston.": "",
        "der Mann mit dem Hut": "",
    }
    rows = [(i, f"Some words first.\n{x}\n\nAnd after.") for i, x in enumerate(lines)]
    rows += [(90, None), (91, ""), (92, "\n".join(lines))]
    got = {r.doc_id: r for r in licenses.licences(frame(spark, rows)).collect()}
    for i, x in enumerate(lines):
        assert (got[i].families, got[i].n_licences, got[i].n_paragraphs) == (lines[x], int(bool(lines[x])), 2)
    assert (got[90].n_paragraphs, got[91].n_licences) == (0, 0)
    assert (got[92].n_licences, got[92].families) == (4, "apache-2.0,cc-by-nc-4.0,gpl-3.0,mit")
    assert licenses.licences(frame(spark, rows).limit(0)).count() == 0


def test_wrapped_licences(spark):
    mit = "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights"
    gpl = "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General\n# Public License as published by the Free Software\n# Foundation, version 3.\nimport os"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    prose = "the man in the house saw a river and a bird over there " * 12
    disclaimer = licenses.TEMPLATES["mit"][-1].replace(", ", ",\n")
    rows = [(7, disclaimer), (1, mit), (2, gpl), (3, bsd), (4, prose + bsd.replace("\n *", "") + " " + prose), (5, "Released under the MIT License.\n" + gpl), (6, "You lost your\nlicense in Boston\nunder the bridge.")]
    got = {r.doc_id: (r.n_licences, r.families) for r in licenses.licences(frame(spark, rows)).collect()}
    assert got == {7: (1, "mit"), 1: (1, "mit"), 2: (1, "gpl-3.0"), 3: (1, "bsd"), 4: (1, "bsd"), 5: (2, "gpl-3.0,mit"), 6: (0, "")}


def test_licences_by_hand(spark):
    """Every window and line scored from the model's coefficients, without openers, finds the same families."""
    import re

    rng = random.Random(3)
    prose = "the version of this work is a free copy of the public source and that one was used for any purpose in the city by its own people".split()
    known = [t for k in licenses.TEMPLATES for t in licenses.TEMPLATES[k][:: 8 if k == licenses.UNKNOWN else 1]]
    rows = []
    for i in range(24):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(known).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(prose)
            parts.append(" ".join(words[rng.randrange(3) :]))
            parts.append(" ".join(rng.choices(prose, k=rng.choice([5, 40, 40, 250]))))
        rows.append((i, rng.choice([" ", "\n", "\n\n", "\n \n"]).join(parts)))
    scan = licenses.Scan()
    by = licenses.train(spark, scan)
    names = by.names
    tf, lr = by.model.stages
    weights, intercept = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()

    def grams_of(words):
        return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}

    def family(words):
        grams = grams_of(words)
        z = intercept + weights[:, sorted({place[g] for g in grams})].sum(axis=1)
        p = np.exp((z - z.max()) / by.temperature)
        unknown = names.index(licenses.UNKNOWN)
        best = names[int(np.argmax(np.where(np.arange(len(z)) == unknown, -np.inf, z)))]
        wanted = [licenses.template_grams(t) for t in licenses.TEMPLATES[best]]
        told = all(any(x in grams for x in some) for some in licenses.NEEDS.get(best, ())) and not any(x in grams for x in (*licenses.BARS.get(best, ()), *licenses.DENIALS))
        sure = told and 1 - p[unknown] / p.sum() >= by.accept and max(len(grams & set(w)) / len(w) for w in wanted) >= scan.confirm
        return best if sure else None

    def split(text):
        return re.findall(r"[^\W_]+(?:\.[^\W_]+)*", text.lower())

    every = sorted({g for _, text in rows for x in [text, *text.split("\n")] for g in grams_of(split(x))})
    hashed = tf.transform(spark.createDataFrame([(g, [g]) for g in every], "g string, grams array<string>")).collect()
    place = {r.g: int(r.features.indices[0]) for r in hashed}
    want = {}
    for i, text in rows:
        found = set()
        for block, x in enumerate(p for p in re.split(r"\n[ \t-\r]*\n", text) if p.strip()):
            w = split(x)
            windows = [w[a : a + licenses.WINDOW] for a in range(0, max(1, len(w) - (licenses.WINDOW - licenses.STEP) + 1), licenses.STEP)]
            found |= {(block, family(words)) for words in [*windows, *map(split, x.split("\n"))] if words}
        found = {x for x in found if x[1]}
        want[i] = (len(found), ",".join(sorted({f for _, f in found})))
    got = {r.doc_id: (r.n_licences, r.families) for r in licenses.licences(frame(spark, rows)).collect()}
    assert sum(bool(f) for _, f in want.values()) > 10
    assert got == want


def test_templates_are_no_part_of_the_plan(spark):
    """Their n-grams come as a table: as literals they would fill the driver with copies of the plan."""
    found = spark.createDataFrame([(["released", "under", "the", "mit", "license"],), (["some", "words"],)], "words array<string>")
    made = licenses.classify(found, trained=licenses.train(spark))
    plan = made._jdf.queryExecution().toString()
    assert "permission is hereby" not in plan and len(plan) < 50_000
    assert sorted((r.family, r.matched) for r in made.select("family", "matched").collect()) == [("mit", 1.0), ("unknown", 0.0)]


def test_licences_of_repeated_ids(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "Licensed under CC BY 4.0."), (None, "x")]
    assert sorted(r.families for r in licenses.licences(frame(spark, rows)).collect()) == ["cc-by-4.0", "mit", "mit"]


#: Notices that are no template as they stand, and what they may be called.
KIN = {
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.": ("lgpl-2.1",),
    "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ("agpl-3.0",),
    "// SPDX-License-Identifier: LGPL-3.0-only": ("lgpl-3.0",),
    "# SPDX-License-Identifier: AGPL-3.0-only": ("agpl-3.0",),
    "The text is licensed under CC BY-SA 4.0.": ("cc-by-sa-4.0",),
    "This book is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ("cc-by-sa-4.0",),
    "This book is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": ("cc-by-nc-nd-4.0",),
    "This software is licensed under the Apache License, Version 1.1.": ("apache-1.1",),
    "This program is not licensed under the MIT License.": (),
    "This program is no longer licensed under the MIT License.": (),
    "The code is not released under the GNU General Public License version 3.": (),
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": (),
    "Licensed under the Mozilla Public License, version 1.0.": (),
    "Licensed under the Eclipse Public License, version 1.0.": (),
    "This file is licensed under the GNU General Public License version 1.": (),
    "SPDX-License-Identifier: CDDL-1.0": (),
    "Licensed under the Open Software License version 2.1.": (),
    "Licensed under the GNU Library General Public License version 2.": (),
    "Copyright 2020 The Authors, licensed under the Boost Software License, Version 1.0.": (),
    "This code is licensed under the GNU General Public License version 3 or later.": ("gpl-3.0",),
    "This code is licensed under the Apache License, Version 2.0.": ("apache-2.0",),
    "The project is released under the MIT License.": ("mit",),
    "The pictures are licensed under CC BY 4.0.": ("cc-by-4.0",),
    "The pictures are licensed under CC BY-NC 4.0.": ("cc-by-nc-4.0",),
}


def test_kin_of_known_licences(spark):
    """Each notice gets its own family or none, never that of its kin; most that have a family get it."""
    rows = [(i, x) for i, x in enumerate(KIN)]
    got = {r.doc_id: r.families for r in licenses.licences(frame(spark, rows)).collect()}
    wrong = {x: got[i] for i, x in rows if got[i] not in ("", *KIN[x])}
    assert not wrong
    missed = [x for i, x in rows if KIN[x] and not got[i]]
    assert len(missed) <= 2, missed


def test_families_hold_their_own_templates():
    for family, templates in licenses.TEMPLATES.items():
        for t in templates if family != licenses.UNKNOWN else ():
            assert licenses.holds(family, set(licenses.template_grams(t))), (family, t)
