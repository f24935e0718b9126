"""Licence scan: a trained paragraph classifier with template confirmation.

Word n-grams (1 to 3) of a paragraph are hashed into a sparse vector and
scored by a multinomial logistic regression over licence families and an
unknown class, trained on notice templates, on shortened variants of them, and
on paragraphs that only sound alike. The unknown class is calibrated by cross
validation over templates: a family is accepted from the probability that no
unknown template, scored by a model that has seen no variant of it, reaches.
What is accepted is confirmed by the share of some template of the family that
the paragraph contains.

A paragraph is a run of lines between blank ones. It is scored as a whole, or
in overlapping windows of words where it is longer, and line by line, so that
several notices in a row are told apart. What can't be confirmed isn't scored:
without any of a few words and pairs of words of a template (``openers``, made
from the templates) a paragraph holds less of it than confirmation asks for.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.text import stop_words
from namesmith.plans.storage import cut

UNKNOWN = "unknown"
#: Fixed texts: notices by which projects name their licence.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the Apache License 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 3 or later.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
        "Released under the GPL version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License version 2 or later.",
        "Released under the GPL version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under CC BY 4.0.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC 4.0.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "lgpl-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License version 2.1 or later.",
        "Released under the LGPL version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "lgpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License version 3 or later.",
        "Released under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License version 3 or later.",
        "Released under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-1.1": [
        "Licensed under the Apache License, Version 1.1.",
        "Released under the Apache Software License, Version 1.1.",
        "SPDX-License-Identifier: Apache-1.1",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Released under CC BY-SA 4.0.",
    ],
    "cc-by-nd-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Released under CC BY-ND 4.0.",
    ],
    "cc-by-nc-sa-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Released under CC BY-NC-SA 4.0.",
    ],
    "cc-by-nc-nd-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Released under CC BY-NC-ND 4.0.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "Released under the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    UNKNOWN: [
        "Licensed under the Apache License, Version 1.0.",
        "Licensed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt",
        "SPDX-License-Identifier: BSL-1.0",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "SPDX-License-Identifier: Zlib",
        "Released under the zlib License.",
        "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2.",
        "Licensed under the Artistic License 2.0.",
        "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
        "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL.",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Released under CC0 1.0.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
        "This work is licensed under a Creative Commons Attribution 2.5 License.",
        "Licensed under CC BY 3.0.",
        "Licensed under CC BY-SA 3.0.",
        "Licensed under CC BY-NC 3.0.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Mozilla Public License, version 1.1.",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
        "Licensed under the Eclipse Public License, version 1.0.",
        "Licensed under the Microsoft Public License.",
        "Licensed under the Python Software Foundation License, version 2.",
        "Licensed under the GNU General Public License version 1.",
        "Licensed under the GNU Library General Public License, version 2.0.",
        "Licensed under the Academic Free License version 3.0.",
        "Licensed under the Open Software License version 3.0.",
        "Licensed under the PostgreSQL License.",
        "Licensed under the University of Illinois NCSA Open Source License.",
        "Licensed under the Business Source License 1.1.",
        "Licensed under the Elastic License 2.0.",
        "Licensed under the Server Side Public License, version 1.",
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "He drove without a licence and lost his license for a year.",
        "A fishing license is free for children under twelve.",
        "The public may use the library free of charge.",
        "Permission to enter is granted by the office.",
        "The general version of the work was published by the foundation.",
        "The software is sold under a commercial license from the vendor.",
        "Students of MIT met in Boston under the bridge.",
        "The Apache people lived in the south of the country.",
        "The terms of the license were not published.",
        "Version 2.0 was released under pressure.",
        "The BSD meeting and the GNU project were in the news.",
        "Creative work is licensed by the state.",
        "The driver was asked for a license and a copy of the contract.",
        "Permission was granted by the court to publish the list of names.",
        "The terms of the agreement are subject to the law of the country.",
        "You may not use this product without written permission of the owner.",
        "This software is provided by a company in the north of the city.",
        "The above figures and this notice appear in all copies of the report.",
        "In no event shall the club be open after midnight.",
        "The source of the river is free and open to the public.",
        "A general public meeting of the foundation was held, version of events unclear.",
        "Neither the name of the street nor the number of the house was given.",
        "The names of contributors are listed at the end of the book.",
        "It is distributed in the hope that it will be read.",
        "Anyone is free to come, to use the hall and to sell at the market.",
        "Redistribution of land and use of water were the conditions of peace.",
        "Version 3 of the plan was written by the public library.",
        "The documentation of the building and the files were copied for a fee.",
        "The attribution of the painting to an international master is common.",
        "Public domain and private property are not the same.",
        "The licence fee is paid for every year of use.",
        "No part of this book may be reproduced in any form without permission.",
    ],
}
#: Words (or runs of up to three) of which a paragraph must hold one of each group to be of a family, and runs that tell other licences of its kin.
_LESSER, _AFFERO = ("lesser", "lgpl"), ("affero", "agpl")
_NC, _SA, _ND = ("by nc", "noncommercial", "non commercial"), ("by sa", "nc sa", "sharealike", "share alike"), ("by nd", "nc nd", "noderivatives", "noderivs", "no derivatives")
_OLD_CC = ("1.0", "2.0", "2.5", "3.0")
NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "apache-1.1": (("1.1",),), "mpl-2.0": (("mozilla", "mpl"),), "epl-2.0": (("eclipse", "epl"), ("2.0",)),
    "lgpl-2.1": (_LESSER, ("2.1",)), "lgpl-3.0": (_LESSER, ("version 3", "3.0", "v3")), "agpl-3.0": (_AFFERO,),
    "cc-by-4.0": (("4.0",),), "cc-by-nc-4.0": (("4.0",), _NC), "cc-by-sa-4.0": (("4.0",), _SA), "cc-by-nd-4.0": (("4.0",), _ND), "cc-by-nc-sa-4.0": (("4.0",), _NC, _SA), "cc-by-nc-nd-4.0": (("4.0",), _NC, _ND),
    "mit": (("mit", "permission is hereby", "copyright notice and", "the software is"),), "isc": (("isc", "with or without"),),
}
BARS: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("version 1.1", "version 1.0", "license 1.1", "apache 1.1", "apache 1.0"), "mpl-2.0": ("version 1.1", "version 1.0", "mpl 1.1"), "epl-2.0": ("version 1.0", "epl 1.0"),
    "gpl-2.0": (*_LESSER, *_AFFERO, "library general", "version 1", "version 3", "gpl 3.0"), "gpl-3.0": (*_LESSER, *_AFFERO, "library general", "version 1", "version 2", "gpl 2.0", "version 2.0"),
    "lgpl-2.1": (*_AFFERO,), "lgpl-3.0": (*_AFFERO, "version 2.1", "lgpl 2.1"), "agpl-3.0": (*_LESSER, "version 1", "agpl 1.0"),
    "cc-by-4.0": (*_NC, *_SA, *_ND, *_OLD_CC), "cc-by-nc-4.0": (*_SA, *_ND, *_OLD_CC), "cc-by-sa-4.0": (*_NC, *_ND, *_OLD_CC), "cc-by-nd-4.0": (*_NC, *_SA, *_OLD_CC), "cc-by-nc-sa-4.0": (*_ND, *_OLD_CC), "cc-by-nc-nd-4.0": (*_SA, *_OLD_CC),
}
#: Runs by which a text says that a licence does not hold.
DENIALS = (
    "not licensed under", "not released under", "not available under", "not distributed under", "not covered by", "not under the", "not published under", "no longer licensed", "no longer released",
    "no longer under", "no longer available", "never licensed under", "never released under", "not be licensed", "not be released",
)
#: Words in a window, and from one window to the next; the longest template fits into what two windows share.
WINDOW, STEP = 176, 44
FOLDS = 2


@dataclass(frozen=True)
class Scan:
    features: int = 1 << 13
    regularization: float = 0.002
    sparsity: float = 0.3
    confirm: float = 0.6


def trimmed(text: Column) -> Column:
    """Lower-case words: letters and digits, with single points inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++(?:\.[\p{L}\p{N}]++)*+"), F.lit(0))


def runs_of(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def grams(words: Column) -> Column:
    """Word n-grams, n from 1 to 3."""
    return F.concat(*(runs_of(words, n) for n in (1, 2, 3)))


def template_grams(text: str) -> list[str]:
    """grams(trimmed(...)) of a template, each once."""
    words = re.findall(r"[^\W_]+(?:\.[^\W_]+)*", text.lower())
    return sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def openers(scan: Scan, n: int) -> list[str]:
    """Runs of n words of which a paragraph must have one to hold ``confirm`` of any template.

    Of each template, runs are taken, those with fewest stop words and of fewest
    templates first, until the n-grams without any of them are fewer than
    confirmation needs.
    """
    known = [(k, template_grams(t)) for k in sorted(TEMPLATES) for t in TEMPLATES[k]]
    common = Counter(g for _, grams in known for g in grams)
    plain = set(stop_words())
    out: set[str] = set()
    for family, grams in known:
        if family == UNKNOWN:
            continue
        rest = grams
        order = lambda g: (sum(w in plain for w in g.split(" ")), g not in out, common[g], g)
        for x in sorted((g for g in grams if g.count(" ") == n - 1), key=order):
            if len(rest) < scan.confirm * len(grams):
                break
            left = [g for g in rest if f" {x} " not in f" {g} "]
            if len(left) < len(rest):
                out.add(x)
                rest = left
    return sorted(out)


def examples(spark: SparkSession) -> DataFrame:
    """label, family, fold, grams: templates, and each without one word or half. A template and its variants share a fold."""
    names = sorted(TEMPLATES)
    rows = [(float(names.index(k)), k, i % FOLDS, t) for k in names for i, t in enumerate(TEMPLATES[k])]
    base = spark.createDataFrame(rows, "label double, family string, fold int, text string").withColumn("words", trimmed(F.col("text")))
    n = F.size("words")
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice("words", F.lit(1), i - 1), F.slice("words", i + 1, n)))
    long = F.when(n >= 12, F.array(F.slice("words", F.lit(1), F.ceil(n / 2).cast("int")), F.slice("words", F.floor(n / 2).cast("int") + 1, n))).otherwise(F.array().cast("array<array<string>>"))
    every = base.select("label", "family", "fold", F.explode(F.concat(F.array("words"), F.array("words"), less, long)).alias("words")).where(F.size("words") > 0)
    return every.withColumn("grams", grams(F.col("words")))


def holds(family: str, grams: set[str]) -> bool:
    """Whether n-grams have what tells the family from its kin, and no denial."""
    return all(grams & set(some) for some in NEEDS.get(family, ())) and not grams & {*BARS.get(family, ()), *DENIALS}


def share_of(family: str, grams: set[str]) -> float:
    """The share of the best template of the family that n-grams have."""
    return max(len(grams & set(w)) / len(w) for w in map(template_grams, TEMPLATES[family]))


def evidence(spark: SparkSession) -> DataFrame:
    """family, wanted, needs, bars: what confirms a family. A table of twenty rows: as literals, its n-grams would fill the driver's memory with copies of the plan."""
    rows = [(k, [template_grams(t) for t in TEMPLATES[k]], [list(some) for some in NEEDS.get(k, ())], [*BARS.get(k, ()), *DENIALS]) for k in sorted(TEMPLATES) if k != UNKNOWN]
    return spark.createDataFrame(rows, "family string, wanted array<array<string>>, needs array<array<string>>, bars array<string>")


@dataclass(frozen=True)
class Trained:
    """The model, its classes in order, the temperature its margins are divided by, and the least probability of a known family at which it is accepted."""

    model: PipelineModel
    names: list[str]
    temperature: float
    accept: float


def softmax(margins: np.ndarray, temperature: float) -> np.ndarray:
    z = (margins - margins.max(axis=1, keepdims=True)) / temperature
    return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)


def train(spark: SparkSession, scan: Scan = Scan()) -> Trained:
    """Fits the classes, and calibrates on templates that a model has seen no variant of.

    The temperature makes these templates' probabilities most likely. A notice is
    accepted from the probability of not being unknown that no unknown template
    reaches, among those that would be confirmed; from a half at least. It goes to
    the likeliest family, which its own words must confirm.
    """
    every = examples(spark).coalesce(1).cache()
    names = sorted(TEMPLATES)

    def fitted(rows: DataFrame) -> PipelineModel:
        stages = [HashingTF(inputCol="grams", outputCol="features", numFeatures=scan.features, binary=True), LogisticRegression(family="multinomial", regParam=scan.regularization, elasticNetParam=scan.sparsity, maxIter=25)]
        return Pipeline(stages=stages).fit(rows)

    unseen = []
    for fold in range(FOLDS):
        unseen += fitted(every.where(F.col("fold") != fold)).transform(every.where(F.col("fold") == fold)).select("label", "grams", vector_to_array("rawPrediction").alias("margins")).collect()
    labels, margins = np.array([int(r["label"]) for r in unseen]), np.array([r["margins"] for r in unseen])
    likely = lambda t: np.log(np.maximum(softmax(margins, t)[np.arange(len(labels)), labels], 1e-12)).sum()
    temperature = float(max(np.geomspace(0.25, 8, 41), key=likely))
    odds, unknown = softmax(margins, temperature), names.index(UNKNOWN)
    highest = 0.5
    for r, p in zip(unseen, odds, strict=True):
        best, grams = names[int(np.where(np.arange(len(p)) == unknown, -1, p).argmax())], set(r["grams"])
        if int(r["label"]) == unknown and holds(best, grams) and share_of(best, grams) >= scan.confirm:
            highest = max(highest, float(1 - p[unknown]))
    model = fitted(every)
    every.unpersist()
    return Trained(model, names, temperature, highest)


def paragraphs(text: Column) -> Column:
    """Runs of lines between blank ones; blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[\x20\x09-\x0D]*\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def pieces(docs: DataFrame, scan: Scan) -> DataFrame:
    """doc_id, mark, block, words: of paragraphs with an opener, windows and lines that have one too."""
    one, two = (F.array(*map(F.lit, openers(scan, n))) for n in (1, 2))
    pairs = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    opened = lambda w: F.arrays_overlap(w, one) & F.arrays_overlap(pairs(w), two)
    blocks = docs.select("doc_id", "mark", F.posexplode(paragraphs(F.col("text"))).alias("block", "x"))
    words = blocks.withColumn("w", trimmed(F.col("x"))).where(F.arrays_overlap("w", one)).where(F.arrays_overlap(pairs(F.col("w")), two))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - STEP) + 1), F.lit(STEP))
    windows = F.transform(starts, lambda i: F.slice("w", i, F.lit(WINDOW)))
    lines = F.transform(F.split("x", "\n"), trimmed)
    each = F.array_distinct(F.filter(F.concat(windows, lines), opened))
    return words.select("doc_id", "mark", "block", F.explode(each).alias("words"))


def classify(found: DataFrame, scan: Scan = Scan(), trained: Trained | None = None) -> DataFrame:
    """Adds family, probability (of any known family) and matched (share of the best template found) to rows with words; unknown where not accepted or confirmed."""
    by = trained or train(found.sparkSession, scan)
    # Written out, or each use below would split the paragraph and run the model again.
    made = cut(found.withColumn("grams", grams(F.col("words"))), "grams")
    scored = cut(by.model.transform(made).select(*found.columns, "grams", vector_to_array("rawPrediction").alias("margins")), "scored")
    top = F.array_max("margins")
    total = F.aggregate("margins", F.lit(0.0), lambda s, x: s + F.exp((x - top) / by.temperature))
    unknown = by.names.index(UNKNOWN)
    best = F.array_max(F.filter(F.transform("margins", lambda m, i: F.struct(m.alias("m"), (-i).alias("i"))), lambda x: x["i"] != -unknown))
    own = scored.withColumn("family", F.get(F.array(*(F.lit(x) for x in by.names)), -best["i"])).withColumn("probability", 1 - F.exp((F.get("margins", F.lit(unknown)) - top) / by.temperature) / total)
    share = F.array_max(F.transform("wanted", lambda w: F.size(F.array_intersect("grams", w)) / F.size(w)))
    told = F.forall("needs", lambda some: F.arrays_overlap("grams", some)) & ~F.arrays_overlap("grams", "bars")
    out = own.join(F.broadcast(evidence(found.sparkSession)), "family", "left").withColumn("matched", F.when(told, share).otherwise(0.0))
    good = (F.col("probability") >= by.accept) & (F.col("matched") >= scan.confirm)
    return out.select(*found.columns, F.when(good, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "matched")


def licences(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """doc_id, n_paragraphs, n_licences (families confirmed in a paragraph, over all), families (sorted, comma-joined).

    Paragraphs are runs of lines with a word, between blank lines. Null and
    empty texts have none. Rows with equal doc_id and text have equal findings;
    texts that share a doc_id but differ have each their own. Rows without
    doc_id are left out.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull()).withColumn("mark", F.xxhash64("text"))
    found = classify(pieces(own.where("text is not null"), scan), scan).where(F.col("family") != UNKNOWN)
    by_doc = found.groupBy("doc_id", "mark").agg(F.countDistinct("block", "family").alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
    met = own.select("doc_id", "mark", F.size(paragraphs(F.col("text"))).cast("long").alias("n_paragraphs")).join(by_doc, ["doc_id", "mark"], "left")
    return met.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"))
