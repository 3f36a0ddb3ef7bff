"""Operator 4: licence scan by the Dice coefficient over word bigrams (DataFrame functions only).

Texts and templates are normalised alike: runs of A-Z, a-z and 0-9 are words, lower-cased, so line breaks, comment
marks and punctuation don't count.  A unit is any run of words of a text, wherever it starts and ends: a notice is
found inside prose, in a comment block or over several paragraphs.  With the bags of word bigrams A (unit) and B
(template), Dice is ``2 |A & B| / (|A| + |B|)``.  A threshold ``t`` bounds the sizes,
``|B| t / (2 - t) <= |A| <= |B| (2 - t) / t``, and asks for ``need = |B| t / (2 - t)`` shared bigrams at least.

1. Any match holds one of any ``|B| - need + 1`` bigrams of its template: its anchors, those of the longest words.  A text
   without a word of an anchor goes before bigrams are formed; of the others only the blocks around anchors are kept.
2. The best unit that starts at a place starts and ends with a bigram of the template, so a fold over the hits within
   the size bound finds it.  A hit counts while its bigram has come less often than in the template, which its own
   earlier occurrence decides.  Frames and folds are bounded by the longest template.
3. Of overlapping units of one template the one with the highest Dice stays (then more shared bigrams, then the earlier
   start).  Of overlapping units of different templates the one with more shared bigrams stays, then the higher Dice:
   near wordings (versions, families) compete.  Equal ones of different licences all stay.

Result: one row per doc_id and licence with the best Dice of its units and their number.  Edge cases: null or empty texts
and texts of one word match nothing; equal rows of a doc_id count once, its different texts are scanned apart and counted
together, and so are those with a null doc_id; an empty table gives no rows; other columns are ignored.  Texts of a doc_id
are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Licence notices in their published wording.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so, subject to the following conditions")
_MIT_REST = (
    ": The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT"
    " NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
    " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN"
    " THE SOFTWARE.")
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met")
_BSD_TWO = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
    " the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.")
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
    " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on"
    " an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the"
    " specific language governing permissions and limitations under the License.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies.")
_GNU = (("GPL", "", ("1", "2", "3")), ("LGPL", "Library ", ("2",)), ("LGPL", "Lesser ", ("2.1", "3")),
        ("AGPL", "Affero ", ("3",)))
_GNU_TERMS = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public"
    " License as published by the Free Software Foundation, ")
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
       ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_CC_VERSIONS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))

TEMPLATES: tuple[tuple[str, str], ...] = (
    *((f"Apache-{v}", f"Licensed under the Apache License, Version {v}.") for v in ("1.0", "1.1", "2.0")),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_REST),
    ("BSD", _BSD_OPENING),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_OPENING + _BSD_TWO),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_OPENING + _BSD_TWO + _BSD_THIRD),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"
     " http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring"
     " rights to this software to the public domain worldwide."),
    *((f"CC-{short}-{v}", f"Licensed under CC {short} {v}.") for short, _ in _CC for v, _ in _CC_VERSIONS),
    *((f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {name} {v} {port} License.")
      for short, name in _CC for v, port in _CC_VERSIONS),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
     " v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
     " 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *((f"{name}-{v if '.' in v else v + '.0'}", f"This work is licensed under the GNU {kind}General Public License, version {v}.")
      for name, kind, versions in _GNU for v in versions),
    *((f"{name}-{v if '.' in v else v + '.0'}", _GNU_TERMS.format(work="library" if name == "LGPL" else "program", kind=kind) + rest)
      for name, kind, versions in _GNU for v in versions
      for rest in (f"either version {v} of the License, or (at your option) any later version.", f"version {v} of the License.")),
    ("ISC", _ISC_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT + _MIT_REST),
    ("MIT", _MIT_GRANT),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not"
     " use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
     " was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
     " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for"
     " any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
     " restrictions"),
)

_WORD = "[A-Za-z0-9]+"


def template_bigrams(text: str) -> list[str]:
    """The bigrams of a template, normalised like a text, repeats included."""
    words = [w.lower() for w in re.findall(_WORD, text)]
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def needed(size: int, threshold: float) -> int:
    """Shared bigrams that a unit needs at least to reach the threshold with a template of ``size``."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def reach(size: int, threshold: float) -> int:
    """Bigrams that such a unit has at most."""
    return math.floor(size * (2 - threshold) / threshold + 1e-9)


def _anchors(grams: list[str], threshold: float) -> set[str]:
    """Bigrams of which every match holds one."""
    longest = sorted(grams, key=lambda g: (-max(map(len, g.split(" "))), -len(g), g))
    return set(longest[:len(grams) - needed(len(grams), threshold) + 1])


def _beaten(own: Column, others: str, better) -> Column:
    """Whether a unit of ``others`` overlaps ``own`` and is better."""
    return F.exists(others, lambda x: (x["s"] <= own["e"]) & (x["e"] >= own["s"]) & better(x, own))


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                    threshold: float = 0.8) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, license_id, dice, n_units."""
    known = [(name, grams) for name, text in templates if (grams := template_bigrams(text))]
    block = max(reach(len(g), threshold) for _, g in known)
    most = max(max(Counter(g).values()) for _, g in known)
    anchors = sorted(set().union(*(_anchors(g, threshold) for _, g in known)))
    keys = sorted({max(a.split(" "), key=len) for a in anchors})
    table = docs.sparkSession.createDataFrame(
        [(gram, k, name, len(grams), times, needed(len(grams), threshold), reach(len(grams), threshold))
         for k, (name, grams) in enumerate(known) for gram, times in Counter(grams).items()],
        "gram string, k int, license_id string, size int, times int, need int, reach int")

    words = F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lower)
    gram = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))
    last = F.size("words") - 2
    near = F.filter(F.sequence(F.lit(0), last), lambda i: gram(i).isin(anchors))
    around = F.array_distinct(F.flatten(F.transform(near, lambda i: F.array(*(
        F.floor(i / block) + F.lit(d) for d in (-1, 0, 1))))))
    blocks = (docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), words.alias("words"))
              .where(F.arrays_overlap("words", F.array(*map(F.lit, keys))) & (last >= 0))
              .select("doc_id", "h", "words", F.explode(around).alias("b")).where(F.col("b").between(0, F.floor(last / block)))
              .select("doc_id", "h", "b", F.slice("words", (F.col("b") * block + 1).cast("int"), block + 1).alias("words"))
              .dropDuplicates(["doc_id", "h", "b", "words"]))
    grams = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1),
                       lambda a, b: F.concat_ws(" ", a, b))
    hits = (blocks.where(F.size("words") > 1).select("doc_id", "h", "b", F.posexplode(grams).alias("i", "gram"))
            .join(F.broadcast(table), "gram")  # a row per distinct bigram of a template
            .select("doc_id", "h", "k", "license_id", "size", "times", "need", "reach", "gram",
                    (F.col("b") * block + F.col("i")).alias("s")).repartition("doc_id", "h"))

    earlier = Window.partitionBy("doc_id", "h", "k", "gram").orderBy("s")
    before = F.coalesce(*(F.when(F.col("times") == n, F.lag("s", n).over(earlier)) for n in range(1, most + 1)), F.lit(-1))
    ahead = Window.partitionBy("doc_id", "h", "k").orderBy("s").rangeBetween(0, block - 1)
    start = F.struct(F.lit(0).alias("m"), F.lit(0.0).alias("dice"), F.lit(0).alias("shared"), F.lit(-1).cast("long").alias("e"))

    def step(best: Column, x: Column) -> Column:
        m = best["m"] + F.when(x["q"] < F.col("s"), 1).otherwise(0)
        dice = m * 2.0 / (x["s"] - F.col("s") + 1 + F.col("size"))
        better = dice >= best["dice"]
        return F.struct(m.alias("m"), F.when(better, dice).otherwise(best["dice"]).alias("dice"),
                        F.when(better, m).otherwise(best["shared"]).alias("shared"),
                        F.when(better, x["s"]).otherwise(best["e"]).alias("e"))

    inside = F.filter("ahead", lambda x: x["s"] < F.col("s") + F.col("reach"))
    units = (hits.withColumn("q", before).withColumn("ahead", F.collect_list(F.struct("s", "q")).over(ahead))
             .where(F.size("ahead") >= F.col("need"))
             .select("doc_id", "h", "k", "license_id", "s", F.aggregate(inside, start, step).alias("best"))
             .where(F.col("best.dice") >= threshold - 1e-9)
             .select("doc_id", "h", "k", F.struct("s", "best.e", "best.dice", "best.shared", "license_id", "k").alias("unit")))

    def ranked(x: Column, own: Column, *names: str) -> Column:
        return F.struct(*(x[n] for n in names)) > F.struct(*(own[n] for n in names))

    def same_template(x: Column, own: Column) -> Column:
        return ranked(x, own, "dice", "shared") | (
            (x["dice"] == own["dice"]) & (x["shared"] == own["shared"]) & (x["s"] < own["s"]))

    def other_template(x: Column, own: Column) -> Column:
        return ranked(x, own, "shared", "dice") | (
            (x["dice"] == own["dice"]) & (x["shared"] == own["shared"]) & (x["license_id"] == own["license_id"])
            & (x["k"] < own["k"]))

    for by, better in ((("doc_id", "h", "k"), same_template), (("doc_id", "h"), other_template)):
        both = Window.partitionBy(*by).orderBy("unit.s").rangeBetween(-block, block)
        units = units.withColumn("others", F.collect_list("unit").over(both)).where(
            ~_beaten(F.col("unit"), "others", better)).drop("others")
    return units.groupBy("doc_id", F.col("unit.license_id").alias("license_id")).agg(
        F.max("unit.dice").alias("dice"), F.count("*").alias("n_units"))
