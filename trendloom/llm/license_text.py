"""Licence scans: paragraphs classified by sparse word n-grams, confirmed by their template.

A multinomial logistic regression over hashed word n-grams gives each paragraph a licence family or none. It is trained
from the templates (cut, wrapped and garnished with other words, by a fixed seed) and from other text, some of it about
licences of other kinds. Its probabilities are calibrated on paragraphs drawn apart: by one temperature, the one with the
least logarithmic loss. Licences of other families are a class of their own, ``unknown``, and so is a licence whose family has
less than a calibrated probability: the one that ``Licences.wrong`` of the held-out other texts and other families exceed. A prediction is confirmed if enough
of the paragraph's word pairs are in the family's template, or of the template in the paragraph.

A paragraph is a run of lines, wrapped or not, each with a word pair of some notice, where a pair of two function words
doesn't tell and a pair may span a line end. A line without one, between two that have one, belongs to them; a blank line ends a
paragraph. What is left out has no pair that tells, so it couldn't be confirmed and isn't rated. Comment signs don't count as words.

All of it is columns and Spark ML transformers: one pass over the texts, no shuffle, no Python.

Defined results: null and empty texts have no paragraphs; rows without an id and repeated rows are scanned one by one;
texts are scanned whole at any length; of equally likely families the first by name order of the templates is told; an
empty table has no paragraphs; only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import functools
import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and opening sentences of licence families.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 2.1 or later."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Except where otherwise noted, content is licensed under a Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "Public domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.", "Released into the public domain under CC0 1.0 Universal."],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}
# Notices of licences of other families, which belong to none of those above.
UNKNOWN_TEXTS = [
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "By installing the product the customer accepts this end user agreement and may install one copy on a single computer.",
    "Licensed under the Open Database License. Any rights in individual contents are licensed under the Database Contents License.",
    "The fonts are licensed under the SIL Open Font License, version 1.1.",
    "The use of the data set is limited to members of the university, who sign a data use agreement.",
    "Licensed under the Artistic License 2.0.",
]
# Words that join others in any text.
FUNCTION_WORDS = "a an and any are as at be by for from he in is it its not of on or she that the their they this to was were will with you your".split()
# Other text, some of it with words of licences.
OTHER = [
    "He lost his driver's license and had to renew the license at the office.",
    "The restaurant has a license to sell wine, version 2 of the menu is under work.",
    "The general public was free to use the library under the new rules of the foundation.",
    "The release of the software under version 3 was late, and copies were sold without notice.",
    "She was granted permission to copy the work and to publish it in the public interest.",
    "All rights were reserved for members, and terms and conditions of the sale are on the back.",
    "A poetic license is the freedom to depart from the facts.",
    "The apache helicopter flew over, and students of mit and berkeley watched.",
    "Students at MIT released the results of their work under pressure.",
    "license", "version 2.0", "the work", "under the", "License:", "free software",
]
NONE = "none"
UNKNOWN = "unknown"
FIRST = 2  #: number of the first family
NAMES = [NONE, UNKNOWN, *TEMPLATES]


@dataclass(frozen=True)
class Licences:
    features: int = 1 << 13
    copies: int = 40  #: training paragraphs made of each template
    seed: int = 7
    confirm: float = 0.6  #: share of word pairs
    wrong: float = 0.05  #: of other texts that may be taken for a known family


TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
TEMPERATURES = (0.3, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}', 0)"


def grams(words: str) -> str:
    """SQL of the words and pairs of neighbours."""
    return f"concat({words}, {pairs(words)})"


def pairs(words: str) -> str:
    return f"if(size({words}) > 1, zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (x, y) -> concat(x, ' ', y)), cast(array() AS array<string>))"


def trie(words: list[str]) -> str:
    """A pattern for any of the words that looks at each letter once."""
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        tails = [char.replace(".", "[.]") + written(node[char]) for char in sorted(node) if char]
        if not tails:
            return ""
        return f"(?:{'|'.join(tails)})" + ("?" if "" in node else "")

    return written(tree)


def training(how: Licences, calibrate: bool) -> list[dict]:
    """Paragraphs with their family; the calibration part is drawn apart."""
    rnd = random.Random(how.seed + calibrate)
    filler = "the and of to in is that le la de un der die das und el los que on re an th nd".split()
    invented = lambda: "".join(rnd.choice("an en er in on re th st nd ti at es or ea le de ch ie".split()) for _ in range(rnd.randint(1, 4)))
    prose = lambda k: " ".join(rnd.choice(filler) if rnd.random() < 0.4 else invented() for _ in range(k))
    out = []
    for family, texts in TEMPLATES.items():
        for text in [*texts, " ".join(texts)]:
            words = text.split()
            for _ in range(how.copies):
                cut = words
                if len(words) > 14 and rnd.random() < 0.7:  # a part
                    size = rnd.randint(9, len(words))
                    at = rnd.randint(0, len(words) - size)
                    cut = words[at : at + size]
                cut = [w for w in cut if rnd.random() > 0.02]
                text_of = " ".join(cut)
                if rnd.random() < 0.4:
                    text_of = f"{rnd.choice(['Copyright (c) 2021 ' + invented().title() + '.', prose(3), prose(rnd.randint(1, 30))])} {text_of} {prose(rnd.choice([0, 0, 3, 20]))}"
                out.append({"paragraph": text_of, "family": family})
    for _ in range(how.copies * 40):
        kind = rnd.random()
        if kind < 0.4:
            text_of = prose(rnd.randint(1, 60))
        elif kind < 0.7:
            text_of = f"{prose(rnd.randint(0, 5))} {rnd.choice(OTHER)} {prose(rnd.randint(0, 10))}"
        else:  # words of licences out of order
            pool = [w for texts in TEMPLATES.values() for t in texts for w in t.split()]
            text_of = " ".join(rnd.choice(pool) if rnd.random() < 0.3 else invented() for _ in range(rnd.randint(3, 30)))
        out.append({"paragraph": text_of, "family": NONE})
    # The other families that calibrate are not those that were learnt.
    out += [{"paragraph": f"{prose(rnd.randint(0, 4))} {text}", "family": UNKNOWN} for text in UNKNOWN_TEXTS[int(calibrate) :: 2] for _ in range(how.copies)]
    return out


def literal_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<paragraph string, family string>>")))


def rated(model, paragraphs: DataFrame, how: Licences) -> DataFrame:
    """Adds ``pairs`` and the margins of the families, ``margin``, to rows with ``paragraph``."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=how.features, binary=True)
    held = paragraphs.withColumn("words", F.expr(words("paragraph"))).withColumn("grams", F.expr(grams("words")))
    return model.transform(hashed.transform(held)).withColumn("margin", vector_to_array("rawPrediction")).drop("features", "rawPrediction", "probability", "prediction")


def softened(margin: str, temperature: float) -> str:
    """SQL of the probabilities from margins."""
    top = f"transform({margin}, m -> exp((m - array_max({margin})) / {temperature}D))"
    return f"transform({top}, e -> e / aggregate({top}, 0D, (s, x) -> s + x))"


@functools.lru_cache(4)
def trained(spark: SparkSession, how: Licences):
    """The model, its temperature and the least probability of a known family."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    number = F.array_position(F.array(*map(F.lit, NAMES)), F.col("family")) - 1
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=how.features, binary=True)
    made = literal_table(spark, training(how, False)).select(number.cast("double").alias("label"), F.expr(words("paragraph")).alias("words")).select("label", F.expr(grams("words")).alias("grams"))
    model = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=60).fit(hashed.transform(made).coalesce(1))
    rows = rated(model, literal_table(spark, training(how, True)), how).select(number.cast("int").alias("label"), "margin").collect()
    soft = lambda margin, t: [e / sum(own) for own in [[math.exp((m - max(margin)) / t) for m in margin]] for e in own]
    loss = lambda t: sum(-math.log(max(1e-12, soft(r["margin"], t)[r["label"]])) for r in rows)
    temperature = min(TEMPERATURES, key=loss)
    # The likeliest family of what belongs to none of them: that much isn't enough.
    others = sorted(max(soft(r["margin"], temperature)[FIRST:]) for r in rows if r["label"] < FIRST)
    return model, temperature, max(0.5, others[min(len(others) - 1, math.ceil((1 - how.wrong) * len(others)))])


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, at, n_lines, paragraph``: the paragraphs with pairs that tell, and the lines at which they begin."""
    function = set(FUNCTION_WORDS)
    told = {pair for texts in [*TEMPLATES.values(), UNKNOWN_TEXTS] for text in texts for pair in pairs_of(text)}
    telling = sorted(p for p in told if not set(p.split(" ")) <= function)
    word = trie(sorted({w for p in telling for w in p.split(" ")} - function))
    none = "cast(array() AS array<string>)"
    some = "array(" + ", ".join(f"'{p}'" for p in telling) + ")"
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.translate(F.col(f"`{text_col}`"), "\x01\x02\x03", "   ").alias("text"))
    # Exact, and cheaper than the pairs: a pair that tells has a word that does, in the line or in one beside it.
    hit = f"RLIKE '(?i)(?<![a-z0-9]){word}(?![a-z0-9])'"
    frame = frame.where(F.expr(f"text {hit}")).select("id", F.expr("split(text, '\\\\r?\\\\n', -1)").alias("lines")).withColumn("hits", F.expr(f"transform(lines, l -> l {hit})"))
    near = "arrays_zip(lines, hits, concat(array(false), hits), concat(slice(hits, 2, size(hits)), array(false)))"
    frame = frame.withColumn("words", F.expr(f"transform({near}, z -> if(z.lines IS NOT NULL AND (z.hits OR z.`2` OR z.`3`), {words('z.lines')}, {none}))")).withColumn("words", F.expr("slice(words, 1, size(lines))"))
    # A line's pairs, and those with the last word of the line before and the first of the next.
    frame = frame.withColumn("ends", F.expr("transform(words, w -> named_struct('first', slice(w, 1, 1), 'last', if(size(w) > 0, slice(w, -1, 1), w)))"))
    around = f"slice(arrays_zip(words, lines, concat(array({none}), transform(ends, e -> e.last)), concat(slice(transform(ends, e -> e.first), 2, size(ends)), array({none}))), 1, size(lines))"
    marks = f"transform({around}, z -> if(size(z.words) > 0 AND arrays_overlap({pairs('concat(z.`2`, z.words, z.`3`)')}, {some}), 2, if(z.lines RLIKE '[A-Za-z0-9]', 1, 0)))"
    frame = frame.withColumn("marks", F.expr(marks))
    sides = "slice(arrays_zip(lines, marks, concat(array(0), marks), concat(slice(marks, 2, size(marks)), array(0))), 1, size(lines))"
    kept = f"transform({sides}, (z, i) -> if(z.marks = 2 OR (z.marks = 1 AND z.`2` = 2 AND z.`3` = 2), concat('\\u0002', i, '\\u0003', z.lines), '\\u0001'))"
    # A filter on the marks, as an inner explosion brings it along, would be pushed down and compute them twice.
    runs = frame.select("id", F.explode_outer(F.expr(f"if(array_contains(marks, 2), split(array_join({kept}, '\\n'), '[\\u0001\\n]*\\u0001[\\u0001\\n]*'), {none})")).alias("run")).where("run <> ''")
    return runs.select("id", F.expr("cast(regexp_extract(run, '\\u0002([0-9]+)', 1) AS int)").alias("at"), F.expr("regexp_count(run, '\\u0002')").alias("n_lines"), F.expr("regexp_replace(regexp_replace(run, '\\u0002[0-9]+\\u0003', ''), '-\\\\s*\\\\n[^A-Za-z0-9\\\\n]*', '-')").alias("paragraph"))


def pairs_of(text: str) -> list[str]:
    import re

    own = re.findall(TOKEN, text.lower())
    return [f"{a} {b}" for a, b in zip(own, own[1:])]


def scan(docs: DataFrame, how: Licences | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph of a licence.

    ``id, paragraph`` (the line at which it begins), ``n_lines, family`` (or ``unknown``), ``probability`` (calibrated,
    of the likeliest family), ``share`` (of word pairs with a template of that family), ``confirmed`` (known, and enough share).
    """
    how = how or Licences()
    model, temperature, known = trained(docs.sparkSession, how)
    held = rated(model, paragraphs(docs, id_col, text_col), how).withColumn("pairs", F.array_distinct(F.expr(pairs("words")))).withColumn("p", F.expr(softened("margin", temperature)))
    held = held.where("element_at(p, 1) < 0.5").withColumn("families", F.slice("p", FIRST + 1, len(TEMPLATES))).withColumn("probability", F.array_max("families"))
    best = F.element_at(F.array(*map(F.lit, TEMPLATES)), F.array_position("families", F.col("probability")).cast("int"))
    templates = {name: [sorted(set(pairs_of(t))) for t in texts] for name, texts in TEMPLATES.items()}
    shares = lambda lists: F.greatest(F.lit(0.0), *(F.size(F.array_intersect("pairs", F.array(*map(F.lit, own)))) / F.greatest(F.lit(1), F.least(F.size("pairs"), F.lit(len(own)))) for own in lists if own))
    held = held.withColumn("best", best)
    share = F.coalesce(*(F.when(F.col("best") == name, shares(lists)) for name, lists in templates.items()), F.lit(0.0))
    family = F.when(F.col("probability") >= known, F.col("best")).otherwise(UNKNOWN)
    told = held.select(F.col("id").alias(id_col), F.col("at").alias("paragraph"), "n_lines", family.alias("family"), F.round("probability", 6).alias("probability"), F.round(share, 6).alias("share"))
    return told.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("share") >= how.confirm))
