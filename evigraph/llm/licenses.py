"""Licence scans: a trained paragraph classifier with template confirmation. DataFrame functions only.

A paragraph is a run of consecutive lines that hold a feature each, so a hard-wrapped notice is one paragraph and a licence line inside
other text is one too (runs over ``LONGEST`` lines are judged in parts). Its features are the distinct words and word pairs of the
lower-cased, joined lines; a sparse multinomial logistic regression over them gives a probability for each licence family and for
``unknown``. It is fitted here, from the templates below in many variations and from look-alike sentences that are no licence (the
unknown class), with an L1 penalty so that few features have weight. A temperature calibrates the probabilities; it is fitted on templates
that the fit behind it has not seen, one of each family.

A family is predicted where its calibrated probability is the largest (of equal ones the first listed) and at least ``SURE``. A template
then confirms it: the share of the shorter side's word pairs that the paragraph and the nearest template of that family have in common
must reach ``ALIKE``. Where the lines of a paragraph, taken alone, are confirmed for two families or more, or the whole is predicted as none,
its lines count one by one instead.
Only features that no look-alike has can speak for a family, so a line without any of their words is unknown without being scored: a
pattern of those words picks the lines to score, which changes no result.

Null text has no paragraphs. Repeated rows get equal results, repeated paragraphs count each; whole texts are read; a column named as the result
is replaced, others pass through; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

#: Wording of licence notices, by family.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license, version 3", "gnu affero general public license version 3",
        "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "spdx-license-identifier: agpl-3.0-or-later",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu affero general public license for more details. you should have received a copy of the gnu affero general public license along with this program. if not, see https://www.gnu.org/licenses/.",
    ],
    "apache": [
        "licensed under the apache license, version 2.0", "apache license version 2.0, january 2004", "available under the apache license 2.0",
        "you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
        "spdx-license-identifier: apache-2.0",
        "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.",
    ],
    "bsd": [
        "licensed under the bsd 3-clause license", "the bsd 3-clause license", "under the bsd license",
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "spdx-license-identifier: bsd-3-clause",
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages",
    ],
    "cc-by": ["licensed under cc by 4.0", "creative commons attribution 4.0 international (cc by 4.0)", "this work is licensed under a creative commons attribution 4.0 international license", "available under the creative commons attribution license", "spdx-license-identifier: cc-by-4.0"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international (cc by-nc 4.0)", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "spdx-license-identifier: cc-by-nc-4.0"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international (cc by-sa 4.0)", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "spdx-license-identifier: cc-by-sa-4.0"],
    "cc0": ["released under cc0 1.0", "cc0 1.0 universal", "the author has dedicated the work to the public domain by waiving all rights under cc0 1.0 universal", "dedicated to the public domain", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. cc0 1.0 universal public domain dedication"],
    "gpl": [
        "this work is licensed under the gnu general public license, version 3", "gnu general public license version 3",
        "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation",
        "spdx-license-identifier: gpl-3.0-or-later",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details. you should have received a copy of the gnu general public license along with this program. if not, see https://www.gnu.org/licenses/.",
    ],
    "isc": ["licensed under the isc license", "the isc license", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "spdx-license-identifier: isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits"],
    "lgpl": [
        "licensed under the gnu lesser general public license, version 2.1", "gnu lesser general public license version 2.1",
        "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "spdx-license-identifier: lgpl-2.1-or-later",
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version. this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu lesser general public license for more details.",
    ],
    "mit": [
        "released under the mit license", "the mit license (mit)",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "spdx-license-identifier: mit",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
        "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "mpl": ["licensed under the mozilla public license, version 2.0", "mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0", "spdx-license-identifier: mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/."],
    "proprietary": ["all rights reserved", "copyright by the publisher, all rights reserved", "no part of this publication may be reproduced without the prior written permission of the publisher", "proprietary and confidential, unauthorized copying is strictly prohibited"],
}
#: Sentences near the subject that grant nothing.
OTHER = [
    "the driver lost his license last year and went by bus", "she asked for permission to leave the room early", "the copy of the book was on the table near the source of light",
    "the apache helicopter flew over the general in the public square", "students at mit wrote a work about free software and its conditions", "the terms of the sale were under discussion",
    "the foundation published a general report on public works", "use the following form to modify your order", "the author of the work lives in the city and writes code",
    "human rights are reserved for no one alone", "commons in the village were open to all people", "version 3 of the file was lost under the desk", "attribution of the painting is not certain",
    "the name of the holder may be used in the list", "the software was sold with a fee for any person", "the bsd and the gnu are animals in this story", "we may obtain a permit at the office",
    "the notice was included in all letters to the public", "the license plate of the car was from 2020", "fees are charged for documentation and files", "it was released under pressure in version 2.0",
    "you can see that an apple or a pear is part of what lies above, as either is available to you", "neither rain nor snow shall except anyone", "v is a letter, sa and nc are two more", "subject to change, with the prior and the written purpose",
    "the forms and names were provided on that basis, part by part", "see http and the like", "it can be that you can not", "an international prior charge was granted later", "products that are strictly for later", "written publication by the publisher", "above all, associated with the copies", "it and that, as is",
    "that the end of this and this and or on an end with or without the names of it and the other in all and or in the way that this work is and of the author of any", "the above is at the end and on the list or of the kind",
    "distribution of the goods is without problems of any kind", "the domain of the function is public knowledge", "mozilla and others made a browser for the public",
]
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
SURE, ALIKE, SEED = 0.6, 0.6, 3
#: Lines of a paragraph at most.
LONGEST = 64
WORD = r"[a-z0-9]+(?:[.+][a-z0-9]+)*"


def grams(line: str) -> set[str]:
    w = re.findall(WORD, line.lower())
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def held_back() -> dict[str, str]:
    """The template of each family that the calibrating fit does not see: the first."""
    return {f: ts[0] for f, ts in TEMPLATES.items() if len(ts) > 1}


def examples(seed: int = SEED, each: int = 60, templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, str]]:
    """(paragraph, family): templates whole, cut, led in and led out, with names and years; and paragraphs that are no licence."""
    rnd = random.Random(seed)
    plain = sorted({w for t in OTHER for w in t.split()})
    out = []
    for family, texts in templates.items():
        for k in range(each):
            w = texts[k % len(texts)].split()
            if len(w) > 9 and rnd.random() < 0.4:
                a = rnd.randrange(len(w) - 7)
                w = w[a : a + rnd.randint(7, len(w) - a)]
            if rnd.random() < 0.3:
                w = rnd.choice([f"copyright {rnd.randint(1990, 2025)} the authors.", "this project is", "see the file."]).split() + w
            if rnd.random() < 0.3:
                w += [rnd.choice(plain) for _ in range(rnd.randint(1, 6))]
            out.append((" ".join(w), family))
    for k in range(each * 8):
        w = OTHER[k % len(OTHER)].split()
        if k >= len(OTHER):
            w = w[: rnd.randint(3, len(w))] + [rnd.choice(plain) for _ in range(rnd.randint(0, 8))]
        out.append((" ".join(w), UNKNOWN))
    rnd.shuffle(out)
    return out


class Model:
    """Vocabulary, weights (feature by family), biases and temperature."""

    def __init__(self, seed: int = SEED, templates: dict[str, list[str]] = TEMPLATES, calibrated: bool = True):
        made = examples(seed, templates=templates)
        other = set().union(*(grams(t) for t, f in made if f == UNKNOWN), *(grams(t) for t in OTHER))
        found = {g for ts in templates.values() for x in ts for g in grams(x)} - other
        self.vocabulary = sorted(g for g in found if " " not in g) + sorted(g for g in found if " " in g)
        x, y = self._matrix(made)
        w, b = np.zeros((len(self.vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))
        step, shrink = 2.0, 2e-4
        for _ in range(400):  # proximal gradient descent
            p = self._softmax(x @ w + b)
            w -= step * (x.T @ (p - y)) / len(x)
            b -= step * (p - y).mean(axis=0)
            w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        used = np.abs(w).max(axis=1) > 0
        self.vocabulary = [g for g, u in zip(self.vocabulary, used) if u]
        self.weights, self.bias, self.scale = w[used], b, 1.0
        if calibrated:
            back = held_back()
            behind = Model(seed, {f: [t for t in ts if t != back.get(f)] for f, ts in templates.items()}, calibrated=False)
            unseen = examples(seed + 1, 20, {f: [t] for f, t in back.items()})
            z, t = behind._matrix(unseen)
            logits = z @ behind.weights + behind.bias
            scales = np.linspace(0.3, 3, 55)
            loss = [-np.log(np.maximum((self._softmax(logits * s) * t).sum(axis=1), 1e-12)).mean() for s in scales]
            self.scale = float(scales[int(np.argmin(loss))])

    def _matrix(self, rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        at = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(at)), np.float32)
        for i, (t, _) in enumerate(rows):
            x[i, [at[g] for g in grams(t) if g in at]] = 1
        return x, np.eye(len(FAMILIES))[[FAMILIES.index(f) for _, f in rows]]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, line: str) -> np.ndarray:
        have = grams(line)
        z = self.bias + sum((self.weights[i] for i, g in enumerate(self.vocabulary) if g in have), np.zeros(len(self.bias)))
        return self._softmax(z[None, :] * self.scale)[0]

    def anchors(self) -> str:
        """A pattern that every lower-cased line with a feature matches: single words, and pairs as they can stand in a line, at word bounds."""
        gap = "[^a-z0-9]+"
        singles = {g for g in self.vocabulary if " " not in g}
        parts = [re.escape(g) for g in sorted(singles)]
        parts += [gap.join(map(re.escape, g.split())) for g in self.vocabulary if " " in g and not singles & set(g.split())]
        by_first: dict[str, list[str]] = {}
        for p in parts:
            by_first.setdefault(p[0], []).append(p[1:])
        heads = [f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())]
        return f"(?<![a-z0-9])(?:{'|'.join(heads)})(?![a-z0-9])"


_model: Model | None = None


def fit() -> Model:
    global _model
    if _model is None:
        _model = Model()
    return _model


def _literal(value, kind: str) -> Column:
    """A constant of a nested type; the optimiser folds it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _grams(line: Column) -> Column:
    words = F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))
    two = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.transform(F.array(words), lambda w: F.array_distinct(F.concat(w, two(w))))[0]


def scan_documents(df: DataFrame, text: str = "text", hits: str = "licenses") -> DataFrame:
    """All columns of ``df`` and ``hits``: array of (first line from 0, number of lines, family, probability, confirmed), a row for each predicted paragraph."""
    m = fit()
    weights = _literal({g: [round(float(x), 6) for x in m.weights[i]] for i, g in enumerate(m.vocabulary)}, "map<string,array<double>>")
    bias = F.array(*[F.lit(round(float(x), 6)) for x in m.bias])
    names = F.array(*[F.lit(f) for f in FAMILIES])
    pairs = {f: [sorted(g for g in grams(t) if " " in g) for t in ts] for f, ts in TEMPLATES.items()} | {UNKNOWN: []}
    templates = _literal([pairs[f] for f in FAMILIES], "array<array<array<string>>>")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    anchored = m.anchors()
    lines = F.filter(F.transform(F.split(F.lower(body), "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("s"))), lambda x: x["s"].rlike(anchored))
    picked = F.when(F.lower(body).rlike(anchored), lines).otherwise(F.array().cast("array<struct<line:int,s:string>>"))

    def paragraphs(of: Column) -> Column:
        """Arrays of the lines of each paragraph."""
        begins = F.transform(of, lambda x, i: F.struct(i.alias("i"), ((i == 0) | (x["line"] - F.get(of, i - 1)["line"] > 1) | (x["line"] % LONGEST == 0)).alias("new")))
        heads = F.transform(F.filter(begins, lambda x: x["new"]), lambda x: x["i"])
        return _bound(heads, lambda h: F.transform(h, lambda a, j: F.slice(of, a + 1, F.coalesce(F.get(h, j + 1), F.size(of)) - a)))

    def logits(g: Column) -> Column:
        rows = F.transform(F.filter(g, lambda k: k.isin(m.vocabulary)), lambda k: F.element_at(weights, k))
        return F.transform(F.aggregate(rows, bias, lambda a, v: F.zip_with(a, v, lambda p, q: p + q)), lambda v: v * m.scale)

    def judged(line: Column, many: Column, s: Column) -> Column:
        def told(g: Column, z: Column) -> Column:
            top = F.array_max(z)
            k = (F.array_position(z, top) - 1).cast("int")
            p = 1 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))
            mine = F.filter(g, lambda x: F.contains(x, F.lit(" ")))
            return F.struct(k.alias("k"), p.alias("p"), mine.alias("mine"))

        def shown(x: Column) -> Column:
            share = lambda t: F.size(F.array_intersect(x["mine"], t)) / F.greatest(F.least(F.size(x["mine"]), F.size(t)), F.lit(1))
            sure = (x["k"] != FAMILIES.index(UNKNOWN)) & (x["p"] >= SURE)
            near = sure & F.exists(F.get(templates, x["k"]), lambda t: share(t) >= ALIKE)
            return F.struct(line.cast("long").alias("line"), many.cast("long").alias("lines"), F.get(names, x["k"]).alias("family"), x["p"].alias("probability"), near.alias("confirmed"), sure.alias("sure"))

        return _bound(_grams(s), lambda g: _bound(logits(g), lambda z: _bound(told(g, z), shown)))

    def whole(p: Column) -> Column:
        alone = F.transform(p, lambda x: judged(x["line"], F.lit(1), x["s"]))
        joined = F.array(judged(p[0]["line"], F.size(p), F.array_join(F.transform(p, lambda x: x["s"]), " ")))
        several = lambda v: F.size(F.array_distinct(F.transform(F.filter(v, lambda x: x["confirmed"]), lambda x: x["family"]))) > 1
        pick = lambda one, by_line: F.when(several(by_line) | ~one[0]["sure"], by_line).otherwise(one)
        return F.when(F.size(p) == 1, alone).otherwise(_bound(F.struct(joined.alias("one"), alone.alias("lines")), lambda v: pick(v["one"], v["lines"])))

    found = F.flatten(F.transform(_bound(picked, paragraphs), whole))
    return without(df, hits).withColumn(hits, F.transform(F.filter(found, lambda x: x["sure"]), lambda x: x.dropFields("sure")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its paragraphs (between blank lines), predicted licence paragraphs, and the confirmed ones as line:family."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_documents(docs)
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\n(?:[\x20\x09-\x0D]*\n)+", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_paragraphs"),
        F.size("licenses").cast("long").alias("n_predicted"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])), ",").alias("confirmed"),
    )
