"""License scan with a positional rare-token index.

Words are runs of a-z, 0-9 and non-ASCII bytes after lower-casing A-Z. Each template is a public notice, the short form of one, or a whole short licence. Its rare
tokens are its words of highest IDF, where document frequencies come from all documents scanned. A place in a file (where the template's first word would stand) is supported by the rare
tokens found at their relative positions, give or take the slack; over half of them must. So at least one of the rarest half must be there: those seeds are looked up first and open the
places, the others' postings are intersected with open templates only, and a file without a seed is done. Each supported place is verified: every mandatory key phrase must
stand there, and the share of the template's words found around it is the score. Base phrases are counted separately and always reported.

Null and empty texts have no words and no labels; repeated rows and ids get each its own, equal result; of equal scores the label is the same anyway. An empty table gives an empty one. No
cap on hits: a long file with many notices is scanned whole. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_blocks, table, utf8

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (label, a public notice or short licence, mandatory key phrases).
TEMPLATES = [
    ("mit", "released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["permission is hereby granted", "deal in the software without restriction"]),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ["permission is hereby granted free of charge", "sublicense and or sell copies"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ["with or without fee is hereby granted"]),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ["you may not use this file except in compliance with the license"]),
    ("gpl-2.0", "this work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version.""", ["gnu general public license", "either version 2 of the license or at your option any later version"]),
    ("gpl-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""", ["gnu general public license", "either version 3 of the license or at your option any later version"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "licensed under the GNU Affero General Public License", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES""", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""", ["nor the names of its contributors may be used to endorse"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""", ["permission is granted to anyone to use this software", "alter it and redistribute it freely"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright, CC0 public domain dedication", ["cc0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
]

TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(TO_WORDS).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word places at which phrase begins; joined: words between single spaces, with one at each end."""
    out, at, words, counted = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


class Index:
    """Positional postings of the templates' rare tokens under given document frequencies."""

    def __init__(self, df: dict[bytes, int], n_docs: int, rare: int = 4, templates=TEMPLATES):
        self.templates = [(label, words_of(text), [k.encode() for k in keys]) for label, text, keys in templates]
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for _, words, _ in self.templates for w in words}
        self.seeds, self.others = defaultdict(list), defaultdict(list)
        self.votes, self.slack = [], [max(3, len(words) // 20) for _, words, _ in self.templates]
        for k, (_, words, _) in enumerate(self.templates):
            top = sorted(set(words), key=lambda w: (-self.idf[w], w))[: rare if len(words) < 30 else 2 * rare]
            self.votes.append(len(top))
            for n, w in enumerate(top):
                # over half of the rare tokens must be there, and so one of the rarest half
                into = self.seeds if n < (len(top) + 1) // 2 else self.others
                into[w] += [(k, p) for p, x in enumerate(words) if x == w]
        self.rare = frozenset(self.seeds) | frozenset(self.others)

    def score(self, k: int, window: list[bytes]) -> float:
        """Share of a template's words in the window, 0 if a mandatory phrase is missing."""
        _, template, keys = self.templates[k]
        joined = b" " + b" ".join(window) + b" "
        if not all(b" " + key + b" " in joined for key in keys):
            return 0.0
        got = Counter(window)
        return sum(min(n, got[w]) for w, n in Counter(template).items()) / len(template)

    def match(self, words: list[bytes], least: float = 0.7) -> dict[str, float]:
        """Best score by label."""
        hits = [(i, w) for i, w in enumerate(words) if w in self.rare]
        support = defaultdict(lambda: defaultdict(set))
        opened = defaultdict(set)
        for i, w in hits:
            for k, p in self.seeds.get(w, ()):
                support[k][i - p].add(w)
                opened[k].add(i - p)
        if not opened:
            return {}
        for i, w in hits:
            for k, p in self.others.get(w, ()):
                if k in opened:
                    support[k][i - p].add(w)
        found: dict[str, float] = {}
        for k, seeds in opened.items():
            at, slack, n = support[k], self.slack[k], len(self.templates[k][1])
            for offset in sorted({o + d for o in seeds for d in range(-slack, slack + 1)}):
                near = set().union(*(at[o] for o in range(offset - slack, offset + slack + 1) if o in at))
                if 2 * len(near) > self.votes[k]:
                    score = self.score(k, words[max(0, offset - slack) : max(0, offset + n + slack)])
                    if score >= least:
                        label = self.templates[k][0]
                        found[label] = max(found.get(label, 0.0), score)
        return found


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """Document frequency of the templates' words over all rows, and the rows. At most one row a template word reaches the driver."""
    vocabulary = {w for _, text, _ in TEMPLATES for w in words_of(text)}

    def run(batches):
        df, n = Counter(), 0
        for b in in_blocks(batches):
            for text in b.column(0).to_pylist():
                df.update(vocabulary.intersection(words_of(text)))
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in df)], "n": [n, *df.values()]})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, places of base phrases, labels of either kind, best template score."""
    index = Index(*frequencies(docs, text_col))
    base = [(p.encode(), label) for p, label in BASE.items()]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    kinds = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in in_blocks(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                at, labels = [], set()
                for phrase, label in base:
                    if here := places(joined, phrase):
                        at += here
                        labels.add(label)
                found = index.match(words)
                rows.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), max(found.values(), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
