"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from ancestor directories.

A passage can only reach ``least`` if it has one of a template's heaviest words: without
them the rest of the template's vector is shorter than ``least``.  These trigger words follow
from the weights, so no line is left out by a list.  A file's header passages are its lines
with a trigger word, their runs, the comment blocks or paragraphs around them, and the lines
from such a line (or the one before it) on, joined one after another up to the length of
the longest template.  A licence file (LICENSE, COPYING, ...) is first one passage as a whole; only if that
reaches no template are its header passages and paragraphs tried.  Templates are one-sentence notices,
notices as they stand in source headers, the bodies of the short licences, and the titles of the
long ones (their files hold the title as a paragraph).  A sentence that several licences share
is no template, so alone it names none of them.  Passages and templates are sparse
vectors over their words, weighted by how few of all files use each template word; words
outside the templates count with the largest weight.  A template that names versions only
fits a passage that has them all.  The best cosine of at least ``least`` names the file's
own licence.

A directory has the licence of its licence files (the best cosine; ties by name).  A file
without one of its own takes that of the nearest directory above it that has one.  That is
settled once per directory, by equi-joins on ancestor paths, then joined to files with
salted keys, as one directory may hold many files.

Null and empty texts have no licence of their own but inherit; null paths inherit nothing.
Texts of any length are scanned whole; repeated rows are each scanned; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import map_rows
from respondex.plans.skew import salted_join
from respondex.plans.staging import staged

#: Notices by licence (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": ["Licensed under the ISC License.", "Released under the ISC License."],
    "Zlib": ["Licensed under the zlib License.", "Released under the zlib License."],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "Unlicense": ["Released into the public domain under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
#: More of them: source headers and short licences in full, titles of long ones (fixed values).
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "For more information, please refer to <https://unlicense.org>",
)
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_LIBRARY = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
_LONG = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "MIT": [_MIT[0], " ".join(_MIT)],
    "BSD-3-Clause": [" ".join(_BSD)],
    "BSD-2-Clause": [" ".join(_BSD[:2] + _BSD[3:])],
    "ISC": [_ISC[0], " ".join(_ISC)],
    "Zlib": [" ".join(_ZLIB)],
    "Unlicense": [" ".join(_UNLICENSE)],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Eclipse Public License - v 2.0"],
    "LGPL-2.1": [_GPL_LIBRARY.format("library", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "GPL-3.0": [_GPL.format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": [_GPL.format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": [_GPL.format("Lesser General Public License", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": [_GPL.format("Affero General Public License", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
}
for _name, _texts in _LONG.items():
    TEMPLATES[_name] = TEMPLATES[_name] + _texts
for _name in TEMPLATES:
    if _name != "Proprietary":
        _ends = ("", "-only", "-or-later") if "GPL" in _name else ("",)
        TEMPLATES[_name] = TEMPLATES[_name] + [f"SPDX-License-Identifier: {_name}{x}" for x in _ends]
FILE_NAMES = r"(?i)^(licen[sc]e|copying|notice|copyright)([._-].*)?$"
LEAST = 0.75
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")

_COMMENT = re.compile(r"\s*(?:#|//|/?\*|--|;|%|<!--)")


def tokens(text: str) -> list[str]:
    """Words of a text; ``v2.0`` is the word ``2.0``."""
    return [w[1:] if w[0] == "v" and w[1:2].isdigit() else w for w in _WORD.findall(text.lower())]


def versions(text: str) -> set[str]:
    """Numbers that a template's licence names as its version (dates and list numbers are none)."""
    w = tokens(text)
    return {x for before, x in zip(["", *w], w) if re.fullmatch(r"\d+(\.\d+)?", x) and (before in ("version", "v", "cc0") or re.fullmatch(r"[1-9]\.0", x))}


VOCABULARY = sorted({w for group in TEMPLATES.values() for t in group for w in tokens(t)})


#: Words of the longest joined lines.
LONGEST = max(len(tokens(t)) for group in TEMPLATES.values() for t in group) + 20


def blocks(lines: list[str]) -> list[list[str]]:
    """Paragraphs and comment blocks: adjacent lines with a word that all begin with a comment mark, or all without."""
    out, before = [], None
    for line in lines:
        kind = bool(_COMMENT.match(line)) if _WORD.search(line.lower()) else None
        if kind is not None and kind == before:
            out[-1].append(line)
        elif kind is not None:
            out.append([line])
        before = kind
    return out


def joined(lines: list[str], triggers: set[str]) -> list[str]:
    """Blocks around lines with a trigger, and lines from each such line or the one before it on, joined up to LONGEST words."""
    out = []
    for block in blocks(lines):
        hits = [i for i, line in enumerate(block) if not triggers.isdisjoint(tokens(line))]
        if not hits or len(block) == 1:
            continue
        out.append(" ".join(block))
        sizes = [len(tokens(line)) for line in block]
        for i in sorted({i for h in hits for i in (h - 1, h) if i >= 0}):
            n = sizes[i]
            for j in range(i + 1, len(block)):
                n += sizes[j]
                if n > LONGEST:
                    break
                out.append(" ".join(block[i : j + 1]))
    return list(dict.fromkeys(out))


def passages(text: str | None, whole: bool, triggers: set[str]) -> list[str]:
    """Lines with a trigger, their runs, what is around them; of a licence file all blocks too."""
    if not text or triggers.isdisjoint(tokens(text)):
        return []
    out, run = [*map(" ".join, blocks(text.split("\n")))] if whole else [], []
    for line in [*text.split("\n"), ""]:
        if not triggers.isdisjoint(tokens(line)):
            run.append(line)
            out.append(line)
        else:
            if len(run) > 1:
                out.append(" ".join(run))
            run = []
    return list(dict.fromkeys(out + joined(text.split("\n"), triggers)))


class Scanner:
    """Cosines of passages to the templates under given document frequencies."""

    def __init__(self, files: int, frequency: dict[str, int], least: float = LEAST):
        self.top = log(files + 1) + 1
        self.idf = {w: log((files + 1) / (frequency.get(w, 0) + 1)) + 1 for w in VOCABULARY}
        self.templates = [(name, self.vector(t), versions(t)) for name, group in TEMPLATES.items() for t in group]
        self.triggers, self.least2 = set(), least * least
        for _, v, _ in self.templates:
            left = 1.0
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if left < self.least2:
                    break
                self.triggers.add(w)
                left -= v[w] * v[w]

    def vector(self, text: str) -> dict[str, float]:
        counts = Counter(tokens(text))
        v = {w: n * self.idf.get(w, self.top) for w, n in counts.items()}
        norm = sum(x * x for x in v.values()) ** 0.5 or 1.0
        return {w: x / norm for w, x in v.items()}

    def best(self, text: str | None, whole: bool) -> tuple[str | None, float]:
        """(licence, cosine) of the most similar template that fits; (None, 0) where no passage can reach the limit; ties go to the lower name.

        whole: a licence file, whose whole text comes before its passages.
        """
        if whole and text:
            found = self.best_of([text])
            if found[0] is not None and found[1] ** 2 >= self.least2:
                return found
        return self.best_of(passages(text, whole, self.triggers))

    def best_of(self, some: list[str]) -> tuple[str | None, float]:
        """``best`` of given passages."""
        found: tuple[float, str | None] = (0.0, None)
        for p in some:
            v = self.vector(p)
            if sum(x * x for w, x in v.items() if w in self.idf) < self.least2:  # no template's cosine is above the root of this share
                continue
            for name, t, need in self.templates:
                if not all(x in v for x in need):
                    continue
                c = round(sum(x * v.get(w, 0.0) for w, x in t.items()), 9)
                if c > found[0] or c == found[0] and found[1] is not None and name < found[1]:
                    found = (c, name)
        return found[1], found[0]


def frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files and of those that use each template word; files: (text)."""
    known = set(VOCABULARY)

    def count(batches):
        n, seen = 0, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                seen.update(known.intersection(tokens(text)) if text else ())
        yield pa.RecordBatch.from_pydict({"word": pa.array([None, *seen], pa.string()), "n": pa.array([n, *seen.values()], pa.int64())})

    got = {r["word"]: r["n"] for r in files.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(None, 0), got


def scanned(files: DataFrame, id_col: str, path_col: str, text_col: str, least: float = LEAST) -> DataFrame:
    """``(id, path, own_license, score, license, license_dir)`` of every row.

    path: slash-separated, the last part is the file's name.  license: own or inherited;
    license_dir: the directory it came from (null: own or none; '' is the root).
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    sent = files.sparkSession.sparkContext.broadcast(frequencies(rows))
    is_file = F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES)
    rows = rows.withColumn("whole", F.coalesce(is_file, F.lit(False)))

    def make():
        scanner = Scanner(*sent.value, least)

        def f(batch: pa.RecordBatch) -> dict:
            got = [scanner.best(t, w) for t, w in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist(), strict=True)]
            return {c: batch.column(c) for c in ("id", "path", "whole")} | {"own": [n if s >= least else None for n, s in got], "score": [s for _, s in got]}

        return f

    kind = f"id {rows.schema['id'].dataType.simpleString()}, path string, whole boolean, own string, score double"
    own = map_rows(rows, kind, "text", make).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    own = staged(own, "license-own")
    by_dir = own.where("whole AND own IS NOT NULL AND dir IS NOT NULL").groupBy(F.col("dir").alias("up")).agg(F.min(F.struct(-F.col("score"), F.col("own").alias("name"))).alias("b")).select("up", F.col("b.name").alias("name"))
    # every directory looks at itself and all above it, the longest path with a licence is nearest
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = salted_join(dirs, by_dir, ["up"], how="inner").groupBy("dir").agg(F.max_by(F.struct("up", "name"), F.length("up")).alias("n"))
    out = salted_join(own, nearest.select("dir", F.col("n.up").alias("up"), F.col("n.name").alias("name")), ["dir"])
    return out.select(F.col("id").alias(id_col), "path", F.col("own").alias("own_license"), "score", F.coalesce("own", "name").alias("license"), F.when(F.col("own").isNull(), F.col("up")).alias("license_dir"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document as a file: folders of 1000 and 100 ids below its source, the first of each folder being its licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    i = F.col("doc_id")
    name = F.when(i % 1000 == 0, F.lit("LICENSE")).when(i % 100 == 0, F.concat(F.lit("d"), F.floor(i / 100), F.lit("/LICENSE"))).otherwise(F.concat(F.lit("d"), F.floor(i / 100), F.lit("/"), i, F.lit(".txt")))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/p"), F.floor(i / 1000), F.lit("/"), name)
    return scanned(docs.withColumn("path", path), "doc_id", "path", "text")
