"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from the nearest directory; DataFrame functions only.

A file's notices are its lines, and for a licence file its whole text.  Its paragraphs, first comments and, for a licence file, its whole
text are held against licence texts and headers as well.  What shares no telling term with a template (``telling_terms``) can't be close to
one and is not scored; equal notices are scored once.
A file without a licence of its own takes that of a licence file in its directory, else in the nearest one above;
ancestors are joined by path, for each directory once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.shared import Scratch

#: Function words, parts of addresses and single characters, which tell nothing of a licence.
STOP = set(
    "the of and to in or is a this be for that with by any are as it on you may at an not under all no will have has if can from into use used such shall its these their must which when where whether "
    "out without only your whom so was one do but either even other however nor neither otherwise non above way http https www org".split()
) | set("0123456789abcdefghijklmnopqrstuvwxyz")
#: What texts of other licences say as well.
RESERVED = "proprietary"
#: File names of licences for a directory.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.].*)?$"
LEAST_SCORE = 0.7
#: Licence names and the notices that stand for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
]

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
    "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: The same for whole licence texts, their paragraphs and titles, and headers of several lines.
TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License. " + _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("BSD-2-Clause", _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + _CLAUSE + _BSD_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Lines of comments; a file's first ones are read as one block.
COMMENT = r"^\s*(#|//|/?[*]|--|;|%|<!--|\"\"\"|$)"


def terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def inverse_frequencies(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """The weight of each template term, and that of any other."""
    seen = Counter(t for _, text in templates for t in set(terms(text)))
    return {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in seen.items()}, math.log(1 + len(templates)) + 1


def weights(templates: list[tuple[str, str]]) -> list[tuple[str, int, str, float]]:
    """(term, template, licence, weight) of the templates' unit vectors."""
    idf, _ = inverse_frequencies(templates)
    out = []
    for i, (name, text) in enumerate(templates):
        vector = {t: n * idf[t] for t, n in sorted(Counter(terms(text)).items())}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        out += [(t, i, name, x / norm) for t, x in vector.items()]
    return out


def telling_terms(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Terms of which each text has one that has a score of ``least`` with a template, be it not by function words.

    Of a template's other terms those of the greatest weight are taken until what is left, function words and all, is shorter than ``least``:
    by Cauchy-Schwarz a text with none of them has a lower score.  Where function words alone are longer, all other terms are taken.
    """
    vectors, out = defaultdict(list), set()
    for term, i, _, weight in weights(templates):
        vectors[i].append((-weight, term))
    for vector in vectors.values():
        rest = 1.0
        for weight, term in sorted(vector):
            if rest < least * least - 1e-9:
                break
            if term not in STOP:
                out.add(term)
                rest -= weight * weight
    return sorted(out)


def _telling(text: Column, known: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), F.array(*map(F.lit, known)))


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small fixed table; Python literals of strings without quotes and of numbers are SQL literals too."""
    body = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scored(notices: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """digest, license, score of the notices (digest, notice) that reach ``least``; a digest stands for its text from here on."""
    spark = notices.sparkSession
    idf, other = inverse_frequencies(templates)
    by_term = F.broadcast(_values(spark, sorted(idf.items()), "term, idf"))  # as many rows as templates have terms
    vectors = F.broadcast(_values(spark, weights(templates), "term, template, license, weight"))
    counted = (
        notices.groupBy("digest")
        .agg(F.first("notice").alias("notice"))
        .select("digest", F.explode(F.split(F.lower("notice"), "[^a-z0-9]+")).alias("term"))
        .filter("term <> ''")
        .groupBy("digest", "term")
        .agg(F.count("*").alias("n"))
        .join(by_term, "term", "left")
        .withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    )
    norms = counted.groupBy("digest").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counted.join(vectors, "term").groupBy("digest", "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 6)
    best = dots.join(norms, "digest").groupBy("digest").agg(F.max(F.struct(score.alias("score"), (-F.col("template")).alias("t"), "license")).alias("b"))
    return best.select("digest", "b.license", "b.score").filter(F.col("score") >= least)


def blocks(rows: DataFrame, known: list[str]) -> DataFrame:
    """path, digest, notice: paragraphs, the first lines of comments, and licence files, as far as they have one of the terms ``known``."""
    lines = F.split("text", "\n")
    code = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False)
    head = F.array_join(F.when(code == 0, lines).otherwise(F.slice(lines, 1, F.greatest(code.cast("int") - 1, F.lit(0)))), "\n")
    whole = F.when(F.substring_index("path", "/", -1).rlike(LICENSE_FILE), F.col("text"))
    found = F.array_union(F.split("text", "\n(?:[^A-Za-z0-9\n]*\n)+"), F.array(head, whole))
    return (
        rows.filter(_telling(F.col("text"), known))
        .select("path", F.explode(F.filter(found, lambda x: _telling(x, known))).alias("notice"))
        .withColumn("digest", F.sha2("notice", 256))
    )


def _best(notices: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """p, own_license, own_score: of each path's best notice."""
    return (
        notices.select("path", "digest").distinct().join(scored(notices, templates, least), "digest")
        .groupBy(F.col("path").alias("p"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
        .select("p", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"))
    )


def license_scan(
    files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_SCORE,
    texts: list[tuple[str, str]] = TEXTS,
) -> DataFrame:
    """One row per row of ``files``: path, own_license, own_score, license, origin (own, inherited, none), license_dir.

    A notice has the licence of its best template, ties going to the earlier one; a file that of its best notice, ties going to the
    first name.  Blocks (paragraphs, the first lines of comments, a licence file as a whole) are scored against ``texts`` likewise; of the best line and
    the best block the higher score counts, then the line; a line that reserves all rights, as texts of other licences do too, counts last.  In a directory with several
    licence files the highest score counts, then the first name.  A null or empty text has no notice; rows that repeat
    a path are versions of one file with one answer, and so are all null paths, which lie in no directory.  An
    empty table gives an empty result; other columns are not read.
    """
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    name = F.substring_index("path", "/", -1)
    known = telling_terms(templates, least)
    lines = F.filter(F.split("text", "\n"), lambda x: _telling(x, known))
    notices = (
        rows.filter(_telling(F.col("text"), known))
        .select("path", F.explode(F.when(name.rlike(LICENSE_FILE), F.array_append(lines, F.col("text"))).otherwise(lines)).alias("notice"))
        .withColumn("digest", F.sha2("notice", 256))
    )
    scratch = Scratch(files.sparkSession, "licenses")
    notices = scratch.save(notices, "notices")
    by_line = _best(notices, templates, least)
    by_text = _best(scratch.save(blocks(rows, telling_terms(texts, least)), "blocks"), texts, least).select(F.col("p").alias("q"), F.col("own_license").alias("of_text"), F.col("own_score").alias("text_score"))
    of_line = F.col("own_license").isNotNull() & (F.col("of_text").isNull() | ((F.col("own_license") != RESERVED) & (F.col("own_score") >= F.col("text_score"))))
    own = by_line.join(by_text, F.col("p").eqNullSafe(F.col("q")), "full").select(
        F.coalesce("p", "q").alias("p"),
        F.when(of_line, F.col("own_license")).otherwise(F.col("of_text")).alias("own_license"),
        F.when(of_line, F.col("own_score")).otherwise(F.col("text_score")).alias("own_score"),
    )
    held = (
        own.filter(F.substring_index("p", "/", -1).rlike(LICENSE_FILE))
        .groupBy(directory_of(F.col("p")).alias("license_dir"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("b"))
        .select("license_dir", F.col("b.own_license").alias("from_license"))
    )
    folders = rows.select(directory_of(F.col("path")).alias("dir")).filter("dir IS NOT NULL").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nearest = (
        folders.select("dir", F.explode(F.array_distinct(above)).alias("license_dir"))
        .join(held, "license_dir")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("license_dir").alias("depth"), "license_dir", "from_license")).alias("b"))
        .select(F.col("dir").alias("d"), "b.license_dir", "b.from_license")
    )
    found = rows.select("path").join(own, F.col("path").eqNullSafe(F.col("p")), "left").join(nearest, directory_of(F.col("path")) == F.col("d"), "left")
    has_own = F.col("own_license").isNotNull()
    return found.select(
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "from_license").alias("license"),
        F.when(has_own, "own").when(F.col("from_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has_own, F.col("license_dir")).alias("license_dir"),
    )
