"""Operator 6: license scans.

Headers (lines, sentences over wrapped lines, paragraphs and runs of paragraphs
of any file that speak of a license) and whole license files are compared with
templates by the cosine of sparse TF-IDF vectors: terms of passages meet those of
the templates in a join, and products are summed by passage and template. Of the
passages of a file that match, the one with most matched weight decides, so a
whole license goes before a sentence of it. Files without a license of their own
inherit that of the nearest directory above them that has a license file, by
joins on paths.

Equal passages are compared once. Only the templates, whose number is fixed by
the caller, are broadcast. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least cosine of a match.
SIMILAR = 0.8
# Texts, notices and opening passages of licenses by their SPDX identifiers.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU{kind} General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU{kind} General Public License for more details.

You should have received a copy of the GNU{kind} General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GPL_TEXT = """GNU{kind} GENERAL PUBLIC LICENSE Version {version} Copyright (C) {year} Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
TEMPLATES = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", _GPL_TEXT.format(kind="", version="3, 29 June 2007", year=2007)),
    ("GPL-3.0-or-later", _GPL.format(kind="", n=3)),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", _GPL_TEXT.format(kind="", version="2, June 1991", year="1989, 1991")),
    ("GPL-2.0-or-later", _GPL.format(kind="", n=2)),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-only", _GPL_TEXT.format(kind=" LESSER", version="3, 29 June 2007", year=2007)),
    ("LGPL-3.0-or-later", _GPL.format(kind=" Lesser", n=3)),
    ("AGPL-3.0-only", _GPL_TEXT.format(kind=" AFFERO", version="3, 19 November 2007", year=2007)),
    ("AGPL-3.0-or-later", _GPL.format(kind=" Affero", n=3)),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", _UNLICENSE),
    ("LicenseRef-Proprietary", "All rights reserved."),
)
#: A passage that doesn't match this isn't a header.
CUE = r"(?i)licen[cs]|copyright|rights reserved|public domain|redistribut|permission is|warrant(?:y|ies)"
#: Names of license files.
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)\b"
SENTENCES = r"(?<=[.!?])[\s]+|[\r\n]+"
#: Paragraphs end at lines without letters and digits; in them sentences go on over line breaks.
PARAGRAPHS = r"\n[^\p{L}\p{N}]*\n"
ENDS = r"(?<=[.!?])\s+"
#: This one counts only where no other license is found.
LAST = "LicenseRef-Proprietary"
TERMS = r"[^\p{L}\p{N}.+-]+"


def templates_frame(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")


def _terms(text: Column) -> Column:
    """Terms in lower case, without full stops and hyphens at their ends, repeats included."""
    return F.filter(F.transform(F.split(F.lower(text), TERMS), lambda t: F.regexp_replace(t, r"^[.+-]+|[.-]+$", "")), lambda t: t != "")


def directory(path: Column) -> Column:
    """What stands before the last slash; the root is empty, also for paths without one."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def _runs(paragraphs: Column) -> Column:
    """Paragraphs that follow each other and all speak of a license, as one passage each."""
    marked = F.transform(paragraphs, lambda p: F.when(p.rlike(CUE), p).otherwise(F.lit("\0")))
    return F.filter(F.transform(F.split(F.array_join(marked, "\n\n"), "\0"), lambda s: F.trim(s)), lambda s: s.rlike(CUE))


def _counted(terms: DataFrame, by: str) -> DataFrame:
    return terms.select(by, F.explode("terms").alias("term")).groupBy(by, "term").agg(F.count("*").cast("double").alias("tf"))


def match_passages(passages: DataFrame, templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``passage, license, cosine, weight``: the best template of each passage text that is similar to one.

    ``weight`` is the length of the passage's vector times the cosine: how much of it is matched.

    ``passages`` has ``passage`` and ``n``, the times it occurs. Terms are
    weighted by tf * (ln((1 + passages) / (1 + passages with the term)) + 1) over
    all passages; those of ``n`` 0 are compared but don't count there. Of equal cosines the template given first wins.
    """
    held = common.materialize(passages.withColumn("terms", _terms(F.col("passage"))).withColumn("at", F.monotonically_increasing_id()), "passages")
    # terms carry the passage's number, as a passage can be a whole text
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = held.select("n", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((1.0 + F.lit(total)) / (1.0 + F.coalesce(F.col("df"), F.lit(0)))) + 1.0
    terms = common.materialize(
        _counted(held, "at").join(seen, "term", "left").select("at", "term", (F.col("tf") * idf).alias("w")), "passage-terms"
    )
    own = _counted(templates.withColumn("terms", _terms(F.col("text"))), "template").join(seen, "term", "left").select("template", "term", (F.col("tf") * idf).alias("tw"))
    own = common.materialize(own, "template-terms")
    lengths = own.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("t_length")).join(templates.select("template", "license"), "template")
    norms = terms.groupBy("at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("p_length"))
    dots = terms.join(F.broadcast(own), "term").groupBy("at", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(F.broadcast(lengths), "template").join(norms, "at").withColumn("cosine", F.round(F.col("dot") / (F.col("t_length") * F.col("p_length")), 9))
    weight = F.round(F.col("cosine") * F.col("p_length"), 6).alias("weight")
    best = scored.where(F.col("cosine") >= similar).groupBy("at").agg(F.max(F.struct("cosine", (-F.col("template")).alias("first"), "license", weight)).alias("best"))
    return held.select("at", "passage").join(best, "at").select("passage", "best.license", "best.cosine", "best.weight")


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates=TEMPLATES, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, path, license, origin, cosine, directory, licenses`` for every row.

    ``origin`` is ``own`` where a passage of the file matches, else ``inherited``
    where a directory above has a matching license file (``directory`` names it,
    the root is empty), else ``none``. Of a file's passages that match, that with
    most matched weight decides, of equals the last license by name, and the
    proprietary one only where it has no other; a
    directory has the license of most of its license files. ``licenses`` has all that the file,
    or the license files of the directory, match. Weights count lines and
    sentences in lines, not the joined ones. Null
    and empty texts have no passages; a null path inherits nothing, a path
    without a slash lies in the root. Rows of one
    key share what is found in any of them. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = files.sparkSession
    rows = files.select(F.col(key).alias("doc_id"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_file = F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE_NAME), F.lit(False))
    sentences = F.filter(F.split("text", SENTENCES), lambda s: s.rlike(CUE))
    lines = F.when(is_file, F.concat(F.array("text"), sentences)).otherwise(sentences)
    every = F.split(F.regexp_replace("text", r"\r\n?", "\n"), PARAGRAPHS)
    paragraphs = F.filter(every, lambda s: s.rlike(CUE))
    joined = F.concat(_runs(every), paragraphs, F.filter(F.flatten(F.transform(paragraphs, lambda s: F.split(s, ENDS))), lambda s: s.rlike(CUE)))
    found = lambda of, n: F.transform(of, lambda s: F.struct(s.alias("passage"), F.lit(n).alias("n")))
    each = F.array_distinct(lines)
    passages = F.concat(found(each, 1), found(F.array_except(joined, each), 0))
    spoken = rows.where(is_file | F.col("text").rlike(CUE)).select("doc_id", "path", is_file.alias("is_file"), F.explode(passages).alias("found")).select("doc_id", "path", "is_file", "found.*")
    spoken = common.materialize(spoken, "spoken")
    matched = match_passages(spoken.groupBy("passage").agg(F.sum("n").alias("n")), templates_frame(spark, templates), similar)
    ranked = F.struct((F.col("license") != LAST).alias("named"), "weight", "license", "cosine")
    per_file = common.materialize(
        spoken.join(matched, "passage").groupBy("doc_id", "path", "is_file").agg(F.max(ranked).alias("best"), F.collect_set("license").alias("found")), "licensed"
    )
    every_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    own = per_file.groupBy(F.col("doc_id").alias("own_id")).agg(F.max("best").alias("best"), every_of("found").alias("own_found"))
    places = (
        per_file.where("is_file").groupBy(directory(F.col("path")).alias("ancestor"), F.col("best.license").alias("license"))
        .agg(F.count("*").alias("files"), F.max("best.cosine").alias("cosine"), every_of("found").alias("found"))
        .groupBy("ancestor").agg(F.max(F.struct((F.col("license") != LAST).alias("named"), "files", "cosine", "license")).alias("given"), every_of("found").alias("found"))
    )
    parts = F.split("dir", "/")
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("ancestor")))
    above = F.concat(root, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor"))))
    dirs = rows.select(directory(F.col("path")).alias("dir")).where("dir is not null").distinct()
    inherited = (
        dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.ancestor").join(places, "ancestor")
        .groupBy("dir").agg(F.max_by(F.struct("ancestor", "given", "found"), "depth").alias("nearest"))
    )
    out = rows.select("doc_id", "path", directory(F.col("path")).alias("dir")).join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").join(inherited, "dir", "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("best.license", "nearest.given.license").alias("license"),
        F.when(F.col("best").isNotNull(), "own").when(F.col("nearest").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("best.cosine", "nearest.given.cosine").alias("cosine"),
        F.when(F.col("best").isNull(), F.col("nearest.ancestor")).alias("directory"),
        F.coalesce("own_found", "nearest.found").alias("licenses"),
    )
