"""License scans: TF-IDF cosine of license text to templates, then inheritance down the directories. DataFrame functions only.

Every line of a text that speaks of a license, with the license lines next to it, is a header; a text that consists of
little else is a license file, and its whole text is compared too. Equal headers are scored once, so a notice that a third of all files carry costs one row.
A file without a license of its own takes that of the nearest directory above it that has a license file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiscore.session import written

#: Headers of a cosine of at least this to their best template have its license.
MIN_COSINE = 0.4
#: A text whose license lines hold this share of its words is a license file.
FILE_SHARE = 0.5

#: Longer lines are split at sentence ends, and sentences that are longer still into windows of words around each cue.
LONG_LINE = 40
WORDS_BEFORE = 8
WORDS_AFTER = 16
#: Terms that tell versions and variants of a license apart weigh this much more.
DECISIVE_WEIGHT = 2.0
DECISIVE = [
    "1.0", "1.1", "2", "2.0", "2.1", "3", "3.0", "4.0", "clause", "neither", "endorse", "affero", "lesser", "library",
    "sharealike", "noncommercial", "noderivatives", "sa", "nc", "nd",
]

_CUE = r"(?i)licen[cs]|copyright|spdx|redistribut|public domain|warrant(?:y|ies)|permission is hereby|^[^a-z0-9]*version [0-9]"
_CUE_WORD = r"(?i)licen[cs]|copyright|spdx|redistribut|domain|warrant|permission"
_SENTENCE_END = "([.!?;]) +"
_MARKS_ONLY = r"^\s*[#/*;%!-]+\s*$"

# Notices and short texts of well-known licenses, as the licenses prescribe their wording.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."
)
_ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
    "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
    "Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_GNU_PLAIN = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version}"


def _gnu(name: str, version: str, spdx: str, dated: str) -> list[str]:
    return [
        f"This work is licensed under the GNU {name}, version {version}.",
        f"Licensed under the GNU {name}, version {version}.",
        f"SPDX-License-Identifier: {spdx}",
        f"SPDX-License-Identifier: {spdx}-only",
        f"SPDX-License-Identifier: {spdx}-or-later",
        f"GNU {name} Version {version}, {dated}",
        _GNU_NOTICE.format(name=name, version=version),
        _GNU_PLAIN.format(name=name, version=version),
    ]


def _creative_commons(kind: str, words: str) -> list[str]:
    return [
        f"Licensed under CC {kind} 4.0.",
        f"SPDX-License-Identifier: CC-{kind}-4.0",
        f"This work is licensed under a Creative Commons {words} 4.0 International License.",
        f"Licensed under a Creative Commons {words} 4.0 International License.",
    ]


TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        _MIT_GRANT,
        f"MIT License {_MIT_GRANT} {_MIT_WARRANTY}",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "GPL-3.0": _gnu("General Public License", "3", "GPL-3.0", "29 June 2007"),
    "GPL-2.0": _gnu("General Public License", "2", "GPL-2.0", "June 1991"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "LGPL-3.0", "29 June 2007"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "LGPL-2.1", "February 1999"),
    "AGPL-3.0": _gnu("Affero General Public License", "3", "AGPL-3.0", "19 November 2007"),
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_GRANT + _BSD_THIRD,
        _BSD_GRANT + _BSD_THIRD + _BSD_WARRANTY,
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        _BSD_GRANT,
        _BSD_GRANT + _BSD_WARRANTY,
    ],
    "MPL-2.0": [
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", _ISC_TEXT],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": _creative_commons("BY", "Attribution"),
    "CC-BY-SA-4.0": _creative_commons("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _creative_commons("BY-NC", "Attribution-NonCommercial"),
}


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, texts in TEMPLATES.items() for t in texts)]
    return spark.createDataFrame(rows, "template_id int, license string, text string")


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; a dot between digits stays."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def _words(text: Column) -> Column:
    return F.split(F.btrim(text), " ")


def _windows(words: Column) -> Column:
    """The words around each one that speaks of a license, each window with an empty piece behind it."""
    cues = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).rlike(_CUE_WORD))
    from_ = lambda i: F.greatest(i - WORDS_BEFORE, F.lit(1))
    window = lambda i: F.array_join(F.slice(words, from_(i), i + WORDS_AFTER - from_(i) + 1), " ")
    return F.concat(F.array(F.lit("")), F.flatten(F.transform(cues, lambda i: F.array(window(i), F.lit("")))))


def _pieces(text: Column) -> Column:
    """The lines of a text, long ones by sentences and long sentences by windows, without lines of comment marks alone."""
    is_short = lambda piece: F.size(_words(piece)) <= LONG_LINE
    # The inner array binds the words, so that they are split once.
    of_part = lambda part: F.when(is_short(part), F.array(part)).otherwise(
        F.flatten(F.transform(F.array(_words(part)), _windows))
    )
    sentences = lambda line: F.split(F.regexp_replace(line, _SENTENCE_END, "$1\n"), "\n")
    of_line = lambda line: F.when(is_short(line), F.array(line)).otherwise(
        F.flatten(F.transform(sentences(line), of_part))
    )
    return F.filter(F.flatten(F.transform(F.split(text, "\n"), of_line)), lambda piece: ~piece.rlike(_MARKS_ONLY))


def headers(docs: DataFrame, file_share: float = FILE_SHARE) -> DataFrame:
    """``docs`` (``_id, _path, _text``) with the text's headers as ``_header``, their share of its words, ``_named``, whether
    the file's name is that of a license file, and of license files the text itself, on one line, as ``_whole``.

    License lines that follow one another with no other line between are one header; lines of comment marks alone part
    nothing, and of a long line only the sentences, or the words, around its license words count. Headers of a text are
    parted by an empty line, which none of them holds; null where the text has none.
    """
    cue = F.col("_text").rlike(_CUE)
    lines = F.transform(_pieces(F.col("_text")), lambda line: F.when(line.rlike(_CUE), F.btrim(line)).otherwise(""))
    found = docs.withColumn("_lines", F.when(cue, lines))
    header = F.regexp_replace(F.btrim(F.array_join("_lines", "\n"), F.lit("\n")), "\n{2,}", "\n\n")
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    named = F.coalesce(F.regexp_extract("_path", r"([^/]*)$", 1).rlike(r"(?i)^(un)?licen[cs]e|^copying"), F.lit(False))
    shared = found.select(
        "_id",
        "_path",
        "_text",
        named.alias("_named"),
        F.when(cue & (header != ""), header).alias("_runs"),
        F.when(cue, F.least(words(header) / words(F.col("_text")), F.lit(1.0))).alias("_share"),
    )
    whole = F.regexp_replace(F.btrim("_text"), r"\s+", " ")
    is_file = F.col("_named") | (F.col("_share") >= file_share)
    return shared.select(
        "_id",
        "_path",
        F.col("_runs").alias("_header"),
        F.when(is_file, whole).alias("_whole"),
        "_share",
        "_named",
    )


def _weights(vectors: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """Sparse TF-IDF vectors of length one: ``key, term, w``."""
    counts = vectors.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    decisive = F.when(F.col("term").isin(DECISIVE), DECISIVE_WEIGHT).otherwise(1.0)
    raw = counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf") * decisive).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("w"))


def match_templates(headers_found: DataFrame, known: DataFrame) -> DataFrame:
    """``_header, license, cosine``: the best template of any header of each distinct ``_header``; of equal cosines the
    alphabetically first license.

    Document frequencies count every file's distinct headers, copies in other files too. Terms are weighted by
    ``ln((1 + N) / (1 + df)) + 1`` over the N headers and templates, and those in ``DECISIVE`` by twice that.
    """
    texts = headers_found.where(F.col("_header").isNotNull()).groupBy("_header").agg(F.count(F.lit(1)).alias("n_files"))
    texts = texts.select(F.col("_header").alias("_headers"), "n_files", F.explode(F.array_distinct(F.split("_header", "\n\n"))).alias("_header"))
    distinct = texts.groupBy("_header").agg(F.sum("n_files").alias("n_files"))
    distinct = distinct.withColumn("terms", terms(F.col("_header"))).where(F.size("terms") > 0)
    sought = known.withColumn("terms", terms(F.col("text")))
    per_text = distinct.select("n_files", F.explode(F.array_distinct("terms")).alias("term"))
    in_templates = sought.select(F.lit(1).cast("long").alias("n_files"), F.explode(F.array_distinct("terms")).alias("term"))
    df = per_text.unionAll(in_templates).groupBy("term").agg(F.sum("n_files").alias("df"))
    total = distinct.select("n_files").unionAll(sought.select(F.lit(1).cast("long"))).agg(F.sum("n_files").alias("total"))
    # One row, so this product adds a column and no rows.
    idf = df.join(F.broadcast(total)).select("term", (F.ln((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    ours = _weights(distinct.select("_header", "terms"), "_header", idf)
    theirs = _weights(sought.select("template_id", "terms"), "template_id", idf)
    theirs = theirs.join(known.select("template_id", "license"), "template_id").withColumnRenamed("w", "v")
    # Templates are a constant list, a few hundred rows of terms.
    dots = ours.join(F.broadcast(theirs), "term").groupBy("_header", "template_id", "license")
    cosines = dots.agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("cosine"))
    best = cosines.groupBy("_header").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"))
    of_texts = texts.join(best, "_header").groupBy(F.col("_headers").alias("_header")).agg(F.min("best").alias("best"))
    return of_texts.select("_header", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"))


def directory(path: Column) -> Column:
    """What stands before the last slash; "" for a file at the root. Paths have no slash at their begin."""
    return F.coalesce(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def ancestors(dir_: Column) -> Column:
    """The directory, those above it and the root, as an array of (depth, name)."""
    parts = F.split(dir_, "/")
    depth = F.when(dir_ == "", 0).otherwise(F.size(parts))
    above = F.transform(
        F.sequence(F.lit(0), depth), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("name"))
    )
    return above


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (``_id, _path, license, cosine, is_file``) with ``origin`` and the license of the nearest directory.

    Only distinct directories meet their ancestors: a directory of a third of all files is one row there, and the files
    then join their own directory's answer.
    """
    placed = files.withColumn("_dir", directory(F.col("_path")))
    grants = placed.where(F.col("is_file") & F.col("license").isNotNull())
    # Of several license files in one directory the surest, then the alphabetically first license.
    grants = grants.groupBy(F.col("_dir").alias("_above")).agg(
        F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("g")
    )
    dirs = placed.groupBy("_dir").agg(F.count(F.lit(1)).alias("n")).where(F.col("_dir").isNotNull())
    chains = dirs.select("_dir", F.explode(ancestors(F.col("_dir"))).alias("a"))
    reached = chains.select("_dir", F.col("a.depth").alias("depth"), F.col("a.name").alias("_above")).join(grants, "_above")
    nearest = reached.groupBy("_dir").agg(F.max(F.struct("depth", "_above", F.col("g.license").alias("license"))).alias("near"))
    joined = placed.join(nearest, "_dir", "left")
    own = F.col("license").isNotNull()
    return joined.select(
        "_id",
        "_path",
        F.when(own, F.col("license")).otherwise(F.col("near.license")).alias("license"),
        F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(~own, F.col("near._above")).alias("inherited_from"),
        "cosine",
    )


def scan(
    docs: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_cosine: float = MIN_COSINE,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """``doc_id, path, license, origin, inherited_from, cosine`` for each row of ``docs``, from its whole text.

    ``origin`` is ``file`` for a license file (license lines hold ``file_share`` of its words, or its name begins with
    license, licence, copying or unlicense), ``header`` for another file with a notice of its own, ``directory`` for one
    that inherits, with that directory in ``inherited_from``, else ``none`` with a null license. ``cosine`` is that of the
    file's surest notice to its best template, null without a notice. A null text is empty; a null path inherits nothing. Rows
    that repeat an id, or have none, each have their row; no rows give no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("_id"), path.alias("_path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")
    )
    # Several steps read the headers; the texts are read once.
    found = written(headers(narrow, file_share), "license-headers")
    sought = F.nullif(F.concat_ws("\n\n", "_header", "_whole"), F.lit(""))
    found = found.withColumn("_header", sought)
    matched = match_templates(found, templates(spark))
    # Files without a notice, most of a corpus, meet nothing; a key of their own each keeps them out of one task.
    meet = F.coalesce(F.col("_header"), F.concat(F.lit("\x00"), F.coalesce(F.col("_id").cast("string"), F.col("_path"), F.lit(""))))
    matched = matched.withColumnRenamed("_header", "_meet")
    files = found.withColumn("_meet", meet).join(matched, "_meet", "left")
    sure = F.col("cosine") >= min_cosine
    files = files.select(
        "_id",
        "_path",
        F.when(sure, F.col("license")).alias("license"),
        "cosine",
        (F.col("_named") | (F.coalesce("_share", F.lit(0.0)) >= file_share)).alias("is_file"),
    )
    return inherit(files).select(F.col("_id").alias("doc_id"), F.col("_path").alias("path"), "license", "origin", "inherited_from", "cosine")
