"""Licences of files by TF-IDF cosine to templates, and of their neighbours by directory.

A passage of a file (a line, or a sentence that may run over lines and comment marks) is a sparse vector over the terms of the
templates, weighted by how rare a term is in the whole corpus; every word beyond these terms weighs as the rarest term
would. A file whose best passage is close to a template has a licence header. A file that is close to a template as
a whole, and so holds little else, is a licence file; of long licences only the opening is a template, and a file is
one if it has nearly all of that and about as many words as the licence. Files without a header take the licence of the
nearest directory above them that holds a licence file.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.common import stored, text_or_empty, words

# Notices by which files name their licence, and the public texts of the licences.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
WHOLE: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
     "above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
     "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
     "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
     "THE SOFTWARE."),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
     "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
     "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
     "SOFTWARE."),
)
#: Openings of long licences, and about how many words the whole of each has.
OPENINGS: tuple[tuple[str, str, int], ...] = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
     "REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, "
     "and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or "
     "entity authorized by the copyright owner that is granting the License.", 1_600),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright Free Software Foundation, Inc. Everyone is "
     "permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble "
     "The GNU General Public License is a free, copyleft license for software and other kinds of works.", 5_700),
)


@dataclass(frozen=True)
class Template:
    """A text that names a licence; `words` is the length of the whole licence if the text is its opening only."""

    license: str
    text: str
    words: int | None = None


TEMPLATES = tuple(Template(*t) for t in (*NOTICES, *WHOLE, *OPENINGS))
#: Cosine from which a passage is a header, and from which a whole file is a licence file; the part of an opening (of its
#: squared length) that a long licence file has, and how far its words may be from those of the licence.
HEADER, FILE, OPENING, ABOUT = 0.8, 0.8, 0.9, 0.25
#: Where passages end: at line ends and behind sentence ends. Comment marks in front of a line are no part of it, and a blank
#: line ends what its lines say together.
PASSAGES = r"\n|(?<=[.!?])\s+"
SENTENCES = r"(?<=[.!?])\s+"
MARKS = r"(^|\n)[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)?[ \t]*"
BLANK = r"\n\s*\n"


def passages_of(text: Column) -> Column:
    """The lines and sentences of a text, and the sentences that run over several lines of a paragraph, each once."""
    paragraphs = F.split(F.regexp_replace(text, MARKS, "$1"), BLANK)
    joined = F.flatten(F.transform(paragraphs, lambda p: F.split(F.translate(p, "\n", " "), SENTENCES)))
    return F.array_distinct(F.concat(F.split(text, PASSAGES), joined))


def template_terms(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(template, license, term, tf) of the templates, whose number does not depend on the data."""
    rows = [(i, t.license, t.text) for i, t in enumerate(templates)]
    table = docs.sparkSession.createDataFrame(rows, "template int, license string, text string")
    cut = table.select("template", "license", F.explode(words(F.col("text"))).alias("term"))
    return cut.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def _weights(docs: DataFrame, terms: list[str], text: Column) -> tuple[dict[str, float], float]:
    """The inverse document frequency of every term over all texts, and that of a term which no text has."""
    present = F.array_intersect(words(text), F.array(*[F.lit(t) for t in terms]))
    # the number of texts rides along as a term that is no word
    found = docs.select(F.explode(F.array_append(present, F.lit(""))).alias("term")).groupBy("term").count()
    count = {r["term"]: r["count"] for r in found.collect()}
    n = count.get("", 0)
    return {t: 1 + math.log((n + 1) / (count.get(t, 0) + 1)) for t in terms}, 1 + math.log(n + 1)


def _damped(tf: Column) -> Column:
    return 1 + F.log(tf.cast("double"))


def cosines(passages: DataFrame, key: list[str], vectors: DataFrame, idf: dict[str, float], rarest: float) -> DataFrame:
    """(key, template, license, cosine, part) of passages (key, w) with every template they share a term with; `part` is
    how much of the template's squared length they have."""
    table = passages.sparkSession.createDataFrame(sorted(idf.items()), "term string, idf double")
    table = F.broadcast(table)
    tf = passages.select(*key, F.explode("w").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(table, "term", "left").withColumn("weight", _damped(F.col("tf")) * F.coalesce("idf", F.lit(rarest)))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*key)))
    shared = weighed.withColumn("norm", norm).filter("idf is not null").join(F.broadcast(vectors), "term")
    dot = F.sum(F.col("weight") * F.col("unit")) / F.first("norm")
    part = F.sum(F.col("unit") * F.col("unit"))
    return shared.groupBy(*key, "template", "license").agg(dot.alias("cosine"), part.alias("part"))


def _fewest(unit: dict[str, float], least: float) -> int:
    """A text with fewer of a template's terms has less of its squared length, whichever they are."""
    squares = sorted((u * u for u in unit.values()), reverse=True)
    held, n = 0.0, 0
    while n < len(squares) and held < least * least - 1e-9:
        held, n = held + squares[n], n + 1
    return n


def _reachable(terms: Column, vectors: dict[int, dict[str, float]], least: float) -> Column:
    """Whether a text with these distinct terms can have a passage of this cosine: with the terms S in common,
    the cosine to a template of unit length is at most the length of its part over S."""

    def reaches(have: Column) -> Column:
        found = F.lit(False)
        for unit in vectors.values():
            # how many terms there are is cheap to see, and few texts have enough of them
            enough = F.size(F.array_intersect(have, F.array(*[F.lit(t) for t in unit]))) >= _fewest(unit, least)
            parts = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(u * u).alias("part")) for t, u in unit.items()])
            held = F.aggregate(
                parts, F.lit(0.0), lambda part, x: part + F.when(F.array_contains(have, x["term"]), x["part"]).otherwise(0.0)
            )
            found = found | F.when(enough, held >= least * least - 1e-9).otherwise(False)
        return found

    # the lambda of a one-element array names the terms, which are then computed once and not per template term
    return F.get(F.transform(F.array(terms), reaches), F.lit(0))


def license_scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                 header: float = HEADER, whole: float = FILE) -> DataFrame:
    """One row per input row: doc_id, path, license, origin (header, file, inherited or none), cosine, from_path.

    Of several passages the one with the highest cosine counts, then the first licence by name; the cosine of a long licence
    file is the part of the opening that it has. A licence file gives its
    licence to all files in its directory and below that have no header and no nearer licence file; of several
    in a directory the closest to its template counts, then the smallest path. A null text is empty; a null path is
    in no directory, so it neither gives nor inherits. Repeated rows have repeated results.
    """
    text = text_or_empty(F.col(text_col))
    terms = template_terms(files, templates)
    listed = terms.collect()
    vocabulary = sorted({r["term"] for r in listed})
    idf, rarest = _weights(files, vocabulary, text)
    raw: dict[int, dict[str, float]] = {}
    license_of = {r["template"]: r["license"] for r in listed}
    for r in listed:
        raw.setdefault(r["template"], {})[r["term"]] = (1 + math.log(r["tf"])) * idf[r["term"]]
    length = {i: math.sqrt(sum(v * v for v in w.values())) for i, w in raw.items()}
    units = {i: {t: v / length[i] for t, v in w.items()} for i, w in raw.items()}
    vectors = files.sparkSession.createDataFrame(
        [(i, license_of[i], t, u) for i, w in units.items() for t, u in w.items()],
        "template int, license string, term string, unit double",
    )
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), path.alias("path"),
                        text.alias("text"))
    present = F.array_intersect(words(F.col("text")), F.array(*[F.lit(t) for t in vocabulary]))
    likely = _reachable(present, units, min(header, whole))
    # only passages of texts that can reach a template leave the scan
    kept = F.when(likely, F.struct(
        F.filter(F.transform(passages_of(F.col("text")), words), lambda w: F.size(w) > 0).alias("passages"),
        words(F.col("text")).alias("words"),
    ))
    scanned = stored(rows.select("row", "doc_id", "path", kept.alias("k")), "license-passages")
    scanned = scanned.select("row", "doc_id", "path", "k.passages", "k.words")
    passages = scanned.filter("passages is not null").select("row", F.posexplode("passages").alias("at", "w"))
    passages = passages.filter(_reachable(F.array_distinct("w"), units, header))
    own = cosines(passages, ["row", "at"], vectors, idf, rarest).filter(F.col("cosine") >= header)
    own = own.groupBy("row").agg(_closest().alias("h"))
    full = scanned.filter("words is not null").select("row", F.size("words").alias("n_words"), F.col("words").alias("w"))
    full = full.filter(_reachable(F.array_distinct("w"), units, whole))
    as_file = cosines(full, ["row", "n_words"], vectors, idf, rarest)
    long = {i: t.words for i, t in enumerate(templates) if t.words}
    measure, about = F.col("cosine"), F.lit(True)
    for i, n in long.items():
        measure = F.when(F.col("template") == i, F.col("part")).otherwise(measure)
        about = F.when(F.col("template") == i, F.col("n_words").between((1 - ABOUT) * n, (1 + ABOUT) * n)).otherwise(about)
    least = F.when(F.col("template").isin(list(long)), OPENING).otherwise(whole) if long else F.lit(whole)
    as_file = as_file.withColumn("cosine", measure).filter((F.col("cosine") >= least) & about)
    as_file = as_file.groupBy("row").agg(_closest().alias("f"))
    judged = stored(
        scanned.select("row", "doc_id", "path").join(own, "row", "left").join(as_file, "row", "left"), "license-own"
    )
    return _inherit(judged)


def _closest() -> Column:
    """The licence of the highest cosine, the first by name among equals."""
    return F.min(F.struct((-F.round("cosine", 9)).alias("order"), F.col("license").alias("license")))


def directories(path: Column) -> Column:
    """All directories above a path, with their depth; the root is ''."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")),
    )


def _inherit(judged: DataFrame) -> DataFrame:
    """Nearest-ancestor inheritance: join the distinct directories to the licence files in them and above."""
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    placed = judged.withColumn("dir", F.when(F.col("path").isNotNull(), parent))
    givers = placed.filter("f is not null and dir is not null").groupBy("dir").agg(
        F.min(F.struct("f.order", "path", "f.license")).alias("g")
    )
    givers = stored(givers, "license-directories")
    places = stored(placed.filter("dir is not null").select("dir").distinct(), "directories")
    above = places.select("dir", F.inline(directories(F.concat("dir", F.lit("/")))).alias("depth", "up"))
    nearest = above.join(givers.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.max(F.struct("depth", "g")).alias("n")
    )
    nearest = stored(nearest.select("dir", F.col("n.g.license").alias("given"), F.col("n.g.path").alias("from_path"),
                                    (-F.col("n.g.order")).alias("given_cosine")), "nearest-license")
    found = placed.join(nearest, "dir", "left")
    mine = F.coalesce("h", "f")
    origin = F.when(F.col("f").isNotNull(), "file").when(F.col("h").isNotNull(), "header")
    origin = origin.when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return found.select(
        "doc_id",
        "path",
        F.coalesce(mine["license"], "given").alias("license"),
        origin.alias("origin"),
        F.round(F.coalesce(-mine["order"], "given_cosine"), 6).alias("cosine"),
        F.when(mine.isNull(), F.col("from_path")).alias("from_path"),
    )
