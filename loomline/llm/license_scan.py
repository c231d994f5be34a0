"""Known licences by canonical digest lookup: texts are normalised, digested and hash-joined. DataFrame functions only."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import written

#: Known tables of up to this many rows are broadcast.
BROADCAST_ROWS = 50_000

#: Licence names and the ways a notice spells them.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
}
#: The sentences that state a licence.
PHRASES = ["Released under {}", "Licensed under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is released under {}"]
#: Whole licence texts.
TEXTS = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """zlib License

(C) <year> <name of author>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Further whole texts are the files of the folder licenses; they are often given without what follows this line.
FILES = ["Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"]
END = "END OF TERMS AND CONDITIONS"
#: Fixed value: the clause that BSD-3-Clause has and BSD-2-Clause has not.
ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: Equivalent spellings, after case folding.
SPELLINGS = [
    ("licenc", "licens"),
    ("sub-licens", "sublicens"),
    ("non-commercial", "noncommercial"),
    ("non-infring", "noninfring"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("https:", "http:"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names a holder or year; a sentence that speaks of a copyright notice is none.
_COPYRIGHT = r"(^|\n)[ \t*#/;>-]*(?:copyright[ \t]*(?:\(c\)|©|:)?[ \t]*[0-9<\[{]|\(c\)[ \t]*[0-9<\[{]|©)[^\n]*"
#: ASCII characters other than letters, digits and the line end, and typographic quotes and dashes.
_PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}]+"


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, its lines kept apart and not trimmed."""
    out = F.translate(text, _UPPER, _LOWER)
    out = F.regexp_replace(out, _COPYRIGHT, "$1")
    for spelling, common in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(common))
    return F.regexp_replace(out, _PUNCTUATION, " ")


def whole(lines: Column) -> Column:
    """Canonical lines as one text."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def whole_texts() -> list[tuple[str, str]]:
    """Name and text of all licences whose whole text is known; a name can have several."""
    out = list(TEXTS.items())
    for name in FILES:
        text = files(__package__).joinpath("licenses", f"{name}.txt").read_text(encoding="utf-8")
        out.append((name, text))
        if END in text:
            out.append((name, text[: text.index(END) + len(END)]))
    out.append(("BSD-3-Clause", TEXTS["BSD-2-Clause"].replace("BSD 2-Clause", "BSD 3-Clause").replace("\n\nTHIS SOFTWARE", f"\n\n{ENDORSEMENT}\n\nTHIS SOFTWARE")))
    return out


def known(spark: SparkSession) -> DataFrame:
    """license, kind (text or notice), digest and chars of the known licences; ties go to the smallest name."""
    rows = [("text", name, text) for name, text in whole_texts()]
    rows += [("notice", name, phrase.format(the + spelling)) for name, ways in NAMES.items() for spelling in ways for phrase in PHRASES for the in ("", "the ")]
    table = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("license"), F.lit(t).alias("text")) for k, n, t in rows])))
    form = table.withColumn("form", whole(canonical_lines(F.col("text")))).withColumn("chars", F.length("form"))
    return form.groupBy("kind", F.sha2("form", 256).alias("digest"), "chars").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """doc_id, digest, license, notices, n_notices of every document.

    ``digest`` is the SHA-256 of the whole canonical text and ``license`` the
    known text with this digest, else null. ``notices`` names, sorted and joined
    by commas, the known licences of which a notice is a whole line of the
    document; null without one. A null text is empty. Canonical form: A-Z
    lower-cased, copyright lines out, equivalent spellings made one, punctuation
    and runs of white space made one space. All follows from the canonical text,
    so equal documents are looked up once; lines whose length no known notice
    has are not digested. Of known texts with one digest the smallest name counts.
    An empty table gives no rows; repeated rows give repeated results; whole
    texts are read, however long; other columns are not read.
    """
    spark = docs.sparkSession
    licenses = licenses.groupBy("kind", "digest").agg(F.min("license").alias("license"), F.min("chars").alias("chars"))
    shape = licenses.agg(F.collect_set(F.when(F.col("kind") == "notice", F.col("chars"))).alias("notice"), F.collect_set(F.when(F.col("kind") == "text", F.col("chars"))).alias("text"), F.count(F.lit(1)).alias("n")).first()
    licenses = F.broadcast(licenses) if shape["n"] <= BROADCAST_ROWS else licenses
    lengths = lambda x: F.array(*[F.lit(i) for i in sorted(x)]).cast("array<int>")
    lines = F.array_distinct(F.transform(F.split("_lines", "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))))
    rows = docs.select("doc_id", canonical_lines(F.coalesce(F.col("text"), F.lit(""))).alias("_lines")).select("doc_id", whole(F.col("_lines")).alias("_form"), lines.alias("_each"))
    rows = written(
        rows.select(
            "doc_id",
            F.sha2("_form", 256).alias("digest"),
            F.array_contains(lengths(shape["text"]), F.length("_form")).alias("_long") if shape["text"] else F.lit(False).alias("_long"),
            F.transform(F.filter("_each", lambda x: F.array_contains(lengths(shape["notice"]), F.length(x))), lambda x: F.sha2(x, 256)).alias("_units"),
        ),
        "license-units",
    )
    units = rows.where("size(_units) > 0").groupBy("digest").agg(F.first("_units").alias("_units")).select("digest", F.explode("_units").alias("unit"))
    notices = units.join(licenses.where("kind = 'notice'").select(F.col("digest").alias("unit"), "license"), "unit")
    notices = notices.groupBy("digest").agg(F.sort_array(F.collect_set("license")).alias("found")).select("digest", F.array_join("found", ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))
    texts = rows.where("_long").select("digest").distinct().join(licenses.where("kind = 'text'").select("digest", "license"), "digest")
    found = rows.select("doc_id", "digest").join(texts, "digest", "left").join(notices, "digest", "left")
    return found.select("doc_id", "digest", "license", "notices", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same in DuckDB SQL, with plain joins on canonical texts instead of digests."""

    def lines(x: str) -> str:
        out = f"translate({x}, '{_UPPER}', '{_LOWER}')"
        out = f"regexp_replace({out}, {_sql_text(_COPYRIGHT)}, '\\1', 'g')"
        for spelling, common in SPELLINGS:
            out = f"replace({out}, '{spelling}', '{common}')"
        return f"regexp_replace({out}, '{_PUNCTUATION}', ' ', 'g')"

    whole_ = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'), ' ')"
    texts = ", ".join(f"('{n}', {_sql_text(t)})" for n, t in whole_texts())
    notices = ", ".join(f"('{n}', {_sql_text(p.format(the + s))})" for n, ways in NAMES.items() for s in ways for p in PHRASES for the in ("", "the "))
    return f"""
WITH t AS (SELECT min(license) AS license, {whole_(lines('x'))} AS form FROM (VALUES {texts}) AS v(license, x) GROUP BY form),
k AS (SELECT min(license) AS license, {whole_(lines('x'))} AS form FROM (VALUES {notices}) AS v(license, x) GROUP BY form),
d AS (SELECT row_number() OVER () AS u, doc_id, {lines("coalesce(text, '')")} AS ls FROM documents),
f AS (SELECT u, doc_id, {whole_('ls')} AS form FROM d),
l AS (SELECT DISTINCT u, trim(regexp_replace(unnest(string_split(ls, chr(10))), ' +', ' ', 'g'), ' ') AS line FROM d),
n AS (SELECT u, string_agg(license, ',' ORDER BY license) AS notices, count(*) AS n FROM (SELECT DISTINCT u, license FROM l JOIN k ON l.line = k.form) GROUP BY u)
SELECT f.doc_id, sha256(f.form) AS digest, t.license, n.notices, coalesce(n.n, 0)::BIGINT AS n_notices
FROM f LEFT JOIN t ON f.form = t.form LEFT JOIN n USING (u)
"""
