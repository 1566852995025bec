"""Licence scan by canonical digests: whole texts, and whole lines, against known licence texts.

Texts are brought to one form (case, spelling, copyright lines, punctuation, white space), digested,
and hash-joined with the digests of the known texts in the same form. Only DataFrame functions.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def package_texts() -> list[tuple[str, str]]:
    """The texts of ``license_texts``: files named by SPDX id, and by what they hold after a plus sign."""
    files = sorted(resources.files("opinaria.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt").split("+")[0], f.read_text("utf-8")) for f in files if f.name.endswith(".txt")]


# Published licence texts and notices, under their SPDX ids.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so")
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.")
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE.")
KNOWN = (
    ("MIT", "MIT License\n\n" + _GRANT + ", subject to the following conditions:\n\nThe above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("MIT", _GRANT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice "
     "shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("MIT-0", "MIT No Attribution\n\n" + _GRANT + ".\n\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
     + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted.\n\n" + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/"
     "LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License "
     "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
     "the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    *package_texts(),
)
# Spellings that licence matching guidelines treat as equal, applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("http", "https"), ("version", "v"),
    ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
)
# A whole line that states a copyright: the word and then a year, a sign or a name in brackets, or a sign and a year. A line
# that merely begins with the word, as wrapped licence texts have them, stays.
COPYRIGHT_LINE = (
    r"^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|[0-9]{4}|[<\[{])[^\n]*|\(c\) *[0-9]{4}[^\n]*|©[^\n]*"
    r"|all rights reserved[^a-z0-9\n]*)$"
)


def _parted(words: str) -> str:
    return words.replace(" ", "  ")


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words of a-z and 0-9, equal spellings as one.

    Words are parted by two spaces, one for each, so that neighbours of one spelling are both replaced.
    """
    plain = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, " ")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(f" {_parted(a)} "), F.lit(f" {_parted(b)} "))
    return F.trim(words)


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): one row for each known form; its size is that of the list given."""
    rows = spark.createDataFrame(list(known), "license string, body string")
    return rows.groupBy(digest(F.col("body")).alias("digest")).agg(F.min("license").alias("license"))


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, line, body): the entire text as line 0, then its lines from 1."""
    text = F.col(text_col).cast("string")
    lines = F.transform(F.split(text, "\n"), lambda body, i: F.struct((i + 1).alias("line"), body.alias("body")))
    whole = F.array(F.struct(F.lit(0).alias("line"), text.alias("body")))
    return docs.select(F.col(id_col).alias("_id"), F.inline(F.concat(whole, lines)))


def scan(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license): each text (line 0) and each line (from 1) that is a known licence text.

    Null, empty and blank texts match nothing. A row is given for every match of every row, so rows
    that repeat an id repeat their matches; ids may be null; other columns do not matter; an empty
    table gives an empty table. The known digests are as many as the list given, and so are broadcast.
    """
    known_rows = F.broadcast(known_digests(docs.sparkSession, known))
    found = units(docs, id_col, text_col).withColumn("digest", digest(F.col("body"))).join(known_rows, "digest")
    return found.select(F.col("_id").alias("doc_id"), "line", "license")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Of the SQL alone: the same rules said once more, line by line and as patterns over words, so that a wrong
# rule above shows as a difference.
_SQL_NOTICE = (
    r"^[^a-z0-9]*copyright[^a-z0-9]*(\(c\)|©|[0-9][0-9][0-9][0-9]|<|\[|\{)", r"^[^a-z0-9]*\(c\) *[0-9][0-9][0-9][0-9]",
    "^[^a-z0-9]*©", "^[^a-z0-9]*all rights reserved[^a-z0-9]*$")
_SQL_WORDS = (
    ("licence(d?)", "license\\1"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"), ("http", "https"), ("version", "v"), ("organisation", "organization"),
    ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"),
    ("copyright owner(s?)", "copyright holder\\1"),
)


def _sql_canonical(text: str) -> str:
    tests = " OR ".join(f"regexp_matches(x, {_sql_text(p)})" for p in _SQL_NOTICE)
    lines = f"[x FOR x IN string_split(lower({text}), chr(10)) IF NOT ({tests})]"
    words = f"trim(regexp_replace(array_to_string({lines}, ' '), '[^a-z0-9]+', ' ', 'g'))"
    for a, b in _SQL_WORDS:
        words = f"regexp_replace({words}, {_sql_text(chr(92) + 'b' + a + chr(92) + 'b')}, {_sql_text(b)}, 'g')"
    return words


def oracle_sql() -> str:
    values = ", ".join(f"({_sql_text(name)}, {_sql_text(body)})" for name, body in KNOWN)
    return f"""WITH known AS (SELECT {_sql_canonical('body')} AS form, min(license) AS license
            FROM (VALUES {values}) v(license, body) GROUP BY 1),
        units AS (SELECT doc_id, 0 AS line, text AS body FROM documents UNION ALL
            SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line,
                unnest(string_split(text, chr(10))) AS body FROM documents)
        SELECT doc_id, line, license FROM (SELECT doc_id, line, {_sql_canonical('body')} AS form FROM units) u
        JOIN known USING (form)"""
