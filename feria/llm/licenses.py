"""Operator 6: documents that are a known licence, by the digest of their canonical text.

A text is made canonical by lower-casing, dropping copyright notices, joining equivalent spellings and turning every run
of other characters than letters and digits into one blank; its SHA-256 is looked up among those of the known texts by
a hash join. The same lookup is made for each line that may be a known one-line notice, so notices inside other texts are
found.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common

#: Spellings that licence matching treats as the same word, after lower-casing.
EQUIVALENTS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("acknowledgment", "acknowledgement"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https:", "http:"),
    ("&", " and "),
]
#: What a line that is a copyright notice begins with, whatever comment signs stand before it.
_LEAD, _WORD, _SIGN = r"[^a-z0-9\n(©]*(?:(?:portions|parts)[ \t]+(?:are[ \t]+)?)?", r"copyright(?:ed)?", r"(?:\(c\)|©)"
OTHER_CHARS = r"[^\p{L}\p{N}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known texts: licence id, text. Full texts and the usual one-line notices.
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_2 + _BSD_END),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_2 + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_NAME + _BSD_END),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]
#: Known texts that a table may hold; beyond this it is no list of licences.
MOST_KNOWN = 100_000


def own_starts(known: list[tuple[str, str]] | None = None) -> tuple[list[str], list[str]]:
    """The words that follow "copyright", and those that follow "(c)", within known texts, two at a time in all equivalent
    spellings: a line that begins so continues a licence's own sentence, however it is wrapped, and is no notice."""
    found: tuple[set, set] = (set(), set())
    for _, t in known or KNOWN:
        low = t.lower()
        for a, b in (("", ""), *EQUIVALENTS, *((b, a) for a, b in EQUIVALENTS if a != "&")):
            spelled = low.replace(a, b) if a else low
            for pairs, sign in zip(found, (_WORD, _SIGN)):
                pairs.update(re.findall(rf"{sign}[^a-z0-9(©]+([a-z]+)[^a-z0-9]+([a-z0-9]+)", spelled))
    return tuple(sorted(rf"{a}(?:[^a-z0-9\n]+{b}(?:[^a-z0-9]|$)|[^a-z0-9\n]*(?:\n|$))" for a, b in pairs) for pairs in found)


def notice_line(known: list[tuple[str, str]] | None = None) -> str:
    """A pattern of lines that are copyright notices: a mark and what is no run of a known text, or the reservation of
    rights alone."""
    word, sign = own_starts(known)
    unless = lambda starts: rf"(?![^a-z0-9\n]*(?:{'|'.join(starts)}))" if starts else ""
    return rf"(?:^|\n){_LEAD}(?:{_WORD}{unless(word)}(?=[ \t]*(?:[(©:,]|[0-9]|$|\n)|[ \t]+\S)[^\n]*|{_SIGN}{unless(sign)}[^\n]*|all rights reserved[^a-z0-9\n]*(?=\n|$))"


def canonical(text: Column, notices: str | None = None) -> Column:
    """The canonical form of texts; `notices` is the `notice_line` of the known list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(low.rlike(r"copyright|\(c\)|©|all rights reserved"), F.regexp_replace(low, notices or notice_line(), "\n")).otherwise(low)
    low = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENTS, low)
    return F.trim(F.regexp_replace(low, OTHER_CHARS, " "))


def known_from_files(spark: SparkSession, folder: str, most: int = MOST_KNOWN) -> list[tuple[str, str]]:
    """License and text of each file of a folder: the file's name without its ending is the licence's id. Empty files are
    texts too, which no document equals; a folder of more files than `most` is no list of licences and an error."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    rows = spark.read.text(folder, wholetext=True).select(F.url_decode(name).alias("license"), F.col("value").alias("known"))
    got = [tuple(r) for r in rows.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{folder} has more than {most} files")
    return got


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, digest and line (whether the known text is a single line) of each known text (no list: the built-in one);
    two licences may not share a canonical text. Equal entries count once; an empty text has the empty text's digest."""
    rows = spark.createDataFrame(known or KNOWN, "license string, known string")
    return rows.select("license", F.sha2(canonical(F.col("known"), notice_line(known)), 256).alias("digest"), (~F.col("known").rlike(r"\S\s*\n\s*\S")).alias("line")).distinct()


def marks(known: list[tuple[str, str]] | None = None) -> str:
    """A pattern that every line equal to a known one-line notice has: of their words of four letters or more the fewest
    that are in all of them, with every spelling that becomes the word."""
    lines = [set(re.findall("[a-z]{4,}", t.lower())) or {""} for _, t in known or KNOWN if "\n" not in t.strip()]
    for a, b in EQUIVALENTS:
        lines = [{w.replace(a, b) for w in words} for words in lines]
    chosen: list[str] = []
    while lines:
        best = max(sorted(set().union(*lines)), key=lambda w: sum(any(w in x for x in words) for words in lines))
        chosen.append(best)
        lines = [words for words in lines if not any(best in x for x in words)]
    out = []
    for w in chosen:
        pattern = re.escape(w)
        for a, b in EQUIVALENTS:
            if b.strip() in w:
                pattern = pattern.replace(re.escape(b), f"(?:{re.escape(a)}|{re.escape(b)})")
        out.append(pattern)
    return "|".join(out) or r"\b\B"


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, license (of the entire text, else null) and notices (licences of single lines, sorted, distinct).

    `known` has licence and text of each known text, the built-in ones if none are given; which lines are looked up and
    which are copyright notices follows from it. Null counts as empty; a text without letters or digits has no licence,
    equal rows get equal results, texts and lines of any length are read whole, an empty table gives no rows, and other
    columns are not read. The known table is a list of licences; Spark joins it by its size.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    notice, marked, known = notice_line(known), marks(known), known_digests(docs.sparkSession, known)
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda s: F.lower(s).rlike(marked)), lambda s: F.sha2(canonical(s, notice), 256)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.sha2(canonical(text, notice), 256).alias("digest"), lines.alias("lines"))
    rows = common.written(rows, "licence-digests")
    found = rows.select("row", F.explode("lines").alias("digest")).join(known.where("line"), "digest").groupBy("row").agg(F.sort_array(F.collect_set("license")).alias("notices"))
    whole = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).select("digest", "license").distinct()
    got = rows.join(whole, "digest", "left").join(found, "row", "left")
    return got.select("id", "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: licences of `documents`."""
    got = scan(common.load(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("digest").alias("canonical_sha256"), "license", F.array_join("notices", ",").alias("notices"))


def _sql(text: str) -> str:
    """`canonical` as SQL: lines are judged one by one, by what they begin with."""
    lead = "^" + _LEAD.replace("\\n", "")
    word, sign = (rf"{lead}{mark}[^a-z0-9]*({'|'.join(starts)})" for mark, starts in zip((_WORD, _SIGN), own_starts()) if starts or True)
    mark = rf"(regexp_matches(l, '{lead}{_WORD}([ \t]*([(©:,0-9]|$)|[ \t]+[^\s])') AND NOT regexp_matches(l, '{word}'))"
    signed = rf"regexp_matches(l, '{lead}{_SIGN}')" + (rf" AND NOT regexp_matches(l, '{sign}')" if own_starts()[1] else "")
    notice = rf"({mark} OR ({signed}) OR regexp_matches(l, '{lead}all rights reserved[^a-z0-9]*$'))"
    low = f"lower(coalesce({text}, ''))"
    low = f"array_to_string(list_filter(string_split({low}, chr(10)), lambda l: NOT {notice}), chr(10))"
    for a, b in EQUIVALENTS:
        low = f"replace({low}, '{a}', '{b}')"
    return f"trim(regexp_replace({low}, '{OTHER_CHARS}', ' ', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH known AS (SELECT DISTINCT license, sha256({_sql('t')}) AS digest, NOT regexp_matches(t, '\\S\\s*\\n\\s*\\S') AS line FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN)}) AS k(license, t)),
lines AS (
  SELECT DISTINCT doc_id, sha256({_sql('line')}) AS digest
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(lower(line), 'licen[cs]e')),
notices AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known USING (digest) WHERE line GROUP BY doc_id),
d AS (SELECT doc_id, sha256({_sql('text')}) AS digest FROM documents)
SELECT d.doc_id, d.digest AS canonical_sha256, k.license, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN (SELECT DISTINCT digest, license FROM known) k ON d.digest = k.digest AND d.digest <> sha256('') LEFT JOIN notices n ON n.doc_id = d.doc_id
"""
