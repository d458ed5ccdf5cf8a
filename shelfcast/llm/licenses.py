"""Licence scan by digests of canonical texts, in DataFrame functions only.

A text is made canonical: lines that only state a copyright go, case and punctuation go, and words
of equivalent spelling become one. The SHA-256 of what is left is joined to digests of known licence
texts. A document is looked up as a whole, and so is each of its lines, since notices of one line
("Released under the MIT License.") stand among other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.runtime import durable
from .common import table

# Licence texts as published.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies"""
ISC_WARRANTY = """.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC_GRANT + ISC_NOTICE + ISC_WARRANTY), ("ISC", "ISC License\n\n" + ISC_GRANT + ISC_NOTICE + ISC_WARRANTY),
    ("0BSD", ISC_GRANT + ISC_WARRANTY), ("0BSD", "BSD Zero Clause License\n\n" + ISC_GRANT + ISC_WARRANTY),
    ("BSD-2-Clause", BSD_GRANT + BSD_WARRANTY), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_GRANT + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_GRANT + BSD_NAMES + BSD_WARRANTY), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_GRANT + BSD_NAMES + BSD_WARRANTY),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB), ("Apache-2.0", APACHE_HEADER),
]
# Names by which notices call a licence, and how notices begin.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
OPENINGS = [
    "Licensed under", "Licensed under the", "Released under", "Released under the", "This work is licensed under", "This work is licensed under the",
    "This work is licensed under a", "This project is licensed under the", "Distributed under the terms of the", "SPDX-License-Identifier:",
]
# Equivalent spellings, the second one stands for both.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("favour", "favor"), ("organisation", "organization"), ("organisations", "organizations"), ("recognise", "recognize"), ("whilst", "while"),
    ("wilful", "willful"), ("per cent", "percent"), ("programme", "program"), ("judgement", "judgment"), ("https", "http"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only states a copyright, once in lower case and after marks of comments.
COPYRIGHT = r"^[^a-z0-9©(]*(copyright (\(c\)|©|[0-9])|copyright:|\(c\) [^a-z]*[0-9][0-9][0-9][0-9]|©|all rights reserved)"
#: All ASCII that is no letter or digit, and signs of typesetting.
SIGNS = r"[\x00-/:-`{-\x7F‐-”…]+"


def known() -> list[tuple[str, str]]:
    """(licence, text) of whole texts and of notices."""
    return TEXTS + [(spdx, f"{opening} {name}") for spdx, names in NAMES.items() for name in names for opening in OPENINGS]


def canonical_line(low: Column) -> Column:
    """Words only, equivalent spellings made one; empty for a line that states a copyright. For a line in lower case."""
    # two spaces between words, so that neighbouring words can both be replaced
    out = F.concat(F.lit(" "), F.replace(F.regexp_replace(low, SIGNS, " "), F.lit(" "), F.lit("  ")), F.lit(" "))
    for other, one in SPELLINGS:
        spaced = lambda s: F.lit(f" {s} ".replace(" ", "  ")[1:-1])
        out = F.replace(out, spaced(other), spaced(one))
    return F.when(low.rlike(COPYRIGHT), "").otherwise(F.trim(F.regexp_replace(out, " +", " ")))


def canonical_lines(text: Column) -> Column:
    """Lines that are left, made canonical. Only A-Z get lower case; lower() is the quicker way if there is nothing else."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.transform(F.split(low, "\n"), canonical_line), lambda x: x != "")


def from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) of a folder that Spark reads, a licence per file, named by the file without its ending .txt."""
    files = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    return files.select(F.url_decode(name).alias("license"), F.col("value").alias("text"))


def digests(texts: DataFrame) -> DataFrame:
    """(digest, license) of known texts; a text that two licences share counts for the first by name."""
    return texts.groupBy(F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 10_000) -> DataFrame:
    """doc_id, text_digest, license, notices, n_notices: one row per document.

    text_digest is that of the whole canonical text, license the known licence whose text it is (else
    null). notices are the licences whose digest some line has, sorted, with commas between them
    (empty: none), and n_notices the number of such lines. A null text is empty. ``texts`` are the
    known ones, a list or a frame (license, text). Up to ``most`` of them, their hashes sort out the
    lines that are looked up; with more, every line is. Documents are not shuffled but for the join of
    digests.
    """
    spark = docs.sparkSession
    texts = texts if isinstance(texts, DataFrame) else spark.createDataFrame(texts, "license string, text string")
    listed = durable(digests(texts))
    hashes = texts.select(F.xxhash64(F.array_join(canonical_lines(F.col("text")), " ")).alias("h")).distinct().limit(most + 1).collect()
    quick = [r["h"] for r in hashes] if len(hashes) <= most else None
    known_line = lambda x: F.xxhash64(x["line"]).isin(quick) if quick is not None else F.lit(True)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("hash"), canonical_lines(body).alias("lines"))
    # stored, so that every text is made canonical once
    rows = durable(lines.select(
        "doc_id", "hash", F.sha2(F.array_join("lines", " "), 256).alias("text_digest"),
        F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("place"), x.alias("line"))), known_line).alias("found"),
    ))
    asked = rows.select("doc_id", "hash", F.inline("found")).select("doc_id", "hash", "place", F.sha2("line", 256).alias("digest"))
    # places, for repeated rows are counted together
    found = (
        asked.join(listed, "digest").groupBy("doc_id", "hash", "license", "place").agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "hash").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("*").alias("n"))
        .select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "notices", "n")
    )
    whole = rows.drop("found").join(listed.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    joined = whole.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    return joined.select("doc_id", "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).alias("n_notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known())


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"translate(x, '{UPPER}', '{LOWER}')"
    out = f"' ' || replace(regexp_replace({low}, {quote(SIGNS)}, ' ', 'g'), ' ', '  ') || ' '"
    for other, one in SPELLINGS:
        spaced = lambda s: quote(f" {s} ".replace(" ", "  ")[1:-1])
        out = f"replace({out}, {spaced(other)}, {spaced(one)})"
    line = f"CASE WHEN regexp_matches({low}, {quote(COPYRIGHT)}) THEN '' ELSE trim(regexp_replace({out}, ' +', ' ', 'g')) END"
    lines = lambda c: f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {line}), lambda x: x <> '')"
    rows = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known())
    return f"""
WITH k AS (SELECT * FROM (VALUES {rows}) AS v(license, body)),
known AS (SELECT sha256(list_aggregate({lines('body')}, 'string_agg', ' ')) AS digest, min(license) AS license FROM k GROUP BY 1),
d AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
n AS (SELECT d.doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
      FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d) AS d JOIN known USING (digest) GROUP BY 1),
w AS (SELECT doc_id, sha256(coalesce(list_aggregate(lines, 'string_agg', ' '), '')) AS text_digest FROM d)
SELECT w.doc_id, text_digest, license, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notices
FROM w LEFT JOIN known ON text_digest = digest LEFT JOIN n ON w.doc_id = n.doc_id
"""


SQL = _sql()
