"""Licence scan by canonical digests, in DataFrame functions alone.

A text is brought into a canonical form (lower case, no copyright lines, no
punctuation, one spelling of words with several) and its SHA-256 is looked up
among the digests of known licences by a hash join. The whole document is one
such text; besides, every line is, so that notices in documents are found.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence texts use for one another.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"), ("organisation", "organization"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("utilise", "utilize"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("v1", "version 1"), ("v2", "version 2"), ("v3", "version 3"),
    ("v4", "version 4"), ("ver", "version"), ("gnu gpl", "gnu general public license"), ("gnu lgpl", "gnu lesser general public license"),
)

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Public licence texts and the notices that name a licence.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. " + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
            "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
            "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
                   "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("public-domain", "This work is in the public domain."), ("all-rights-reserved", "All rights reserved."),
)

#: A canonical text is never shorter than this share of its plain form: no spelling shrinks a text more.
SHRINK = 2
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def plain(text: Column) -> Column:
    """Lower case, copyright lines gone, every run of other signs one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), NOT_WORD, " "))


def one_spelling(text: Column) -> Column:
    return reduce(lambda t, pair: F.regexp_replace(t, rf"\b{pair[0]}\b", pair[1]), SPELLINGS, text)


def first_words(known: tuple = KNOWN) -> list[str]:
    """Words that the plain form of a known text can begin with, other spellings included."""
    words = {next(iter(re.findall(r"[^\W_]+", text.lower()))) for _, text in known}
    while True:
        more = {a.split()[0] for a, b in SPELLINGS if b.split()[0] in words} | {b.split()[0] for a, b in SPELLINGS if a.split()[0] in words}
        if more <= words:
            return sorted(words)
        words |= more


def may_be_known(form: Column, known: tuple = KNOWN) -> Column:
    """Whether a plain text has a length and a first word that some known text can have; spares the others the spelling step."""
    longest = SHRINK * (max(len(t) for _, t in known) + 64)
    return (F.length(form) > 0) & (F.length(form) <= longest) & F.split_part(form, F.lit(" "), F.lit(1)).isin(first_words(known))


def canonical_digest(form: Column, known: tuple = KNOWN) -> Column:
    """SHA-256 of the canonical text of a plain one; null where no known text can be it."""
    return F.when(may_be_known(form, known), F.sha2(one_spelling(form), 256))


def known_licenses(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """``digest, license`` of the known texts; a table of their number, one row per digest."""
    texts = spark.createDataFrame([(name, text) for name, text in known], "license string, text string")
    return texts.select(F.sha2(one_spelling(plain(F.col("text"))), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: tuple = KNOWN) -> DataFrame:
    """``doc_id, license, notices, n_notices`` for every row of ``doc_id, text``.

    ``license`` is the known text that the whole document is, else null;
    ``notices`` are the known texts that its lines are, sorted, joined by a
    comma, each once, and ``n_notices`` counts those lines. Null and empty texts
    have none; null and repeated ids are kept as rows of their own. The known
    digests, one row per known text, are broadcast; lines of a document stay in
    its task until they are counted, and one narrow row per document and task
    is shuffled.
    """
    spark = docs.sparkSession
    lookup = known_licenses(spark, known)
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    wholes = texts.withColumn("form", plain(F.col("text"))).withColumn("whole", canonical_digest(F.col("form"), known))
    lines = wholes.select("row", "doc_id", "whole", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.withColumn("form", plain(F.col("line"))).withColumn("part", canonical_digest(F.col("form"), known))
    whole = F.broadcast(lookup.select(F.col("digest").alias("whole"), "license"))
    part = F.broadcast(lookup.select(F.col("digest").alias("part"), F.col("license").alias("notice")))
    found = rows.join(whole, "whole", "left").join(part, "part", "left")
    return (
        found.groupBy("row", "doc_id", "license")
        .agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count("notice").alias("n_notices"))
        .select("doc_id", "license", "notices", "n_notices")
    )


def scan_sql(known: tuple = KNOWN) -> str:
    """The same rows in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), {quote(COPYRIGHT_LINE)}, ' ', 'g'), {quote(NOT_WORD)}, ' ', 'g'))"
    spell = lambda c: reduce(lambda t, p: f"regexp_replace({t}, '\\b{p[0]}\\b', '{p[1]}', 'g')", SPELLINGS, c)
    longest = SHRINK * (max(len(t) for _, t in known) + 64)
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in known)
    digest = lambda c: f"CASE WHEN length({c}) > 0 AND length({c}) <= {longest} THEN sha256({spell(c)}) END"
    return f"""
    WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({spell(form('text'))}) AS digest FROM (VALUES {values}) AS v(license, text)) GROUP BY digest),
    docs AS (SELECT doc_id, {form("coalesce(text, '')")} AS form, coalesce(text, '') AS text FROM documents),
    whole AS (SELECT doc_id, text, {digest('form')} AS digest FROM docs),
    lines AS (SELECT doc_id, {form('line')} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
    notices AS (SELECT doc_id, k.license FROM (SELECT doc_id, {digest('form')} AS digest FROM lines) JOIN known k USING (digest)),
    by_doc AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM notices GROUP BY doc_id)
    SELECT w.doc_id, k.license, coalesce(b.notices, '') AS notices, coalesce(b.n_notices, 0) AS n_notices
    FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN by_doc b ON w.doc_id = b.doc_id
    """
