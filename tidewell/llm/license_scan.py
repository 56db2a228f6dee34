"""License scans: canonical digests of whole texts and lines, joined to known ones.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import held
from .ids import row_key

# Licence notices and texts by SPDX-style name, and spellings that count as equal.
NOTICES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)
# Entire texts: name, titles that may stand above, paragraphs. Copyright statements are left out, as canonical() drops them.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_ZLIB = (
    "This software is provided \"as-is\", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "3. This notice may not be removed or altered from any source distribution.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
_BULLETS = tuple(x[3:] if x[1:3] == ". " else x for x in _BSD)
_MORE = "For more information, please refer to <{}://unlicense.org{}>"
TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), (_MIT,)),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), (_BSD[:3] + _BSD[4:], _BULLETS[:3] + _BULLETS[4:])),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License"), (_BSD, _BULLETS)),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), (_ISC, (_ISC[0].replace("and/or", "and"), _ISC[1]))),
    ("Zlib", ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"), (_ZLIB,)),
    ("Unlicense", ("The Unlicense", "Unlicense"), (_UNLICENSE, *((*_UNLICENSE, _MORE.format(a, b)) for a in ("http", "https") for b in ("", "/")))),
    ("Apache-2.0", (), (_APACHE_NOTICE, (_APACHE_NOTICE[0], _APACHE_NOTICE[1].replace("http", "https"), _APACHE_NOTICE[2]))),
)
KNOWN = NOTICES + tuple(
    (name, "\n\n".join((*title, *rights, *body)))
    for name, titles, bodies in TEXTS
    for body in bodies
    for title in ((), *((t,) for t in titles))
    for rights in ((), ("All rights reserved.",))
)
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("sub license", "sublicense"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)


#: Words after which "copyright" or "(c)" at a line's start goes on with a sentence or a clause.
_PROSE = "notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|rights?|treat(?:y|ies)|protection|acts?|and|or|in|of|to|is|are|for|this|that|which|may|shall|must"
_CLAUSE = "you|your|if|the|any|an?|all|in|to|for|neither|no|not|this|that|each|where|when|or|and|such|use|must|may|it|redistribut\\p{L}*|modif\\p{L}*"
_SIGN = r"(?:\(c\)|©|(?:19|20)\d\d)"
#: A copyright statement: a sign, year or holder after the word, or a sign before a holder or year.
_STATEMENT = rf"""(?m)^[^\n\p{{L}}]*(?:copyright\b[^\n\p{{L}}\p{{N}}]{{0,4}}{_SIGN}|copyright[: \t]++(?!(?:{_PROSE})\b)[^\n\p{{L}}\p{{N}}]{{0,2}}[\p{{L}}\p{{N}}]
    |\(c\)[^\n]*\b(?:19|20)\d\d\b|\(c\)[ \t]*+(?!(?:{_CLAUSE})\b)[^\n\p{{L}}\p{{N}}]{{0,2}}[\p{{L}}\p{{N}}]|©)[^\n]*$""".replace("\n    ", "")
#: Known texts up to which their digests are broadcast.
BROADCAST_KNOWN = 100_000


def _spelled(text: Column) -> Column:
    for other, usual in SPELLINGS:
        text = F.regexp_replace(text, rf"\b{other}\b", usual)
    return text


def _has(text: Column, parts: Sequence[str]) -> Column:
    """Whether any of the parts stands in the text: a byte search, so that most texts are spared the patterns."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def canonical(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds `canonical`: lower case, no copyright statements, equal spellings, no punctuation, single spaces; lines are kept apart."""
    low = F.col("_low")
    rows = held(rows, "_low", F.lower(F.coalesce(text_col, F.lit(""))))
    rows = held(rows, "_said", F.when(_has(low, ("copyright", "(c)", "©")), F.regexp_replace(low, _STATEMENT, "")).otherwise(low))
    rows = held(rows, "_plain", F.regexp_replace("_said", r"[^\p{L}\p{N}\n]+", " "))
    plain = F.col("_plain")
    rows = held(rows, "_usual", F.when(_has(plain, [x for x, _ in SPELLINGS]), _spelled(plain)).otherwise(plain))
    return held(rows, "canonical", F.regexp_replace("_usual", " ?\n ?", "\n")).drop("_low", "_said", "_plain", "_usual")


def digest(canonical_line: Column) -> Column:
    """The digest of a canonical line; null if nothing is left."""
    flat = F.trim(canonical_line)
    return F.when(flat != "", F.sha2(flat, 256))


def with_digest(rows: DataFrame) -> DataFrame:
    """Adds `whole`: the digest of the canonical text on one line, where spellings may be cut by line ends."""
    flat = F.col("_flat")
    rows = held(rows, "_flat", F.regexp_replace("canonical", "\n+", " "))
    pairs = [x for x, _ in SPELLINGS if " " in x]
    return rows.withColumn("whole", digest(F.when(_has(flat, pairs), _spelled(flat)).otherwise(flat))).drop("_flat")


def known_digests(docs: DataFrame, known: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """license, digest: one row per distinct canonical text of `known`; the first name wins, of a table the least."""
    if isinstance(known, DataFrame):
        rows = known.select(F.col("license").alias("i"), "license", "text").where("license is not null")
    else:
        rows = docs.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known)], "i int, license string, text string")
    return with_digest(canonical(rows, "text")).withColumnRenamed("whole", "digest").groupBy("digest").agg(F.min_by("license", "i").alias("license")).where("digest is not null")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, known: Sequence[tuple[str, str]] | DataFrame = KNOWN, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license, line_licenses, n_license_lines for each document.

    A text is made canonical (case, punctuation, copyright statements, spellings) and
    its SHA-256 is hash-joined to those of known licences: `license` names the
    one that the entire text equals.  Entire lines are looked up the same way;
    line_licenses lists their names, sorted, and n_license_lines counts them.

    The known list is fixed and broadcast.  `more` is a table (license, text) of
    further known texts; `known` wins where both name a text.  A table of over
    BROADCAST_KNOWN texts is joined by a shuffle.  Null, empty or
    all-punctuation texts have a null digest and no licence.  Rows that repeat
    an id and text have equal results; a null id is kept.  Other columns are ignored.
    """
    names, tables = known_digests(docs, known), [t for t in (known, more) if isinstance(t, DataFrame)]
    if more is not None:
        further = known_digests(docs, more)
        names = names.unionByName(further.join(F.broadcast(names) if not isinstance(known, DataFrame) else names, "digest", "left_anti"))
    if all(t.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN for t in tables):
        names = F.broadcast(names)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_digest(canonical(rows.withColumn("row", row_key("doc_id", "text")), "text"))
    # the entire text stands at place -1 beside its lines, so the texts are read and made canonical once
    places = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("whole").alias("digest"))), F.transform(F.split("canonical", "\n"), lambda x, i: F.struct(i.alias("at"), digest(x).alias("digest"))))
    found = rows.select("doc_id", "row", F.explode(places).alias("p")).select("doc_id", "row", "p.*").join(names, "digest", "left")
    line = F.col("at") >= 0
    hits = found.groupBy("doc_id", "row").agg(
        F.count_if(F.col("at") == -1).alias("rows"),
        F.max(F.when(~line, F.col("digest"))).alias("digest"),
        F.max(F.when(~line, F.col("license"))).alias("license"),
        F.array_sort(F.collect_set(F.when(line, F.col("license")))).alias("line_licenses"),
        F.count_if(line & F.col("license").isNotNull()).alias("n"),
    )
    out = hits.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", "digest", "license", "line_licenses", (F.col("n") / F.col("rows")).cast("long").alias("n_license_lines"))
