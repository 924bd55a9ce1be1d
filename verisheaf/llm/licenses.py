"""Operator 9: licence scan by canonical digest lookup.

Texts are brought to one form (case, punctuation, copyright lines, equivalent spellings), and the digest of the whole
form is hash-joined to the digests of known licences. Each line is looked up the same way, which finds licence notices
inside longer texts. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisheaf.llm.common import read_table, text_of

# Equivalent spellings, replaced in this order after punctuation became a space.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("https ", "http "),
)

# Full licence texts.
_GRANT_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_NO_ENDORSE_BSD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_DISCLAIMER_BSD = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_DISCLAIMER = """.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("BSD-2-Clause", _GRANT_BSD + _DISCLAIMER_BSD),
    ("BSD-3-Clause", _GRANT_BSD + _NO_ENDORSE_BSD + _DISCLAIMER_BSD),
    ("ISC", _ISC_GRANT + _ISC_KEEP + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + _ISC_KEEP + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + _ISC_DISCLAIMER),
    ("Zlib", _ZLIB),
)
# MD5 of the canonical form (digest_of_all of canonical_lines) of longer licences as published.
_DIGESTS = (
    ("Apache-2.0", "3f4bdf128d873ad53471b7e9441114d0"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-2.0", "e374d0b43c25aed1a2b28951fe92a546"),
    ("GPL-3.0", "4e2a5fb39fd6441859c05e128799e2e1"),
    ("LGPL-2.0", "63ac11b5b2fcfe811ff161b9e5def0c5"),
    ("LGPL-2.1", "b0e44c745072418c0ff11407a0bc4ffc"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "a708f02208e9c42d3644490185833425"),
    ("MPL-2.0", "35fb4d2625087f7fd780039aa7b4ebb2"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "fd920ddc37a3d7e8c50763b83c95353c"),
    ("GFDL-1.3", "69253b6f159e4a07012cc5d95badaa85"),
)
# Names under which notices cite a licence.
_NAMES = (
    ("MIT", ("the MIT License", "MIT License", "MIT", "an MIT license")),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0", "Apache 2.0")),
    ("GPL-2.0", ("the GNU General Public License, version 2", "the GNU General Public License v2", "GPL-2.0", "GPLv2", "the GPL version 2")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "the GNU General Public License v3", "GPL-3.0", "GPLv3", "the GPL version 3")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3")),
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "BSD-2-Clause", "the 2-clause BSD license")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "BSD-3-Clause", "the 3-clause BSD license")),
    ("ISC", ("the ISC License", "ISC")),
    ("Unlicense", ("the Unlicense", "Unlicense")),
    ("CC0-1.0", ("CC0 1.0", "CC0", "the Creative Commons Zero license", "CC0 1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "CC-BY-SA-4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "CC-BY-NC-4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "CC-BY-ND-4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License")),
)
# Sentences of a notice.
_NOTICES = (
    "Released under {}.",
    "Licensed under {}.",
    "Distributed under {}.",
    "Available under {}.",
    "Published under {}.",
    "This work is licensed under {}.",
    "This work is released under {}.",
    "This file is licensed under {}.",
    "This project is licensed under {}.",
    "This software is licensed under {}.",
    "This software is released under {}.",
    "SPDX-License-Identifier: {}",
)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of every known text and notice: a fixed list of under a thousand."""
    notices = [(name, form.format(cited)) for name, cites in _NAMES for cited in cites for form in _NOTICES]
    return [*_TEXTS, *notices]


def canonical_lines(text: Column) -> Column:
    """Lower case; lines that state a copyright emptied; all but letters, digits and line feeds becomes a space; one
    spelling for equivalents. Lines stay lines."""
    out = F.lower(text)
    out = F.regexp_replace(out, r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def digest_of_all(lines: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")))


def catalog(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id), one row per digest; of licences with one digest, the first by name. texts: in place of all
    known texts and digests."""
    raw = spark.createDataFrame(texts if texts is not None else known_texts(), "license_id string, text string")
    rows = raw.select(digest_of_all(canonical_lines(F.col("text"))).alias("digest"), "license_id")
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame(list(_DIGESTS), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest (MD5 of the canonical form of the entire text), license_id (the licence
    that the entire text is, null if none), notices (the licences that single lines state, sorted, comma-separated;
    empty if none) and n_notices (such lines).

    known: (digest, license_id), a fixed list; its rows decide how it is joined. Null text counts as empty, which is no
    licence. Rows repeated with the same id and text give equal rows. Null ids are kept. Empty tables give no rows, an
    empty list finds nothing. Extra columns are ignored.
    """
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(text_of(text_col)).alias("lines"))
    base = lines.select("doc_id", "lines", digest_of_all(F.col("lines")).alias("digest"))
    known = known.select("digest", "license_id").dropDuplicates(["digest"])
    each = base.select("doc_id", F.col("digest").alias("text_digest"), F.explode(F.split("lines", "\n")).alias("line"))
    each = each.where("line rlike '[^ ]'").select("doc_id", "text_digest", F.md5(F.trim("line")).alias("digest"))
    notices = each.join(known, "digest").groupBy("doc_id", "text_digest", "license_id").agg(F.count(F.lit(1)).alias("n"))
    notices = notices.groupBy("doc_id", "text_digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"), F.sum("n").alias("n_notices"))
    # Rows that repeat an id and text counted their lines together.
    rows = base.select("doc_id", "digest")
    copies = rows.join(notices.select(F.col("doc_id").alias("at_id"), F.col("text_digest"), "notices", "n_notices"), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("digest") == F.col("text_digest")), "left")
    entire = copies.join(known, "digest", "left")
    return entire.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op9_license_scan(spark, sf_dir):
    return scan_licenses(read_table(spark, sf_dir, "documents"), catalog(spark))


def _sql_canonical(text: str) -> str:
    out = rf"regexp_replace(regexp_replace(lower({text}), '(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$', '', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known_texts())
    digests = ", ".join(f"('{a}', '{b}')" for a, b in _DIGESTS)
    return rf"""
WITH k AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT md5(trim(regexp_replace({_sql_canonical('text')}, '[ \n]+', ' ', 'g'))) AS digest, license_id FROM (VALUES {values}) AS t(license_id, text)
    UNION ALL SELECT digest, license_id FROM (VALUES {digests}) AS u(license_id, digest)
  ) GROUP BY digest
), b AS (
  SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS lines FROM documents
), d AS (
  SELECT doc_id, lines, md5(trim(regexp_replace(lines, '[ \n]+', ' ', 'g'))) AS digest FROM b
), e AS (
  SELECT doc_id, md5(trim(line)) AS digest FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM d) WHERE trim(line) <> ''
), n AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM e JOIN k USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n_notices, 0) AS BIGINT) AS n_notices
FROM d LEFT JOIN k USING (digest) LEFT JOIN n ON n.doc_id = d.doc_id
"""
