"""Licence scan by canonical digests, in DataFrame expressions only.

A text is brought to a canonical form: lower case; copyright lines dropped;
equivalent spellings made one; everything but letters and digits made one space.
The SHA-256 digest of the whole canonical text is hash-joined to the digests of
known licence texts, canonicalised by the same expressions. The same is done for
each line, which finds one-line notices inside other text.

The table of known licences is a parameter; the built-in one is a constant list,
so broadcasting it has a proven bound. Lines are matched before anything is
shuffled; only matches move.

Edge cases: null texts have a null digest and no licence; texts that are empty
in canonical form match nothing; repeated rows give repeated results, and rows
that share a doc_id share the notices of all of them; rows with a null doc_id
are kept and have no line matches; other columns are ignored.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, each with the one used here.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)

# Public licence texts and one-line notices.
KNOWN = (
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

# Titles that stand above the short texts, and the longer texts in the folder licences
# as (licence, lines of title, line after which or from which an annex follows).
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "This software is released under the MIT license:"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "The BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "The BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("The zlib License",),
}
_FILES = (
    ("Apache-2.0", 3, "END OF TERMS AND CONDITIONS"),
    ("Artistic-1.0-Perl", 1, None),
    ("BSL-1.0", 1, None),
    ("CC0-1.0", 2, None),
    ("GFDL-1.2", 2, "ADDENDUM: How to use"),
    ("GFDL-1.3", 2, "ADDENDUM: How to use"),
    ("GPL-1.0", 2, "END OF TERMS AND CONDITIONS"),
    ("GPL-2.0", 2, "END OF TERMS AND CONDITIONS"),
    ("GPL-3.0", 2, "END OF TERMS AND CONDITIONS"),
    ("LGPL-2.0", 2, "END OF TERMS AND CONDITIONS"),
    ("LGPL-2.1", 2, "END OF TERMS AND CONDITIONS"),
    ("LGPL-3.0", 2, None),
    ("MPL-1.1", 2, "EXHIBIT A -"),
    ("MPL-2.0", 1, "Exhibit A - Source"),
    ("Unicode-3.0", 1, None),
    ("Unlicense", 0, None),
    ("Zlib", 1, None),
)


def _whole_texts() -> list[tuple[str, str]]:
    """The forms of whole licence texts: with and without title, clause numbers, annex and the address below the title."""
    bodies = list(KNOWN[:5])
    bodies += [(licence, text.replace("1. Redis", "Redis").replace("2. Redis", "Redis").replace("3. Neither", "Neither")) for licence, text in KNOWN[3:5]]
    out = []
    for licence, titles, annex in _FILES:
        text = resources.files(__package__).joinpath("licences", f"{licence}.txt").read_text(encoding="utf-8")
        lines = [line for line in text.split("\n") if line.strip()]
        ends = [lines, [line for line in lines if not line.strip().startswith("Copyright [yyyy]")]]
        if annex:
            at = next(i for i, line in enumerate(lines) if line.strip().startswith(annex))
            ends += [lines[:at], lines[: at + 1]] if annex.startswith("END") else [lines[:at]]
        for some in ends:
            for form in (some, [line for i, line in enumerate(some) if i > 4 or "Franklin St" not in line]):
                out.append((licence, "\n".join(form)))
                bodies.append((licence, "\n".join(form[titles:])))
    bodies += [(licence, text.replace("/licenses/why-not-lgpl", "/philosophy/why-not-lgpl")) for licence, text in bodies if licence == "GPL-3.0"]
    out += [(licence, text.replace("/licenses/why-not-lgpl", "/philosophy/why-not-lgpl")) for licence, text in out if licence == "GPL-3.0"]
    out += bodies + [(licence, f"{title}\n\n{text}") for licence, text in bodies for title in _TITLES.get(licence, ())]
    return list(dict.fromkeys(out))


KNOWN += tuple(row for row in _whole_texts() if row not in KNOWN)

_COPYRIGHT_LINE = r"(?m)^[^\n]*(copyright \(c\)|copyright ©|©|\(c\) *[12][0-9][0-9][0-9]|copyright *[12][0-9][0-9][0-9]|all rights reserved)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, " "), _OTHER, " ")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.trim(out)


def digest(text: Column) -> Column:
    """Digest of the canonical form; null for null."""
    return F.sha2(canonical(text), 256)


def canonical_sql(text: str) -> str:
    """The canonical form as SQL of an engine with RE2 patterns, for checks."""
    out = f"regexp_replace(regexp_replace(lower({text}), '{_COPYRIGHT_LINE}', ' ', 'g'), '{_OTHER}', ' ', 'g')"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{one}')"
    return f"trim({out})"


def oracle_sql() -> str:
    """What scan returns for a table documents(doc_id, text), as DuckDB SQL."""
    rows = ", ".join("('{}', '{}')".format(licence, text.replace("'", "''")) for licence, text in KNOWN)
    return f"""
    WITH known AS (SELECT sha256({canonical_sql("text")}) AS digest, min(licence) AS licence FROM (VALUES {rows}) AS t(licence, text) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    found AS (
        SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
        FROM (SELECT doc_id, sha256({canonical_sql("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id)
    SELECT doc_id, d.digest, licence, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
    FROM (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM documents) d LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)"""


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text) of the built-in list."""
    return spark.createDataFrame(list(KNOWN), "licence string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): digest, licence, n_notices, and notices, the licences of its lines in order of name.

    known: (licence, text) of licences to find, small enough to broadcast; a
    digest that two licences share goes to the one first by name.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    table = F.broadcast(known.select("licence", digest(F.col("text")).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence")))
    whole = docs.select("doc_id", "text").withColumn("digest", digest(F.col("text"))).join(table, "digest", "left")
    lines = docs.where("doc_id is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", digest(F.col("line")).alias("digest")).join(table, "digest")
    notices = lines.groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("notices"))
    return whole.select("doc_id", "digest", "licence").join(notices, "doc_id", "left").select(
        "doc_id", "digest", "licence", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices")
    )

