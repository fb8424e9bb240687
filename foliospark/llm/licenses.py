"""Licence scans: canonical digests of entire texts and entire lines, joined to known ones.

DataFrame operations only.  The canonical form is lower case, one blank for every run of other characters than
letters and digits, one spelling of equivalent words, without copyright lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_KNOWN = 10_000

# Words that count as the same in licence texts, each with the spelling it is brought to.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Wordings of published licences, and lines by which works say their licence.
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted"
)
ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution."
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission."
)
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
KNOWN = [
    ("MIT", f"MIT License {MIT_GRANT} {AS_IS}"),
    ("MIT", f"{MIT_GRANT} {AS_IS}"),
    ("ISC", f"ISC License {ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_AS_IS}"),
    ("0BSD", f"{ISC_GRANT}. {ISC_AS_IS}"),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_AS_IS}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_NAMES} {BSD_AS_IS}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]


def canonical_lines(text: Column) -> Column:
    """The text in canonical form with its line ends; copyright lines are empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    for old, new in EQUIVALENT:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.regexp_replace(plain, r"(?m)^ ?copyright( [^\n]*)?$", "")


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license_id, known``: each licence's digest; of equal texts the first id by name."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license_id string, text string")
    found = rows.select("license_id", digest(whole(canonical_lines(F.col("text")))).alias("known"))
    return found.groupBy("known").agg(F.min("license_id").alias("license_id"))


def scanned(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license_id, line_licenses, text_digest``, one row per input row.

    ``license_id``: the licence whose text the entire document is, null if there is none; ``line_licenses``: the sorted
    licences that an entire line of it is, joined by commas, null if there is none.  Null and
    empty texts have the digest of the empty text, which is no licence.

    ``known`` is broadcast; it may have ``MAX_KNOWN`` rows, else it raises.  A document's matches are combined in the
    task that reads it, before the shuffle.
    """
    if (n := known.limit(MAX_KNOWN + 1).count()) > MAX_KNOWN:
        raise ValueError(f"{n} or more known texts; at most {MAX_KNOWN} are broadcast")
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        canonical_lines(F.col(text_col)).alias("lines"),
    )
    parts = lines.select("doc_id", "row", F.posexplode(F.concat(F.array(whole(F.col("lines"))), F.split("lines", "\n"))))
    hashed = parts.select("doc_id", "row", "pos", digest(F.trim("col")).alias("digest"))
    joined = hashed.join(F.broadcast(known), F.col("digest") == F.col("known"), "left")
    entire = F.col("pos") == 0
    return (
        joined.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(entire, F.col("license_id"))).alias("license_id"),
            F.collect_set(F.when(~entire, F.col("license_id"))).alias("found"),
            F.max(F.when(entire, F.col("digest"))).alias("text_digest"),
        )
        .select(
            "doc_id", "license_id", F.nullif(F.array_join(F.sort_array("found"), ","), F.lit("")).alias("line_licenses"), "text_digest"
        )
    )


def sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same scan for DuckDB."""

    def lines(text: str) -> str:
        plain = rf"regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
        for old, new in EQUIVALENT:
            plain = f"replace({plain}, '{old}', '{new}')"
        return rf"regexp_replace({plain}, '(?m)^ ?copyright( [^\n]*)?$', '', 'g')"

    def entire(text: str) -> str:
        return rf"trim(regexp_replace({text}, '[ \n]+', ' ', 'g'))"

    rows = ", ".join(f"""('{name}', '{text.replace("'", "''")}')""" for name, text in (KNOWN if known is None else known))
    return f"""
with known as (
    select sha256({entire(lines("text"))}) as known, min(license_id) as license_id
    from (values {rows}) as k(license_id, text) group by 1
),
plain as (select doc_id, {lines("text")} as lines from documents),
parts as (
    select doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) as digest from plain
),
named as (
    select doc_id, string_agg(distinct license_id, ',' order by license_id) as line_licenses
    from parts join known on digest = known group by doc_id
),
texts as (select doc_id, sha256({entire("lines")}) as text_digest from plain)
select doc_id, license_id, line_licenses, text_digest
from texts left join known on text_digest = known left join named using (doc_id)
"""
