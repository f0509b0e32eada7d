"""Licence scans by canonical digests, in DataFrame functions only.

Texts are brought to a canonical form: copyright lines go, case and
punctuation go, equivalent spellings become one.  The digest of the whole
canonical text, and of each of its lines (short notices stand alone on a
line), is hash-joined to the digests of known licences, made the same way.

Defined results: a null or empty text has the digest of the empty text and no
licence; ties (a digest of several names) list all names; lines repeated in a
text count each; repeated rows are scanned each; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings (after case and punctuation are gone) and the one that stands for them.
EQUIVALENT = (
    ("licence", "license"), ("licens ed", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https ", "http "),
)
COPYRIGHT = r"(?im)^[ \t>*#/;-]*(?:copyright\b|\(c\)|©|all rights reserved).*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Public licence texts and the short notices that name a licence.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """Canonical form, with the line breaks kept."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(COPYRIGHT), F.lit(""))
    t = F.regexp_replace(F.lower(t), F.lit(r"[^\p{L}\p{N}\n]+"), F.lit(" "))
    for spelling, one in EQUIVALENT:
        t = F.replace(t, F.lit(spelling), F.lit(one))
    return t


def whole(form: Column) -> Column:
    """The canonical text on one line."""
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def known_digests(spark: SparkSession, licenses=KNOWN) -> DataFrame:
    """digest, license, size (canonical characters) of the given licences: a small fixed table."""
    rows = spark.createDataFrame([(n, t) for n, t in licenses], "license string, text string")
    form = rows.select("license", whole(canonical(F.col("text"))).alias("t"))
    return form.groupBy(F.sha2("t", 256).alias("digest")).agg(F.concat_ws("|", F.array_sort(F.collect_set("license"))).alias("license"), F.max(F.length("t")).alias("size"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", licenses=KNOWN) -> DataFrame:
    """key, text_sha256 (canonical digest), license (of the whole text, '' if unknown), notices (licences that lines name), n_notices."""
    known = known_digests(docs.sparkSession, licenses)
    sizes = [r.size for r in known.select("size").distinct().collect()]  # a few numbers: no other line can match
    form = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), canonical(F.col(text)).alias("c"))
    lines = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(sizes))
    each = form.select("key", "row", F.sha2(whole(F.col("c")), 256).alias("text_sha256"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("lines"))
    units = each.select("key", "row", "text_sha256", F.posexplode(F.concat(F.array("text_sha256"), "lines")).alias("line", "digest"))
    found = units.join(F.broadcast(known.select("digest", "license")), "digest", "left")
    named = found.groupBy("row", "key", "text_sha256").agg(
        F.max(F.when(F.col("line") == 0, F.col("license"))).alias("license"),
        F.array_sort(F.collect_set(F.when(F.col("line") > 0, F.col("license")))).alias("notices"),
        F.count(F.when(F.col("line") > 0, F.col("license"))).alias("n_notices"),
    )
    return named.select(F.col("key").alias(key), "text_sha256", F.coalesce("license", F.lit("")).alias("license"), F.concat_ws(",", "notices").alias("notices"), "n_notices")


def sql(licenses=KNOWN) -> str:
    """The same scan of ``documents`` in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(t: str) -> str:
        t = f"regexp_replace(lower(regexp_replace(coalesce({t}, ''), {quote(COPYRIGHT)}, '', 'g')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        for a, b in EQUIVALENT:
            t = f"replace({t}, {quote(a)}, {quote(b)})"
        return t

    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in licenses)
    one = lambda t: f"trim(regexp_replace({t}, '[ \\n]+', ' ', 'g'), ' ')"
    return f"""
WITH known AS (SELECT sha256({one(form('t'))}) AS digest, string_agg(DISTINCT n, '|' ORDER BY n) AS license FROM (VALUES {rows}) AS v(n, t) GROUP BY 1),
f AS (SELECT row_number() OVER () AS r, doc_id, {form('text')} AS c FROM documents),
d AS (SELECT r, doc_id, c, sha256({one('c')}) AS text_sha256 FROM f),
l AS (SELECT r, k.license FROM (SELECT r, sha256(trim(unnest(string_split(c, chr(10))), ' ')) AS digest FROM d) x JOIN known k USING (digest)),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l GROUP BY r)
SELECT doc_id, text_sha256, coalesce(k.license, '') AS license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices
FROM d LEFT JOIN known k ON k.digest = d.text_sha256 LEFT JOIN n USING (r)
"""
