"""License scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: copyright lines out, case folded, punctuation and white space to single spaces,
equivalent spellings to one. The digest of the whole canonical text is joined to those of known licences; so a known
notice is found however it is set, and nothing is found in part. The same is done with each line of a document, taken as
a text of its own, for licence notices that stand inside other text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import with_key

#: The parts that the BSD licences share.
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Names and texts of licences and of notices that grant them.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]
#: Titles that may stand over a whole licence text.
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}
KNOWN += [(name, f"{TITLES[name]} {text}") for name, text in KNOWN if name in TITLES and len(text) > 400]
#: Spellings that count as one, after case and punctuation are folded; longer forms first.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("favour", "favor"), ("neighbouring", "neighboring"),
    ("authorisation", "authorization"), ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"), ("v3", "version 3"), ("https", "http"),
]


def canonical(text: Column) -> Column:
    """The canonical form; empty if nothing is left, null for null."""
    c = F.regexp_replace(text, r"(?im)^[ \t#*/;-]*(copyright|\(c\)|©)[^\r\n]*$", " ")
    c = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    for a, b in SPELLINGS:
        c = F.regexp_replace(c, rf"\b{a}\b", b)
    return c


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, license: a row for each known text, as many as the list has."""
    table = spark.createDataFrame(known, "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    return table.dropDuplicates(["digest"])


def needles(known: list[tuple[str, str]]) -> list[str]:
    """Patterns of which every text that is equal to a known one has one: a word of each that has no other spelling."""
    spelled = {w for pair in SPELLINGS for form in pair for w in form.split()}
    out = set()
    for _, text in known:
        kept = [w for w in re.findall("[a-z0-9]+", re.sub(r"(?im)^[ \t#*/;-]*(copyright|\(c\)|©)[^\r\n]*$", " ", text).lower()) if w not in spelled]
        out.add(max(kept, key=len) if kept else "[a-z0-9]")
    return sorted(out)


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, digest (of the whole text), license (of the whole text, or null), notices (sorted array of the licences of
    its lines), n_notices (long: lines that match) for every row. Null texts have a null digest; texts without letters
    or digits match nothing. Repeated rows each come back.

    A line without the longest word of any known text, in one of its spellings, cannot match, and is passed over before
    it is brought to canonical form."""
    spark = docs.sparkSession
    keyed, keys = with_key(docs.select(id_col, text_col), id_col, text_col)
    table = F.broadcast(known_digests(spark, known).select(F.col("digest").alias("known"), "license"))
    words = needles(known)
    lines = keyed.select(*keys, F.explode(F.split(text_col, r"\r\n|\r|\n")).alias("line"))
    lines = lines.filter(F.col("line").rlike("(?iu)" + "|".join(words)))
    met = lines.join(table, digest(F.col("line")) == F.col("known"))
    met = met.groupBy(*keys).agg(F.array_sort(F.collect_set("license")).alias("notices"), F.count("*").alias("n_notices"))
    # a repeated row's lines were counted once for each of its copies
    copies = keyed.groupBy(*keys).agg(F.count("*").alias("copies"))
    met = met.join(copies, keys).select(*keys, "notices", (F.col("n_notices") / F.col("copies")).cast("long").alias("n_notices"))
    whole = keyed.select(id_col, *keys, digest(F.col(text_col)).alias("digest"))
    out = whole.join(table, F.col("digest") == F.col("known"), "left").join(met, keys, "left")
    return out.select(id_col, "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, license, notices (comma-joined), n_notices of every row of documents. A null text has a null digest; empty
    texts match nothing; repeated rows each come back; an empty table gives no rows."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "digest", "license", F.concat_ws(",", "notices").alias("notices"), "n_notices")


def _sql_canonical(text: str) -> str:
    c = rf"regexp_replace({text}, '(?im)^[ \t#*/;-]*(copyright|\(c\)|©)[^\r\n]*$', ' ', 'g')"
    c = f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        c = rf"regexp_replace({c}, '\b{a}\b', '{b}', 'g')"
    return c


def op6_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT license, sha256({_sql_canonical('t')}) AS digest FROM (VALUES {quoted}) AS v(license, t)),
lines AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents),
met AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM lines) JOIN k USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
SELECT doc_id, whole.digest, k.license, coalesce(notices, '') AS notices, CAST(coalesce(n, 0) AS BIGINT) AS n_notices
FROM whole LEFT JOIN k USING (digest) LEFT JOIN met USING (doc_id)
"""
