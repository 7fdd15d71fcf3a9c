"""License scans by canonical digest: normalise, digest, and hash-join with the digests of known licenses.

The canonical form of a text: lower case; copyright lines gone; everything but letters and digits a single
blank (comment signs too); equivalent spellings made one, by rules on word endings rather than a list, as
only equality counts. The digest of a document's entire text, and of each of its lines that speaks of a
license (a notice is a text of one line), is joined with the table of known digests.

The known table is fixed and small: the whole texts in license_texts/ (each also without what follows its
terms), short texts and notices in KNOWN; or it is the caller's own, checked by size before a broadcast.
Defined cases: null or empty text has the digest of nothing and matches nothing; a notice that stands
several times in a text counts each time; repeated rows (same doc_id, same text) are reported once, rows of one
doc_id with unequal texts once each; a null doc_id stays null; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public license texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_TAIL),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]

#: Pattern (or plain words) and replacement, in this order, after lower-casing; patterns mean the same in Java, RE2 and Python.
STEPS: list[tuple[str, str]] = [
    (r"(^|\n)[ \t*#/;%-]*(copyright|\(c\)|©)[^\n]*", r"\1"),
    (r"[^a-z0-9]+", " "),
    # what goes: a phrase; blanks in compounds; doubled letters; silent endings
    (r"\ball rights reserved\b|\b(sub|non) (licen|commercial|infring)|(abel|ignal|odel|ancel|itial)l(ed|ing)\b|(catalog|analog)ue|(judg|acknowledg)e(ment)|(program)me\b|(fulfil)l", r"\1\2\3\4\5\6\7\8\9"),
    (r"(licen|practi|defen|offen)ce", r"\1se"),
    (r"([a-z]{3})is(e|ed|es|er|ers|ing|ation|ations)\b", r"\1iz\2"),
    (r"([a-z]{2})our(s|ed|ing|able|ite|ites)?\b", r"\1or\2"),
    (r"\bcentre", "center"),
    ("https", "http"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    (r" +", " "),
]
_NOTICE = r"(?i)(licen[cs]ed?|copyright|spdx)"
_END = "END OF TERMS AND CONDITIONS"


def _plain(pattern: str) -> bool:
    """Whether a pattern is plain words, which need no regular expression."""
    return pattern.replace(" ", "").isalnum()


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.replace(out, F.lit(pattern), F.lit(to)) if _plain(pattern) else F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return F.trim(out)


def canonical_text(text: str) -> str:
    """canonical() of one text, on the driver."""
    out = text.lower()
    for pattern, to in STEPS:
        out = out.replace(pattern, to) if _plain(pattern) else re.sub(pattern, to, out)
    return out.strip(" ")


@lru_cache(maxsize=1)
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of the files of license_texts/, and of each up to the end of its terms."""
    out = []
    for path in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        if _END in text:
            out.append((path.stem, text[: text.index(_END) + len(_END)]))
            out.append((path.stem, text[: text.index(_END)]))
    return tuple(out)


def known_digests() -> list[tuple[str, str]]:
    """(license, digest) of all that is known."""
    return sorted({(name, hashlib.md5(canonical_text(text).encode()).hexdigest()) for name, text in (*KNOWN, *whole_texts())})


def known_table(spark: SparkSession) -> DataFrame:
    """known_digests() as a table."""
    return spark.createDataFrame(known_digests(), "license string, digest string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, digest of the whole canonical text, license it is (or null), n_notices and the licenses of its notices, sorted."""
    from .common import bounded_broadcast

    known = F.broadcast(known_table(docs.sparkSession)) if known is None else bounded_broadcast(known, 10_000)
    text = F.coalesce(F.col("text"), F.lit(""))
    notices = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(_NOTICE)), lambda x: F.md5(canonical(x)))
    rows = docs.select("doc_id", F.md5(text).alias("row"), F.md5(canonical(text)).alias("digest"), notices.alias("notices"))
    rows = rows.groupBy("doc_id", "row").agg(F.first("digest").alias("digest"), F.first("notices").alias("notices"))  # repeated rows
    whole = rows.join(known.groupBy("digest").agg(F.min("license").alias("whole_license")), "digest", "left")
    # a document without notices has a key of its own that no license has: nulls would all meet in one task
    line = whole.withColumn("line", F.explode_outer("notices")).withColumn("line_digest", F.coalesce("line", F.concat(F.lit("-"), "row")))
    lines = line.join(known.select(F.col("digest").alias("line_digest"), F.col("license")), "line_digest", "left")
    found = lines.groupBy("doc_id", "row", "digest").agg(F.min("whole_license").alias("whole_license"), F.count("license").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return found.drop("row")


def _sql(text: str) -> str:
    out = f"lower({text})"
    for pattern, to in STEPS:
        out = f"replace({out}, '{pattern}', '{to}')" if _plain(pattern) else f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH known AS (
  SELECT DISTINCT license, md5({_sql("body")}) AS digest FROM (VALUES {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in KNOWN)}) v(license, body)
  UNION
  SELECT license, digest FROM (VALUES {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in known_digests())}) v(license, digest)
), d AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
), whole AS (
  SELECT doc_id, text, md5(text) AS row, md5({_sql("text")}) AS digest FROM d
), line AS (
  SELECT doc_id, row, unnest(string_split(text, chr(10))) AS line FROM whole
), noticed AS (
  SELECT line.doc_id, line.row, known.license FROM line JOIN known ON known.digest = md5({_sql("line.line")})
  WHERE regexp_matches(line.line, '{_NOTICE}')
), counted AS (
  SELECT doc_id, row, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM noticed GROUP BY doc_id, row
)
SELECT w.doc_id, w.digest, k.whole_license, coalesce(c.n_notices, 0) AS n_notices, coalesce(c.notices, '') AS notices
FROM whole w LEFT JOIN (SELECT digest, min(license) AS whole_license FROM known GROUP BY digest) k ON k.digest = w.digest
LEFT JOIN counted c ON c.doc_id = w.doc_id AND c.row = w.row
"""
