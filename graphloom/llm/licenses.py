"""License scans by canonical digest lookup, in DataFrame functions alone.

A text is brought to a canonical form (lower case, copyright lines out, punctuation to single spaces, equivalent spellings to one),
its SHA-256 is taken, and whole texts are joined by it to the digests of known license texts. Those are LICENSES, a constant of this
module, and the standard texts of the folder `texts`, so the table is broadcast whatever the size of the corpus. A text that is none of
them is looked up once more in a looser form, without list markers and copyright lines that give a name alone.

Cases: a null text has a null digest and no license; an empty text has the digest of the empty string and no license; a very long text is
looked up whole; repeated rows keep their number; an empty table gives no rows; other columns, whatever their names, are left alone."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Fixed values: (license, text or notice). Titles and copyright lines are no part of the canonical form.
LICENSES = [
    ("MIT", _PERMIT + _AS_IS),
    ("MIT", "MIT License\n" + _PERMIT + _AS_IS),
    ("MIT", "The MIT License (MIT)\n" + _PERMIT + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("ISC", "ISC License\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", _ISC + ". " + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_3 + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
#: Spellings that license texts use for one another, as (pattern, canonical), on the form with single spaces.
SPELLINGS = [
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement", "noninfringement"),
    (r"\bmerchantibility", "merchantability"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bhttps ", "http "),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bfavour", "favor"),
    (r"\borganisation", "organization"),
    (r"\bwilful", "willful"),
    (r"\bwhilst\b", "while"),
    (r"\bv (\d)", "version $1"),
]
#: A copyright notice: a line of at most 120 further characters, or what stands before a license that begins on the same line.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright( \(c\)| ©|:)? ?\d{4}|copyright \(c\)|copyright ©|\(c\) ?\d{4}|© ?\d{4}|all rights reserved)[^\n]{0,120}?($|permission is hereby|permission to use|redistribution and use|licensed under|released under|this software is|this work is|this program is)"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " $3")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for pattern, one in SPELLINGS:
        out = F.regexp_replace(out, pattern, one)
    return F.trim(out)


#: A copyright line of a name without a year or a mark, in a text as written.
NAMED_LINE = r"(?m)^[ \t*#/;-]*Copyright:?[ \t]+(by[ \t]+)?(?!Holder|Owner|Notice|License)[A-Z][^\n;]{0,79}$"
#: A list marker between white space: `1.`, `(a)`, `iv)`; numbers of versions and sections, and what ends a text, are none.
MARKER = r"(?<!version)(?<!section)(^|\s)[ \t*#/;-]*(\([a-z0-9]{1,4}\)|([0-9]{1,2}|[a-z]|[ivx]{2,4})[.)])(?=\s+\S)"
#: Every known text has one of these words, so a text without them is looked up once.
LICENSE_WORDS = r"licen[cs]e|software"
#: What standard texts end with before their appendices, which copies leave out.
END = "END OF TERMS AND CONDITIONS"


def loose(text: Column) -> Column:
    return canonical(F.regexp_replace(F.lower(F.regexp_replace(text, NAMED_LINE, " ")), MARKER, " "))


def known_texts() -> list[tuple[str, str]]:
    """LICENSES, and each standard text whole and up to the end of its terms."""
    out = list(LICENSES)
    for f in sorted(files(__package__).joinpath("texts").iterdir(), key=lambda f: f.name):
        text = f.read_text(encoding="utf-8")
        out.append((f.name, text))
        if END in text:
            out += [(f.name, text[: text.index(END)]), (f.name, text[: text.index(END) + len(END)])]
    return out


def digests(spark: SparkSession) -> DataFrame:
    """license, text_digest of the known texts in both forms; one row for each digest."""
    known = spark.createDataFrame(known_texts(), "license string, text string")
    forms = known.select("license", F.explode(F.array(F.sha2(canonical(F.col("text")), 256), F.sha2(loose(F.col("text")), 256))).alias("text_digest"))
    return forms.groupBy("text_digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_digest, license (null where the whole text is no known license)."""
    t = F.col("text")
    again = F.when(F.lower(t).rlike(LICENSE_WORDS), F.sha2(loose(t), 256)).alias("loose_digest")
    rows = require(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", F.sha2(canonical(t), 256).alias("text_digest"), again)
    known = digests(docs.sparkSession)
    exact, second = F.broadcast(known), F.broadcast(known.toDF("loose_digest", "loose_license"))
    return rows.join(exact, "text_digest", "left").join(second, "loose_digest", "left").select("doc_id", "text_digest", F.coalesce("license", "loose_license").alias("license"))


def _canonical_sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, ' \\3', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    for pattern, one in SPELLINGS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(one.replace('$1', chr(92) + '1'))}, 'g')"
    return f"trim({out})"


def oracle() -> str:
    known = ", ".join("('{}', '{}')".format(a, t.replace("'", "''")) for a, t in LICENSES)
    return f"""
        WITH known AS (SELECT sha256({_canonical_sql('t')}) AS text_digest, min(license) AS license FROM (VALUES {known}) v(license, t) GROUP BY 1),
        d AS (SELECT doc_id, sha256({_canonical_sql('text')}) AS text_digest FROM documents)
        SELECT d.doc_id, d.text_digest, known.license FROM d LEFT JOIN known USING (text_digest)"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
