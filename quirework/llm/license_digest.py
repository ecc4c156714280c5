"""Licence scans by canonical digests, with DataFrame functions only.

A text is brought into a canonical form - lower case, copyright lines left out, "all rights reserved" left out,
equivalent spellings made one, every run of anything but letters and digits made one space - and the SHA-256 of the
whole form is hash-joined to the digests of known licence texts. So a document is recognised exactly if it is a licence
text as a whole, whatever its holder, year, quotation marks, line breaks and spelling.

A copyright line begins, after comment marks, with the sign, or with "(c)" and a year, or with the word and a year, a
sign, a placeholder or a holder. Words that licence texts have after "copyright" (TEXT_WORDS) are no holders: a
sentence may break anywhere without losing its line. A copyright statement must have lines of its own, though.

Known are the notices and short licences of this module (as texts) and long licences (as digests of their
canonical form); ``known`` is another table of (license_id, text). There are fewer than 100 of the former, so that
their digests are broadcast; a larger table of known texts is joined as Spark sees fit.

Defined cases: a null text has the form of an empty text; a text whose form is empty matches nothing; of known
texts with one digest the smallest license_id is given; repeated rows are each looked up; other columns are
ignored (``scan`` returns doc_id, n_words of the canonical form, canonical_sha256, license_id and is_license).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words that follow "copyright" in the sentences of licences (fixed values).
TEXT_WORDS = (
    "act", "and", "as", "disclaimer", "doctrine", "for", "holder", "holders", "if", "in", "information", "interest", "interests", "is",
    "law", "laws", "licence", "licences", "license", "licenses", "management", "notice", "notices", "of", "office", "on", "or", "owner",
    "owners", "ownership", "permission", "permissions", "protection", "right", "rights", "statement", "statements", "that", "to",
    "treaties", "treaty", "under", "with",
)
#: A copyright line of a lower-cased text; only \n ends a line.
COPYRIGHT_LINE = r"(?md)^[ \t/*#;-]*(?:©|\(c\)[ \t]*(?:[0-9<\[{©]|copyright)|(?:copyright|copr\.)(?:[ \t:,]*(?:©|\(c\)|[0-9<\[{])|[ \t:,]+(?!(?:WORDS)(?![a-z]))\p{L}))[^\n]*$".replace("WORDS", "|".join(TEXT_WORDS))
#: Equivalent spellings (fixed values): variant, canonical. Words are matched whole.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("https", "http"),
)

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Texts of known licences and notices (fixed values).
KNOWN = (
    ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\n" + _PERMISSION + _AS_IS),
    ("MIT", _PERMISSION + _AS_IS),
    ("MIT-0", "MIT No Attribution\n\n" + _PERMISSION.split(", subject to")[0] + ".\n\n" + _AS_IS),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _BSD_THIRD + _BSD_AS_IS),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS.split(" IN NO EVENT")[0] + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
)
#: SHA-256 of the canonical form of long licence texts (fixed values).
KNOWN_DIGESTS = (
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSD-UC", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GPL-1.0", "ecede0ce378cc2fefec4431f4cf508af5338dc8a3e44b5c5a3a7867070db5798"),
    ("GPL-2.0", "c9150a998ddbe45123303bf71d093beee4baf803b1eaea84b34fd41189285f1f"),
    ("GPL-3.0", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
LARGEST_BROADCAST = 10_000


def spelled(form: Column) -> Column:
    """The form with canonical spellings. Each word gets spaces of its own, so that neighbours don't share one."""
    out = F.concat(F.lit(" "), F.replace(form, F.lit(" "), F.lit("  ")), F.lit(" "))
    for variant, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} ".replace(" ", "  ")[1:-1]), F.lit(f" {one} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def any_spelling() -> str:
    """A pattern that finds out whether a form has a variant at all: variants by their first letter."""
    by: dict[str, list[str]] = {}
    for variant, _ in SPELLINGS:
        by.setdefault(variant[0], []).append(variant[1:])
    return "(?:^| )(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by.items()) + ")(?: |$)"


def canonical(text: Column) -> Column:
    """The canonical form: words of a-z, digits and non-ASCII characters between single spaces."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def of_words(form: Column) -> Column:
        # two steps that few texts need, so each only where its words occur
        bare = F.when(form.contains("all rights reserved"), F.trim(F.regexp_replace(form, "(?<![^ ])all rights reserved(?![^ ]) ?", ""))).otherwise(form)
        return let(bare, lambda f: F.when(f.rlike(any_spelling()), spelled(f)).otherwise(f))

    def of_low(low: Column) -> Column:
        lines = F.when(low.contains("cop") | low.contains("(c)") | low.contains("©"), F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)
        return let(F.trim(F.regexp_replace(lines, r"[^a-z0-9\u0080-\x{10FFFF}]+", " ")), of_words)

    return let(F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), of_low)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """license_id and canonical_sha256 of the texts and digests of this module."""
    texts = spark.createDataFrame(list(KNOWN), "license_id string, text string").select("license_id", digest(F.col("text")).alias("canonical_sha256"))
    return texts.union(spark.createDataFrame(list(KNOWN_DIGESTS), "license_id string, canonical_sha256 string"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, canonical_sha256, license_id, is_license of each row."""
    if known is None:
        digests, few = known_digests(docs.sparkSession), True
    else:
        digests = known.where(F.col("text").isNotNull()).select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
        digests = digests.select("license_id", F.sha2("form", 256).alias("canonical_sha256"))
        few = known.limit(LARGEST_BROADCAST + 1).count() <= LARGEST_BROADCAST
    digests = digests.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    if few:
        digests = F.broadcast(digests)
    form = F.transform(F.array(canonical(F.col(text_col))), lambda f: F.struct(F.when(f == "", 0).otherwise(F.length(f) - F.length(F.replace(f, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), F.sha2(f, 256).alias("sha")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.get(form, F.lit(0)).alias("form")).select("doc_id", F.col("form.n_words").alias("n_words"), F.col("form.sha").alias("canonical_sha256"))
    return rows.join(digests, "canonical_sha256", "left").select("doc_id", "n_words", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def oracle() -> str:
    """The same, over lists of lines and words."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    after = r"^[ \t/*#;-]*(copyright|copr\.)[ \t:,]"
    low = "translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    statement = (
        rf"regexp_matches(x, '^[ \t/*#;-]*(©|\(c\)[ \t]*([0-9<\[{{©]|copyright))') OR regexp_matches(x, '{after}*(©|\(c\)|[0-9<\[{{])')"
        rf" OR (regexp_matches(x, '{after}+\pL') AND NOT regexp_matches(x, '{after}+({'|'.join(TEXT_WORDS)})([^a-z]|$)'))"
    )
    lines = f"list_filter(string_split({low}, chr(10)), lambda x: NOT ({statement}))"
    reserved = " OR ".join(f"(w[i - {k}:i - {k} + 2] = ['all', 'rights', 'reserved'])" for k in range(3))
    single = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS if " " not in a)
    form = rf"""
SELECT KEY, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ('holder', 'holders') AND w[i - 1] = 'copyright' THEN replace(x, 'hold', 'own') ELSE coalesce(MAP {{{single}}}[x], x) END), ' ') AS f
FROM (SELECT KEY, list_filter(w, lambda x, i: NOT ({reserved})) AS w
  FROM (SELECT KEY, regexp_extract_all(array_to_string({lines}, ' '), '[a-z0-9\x{{0080}}-\x{{10FFFF}}]+') AS w FROM SOURCE))"""
    of = lambda key, source: form.replace("KEY", key).replace("SOURCE", source)
    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    digests = ", ".join(f"({quoted(i)}, {quoted(h)})" for i, h in KNOWN_DIGESTS)
    return f"""
WITH named AS ({of("i", f"(VALUES {values}) AS k(i, t)")}),
known AS (SELECT h, min(i) AS license_id FROM (SELECT i, sha256(f) AS h FROM named UNION ALL SELECT i, h FROM (VALUES {digests}) AS g(i, h)) GROUP BY h),
d AS ({of("doc_id", "(SELECT doc_id, text AS t FROM documents)")})
SELECT doc_id, CAST(CASE WHEN f = '' THEN 0 ELSE len(string_split(f, ' ')) END AS BIGINT) AS n_words, sha256(f) AS canonical_sha256, license_id, license_id IS NOT NULL AS is_license
FROM d LEFT JOIN known ON sha256(d.f) = known.h
"""
