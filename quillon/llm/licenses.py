"""License scans by canonical digest: whole texts, normalised, are joined by hash with known licences.

Canonical form: lines that say whose copyright it is and the words "all rights reserved" go, A-Z become a-z, every run of characters other
than letters and digits is one blank, and words with equivalent spellings are written one way.  Two texts with the same
canonical form are the same licence; their SHA-256 digests are equal, and those are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words that licence guidelines hold to be equivalent, and the way they are written here.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The word before these is part of a licence's sentence; it gets a mark, so that no line is taken for a copyright line.
GUARD = r"copyright([ \t\n*#/;-]+(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|doctrines?|permissions?|and|or|in|is|on|to|of|for|that|which)([^a-z]|$))"
MARK = "\x01"
#: Lines that say whose copyright it is, with or without a year.
COPYRIGHT = r"(^|\n)[ \t*#/;-]*((some[ \t]+)?(portions|parts)[ \t]+)?(copyright([ \t]*(\(c\)|©|:|,)|[ \t]+)[^\n]*|\(c\)[ \t]*(copyright|©|[0-9]{4})[^\n]*|©[^\n]*)"
RESERVED = r"all rights reserved"
NOT_WORD = r"[^\p{L}\p{N}]+"

# Public licence texts.
PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_TEXTS = {
    "MIT": [PERMISSION],
    "ISC": [f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_END}"],
    "0BSD": [f"{ISC_GRANT}.\n\n{ISC_END}"],
    "BSD-2-Clause": [BSD_START + BSD_END],
    "BSD-3-Clause": [BSD_START + BSD_THIRD + BSD_END],
    "Zlib": [ZLIB],
    "Apache-2.0-notice": [APACHE_NOTICE],
    "MPL-2.0-notice": [MPL_NOTICE],
}
# Titles that stand above these texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)", "The MIT License", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"],
}
for _id in ("BSD-2-Clause", "BSD-3-Clause"):
    # Clauses with bullets instead of numbers; a bullet is no word.
    _TEXTS[_id].append("\n".join(x[3:] if x[:3] in ("1. ", "2. ", "3. ") else x for x in _TEXTS[_id][0].split("\n")))
#: (id, text) of the short licences that scan() knows unless it is given others: with each title, and without.
KNOWN = [(i, t if title is None else f"{title}\n\n{t}") for i, texts in _TEXTS.items() for t in texts for title in (None, *TITLES.get(i, ()))]

# SHA-256 of the canonical form of whole licence texts as their stewards publish them.
DIGESTS = {
    "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2": "Apache-2.0",
    "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause-UC",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2",
    "8d636e2e2f248f9b102e9d9f78337901ec8bca3bfe91434cdcf261a01bf305b1": "GFDL-1.2",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3",
    "8b8b57bd195ed50d50edb5da1dd173b409fb9b075910c69726be7d0363c40008": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}


def canonical(text: Column) -> Column:
    """The canonical words of a text, joined by one blank; of a null, an empty string."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, GUARD, f"copyright{MARK}$1"), COPYRIGHT, "\n"), RESERVED, " ")
    words = F.filter(F.split(bare, NOT_WORD), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(list(SPELLINGS)), F.element_at(table, w)).otherwise(w)), " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """canonical_sha256, license_id of known licences: a table (license_id, text), or rows of it; without it, KNOWN and
    DIGESTS.  Of several ids for a text, the least.  Null and empty texts, and rows without id, are none."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(KNOWN if known is None else known, "license_id string, text string")
    rows = rows.select("license_id", canonical(F.col("text")).alias("c")).where("c <> '' AND license_id IS NOT NULL")
    rows = rows.select("license_id", F.sha2("c", 256).alias("canonical_sha256"))
    if known is None:
        rows = rows.union(spark.createDataFrame([(i, d) for d, i in DIGESTS.items()], rows.schema))
    return rows.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, canonical_sha256 and license_id, null where the whole text is no known licence.

    known: canonical_sha256 (each once) and license_id.  Spark broadcasts it if it is below its size limit for that, and
    shuffles both sides by digest if not.  Null and empty texts are no licence; rows that repeat, or have no id, give a
    result each; other columns of docs, of whatever name, are not read; a text of any length is taken whole.
    """
    made = docs.select(F.col(doc_id), F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"))
    return made.join(known, "canonical_sha256", "left").select(doc_id, "canonical_sha256", "license_id")
