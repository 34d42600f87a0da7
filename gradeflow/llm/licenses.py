"""Licence scan by canonical digests, in DataFrame functions only.

Texts are normalised in case, punctuation, copyright lines and equivalent spellings; the
digest of the whole normalised text is looked up among those of known licences. Lines that
are a known notice by themselves are looked up in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.catalog import register

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Known licence texts and short notices, as published.
LICENSES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted.\n" + _ISC_END),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
     "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
     "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
     "all present and future rights to this software under copyright law.\n" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
     + "\nFor more information, please refer to <https://unlicense.org>"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
]
# One-line notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# Spellings that mean the same, after case folding.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"),
             ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("https:", "http:"), ("all rights reserved", " "),
             ("\u2018", " "), ("\u2019", " "), ("\u201c", " "), ("\u201d", " "), ("&", " and ")]
#: Lines that are copyright notices: the word with a year, a sign or a placeholder after it, or the sign alone in front.
COPYRIGHT = r"(^|\n)[ \t]*(copyright[^\n]*([0-9]{4}|\(c\)|\x{A9}|<year>|[\[{]year[\]}]|[\[{]yyyy[\]}])|\(c\)|\x{A9})[^\n]*"
#: A first line that is the title of a licence, if more text follows.
TITLE = r"^[ \t\r\n]*[^\n]{0,60}license[^\n]{0,20}\n[ \t\r\n]*([^ \t\r\n])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of all else become one blank.
OTHER = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
# Digests of the canonical form of longer licences, from the files that their publishers give out.
DIGESTS = [
    ("Apache-2.0", "46b64fd2049c7430fd2d0915941ac7a7"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "abc0f949f6a0be22990ee5efd22e5d3d"),
    ("GFDL-1.3", "1cedde6c4073f7610c0a5ffd1d0bedc3"),
    ("GPL-1.0", "37568ce4cada0816ecc642efe89eac4e"),
    ("GPL-2.0", "c86b7e05f69c4ae379e8486562dd20f1"),
    ("GPL-3.0", "0ab054ab82a1e6c1e8899e88dba6a5c9"),
    ("LGPL-2.0", "7635abe16d4f0e5d50aa8f53dc87c1dc"),
    ("LGPL-2.1", "469b325e1e3630601f3dd2ef6d91cd19"),
    ("LGPL-3.0", "33fad1678ccee0a0d16f8788ad08749e"),
    ("MPL-1.1", "0f5ace3e5ce8e4299b08c1efc8778e48"),
    ("MPL-2.0", "0fd73770a20040e1628fb07465e54b5c"),
]
#: What any notice must hold, in lower case.
HINT = "licen"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no title, one spelling, words joined by one blank."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, "$1")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(out, TITLE, "$1"), OTHER, " "))


def known_digests(spark, known) -> DataFrame:
    """(license, digest) of the fixed texts; the table has a row per text."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select("license", F.md5(canonical(F.col("text"))).alias("digest")).distinct()


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", licenses=LICENSES, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """One row per row of ``docs``: key, digest, license of the whole text or null, notices in its lines.

    ``notices`` are the distinct names in order, joined by commas, empty if there are none.
    Null texts have a null digest, no licence and no notices; an empty text has the digest
    of the empty text, which is no licence. Repeated rows are scanned one by one; other
    columns are not read.
    """
    spark = docs.sparkSession
    known = known_digests(spark, [*licenses, *notices])
    if digests:
        known = known.unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    lines = [(r["digest"], r["license"]) for r in known_digests(spark, notices).orderBy("digest").collect()]
    names = F.create_map(*[F.lit(x) for pair in lines for x in pair])
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    hinted = F.filter(F.split("_text", "\n"), lambda x: F.contains(F.translate(x, UPPER, LOWER), F.lit(HINT)))
    found = F.array_compact(F.transform(hinted, lambda x: names[F.md5(canonical(x))]))
    rows = rows.select(key, F.md5(canonical(F.col("_text"))).alias("digest"),
                       F.coalesce(F.array_join(F.array_sort(F.array_distinct(found)), ","), F.lit("")).alias("notices"))
    # a fixed table of a few rows
    return rows.join(F.broadcast(known), "digest", "left").select(key, "digest", "license", "notices")


def _canonical_sql(x: str) -> str:
    x = rf"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '\1', 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    x = rf"regexp_replace({x}, '{TITLE}', '\1')"
    return f"trim(regexp_replace({x}, '{OTHER}', ' ', 'g'))"


def _sql() -> str:
    quoted = lambda rows: ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in rows)
    return rf"""
    with k(name, body) as (values {quoted([*LICENSES, *NOTICES])}), n(name, body) as (values {quoted(NOTICES)}), w(name, digest) as (values {quoted(DIGESTS)}),
    kd as (select distinct name, md5({_canonical_sql('body')}) digest from k union select name, digest from w),
    nd as (select distinct name, md5({_canonical_sql('body')}) digest from n),
    l as (select doc_id, unnest(string_split(text, chr(10))) x from documents),
    f as (select doc_id, string_agg(distinct name, ',' order by name) notices
          from (select doc_id, md5({_canonical_sql('x')}) digest from l where contains(translate(x, '{UPPER}', '{LOWER}'), '{HINT}')) join nd using (digest) group by doc_id),
    d as (select doc_id, md5({_canonical_sql('text')}) digest from documents)
    select d.doc_id, d.digest, kd.name license, coalesce(f.notices, '') notices
    from d left join kd using (digest) left join f using (doc_id)"""


@register("op9_license_scan", _sql())
def op9(spark, folder: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{folder}/documents.parquet"))
