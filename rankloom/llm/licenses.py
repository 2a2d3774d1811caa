"""Licence scan by canonical digests: a text is normalised until spellings of one licence agree, then joined by its digest.

Normal form: copyright lines go, case and punctuation go, words stand one space apart, and equivalent spellings become one. The
whole text and each of its lines are looked up among the digests of known licences and notices; nothing is matched in part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import cut, once, small

# A text without any of these has no copyright line.
_MARKS = ("copyright", "(c)", "©", "all rights reserved")
COPYRIGHT = (
    r"(?im)^[^\p{L}\n]*((portions|parts)[ \t]+copyright\b|copyright[ \t]*(\(c\)|©|:|[0-9]|<|\[)|copyright[ \t]+[^\n]*\b(19|20)[0-9][0-9]\b|"
    r"copyright[ \t]+the[ \t][^\n]*\b(authors|contributors|developers|project|team)[ \t.]*$|\(c\)[ \t]*[0-9<\[]|\(c\)[ \t][^\n]*\b(19|20)[0-9][0-9]\b|©|all rights reserved).*$"
)
WORDLESS = r"[^\p{L}\p{N}]+"
# The same within a line; a space that already stands alone is left, for speed.
_WORDLESS_IN_LINE = r"[^\p{L}\p{N}\n ][^\p{L}\p{N}\n]*| [^\p{L}\p{N}\n]+"

# Spellings that count as the same, after case and punctuation are gone (a pattern and what stands for it).
EQUIVALENT = (
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\b(favo|hono|behavio|colo|labo)ur", "$1r"),
    (r"\b(author|organ|recogn|util|real|initial|modern|custom)is(e|ed|es|ing|ation)\b", "$1iz$2"),
    (r"\b(acknowled|jud)gement", "$1gment"),
    (r"\bhttps?\b", "http"),
    (r"\bwhilst\b", "while"),
)

# Public licence texts and usual notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Longer public licences, whole and up to the end of their terms, by the first letters, size and digest of their normal forms.
DIGESTS = (
    ("Apache-2.0", "apa", 8871, "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", "apa", 9887, "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "the", 5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause-UC", "red", 1361, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "cre", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu", 19578, "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "gnu", 22013, "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "gnu", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "gnu", 9415, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "gnu", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "gnu", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "gnu", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "gnu", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "gnu", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "gnu", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "gnu", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "gnu", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "gnu", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "moz", 22447, "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "moz", 14342, "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)


def bare(lower: Column) -> Column:
    """The words of every line of a lower-case text one space apart, without copyright lines and punctuation; lines stay lines."""
    marked = reduce(lambda c, m: c | F.contains(lower, F.lit(m)), _MARKS[1:], F.contains(lower, F.lit(_MARKS[0])))
    own = F.when(marked, F.regexp_replace(lower, COPYRIGHT, "")).otherwise(lower)
    return F.regexp_replace(own, _WORDLESS_IN_LINE, " ")


def one_line(words: Column) -> Column:
    """A bare text of many lines as one."""
    return F.btrim(F.regexp_replace(words, r" ?\n[ \n]*", " "))


def canonical(words: Column) -> Column:
    """Equivalent spellings of a bare text made one. One look tells most texts, which have none of them, from the others."""
    made = reduce(lambda c, e: F.regexp_replace(c, *e), EQUIVALENT, words)
    return F.when(words.rlike("|".join(p for p, _ in EQUIVALENT)), made).otherwise(words)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | DataFrame = KNOWN, digests: tuple[tuple[str, str, int, str], ...] = DIGESTS) -> DataFrame:
    """(license, start: the first three letters, size: the characters, digest) of normal forms: of licence texts (license, unit), and such rows as they are."""
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, unit string")
    made = canonical(one_line(bare(F.lower("unit"))))
    own = once(table, _made=made).select("license", F.left("_made", F.lit(3)).alias("start"), F.length("_made").alias("size"), F.sha2("_made", 256).alias("digest"))
    return own.unionByName(spark.createDataFrame(list(digests), "license string, start string, size int, digest string")).distinct()


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", known: tuple[tuple[str, str], ...] | DataFrame = KNOWN, digests: tuple[tuple[str, str, int, str], ...] = DIGESTS) -> DataFrame:
    """Every unit that is a known licence or notice: id, unit (0: the whole text, n: its n-th line), license, digest.

    Null and empty texts and lines without words are none. Repeated rows give repeated results, an empty table none; other columns
    do not matter. ``known`` lists licence texts, as a tuple or as a table (license, unit) of any size; ``digests`` known normal forms.
    """
    low = once(df.where(F.col(text).isNotNull()).select(id_col, text), _low=F.lower(F.col(text))).select(id_col, "_low")
    bared = once(low, _bare=bare(F.col("_low"))).select(id_col, "_bare")
    units = F.concat(F.array(one_line(F.col("_bare"))), F.split("_bare", "\n"))
    words = bared.select(id_col, F.posexplode(units).alias("unit", "_u")).withColumn("_words", F.btrim("_u"))
    # No spelling loses half of a text or changes its first three letters: what is twice as long as every known licence, or starts
    # unlike all of them, is none, and skips spellings and digest.
    listed = cut(known_digests(df.sparkSession, known, digests))
    longest = listed.agg(F.max("size")).first()[0] or 0
    words = words.where(F.length("_words").between(1, 2 * longest))
    starts = listed.groupBy("start").agg(F.max("size").alias("most"))
    words = words.join(small(starts), (F.left("_words", F.lit(3)) == F.col("start")) & (F.length("_words") <= 2 * F.col("most")), "left_semi")
    found = words.select(id_col, "unit", F.sha2(canonical(F.col("_words")), 256).alias("digest"))
    return found.join(small(listed.select("license", "digest")), "digest").select(id_col, F.col("unit").cast("long").alias("unit"), "license", "digest")
