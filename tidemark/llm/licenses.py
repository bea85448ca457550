"""License scans by canonical digests, in SQL functions alone.

A text and its known licences are brought to one form (case, punctuation, white space, copyright lines, equivalent spellings)
and compared by digest. Looked up are the whole text, the whole text without its first paragraph (a title), each run of
paragraphs that is as long as a known text, and each line and sentence, so that a licence inside a longer document is found
too. Texts and units without any of the words TRIGGER are not canonicalised: every known licence has one of them in its canonical
form, and a word of letters is in the canonical form only if it is in the text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, settle, small

#: Short licences in full.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
TEXTS |= {
    "BSD-3-Clause": TEXTS["BSD-2-Clause"].replace(
        "THIS SOFTWARE IS PROVIDED",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED",
    ),
    "0BSD": TEXTS["ISC"].replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    **{
        f"{short}-{version}.0": f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
        for short, name, version in (("GPL", "General Public License", 2), ("GPL", "General Public License", 3), ("LGPL", "Lesser General Public License", 3), ("AGPL", "Affero General Public License", 3))
    },
}
#: Names that notices give to licences.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache 2.0 license"),
    "MIT": ("the MIT License", "MIT License", "MIT", "the terms of the MIT License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "BSD-2-Clause", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "BSD-3-Clause", "the New BSD License"),
    "ISC": ("the ISC License", "ISC"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPL-3.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
    "CC0-1.0": ("CC0 1.0", "CC0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
}
PHRASES = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "This work is released under {}", "This software is licensed under {}", "This software is released under {}", "This project is licensed under {}", "Distributed under {}", "SPDX-License-Identifier: {}")
#: Spellings that count as one, tried in this order on lower-case text.
SPELLINGS = (("licenc", "licens"), ("sub-licens", "sublicens"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("http://", "https://"), ("&", " and "), (" v. 2", " version 2"), (" v2", " version 2"), (" v3", " version 3"))
#: Lines that tell who holds the copyright, and when.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<|\[)|\(c\)|©|all rights reserved)[^\n]*$"
#: Every known licence has one of these in its canonical form, and so in its text.
TRIGGER = r"(?i)licen[cs]|released|distributed|permission|redistribution"
PUNCTUATION = r"[^\p{L}\p{N}]+"
PARAGRAPH = r"\n[ \t]*\n\s*"
#: What a line of a comment begins with; block comments need no mark, since lines of punctuation alone are blank.
MARK = r"[ \t]*(?:#|//|;|--|%)"
#: Numbers and letters of list items at the start of a line, in lower case.
BULLET = r"(?m)^[^a-z0-9\n]*(?:[0-9]{1,2}|[a-h])[.)][ \t]+"
#: Places where texts name a holder, in canonical form, and what stands there instead.
HOLDERS = (
    ("neither the names? of .{1,160}? nor the names of (?:its|their|any|the) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("software is provided by .{1,160}? as is", "software is provided by the copyright holders and contributors as is"),
    ("in no event shall .{1,160}? be liable", "in no event shall the authors or copyright holders be liable"),
)
#: Smaller units that are looked up: the separators that a text is split at.
UNITS = (r"\n", r"[.!?][ \t\n]+")
#: Paragraphs (of more than copyright lines) in the known texts.
LENGTHS = sorted({len(re.split(PARAGRAPH, text)) for text in TEXTS.values()} - {1})


def canonical(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(text), F.lit(COPYRIGHT), F.lit(" ")), F.lit(BULLET), F.lit(" "))
    text = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SPELLINGS, text)
    text = F.trim(F.regexp_replace(text, F.lit(PUNCTUATION), F.lit(" ")))
    return reduce(lambda t, h: F.regexp_replace(t, F.lit(h[0]), F.lit(h[1])), HOLDERS, text)


def unwrapped(text: Column) -> Column:
    """The text with a blank line wherever a paragraph ends: lines of punctuation alone and those that name an interpreter are blank, and comments and other lines stand apart."""
    text = F.regexp_replace(text, F.lit(r"(?md)^(?:[^\p{L}\p{N}\n]+|#![^\n]*)$"), F.lit(""))
    text = F.regexp_replace(text, F.lit(rf"(?md)^({MARK}[^\n]*)\n(?!{MARK})"), F.lit("$1\n\n"))
    return F.regexp_replace(text, F.lit(rf"(?md)^((?!{MARK})[^\n]+)\n(?={MARK})"), F.lit("$1\n\n"))


def notices() -> list[tuple[str, str]]:
    """(license, text) of all known texts and notices."""
    return [*TEXTS.items(), *((k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES)]


def known(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """license, digest of all known texts and notices, and of more (license, text): texts that are known besides, as long as one likes."""
    texts = spark.createDataFrame(notices(), "license string, text string")
    return (texts if more is None else texts.unionByName(more.select("license", "text"))).select("license", F.md5(canonical(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def _runs(parts: Column) -> Column:
    """The paragraphs (canonical, none empty) one by one, and runs of them as long as a known text."""

    def of(n: int) -> Column:
        starts = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n), " "))

    return F.concat(parts, *[of(n) for n in LENGTHS])


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, whole_license, licenses, n_units for each row of (doc_id, text).

    text_digest: md5 of the whole canonical text where a licence is in reach (the trigger words), else null. whole_license:
    the licence that the whole text is, or all but its first paragraph. licenses: all that the text, a run of its paragraphs, a
    line or a sentence of it is, sorted and joined by commas; empty if none. n_units: how many distinct units are licences.
    A paragraph ends at a blank line, at a line of punctuation alone and where a comment begins or ends; lines may end as on any system,
    list items may be numbered or not, and whoever is named as holder is passed over. more (license, text) are further texts
    to find, as wholes or without their first paragraph; they are broadcast as digests up to MOST_BROADCAST.
    Null and empty texts have none; rows that repeat a doc_id are scanned each. An empty table gives an empty one.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\r\n?"), F.lit("\n")).alias("text"))

    def found(parts: Column) -> Column:
        smaller = [F.transform(F.filter(F.split("text", sep), lambda u: u.rlike(TRIGGER)), lambda u: F.md5(canonical(u))) for sep in UNITS]
        body = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
        whole = F.md5(F.array_join(parts, " "))
        units = F.array_distinct(F.concat(F.array(whole, F.md5(body)), F.transform(_runs(parts), lambda u: F.md5(u)), *smaller))
        return F.struct(whole.alias("whole"), F.md5(body).alias("body"), units.alias("digests"))

    # digests in the row, so nothing but the few hits is shuffled or joined
    parts = F.filter(F.transform(F.split(unwrapped(F.col("text")), PARAGRAPH), canonical), lambda u: u != "")
    held = base.select("doc_id", F.when(F.col("text").rlike(TRIGGER), let(parts, found)).alias("f"), F.monotonically_increasing_id().alias("_row"))
    hits = held.select("doc_id", "_row", F.col("f.whole").alias("text_digest"), F.col("f.body").alias("body"), F.explode_outer("f.digests").alias("digest"))
    digests = known(docs.sparkSession, more)
    hits = hits.join(F.broadcast(digests) if more is None else small(settle(digests, "known")), "digest", "left")
    whole = [F.min(F.when(F.col("digest") == F.col(c), F.col("license"))) for c in ("text_digest", "body")]
    return hits.groupBy("_row", "doc_id", "text_digest").agg(
        F.coalesce(*whole).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count("license").alias("n_units"),
    ).drop("_row")
