"""License scans with DataFrame operations only: MinHash bands retrieve templates, exact containment verifies them.

For each template, windows of its length in word shingles overlap by three quarters over the whole text. A window and
the template have minima of the same hash functions in bands; a window that agrees in a band is a candidate, and the
share of the template's shingles in it and one step round it is then computed exactly. The number of bands follows from
the similarity that the worst placed window of a match still has, so that nearly every match is retrieved.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.secrets import _within

#: Parts that several license texts share, as their publishers word them.
_SOFTWARE = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"

#: Complete texts of licenses and the longer notices by which works state theirs, as their publishers word them.
TEXTS = {
    "MIT": f"{_SOFTWARE}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-0": f"{_SOFTWARE}. {_AS_IS}",
    "X11": (
        f"{_SOFTWARE}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")
        + " Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without "
        "prior written authorization from the X Consortium."
    ),
    "NCSA": (
        f"{_SOFTWARE.replace('deal in', 'deal with')}, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other "
        "materials provided with the distribution. Neither the names of the copyright holders, nor the names of its contributors may be used to endorse or promote products derived from this "
        f"Software without specific prior written permission. {_AS_IS.replace('DEALINGS IN', 'DEALINGS WITH')}"
    ),
    "BSD-2-Clause": f"{_BSD} {_BSD_AS_IS}",
    "BSD-3-Clause": (
        f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        f"permission. {_BSD_AS_IS}"
    ),
    "BSD-4-Clause": (
        f"{_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
        "4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        f"{_BSD_AS_IS}"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        f"appear in all copies. {_ISC_AS_IS}"
    ),
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_AS_IS}",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin "
        "of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not "
        "be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
        "object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
        + " For more information, please refer to"
    ),
    "PostgreSQL": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above "
        "copyright notice and this paragraph and the following two paragraphs appear in all copies. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, "
        "INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE COPYRIGHT HOLDER HAS BEEN ADVISED OF THE POSSIBILITY "
        "OF SUCH DAMAGE. THE COPYRIGHT HOLDER SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE "
        "SOFTWARE PROVIDED HEREUNDER IS ON AN \"AS IS\" BASIS, AND THE COPYRIGHT HOLDER HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS."
    ),
    "curl": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        f"in all copies. {_AS_IS.replace('NONINFRINGEMENT', 'NONINFRINGEMENT OF THIRD PARTY RIGHTS')} Except as contained in this notice, the name of a copyright holder shall not be used in "
        "advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder."
    ),
    "WTFPL": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO "
        "PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        f"License, or (at your option) any later version. {_GNU} GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; "
        "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        f"License, or (at your option) any later version. {_GNU} GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version "
        f"2.1 of the License, or (at your option) any later version. {_GNU.replace('program', 'library')} GNU Lesser General Public License for more details. You should have received a copy of the "
        "GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        f"of the License, or (at your option) any later version. {_GNU} GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License "
        "along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
#: Lines that name a license.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "licensed under a Creative Commons Attribution 4.0 International License",
}
TEMPLATES = TEXTS | NOTICES


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashed: Column, width: int) -> Column:
    """Hashes of width words from hashes of words; fewer words: one of them all; none: empty."""
    n = F.size(hashed)
    many = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*(F.element_at(hashed, i + k) for k in range(width))))
    return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>"))


def bands_needed(share: float, miss: float = 1e-3, step: float = 0.25) -> int:
    """Bands of one row so that a match of that share of the template's shingles is missed with this chance at most.

    The best placed window is off by half a step at most, so it has at least share - step / 2 of the template's
    shingles, in a union of at most the template and the window's others.
    """
    both = share - step / 2
    return ceil(log(miss) / log(1 - both / (2 - both)))


@dataclass(frozen=True)
class Template:
    name: str
    shingles: list[int]
    minima: list[int]  # by band


def _minimum(of: Column, band: int) -> Column:
    return F.array_min(F.transform(of, lambda x: F.xxhash64(x, F.lit(band))))


def prepared(spark: SparkSession, templates: dict[str, str], width: int = 5, share: float = 0.8) -> list[Template]:
    """The templates' shingles and minima, by the same expressions as those of documents."""
    bands = bands_needed(share)
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = rows.select("name", _within(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), lambda h: shingles(h, width)).alias("s"))
    rows = rows.select("name", F.array_distinct("s").alias("s"), F.array(*(_minimum(F.col("s"), b) for b in range(bands))).alias("m"))
    return [Template(r.name, sorted(r.s), list(r.m)) for r in rows.collect() if r.s]


def _literal(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def _known(templates: list[Template]) -> Column:
    """The templates as one constant: an array of (name, size, step, s: shingles, m: minima)."""
    rows = (
        f"named_struct('name', '{t.name}', 'size', {len(t.shingles)}, 'step', {max(1, len(t.shingles) // 4)}, 's', {_literal(t.shingles)}, 'm', {_literal(t.minima)})"
        for t in templates
    )
    return F.expr(f"array({', '.join(rows)})")


def matches(all_shingles: Column, t: Column, share: float) -> Column:
    """Array of (license, containment, word) of the windows that match a template; word counts from 0."""
    size, step = t["size"], t["step"]
    last = F.greatest(F.size(all_shingles) - (size - 1), F.lit(1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, step), F.array(last)))

    def retrieved(p: Column) -> Column:
        def agrees(window: Column) -> Column:
            bands = F.sequence(F.lit(0), F.when(size > 1, F.size(t["m"])).otherwise(1) - 1)
            return F.exists(bands, lambda band: F.array_min(F.transform(window, lambda x: F.xxhash64(x, band))) == F.get(t["m"], band))

        return _within(F.slice(all_shingles, p, size), agrees)

    def verified(p: Column) -> Column:
        round_ = F.when(size > 1, step).otherwise(0)
        start = F.greatest(p - round_, F.lit(1))
        held = F.size(F.array_intersect(F.slice(all_shingles, start, (p - start) + size + round_), t["s"])) / size
        return F.struct(t["name"].alias("license"), held.alias("containment"), (p - 1).alias("word"))

    return F.filter(F.transform(F.filter(starts, retrieved), verified), lambda m: m["containment"] >= share)


def runs(found: Column, size: Column) -> Column:
    """One of each run of overlapping matches, found being in order of word: the first with the largest containment."""
    empty = F.array().cast("array<struct<best:struct<license:string,containment:double,word:int>,last:int>>")

    def add(done: Column, m: Column) -> Column:
        def run(best: Column) -> Column:
            return F.array(F.struct(best.alias("best"), m["word"].alias("last")))

        now = F.get(done, F.size(done) - 1)
        better = F.when(m["containment"] > now["best"]["containment"], m).otherwise(now["best"])
        overlaps = m["word"] < now["last"] + size
        return F.when(F.coalesce(overlaps, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), run(better))).otherwise(F.concat(done, run(m)))

    return F.transform(F.aggregate(found, empty, add), lambda r: r["best"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, width: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, word): the matches of each template in each row of docs(doc_id, text).

    A match is a run of overlapping windows that have share of the template's width-word shingles or more, with what is
    a step round them; word is the place of the first of the run's windows with the largest containment, in words. A text
    without any shingle of any template is passed over: it can't match. Null, empty and unlicensed texts give no row;
    repeated rows give repeated results, a null doc_id stays null; an empty table gives an empty result; other columns
    are ignored.
    """
    known = prepared(docs.sparkSession, templates or TEMPLATES, width, share)
    every = F.expr(_literal(sorted({s for t in known for s in t.shingles})))
    none = F.array().cast("array<struct<license:string,containment:double,word:int>>")

    def all_of(all_shingles: Column) -> Column:
        own = F.filter(_known(known), lambda t: F.arrays_overlap(all_shingles, t["s"]))
        found = F.transform(own, lambda t: _within(matches(all_shingles, t, share), lambda ms: runs(ms, t["size"])))
        return F.when(F.arrays_overlap(all_shingles, every), F.flatten(found)).otherwise(none)

    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    rows = docs.select("doc_id", _within(hashed, lambda h: _within(shingles(h, width), all_of)).alias("found"))
    # outer: else the optimiser adds a filter on the array's size, which would be made twice
    rows = rows.select("doc_id", F.explode_outer("found").alias("m")).where("m IS NOT NULL")
    return rows.select("doc_id", "m.license", "m.containment", "m.word")


def best_of_each(found: DataFrame) -> DataFrame:
    """Of scan_licenses' rows, the best match of each license in each document (rows without doc_id count as one)."""
    best = F.max_by(F.struct("containment", "word"), F.struct("containment", -F.col("word"))).alias("b")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "b.containment", "b.word")
