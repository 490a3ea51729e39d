"""License notices in texts, by patience alignment with templates.

Words that a template holds once point at places where it may stand in a text: each occurrence proposes where the template would begin. Places
with enough proposals are aligned: words unique to both sides anchor, the longest increasing subsequence of anchors stays, and the gaps
between them are aligned the same way, after equal words at their ends. The share of the template's words that are aligned is the coverage.
The words that tell a license from its neighbours (family, version, variant) have to be aligned, and no other variant word may stand between
them. Where templates of different licenses overlap, the one with the most aligned words gives the name.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from marketlens.llm.common import map_texts

WORD = re.compile(r"[A-Za-z0-9]+")
MIN_COVERAGE = .8
#: Words too common to point at a place.
COMMON = frozenset("the of and to in a is for this that with under by or be as on are not no any it all version from".split())
#: Public notices by name.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}
#: Words of a title that don't tell it from another one.
SOFT = frozenset("the license licence version v international public domain dedication universal".split())
#: Words that make another license of the one they stand in.
VARIANTS = frozenset("lesser library affero nc sa nd noncommercial sharealike noderivatives noderivs mit bsd apache".split())
#: Usual titles by name, as in "under the ...".
TITLES = {
    "apache-1.1": ["Apache License 1.1"], "apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "mit": ["MIT License"], "isc": ["ISC License"], "zlib": ["zlib License"], "bsl-1.0": ["Boost Software License, Version 1.0"], "unlicense": ["Unlicense"], "wtfpl": ["WTFPL"],
    "bsd": ["BSD License"], "bsd-2-clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "mpl": ["MPL License", "Mozilla Public License"], "mpl-1.1": ["Mozilla Public License 1.1", "MPL 1.1"], "mpl-2.0": ["Mozilla Public License 2.0", "MPL 2.0"],
    "epl-1.0": ["Eclipse Public License 1.0"], "epl-2.0": ["Eclipse Public License 2.0"], "artistic-2.0": ["Artistic License 2.0"], "cc0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
}
#: The GNU family and its versions, the parts of the Creative Commons names and their versions.
GNU = {"gpl": ("General Public License", ("2", "3")), "lgpl": ("Lesser General Public License", ("2.1", "3")), "agpl": ("Affero General Public License", ("3",))}
CC_PARTS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC_VARIANTS, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("2.0", "2.5", "3.0", "4.0")
#: The parts that BSD texts share, and whole texts.
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
NO_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
TEXTS = {
    "mit-text": f"{TEMPLATES['mit']} {WARRANTY}",
    "bsd-2-clause-text": f"{TEMPLATES['bsd-2-clause']} {DISCLAIMER}",
    "bsd-3-clause": f"{TEMPLATES['bsd-2-clause']} 3. {NO_ENDORSEMENT}",
    "bsd-3-clause-text": f"{TEMPLATES['bsd-2-clause']} 3. {NO_ENDORSEMENT} {DISCLAIMER}",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Words of a text that have to be aligned; those of a notice or header come from its title.
TOLD_BY = {
    "apache-2.0-notice": "apache 2 0", "mit-notice": "mit", "gpl-3.0-notice": "gnu general public 3", "cc-by-nc-4.0-notice": "cc by nc 4 0", "all-rights-reserved": "all rights reserved",
    "apache-2.0-header": "apache 2 0", "gpl-3.0-header": "gnu general public 3", "mpl-2.0-header": "mozilla 2 0", "bsd-3-clause": "neither endorse promote", "bsd-3-clause-text": "neither endorse promote",
}


def made_templates() -> list[tuple[str, str, frozenset[str]]]:
    """(name, text, words that have to be aligned) of the fixed texts, and of notices and headers made from titles."""
    out = [(name, text, frozenset(TOLD_BY.get(name, "").split())) for name, text in (TEMPLATES | TEXTS).items()]
    titles = [(name, title) for name, some in TITLES.items() for title in some]
    for family, (title, versions) in GNU.items():
        titles += [(family, f"GNU {title}"), (family, f"GNU {family}"), (family, family)]
        for v in versions:
            full = v if "." in v else f"{v}.0"
            titles += [(f"{family}-{full}", t) for t in (f"GNU {title} version {v}", f"GNU {family} version {v}", f"{family} version {v}", f"{family} {full}", f"{family}v{v}")]
            if (family, v) != ("gpl", "3"):
                text = TEMPLATES["gpl-3.0-header"].replace("General Public License", title).replace("version 3", f"version {v}")
                out.append((f"{family}-{full}-header", text, told(f"GNU {title} {v}") | {"general", "public"}))
    for variant in CC_VARIANTS:
        parts = variant.split("-")
        for v in CC_VERSIONS:
            titles += [(f"cc-{variant}-{v}", t) for t in (f"CC {variant} {v}", f"Creative Commons {'-'.join(CC_PARTS[p] for p in parts)} {v}")]
    return out + [(f"{name}-notice", f"under {title}", told(title)) for name, title in titles]


def told(title: str) -> frozenset[str]:
    return frozenset(words_of(title)) - SOFT


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails, at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k:k + 1] = [v]
        at[k:k + 1] = [i]
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words of a and b, increasing on both sides."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if right[w] == 1}
        both = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if left[w] == 1 and w in place]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            continue
        pairs += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    pointers: dict[str, int]
    must: frozenset[str]

    @classmethod
    def of(cls, name: str, text: str, must: frozenset[str] = frozenset()) -> Template:
        """Numbers point at a place only where the template has no other words that do."""
        words = words_of(text)
        count = Counter(words)
        once = {w: j for j, w in enumerate(words) if count[w] == 1 and w not in COMMON}
        return cls(name, words, {w: j for w, j in once.items() if not w.isdigit()} or once, must)

    def tells(self, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether all words of `must` are aligned, without a foreign variant word between the first and the last of them."""
        own = [i for i, j in pairs if self.words[j] in self.must]
        if len({words[i] for i in own}) < len(self.must):
            return False
        aligned = {i for i, _ in pairs}
        return not own or not any(words[i] in VARIANTS and i not in aligned for i in range(own[0], own[-1] + 1))


def places(words: list[str], templates: list[Template], index: dict[str, list[tuple[int, int]]], least: float) -> dict[int, list[int]]:
    """Template number -> where it may begin: proposals that lie within a quarter of its length count together."""
    proposals = defaultdict(list)
    for i, w in enumerate(words):
        for t, j in index.get(w, ()):
            proposals[t].append(i - j)
    out = {}
    for t, starts in proposals.items():
        size = len(templates[t].words)
        need, reach, found = max(1, round(least * len(templates[t].pointers) / 2)), max(2, size // 4), []
        starts.sort()
        k = 0
        while k < len(starts):
            end = k
            while end < len(starts) and starts[end] <= starts[k] + reach:
                end += 1
            if end - k >= need:
                found.append(starts[(k + end) // 2])
                k = end
            else:
                k += 1
        out[t] = found
    return out


def license_of(name: str) -> str:
    """Name of the license that a template tells of."""
    return re.sub("-(notice|header|text)$", "", name)


def apart(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Of overlapping (aligned words, first, last, name, coverage) the one with most aligned words, then coverage, then by name; in order of place.

    A notice inside a longer text of the same license stays beside it.
    """
    out, outer, owner, by_name = [], [], [], defaultdict(list)

    def slot(taken, f):
        """Where f goes among disjoint places, and whether it is free there."""
        k = bisect_left(taken, (f[1], f[1]))
        k -= k > 0 and taken[k - 1][1] >= f[1]
        return k, k == len(taken) or taken[k][0] > f[2]

    for f in sorted(found, key=lambda f: (-f[0], -f[4], f[1], f[3])):
        k, free = slot(outer, f)
        n, own_free = slot(by_name[f[3]], f)
        inside = not free and outer[k][0] <= f[1] and f[2] <= outer[k][1] and owner[k] == license_of(f[3])
        if free:
            outer.insert(k, (f[1], f[2]))
            owner.insert(k, license_of(f[3]))
        if free or inside and own_free:
            by_name[f[3]].insert(n, (f[1], f[2]))
            out.append(f)
    return sorted(out, key=lambda f: (f[1], f[3]))


def scan(text: str, templates: list[Template], index: dict[str, list[tuple[int, int]]], min_coverage: float) -> list[tuple[str, int, int, float]]:
    """(template, start, end, coverage) of each notice, in code points, by start, then name. Places of different licenses don't overlap."""
    words = words_of(text)
    present = set(words)
    at = {t: p for t, p in places(words, templates, index, min_coverage).items() if p and templates[t].must <= present}
    found = []
    for t, starts in at.items():
        template, done = templates[t], 0
        slack = max(4, len(template.words) // 4)
        for s in starts:
            a0, a1 = max(done, s - slack), min(len(words), s + len(template.words) + slack)
            pairs = [(a0 + i, j) for i, j in patience(words[a0:a1], template.words)]
            if pairs and len(pairs) >= min_coverage * len(template.words) and template.tells(words, pairs):
                found.append((len(pairs), pairs[0][0], pairs[-1][0], template.name, len(pairs) / len(template.words)))
                done = pairs[-1][0] + 1
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    return [(name, spans[first][0], spans[last][1], coverage) for _, first, last, name, coverage in apart(found)]


def license_scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Adds notices (name, start, end, coverage) of each whole text to its row; own `templates` are texts by name, none of whose words is required.

    Null, empty and wordless texts have none; of several copies in a text each counts. Rows come through one by one, so repeated ones, null ids and an empty table
    need nothing special.
    """
    made = [Template.of(*t) for t in (made_templates() if templates is None else templates.items())]
    index = defaultdict(list)
    for t, template in enumerate(made):
        for w, j in template.pointers.items():
            index[w].append((t, j))

    def run(texts):
        found = [scan(t.decode("utf-8", "replace"), made, index, min_coverage) for t in texts]
        return [[[dict(zip(("name", "start", "end", "coverage"), n)) for n in f] for f in found]]

    return map_texts(docs, text, "notices array<struct<name:string,start:int,end:int,coverage:double>>", run, docs.columns if keep is None else keep)
