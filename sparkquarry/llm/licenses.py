"""Licence scans: passages compared to licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised alike: A-Z lower-cased, words of letters, digits and non-ASCII.
Passages of a template's length that begin with one of its bigrams (or end with the text) are compared
with it over the sets of bigrams. Sizes bound the coefficient, so templates too long for the text, and
passages with too few of the template's bigrams, are left out first; the others are counted by one
window that slides over the text, so a text takes time in proportion to its length for each template.
A version is reported only where the passage holds its number, and the opening that all BSD licences
share as "BSD" only where no passage tells the clause count.

The templates are notices, and whole texts of short licences; templates_from() reads whole texts of
any length from a folder, to be handed to licenses().
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K

THRESHOLD = 0.8

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = _BSD + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.' + _AS_IS
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.' + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
_BSL = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'
_APACHE = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

# Notices of public licences, and whole texts of short ones.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0' + _APACHE],
    "MIT": [_MIT, "Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." + _GNU_END],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version." + _GNU_END],
    "LGPL-3.0": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL-2.0": ["under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL-2.1": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "EPL-1.0": ["made available under the terms of the Eclipse Public License v1.0", "Eclipse Public License - v 1.0"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License v2.0", "Eclipse Public License - v 2.0"],
    "Zlib": [_ZLIB, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "BSD": [_BSD],
    "BSD-2-Clause": [_BSD_2 + _BSD_END, "Licensed under the BSD 2-Clause License"],
    "BSD-3-Clause": [_BSD_2 + _BSD_3 + _BSD_END, _BSD_2 + _BSD_3, "Licensed under the BSD 3-Clause License"],
    "ISC": [_ISC, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0"],
    "BSL-1.0": [_BSL, "Distributed under the Boost Software License, Version 1.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "Unlicense": [_UNLICENSE, "This is free and unencumbered software released into the public domain"],
}

_SPDX = ("BSD-2-Clause", "BSD-3-Clause", "0BSD", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "Apache-2.0", "MIT", "MPL-2.0", "EPL-1.0", "EPL-2.0", "ISC", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "BSL-1.0")
for _name in _SPDX:
    TEMPLATES.setdefault(_name, []).append(f"SPDX-License-Identifier: {_name}")

#: Names that count only where no other passage overlaps.
GENERAL = frozenset({"BSD"})
_VERSION = re.compile(r"-([0-9]+)\.([0-9]+)\Z")


def templates_from(folder: str) -> dict[str, list[str]]:
    """TEMPLATES and the whole texts of a folder, each under its file's name."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for path in sorted(Path(folder).iterdir()):
        if path.is_file():
            out.setdefault(path.name, []).append(path.read_text("utf-8", "replace"))
    return out


def version_at(name: str, text: str) -> list[int]:
    """Bigrams (by their first word) of the template that hold the first mention of the licence's version, and the one that tells GNU licences apart (general, lesser, affero)."""
    v, words = _VERSION.search(name), re.findall("[a-z0-9]+", text.lower())
    if not v or v[1] not in words[1:]:
        return []
    i = words.index(v[1], 1)
    kind = [words.index("gnu")] if "gnu" in words else []
    return kind + ([i - 1, i] if words[i + 1 : i + 2] == [v[2]] else [i - 1])


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def _bigrams(text: str) -> np.ndarray:
    return K.fold(K.tokenize(*K.flat(pa.array([text])), K.ALNUM_WORDS).h, 2)


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names, self.sets, self.length, self.version, of = [], [], [], [], {}
        for name, texts in templates.items():
            for text in texts:
                h = _bigrams(text)
                if not len(h):
                    continue
                t = len(self.names)
                self.names.append(name)
                self.sets.append(set(h.tolist()))
                self.length.append(len(h) + 1)
                self.version.append({int(h[i]) for i in version_at(name, text)})
                for x in self.sets[-1]:
                    of.setdefault(x, []).append(t)
        self.keys = np.array(sorted(of), np.uint64)
        # The templates that hold a key, as one flat list.
        self.first = np.concatenate([[0], np.cumsum([len(of[int(x)]) for x in self.keys])]).astype(np.int64)
        self.of = np.array([t for x in self.keys for t in of[int(x)]], np.int64)

    def _passages(self, h: np.ndarray, t: int, where: np.ndarray):
        """(dice, first bigram) of the passages of a text (bigrams h) that are like template t; where: its places with a bigram of t, in order."""
        m, size, names = self.length[t] - 1, len(self.sets[t]), self.sets[t]
        n = min(m, len(h))
        if 2 * n < self.threshold * (n + size):
            return  # even a text of nothing but the template's bigrams is too short
        starts = np.unique(np.minimum(where, len(h) - n))
        inside = np.searchsorted(where, starts + n) - np.searchsorted(where, starts)
        starts = starts[2 * inside >= self.threshold * size].tolist()
        if not starts:
            return
        lo, end = starts[0], starts[-1] + n
        keys, code = np.unique(h[lo:end], return_inverse=True)
        known = np.array([int(x) in names for x in keys])
        need = [int(np.searchsorted(keys, np.uint64(x))) if np.uint64(x) in keys else -1 for x in self.version[t]]
        if -1 in need:
            return
        code, known, count = code.tolist(), known.tolist(), [0] * len(keys)
        distinct = shared = 0
        left = right = lo
        for s in starts:
            if s >= right:  # far from the last one: begin anew
                for i in range(left, right):
                    count[code[i - lo]] = 0
                distinct = shared = 0
                left = right = s
            while right < s + n:
                c = code[right - lo]
                if not count[c]:
                    distinct += 1
                    shared += known[c]
                count[c] += 1
                right += 1
            while left < s:
                c = code[left - lo]
                count[c] -= 1
                if not count[c]:
                    distinct -= 1
                    shared -= known[c]
                left += 1
            value = 2 * shared / (distinct + size)
            if value >= self.threshold and all(count[c] for c in need):
                yield value, s

    def scan_text(self, h: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(name, dice, first word, end word) of a text with the bigrams h; of overlapping ones the best, then the longest, then the first by place and name."""
        if not len(h) or not len(self.keys):
            return []
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        on = np.flatnonzero(self.keys[k] == h)
        if not len(on):
            return []
        many = self.first[k[on] + 1] - self.first[k[on]]
        places = np.repeat(on, many)
        templates = self.of[np.repeat(self.first[k[on]] - (np.cumsum(many) - many), many) + np.arange(len(places))]
        order = np.argsort(templates, kind="stable")
        templates, places = templates[order], places[order]
        cut = np.flatnonzero(np.diff(templates)) + 1
        found = []
        for t, where in zip(templates[np.concatenate([[0], cut])].tolist(), np.split(places, cut)):
            name, n = self.names[t], min(self.length[t], len(h) + 1)
            found += [(name in GENERAL, -value, -self.length[t], s, name, s + n) for value, s in self._passages(h, t, where)]
        taken, kept = bytearray(len(h) + 1), []
        for _, value, _, s, name, e in sorted(found):
            if taken.find(1, s, e) < 0:
                taken[s:e] = b"\1" * (e - s)
                kept.append((name, -value, s, e))
        return sorted(kept, key=lambda x: x[2])

    def scan(self, w: K.Words):
        """(text, [(name, dice, first word, end word)]) of the texts with matches; words are counted through all texts."""
        if not len(self.keys):
            return
        h, at = K.windows(w, 2)
        ends = np.searchsorted(at, w.first)  # a text's bigrams
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        for d in np.flatnonzero(K.sums(self.keys[k] == h, ends)).tolist():
            if found := self.scan_text(h[ends[d] : ends[d + 1]]):
                a = int(w.first[d])
                yield d, [(name, value, a + s, a + e) for name, value, s, e in found]


def licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, matches array<struct<license, dice, start, end>> (UTF-8 byte offsets) for each row of docs.

    Null, empty and wordless texts have no matches. Repeated rows are scanned each. Long texts take
    time in proportion. Ties go to the longest template, then the first place, then the first name.
    Columns other than doc_id and text are not looked at. An empty table gives an empty result.
    """

    def make():
        scanner = Scanner(templates, threshold)

        def kernel(buf, offs, part):
            w = K.tokenize(buf, offs, K.ALNUM_WORDS)
            out = [[] for _ in offs[1:]]
            for d, found in scanner.scan(w):
                out[d] = [{"license": name, "dice": value, "start": int(w.s[s] - offs[d]), "end": int(w.e[e - 1] - offs[d])} for name, value, s, e in found]
            return {"doc_id": part.column("doc_id"), "matches": pa.array(out, pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])))}

        return kernel

    return K.map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, matches array<struct<license: string, dice: double, start: long, end: long>>")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, license (of the best match, the first of equals), dice, licenses (all names, sorted) for each document."""
    out = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), (-m["start"]).alias("at"), m["license"].alias("license"))))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), F.round(best["dice"], 6).alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"))
