"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are lower-cased and stripped of punctuation at their ends. An occurrence
of a template is a stretch of at most 2^k shingles (five words each), two to four
times as many as the template has, that holds 0.8 of its shingles; what is
inserted or lost in it does not matter, nor where in the text it stands. Windows of 2^k
shingles step by half their length, so one of two neighbours holds half of an
occurrence's shingles, 0.4 of the template: a similarity of 0.087 at least, with a
window full of other words. BANDS bands of one minimum each then collide with a
probability of 1 - 0.913^128, all but 1e-5; with a template that fills half of its
window it is all but 1e-20. A template that the bands of any window retrieve is
verified by exact shingle containment over all stretches of the text; one
that no band retrieves is not looked at.

The texts of a batch are laid end to end, so that minima are made for all their
windows together, each length of window from the next shorter one; a window
over a seam has its share of both texts, and the bound holds for it as it
stands.

Defined cases: null, empty and short texts match nothing; very long texts are scanned
whole, in parts that overlap by the longest window; a text that is a
template matches it; repeated rows get equal answers; null ids are allowed;
further columns, whatever their names, are not read;
an empty table gives an empty result. A template of fewer than five words is
one shingle of all its words. Its window is one run of that many words, whose
one band is the shingle itself, so it is found anywhere and only as it stands.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, mix64, slices, split_words

SHINGLE, BANDS, PERCENT = 5, 128, 80
#: Shingles whose minima are held at once, in a core's cache.
PART = 1 << 12
#: Bands of the windows of two shingles, of which a template of one is half: all but 3e-10 collide.
FEW = 32

# Public notices and license texts by their common identifiers.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced"],
}

#: Notices of fewer words than a shingle.
PHRASES = {"Proprietary": ["All rights reserved"]}
ALL = {name: texts + PHRASES.get(name, []) for name, texts in TEMPLATES.items()}

_EDGES = b".,;:!?()[]{}<>\"'`*_/\\|#"
_rng = np.random.default_rng(77)
U32 = np.uint32
_A = _rng.integers(0, 2**32, BANDS, dtype=U32) | U32(1)
_B = _rng.integers(0, 2**32, BANDS, dtype=U32)


def normalised(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(_EDGES) for x in split_words(text, lower=True)) if w]


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of size words, in order, from the hashes of the words; fewer words: one for all."""
    n = len(h)
    if not n:
        return h
    size = min(size, n)
    out = h[: n - size + 1].copy()
    for j in range(1, size):
        out = mix64(out) + h[j : n - size + 1 + j]
    return mix64(out + U64(size))


def minima(h: np.ndarray) -> np.ndarray:
    """A number for each shingle and band: one permutation of 32 bits for each band."""
    out = np.multiply((h >> U64(32)).astype(U32)[:, None], _A)
    out += _B
    return out


class Index:
    """Templates by length of window, band and minimum."""

    def __init__(self, templates: dict[str, list[str]]):
        known = WordHashes()
        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        words = [normalised(templates[n][i]) for n, i in self.names]
        self.sets = [np.unique(shingles(known.of(w))) for w in words]
        self.phrases = [(t, len(w)) for t, w in enumerate(words) if 0 < len(w) < SHINGLE]
        self.level_of = {t: max(1, int(np.ceil(np.log2(2 * len(s))))) for t, (s, w) in enumerate(zip(self.sets, words, strict=True)) if len(w) >= SHINGLE}
        self.top = max(self.level_of.values(), default=0)
        #: For each length 2^level: sorted (band, minimum) keys with their templates, and which low bits occur among them.
        self.keys: dict[int, tuple[np.ndarray, list[list[int]], np.ndarray]] = {}
        for level in sorted(set(self.level_of.values())):
            found: dict[int, list[int]] = {}
            for t in (t for t, own in self.level_of.items() if own == level):
                for band, low in enumerate(minima(self.sets[t]).min(axis=0)[: FEW if level == 1 else BANDS].tolist()):
                    found.setdefault(band << 32 | low, []).append(t)
            keys = np.array(sorted(found), np.int64)
            seen = np.zeros(1 << 16, bool)
            seen[(keys ^ (keys >> 32) * 0x9E37) & 0xFFFF] = True
            self.keys[level] = keys, [found[k] for k in keys.tolist()], seen
        self.turn = (np.arange(BANDS) * 0x9E37 & 0xFFFF).astype(U32)

    def retrieved(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(first shingle, end, template) of the windows over h that share a band's minimum with a template."""
        out: list[tuple[int, int, int]] = []
        if not self.top:
            return out
        longest = 1 << self.top
        for at in range(0, len(h), PART):
            n = min(len(h) - at, PART + longest)
            low = minima(h[at : at + n])
            for level in range(1, self.top + 1):
                # Windows of half the length start at every quarter of this one's length; two of them make one.
                back = 1 if level == 1 else 2
                first = low if level == 1 else low[::2]
                second = low[back::back] if level > 1 else low[1:]
                low = first.copy()
                np.minimum(low[: len(second)], second[: len(low)], out=low[: len(second)])
                if level not in self.keys:
                    continue
                keys, templates, seen = self.keys[level]
                step = 1 << (level - 1)
                bands = FEW if level == 1 else BANDS
                own = np.ascontiguousarray(low[: -(-min(n, PART) // step), :bands])
                hit = np.flatnonzero(seen.take((own ^ self.turn[:bands]).astype(np.uint16).ravel()))
                window, band = np.divmod(hit, bands)
                asked = band << 32 | own.ravel()[hit].astype(np.int64)
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                for i in np.flatnonzero(keys[place] == asked).tolist():
                    start = at + int(window[i]) * step
                    out += [(start, start + 2 * step, t) for t in templates[place[i]]]
        return out

    def scan(self, words: list[bytes], known: WordHashes) -> list[tuple[int, int, int, float]]:
        return self.scan_all([words], known)[0]

    def scan_all(self, texts: list[list[bytes]], known: WordHashes) -> list[list[tuple[int, int, int, float]]]:
        """For each text (template, first word, end word, containment) of every verified stretch, the best of overlapping ones."""
        own = [known.of(w) for w in texts]
        runs = [shingles(w) if len(w) >= SHINGLE else w[:0] for w in own]
        starts = np.r_[0, np.cumsum([len(r) for r in runs])]
        found = [self._phrases(w) for w in own]
        asked: set[tuple[int, int]] = set()
        for first, end, t in self.retrieved(np.concatenate([np.empty(0, U64), *runs])):
            # The texts that the window covers.
            a, b = np.searchsorted(starts, [first, min(end, int(starts[-1])) - 1], side="right") - 1
            asked |= {(d, t) for d in range(int(a), int(b) + 1) if len(runs[d])}
        for d, t in sorted(asked):
            found[d] += _apart(t, self._stretches(t, 1 << self.level_of[t], runs[d]))
        return [sorted(f, key=lambda x: (x[1], x[2], x[0])) for f in found]

    def _phrases(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Every occurrence of the templates under SHINGLE words."""
        out: list[tuple[int, int, int, float]] = []
        runs = {n: shingles(words, n) for n in {n for _, n in self.phrases} if n <= len(words)}
        for t, n in self.phrases:
            end = 0
            for a in np.flatnonzero(runs[n] == self.sets[t][0]).tolist() if n in runs else ():
                if a >= end:
                    end = a + n
                    out.append((t, a, end, 1.0))
        return out

    def _stretches(self, t: int, span: int, h: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word, end word, containment): for each shingle of a template, the stretch that ends in it, if it holds enough."""
        own = self.sets[t]
        place = np.minimum(np.searchsorted(own, h), len(own) - 1)
        hit = np.flatnonzero(own[place] == h)
        at, kind = hit.tolist(), place[hit].tolist()
        n, held, out = len(self.sets[t]), Counter(), []
        low = 0
        for high, k in enumerate(kind):
            held[k] += 1
            while at[high] - at[low] >= span or held[kind[low]] > 1:
                held[kind[low]] -= 1
                if not held[kind[low]]:
                    del held[kind[low]]
                low += 1
            if 100 * len(held) >= PERCENT * n:
                out.append((at[low], at[high] + SHINGLE, len(held) / n))
        return out


def _apart(t: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of overlapping stretches of one template, the one of the highest containment and then the shortest stays."""
    firsts: list[int] = []
    kept: list[tuple[int, int, int, float]] = []
    for a, b, c in sorted(found, key=lambda x: (-x[2], x[1] - x[0], x[0])):
        i = bisect(firsts, a)
        if (i == 0 or kept[i - 1][2] <= a) and (i == len(kept) or b <= kept[i][1]):
            firsts.insert(i, a)
            kept.insert(i, (t, a, b, c))
    return kept


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words and the matches (license, template, first word, end word, containment) of every document."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        index, known = Index(templates), WordHashes()
        for pdf in batches:
            n_words, found = [], []
            for part in slices(pdf["text"].str.len().fillna(0).to_numpy(), 1 << 20):
                words = [normalised(t) for t in pdf["text"].iloc[part]]
                n_words += map(len, words)
                found += [[{"license": index.names[t][0], "template": index.names[t][1], "first": a, "end": b, "containment": c} for t, a, b, c in own] for own in index.scan_all(words, known)]
            yield pd.DataFrame({"key": pdf["key"].array, "n_words": n_words, "matches": found})

    schema = f"key {kind}, n_words long, matches array<struct<license: string, template: int, first: long, end: long, containment: double>>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema).withColumnRenamed("key", key)
