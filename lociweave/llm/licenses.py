"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts are lower-cased words of ASCII letters, digits and non-ASCII characters; shingles are
five words.  For each length of a template, in words, windows of twice that length overlap by
half, so whatever is at most as long as the template lies whole in some window.  A template is
in a text if the shingles of one of its windows (its words, not their hashes) hold
MIN_CONTAINMENT of its own.

A window and a template are compared so only where one of the length's one-row MinHash bands
agrees.  A window of w shingles that holds the fewest, m, of a template's t that MIN_CONTAINMENT
asks for has J >= m / (w + t - m) and fails to retrieve it with probability at most
(1 - J)**bands.  J is lowest for the shortest templates (1/6 for one of five words); each length
has as many bands as its worst template needs for a probability under MISS.

Only windows with a shingle of some template of the length can agree in a band, because a band's
minimum is then the hash of a shared shingle; others are passed over unsigned.

Null and empty texts hold no license; a repeated row is scanned like any other; a very long text
is scanned whole, window by window; an empty table gives an empty result.  Templates are whole
license texts and notices, given as a table or as a dictionary.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import ALNUM_BYTES, LOWER, mix, run_hashes, span_hashes, spans, text_slices

SHINGLE = 5
MIN_CONTAINMENT = 0.8
#: bound of the probability that a window fails to retrieve a template which it holds
MISS = 1e-6
#: band values formed at once
BLOCK = 1 << 20
#: most characters of a table of templates, which is sent to all tasks
MAX_TEMPLATE_CHARS = 16 << 20

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(kind: str, what: str, version: str) -> str:
    """The notice that the GNU licenses ask for at the head of a file."""
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details. "
        f"You should have received a copy of the {kind} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


# Texts of licenses that are a page at most, the notices of longer ones, and lines by which
# licenses are commonly named.
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END],
    "AGPL-3.0": [_gnu("GNU Affero General Public License", "program", "3")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [f"{_BSD_HEAD} {_BSD_END}"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_END}"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "CC-BY-4.0": ["licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", _gnu("GNU General Public License", "program", "3")],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END],
    "LGPL-3.0": [_gnu("GNU Lesser General Public License", "library", "3")],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower() if text.isascii() else LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes())


def shingles_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), ALNUM_BYTES)
    return run_hashes(span_hashes(data, starts, ends), SHINGLE)


def _salts(bands: int) -> np.ndarray:
    return np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def signature(hashes: np.ndarray, bands: int) -> np.ndarray:
    """One minimum per band of a set of shingle hashes."""
    salts = _salts(bands)
    rows = max(1, BLOCK // len(hashes))
    return np.concatenate([mix(salts[k : k + rows, None] ^ hashes[None, :]).min(axis=1) for k in range(0, bands, rows)])


def _among(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are among sorted ones."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def bands_for(shingles: int, window: int, min_containment: float) -> int:
    """Bands by which a window of so many shingles misses a template that it holds with a probability under MISS."""
    fewest = next((k for k in range(1, shingles + 1) if k / shingles >= min_containment), shingles)
    other = 1 - fewest / (window + shingles - fewest)
    return math.floor(math.log(MISS) / math.log(other)) + 1 if other else 1


class Templates:
    """Templates by their length in words, each with its exact shingles and its signature."""

    def __init__(self, texts: dict[str, list[str]], min_containment: float):
        self.min_containment = min_containment
        self.names, self.shingles, self.lengths, hashes = [], [], [], []
        for name, own in sorted(texts.items()):
            for text in own:
                words = words_of(text)
                if len(words) < SHINGLE:
                    raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
                self.names.append(name)
                self.shingles.append(shingles_of(words))
                self.lengths.append(len(words))
                hashes.append(np.unique(_hashes(words)))
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        self.classes: dict[int, list[int]] = {}
        for i, n in enumerate(self.lengths):
            self.classes.setdefault(n, []).append(i)
        self.class_known = {n: np.unique(np.concatenate([hashes[i] for i in members])) for n, members in self.classes.items()}
        self.bands = {n: max(bands_for(len(self.shingles[i]), 2 * n - SHINGLE + 1, min_containment) for i in members) for n, members in self.classes.items()}
        self.signatures = {n: np.stack([signature(hashes[i], self.bands[n]) for i in members]) for n, members in self.classes.items()}

    def agreeing(self, step: int, hashes: np.ndarray, starts: np.ndarray, shingles: int) -> np.ndarray:
        """(windows, members of a length) which agree in a band; windows of so many shingles, signed band by band in blocks."""
        own = self.signatures[step]
        out = np.zeros((len(starts), len(own)), bool)
        rows = max(1, BLOCK // max(1, shingles))
        for lo in range(0, len(starts), rows):
            block = hashes[starts[lo : lo + rows, None] + np.arange(shingles)]
            for band in range(self.bands[step]):
                least = mix(_salts(band + 1)[band] ^ block).min(axis=1)
                out[lo : lo + rows] |= least[:, None] == own[None, :, band]
        return out

    def found_in(self, words_at, hashes: np.ndarray) -> dict[int, tuple[float, set]]:
        """(share, shingles) of each template that is in a text; words_at(lo, hi) gives its words, hashes its shingles'.

        Windows with the same shingles are signed and verified once, where the last of them is; of windows with the same share the last counts.
        """
        out: dict[int, tuple[float, set]] = {}
        some = np.flatnonzero(_among(self.known, hashes))
        if not len(some):
            return out
        for step, members in self.classes.items():
            held = some[_among(self.class_known[step], hashes[some])]
            if not len(held):
                continue
            shingles = 2 * step - SHINGLE + 1
            starts = np.unique(np.concatenate([held // step * step, np.maximum(0, held // step * step - step)]))
            whole, cut = starts[starts + shingles <= len(hashes)], starts[starts + shingles > len(hashes)]
            if len(whole) > 1:
                keys = run_hashes(hashes, shingles)[whole]
                whole = np.sort(whole[len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]])
            agree = [(lo, row) for lo, row in zip(whole.tolist(), self.agreeing(step, hashes, whole, shingles), strict=True) if row.any()]
            for lo in cut.tolist():
                agree.append((lo, self.agreeing(step, hashes, np.array([lo]), len(hashes) - lo)[0]))
            for lo, row in agree:
                for at in np.flatnonzero(row).tolist():
                    i = members[at]
                    common = self.shingles[i] & shingles_of(words_at(lo, min(len(hashes) + SHINGLE - 1, lo + 2 * step)))
                    share = len(common) / len(self.shingles[i])
                    if share >= max(self.min_containment, out.get(i, (0,))[0]):
                        out[i] = (share, common)
        return out

    def licenses(self, found: dict[int, tuple[float, set]]) -> dict[str, float]:
        """Licenses and their best shares.

        A template whose found shingles all belong to better matches is not reported: notices of two
        versions of a license differ in a word or two, and texts of some licenses are parts of others'.
        """
        best: dict[str, float] = {}
        claimed: set = set()
        for i, (share, common) in sorted(found.items(), key=lambda x: (-x[1][0], -len(x[1][1]), x[0])):
            if common - claimed:
                best[self.names[i]] = max(best.get(self.names[i], 0), share)
            claimed |= common
        return best


def templates_of(table: DataFrame) -> dict[str, list[str]]:
    """Templates from a table of name and text, of MAX_TEMPLATE_CHARS characters at most in all."""
    from pyspark.sql import functions as F

    good = table.where("name is not null and text is not null").select("name", "text")
    size = good.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates of {size} characters; at most {MAX_TEMPLATE_CHARS} are sent to all tasks")
    out: dict[str, list[str]] = {}
    for r in good.distinct().orderBy("name", "text").collect():
        out.setdefault(r["name"], []).append(r["text"])
    return out


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | DataFrame | None = None, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (sorted names joined by commas), best_containment."""
    texts = templates_of(templates) if isinstance(templates, DataFrame) else templates or TEMPLATES
    known = docs.sparkSession.sparkContext.broadcast(Templates(texts, min_containment))
    schema = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("licenses", pa.string()), ("best_containment", pa.float64())])

    def scan(batches):
        templates = known.value
        for batch in batches:
            rows = []
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                lower = LOWER[data]
                starts, ends, first = spans(lower, offsets, ALNUM_BYTES)
                hashes = run_hashes(span_hashes(lower, starts, ends), SHINGLE)
                ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                for k in range(hi - lo):
                    a, b = int(first[k]), int(first[k + 1])
                    words_at = lambda x, y, a=a: [lower[starts[a + i] : ends[a + i]].tobytes() for i in range(x, y)]
                    out = templates.licenses(templates.found_in(words_at, hashes[a : b - SHINGLE + 1])) if b - a >= SHINGLE else {}
                    rows.append({"doc_id": ids[k], "n_licenses": len(out), "licenses": ",".join(sorted(out)), "best_containment": max(out.values(), default=0.0)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_licenses long, licenses string, best_containment double")
