"""License scans: MinHash bands retrieve templates for text windows, shingles verify.

A template of m shingles belongs to a size class B, the power of two from m on.
Texts are cut into blocks of B shingles; windows are two neighbouring blocks, so
each place where a template can stand lies wholly in one window.  A window of at
most 4m shingles that holds 80 % of a template has a Jaccard similarity of at
least 0.8 / 4.2 = 0.19 with it; with 48 bands of one MinHash each, it collides
with probability 1 - 0.81 ** 48 > 0.9999.

A template of under five words is one shingle of all its words.  Texts are hashed
at that width too, and every place is looked up, without bands.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm.common import texts

WORDS, BANDS, CONTAINED = 5, 48, 0.8
#: The fewest words of a template.
LEAST = 3
#: The most templates an operator call takes: they travel with the task.
MAX_TEMPLATES = 10_000
CACHE = 400_000

#: Short notices by which public licenses are declared.
TEMPLATES = {
    "mit_line": "Released under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "apache2_line": "Licensed under the Apache License, Version 2.0.",
    "apache2_notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl3_line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "cc_by_nc4_line": "Licensed under CC BY-NC 4.0.",
    "cc_by4_line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd_redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "mpl2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}

#: Whole license texts.
FULL_TEMPLATES = {
    "mit_text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd3_text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc_text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib_text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Notices under five words, which match as a whole or not at all.
SHORT_TEMPLATES = {
    "all_rights_reserved": "All rights reserved.",
    "some_rights_reserved": "Some rights reserved.",
    "no_rights_reserved": "No rights reserved.",
    "mit_name": "The MIT License",
    "spdx_mit": "SPDX-License-Identifier: MIT",
    "cc0_name": "CC0 1.0 Universal",
}

_words = re.compile(r"[^\W_]+").findall
_rng = np.random.RandomState(11)
_FACTORS = (_rng.randint(1, 1 << 62, BANDS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_PLACE = (_rng.randint(1, 1 << 62, WORDS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_BAND_BASE = np.arange(BANDS, dtype=np.uint64) << np.uint64(32)
_FLAGS = 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Words()


def _word_hashes(text: str | None) -> np.ndarray:
    words = _words((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for i in range(width):
        s = _mix(s) + h[i : i + n] * _PLACE[i]
    return _mix(s)


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Hashes of the runs of ``width`` words (letters and digits, lower-cased), in order."""
    return _runs(_word_hashes(text), width)


def _minima(s: np.ndarray, block: int) -> np.ndarray:
    """Per window (blocks j and j + 1; the last block alone ends it) each band's minimum."""
    g = _mix(s[:, None] * _FACTORS) >> np.uint64(32)
    mins = np.minimum.reduceat(g, np.arange(0, len(s), block), axis=0)
    mins[:-1] = np.minimum(mins[:-1], mins[1:])
    return mins


class Scanner:
    def __init__(self, templates: dict[str, str]):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.sets: dict[str, np.ndarray] = {}
        classes: dict[int, list[str]] = {}
        #: Per width under WORDS: hash of the whole template to its names.
        self.short: dict[int, dict[int, list[str]]] = {}
        for name, text in templates.items():
            n = len(_word_hashes(text))
            if n < LEAST:
                raise ValueError(f"template {name!r} has under {LEAST} words")
            self.sets[name] = s = np.unique(shingles(text, min(n, WORDS)))
            if n < WORDS:
                self.short.setdefault(n, {}).setdefault(int(s[0]), []).append(name)
                continue
            classes.setdefault(1 << int(np.ceil(np.log2(len(shingles(text))))), []).append(name)
        self.classes = []
        for block, names in sorted(classes.items()):
            keys = np.concatenate([_minima(self.sets[n], len(self.sets[n])).ravel() | _BAND_BASE for n in names])
            which = np.repeat(np.arange(len(names)), BANDS)
            order = np.argsort(keys, kind="stable")
            flags = np.zeros(1 << _FLAGS, bool)
            flags[self._flag(keys)] = True
            self.classes.append((block, names, keys[order], which[order], flags))

    @staticmethod
    def _flag(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FLAGS)).astype(np.int64)

    def retrieve(self, s: np.ndarray):
        """(class, window, template) for windows that agree with a template in a band.

        A stretch of the text is hashed once, for the smallest blocks; those of the
        next class, twice or more as wide, take the lesser of neighbouring minima.
        """
        if not self.classes or not len(s):
            return
        first, last = self.classes[0][0], self.classes[-1][0]
        step = max(last, 8192 // last * last)
        for at in range(0, len(s), step):
            part = s[at : at + step + last]
            g = _mix(part[:, None] * _FACTORS) >> np.uint64(32)
            mins, size = np.minimum.reduceat(g, np.arange(0, len(part), first), axis=0) if first > 1 else g, first
            for c, (block, names, keys, which, flags) in enumerate(self.classes):
                while size < block:
                    pairs = np.minimum(mins[: len(mins) // 2 * 2 : 2], mins[1::2])
                    mins, size = (np.concatenate([pairs, mins[-1:]]) if len(mins) % 2 else pairs), 2 * size
                windows = mins.copy()
                windows[:-1] = np.minimum(mins[:-1], mins[1:])
                k = (windows[: step // block] | _BAND_BASE).ravel()
                hit = np.flatnonzero(flags[self._flag(k)])
                lo, hi = np.searchsorted(keys, k[hit], "left"), np.searchsorted(keys, k[hit], "right")
                found = {(at // block + h // BANDS, t) for h, i, j in zip(hit.tolist(), lo.tolist(), hi.tolist(), strict=True) for t in which[i:j].tolist()}
                yield from ((c, w, names[t]) for w, t in sorted(found, key=lambda x: (x[0], names[x[1]])))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Per matching template: name, best containment, first word of the best
        window's match, matching windows."""
        h = _word_hashes(text)
        s = _runs(h, WORDS)
        best: dict[str, tuple[float, int, int]] = {}
        for width, known in self.short.items():
            runs = _runs(h, width)
            at = np.flatnonzero(np.isin(runs, np.array(list(known), np.uint64)))
            for key in np.unique(runs[at]).tolist():
                own = at[runs[at] == key]
                windows = np.union1d(own, own[own > 0] - 1)  # of two neighbouring shingles each
                for name in known[key]:
                    best[name] = (1.0, int(own[0]), len(windows))
        for c, w, name in self.retrieve(s):
            block, own = self.classes[c][0], self.sets[name]
            part = s[w * block : (w + 2) * block]
            here = np.isin(part, own)
            share = len(np.unique(part[here])) / len(own)
            if share >= CONTAINED:
                old = best.get(name, (0.0, 0, 0))
                top = (share, w * block + int(np.argmax(here))) if share > old[0] else old[:2]
                best[name] = (*top, old[2] + 1)
        return [(n, *v) for n, v in sorted(best.items())]


def template_table(templates: DataFrame) -> dict[str, str]:
    """``(license_id, text)`` as the scanner takes it; more than MAX_TEMPLATES rows raise."""
    rows = templates.select("license_id", "text").limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    return {r["license_id"]: r["text"] for r in rows}


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row per document and template found in it:
    ``doc_id, license_id, containment, start_word, n_windows``.

    Found means that a window holds at least 80 % of the template's five-word
    shingles; a template under five words must stand there whole.  Of equal windows
    the first gives ``start_word``.  Null texts, empty ones and those under three
    words match nothing.  Rows that repeat a doc_id
    are scanned each; null doc_ids are reported as null; extra columns are
    ignored.  ``templates``: name to text, or a table ``license_id, text``; they need
    three words each, and there may be at most MAX_TEMPLATES.
    """
    templates = TEMPLATES | FULL_TEMPLATES | SHORT_TEMPLATES if templates is None else templates
    templates = template_table(templates) if isinstance(templates, DataFrame) else templates

    def run(batches):
        scanner = Scanner(templates)
        for b in batches:
            rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in scanner.scan(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license_id", "containment", "start_word", "n_windows"])

    return texts(docs).mapInArrow(run, "doc_id long, license_id string, containment double, start_word long, n_windows long")
