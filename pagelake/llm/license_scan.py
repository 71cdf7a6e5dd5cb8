"""License scans by conditional compression.

Candidate blocks are windows around trigger words that reach as many words past
and before them as the longest template has, across line breaks. Each block is
compressed by zstandard alone and once per template with the template as a
raw-content dictionary; the saving ranks the templates, since a block that
repeats a template's wording costs almost nothing beside it. Every template that
saves ``MIN_SAVING`` of its own bytes, and every very short one, is then confirmed by its exact differences
in wording: which template words are missing and which words stand between them
that the template does not have. Matches inside another one's span are left out.

Spark's own filter drops texts without a trigger before any row reaches Python.

Edge cases: null and empty texts have no findings. A window ends ``WINDOW_CHARS``
characters from its trigger, for texts without word breaks. Repeated rows
repeat their findings; an empty table gives no rows. A document without a
notice has no row. Long texts are scanned whole. Only doc_id and text are read,
so other columns' names cannot clash. Ties between templates go to the earlier one in the list.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of public license texts.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
#: Public notices, headers and whole texts of common licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", _MIT_GRANT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD", _BSD_GRANT),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("All-Rights-Reserved", "All rights reserved"),
    ("MIT", f"{_MIT_GRANT}, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
     "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("BSD-2-Clause", f"{_BSD_GRANT}: {_BSD_TWO}{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}: {_BSD_TWO}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    *((name, f"SPDX-License-Identifier: {i}") for name, ids in (
        ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("GPL-3.0", "GPL-3.0 GPL-3.0-only GPL-3.0-or-later"), ("GPL-2.0", "GPL-2.0 GPL-2.0-only GPL-2.0-or-later"),
        ("LGPL-3.0", "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"), ("BSD-3-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-2-Clause"),
        ("MPL-2.0", "MPL-2.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC0-1.0", "CC0-1.0"), ("Unlicense", "Unlicense"),
    ) for i in ids.split()),
)
#: Words of a trigger may stand in different lines.
TRIGGER = r"(?i)licen[cs]e|spdx-|" + "|".join(
    t.replace(" ", r"\W{1,20}") for t in ("all rights reserved", "permission is hereby granted", "permission to use", "redistribution and use", "public domain", "creative commons", "waived all copyright", "subject to the terms of")
)
#: Words that turn a notice that follows them into its opposite.
DENIALS = frozenset(("not", "never", "formerly", "no", "un", "nicht", "pas"))
#: Words that make a longer license name of a shorter one.
QUALIFIERS = frozenset(("lesser", "library", "affero"))
#: Least share of a template's bytes that it must save.
MIN_SAVING = 0.2
#: Templates of up to so many words are always compared: a neighbouring notice that starts alike can take most of what they save.
SHORT_WORDS = 8
#: Share of a template's words that may be missing; short templates must be whole.
MAX_MISSING = 0.08
#: Triggers so many words apart share a window.
NEAR_WORDS = 8
WINDOW_CHARS = 8_000

_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Notices and whole texts are looked for apart, in windows of their own length: beside a long window's other words a notice saves too little.
WHOLE_WORDS = 60
GROUPS = tuple([k for k, (_, t) in enumerate(TEMPLATES) if (len(_words(t)) >= WHOLE_WORDS) is whole] for whole in (False, True))
#: Words of the longest template of each group, and a few more.
REACH = tuple(max(len(_words(TEMPLATES[k][1])) for k in group) + 4 for group in GROUPS)


def blocks(text: str, reach: int = REACH[0]) -> list[tuple[int, int]]:
    """(start, end) of the windows of ``reach`` words on both sides of the triggers of a text, in code points."""
    hits = [m.span() for m in re.finditer(TRIGGER, text)]
    if not hits:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    groups: list[list[int]] = []
    for h, e in hits:
        k = max(0, bisect.bisect_right(starts, h) - 1)
        if groups and k - groups[-1][0] <= NEAR_WORDS:
            groups[-1][1], groups[-1][3] = k, e
        else:
            groups.append([k, k, h, e])
    return [(max(words[max(0, k - reach)][0], h - WINDOW_CHARS), min(words[min(len(words) - 1, m + reach)][1], e + WINDOW_CHARS)) for k, m, h, e in groups]


@functools.cache
def _compressors() -> tuple:
    import zstandard as z

    raw = [z.ZstdCompressionDict(t.encode().ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT) for _, t in TEMPLATES]
    return z.ZstdCompressor(level=19), [z.ZstdCompressor(level=19, dict_data=d) for d in raw]


def savings(block: str, group: list[int]) -> list[tuple[float, int, float]]:
    """Of the templates of a group: (relative saving, minus template number, share of the template's bytes saved), best first."""
    plain, primed = _compressors()
    data = block.encode("utf-8", "replace")
    size = len(plain.compress(data))
    saved = [(k, size - len(primed[k].compress(data))) for k in group]
    return sorted(((n / size, -k, n / len(TEMPLATES[k][1].encode())) for k, n in saved), reverse=True)


def wording(template: str, have: list[str]) -> list[tuple[int, int, int, int]]:
    """(missing template words, words inserted between, first word, last word + 1 among ``have``) of every match."""
    want, out, todo = _words(template), [], [(0, len(have))]
    allowed = int(MAX_MISSING * len(want))
    while todo:
        lo, hi = todo.pop()
        if hi - lo < len(want) - allowed:
            continue
        matcher = difflib.SequenceMatcher(None, want, have[lo:hi], autojunk=False)
        same = [m for m in matcher.get_matching_blocks() if m.size]
        if not same:
            continue
        best = None
        for i in range(len(same)):
            for j in range(i, len(same)):
                first, last, n = lo + same[i].b, lo + same[j].b + same[j].size, sum(m.size for m in same[i : j + 1])
                got = (len(want) - n, last - first - n, first, last)
                if max(got[:2]) <= allowed and (best is None or got < best):
                    between = Counter(have[first:last]) - Counter(want)
                    lost = Counter(want) - Counter(have[first:last])
                    # another version or another license of the family is another statement
                    if not any(w in QUALIFIERS for w in between) and not any(c.isdigit() for w in [*between, *lost] for c in w):
                        best = got
        if best:
            first, last = best[2:]
            # a denial before the match makes it another statement
            if not (first and have[first - 1] in DENIALS):
                out.append(best)
        else:
            longest = max(same, key=lambda m: m.size)
            first, last = lo + longest.b, lo + longest.b + longest.size
        todo += [(lo, first), (last, hi)]
    return out


def scan(text: str | None) -> list[dict]:
    """Findings of one text: license, start and end (code points of the notice), saving, rank, missing, inserted."""
    found: dict[tuple, dict] = {}
    text = text or ""
    for group, a, b in ((group, a, b) for group, reach in zip(GROUPS, REACH, strict=True) for a, b in blocks(text, reach)):
        block = text[a:b]
        spans = [(a + m.start(), a + m.end()) for m in _WORD.finditer(block)]
        have = _words(block)
        for rank, (saving, k, share) in enumerate(savings(block, group), 1):
            name, template = TEMPLATES[-k]
            if share < MIN_SAVING and len(_words(template)) > SHORT_WORDS:
                continue
            for missing, inserted, first, last in wording(template, have):
                start, end = spans[first][0], spans[last - 1][1]
                if template.startswith("SPDX-") and re.match(r"-\w", text[end : end + 2]):
                    continue  # a longer identifier
                new = {"license": name, "start": start, "end": end, "saving": round(saving, 6), "rank": rank, "missing": missing, "inserted": inserted}
                old = found.get((start, end))
                if old is None or (missing + inserted, rank) < (old["missing"] + old["inserted"], old["rank"]):
                    found[start, end] = new
    out, last = [], -1
    for f in sorted(found.values(), key=lambda f: (f["start"], -f["end"])):
        if f["end"] > last:
            out.append(f)
            last = f["end"]
    return out


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per notice found: doc_id, license, start, end, saving, rank, missing, inserted."""
    id_type = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, license string, start long, end long, saving double, rank int, missing int, inserted int"
    kinds = {"license": pa.string(), "start": pa.int64(), "end": pa.int64(), "saving": pa.float64(), "rank": pa.int32(), "missing": pa.int32(), "inserted": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, rows = [], []
            for k, t in enumerate(b.column(1)):
                got = scan(t.as_py())
                rows += got
                where += [k] * len(got)
            cols = [b.column(0).take(pa.array(where, pa.int64())), *[pa.array([r[c] for r in rows], t) for c, t in kinds.items()]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *kinds])

    hits = df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).where(F.rlike(F.col(f"`{text}`"), F.lit(TRIGGER)))
    return hits.mapInArrow(run, schema)
