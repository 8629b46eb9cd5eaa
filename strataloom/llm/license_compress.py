"""License scan by conditional compression.

Candidate blocks come from the templates alone: every word that lies in one of their three-word runs is marked, and
marked words with at most GAP others between them form a run. A run is read in windows of twice the longest template's
words, so texts of any length and line structure are read alike. Each window is compressed alone and with every template
as a raw Zstandard dictionary, and the templates are ranked by size, ties by name. The first in that ranking that holds up
on exact wording is confirmed: of the template's words in order at most `max_missing` percent are missing from the
window, few others come between, and neither kind holds a number, a negation or a license's name; nor may a word
just before the match negate it. If none holds up, the first in the ranking is returned unconfirmed. After a confirmed
match the window goes on behind it, so several notices in one run are all found.

Identifiers and titles are too short for runs: they are compressed with each line template, and the first in that ranking
with the very same words is confirmed. An identifier's tag may stand anywhere in a line of any length; its expression is
taken apart, over several lines where it goes on. A title has lines of its own, one or more, blank ones between them or not.

Contract. One row per match or unconfirmed block: doc_id, block_start, block_end (code points), license, rank (its place
in the ranking, from 1), reduction (0 to 1), missing and extra (differing words), confirmed. Blocks whose best reduction
is under LEAST are no license text and give no row. Null and empty texts have no blocks. Repeated rows give repeated
results. Extra columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import table

# fixed values: license texts without their copyright lines, standard notices, and short notices; <...> is filled in
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_AD = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <organization>.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This <program> is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.\n"
_GNU_END = "This <program> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
TEMPLATES = {
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": _GNU.format(kind="Affero General Public License", version="3", colon=":", comma=",") + _GNU_END.format(kind="Affero General Public License"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END,
    "BSD-4-Clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_AD + _BSD_3 + _BSD_END,
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, <author> has waived all copyright and related or neighboring rights to <work>. This work is published from: <country>.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _GNU.format(kind="General Public License", version="2", colon=";", comma=";") + _GNU_END.format(kind="General Public License"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GNU.format(kind="General Public License", version="3", colon=":", comma=",") + _GNU_END.format(kind="General Public License"),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": _GNU.format(kind="Lesser General Public License", version="2.1", colon=";", comma=";") + _GNU_END.format(kind="Lesser General Public License"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": _GNU.format(kind="Lesser General Public License", version="3", colon=":", comma=",") + _GNU_END.format(kind="Lesser General Public License"),
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": 'This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\nThe origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\nAltered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\nThis notice may not be removed or altered from any source distribution.",
}
# fixed values: how licenses are named in running text
NOTICES = {
    "AGPL-3.0-notice": "under the GNU Affero General Public License version 3",
    "AGPL-3.0-short": "under the AGPL-3.0 license",
    "Apache-2.0-notice": "the Apache License, Version 2.0",
    "Apache-2.0-short": "under the Apache-2.0 license",
    "BSD-notice": "under the BSD license",
    "BSD-2-Clause-notice": "under the BSD 2-Clause License",
    "BSD-2-Clause-short": "under the 2-clause BSD license",
    "BSD-3-Clause-notice": "under the BSD 3-Clause License",
    "BSD-3-Clause-short": "under the 3-clause BSD license",
    "BSL-1.0-notice": "under the Boost Software License, Version 1.0",
    "CC-BY-4.0-notice": "under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-notice": "under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0-notice": "under the CC0 1.0 Universal public domain dedication",
    "EPL-2.0-notice": "the Eclipse Public License 2.0",
    "GPL-2.0-notice": "under the GNU General Public License version 2",
    "GPL-2.0-short": "under the GPL-2.0 license",
    "GPL-3.0-notice": "under the GNU General Public License version 3",
    "GPL-3.0-short": "under the GPL-3.0 license",
    "ISC-notice": "under the ISC License",
    "LGPL-2.1-notice": "under the GNU Lesser General Public License version 2.1",
    "LGPL-3.0-notice": "under the GNU Lesser General Public License version 3",
    "MIT-notice": "under the MIT License",
    "MPL-2.0-notice": "the Mozilla Public License 2.0",
    "MPL-2.0-version": "the Mozilla Public License, version 2.0",
    "Unlicense-notice": "under the Unlicense license",
    "Zlib-notice": "under the zlib License",
}
# fixed values: identifiers, and the titles at the head of license texts, of many pages too; a title stands on lines of its own
IDENTIFIERS = "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL OFL-1.1 PostgreSQL Python-2.0 Unlicense WTFPL Zlib".split()
TITLES = {
    "AGPL-3.0-title": ["GNU Affero General Public License Version 3, 19 November 2007", "GNU Affero General Public License v3.0"],
    "Apache-2.0-title": ["Apache License Version 2.0, January 2004", "Apache License 2.0"],
    "BSD-2-Clause-title": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause-title": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "BSL-1.0-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "CC-BY-4.0-title": ["Creative Commons Attribution 4.0 International Public License", "Attribution 4.0 International"],
    "CC-BY-SA-4.0-title": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0-title": ["CC0 1.0 Universal"],
    "EPL-2.0-title": ["Eclipse Public License - v 2.0"],
    "GPL-2.0-title": ["GNU General Public License Version 2, June 1991", "GNU General Public License v2.0"],
    "GPL-3.0-title": ["GNU General Public License Version 3, 29 June 2007", "GNU General Public License v3.0"],
    "ISC-title": ["ISC License"],
    "LGPL-2.1-title": ["GNU Lesser General Public License Version 2.1, February 1999", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0-title": ["GNU Lesser General Public License Version 3, 29 June 2007", "GNU Lesser General Public License v3.0"],
    "MIT-title": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "MPL-2.0-title": ["Mozilla Public License Version 2.0"],
    "Unlicense-title": ["The Unlicense"],
    "Zlib-title": ["zlib License"],
}
MARK = "spdx-license-identifier"
LINES = {f"{name}-identifier": [f"SPDX-License-Identifier: {name}"] for name in IDENTIFIERS} | TITLES
#: A difference in one of these, in a number or in a word of a template's name makes another license of a text.
DECISIVE = frozenset("formerly previously not no non never cannot except neither nor unless general lesser library affero mozilla eclipse creative commons noncommercial sharealike attribution gnu".split())
NEGATIONS = frozenset("not no never cannot isn't aren't neither nor formerly previously".split())
WORDS = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
#: An identifier's tag as a word; what ends its expression, but for a line's end; and what joins two licenses, besides words.
TAG = re.compile(rf"(?<![a-z0-9])(?<![a-z0-9][.'-]){MARK}(?![.'-]?[a-z0-9])")
CLOSED = re.compile(r"[.!?](?=\s)|\*/|-->")
BREAK = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
JOINT, JOINTS = re.compile(r"[,;|&]|(?<!\*)/(?![/*])"), frozenset(("and", "or", "with"))
#: List markers are no words: at a line's start, or between punctuation and a capital.
MARKER = re.compile(r"(?m)^[ \t#*/;-]*\(?(?:[0-9]{1,2}|[a-z])[.)](?=\s)|(?<=[:;.,]\s)\(?[0-9][.)](?=\s+[A-Z])")
GAP, EDGE, LEAD = 8, 2, 4
MAX_MISSING, LEAST = 5, 0.2


def _lower(text: str) -> str:
    """Lower case of the same length, without list markers."""
    text = MARKER.sub(lambda m: " " * len(m[0]), text)
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(template: str) -> list[str]:
    return WORDS.findall(_lower(re.sub(r"<[^<>]*>", " ", template)))


class Ranker:
    """Compressors with each template as raw dictionary, and one without; the templates' words and three-word runs."""

    def __init__(self, templates: dict[str, str], max_missing: int = MAX_MISSING, lines: dict[str, list[str]] | None = None):
        raw = lambda t: zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "level": 9}
        self.max_missing = max_missing
        self.alone = zstandard.ZstdCompressor(**options)
        self.given = {n: zstandard.ZstdCompressor(dict_data=raw(t), **options) for n, t in sorted(templates.items())}
        self.words = {n: words_of(t) for n, t in templates.items()}
        self.counts = {n: Counter(t) for n, t in self.words.items()}
        self.decisive = DECISIVE | {w for n in templates for w in n.lower().split("-") if w not in ("text", "header", "clause")}
        forms = [(name, form) for name, some in sorted((lines or {}).items()) for form in some]
        self.lines = [(name, zstandard.ZstdCompressor(dict_data=raw(form), **options)) for name, form in forms]
        self.line_words = [tuple(words_of(form)) for _, form in forms]
        self.starts = {w[:i] for w in self.line_words for i in range(1, len(w) + 1)}
        self.cues = {max(w, key=len) for w in self.line_words if not MARK == w[0]} | ({MARK} if (MARK,) in self.starts else set())
        self.longest = max(map(len, self.line_words), default=0)
        self.number = {w: i for i, w in enumerate(sorted({w for t in self.words.values() for w in t}), 1)}
        self.base = len(self.number) + 1
        runs = [self._runs(np.array([self.number[w] for w in t])) for t in self.words.values()]
        self.runs = np.unique(np.concatenate(runs))
        self.window = 2 * max(map(len, self.words.values()))
        self.shortest = min(4, *map(len, self.words.values()))

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        ids = ids.astype(np.int64)
        return (ids[:-2] * self.base + ids[1:-1]) * self.base + ids[2:]

    def candidates(self, words: list[str]) -> list[tuple[int, int]]:
        """Ranges of words that may hold license text."""
        if len(words) < 3:
            return []
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        known = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))  # few, so that the rest is cheap
        hits = known[np.isin((ids[known] * self.base + ids[known + 1]) * self.base + ids[known + 2], self.runs)]
        if not len(hits):
            return []
        marked = np.unique(np.concatenate([hits, hits + 1, hits + 2]))
        parts = np.split(marked, np.flatnonzero(np.diff(marked) > GAP + 1) + 1)
        return [(int(p[0]), int(p[-1]) + 1) for p in parts if len(p) >= self.shortest]

    def line(self, block: str, words: tuple[str, ...]) -> tuple | None:
        """As rank(), for a whole line: the template of the greatest reduction whose words it holds, no fewer and no more."""
        if words not in self.line_words:
            return None
        data = block.encode("utf-8", "surrogatepass")
        whole = len(self.alone.compress(data))
        sizes = [(len(c.compress(data)), name, i) for i, (name, c) in enumerate(self.lines)]
        for place, (size, name, i) in enumerate(sorted(sizes), 1):
            if self.line_words[i] == words:
                return name, place, max(0.0, 1 - size / whole), [], [], True
        return None

    def sizes(self, block: str) -> tuple[int, dict[str, int]]:
        """The block's compressed size alone and with each template."""
        data = block.encode("utf-8", "surrogatepass")
        return len(self.alone.compress(data)), {n: len(c.compress(data)) for n, c in self.given.items()}

    def rank(self, block: str, words: list[str], lead: list[str] = ()) -> tuple:
        """(license, rank, reduction, missing, extra, confirmed, first, last) of the best template; word positions in `words`."""
        whole, sizes = self.sizes(block)
        order = sorted(sizes, key=lambda n: (sizes[n], n))
        fallback, held = None, Counter(words)
        for place, name in enumerate(order, 1):
            if fallback and whole - sizes[name] < (whole - sizes[order[0]]) / 2:
                break  # this template and those after it explain less than half of what the first does
            least_missing = len(self.words[name]) - (self.counts[name] & held).total()
            if fallback and 100 * least_missing > self.max_missing * len(self.words[name]):
                continue  # too many words are missing, in whatever order
            missing, extra, first, last = self.differences(self.words[name], words)
            ahead = NEGATIONS.intersection([*lead[::-1], *words[:first]][-LEAD:])
            if ahead and first <= LEAD:
                extra = [*sorted(ahead), *extra]
            own = len(self.words[name])
            sure = 100 * len(missing) <= self.max_missing * own and len(extra) <= max(3, 0.15 * own) and not any(w in self.decisive or any(map(str.isdigit, w)) for w in (*missing, *extra))
            found = (name, place, max(0.0, 1 - sizes[name] / whole), missing, extra, sure, first, last)
            if sure:
                return found
            fallback = fallback or found
        return fallback

    @staticmethod
    def differences(template: list[str], words: list[str]) -> tuple[list[str], list[str], int, int]:
        """Template words that the block lacks in order, block words between the first and last match, and those two."""
        found = [m for m in difflib.SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
        if not found:
            return template, words, 0, len(words)
        kept = {i for m in found for i in range(m.a, m.a + m.size)}
        used = {j for m in found for j in range(m.b, m.b + m.size)}
        return [w for i, w in enumerate(template) if i not in kept], [words[j] for j in range(min(used), max(used)) if j not in used], min(used), max(used) + 1


def line_matches(ranker: Ranker, text: str) -> list[tuple]:
    """The matches of identifiers, one for each license of an expression, and of titles, in order."""
    if not ranker.lines or not any(cue in text.lower() for cue in ranker.cues):
        return []
    low = _lower(text)
    return sorted([*(_identifiers(ranker, low) if (MARK,) in ranker.starts else ()), *_titles(ranker, low)], key=lambda m: m[:3])


def _identifiers(ranker: Ranker, low: str) -> Iterator[tuple]:
    """Of each tag's expression the identifiers that follow the tag, a joint or another identifier. It ends with its line, unless
    the line ends within brackets or with a joint word."""
    for tag in TAG.finditer(low):
        at, depth, due, joined = tag.end(), 0, True, False  # due: a license comes next; joined: after a joint word
        for m in WORDS.finditer(low, at):
            between, *later = BREAK.split(low[at : m.start()])
            depth += between.count("(") - between.count(")")
            if m[0] == MARK or CLOSED.search(low[at : m.start()]) or (later and not joined and depth <= 0):
                break
            depth += sum(part.count("(") - part.count(")") for part in later)
            due = due or bool(JOINT.search(between))
            joined = m[0] in JOINTS
            one = due and ranker.line(f"{MARK}: {m[0]}", (MARK, m[0]))
            if one:
                yield tag.start(), m.end(), *one
            depth = depth if due or joined else 0  # what follows is no expression
            due, at = bool(joined or one), m.end()


def _titles(ranker: Ranker, low: str) -> Iterator[tuple]:
    """The longest title that begins with a line and ends with it or a later one, of lines with words."""
    lines, start = [], 0
    for line in low.splitlines(keepends=True):
        found = list(islice(WORDS.finditer(line), ranker.longest + 1))  # with one word more no title holds the line
        if found:
            lines.append((tuple(m[0] for m in found), start + found[0].start(), start + found[-1].end()))
        start += len(line)
    at = 0
    while at < len(lines):
        words, stop, best = (), at, None
        while stop < len(lines) and words + lines[stop][0] in ranker.starts:
            words += lines[stop][0]
            stop += 1
            if words in ranker.line_words and not (words[0] == MARK and len(lines[at][0]) == 2):  # such a line is an identifier
                best = stop, words
        if best:
            begin, end = lines[at][1], lines[best[0] - 1][2]
            yield begin, end, *ranker.line(low[begin:end], best[1])
        at = best[0] if best else at + 1


def matches(ranker: Ranker, text: str) -> Iterator[tuple]:
    """(start, end, license, rank, reduction, missing, extra, confirmed) of each match in a text: lines first, then runs. An
    unconfirmed run that a matched line lies in or touches is read again without the matched lines."""
    lines, kept, again = line_matches(ranker, text), [], []
    yield from lines
    for found in run_matches(ranker, text):
        (kept if found[7] or not _meets(found, lines) else again).append(found)
    if again:
        bare, at = [], 0
        for a, b, *_ in lines:
            bare += [text[at:a], "\n" * (b - max(at, a))]
            at = max(at, b)
        sure = [m for m in kept if m[7]]
        kept += [m for m in run_matches(ranker, "".join(bare) + text[at:]) if _meets(m, again) and not _meets(m, sure)]
    yield from sorted(kept, key=lambda m: m[:2])


def _meets(found: tuple, others: list[tuple]) -> bool:
    return any(a < found[1] and found[0] < b for a, b, *_ in others)


def run_matches(ranker: Ranker, text: str) -> Iterator[tuple]:
    """The matches of runs of the templates' words, in order."""
    if not ranker.candidates(WORDS.findall(text.lower())):
        return
    low = _lower(text)
    found = ranker.candidates(WORDS.findall(low))
    at = [m.span() for m in WORDS.finditer(low)]
    word = lambda i: low[at[i][0] : at[i][1]]
    for begin, end in found:
        while end - begin >= ranker.shortest:
            stop = min(end, begin + ranker.window)
            last = stop
            while last < min(len(at), stop + EDGE) and "\n" not in low[at[last - 1][1] : at[last][0]]:
                last += 1
            words = [word(i) for i in range(begin, last)]
            lead = []
            for i in range(begin - 1, max(-1, begin - 1 - LEAD), -1):
                if re.search(r"[.!?\n]\s*$", low[at[i][1] : at[i + 1][0]]):
                    break
                lead.append(word(i))
            name, place, reduction, missing, extra, sure, a, b = ranker.rank(low[at[begin][0] : at[last - 1][1]], words, lead)
            if sure:
                if a >= ranker.shortest and reduction >= LEAST:  # what comes before the match
                    yield from _before(ranker, low, at, begin, begin + a, lead)
                yield at[begin + a][0], at[begin + b - 1][1], name, place, reduction, missing, extra, True
                begin += b
                continue
            # unconfirmed; of a run that goes on, the window moves by what no template can start before
            through = stop if stop == end else begin + ranker.window // 2
            if reduction >= LEAST:
                yield at[begin][0], at[min(through, last) - 1][1] if through < stop else at[last - 1][1], name, place, reduction, missing, extra, False
            begin = through


def _before(ranker: Ranker, low: str, at: list[tuple[int, int]], begin: int, end: int, lead: list[str]) -> Iterator[tuple]:
    words = [low[a:b] for a, b in at[begin:end]]
    name, place, reduction, missing, extra, sure, a, b = ranker.rank(low[at[begin][0] : at[end - 1][1]], words, lead)
    if sure:
        yield at[begin + a][0], at[begin + b - 1][1], name, place, reduction, missing, extra, True
    elif reduction >= LEAST:
        yield at[begin][0], at[end - 1][1], name, place, reduction, missing, extra, False


def scan(docs: DataFrame, templates: dict[str, str] | None = None, max_missing: int = MAX_MISSING, lines: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per license match or unconfirmed block of `docs` (doc_id, text). Without `templates` and `lines` of one's own
    those built in are looked for."""
    templates, lines = (TEMPLATES | NOTICES, LINES) if templates is None and lines is None else (templates or TEMPLATES, lines)
    names = ["doc_id", "block_start", "block_end", "license", "rank", "reduction", "missing", "extra", "confirmed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(templates, max_missing, lines)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                rows += [(doc_id, *m) for m in matches(ranker, text.as_py() or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, block_start long, block_end long, license string, rank long, reduction double, missing array<string>, extra array<string>, confirmed boolean")


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License matches of all documents with their best template."""
    return scan(table(spark, sf_dir, "documents"))
