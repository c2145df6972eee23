"""License scan by conditional compression.

Runs of words that share word triples with a template are candidate blocks. A
block is compressed with each template as a raw zstandard dictionary. The
templates are ranked by how much smaller that makes the block, and those that
help are confirmed by the exact differences in wording: a license is found when
the block has its template's words, and no difference touches a word that tells
licenses apart."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from importlib.resources import files
from math import ceil

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_and_text, in_batches

# Names of licenses as notices give them, by SPDX identifier.
NAMED = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("ISC", "ISC License"),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Unlicense", "Unlicense"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)
LEADS = ("Licensed under the", "Released under the", "This work is licensed under the", "This project is licensed under the")
SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
        "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Zlib", "BSL-1.0", "Unlicense", "0BSD", "CC0-1.0", "CC-BY-4.0",
        "CC-BY-SA-4.0", "CC-BY-NC-4.0")

# Wording of license notices and texts, as published with the licenses.
_GNU = ("{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as "
        "published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.\n\n"
        "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.")
_BSD_CONDITIONS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                   "following conditions are met:")
_BSD_TWO = (" 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
            "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_THIRD = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.")
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
              "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
              "to permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_REST = (" The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
             "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
             "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
             "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
             "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
WORDING = (
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_REST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
                   "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    *((f"{kind}GPL-{v}", form) for kind, word, v, n in (("", "", "2.0", "2"), ("", "", "3.0", "3"), ("L", "Lesser ", "2.1", "2.1"),
                                                       ("L", "Lesser ", "3.0", "3"), ("A", "Affero ", "3.0", "3"))
      for form in (_GNU.format("This program", word, n).split("\n\n")[0], _GNU.format("This program", word, n),
                   _GNU.format("This library", word, n))),
    ("LicenseRef-BSD", _BSD_CONDITIONS),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_TWO),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_TWO + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_TWO + _BSD_THIRD),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
             "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
             "original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                  "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("LicenseRef-Proprietary", "All rights reserved."),
)
#: Whole texts, as published, in ``licenses/<identifier>.txt``.
WHOLE = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
NOTICES = (
    *((name, f"{lead} {called}.") for name, called in NAMED for lead in LEADS),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
    *WORDING,
    *((name, (files(__package__) / "licenses" / f"{name}.txt").read_text(encoding="utf-8")) for name in WHOLE),
)

#: What a text that can hold a notice has; every template has it.
CUE = r"(?i)licen[cs]e|rights\W+reserved|hereby\W+granted|permission\W+is\W+granted|redistribution|public\W+domain"
#: The share of a template's word triples (those that it has once) that make a
#: run of words a candidate, the share of a template's words that a block
#: needs, and of the block's words that it may have besides.
SEEDED, COVERED, BESIDES = 0.25, 0.85, 0.35
#: A reservation of rights so many words before another notice is part of it.
RESERVED, RESERVED_NEAR = "LicenseRef-Proprietary", 12
#: Words in which licenses differ; numbers are such words too.
TELLING = frozenset("mit apache gnu general lesser affero public mozilla bsd clause cc cc0 by sa nc nd not non without commercial "
                    "noncommercial sharealike noderivatives attribution isc zlib boost unlicense only later neither endorse "
                    "all rights reserved no domain".split())
#: Results that a process keeps, of blocks of so many characters at most.
KEPT, KEPT_CHARS = 20_000, 2_000
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: What makes no difference: the v and the zeros of versions.
_VERSION = re.compile(r"(?<![^\W_])v(?=\d)|(?<=\d)(?:\.0)+(?![.\d]*\d)")
_YEAR = re.compile(r"(19|20)\d\d")


def plain(text: str) -> str:
    """In lower case, versions and the British spelling made alike; line ends stay."""
    return _VERSION.sub("", text.lower()).replace("licence", "license")


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


@dataclass(frozen=True)
class Finding:
    license: str
    template: int
    reduction: float
    rank: int
    missing: str
    added: str
    #: words of the template that the block has, and words at either end of the block that aren't the notice's
    matched: int = 0
    before: int = 0
    after: int = 0


class Scanner:
    """Ranks and confirms; one for each process."""

    def __init__(self, notices=NOTICES):
        self.names = [n for n, _ in notices]
        self.words = [words(t) for _, t in notices]
        self.bags = [Counter(w) for w in self.words]
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.with_template = []
        self.seeds: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for k, w in enumerate(self.words):
            d = zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            self.with_template.append(zstandard.ZstdCompressor(level=3, dict_data=d))
            triples = list(zip(w, w[1:], w[2:]))
            often = Counter(triples)
            once = [(t, j) for j, t in enumerate(triples) if often[t] == 1]
            for t, j in once:
                self.seeds[t].append((k, j))
            self.need.append(max(1, round(SEEDED * len(once))))
        self.seeds = dict(self.seeds)
        self.find_kept = lru_cache(maxsize=KEPT)(self._find)

    def rank(self, block: list[str]) -> list[tuple[float, int]]:
        """(share of the compressed size saved, template), the best first,
        ties in the order of the templates."""
        data = " ".join(block).encode()
        alone = len(self.compressor.compress(data))
        saved = [(1 - len(c.compress(data)) / alone, k) for k, c in enumerate(self.with_template)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def differences(self, block: list[str], k: int) -> tuple[list[str], list[str], int, int]:
        """The template's words that the block lacks, the block's words that
        the template lacks, and how many words before and after the notice the
        block has."""
        template, missing, added = self.words[k], [], []
        steps = [s for s in SequenceMatcher(None, template, block, autojunk=False).get_opcodes() if s[0] != "equal"]
        before = after = 0
        for n, (tag, a, b, c, d) in enumerate(steps):
            if c == 0 < d:
                before, steps[n] = d, (tag, a, b, d, d)
            elif c < d == len(block):
                after, steps[n] = d - c, (tag, a, b, c, c)
        for _, a, b, c, d in steps:
            missing += template[a:b]
            added += block[c:d]
        return missing, added, before, after

    def find(self, block: list[str]) -> Finding | None:
        joined = " ".join(block)
        return (self.find_kept if len(joined) <= KEPT_CHARS else self._find)(joined)

    def _find(self, joined: str) -> Finding | None:
        """The confirmed template with the most words, of equals the one with
        the fewest differences. All templates that save anything are
        confirmed, but for those that lack too many words in any order."""
        block = joined.split(" ")
        bag, best = Counter(block), None
        for rank, (saved, k) in enumerate(self.rank(block)):
            most = (1 - COVERED) * len(self.words[k])
            if saved <= 0:
                break
            if (self.bags[k] - bag).total() > most:
                continue
            missing, added, before, after = self.differences(block, k)
            if (len(missing) <= most and len(added) <= BESIDES * (len(block) - before - after)
                    and not any(w in TELLING or w[0].isdigit() and not _YEAR.fullmatch(w) for w in (*missing, *added))):
                matched = len(self.words[k]) - len(missing)
                order = (-matched, len(missing) + len(added), rank)
                if not best or order < best[0]:
                    best = order, Finding(self.names[k], k, saved, rank + 1, " ".join(missing), " ".join(added), matched, before, after)
        return best[1] if best else None

    def candidates(self, text_words: list[str]) -> set[tuple[int, int]]:
        """Ranges of words that have enough of a template's triples, in its
        order and about as far apart; a range is as long as the template makes it."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(zip(text_words, text_words[1:], text_words[2:])):
            for k, j in self.seeds.get(t, ()):
                hits[k].append((i, j))
        out = set()
        for k, found in hits.items():
            if len(found) < self.need[k]:
                continue
            size = len(self.words[k])
            drift, groups, done = 3 + BESIDES * size, [], []
            for i, j in found:
                done += [g for g in groups if i > g[0] + 2 * size + drift]
                groups = [g for g in groups if i <= g[0] + 2 * size + drift]
                for g in reversed(groups):
                    if j > g[3] and abs((i - j) - (g[2] - g[3])) <= drift:
                        g[2], g[3], g[4] = i, j, g[4] + 1
                        break
                else:
                    groups.append([i, j, i, j, 1])
            for first, at, last, to, n in (*done, *groups):
                if n >= self.need[k]:
                    # the outer words of a notice may have up to three others after each
                    rest, most = size - to - 3, ceil(BESIDES / (1 - BESIDES) * size)
                    out.add((max(0, first - at - min(3 * at, most)), min(len(text_words), last + 3 + rest + min(3 * rest, most))))
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, Finding]]:
        """(first line, number of lines, finding) in the order of the text. Of
        findings that overlap the one with the most of its template's words
        stands, then the one with the fewest differences, then the first."""
        low = plain(text or "")
        own = _WORD.findall(low)
        found = []
        for a, b in self.candidates(own):
            if f := self.find(own[a:b]):
                found.append((-f.matched, len(f.missing) + len(f.added), a + f.before, b - f.after, f))
        if not found:
            return []
        found.sort(key=lambda x: x[:4])
        taken, kept = bytearray(len(own)), []
        for _, _, a, b, f in found:
            if 1 not in taken[a:b]:
                taken[a:b] = b"\x01" * (b - a)
                kept.append((a, b, f))
        kept.sort(key=lambda x: x[0])
        kept = [x for x, after in zip(kept, [*kept[1:], None])
                if not (x[2].license == RESERVED and after and after[2].license != RESERVED and after[0] - x[1] <= RESERVED_NEAR)]
        ends = {x for a, b, _ in kept for x in (a, b - 1)}
        line, at, line_of = 0, 0, {}
        for i, m in enumerate(_WORD.finditer(low)):
            if i in ends:
                line += low.count("\n", at, m.start())
                at, line_of[i] = m.start(), line
        return [(line_of[a], line_of[b - 1] - line_of[a] + 1, f) for a, b, f in kept]


def scan_licenses(docs: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each notice found: doc_id, line and n_lines of its block,
    license, template, reduction and its rank among the templates, and the
    words missing and added.

    A block can begin anywhere in a line and span lines, blank ones too. Texts
    without a cue never reach Python. A null or empty text has no notice; a
    null id stays null; repeated rows give repeated rows; an empty table gives
    none; other columns are ignored. One pass, no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("n_lines", pa.int64()), ("license", pa.string()),
                        ("template", pa.int64()), ("reduction", pa.float64()), ("reduction_rank", pa.int64()),
                        ("missing", pa.string()), ("added", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        rows = ((i.as_py(), line, n, f.license, f.template, f.reduction, f.rank, f.missing, f.added)
                for b in batches for i, t in zip(b.column(0), b.column(1)) for line, n, f in scanner.scan(t.as_py()))
        return in_batches(rows, schema)

    return id_and_text(docs, id_col, text_col).where(F.col("text").rlike(CUE)).mapInArrow(
        run, "doc_id bigint, line bigint, n_lines bigint, license string, template bigint, reduction double, "
             "reduction_rank bigint, missing string, added string")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """The license notices of all documents."""
    return scan_licenses(documents(spark, sf_dir))
