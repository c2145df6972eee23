import random
import re

import duckdb
import pytest

from fieldsense.llm import license as X

from . import cases


def test_templates_are_found_and_told_apart():
    s = X.Scanner()
    for name, notice in X.NOTICES:
        found = s.scan(f"Some prose here, long enough to be a line.\n{notice}\nMore prose after it that goes on.")
        assert [f.license for _, _, f in found] == [name], notice[:200]
        assert found[0][0] >= 1 and found[0][2].missing == found[0][2].added == ""
        assert re.search(X.CUE, notice)
    assert s.scan("This work is licensed under the GNU General Public License, version 2.")[0][2].license == "GPL-2.0"
    assert s.scan("Licensed under the Apache License, Version 1.1.") == []
    assert s.scan("My license to drive was not renewed, all rights aside.") == []
    assert s.scan("Copyright 2021 A. Person. All rights reserved.")[0][2].license == "LicenseRef-Proprietary"


GPL3 = """// Copyright (C) 2020  A. Person
//
// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
// GNU General Public License for more details."""
MPL2 = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/."""
CLAUSES = """Copyright (c) 2019, Some Lab
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of Some Lab nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
HEADERS = {
    "wrapped GPL-3 header": (GPL3, "GPL-3.0", 2, 9),
    "wrapped GPL-2 header": (GPL3.replace("software: you", "software; you").replace("version 3", "version 2"), "GPL-2.0", 2, 9),
    "wrapped LGPL header": (GPL3.replace("GNU General", "GNU Lesser General"), "LGPL-3.0", 2, 9),
    "wrapped MPL header": (MPL2, "MPL-2.0", 0, 3),
    "two clauses": (CLAUSES, "BSD-2-Clause", 3, 9),
    "three clauses": (CLAUSES + THIRD, "BSD-3-Clause", 3, 13),
    "ISC": (ISC, "ISC", 0, 11),
    "Unlicense": (UNLICENSE, "Unlicense", 0, 6),
    "CC BY": ("This work is licensed under the Creative Commons Attribution 4.0 International License.", "CC-BY-4.0", 0, 1),
    "CC BY-NC": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0", 0, 1),
    "SPDX MIT": ("# SPDX-License-Identifier: MIT", "MIT", 0, 1),
    "SPDX GPL": ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later", 0, 1),
}


@pytest.mark.parametrize("what", HEADERS)
def test_real_headers(what):
    text, name, line, n = HEADERS[what]
    found = X.Scanner().scan(f"Prose that comes before.\n\n{text}\n\nimport os\nprint('the code')")
    assert [(a, b, f.license) for a, b, f in found] == [(line + 2, n, name)]


def test_whole_texts_with_changes():
    s, rnd = X.Scanner(), random.Random(4)
    for name, text in X.NOTICES[-len(X.WHOLE):]:
        parts = text.split(" ")
        for _ in range(len(parts) // 60):
            parts[rnd.randrange(len(parts))] += "\n// qq"
        (_, _, f), = s.scan("Chapter one.\n" + " ".join(parts) + "\nChapter two.")
        assert f.license == name and 0 < len(f.added.split()) <= len(parts) // 60


def test_no_better_template_is_passed_over():
    """Against all templates held against every run of words by difflib alone."""
    rnd = random.Random(2)
    short = [x for x in X.NOTICES if len(X.words(x[1])) < 30]
    s = X.Scanner(short)
    for _ in range(60):
        name, notice = rnd.choice(short)
        w = X.words(notice)
        for _ in range(rnd.randint(0, 2)):
            w.insert(rnd.randrange(len(w)), rnd.choice(("hereby", "kindly", "please")))
        if not s.seeds.keys() & {*zip(w, w[1:], w[2:])}:
            continue  # no three words are left together: no candidate, as stated
        w = ["prose", "before", *w, "prose", "after"]
        best = None
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                for k, t in enumerate(s.words):
                    missing, added, x, y = s.differences(w[a:b], k)
                    if (x or y or len(missing) > (1 - X.COVERED) * len(t) or len(added) > X.BESIDES * (b - a)
                            or any(v in X.TELLING or v[0].isdigit() for v in (*missing, *added))):
                        continue
                    order = (len(missing) - len(t), len(missing) + len(added))
                    best = min(best or order, order)
        found = s.scan(" ".join(w))
        mine = min(((-f.matched, len(f.missing.split()) + len(f.added.split())) for _, _, f in found), default=None)
        assert mine == best, w


def test_wrapped_and_changed_notices():
    s = X.Scanner()
    (line, n, f), = s.scan("Title.\n\nLicensed under the\nApache License, Version 2.0.\nThen the text goes on with other words.")
    assert (line, n, f.license, f.missing, f.added) == (2, 2, "Apache-2.0", "", "")
    (_, _, f), = s.scan("This work is hereby licensed under the GNU General Public License, version 3.")
    assert (f.license, f.missing, f.added, f.rank) == ("GPL-3.0", "", "hereby", 1)


def test_a_notice_within_a_long_line():
    prose = "The story goes on for a while and names many things that are of no use here. " * 60
    found = X.Scanner().scan(f"{prose}Released under the MIT License. {prose}\nThe end.")
    assert [(a, n, f.license) for a, n, f in found] == [(0, 1, "MIT")]


def test_reduction_ranks_the_own_template_first():
    s = X.Scanner()
    for k, (_, notice) in enumerate(X.NOTICES):
        ranked = s.rank(X.words(notice))
        saved = dict((t, x) for x, t in ranked)
        assert saved[k] > 0 and (len(notice) < 200 or X.NOTICES[ranked[0][1]][0] == X.NOTICES[k][0] or saved[k] >= ranked[0][0] - 0.1), notice[:100]


def test_edge_cases(spark):
    rows = [*cases.texts(), (900, "Released under the MIT License.\nAll rights reserved.", "en", "a", 1), (900, "Released under the MIT License.", "en", "a", 1),
            (None, "Released under the MIT License.", None, None, None)]
    out = X.scan_licenses(cases.documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.line, r.license) for r in out), key=repr) == sorted(
        [(900, 0, "MIT"), (900, 1, "LicenseRef-Proprietary"), (900, 0, "MIT"), (None, 0, "MIT")], key=repr)
    assert X.scan_licenses(cases.documents(spark, [])).count() == 0


def test_query_finds_every_notice(spark):
    d = "/root/testdata/sf0.01"
    lines = "('Released under the MIT License.', 'Licensed under the Apache License, Version 2.0.', 'All rights reserved.', " \
            "'Licensed under CC BY-NC 4.0.', 'This work is licensed under the GNU General Public License, version 3.')"
    want = duckdb.sql(f"SELECT doc_id FROM (SELECT doc_id, unnest(split(text, chr(10))) l FROM '{d}/documents.parquet') WHERE l IN {lines}").fetchall()
    assert sorted((r.doc_id,) for r in X.op2_license_scan(spark, d).collect()) == sorted(want)
