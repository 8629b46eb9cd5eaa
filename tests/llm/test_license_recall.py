"""A labelled set of notices in several forms: recall of each, and texts that hold none."""

import pytest

from strataloom.llm import license_compress as lc

FORMS = {
    "identifier": [("// SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}), ("# SPDX-License-Identifier: MIT", {"MIT"}), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", {"GPL-2.0-or-later"}), (" * SPDX-License-Identifier: (MIT OR Apache-2.0)", {"MIT", "Apache-2.0"}), ("SPDX-License-Identifier: BSD-3-Clause AND ISC", {"BSD-3-Clause", "ISC"}), ("<!-- SPDX-License-Identifier: MPL-2.0 -->", {"MPL-2.0"}), ("SPDX-License-Identifier: CC-BY-SA-4.0\r", {"CC-BY-SA-4.0"})],
    "title": [("MIT License", {"MIT"}), ("The MIT License (MIT)", {"MIT"}), ("# MIT License", {"MIT"}), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", {"GPL-3.0"}), ("                                 Apache License\n                           Version 2.0, January 2004\n", {"Apache-2.0"}), ("BSD 3-Clause License", {"BSD-3-Clause"}), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", {"LGPL-2.1"}), ("Mozilla Public License Version 2.0\n==================================", {"MPL-2.0"}), ("ISC License", {"ISC"}), ("CC0 1.0 Universal", {"CC0-1.0"})],
    "notice": [("Distributed under the BSD license.", {"BSD"}), ("Released under the MIT License or the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}), ("This project is available under the MIT license.", {"MIT"}), ("You may use it under the GNU General Public License version 3 or later.", {"GPL-3.0"}), ("It is distributed under the GNU Lesser General Public License, version 2.1.", {"LGPL-2.1"}), ("Code under the BSD 3-Clause License, see below.", {"BSD-3-Clause"}), ("All parts fall under the Boost Software License, Version 1.0.", {"BSL-1.0"}), ("This file is subject to the terms of the Mozilla Public License, version 2.0.", {"MPL-2.0"}), ("Offered under the ISC License.", {"ISC"}), ("Published under the Apache-2.0 license.", {"Apache-2.0"})],
    "text": [(lc.re.sub("<[^<>]*>", "program", t), {n.removesuffix("-header").removesuffix("-text")}) for n, t in lc.TEMPLATES.items()],
}
#: Prose that names no license, or takes one back.
NONE = ["She lost her driving license in the city.", "This license is granted to the owner of the house.", "He got a licence for the MIT campus.", "The project is not under the MIT License.", "It was formerly released under the MIT License.", "The general public may enter, version 3 of the plan says.", "Apache helicopters, version 2.0", "identifier: MIT", "A history of the MIT License and its readers", "Read more about the SPDX-License-Identifier tag."]
ENDS = ("-identifier", "-title", "-notice", "-short", "-version", "-header", "-text")


def plain(name):
    for end in ENDS:
        name = name.removesuffix(end)
    return name


@pytest.fixture(scope="module")
def ranker():
    return lc.Ranker(lc.TEMPLATES | lc.NOTICES, lines=lc.LINES)


@pytest.mark.parametrize("form", FORMS)
def test_recall_of_each_form(ranker, form):
    found = total = 0
    for text, want in FORMS[form]:
        got = {plain(m[2]) for m in lc.matches(ranker, f"Some prose stands here before it all.\n{text}\nand a line of other words goes on behind\n") if m[7]}
        found, total = found + len(got & want), total + len(want)
        assert not got - want, (text, got)
        if got != want:
            print("missed", text[:80], want - got)
    print(form, found, "of", total)
    assert found >= 0.9 * total


def test_none_is_found_where_there_is_none(ranker):
    for text in NONE:
        assert not [m[2] for m in lc.matches(ranker, text) if m[7]], text


def test_offsets_of_lines(spark):
    text = "x\r\n// SPDX-License-Identifier: MIT OR ISC\n\n  GNU General Public License\n Version 2, June 1991\nbody\n"
    rows = lc.scan(spark.createDataFrame([(1, text), (2, None), (3, "MIT License")], "doc_id long, text string")).orderBy("doc_id", "block_start", "license").collect()
    cut = [(r.doc_id, r.license, text[r.block_start : r.block_end] if r.doc_id == 1 else r.block_end, r.confirmed) for r in rows]
    assert cut == [(1, "ISC-identifier", "SPDX-License-Identifier: MIT OR ISC", True), (1, "MIT-identifier", "SPDX-License-Identifier: MIT", True), (1, "GPL-2.0-title", "GNU General Public License\n Version 2, June 1991", True), (3, "MIT-title", 11, True)]


def test_lines_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "House rules one\n")], "doc_id long, text string")
    assert [r.license for r in lc.scan(docs, {"x": "anyone may dance here on all sundays"}, lines={"house": ["House rules one"]}).collect()] == ["house"]


WIDE = "var a=1; " * 60
WHOLE = {
    "a letter that is longer in lower case": ("\u0130stanbul\n// SPDX-License-Identifier: MIT\nISC License\n", ["MIT-identifier", "ISC-title"]),
    "a long line": (f"{WIDE}// SPDX-License-Identifier: MIT OR ISC\nx\n", ["MIT-identifier", "ISC-identifier"]),
    "behind code": ("x = 1  # SPDX-License-Identifier: Zlib\n", ["Zlib-identifier"]),
    "two tags in a line": ("a SPDX-License-Identifier: MIT b SPDX-License-Identifier: ISC\n", ["MIT-identifier", "ISC-identifier"]),
    "over lines": ("// SPDX-License-Identifier: (MIT OR\n//   ISC) AND\n//   Zlib\nISC\n", ["MIT-identifier", "ISC-identifier", "Zlib-identifier"]),
    "a tag on a line of its own": ("SPDX-License-Identifier:\n  MIT\n", ["MIT-identifier"]),
    "a title with a blank line": ("GNU General Public License\n\n  Version 3, 29 June 2007\n", ["GPL-3.0-title"]),
    "a title on three lines": ("GNU\nGeneral Public License\n====\nVersion 3, 29 June 2007\n", ["GPL-3.0-title"]),
    "a numbered title": ("2. MIT License\n", ["MIT-title"]),
    "a wide title": (f"{' ' * 300}MIT{' ' * 300}License\n", ["MIT-title"]),
    "no other line": ("SPDX-License-Identifier: MIT */ int mit, isc;\nISC\n", ["MIT-identifier"]),
    "no word of prose": ("SPDX-License-Identifier: MIT. Das kommt mit, ISC auch.", ["MIT-identifier"]),
}


@pytest.mark.parametrize("case", WHOLE)
def test_lines_are_read_whole(ranker, case):
    text, want = WHOLE[case]
    assert [m[2] for m in lc.line_matches(ranker, text)] == want


def test_a_title_does_not_hide_a_changed_text(ranker):
    """The text after the title is no MIT text, and is shown as unconfirmed."""
    text = "The MIT License (MIT)\n" + lc.TEMPLATES["MIT-text"].replace("without restriction", "without profit, never for war,")
    found = [(m[2], m[7], text[m[0] : m[1]]) for m in lc.matches(ranker, text)]
    assert [f[:2] for f in found] == [("MIT-title", True), ("MIT-text", False)]
    assert found[1][2].startswith("Permission is") and found[1][2].endswith("IN THE SOFTWARE")
