"""Unabridged, hard-wrapped licence notices."""

from __future__ import annotations

import textwrap

import pytest

from corpusmill.llm.licenses import license_scan

MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES."""
GNU = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
ISC = """Copyright (c) 2020 A. Person

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    (MIT, ["MIT"]), (BSD_2 + DISCLAIMER, ["BSD-2-Clause"]), (BSD_2 + THIRD.format("the copyright holder") + DISCLAIMER, ["BSD-3-Clause"]),
    (BSD_2 + THIRD.format("the University of Some Town") + DISCLAIMER, ["BSD-3-Clause"]),
    (BSD_2 + THIRD.format("the " + "University of Some Town and " * 40 + "Others") + DISCLAIMER, ["BSD-3-Clause"]),
    ("Creative Commons Attribution 4.0 International", ["CC-BY-4.0"]),
    ("Released under the MIT License, see LICENSE.", ["MIT"]), ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
    ("Neither the name of a holder. " + MIT, ["MIT"]),
    (GNU.format("program", ";", "General Public License", ";", "2"), ["GPL-2.0-or-later"]),
    (GNU.format("program", ":", "General Public License", ",", "3"), ["GPL-3.0-or-later"]),
    (GNU.format("library", ";", "Lesser General Public License", ";", "2.1"), ["LGPL-2.1-or-later"]),
    (GNU.format("program", ":", "Affero General Public License", ",", "3"), ["AGPL-3.0-or-later"]),
    (APACHE, ["Apache-2.0"]), (ISC, ["ISC"]), (MPL, ["MPL-2.0"]),
    ("CC0 1.0 Universal", ["CC0-1.0"]), ("The third clause of the MIT License\nis named in a sentence.", []),
]


def wrapped(text: str, width: int, mark: str) -> str:
    """Every paragraph wrapped, each line behind a comment mark."""
    lines = [x for p in text.split("\n") for x in textwrap.wrap(p, width) or [""]]
    return "\n".join(f"{mark}{x}".rstrip() for x in lines)


@pytest.mark.parametrize("width, mark, end", [(10_000, "", "\n"), (72, "", "\n"), (60, "# ", "\n"), (33, " * ", "\r\n")])
def test_unabridged_notices(spark, width, mark, end):
    rows = [(i, "Some text before it\n\n" + wrapped(text, width, mark).replace("\n", end)) for i, (text, _) in enumerate(NOTICES)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [want for _, want in NOTICES]


def test_sentences_of_the_wrapped_mit_text(spark):
    rows = [(1, wrapped(MIT, 72, ""))]
    assert license_scan(spark.createDataFrame(rows, "doc_id long, text string")).first()["sentence_ids"] == [4, 2, 5, 3, 6]


def test_spdx_lines(spark):
    rows = [(1, "// SPDX-License-Identifier: Apache-2.0\ncode\n# SPDX-License-Identifier: MIT"), (2, "SPDX-License-Identifier:"),
            (3, "SPDX-License-Identifier: MIT\nReleased under the MIT License.")]
    got = {r["doc_id"]: r["licenses"] for r in license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: ["Apache-2.0", "MIT"], 2: [], 3: ["MIT"]}


def test_holder_of_thousands_of_words(spark):
    name = "the " + "University of Some Town and " * 3000 + "Others"
    rows = [(BSD_2 + THIRD.format(name) + DISCLAIMER,), ("Neither the name of " + "word " * 50_000,)]
    assert [r["licenses"] for r in license_scan(spark.createDataFrame(rows, "text string")).collect()] == [["BSD-3-Clause"], []]
