"""Licence texts wrapped as published."""

import pytest

from fractus.llm.licenses import RULES, SENTENCES, license_scan

MIT = """MIT License

Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions."""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """Copyright (c) 2020, A. Writer
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
SCHEMA = "doc_id long, text string"


def behind(mark, text, end="\n"):
    return end.join(mark + line for line in text.split("\n"))


@pytest.mark.parametrize("change", [str, lambda t: behind("# ", t), lambda t: "/*\n" + behind(" * ", t) + "\n */", lambda t: behind("// ", t, "\r\n")])
def test_wrapped_texts(spark, change):
    rows = [(i, change(t)) for i, t in enumerate((MIT, APACHE, GPL, BSD))]
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "MIT-text", 1: "Apache-2.0-text", 2: "GPL-3.0-or-later-text", 3: "BSD-3-Clause-text"}


def test_lines_that_are_sentences_stay(spark):
    rows = [
        (0, "Licensed under the MIT License\nand more"),
        (1, "see\nReleased under the\nMIT License.\nLicensed under CC BY 4.0\nend"),
        (2, "Released under\n\nthe MIT License."),
        (3, "Licensed under the Apache License, Version 2.0\n(the \"License\"); you"),
        (4, "We released under the\nMIT License."),
    ]
    got = {r.doc_id: r.sentence_ids for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "mit-short", 1: "mit-notice,cc-by-4", 2: "", 3: "apache-grant", 4: ""}


def test_longer_rules_win(spark):
    two = BSD[: BSD.index("3. Neither")]
    rows = [(0, two), (1, BSD + "\n" + BSD), (2, BSD + "\n" + two), (3, two + "\n" + BSD)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, ids int, IDS_ int")
    out = license_scan(docs)
    assert out.columns == [*docs.columns, "n_known", "sentence_ids", "licenses"]
    both = "BSD-2-Clause-text,BSD-3-Clause-text"
    assert {r.doc_id: r.licenses for r in out.collect()} == {0: "BSD-2-Clause-text", 1: "BSD-3-Clause-text", 2: both, 3: both}


def test_every_rule_is_found_in_its_sentences(spark):
    wrapped = lambda t: t.replace(", ", ",\n    ")
    rows = [(rule, wrapped("\n\n".join(SENTENCES[s] for s in parts))) for rule, parts in RULES.items()]
    got = license_scan(spark.createDataFrame(rows, "rule string, text string")).collect()
    assert len(got) == len(RULES) > 30 and all(r.licenses == r.rule for r in got)


def test_very_long_stretches_without_letters(spark):
    """Hundreds of thousands of blank lines or bare comment marks are one end of a sentence."""
    grant, condition = SENTENCES["mit-grant"], SENTENCES["mit-condition"]
    for line in ("", " * ", "//", "\t"):
        gap = ("\n" + line) * 200_000
        text = f"The software{gap}\n{grant}{gap}\n{condition}{gap}license"
        (row,) = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert row.licenses == "MIT-text" and row.n_known >= 2


def test_named_owners(spark):
    """The third clause of BSD names whoever holds the copyright."""
    names = ["the copyright holder", "Google Inc.", "the University of California, Berkeley", "A.\n   Writer", "a b c d e f g h i j k l m"]
    rows = [(i, BSD.replace("the copyright holder nor", f"{n} nor")) for i, n in enumerate(names)]
    assert all("nor the names" in t.replace("\n", " ").replace("  ", " ") or "nor the\n" in t for _, t in rows)
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "BSD-3-Clause-text", 1: "BSD-3-Clause-text", 2: "BSD-3-Clause-text", 3: "BSD-3-Clause-text", 4: "BSD-2-Clause-text"}


ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
GPL2_OF = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; version 2 of the License."""
GPL2_LATER = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


@pytest.mark.parametrize("change", [str, lambda t: behind("# ", t), lambda t: "/*\n" + behind(" * ", t) + "\n */"])
def test_headers_that_share_sentences(spark, change):
    rows = [(i, change(t)) for i, t in enumerate((ASF, APACHE, GPL2_ONLY, GPL2_OF, GPL2_LATER))]
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "Apache-2.0-ASF-text", 1: "Apache-2.0-text", 2: "GPL-2.0-only-text", 3: "GPL-2.0-only-text-of", 4: "GPL-2.0-or-later-text"}


def test_spdx_lines(spark):
    rows = [
        (0, "// SPDX-License-Identifier: MIT\nint main;"),
        (1, "/* spdx-license-identifier:Apache-2.0 */"),
        (2, "# Copyright 2020 A. Writer\n# SPDX-License-Identifier: GPL-2.0-or-later\n\nimport os"),
        (3, "SPDX-License-Identifier: MIT OR Apache-2.0"),
        (4, "the tag SPDX-License-Identifier: MIT is read"),
        (5, "SPDX-License-Identifier: CC-BY-NC-SA-4.0\r\nSPDX-License-Identifier: BSD-3-Clause"),
        (6, "MIT"),
    ]
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "MIT-spdx", 1: "Apache-2.0-spdx", 2: "GPL-2.0-or-later-spdx", 3: "", 4: "", 5: "BSD-3-Clause-spdx,CC-BY-NC-SA-4.0-spdx", 6: ""}
