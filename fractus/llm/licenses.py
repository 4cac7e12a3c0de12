"""Licence texts by their sentences (operator 8), with DataFrame functions only.

Texts are normalised with marks where sentences end and lines break, and known
licence sentences are looked up between the marks, wrapped or not; the
identifiers of a text, in order, are then matched against ordered rules. One projection: no shuffle, and texts that can't hold a known
sentence are settled by one search for words that known sentences need.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import unused

# The six licences of Creative Commons.
CREATIVE_COMMONS = {
    "CC-BY": "Attribution",
    "CC-BY-SA": "Attribution-ShareAlike",
    "CC-BY-ND": "Attribution-NoDerivatives",
    "CC-BY-NC": "Attribution-NonCommercial",
    "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
# Identifiers of the SPDX licence list.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 ISC 0BSD Zlib Unlicense BSL-1.0 CC0-1.0 PostgreSQL".split() + [f"{code}-4.0" for code in CREATIVE_COMMONS]
# Sentences of public licence texts, as published, normalised below.
SENTENCES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "mit-short": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero-bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "asf-agreements": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "asf-notice-file": "See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    "asf-grant": "The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-only-of": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    **{f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in SPDX},
    **{f"{code.lower()}-4-notice": f"This work is licensed under a Creative Commons {name} 4.0 International License." for code, name in CREATIVE_COMMONS.items()},
}
#: Ordered rules: a licence is present where these sentences follow one another among a text's known sentences, and no longer rule covers all of them.
RULES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit-notice",),
    "MIT-short": ("mit-short",),
    "MIT-text": ("mit-grant", "mit-condition"),
    "Apache-2.0": ("apache-notice",),
    "Apache-2.0-text": ("apache-grant", "apache-copy", "apache-basis"),
    "GPL-3.0": ("gpl3-notice",),
    "GPL-3.0-or-later-text": ("gpl-redistribute", "gpl-warranty", "gpl-details"),
    "BSD-2-Clause-text": ("bsd-grant", "bsd-source", "bsd-binary"),
    "BSD-3-Clause-text": ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"),
    "CC-BY-NC-4.0": ("cc-by-nc-4",),
    "CC-BY-4.0": ("cc-by-4",),
    "CC-BY-SA-4.0": ("cc-by-sa-4",),
    "GPL-2.0-or-later-text": ("gpl2-redistribute", "gpl-warranty", "gpl-details"),
    "LGPL-2.1-or-later-text": ("lgpl21-redistribute", "lgpl21-warranty"),
    "LGPL-3.0-or-later-text": ("lgpl3-redistribute", "gpl-warranty"),
    "AGPL-3.0-or-later-text": ("agpl3-redistribute", "gpl-warranty"),
    "MPL-2.0-text": ("mpl2-copy",),
    "MPL-2.0-text-https": ("mpl2-copy-https",),
    "ISC-text": ("isc-grant",),
    "ISC-text-and": ("isc-grant-and",),
    "0BSD-text": ("zero-bsd-grant",),
    "Zlib-text": ("zlib-warranty", "zlib-liable", "zlib-grant"),
    "Unlicense-text": ("unlicense-free", "unlicense-grant"),
    "BSL-1.0": ("boost-notice",),
    "BSL-1.0-text": ("boost-grant",),
    "CC0-1.0-text": ("cc0-dedication",),
    "PostgreSQL-text": ("postgres-grant",),
    "EPL-2.0-text": ("epl2-notice",),
    "Apache-2.0-ASF-text": ("asf-agreements", "asf-notice-file", "asf-grant", "apache-copy", "apache-basis"),
    "GPL-2.0-only-text": ("gpl2-only",),
    "GPL-2.0-only-text-of": ("gpl2-only-of",),
    **{f"{name}-spdx": (f"spdx-{name.lower()}",) for name in SPDX},
    **{f"{code}-4.0-text": (f"{code.lower()}-4-notice",) for code in CREATIVE_COMMONS},
}

#: Where a sentence ends: newlines, or a stop, colon or semicolon before white space.
BREAK = r"\n+|[.!?:;][ \t\r]+"
#: Where a sentence ends for certain: a stop, colon or semicolon before white space, or a line without letters and digits. At other newlines it may go on.
END = r"[.!?:;][ \t\r\n]+|\n[^a-z0-9\n]*+\n[^a-z0-9]*+"

#: Sentences that name an owner: what may stand for the name (one to twelve words between fixed ones), and the published form.
OWNER = "neither the name of", "nor the names of its contributors", "the copyright holder"
OWNER_WORDS = 12
#: The colon of an SPDX line doesn't end a sentence: the line is one.
SPDX_LINE = r"(spdx-license-identifier)[ \t]*:[ \t]*"


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def parts_of(text: str) -> list[str]:
    return [x for x in (normal(s) for s in re.split(BREAK, re.sub(SPDX_LINE, r"\1 ", text, flags=re.I))) if x]


def known_sentences(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentences and their identifiers; a text of several sentences gives ``id``, ``id+1``, and so on. The first text that has a sentence names it."""
    out: dict[str, str] = {}
    for name, text in sentences.items():
        for i, part in enumerate(parts_of(text)):
            out.setdefault(part, name if i == 0 else f"{name}+{i}")
    return out


def needed_words(known: dict[str, str]) -> list[str]:
    """Few words of which every known sentence has one: greedy cover, longer words first on ties."""
    left, out = [set(s.split()) for s in known], []
    while left:
        words = {w for s in left for w in s}
        best = min(words, key=lambda w: (-sum(w in s for s in left if len(w) > 3), -len(w), w))
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def _rules(sentences: dict[str, str], rules: dict[str, tuple[str, ...]]) -> list[tuple[str, str, list[str]]]:
    """Names, sequences as ``,id,,id,`` and the longer rules' sequences that hold each, longest first."""
    known = known_sentences(sentences)
    ids = {name: [known[part] for part in parts_of(text)] for name, text in sentences.items()}
    sequences = {rule: "".join(f",{i}," for s in parts for i in ids[s]) for rule, parts in rules.items()}
    longer = {r: sorted({x for x in sequences.values() if s in x and s != x}, key=lambda x: (-len(x), x)) for r, s in sequences.items()}
    return sorted((rule, sequence, longer[rule]) for rule, sequence in sequences.items())


def _marked(text: Column) -> Column:
    """Normalised words of a text; H stands where a sentence ends, S at a newline within which it may go on."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(out, SPDX_LINE, "$1 ")
    out = F.regexp_replace(F.regexp_replace(out, END, "H"), "\n", "S")
    out = F.concat(F.lit("H"), F.regexp_replace(out, "[^a-z0-9HS]+", " "), F.lit("H"))
    out = F.regexp_replace(F.regexp_replace(out, "[S ]*H[HS ]*", "H"), " *S[S ]*", "S")
    before, behind, form = (part.replace(" ", "[ S]") if k < 2 else part for k, part in enumerate(OWNER))
    return F.regexp_replace(out, f"(?<=[HS])({before})(?:[HS ][a-z0-9]+){{1,{OWNER_WORDS}}}?[HS ]({behind})(?=[ S])", f"$1 {form} $2")


def license_scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``docs`` with n_known (long), sentence_ids and licenses (strings, comma-joined).

    A known sentence is found on one line or wrapped over several, indented or
    behind comment marks without letters; a blank line ends it. Of sentences
    that begin together the longest counts. Where a sentence names an owner
    (:data:`OWNER`) any name of up to ``OWNER_WORDS`` words, stops included, stands for the published one.
    ``sentence_ids`` are the known sentences in order, repeats included;
    ``licenses`` the names of the rules found, sorted; a rule whose sentences all
    belong to a longer rule's (BSD-2-Clause in BSD-3-Clause) isn't. A line with an
    SPDX identifier is a sentence; expressions of several identifiers are unknown. Null and empty texts have
    none (0 and empty strings). Every row is judged alone, so repeated rows and
    ids, null ids and empty tables need no care. Columns of these names are
    replaced; all others are carried along.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = known_sentences(sentences)
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    possible = text.rlike("(?i)" + "|".join(needed_words(known)))
    # The longest first: a wrapped sentence may begin with a line that is another one.
    pattern = "|".join(s.replace(" ", "[ S]") for s in sorted(known, key=lambda s: (-len(s), s)))
    sentence = F.regexp_extract_all(_marked(text), F.lit(f"(?<=[HS])(?:{pattern})(?=[HS])"), F.lit(0))
    found = F.transform(sentence, lambda s: F.element_at(lookup, F.translate(s, "S", " ")))
    ids = F.when(possible, found).otherwise(F.array().cast("array<string>"))
    docs = docs.drop("n_known", "sentence_ids", "licenses")
    (work,) = unused(docs, "ids")
    out = docs.withColumn(work, ids)
    line = F.concat(F.lit(","), F.array_join(work, ",,"), F.lit(","))

    def alone(longer: list[str]) -> Column:
        left = line
        for sequence in longer:
            left = F.replace(left, F.lit(sequence), F.lit(" "))
        return left

    hits = F.array_compact(F.array(*[F.when(alone(longer).contains(sequence), F.lit(rule)) for rule, sequence, longer in _rules(sentences, rules)]))
    licenses = F.when(F.size(work) > 0, F.array_join(hits, ",")).otherwise(F.lit(""))
    return out.withColumns({"n_known": F.size(work).cast("long"), "sentence_ids": F.array_join(work, ","), "licenses": licenses}).drop(work)


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in known_sentences(SENTENCES).items())
    rules = ", ".join(f"({quoted(k)}, {quoted(v)}, {quoted(x[0] if x else '|')}, {quoted(x[1] if len(x) > 1 else '|')})" for k, v, x in _rules(SENTENCES, RULES))
    assert all(len(x) <= 2 for _, _, x in _rules(SENTENCES, RULES))
    before, behind = (part.replace(" ", "[^a-z0-9]+") for part in OWNER[:2])
    named = f"'({before})(?:[^a-z0-9]+[a-z0-9]+){{1,{OWNER_WORDS}}}?[^a-z0-9]+({behind})', '\\1 {OWNER[2]} \\2', 'g'"
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(rule, seq, longest, longer) AS (VALUES {rules}), s AS (
  SELECT doc_id, i, trim(regexp_replace(a[i], '[^a-z0-9]+', ' ', 'g')) AS sentence
  FROM (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPDX_LINE}', '\\1 ', 'g'), {named}), '{BREAK}') AS a FROM documents), unnest(range(1, len(a) + 1)) AS u(i)
), f AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM s JOIN known USING (sentence) GROUP BY doc_id
), l AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS names FROM f JOIN rules ON contains(replace(replace(',' || replace(ids, ',', ',,') || ',', longest, ' '), longer, ' '), seq) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(names, '') AS licenses
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)
"""
