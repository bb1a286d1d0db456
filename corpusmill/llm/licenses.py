"""Licences of a document by its sentences.

A text is cut into sentences at blanks after an end mark and at empty lines;
a sentence is normalised to lower-case words and numbers. A known sentence may
be wrapped over lines, behind comment marks or not, and begins and ends at the
break of a line or sentence. Known licence sentences have identifiers, and the
sequence of the identifiers in a document is matched against ordered rules: a
rule is a run of identifiers, and the runs of an earlier rule are taken out
before a later one is tried. So the sentences of a longer notice are not read
as a shorter one.

`SQL` reads one-line notices (`SENTENCES`, `RULES`) only. It equals the operator
on tables without wrapped or unabridged notices, such as the given ones.

Everything is an expression over one row. Nulls and the like: a null or empty
text has no sentence and no licence; repeated rows are read alike. Extra columns
are carried along; those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import column_or_null, packed, unpacked

# Normalised sentences of one-line licence notices and their identifiers.
SENTENCES = {
    "released under the mit license": 1,
    "licensed under the mit license": 1,
    "this project is licensed under the mit license": 1,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": 2,
    "the software is provided as is without warranty of any kind": 3,
    "licensed under the apache license version 2 0": 10,
    "licensed under the apache license version 2 0 the license": 10,
    "you may not use this file except in compliance with the license": 11,
    "you may obtain a copy of the license at": 12,
    "this work is licensed under the gnu general public license version 3": 20,
    "this program is free software": 21,
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation either version 3 of the license or at your option any later version": 22,
    "this program is distributed in the hope that it will be useful": 23,
    "licensed under cc by 4 0": 30,
    "licensed under cc by sa 4 0": 31,
    "licensed under cc by nc 4 0": 32,
    "licensed under cc by nc nd 4 0": 33,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": 40,
    "all rights reserved": 50,
}
#: Rules in order: a run of identifiers and the licence it stands for.
RULES = (
    ((2, 3), "MIT"), ((2,), "MIT"), ((1,), "MIT"),
    ((10, 11, 12), "Apache-2.0"), ((10, 11), "Apache-2.0"), ((10,), "Apache-2.0"),
    ((21, 22), "GPL-3.0-or-later"), ((22,), "GPL-3.0-or-later"), ((20,), "GPL-3.0-only"),
    ((30,), "CC-BY-4.0"), ((31,), "CC-BY-SA-4.0"), ((32,), "CC-BY-NC-4.0"), ((33,), "CC-BY-NC-ND-4.0"),
    ((40, 3), "BSD-2-Clause"), ((40,), "BSD-2-Clause"), ((50,), "Proprietary"),
)
_NAMES = "neither the name of the copyright holder nor the names of its contributors"
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
#: The sentences and headings of unabridged notices; some share the identifier of their one-line form.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
    "the software is furnished to do so subject to the following conditions": 2,
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": 3,
    **dict.fromkeys(("mit license", "the mit license", "the mit license mit"), 4),
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "software": 5,
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
    "action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
    "dealings in the software": 6,
    "the asf licenses this file to you under the apache license version 2 0 the license": 10,
    "apache license version 2 0 january 2004": 13,
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
    "as is basis without warranties or conditions of any kind either express or implied": 14,
    "gnu general public license version 2 june 1991": 17, "gnu general public license version 3 29 june 2007": 18,
    "this program is distributed in the hope that it will be useful but without any warranty": 23,
    _GNU.format("general public license"): 24,
    _LATER.format("2"): 25, _LATER.format("2 1"): 26, _LATER.format("3"): 27,
    f"{_GNU.format('general public license')} {_LATER.format('2')}": 28,
    **dict.fromkeys((_GNU.format("general public license version 2"), _GNU.replace(" as published", "{}").format(
        "general public license", " version 2 of the license as published")), 29),
    **dict.fromkeys((_GNU.format("general public license version 3"), _GNU.replace(" as published", "{}").format(
        "general public license", " version 3 of the license as published")), 19),
    "creative commons attribution 4 0 international": 30, "creative commons attribution 4 0 international license": 30,
    "creative commons attribution sharealike 4 0 international": 31,
    "creative commons attribution sharealike 4 0 international license": 31,
    "released under the mit license see license": 1, "licensed under the mit license see license": 1,
    "boost software license version 1 0 17th august 2003": 92, "boost software license version 1 0 august 17th 2003": 92,
    "distributed under the boost software license version 1 0": 92,
    "cc0 1 0 universal": 34, "licensed under cc0 1 0": 34,
    **{f"to the extent possible under law the {who} all copyright and related {kind} neighboring rights to this {what}": 35
       for who in ("author s have waived", "author has waived", "person who associated cc0 with this work has waived")
       for kind in ("or", "and") for what in ("work", "software")},
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this "
    "software to the public domain worldwide": 35,
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": 41,
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": 42,
    f"{_NAMES} {_ENDORSE}": 43,
    _ENDORSE.replace("may be", "the name of the author may not be"): 43,
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": 44,
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including "
    "but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": 45,
    **dict.fromkeys(("bsd 3 clause license", "the 3 clause bsd license"), 46),
    **dict.fromkeys(("bsd 2 clause license", "the 2 clause bsd license"), 47),
    **dict.fromkeys(("isc license", "the isc license"), 60),
    **{f"permission to use copy modify and {x} this software for any purpose with or without fee is hereby granted provided that "
       "the above copyright notice and this permission notice appear in all copies": 61 for x in ("or distribute", "distribute")},
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": 62,
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
    "warranties of merchantability and fitness": 63,
    "this library is free software": 70,
    _GNU.format("lesser general public license"): 71,
    f"{_GNU.format('lesser general public license')} {_LATER.format('2 1')}": 72,
    f"{_GNU.format('lesser general public license')} {_LATER.format('3')}": 73,
    _GNU.format("library general public license"): 74,
    "gnu lesser general public license version 2 1 february 1999": 75,
    "gnu lesser general public license version 3 29 june 2007": 76,
    _GNU.format("affero general public license"): 80,
    f"{_GNU.format('affero general public license')} {_LATER.format('3')}": 81,
    "gnu affero general public license version 3 19 november 2007": 82,
    **dict.fromkeys(("this source code form is subject to the terms of the mozilla public license v",
                     "this source code form is subject to the terms of the mozilla public license version 2 0"), 90),
    "mozilla public license version 2 0": 91,
}


def _bsd(name: str, last: tuple[int, ...]) -> tuple[tuple[tuple[int, ...], str], ...]:
    """Runs of a BSD notice: with or without the line of reserved rights before it and each of the first two clauses."""
    return tuple(((*rights, 40, *one, *two, *last), name) for rights in ((50,), ()) for one in ((41,), ()) for two in ((42,), ())
                 if one or two or last)


#: Rules of the unabridged notices, before the others.
NOTICE_RULES = (
    ((4,), "MIT"), ((13,), "Apache-2.0"),
    ((24, 25), "GPL-2.0-or-later"), ((28,), "GPL-2.0-or-later"), ((29,), "GPL-2.0-only"), ((17,), "GPL-2.0"),
    ((24, 27), "GPL-3.0-or-later"), ((19,), "GPL-3.0-only"), ((18,), "GPL-3.0"),
    ((74, 25), "LGPL-2.0-or-later"), ((71, 26), "LGPL-2.1-or-later"), ((72,), "LGPL-2.1-or-later"), ((75,), "LGPL-2.1"),
    ((71, 27), "LGPL-3.0-or-later"), ((73,), "LGPL-3.0-or-later"), ((76,), "LGPL-3.0"),
    ((80, 27), "AGPL-3.0-or-later"), ((81,), "AGPL-3.0-or-later"), ((82,), "AGPL-3.0"),
    ((34,), "CC0-1.0"), ((35,), "CC0-1.0"),
    *_bsd("BSD-4-Clause", (44, 43)), *_bsd("BSD-3-Clause", (43,)), *_bsd("BSD-2-Clause", ()),
    ((46,), "BSD-3-Clause"), ((47,), "BSD-2-Clause"),
    ((60,), "ISC"), ((61,), "ISC"), ((62,), "0BSD"), ((90,), "MPL-2.0"), ((91,), "MPL-2.0"), ((92,), "BSL-1.0"),
)
RESULTS = ("sentence_ids", "licenses")

_OTHER = "[^a-z0-9]+"
#: Words that every known sentence has one of; a sentence without them is not normalised.
_HINT = "(?i)licen|copyright|warrant|permission|redistribut|rights reserved|free software|in the hope"
#: The same for every text with a sentence of an unabridged notice.
_HINTS = f"{_HINT}|cc0|creative commons|endorse or promote|advertising materials"
#: Sentences that name a holder, as (pattern, the known sentence's words). The fixed words on both sides mark the name,
#: which has as many words as it has; it ends with its sentence.
_HOLDERS = (
    (r"neither the names? of [a-z0-9 ]+? nor the names? of [a-z0-9 ]*?contributors", _NAMES),
    (r"this software is provided by [a-z0-9 ]+? as is and any express",
     "this software is provided by the copyright holders and contributors as is and any express"),
)
#: What stands for the end of a sentence or paragraph in a normalised text, in which a line break may lie within a sentence.
_END = "\x01"
_SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"


def _pattern() -> str:
    """Any known sentence between two breaks, the longest first; each of its blanks may be the end of a line."""
    known = sorted({**SENTENCES, **NOTICES}, key=lambda s: (-len(s), s))
    for pattern, words in _HOLDERS:
        known = [s.replace(words, pattern) for s in known]
    anyone = "|".join(known).replace("[a-z0-9 ]", "[a-z0-9_]").replace(" ", r"[ \n]").replace("[a-z0-9_]", r"[a-z0-9 \n]")
    return rf"(?<![^\n{_END}])(?:{anyone})(?![^\n{_END}])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in {**SENTENCES, **NOTICES}.items() for x in pair])
    ended = F.regexp_replace(F.translate(F.lower(text), _END, " "), r"(?<=[.!?;:])(?:[ \t]+|[ \t\r]*\n)", _END)
    normal = F.regexp_replace(F.regexp_replace(ended, rf"[^a-z0-9\n{_END}]+", " "), r" ?\n ?", "\n")
    normal = F.regexp_replace(F.regexp_replace(normal, r"\n\n+", _END), f" ?{_END} ?", _END)

    def identifier(x: Column) -> Column:
        x = F.replace(x, F.lit("\n"), F.lit(" "))
        for pattern, words in _HOLDERS:
            x = F.regexp_replace(x, pattern, words)
        return known[x]

    found = F.regexp_extract_all(F.btrim(normal), F.lit(_pattern()), F.lit(0))
    ids = F.array_compact(F.transform(found, identifier))
    return F.when(text.rlike(_HINTS), ids).otherwise(F.array().cast("array<int>"))


def spdx_names(text: Column) -> Column:
    """The names that a text's SPDX lines give, in order."""
    return F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1))


def _run(ids: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def matched_licenses(ids: Column) -> Column:
    """Distinct licences of the rules that match, in the order of the rules."""
    left = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    found = []
    for run, name in (*NOTICE_RULES, *RULES):
        found.append(F.when(F.contains(left, F.lit(_run(run))), F.lit(name)))
        left = F.replace(left, F.lit(_run(run)), F.lit("|"))
    return F.array_distinct(F.array_compact(F.array(*found)))


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with `sentence_ids` and `licenses`."""
    rows = packed(docs, text=F.coalesce(column_or_null(docs, text_col, "string"), F.lit("")))
    rows = rows.select("row", sentence_ids(F.col("text")).alias("sentence_ids"), spdx_names(F.col("text")).alias("_spdx"))
    # Few texts have any: the others take no part in the rules.
    by_rule = F.when(F.size("sentence_ids") > 0, matched_licenses(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("licenses", F.array_distinct(F.concat(by_rule, "_spdx")))
    return unpacked(rows, docs.columns, *RESULTS)


def _sql() -> str:
    """The result for one-line notices as SQL: sentences are found by scanning lines and end marks, rules by nested replacements."""
    values = ", ".join(f"('{s}', {i})" for s, i in SENTENCES.items())
    steps, left = [], "seq"
    for run, name in RULES:
        steps.append(f"CASE WHEN contains({left}, '{_run(run)}') THEN '{name}' END")
        left = f"replace({left}, '{_run(run)}', '|')"
    return f"""
WITH known(s, i) AS (VALUES {values}),
parts AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS part,
                 generate_subscripts(string_split_regex(regexp_replace(text, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), 1) AS n
          FROM documents),
hits AS (SELECT doc_id, n, i FROM parts JOIN known ON s = trim(regexp_replace(lower(part), '{_OTHER}', ' ', 'g'))
         WHERE regexp_matches(part, '{_HINT}')),
spdx AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPDX}', 1) AS names FROM documents),
seqs AS (SELECT doc_id, list(i ORDER BY n) AS ids, string_agg('<' || i || '>', '' ORDER BY n) AS seq FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(ids, []) AS sentence_ids,
       list_concat(CASE WHEN seq IS NULL THEN [] ELSE (SELECT list(x ORDER BY k) FROM (SELECT x, min(k) AS k FROM (
           SELECT unnest([{', '.join(steps)}]) AS x, generate_subscripts([{', '.join(steps)}], 1) AS k) WHERE x IS NOT NULL GROUP BY x)) END,
           (SELECT coalesce(list(x ORDER BY k), []) FROM (SELECT x, min(k) AS k FROM (
               SELECT unnest(names) AS x, generate_subscripts(names, 1) AS k) GROUP BY x))) AS licenses
FROM documents d JOIN spdx USING (doc_id) LEFT JOIN seqs USING (doc_id)"""


SQL = _sql()
