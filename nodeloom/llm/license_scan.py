"""Licence scans by sentence rules: normalised sentences -> known sentence ids -> ordered licence rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and notices (fixed values), by rule; a rule is the sequence of its sentences.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("all-rights-reserved", ("All rights reserved.",)),
    ("apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("apache-2.0", ("You may not use this file except in compliance with the License.", "See the License for the specific language governing permissions and limitations under the License.")),
    ("bsd", ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")),
    ("cc-by-nc-4.0", ("Licensed under CC BY-NC 4.0.",)),
    ("cc-by-4.0", ("Licensed under CC BY 4.0.",)),
    ("cc0-1.0", ("The person who associated a work with this deed has dedicated the work to the public domain.",)),
    ("gpl-3.0", ("This work is licensed under the GNU General Public License, version 3.",)),
    ("gpl", ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")),
    ("mit", ("Released under the MIT License.",)),
    ("mit", ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.')),
    ("mpl-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    ("unlicense", ("This is free and unencumbered software released into the public domain.",)),
)
_GNU = "free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version."
_CC = (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
_SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
#: More notices of common licences, beside those that the SQL knows.
COMMON: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("0bsd", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",)),
    ("apache-2.0", ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',)),
    ("apache-2.0", ('The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',)),
    ("apache-2.0", ("Apache License Version 2.0, January 2004",)),
    ("bsd", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",)),
    ("bsd-3-clause", ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")),
    ("bsl-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
    ("bsl-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    ("epl-1.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",)),
    ("epl-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)),
    ("gpl-2.0", ("This program is " + _GNU.format("General Public License version 2") + ".",)),
    ("gpl-2.0", ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",)),
    ("gpl-3.0", ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",)),
    ("isc", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("isc", ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("mit", ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")),
    ("mit", ("Licensed under the MIT License.",)),
    ("mpl-2.0", ("Mozilla Public License Version 2.0",)),
    ("zlib", ("This software is provided 'as-is', without any express or implied warranty.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.")),
    ("lgpl-2.1", ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",)),
    ("lgpl-3.0", ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",)),
    ("agpl-3.0", ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",)),
    *((f"{name}-{v}-or-later", (f"This {what} is {_GNU.format(full)}, {_LATER.format(v if v == '2.1' else v[0])}",)) for name, full, v in (("gpl", "General Public License", "2.0"), ("lgpl", "Lesser General Public License", "2.1"), ("lgpl", "Lesser General Public License", "3.0"), ("agpl", "Affero General Public License", "3.0")) for what in ("program", "library", "file")),
    *((f"cc-{k}-4.0", (f"This work is licensed under {a} Creative Commons {full} 4.0 International License.",)) for k, full in _CC for a in ("a", "the")),
    *((f"cc-{k}-4.0", (f"Licensed under CC {k.upper()} 4.0.",)) for k, _ in _CC if k not in ("by", "by-nc")),
    *((name.lower(), (f"SPDX-License-Identifier: {name}",)) for name in _SPDX),
)
BREAK = r"(?:[.!?]\s+)|(?:[.!?]$)|\n+"


def _key(sentence: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(kept.split())


def sentence_ids(rules: tuple = RULES) -> dict[str, int]:
    """Normalised sentence -> id, over all rules. A sentence that holds a sentence break counts piece by piece."""
    out: dict[str, int] = {}
    for _, sentences in rules:
        for s in sentences:
            for piece in re.split(BREAK, s):
                if _key(piece):
                    out.setdefault(_key(piece), len(out))
    return out


def rule_sequences(rules: tuple = RULES) -> list[tuple[str, list[int]]]:
    ids = sentence_ids(rules)
    return [(name, [ids[_key(p)] for s in sentences for p in re.split(BREAK, s) if _key(p)]) for name, sentences in rules]


_START = re.compile(r"(?:\r\n?|\n)[^a-z0-9\r\n]*(?:(?:rem|dnl)[ \t]+)?")  # a line break and the comment prefix after it
_HARD = re.compile(r"[.!?][ \t\n\x0b\f\r]+|[.!?]\Z|\n\n+")
_SOFT = re.compile(r"\n|[.!?][\"')\]]+[ \t]|[:;][\"')\]]*[ \t]")
_WORD = re.compile(r"[a-z0-9]+")


class Scanner:
    """Known sentences of a text and the rules they fulfil."""

    def __init__(self, rules: tuple) -> None:
        self.ids, self.rules, self.longest = sentence_ids(rules), rule_sequences(rules), {}
        for key in self.ids:
            words = key.split()
            self.longest[words[0]] = max(self.longest.get(words[0], 0), len(words))

    def hits(self, text: str) -> list[int]:
        out = []
        for sentence in _HARD.split(_START.sub("\n", text.lower())):
            lines = [(first[0], line) for line in _SOFT.split(sentence) if (first := _WORD.search(line))]
            for at, (first, _) in enumerate(lines):
                most = self.longest.get(first, 0)
                words: list[str] = []
                for k in range(at, len(lines) if most else 0):  # each line adds a word at least, so at most `most` of them
                    words += _WORD.findall(lines[k][1])
                    if len(words) > most:
                        break
                    if (found := self.ids.get(" ".join(words))) is not None:
                        out.append(found)
        return out

    def licenses(self, hits: list[int]) -> list[str]:
        out = set()
        for name, sequence in self.rules if hits else ():
            rest = iter(hits)
            if all(i in rest for i in sequence):
                out.add(name)
        return sorted(out)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple = RULES + COMMON) -> DataFrame:
    """Per row: doc_id, n_known (known sentences), n_licenses, licenses (names, sorted, joined by commas).

    Sentences end at [.!?] before white space or the end, and at blank lines (lines of comment marks alone count as
    blank). A line break inside a paragraph, with the comment prefix after it, is white space; a known sentence may also
    start or end there, or at a colon, a semicolon or a closing quote, so it is found whether it is wrapped or has lines of its own. Every occurrence counts, also of a
    sentence that starts inside another. A rule matches where its ids occur in order, with anything between. Texts are
    read once, in an Arrow task with the rules' sentence table, and nothing is shuffled.

    Defined cases: null and empty texts have no sentences; repeated rows each give a row; an empty table gives an
    empty result; other columns are ignored. Only the sentences of RULES and COMMON are known: reworded licences, and a
    sentence that starts or ends in the middle of a line without a sentence end, are not found.
    """
    given = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            hits = [scanner.hits(x.as_py() or "") for x in batch.column(1)]
            names = [scanner.licenses(h) for h in hits]
            known, n = pa.array([len(h) for h in hits], pa.int64()), pa.array([len(x) for x in names], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), known, n, pa.array([",".join(x) for x in names], pa.string())], names=["doc_id", "n_known", "n_licenses", "licenses"])

    return given.mapInArrow(run, f"doc_id {given.schema['i'].dataType.simpleString()}, n_known long, n_licenses long, licenses string")


def oracle() -> str:
    known = ", ".join(f"('{k}', {i})" for k, i in sentence_ids().items())
    steps = ", ".join(f"({r}, '{n}', {k}, {len(s)}, {i})" for r, (n, s) in enumerate(rule_sequences()) for k, i in enumerate(s))
    pattern = BREAK.replace("(?:[.!?]$)", "(?:[.!?]$)")
    return f"""
WITH RECURSIVE known(x, sid) AS (VALUES {known}),
steps(rule, name, k, n, sid) AS (VALUES {steps}),
parts AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS s FROM documents),
flat AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM parts),
hits AS (SELECT doc_id, pos, sid FROM (SELECT doc_id, pos, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS x FROM flat) f JOIN known USING (x)),
walk AS (
  SELECT h.doc_id, s.rule, s.name, 0 AS k, s.n, min(h.pos) AS pos FROM hits h JOIN steps s ON s.sid = h.sid AND s.k = 0 GROUP BY ALL
  UNION ALL
  SELECT w.doc_id, w.rule, w.name, s.k, w.n, min(h.pos) AS pos FROM walk w JOIN steps s ON s.rule = w.rule AND s.k = w.k + 1
    JOIN hits h ON h.doc_id = w.doc_id AND h.sid = s.sid AND h.pos > w.pos GROUP BY w.doc_id, w.rule, w.name, s.k, w.n),
names AS (SELECT DISTINCT doc_id, name FROM walk WHERE k = n - 1),
l AS (SELECT doc_id, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses FROM names GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_known FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, CAST(coalesce(n_licenses, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""
