"""Licence scans by sentence rules, as DataFrame operations alone.

A text is cut into sentences, twice: with every line break as an end, and with only those line breaks
as ends that stand around a line without letters or digits. Sentences are normalised (lower case,
letters and digits alone) and those that are known become identifiers; the sequence of identifiers is
matched against licence rules in their order. A rule is a run of identifiers; the run it matches is
taken out, so that a shorter rule later in the order does not claim it. Sentences and rules come from
the wording of the notices, cut by the same rule, so that each known sentence is one that the cut can give.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of standard licence notices.
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. ',
    "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. ",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_GNU = "{subject} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version. "
_GNU_ONLY = "{subject} is free software; you can redistribute it and/or modify it under the terms of the GNU {license} version {version} as published by the Free Software Foundation. "
_GNU_REST = (
    "{subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {license} for more details."
)
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.\n\n"
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. ",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
)
_MPL_HTTPS = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means.",
)


def _gnu(spdx: str, subject: str, license: str, version: str) -> list[tuple[str, str]]:
    """The notices of one licence of the family, older and newer wording, whole and in parts."""
    marks = ((":", ","), (";", ";"), (";", ","), (",", ";"), (":", ";"))
    heads = [_GNU.format(subject=subject, license=license, version=version, colon=c, comma=d) for c, d in marks]
    rest = _GNU_REST.format(subject=subject, license=license)
    only = _GNU_ONLY.format(subject=subject, license=license, version=version)
    later = [h + rest for h in heads] + heads + [h[h.index("you can") :] for h in heads if "software," not in h]
    return [*((f"{spdx}-or-later", x) for x in later), (f"{spdx}-only", only + rest), (f"{spdx}-only", only)]


#: Fixed values: (licence, notice) in the order in which they are tried: whole notices before their parts.
NOTICES = (
    ("Apache-2.0", "".join(_APACHE)),
    ("Apache-2.0", _APACHE[0]),
    ("Apache-2.0", _APACHE[0][_APACHE[0].index("you may") :] + _APACHE[1]),
    ("MIT", "".join(_MIT)),
    ("MIT", "".join(_MIT[:3])),
    ("MIT", "".join(_MIT[:2])),
    *_gnu("GPL-3.0", "This program", _GPL, "3"),
    *_gnu("GPL-2.0", "This program", _GPL, "2"),
    *_gnu("LGPL-3.0", "This program", _LGPL, "3"),
    *_gnu("LGPL-3.0", "This library", _LGPL, "3"),
    *_gnu("LGPL-2.1", "This library", _LGPL, "2.1"),
    *_gnu("AGPL-3.0", "This program", _AGPL, "3"),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + _BSD_NAMES),
    ("BSD-2-Clause", _BSD + _BSD_WARRANTY),
    ("BSD-2-Clause", _BSD),
    ("ISC", _ISC + "\n\n" + _ISC_WARRANTY),
    ("ISC", _ISC),
    ("MPL-2.0", "".join(_MPL)),
    ("MPL-2.0", _MPL[0] + _MPL_HTTPS),
    ("MPL-2.0", _MPL[0]),
    ("Unlicense", "".join(_UNLICENSE)),
    ("Unlicense", _UNLICENSE[0]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Licensed under the BSD license."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Single words, or parts of one, of which each known sentence holds one; normalisation leaves words whole, so a text without any has no known sentence.
TRIGGERS = ("licen", "permi", "warrant", "redistribut", "rights", "software", "copyright")
#: Ends of sentences: marks before white space or the end of the text.
_ENDS = r"[.!?;:]+[ \t\r\n]+|[.!?;:]+$"
#: The two cuts: at every line break, and at lines without letters or digits.
_VIEWS = (_ENDS + r"|[\r\n]+", _ENDS + r"|\n[^a-z0-9]*[\r\n]|\r\r")


def sentences_of(text: str, view: int) -> list[str]:
    """The sentences of a text in normal form, as the queries cut them."""
    return [re.sub("[^a-z0-9]+", " ", x).strip(" ") for x in re.split(_VIEWS[view], text.lower())]


def _table() -> tuple[dict[int, str], tuple[tuple[str, tuple[int, ...]], ...]]:
    """Identifiers of the sentences of the notices, and the rules; sentences without a trigger say nothing."""
    ids: dict[str, int] = {}
    rules: dict[tuple[int, ...], str] = {}
    for name, text in NOTICES:
        own = [x for x in sentences_of(text, 1) if any(t in x for t in TRIGGERS)]
        rules.setdefault(tuple(ids.setdefault(x, len(ids) + 1) for x in own), name)
    return {i: x for x, i in ids.items()}, tuple((name, run) for run, name in rules.items())


#: Known licence sentences in normal form by identifier, and (licence, run of identifiers) in the order of NOTICES.
SENTENCES, RULES = _table()


def _run(ids: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _identifiers(lower: Column, ends: str) -> Column:
    """The known identifiers of a text in order, as <1><2>..."""
    known = F.array(*[F.lit(s) for s in SENTENCES.values()])
    plain = F.transform(F.split(lower, ends, -1), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    at = F.filter(F.transform(plain, lambda s: F.array_position(known, s)), lambda p: p > 0)
    return F.array_join(F.transform(at, lambda p: F.concat(F.lit("<"), p.cast("string"), F.lit(">"))), "")


def _matched(ids: Column) -> Column:
    """Licences of a sequence in rule order."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_run(run)).alias("run")) for name, run in RULES])
    start = F.struct(ids.alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["run"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["run"], F.lit("<>"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.concat(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"),
        )

    return F.aggregate(rules, start, step)["names"]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) of every document.

    n_sentences counts the known sentences of the cut, of the two, that has more (line ends first on a
    tie), sentence_ids lists their identifiers as <1><2>..., licenses has the distinct licences of both
    cuts in code point order, joined by commas. Texts without licences, null and empty ones have 0 and empty strings.
    Repeated rows stay; columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    lower = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lower"))
    maybe = F.lit(False)
    for word in TRIGGERS:
        maybe = maybe | F.contains("lower", F.lit(word))
    # the text goes no further than the identifiers
    marked = lower.select("doc_id", *[F.when(maybe, _identifiers(F.col("lower"), v)).otherwise("").alias(f"ids{i}") for i, v in enumerate(_VIEWS)])
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit("")))
    n0, n1 = count(F.col("ids0")), count(F.col("ids1"))
    names = F.concat(_matched(F.col("ids0")), _matched(F.col("ids1")))
    some = (F.col("ids0") != "") | (F.col("ids1") != "")
    return marked.select(
        "doc_id",
        F.greatest(n0, n1).cast("long").alias("n_sentences"),
        F.when(n1 > n0, F.col("ids1")).otherwise(F.col("ids0")).alias("sentence_ids"),
        F.when(some, F.array_join(F.array_sort(F.array_distinct(names)), ",")).otherwise("").alias("licenses"),
    )


def sql() -> str:
    """The same scan for DuckDB."""
    known = "[" + ", ".join(f"'{s}'" for s in SENTENCES.values()) + "]"

    def ids(view: str) -> str:
        return (
            f"list_transform(list_filter(list_transform(string_split_regex(low, '{view}'), "
            f"lambda s: coalesce(list_position({known}, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), 0)), lambda p: p > 0), lambda p: '<' || p || '>')"
        )

    steps = []
    for i in (0, 1):
        rest, cases = f"ids{i}", []
        for name, run in RULES:
            cases.append(f"CASE WHEN contains({rest}, '{_run(run)}') THEN '{name}' END")
            rest = f"replace({rest}, '{_run(run)}', '<>')"
        steps.append("[" + ", ".join(cases) + "]")
    return f"""
WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
ids AS (SELECT doc_id, array_to_string({ids(_VIEWS[0])}, '') AS ids0, array_to_string({ids(_VIEWS[1])}, '') AS ids1 FROM low),
counted AS (
  SELECT *, len(ids0) - len(replace(ids0, '<', '')) AS n0, len(ids1) - len(replace(ids1, '<', '')) AS n1,
         list_filter(list_concat({steps[0]}, {steps[1]}), lambda x: x IS NOT NULL) AS names
  FROM ids)
SELECT doc_id, CAST(greatest(n0, n1) AS BIGINT) AS n_sentences, CASE WHEN n1 > n0 THEN ids1 ELSE ids0 END AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licenses
FROM counted
"""
