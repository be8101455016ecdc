"""Licence scan: sentences map to identifiers, sequences of identifiers to licences. SQL functions only.

A text is normalised: A-Z lower-cased, every run of other than a-z and 0-9 one
blank. Sentences end at blank lines (lines without a-z, A-Z and 0-9, as bare
comment leaders are) and at ``.``, ``!``, ``?`` before a blank or the end. A single line
break and ``:`` or ``;`` before a blank or the end may be the end of a sentence, or a
place at which it goes on: wrapped licence bodies, comment blocks and SPDX tags
are recognised, and so are notices that stand on a line of their own. Known
sentences have identifiers 1, 2, 3, ... in the order of ``SENTENCES``. A rule is a
sequence of identifiers that must follow one another (other known sentences in
between break it, unknown ones do not). The rules are ordered: at one place the
first that fits wins, so a whole licence text comes before its title.

Everything happens inside one row by string and array functions over two literal
tables (sentences and rules, tens of entries), so no text is shuffled.

Defined cases: a null or empty text has no sentence and no licence. Of known
sentences that begin at one place the longest counts. Repeated rows get a row
each. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import pick

#: fixed values: sentences of public licences and notices, normalised
SENTENCES = (
    "released under the mit license",
    "licensed under the mit license",
    "the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 only",
    "all rights reserved",
    "mit license",
    "apache license version 2 0 january 2004",
    "bsd 2 clause license",
    "bsd 3 clause license",
    "gnu general public license version 3 29 june 2007",
    "gnu general public license version 2 june 1991",
    "mozilla public license version 2 0",
    "spdx license identifier bsd 2 clause",
    "spdx license identifier bsd 3 clause",
    "spdx license identifier gpl 3 0 or later",
    "spdx license identifier gpl 2 0 only",
    "spdx license identifier gpl 2 0 or later",
    "spdx license identifier mpl 2 0",
)


@dataclass(frozen=True)
class LicenceRule:
    """``licence`` is found where these sentences (numbers into the sentence table, from 1) follow one another."""

    licence: str
    sequence: tuple[int, ...]


RULES = (
    LicenceRule("MIT", (4, 5)), LicenceRule("Apache-2.0", (7, 8, 9, 10)), LicenceRule("BSD-3-Clause", (20, 21, 22, 23)),
    LicenceRule("BSD-2-Clause", (20, 21, 22)), LicenceRule("GPL-3.0-or-later", (12, 14)), LicenceRule("GPL-2.0-or-later", (13, 14)),
    LicenceRule("MIT", (1,)), LicenceRule("MIT", (2,)), LicenceRule("MIT", (3,)), LicenceRule("MIT", (25,)),
    LicenceRule("Apache-2.0", (6,)), LicenceRule("Apache-2.0", (7,)), LicenceRule("Apache-2.0", (26,)),
    LicenceRule("GPL-3.0-only", (11,)), LicenceRule("GPL-3.0-only", (27,)), LicenceRule("GPL-3.0-or-later", (12,)), LicenceRule("GPL-2.0-or-later", (13,)),
    LicenceRule("CC-BY-NC-4.0", (15,)), LicenceRule("CC-BY-NC-4.0", (19,)), LicenceRule("CC-BY-4.0", (16,)), LicenceRule("CC-BY-4.0", (18,)),
    LicenceRule("CC-BY-SA-4.0", (17,)), LicenceRule("MPL-2.0", (24,)), LicenceRule("LicenseRef-all-rights-reserved", (28,)),
    LicenceRule("MIT", (29,)), LicenceRule("Apache-2.0", (30,)), LicenceRule("BSD-2-Clause", (31,)), LicenceRule("BSD-3-Clause", (32,)),
    LicenceRule("GPL-3.0-only", (33,)), LicenceRule("GPL-2.0-only", (34,)), LicenceRule("MPL-2.0", (35,)),
    LicenceRule("BSD-2-Clause", (36,)), LicenceRule("BSD-3-Clause", (37,)), LicenceRule("GPL-3.0-or-later", (38,)),
    LicenceRule("GPL-2.0-only", (39,)), LicenceRule("GPL-2.0-or-later", (40,)), LicenceRule("MPL-2.0", (41,)),
)
# "|" ends a sentence, "~" may end it
_STEPS = (
    (r"[|~]", " "),
    (r"[.!?]+(?=[\\s]|$)", "|"),
    (r"[:;]+(?=[\\s]|$)", "~"),
    (r"\\n[^a-z0-9|\\n]*(?=\\n)", "|"),
    (r"\\n", "~"),
    (r"[^a-z0-9|~]+", " "),
    (r" ?[ ~]*\\|[ ~|]*", "|"),
    (r" ?~[ ~]*", "~"),
)


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def normalised_sql(text: str) -> str:
    """The words of a text with the ends of its sentences."""
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, put in _STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{put}')"
    return f"trim({out})"


def known_sql(text: str, sentences: tuple[str, ...]) -> str:
    """Array of (number among the known sentences of the text, from 1, and identifier), in order."""
    longest = sorted(sentences, key=len, reverse=True)
    any_of = "|".join(s.replace(" ", "[ ~]") for s in longest)
    found = f"regexp_extract_all({normalised_sql(text)}, '(?:^|(?<=[|~]))(?:{any_of})(?=[|~]|$)', 0)"
    code = "map(" + ", ".join(f"{_text(s)}, {i}" for i, s in enumerate(sentences, 1)) + ")"
    return f"transform({found}, (x, i) -> struct(i + 1 AS place, element_at({code}, translate(x, '~', ' ')) AS id))"


def _matches(known: str, rules: tuple[LicenceRule, ...]) -> str:
    """Walk over the known sentences: at each not yet covered place the first rule that fits."""
    tests = " ".join(
        "WHEN " + " AND ".join(f"(i + {j} < size(k) AND k[i + {j}].id = {s})" for j, s in enumerate(r.sequence)) + f" THEN struct({n} AS rule, {len(r.sequence)} AS size)"
        for n, r in enumerate(rules))
    best = f"CASE {tests} ELSE struct(-1 AS rule, 1 AS size) END"
    empty = "struct(0 AS upto, cast(array() AS array<struct<at:int,rule:int,size:int>>) AS found)"
    grown = "struct(i + m.size AS upto, IF(m.rule < 0, acc.found, concat(acc.found, array(struct(i AS at, m.rule AS rule, m.size AS size)))) AS found)"
    step = f"IF(i < acc.upto, acc, element_at(transform(array({best}), m -> {grown}), 1))"
    walk = f"aggregate(sequence(0, size(k) - 1), {empty}, (acc, i) -> {step}, acc -> acc.found)"
    return f"IF(size(k) = 0, cast(array() AS array<struct<at:int,rule:int,size:int>>), {walk})"


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentences: tuple[str, ...] = SENTENCES,
         rules: tuple[LicenceRule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, licences (sorted, distinct), n_known (known sentences) and matches.

    A match is (licence, first, last): the numbers of its first and last sentence among the known ones of the text.
    """
    names = "array(" + ", ".join(_text(r.licence) for r in rules) + ")"
    made = f"transform(found, f -> struct(element_at({names}, f.rule + 1) AS licence, k[f.at].place AS first, k[f.at + f.size - 1].place AS last))"
    found = F.expr(f"element_at(transform(array({known_sql('text', sentences)}), k -> struct(size(k) AS n, element_at(transform(array({_matches('k', rules)}), found -> {made}), 1) AS m)), 1)")
    out = pick(docs, doc_id=doc_id, text=text).select("doc_id", found.alias("f"))
    return out.select("doc_id", licences_of(F.col("f.m")).alias("licences"), F.col("f.n").cast("long").alias("n_known"), F.col("f.m").alias("matches"))


def licences_of(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["licence"])))
