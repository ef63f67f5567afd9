"""Licence scans by known sentences and ordered rules, in SQL functions only.

A text is normalised (lower case, runs of other characters than letters and digits
become a blank, so comment marks and bullets go) and its known licence sentences are
found.  A sentence begins and ends at a line feed, a blank line, a list label or a
full stop and the like; inside it, words may go on in the next line, as in licence
files, but not over a blank line, a label or the end of a sentence.  Where several
known sentences begin at one place the longest counts.  The identifiers found, in order, are matched against licence
rules: a rule is a sequence of identifiers that must follow one another among the
known sentences of the text.  Rules are tried in their order, and a match uses up
its sentences, so a longer rule put first keeps shorter ones from its sentences.
Everything happens in the row: nothing is shuffled.

Defined cases: a null or empty text has no sentence and no licence; repeated rows
are rows of the result of their own; a null identifier is kept.  Licences are listed
in the order of the rules, each once, with the number of its matches.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts table entries into pieces: line feeds, and a full stop and the like before white space.
CUT = r"\n|[.!?;:][\x09-\x0D\x20]"
#: Licence sentences by identifier, as notices of one line have them.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-compliance": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-basis": 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit-short": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute": "This program is free software",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-short": "Licensed under the BSD 3-Clause License",
    "ccbync4-short": "Licensed under CC BY-NC 4.0",
    "ccby4-short": "Licensed under CC BY 4.0",
    "ccbysa4-short": "Licensed under CC BY-SA 4.0",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}
#: Further wordings of the same sentences: whole, where licences go on after the words above.
WORDINGS = {
    "apache-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
}
#: Titles that stand for a sentence where a paragraph begins with them.
TITLES = {
    "apache-short": ["Apache License Version 2.0, January 2004"],
    "mit-title": ["MIT License", "The MIT License"],
    "gpl3-short": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "bsd-short": ["BSD 3-Clause License"],
    "mpl2-form": ["Mozilla Public License Version 2.0"],
}
#: Where a lower-case text is cut for good: ends of sentences, lines without letters or digits, list labels.
ENDS = r"[.!?;:](?=[\x09-\x0D\x20])|\n[^a-z0-9\n]*(?=\n)|\n[^a-z0-9\n]*\(?(?:[0-9]{1,2}|[a-z])\)(?=[\x09\x20])"
#: Ordered rules, longer ones before those they contain.
RULES = [
    ("Apache-2.0", ["apache-header", "apache-compliance", "apache-obtain", "apache-basis"]),
    ("Apache-2.0", ["apache-header", "apache-compliance"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-short"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("GPL-3.0", ["gpl-redistribute", "gpl-terms", "gpl-hope", "gpl-copy"]),
    ("GPL-3.0", ["gpl-redistribute", "gpl-terms"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-short"]),
    ("CC-BY-NC-4.0", ["ccbync4-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("CC-BY-4.0", ["ccby4-short"]),
    ("CC-BY-4.0", ["ccby4-work"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense-domain"]),
    ("ISC", ["isc-grant"]),
]


def plain(sentence: str) -> str:
    """What the look-up compares, for the ASCII sentences of the table."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def pieces(sentence: str) -> list[str]:
    """The normalised sentences that a text cuts a table entry into."""
    return [p for p in (plain(x) for x in re.split(CUT, sentence)) if p]


def known(sentences: dict[str, str]) -> dict[str, int]:
    """Number of every normalised sentence; an entry that the cut divides counts by its longest piece."""
    return {max(pieces(text), key=len): n for n, text in enumerate(sentences.values(), 1)}


def laid_out(text: Column) -> Column:
    """The normalised words of a text, with X (never left by lower case) at ends and a line feed where a line merely goes on."""
    ended = F.concat(F.lit("X"), F.regexp_replace(F.lower(text), ENDS, "X"), F.lit("X"))
    words = F.regexp_replace(ended, r"[^a-z0-9X\n]+", " ")
    return F.regexp_replace(F.regexp_replace(words, r"[\x20\n]*X[X\x20\n]*", "X"), r"\x20*\n[\x20\n]*", "\n")


def recognised(text: Column, sentences: dict[str, str], wordings: dict[str, list[str]], titles: dict[str, list[str]]) -> Column:
    """Numbers of the known sentences of a text, in order."""
    number = {name: n for n, name in enumerate(sentences, 1)}

    def extra(entries: dict[str, list[str]]) -> dict[str, int]:
        return {max(pieces(x), key=len): number[name] for name, more in entries.items() if name in number for x in more}

    def any_of(entries: dict[str, int]) -> str:
        longest_first = sorted(entries, key=lambda s: (-len(s), s))
        return "(?:" + "|".join(s.replace(" ", r"[\x20\n]") for s in longest_first) + r")(?=[X\n])"

    anywhere, at_the_head = extra(wordings) | known(sentences), extra(titles)
    table = at_the_head | anywhere
    if not table:
        return F.array().cast("array<int>")
    pattern = r"(?<=[X\n])" + any_of(anywhere) + (r"|(?<=X)" + any_of(at_the_head) if at_the_head else "")
    look_up = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.regexp_extract_all(laid_out(text), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: F.element_at(look_up, F.translate(s, "\n", " ")))


def matched(numbers: Column, rules: list[tuple[str, list[str]]], sentences: dict[str, str]) -> Column:
    """(rest, found): the sequence with matched sentences used up, and the licence of every match."""
    number = {name: n for n, name in enumerate(sentences, 1)}
    start = F.struct(
        F.concat(F.lit(","), F.array_join(F.transform(numbers, lambda n: F.concat(F.lit(","), n.cast("string"), F.lit(","))), "")).alias("rest"),
        F.array().cast("array<string>").alias("found"),
    )
    table = F.array(*[
        F.struct(F.lit("".join(f",{number[x]}," for x in sequence)).alias("sequence"), F.lit(licence).alias("licence")) for licence, sequence in rules
    ])

    def step(state: Column, rule: Column) -> Column:
        # "|" keeps what stood on both sides of a match apart.
        left = F.replace(state["rest"], rule["sequence"], F.lit("|"))
        times = (F.length(state["rest"]) - F.length(left)) / (F.length(rule["sequence"]) - 1)
        more = F.array_repeat(rule["licence"], times.cast("int"))
        return F.struct(left.alias("rest"), F.concat(state["found"], more).alias("found"))

    return F.aggregate(table, start, step, lambda state: state["found"])


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, id_column: str = "doc_id", text_column: str = "text", wordings: dict[str, list[str]] = WORDINGS, titles: dict[str, list[str]] = TITLES) -> DataFrame:
    """(doc_id, n_known, known, licences, n_matches) of every row; ``known`` names the sentences in order."""
    names = F.array(*[F.lit(x) for x in sentences])
    rows = docs.select(F.col(id_column).alias("doc_id"), recognised(F.coalesce(F.col(text_column).cast("string"), F.lit("")), sentences, wordings, titles).alias("numbers"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("found", F.when(F.size("numbers") > 0, matched(F.col("numbers"), rules, sentences)).otherwise(none))
    return rows.select(
        "doc_id",
        F.size("numbers").cast("long").alias("n_known"),
        F.array_join(F.transform("numbers", lambda n: F.element_at(names, n)), ",").alias("known"),
        F.array_join(F.array_distinct("found"), ",").alias("licences"),
        F.size("found").cast("long").alias("n_matches"),
    )
