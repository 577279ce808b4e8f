"""Licence scans by sentences: known sentences become identifiers, and sequences of identifiers become licences.

A text is cut into sentences at line breaks and after full stops, but a known sentence that is wrapped over lines of one paragraph counts
as well, with or without comment signs before the lines; each is normalised (lower case, runs of anything but letters and digits
become one blank), and those in the table of known sentences give their identifier. A document's identifiers, in order, are matched
against the rules in their order: each occurrence of a rule's sequence is replaced by the licence, so a sentence counts once and
longer rules come before the shorter ones that they contain.

The rules and sentences are a fixed table, small enough to broadcast; only documents with a word that every known sentence has one of are cut up, and only
known sentences are grouped.

An SPDX line gives an identifier for each licence that its expression names. "All rights reserved." is a licence only where no other is found. Two identifiers
of one normalised sentence are refused.

Defined cases: null and empty texts have no sentence; repeated sentences are kept; each row is a document of its own, so repeated rows are judged alike
and rows that share a doc_id, or have none, apart; of rules that fit, the first in their order takes the sentences; whole texts are read, however
long; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short sentences of public licences and notices, with their identifiers.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-comply": 'you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    "ccbync-notice": "Licensed under CC BY-NC 4.0.",
    "ccby-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "all-rights": "All rights reserved.",
    "ccbysa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "gpl3-title": "GNU General Public License Version 3, 29 June 2007",
    "gpl2-title": "GNU General Public License Version 2, June 1991",
    "lgpl3-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "agpl3-title": "GNU Affero General Public License Version 3, 19 November 2007",
}
# Public licence identifiers that an SPDX line may name.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 "
    "CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 "
    "MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Ruby Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
SPDX_TAG = "SPDX-License-Identifier"
SENTENCES |= {f"spdx-{i.lower()}": f"{SPDX_TAG} {i}" for i in SPDX}
# Ordered rules, a licence and its sentences.
LICENCE_RULES = [
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy", "apache-asis", "apache-see"]),
    ("MIT", ["mit-title", "mit-grant", "mit-condition"]),
    ("GPL-3.0", ["gpl-free", "gpl-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["ccbync-notice"]),
    ("CC-BY-4.0", ["ccby-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa-notice"]),
    ("BSD", ["bsd-redistribute"]),
    ("CC-BY-SA-4.0", ["ccbysa-work"]),
    ("Unlicense", ["unlicense-free"]),
    ("BSL-1.0", ["boost-notice"]),
    ("Zlib", ["zlib-grant"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
    *[(i, [f"spdx-{i.lower()}"]) for i in SPDX],
    ("proprietary", ["all-rights"]),
]
#: A licence that counts only if no other is found: its sentence also stands in the headers of others.
LAST_RESORT = "proprietary"
_FSF = "as published by the Free Software Foundation"
_LATER = "or (at your option) any later version."
# Whole official sentences, with their common variants. Those of an identifier above are further forms of it.
OFFICIAL = {
    "apache-grant": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this work except in compliance with the License.',
        'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "mit-licensed": (
        *(f"{what} is licensed under the MIT {word}." for what in ("This project", "This software", "This code", "This work", "This library", "This package") for word in ("License", "Licence")),
        *(f"{what} is released under the MIT {word}." for what in ("This project", "This software", "This code", "This work", "This library", "This package") for word in ("License", "Licence")),
    ),
    "apache-notice": tuple(f"{what} is licensed under the Apache License{version}." for what in ("This project", "This software", "This code", "This work", "This library", "This package") for version in (", Version 2.0", " 2.0")),
    "boost-notice": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "epl2-notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "ccbysa-work": ("Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "cc0-waiver": ("CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",),
    "apache-title": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    "apache-copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-asis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',),
    "mit-title": ("MIT License", "The MIT License"),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit-condition": ("The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    **{
        f"{i}{v[0]}-free": tuple(
            f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License {_FSF}{comma} {tail}"
            for what in ("program", "library", "software", "file")
            for mark in (":", ";")
            for comma in (",", ";")
            for tail in (f"either version {v} of the License, {_LATER}", f"version {v} of the License.", f"version {v}.")
        )
        for i, name, versions in (("gpl", "", ("2", "3")), ("lgpl", "Lesser ", ("2.1", "3")), ("agpl", "Affero ", ("3",)))
        for v in versions
    },
    "gpl-warranty": tuple(
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
        for what in ("program", "library", "software", "file")
    ),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl-notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
# Ordered rules of the official sentences, which come before the short ones.
OFFICIAL_RULES = [
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-grant"]),
    *[(licence, [i, *more]) for more in (["gpl-warranty"], []) for licence, i in (("GPL-2.0", "gpl2-free"), ("GPL-3.0", "gpl3-free"), ("LGPL-2.1", "lgpl2-free"), ("LGPL-3.0", "lgpl3-free"), ("AGPL-3.0", "agpl3-free"))],
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-notice"]),
]
KNOWN: dict[str, str | tuple[str, ...]] = {i: tuple(([SENTENCES[i]] if i in SENTENCES else []) + list(OFFICIAL.get(i, ()))) for i in [*SENTENCES, *(i for i in OFFICIAL if i not in SENTENCES)]}
#: Every known sentence has one of these, in any case.
ANCHORS = ("licen", "permission", "copyright", "redistribut", "warranty", "rights reserved", "public domain", "creative commons")


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentences_of(text: Column) -> Column:
    """Sentences of a text, not normalised. An SPDX line is a sentence for each licence of its expression; exceptions (WITH) are left out."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, f"(?i){SPDX_TAG}:[ \\t]*", f"{SPDX_TAG} "), r"([.!?:])[ \t]+", "$1\n"), "\n")
    tagged = rf"(?i)^\W*{SPDX_TAG} "
    names = lambda s: F.regexp_extract_all(F.regexp_replace(F.regexp_replace(s, rf"(?i)^.*?{SPDX_TAG} ", ""), r"(?i)\bWITH\s+\S+", ""), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.+-]*"), F.lit(0))
    parts = lambda s: F.transform(F.filter(names(s), lambda n: ~F.upper(n).isin("OR", "AND")), lambda n: F.concat(F.lit(f"{SPDX_TAG} "), F.regexp_replace(n, r"\+$", "-or-later")))
    return F.when(text.rlike(rf"(?i){SPDX_TAG}"), F.flatten(F.transform(lines, lambda s: F.when(s.rlike(tagged), parts(s)).otherwise(F.array(s))))).otherwise(lines)


def unwrapped(text: Column, parts: list[tuple[str, str]]) -> Column:
    """The text with each known sentence of parts (identifier, sentence) that is wrapped over lines of one paragraph put in one line, in a form of the same identifier.

    It starts at the start of a line or sentence and ends where a sentence or paragraph does; each line may begin with comment signs. The forms of one
    identifier are one pattern; identifiers go from the longest sentence to the shortest. No line break but those inside such a sentence is touched."""
    inner = r"(?:[^\p{L}\p{N}\n.!?:]|[.!?:](?![ \t\r\n]))"  # between words: a full stop and a blank would end the sentence
    gap = rf"(?:{inner}++(?:\n{inner}*+)?|\n{inner}*+)"  # at most one line break: an empty line ends the paragraph
    start = r"(?<=^|\n|[.!?:](?=[ \t]))([^\p{L}\p{N}\n]*+)"
    end = r"(?=[^\p{L}\p{N}\n]*?(?:[.!?:](?:[ \t\r\n]|\z)|\z|\n[^\p{L}\p{N}\n]*(?:\n|\z)))"
    forms: dict[str, set[tuple[str, ...]]] = {}
    for i, p in parts:
        if p.startswith(SPDX_TAG):  # a tag and its expression are one line
            continue
        forms.setdefault(i, set()).add(tuple(re.findall(r"[^\W_]+", p.lower())))
    for own in sorted((sorted(f, key=lambda w: (-len(w), w)) for f in forms.values()), key=lambda f: (-len(f[0]), f)):
        text = F.regexp_replace(text, "(?iu)" + start + _either(own, gap) + end, "$1" + " ".join(own[0]))
    return text


def _either(forms: list[tuple[str, ...]], gap: str) -> str:
    """A pattern of any of forms, lists of words; a common beginning is written once."""
    k = 0
    while all(len(f) > k for f in forms) and len({f[k] for f in forms}) == 1:
        k += 1
    head = gap.join(forms[0][:k])
    rest = sorted({f[k:] for f in forms}, key=lambda w: (-len(w), w))
    if rest == [()]:
        return head
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for f in rest:
        if f:
            by_first.setdefault(f[0], []).append(f)
    tails = "|".join((gap if k else "") + _either(own, gap) for own in by_first.values())
    return f"{head}(?:{tails})" + ("?" if () in rest else "")


def scan(docs: DataFrame, sentences: dict[str, str | tuple[str, ...]] = KNOWN, rules: list[tuple[str, list[str]]] = OFFICIAL_RULES + LICENCE_RULES, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) for each document of docs (doc_id, text) with a known sentence; sentence_ids in order, licences distinct and sorted, both joined by commas."""
    parts = [(i, p) for i, forms in sentences.items() for s in ([forms] if isinstance(forms, str) else forms) for p in _pieces(s)]
    if missing := [p for _, p in parts if not any(a in p.lower() for a in anchors)]:
        # A sentence of several pieces is known by those with an anchor.
        parts = [(i, p) for i, p in parts if p not in missing]
    if lost := set(sentences) - {i for i, _ in parts}:
        raise ValueError(f"no anchor in {sorted(lost)}")
    spark = docs.sparkSession
    known = spark.createDataFrame(parts, "sentence_id string, sentence string").select("sentence_id", normal(F.col("sentence")).alias("normal")).distinct()
    if twice := known.groupBy("normal").agg(F.sort_array(F.collect_list("sentence_id")).alias("ids")).where("size(ids) > 1").collect():  # of a fixed table
        raise ValueError(f"one sentence with several identifiers: {sorted(r['ids'] for r in twice)}")
    likely = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).where(F.col("text").rlike("(?i)" + "|".join(anchors)))
    cut = likely.select("doc_id", "row", F.posexplode(F.filter(sentences_of(unwrapped(F.col("text"), parts)), lambda s: s.rlike("(?i)" + "|".join(anchors)))).alias("pos", "sentence"))
    found = cut.withColumn("normal", normal(F.col("sentence"))).join(F.broadcast(known), "normal")
    runs = found.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence_id"))).alias("s"))
    ids = F.transform("s", lambda s: s.sentence_id)
    runs = runs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), ids.alias("ids"))
    left = F.concat(F.lit(";"), F.array_join("ids", ";;"), F.lit(";"))
    for licence, sequence in rules:
        left = F.replace(left, F.lit(";" + ";;".join(sequence) + ";"), F.lit(f"={licence}="))
    found = F.array_distinct(F.regexp_extract_all(left, F.lit("=([^=;]+)="), F.lit(1)))
    found = F.when(F.size(found) > 1, F.array_remove(found, LAST_RESORT)).otherwise(found)
    licences = F.array_join(F.array_sort(found), ",")
    return runs.select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), licences.alias("licences"))


def _pieces(sentence: str) -> list[str]:
    """A known sentence cut as texts are."""
    out = sentence
    for mark in ".!?:":
        out = out.replace(f"{mark} ", f"{mark}\n")
    return [p for p in out.split("\n") if p]
