"""Licence scans by sentence rules (operator 7).

A text is cut into sentences (at blank lines, and after . ! ? : ; where white space follows, so that "2.0" stays whole), every
sentence is normalised (lower case, runs of anything but letters and digits become one blank), and known sentences become
identifiers. A single line end is a blank, and comment marks before a line are dropped, so wrapped texts are read as if on one
line; but whole lines that make up a known sentence are a sentence of their own, with or without an end before and after them.
A known sentence may also hold : and ; as ends within. From the front, the longest known sentence is taken. Rules, most specific first, are ordered lists of identifiers; a rule matches where its identifiers follow one
another with at most `gap` other sentences between two of them. A sentence that one rule has taken no later rule takes, and
a rule matches as often as it can, from the front.

Defined results: a null or empty text has no sentences and no licences; repeated rows give equal results; a text is read
whole, however long; other columns play no part.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.common import map_arrow

SENTENCE_END = re.compile(r"([.!?:;]+)(?=\s|$)")
LINE_END = re.compile(r"\r\n|\r|\n")
MARKS = re.compile(r"[^0-9a-z.?:]*(?:(?:rem|dnl)\s+)?")  # of comments, before a line in lower case
LINE, PART, END = range(3)  # what ends a piece of a text: a line end; : or ;; anything that no sentence goes over
OTHER = re.compile(r"[^0-9a-z]+")

# Names of licences as notices give them, normalised.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0"),
    "MIT": ("mit license", "mit licence", "expat license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gpl version 2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gpl version 3", "gplv3"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl version 3", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl version 3", "agplv3"),
    "CC0-1.0": ("cc0", "cc0 1 0", "creative commons zero v1 0 universal"),
    **{f"CC-{k.upper()}-{v}": (f"cc {k.replace('-', ' ')} {v.replace('.', ' ')}", f"creative commons {k.replace('-', ' ')} {v.replace('.', ' ')} license") for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("2.0", "2.5", "3.0", "4.0")},
}
# What stands before and after such a name.
LEADS = ("", "licensed under", "released under", "distributed under", "available under", "published under", "this work is licensed under", "this file is licensed under", "this software is licensed under", "this project is licensed under", "this program is licensed under", "this document is licensed under", "this text is licensed under", "this content is licensed under", "spdx license identifier")
# Sentences of licence texts and notices, normalised, by identifier.
SENTENCES = {
    "reserved": ("all rights reserved",),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "bsd-intro": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "apache-may": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at",),
    "gpl-free-2": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl-free-3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "free": ("this program is free software", "this is free software"),
    "gpl-terms-2": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl-terms-3": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "public": ("this work is in the public domain", "dedicated to the public domain", "this is free and unencumbered software released into the public domain"),
}
#: Most specific first: (licence, identifiers in order).
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("name:Apache-2.0", "apache-may", "apache-copy")),
    ("GPL-3.0-or-later", ("free", "gpl-terms-3")),
    ("GPL-2.0-or-later", ("free", "gpl-terms-2")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-free-3",)),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    *((name, (f"name:{name}",)) for name in NAMES),
    ("Public-Domain", ("public",)),
    ("All-Rights-Reserved", ("reserved",)),
]


def known_sentences() -> dict[str, str]:
    """Identifier of every known normalised sentence: those listed, and names after a lead, with or without "the"."""
    out = {s: k for k, all_ in SENTENCES.items() for s in all_}
    for name, forms in NAMES.items():
        for form in forms:
            for lead in LEADS:
                for the in ("", "the ") if lead else ("",):
                    if lead or len(form) > 6:
                        for tail in ("", " the license"):  # as in: Version 2.0 (the "License")
                            out[f"{lead} {the}{form}{tail}".strip()] = f"name:{name}"
    return out


KNOWN = known_sentences()
#: The first words of known sentences, by number.
STARTS = {" ".join(words[:k]) for words in map(str.split, KNOWN) for k in range(1, len(words) + 1)}


def pieces(text: str) -> list[tuple[str, int]]:
    """Normalised pieces of lines, with what ends each."""
    out = []
    for line in LINE_END.split(text.lower()):
        parts = SENTENCE_END.split(line[MARKS.match(line).end() :])
        empty = True
        for raw, end in zip(parts[::2], [*parts[1::2], None]):
            kind = LINE if end is None else END if set(end) & set(".!?") else PART
            if s := OTHER.sub(" ", raw).strip():
                out.append((s, kind))
                empty = False
            elif out and (empty if end is None else kind > out[-1][1]):
                out[-1] = (out[-1][0], END if end is None else kind)
    return out


def identifiers(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """Number of sentences that hold a letter or digit, and (place, identifier) of the known ones."""
    n, found, cut, k, begun = 0, [], pieces(text or ""), 0, False
    while k < len(cut):
        s, j, best = cut[k][0], k, None
        while s in STARTS:
            if s in KNOWN:
                best = (j, KNOWN[s])
            if cut[j][1] == END or j + 1 == len(cut):
                break
            j += 1
            s = f"{s} {cut[j][0]}"
        if best:
            n += begun
            found.append((n, best[1]))
            n, k, begun = n + 1, best[0] + 1, False
        else:
            begun = cut[k][1] == LINE
            n, k = n + (not begun), k + 1
    return n + begun, found


def matches(found: list[tuple[int, str]], gap: int = 2) -> list[tuple[str, int, int]]:
    """(licence, first sentence, last sentence) in order of the text. Each rule goes over the sentences once, and looks no further
    ahead than the gap, so a long list of the same sentence costs no more than its length."""
    free, out = list(found), []
    for name, rule in RULES:
        used: set[int] = set()
        for i, (_, k) in enumerate(free):
            if k != rule[0] or i in used:
                continue
            chain = [i]
            for want in rule[1:]:
                last, j = free[chain[-1]][0], chain[-1] + 1
                while j < len(free) and free[j][0] - last - 1 <= gap and (free[j][1] != want or j in used):
                    j += 1
                if j == len(free) or free[j][0] - last - 1 > gap:
                    break
                chain.append(j)
            if len(chain) == len(rule):
                out.append((name, free[chain[0]][0], free[chain[-1]][0]))
                used.update(chain)
        if used:
            free = [x for i, x in enumerate(free) if i not in used]
    return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2) -> DataFrame:
    """id_col, n_sentences, n_known and matches (array of license, first, last) per row of df."""

    def run(batches):
        kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                n, known, hits = [], [], []
                for text in part.column(1).to_pylist():
                    total, found = identifiers(text)
                    n.append(total)
                    known.append(len(found))
                    hits.append([{"license": a, "first": x, "last": y} for a, x, y in matches(found, gap)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(hits, kind)], ["id", "n_sentences", "n_known", "matches"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, n_sentences bigint, n_known bigint, matches array<struct<license: string, first: bigint, last: bigint>>").withColumnRenamed("id", id_col)
