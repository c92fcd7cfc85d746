"""Licence rules on texts written here, and against a plain search on the documents."""

import random
import time

from pyspark.sql import Row

from strandlake.llm import licenses
from strandlake.llm.queries import queries

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"
SF = "/root/testdata/sf0.001"


def names(text, gap=2):
    return [m[0] for m in licenses.matches(licenses.identifiers(text)[1], gap)]


def sentence(k):
    return licenses.SENTENCES[k][0].capitalize() + "."


def test_rules():
    assert names("Some words. Licensed under the Apache License, Version 2.0. More words") == ["Apache-2.0"]
    assert names("Released under the MIT License.\nAll rights reserved.") == ["MIT", "All-Rights-Reserved"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("MIT") == [] and names("I read about the MIT License today.") == [] and names(None) == names("") == []
    bsd = [sentence(k) for k in ("bsd-intro", "bsd-source", "bsd-binary")]
    assert names(" ".join(bsd)) == ["BSD-2-Clause"] and names(" ".join([*bsd, sentence("bsd-names")])) == ["BSD-3-Clause"]
    assert names(" ".join(reversed(bsd))) == []  # order counts
    assert names(" A. B. ".join(bsd)) == ["BSD-2-Clause"] and names(" A. B. C. ".join(bsd)) == [] and names(" A. B. C. ".join(bsd), gap=3) == ["BSD-2-Clause"]
    assert names("Licensed under the Apache License, Version 2.0; " + sentence("apache-may") + sentence("apache-copy").join(["\n", ""])) == ["Apache-2.0"]
    assert names("All rights reserved. " * 3) == ["All-Rights-Reserved"] * 3


def brute_matches(found, gap):
    """Rules one after another; each takes the first place where it fits, and begins anew, until it fits nowhere."""
    free, out = list(found), []
    for name, rule in licenses.RULES:
        while True:
            for i in range(len(free)):
                chain = [i] if free[i][1] == rule[0] else []
                for want in rule[1:]:
                    later = [j for j in range(chain[-1] + 1, len(free)) if free[j][1] == want] if chain else []
                    chain = [*chain, later[0]] if later and free[later[0]][0] - free[chain[-1]][0] - 1 <= gap else []
                if chain:
                    out.append((name, free[chain[0]][0], free[chain[-1]][0]))
                    free = [x for j, x in enumerate(free) if j not in chain]
                    break
            else:
                break
    return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(7)
    names_ = ["mit-grant", "mit-notice", "as-is", "bsd-intro", "bsd-source", "bsd-binary", "bsd-names", "free", "gpl-terms-3", "reserved", "name:MIT", "name:Apache-2.0", "apache-may", "apache-copy"]
    for _ in range(400):
        few = rng.sample(names_, rng.randint(2, 8))
        at, found = 0, []
        for _ in range(rng.randint(0, 25)):
            at += rng.choice([1, 1, 1, 2, 3, 4])
            found.append((at, rng.choice(few)))
        gap = rng.choice([0, 1, 2, 5])
        assert licenses.matches(found, gap) == brute_matches(found, gap)


def test_many_equal_sentences_take_time_in_proportion():
    begun = time.perf_counter()
    for k in ("reserved", "mit-grant"):
        n, found = licenses.identifiers(sentence(k) * 1 + "\n" + (sentence(k) + "\n") * 40_000)
        assert n == len(found) == 40_001 and len(licenses.matches(found)) == (40_001 if k == "reserved" else 0)
    assert time.perf_counter() - begun < 60


def test_scan(spark):
    texts = [None, "", "x", "All rights reserved.", "All rights reserved.", "w " * 100_000 + ". Released under the MIT License."]
    df = spark.createDataFrame([Row(doc_id=i, text=t, matches="clash", id="clash") for i, t in enumerate(texts)] + [Row(doc_id=None, text="all rights reserved", matches="", id="")])
    rows = {r.doc_id: (r.n_sentences, r.n_known, [m.license for m in r.matches]) for r in licenses.scan(df).collect()}
    assert rows == {0: (0, 0, []), 1: (0, 0, []), 2: (1, 0, []), 3: (1, 1, ["All-Rights-Reserved"]), 4: (1, 1, ["All-Rights-Reserved"]), 5: (2, 1, ["MIT"]), None: (1, 1, ["All-Rights-Reserved"])}
    assert licenses.scan(df.limit(0)).count() == 0


def test_query_finds_what_a_plain_search_finds(spark):
    lines = {"licensed under cc by-nc 4.0.": "CC-BY-NC-4.0", "this work is licensed under the gnu general public license, version 3.": "GPL-3.0", "licensed under the apache license, version 2.0.": "Apache-2.0", "released under the mit license.": "MIT", "all rights reserved.": "All-Rights-Reserved"}
    got = {r.doc_id: r.licenses for r in queries()["op7_license_rules"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = list(dict.fromkeys(lines[x.strip().lower()] for x in r.text.split("\n") if x.strip().lower() in lines))
        assert set(want) <= set(filter(None, got[r.doc_id].split(",")))
        if not any(k.rstrip(".") in r.text.lower() for k in lines):
            assert got[r.doc_id] == ""


MIT_TEXT = MIT + """ and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NAMES_TEXT = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL_3_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL_2_TEXT = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
WRAPPED = {MIT_TEXT: "MIT", BSD_TEXT: "BSD-2-Clause", BSD_TEXT + NAMES_TEXT: "BSD-3-Clause", ISC_TEXT: "ISC", GPL_3_TEXT: "GPL-3.0-or-later", GPL_2_TEXT: "GPL-2.0-or-later", GPL_2_TEXT.replace("This program", "This"): "GPL-2.0-or-later"}


def test_wrapped_texts():
    for text, name in WRAPPED.items():
        for mark in ("", "# ", " * ", "// ", ";; ", "! ", "REM ", "dnl "):
            for end in ("\n", "\r\n", "\r"):
                marked = end.join(mark + x for x in text.split("\n"))
                assert names(marked) == [name], (mark, marked)
                assert names(f"/*{end}{marked}{end} */{end}code = 1;") == [name]
                assert names(f"Copyright (c) Somebody{end}{marked}") == [name]  # no end before it
    assert names("Licensed under the\nMIT License") == names("words\nLicensed under the MIT\nLicense\nwords") == ["MIT"]
    assert names("Licensed under the\n\nMIT License and words") == names("I read about the\nMIT License today") == []
    assert licenses.identifiers("some words\nthat go on. More\n\nThe end\nof it") == (3, [])
    assert licenses.identifiers("some words\non two lines\nReleased under the\nMIT License\nmore\nwords") == (3, [(1, "name:MIT")])
    bsd = [sentence(k) for k in ("bsd-intro", "bsd-source", "bsd-binary")]
    assert names("\nA sentence\nwrapped at\neach word\nand line.\n".join(bsd)) == ["BSD-2-Clause"]  # gaps are of sentences, not of lines
