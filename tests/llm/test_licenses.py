import re

from pyspark.sql import functions as F

from tidelog.llm import catalog
from tidelog.llm import licenses as L

WORD = re.compile(L.WORD)
GATE, RULES = L.gate(), L.rules()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """Words, base places, and detections that no better interval contains, with Python's expressions."""
    w = WORD.findall((text or "").translate(LOWER))
    base = []
    for phrase, label in L.BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    spaced = " " + "  ".join(w) + " "
    found = []
    if any(g in spaced for g in GATE):
        for order, priority, _, label, key, pattern in RULES:
            if key in spaced:
                for m in re.finditer(pattern, spaced):
                    a = spaced[: m.start()].count(" ") // 2
                    found.append((a, a + m.group().count(" ") // 2, priority, order, label))
    kept = []
    for d in found:
        inside = [e for e in found if e is not d and e[0] <= d[0] and e[1] >= d[1]]
        if not any(e[2] < d[2] or (e[2] == d[2] and ((e[1] - e[0], -e[3]) > (d[1] - d[0], -d[3]))) for e in inside):
            kept.append((d[0], d[1], d[2], d[4]))
    return len(w), sorted(base), sorted(kept)




def test_there_are_hundreds_of_rules():
    assert len(L.rules()) > 300 and len({r[5] for r in L.rules()}) > 300


def strings_of(pattern, rng):
    """A random string that the pattern matches."""
    out = ""
    for op, value in re._parser.parse(pattern) if isinstance(pattern, str) else pattern:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            kind, what = rng.choice(value)
            out += "x" if str(value[0][0]) == "NEGATE" else chr(what if str(kind) == "LITERAL" else rng.randint(*what))
        elif name == "BRANCH":
            out += strings_of(rng.choice(value[1]), rng)
        elif name == "SUBPATTERN":
            out += strings_of(value[3], rng)
        elif name == "MAX_REPEAT":
            out += "".join(strings_of(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 3))))
        else:
            raise AssertionError(name)
    return out


def test_gate_and_keywords_stand_in_every_match(rng):
    for order, _, _, label, key, pattern in RULES:
        for _ in range(40):
            text = strings_of(pattern, rng)
            assert re.fullmatch(pattern, text), (pattern, text)
            assert key in text and any(g in text for g in GATE), (order, label, key, text)
    assert all(any(g in phrase for g in GATE) for phrase, _ in L.BASE)


#: Passages of license texts, and the labels a reader gives them.
TEXTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software": {"mit"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": {"bsd"},
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived": {"bsd-3-clause"},
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,": {"apache-2.0"},
    "This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by": {"gpl"},
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided": {"isc"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "GNU Library General Public License": {"gpl", "lgpl"},
    "MIT No Attribution": {"mit-0"},
    "Permission is granted by the library to any person with a card.": set(),
    "You may not use this room except in the afternoon; the license of the bar is on the wall.": set(),
}


def test_sentences_of_license_texts(docs_of):
    found = L.detect(docs_of(list(TEXTS))).select("doc_id", L.joined("concat(transform(base, b -> b.label), transform(detections, d -> d.label))").alias("labels"))
    texts = list(TEXTS)
    assert {texts[r.doc_id]: set(filter(None, r.labels.split(","))) for r in found.collect()} == TEXTS


CASES = [
    "Released under the MIT License.", "MIT license MIT License mit-license", "the mit licenses", "Licensed under the Apache License, Version 2.0.",
    "GNU General Public License, version 3 or (at your option) any later version.", "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-2.0-only",
    "GNU Lesser General Public License v2.1 and GNU Affero General Public License", "BSD 3-Clause", "licensed under the 3-clause BSD license",
    "Mozilla Public License 2.0, Eclipse Public License - v 2.0", "placed in the public domain", "Creative Commons Attribution-ShareAlike license",
    "Creative Commons Attribution-NonCommercial-NoDerivatives", "CC0 1.0 Universal", "no statement at all", "", None, "License: MIT", "é licençe mit license",
    "general public license general public license", "The Apache Software License 1.1; MIT licence; ISC license; zlib license; Unlicense", "public\ndomain released in the\n public domain",
    "mit " * 30 + "license", "Apache License " * 400, *TEXTS,
]


def test_against_python(docs_of):
    rows = L.detect(docs_of(CASES)).collect()
    for r in rows:
        n, base, kept = brute(CASES[r.doc_id])
        assert r.n_words == n
        assert sorted((b.first, b.label) for b in r.base) == base, CASES[r.doc_id]
        assert sorted((d.first, d.end, d.priority, d.label) for d in r.detections) == kept, CASES[r.doc_id]
    found = {r.doc_id: {d.label for d in r.detections} for r in rows}
    assert found[3] == {"apache-2.0"} and found[4] == {"gpl-3.0-or-later"} and found[5] == {"apache-2.0"}


#: Lines as they occur in documents, and the labels a reader gives them.
LINES = {
    "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
    "This work is licensed under CC-BY-SA 3.0.": {"cc-by-sa"},
    "licensed under CC BY v2.5": {"cc-by"},
    "Licensed under GPL-3.0": {"gpl-3.0"},
    "Licensed under MPL 2.0": {"mpl-2.0"},
    "Released under MIT.": {"mit"},
    "Distributed under the terms of the GNU LGPL v2.1": {"lgpl-2.1"},
    "Released under MIT-0": {"mit-0"},
    "GPLv3": {"gpl-3.0"},
    "GPLv2 or later": {"gpl-2.0-or-later"},
    "AGPLv3": {"agpl-3.0"},
    "Apache License v2.0": {"apache", "apache-2.0"},
    "GNU General Public License v3": {"gpl", "gpl-3.0"},
    "Mozilla Public License v. 2.0": {"mpl-2.0"},
    "Licensed under the Apache License, Version 2.0.": {"apache", "apache-2.0"},
    "under the MIT License.": {"mit"},
    "This work is licensed under the GNU General Public License": {"gpl"},
    "Published by MIT Press": set(),
    "Compression is provided under zlib, storage under PostgreSQL 9.": set(),
    "Sie kam mit dem Zug, released under protest": set(),
}


def test_lines_of_documents(spark, docs_of):
    found = L.detect(docs_of(list(LINES))).select("doc_id", L.joined("concat(transform(base, b -> b.label), transform(detections, d -> d.label))").alias("labels"))
    texts = list(LINES)
    assert {texts[r.doc_id]: set(filter(None, r.labels.split(","))) for r in found.collect()} == LINES
    for text in LINES:
        assert {d[3] for d in brute(text)[2]} <= LINES[text]


def test_odd_empty_and_clashing(odd, docs_of):
    assert L.detect(odd).where("size(detections) > 0").count() == 0 and L.detect(odd).count() == odd.count()
    assert L.detect(docs_of([])).count() == 0
    df = docs_of(["MIT License"]).withColumns({c: F.lit(1) for c in ("base", "detections", "_low", "_words", "_found")})
    assert L.detect(df).first().base[0].label == "mit"


def test_plan_stays_native(spark):
    text = catalog.op6_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text
