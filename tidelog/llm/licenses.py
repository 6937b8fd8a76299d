"""License statements in texts, by ordered signature rules.

A text is lower-cased and reduced to its words, so that rules need not care for
punctuation and line breaks.  A rule is a regular expression over words with a
label, a priority and a keyword, a string that every match of it holds; it only runs
where that stands.  Rules are the sentences of license texts below, and the names of
licenses in the forms in which they are stated.
Detections of all rules are resolved in one pass: one that lies within the interval
of another of better priority, or of a larger one of the same priority, goes.

Everything is Spark expressions inside the row: no shuffle, no join.
"""

from __future__ import annotations

import collections
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import scans

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases whose words stand consecutively, and their labels.  Fixed values.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_V = "(?:version )?(?:v ?)?"
#: Behind an identifier: "gplv3" and "gpl 3" as well as "gpl v 3" and "gpl version 3".
_I = "(?: version)?(?: ?v)? ?"
#: Version and port of a Creative Commons identifier.
_CC = f"(?: {_V}[1-4](?: [05])?)?"
_LICENSE = "(?:public )?licen[sc]e"
#: Label, full name, identifier; both regular expressions over words, a version in digits apart.
FAMILIES = [
    ("mit", f"mit {_LICENSE}", "mit"),
    ("mit-0", f"mit no attribution(?: {_LICENSE})?", "mit 0"),
    ("x11", f"x11 {_LICENSE}", "x11"),
    ("isc", f"isc {_LICENSE}", "isc"),
    ("0bsd", f"(?:zero clause|0 clause) bsd(?: {_LICENSE})?", "0bsd"),
    ("bsd", f"bsd {_LICENSE}", "bsd"),
    ("bsd-1-clause", f"(?:1|one) clause bsd(?: {_LICENSE})?", "bsd 1 clause"),
    ("bsd-2-clause", f"(?:(?:2|two) clause|simplified|freebsd) bsd(?: {_LICENSE})?", "bsd 2 clause"),
    ("bsd-3-clause", f"(?:(?:3|three) clause|new|revised|modified) bsd(?: {_LICENSE})?", "bsd 3 clause"),
    ("bsd-4-clause", f"(?:(?:4|four) clause|original|old) bsd(?: {_LICENSE})?", "bsd 4 clause"),
    ("apache", f"apache(?: software)? {_LICENSE}", "apache"),
    ("apache-1.0", f"apache(?: software)? {_LICENSE} {_V}1 0", f"apache{_I}1 0"),
    ("apache-1.1", f"apache(?: software)? {_LICENSE} {_V}1 1", f"apache{_I}1 1"),
    ("apache-2.0", f"apache(?: software)? {_LICENSE} {_V}2(?: 0)?", f"apache{_I}2(?: 0)?"),
    ("gpl", "(?:gnu )?general public licen[sc]e", "(?:gnu )?gpl"),
    ("gpl-1.0", f"(?:gnu )?general public licen[sc]e {_V}1(?: 0)?", f"(?:gnu )?gpl{_I}1(?: 0)?"),
    ("gpl-2.0", f"(?:gnu )?general public licen[sc]e {_V}2(?: 0)?", f"(?:gnu )?gpl{_I}2(?: 0)?"),
    ("gpl-2.0-or-later", f"(?:gnu )?general public licen[sc]e {_V}2(?: 0)? or(?: at your option)? any later version", f"(?:gnu )?gpl{_I}2(?: 0)? or(?: any)? later(?: version)?"),
    ("gpl-3.0", f"(?:gnu )?general public licen[sc]e {_V}3(?: 0)?", f"(?:gnu )?gpl{_I}3(?: 0)?"),
    ("gpl-3.0-or-later", f"(?:gnu )?general public licen[sc]e {_V}3(?: 0)? or(?: at your option)? any later version", f"(?:gnu )?gpl{_I}3(?: 0)? or(?: any)? later(?: version)?"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "(?:gnu )?lgpl"),
    ("lgpl-2.0", f"(?:gnu )?library general public licen[sc]e {_V}2(?: 0)?", f"(?:gnu )?lgpl{_I}2(?: 0)?"),
    ("lgpl-2.1", f"(?:gnu )?lesser general public licen[sc]e {_V}2 1", f"(?:gnu )?lgpl{_I}2 1"),
    ("lgpl-3.0", f"(?:gnu )?lesser general public licen[sc]e {_V}3(?: 0)?", f"(?:gnu )?lgpl{_I}3(?: 0)?"),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "(?:gnu )?agpl"),
    ("agpl-3.0", f"(?:gnu )?affero general public licen[sc]e {_V}3(?: 0)?", f"(?:gnu )?agpl{_I}3(?: 0)?"),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", "gfdl"),
    ("gfdl-1.2", f"(?:gnu )?free documentation licen[sc]e {_V}1 2", f"gfdl{_I}1 2"),
    ("gfdl-1.3", f"(?:gnu )?free documentation licen[sc]e {_V}1 3", f"gfdl{_I}1 3"),
    ("mpl", f"mozilla {_LICENSE}", "mpl"),
    ("mpl-1.0", f"mozilla {_LICENSE} {_V}1 0", f"mpl{_I}1 0"),
    ("mpl-1.1", f"mozilla {_LICENSE} {_V}1 1", f"mpl{_I}1 1"),
    ("mpl-2.0", f"mozilla {_LICENSE} {_V}2(?: 0)?", f"mpl{_I}2(?: 0)?"),
    ("epl", f"eclipse {_LICENSE}", "epl"),
    ("epl-1.0", f"eclipse {_LICENSE} {_V}1(?: 0)?", f"epl{_I}1(?: 0)?"),
    ("epl-2.0", f"eclipse {_LICENSE} {_V}2(?: 0)?", f"epl{_I}2(?: 0)?"),
    ("eupl-1.2", f"european union {_LICENSE}(?: {_V}1 2)?", f"eupl(?:{_I}1 2)?"),
    ("cddl-1.0", f"common development and distribution licen[sc]e(?: {_V}1 0)?", f"cddl(?:{_I}1 0)?"),
    ("cpl-1.0", f"common {_LICENSE}(?: {_V}1 0)?", f"cpl(?:{_I}1 0)?"),
    ("artistic-1.0", f"artistic licen[sc]e(?: {_V}1 0)?", f"artistic{_I}1 0"),
    ("artistic-2.0", f"artistic licen[sc]e {_V}2(?: 0)?", f"artistic{_I}2(?: 0)?"),
    ("bsl-1.0", f"boost software licen[sc]e(?: {_V}1 0)?", f"bsl{_I}1 0"),
    ("busl-1.1", f"business source licen[sc]e(?: {_V}1 1)?", f"busl{_I}1 1"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", f"wtfpl(?: {_V}2)?", "wtfpl"),
    ("zlib", f"zlib(?: libpng)? {_LICENSE}", "zlib"),
    ("postgresql", f"postgresql {_LICENSE}", "postgresql"),
    ("python-2.0", f"python(?: software foundation)? {_LICENSE}(?: {_V}2(?: 0)?)?", f"(?:python|psf){_I}2 0"),
    ("php-3.01", f"php {_LICENSE}(?: {_V}3 0?1)?", f"php{_I}3 0?1"),
    ("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_LICENSE}", "ncsa"),
    ("openssl", f"openssl {_LICENSE}", "openssl"),
    ("ofl-1.1", f"(?:sil )?open font licen[sc]e(?: {_V}1 1)?", "ofl(?: 1 1)?"),
    ("odbl-1.0", f"open(?: data commons)?(?: open)? database licen[sc]e(?: {_V}1 0)?", "odbl(?: 1 0)?"),
    ("ms-pl", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("osl-3.0", f"open software licen[sc]e(?: {_V}3(?: 0)?)?", "osl(?: 3 0)?"),
    ("upl-1.0", f"universal permissive licen[sc]e(?: {_V}1 0)?", "upl(?: 1 0)?"),
    ("sspl-1.0", f"server side public licen[sc]e(?: {_V}1(?: 0)?)?", "sspl(?: 1 0)?"),
    ("elastic-2.0", f"elastic licen[sc]e(?: {_V}2(?: 0)?)?", f"elastic{_I}2 0"),
    ("cc0-1.0", f"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0(?: 1 0)?"),
    ("cc-by", "creative commons attribution(?: licen[sc]e)?", f"cc by{_CC}"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: licen[sc]e)?", f"cc by sa{_CC}"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: licen[sc]e)?", f"cc by nc{_CC}"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)(?: licen[sc]e)?", f"cc by nd{_CC}"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?", f"cc by nc sa{_CC}"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: licen[sc]e)?", f"cc by nc nd{_CC}"),
    ("public-domain", "(?:released|placed|dedicated)(?: in)?(?: to)? the public domain", "public domain"),
    ("proprietary", "proprietary(?: and confidential)?(?: licen[sc]e)", "licenseref proprietary"),
]

_GRANT = "(?:licen[sc]ed|released|distributed|published|available|provided|covered|used)"
#: Verbs behind which an identifier alone is a statement, and those that say the same of a product ("provided under zlib").
_RELEASED = "(?:licen[sc]ed|released|distributed|published)"
_OFFERED = "(?:licen[sc]ed|released|distributed|published|available|provided|covered)"
#: Identifiers that are names of products, systems or places as well.
PRODUCTS = {"apache", "bsd", "x11", "zlib", "postgresql", "openssl", "ncsa", "python-2.0", "php-3.01"}
#: Families whose identifiers with a version can mean nothing else, as "GPLv3".
ALONE = ("gpl-", "lgpl-", "agpl-")
#: Priority, confidence, form, whether it holds the name, the identifier, the identifier behind a verb or the identifier alone.
FORMS = [
    (0, 1.0, "spdx licen[sc]e identifier {0}(?: (?:only|or later))?", "id"),
    (1, 0.9, _GRANT + "(?: only)? (?:under|by|with)(?: the)?(?: terms (?:of|and conditions of))?(?: the)? {0}", "name"),
    (1, 0.9, _GRANT + "(?: only)? (?:under|by|with)(?: the)?(?: terms (?:of|and conditions of))?(?: the)? {0}(?: licen[sc]e)", "id"),
    (2, 0.7, "{0}", "name"),
    (3, 0.5, "licen[sc]e {0}", "id"),
    (3, 0.5, "{0} licen[sc]ed", "id"),
    (1, 0.9, "{1}(?: only)? under(?: the)?(?: terms (?:of|and conditions of))?(?: the)? {0}", "granted"),
    (3, 0.5, "{0}", "alone"),
]
#: Sentences of license texts: grants, conditions and disclaimers.  ``*`` stands for up to twelve words of any kind.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the names? of * nor the names of (?:its|their|any) * may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-1.1", "products derived from this software may not be called apache"),
    ("apache-2.0", "you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "you can redistribute it and or modify it under the terms of(?: version [1-3] of)? the gnu general public license"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-2.0-or-later", "either version 2 of the license or(?: at your option)? any later version"),
    ("gpl-3.0-or-later", "either version 3 of the license or(?: at your option)? any later version"),
    ("lgpl", "you can redistribute it and or modify it under the terms of(?: version [2-3](?: 1)? of)? the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1-or-later", "either version 2 1 of the license or(?: at your option)? any later version"),
    ("agpl", "you can redistribute it and or modify it under the terms of(?: version 3 of)? the gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed * package"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("ncsa", "permission is hereby granted * to deal with the software without restriction"),
    ("python-2.0", "grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("x11", "except as contained in this notice the names? of * shall not be used in advertising or otherwise to promote the sale"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("cc0-1.0", "has (?:dedicated|waived) * to the public domain by waiving all of his or her rights"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "you may not distribute the modified material"),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
]
_ANY = "(?: [^ ]+ ){0,12}"
#: Words that stand in most statements and so tell little.
_COMMON = ("licen", "license", "under", "the", "of", "and", "or", "public")
#: Words, or parts of words, that most texts hold.
_USUAL = ("under", "the", "public", "software", "this", "you", "not", "may", "with", "version", "that", "file", "work", "mit", "isc", "epl", "mpl", "upl", "osl", "ofl", "general", "free", "later", "open", "and", "use", "which", "what", "without", "terms", "for", "any", "your", "their")


def needed(pattern: str) -> list[str]:
    """Strings that every match of a pattern holds: what is left of it without groups, classes and optional characters."""
    flat, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            i = pattern.index("]", i)
            flat += "|" if not depth else ""
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            flat += "|" if not depth else ""
        elif not depth:
            flat += c
        i += 1
    flat = re.sub(r"\{[0-9,]*\}", "|", flat)
    return [part for part in re.sub(r"\|[?]|.[?]", "|", flat).split("|") if part.strip()]


def _keyword(pattern: str) -> str:
    """The most telling needed string, by which the rule is tried or not."""
    return max(needed(pattern), key=lambda part: (any(w not in _COMMON for w in part.split()), len(part.strip()), part))


def rules() -> list[tuple[int, int, float, str, str, str]]:
    """``(order, priority, confidence, label, keyword, pattern)``; in a pattern every word has a blank on both sides."""
    out = []

    def add(priority: int, confidence: float, label: str, body: str) -> None:
        pattern = spaced(body)
        out.append((len(out), priority, confidence, label, _keyword(pattern), pattern))

    for priority, confidence, form, kind in FORMS:
        for label, name, identifier in FAMILIES:
            if kind != "alone" or label.startswith(ALONE):
                add(priority, confidence, label, form.format(name if kind == "name" else identifier, _RELEASED if label in PRODUCTS else _OFFERED))
    for label, sentence in SENTENCES:
        add(1, 0.95, label, sentence)
    return out


def _clauses(pattern: str) -> list[frozenset[str]]:
    """Sets of words of which every match of a pattern holds one each: its needed words, and the alternatives of its groups."""
    out = [frozenset([w]) for part in needed(pattern) for w in part.split()]
    for group in re.finditer(r"\(\?:([^()]*)\)(?![?{])", pattern):
        words = [max(re.split(r"\[[^]]*\]| +|.[?]", choice), key=len) for choice in group.group(1).split("|")]
        if all(words) and pattern[: group.start()].count("(") == pattern[: group.start()].count(")"):
            out.append(frozenset(words))
    return out


def gate() -> list[str]:
    """Few words of which every match of any rule or base phrase holds one; texts without them are not reduced to words."""
    open_ = [_clauses(spaced(phrase)) for phrase, _ in BASE] + [_clauses(pattern) for *_, pattern in rules()]
    chosen: set[str] = set()
    while open_:
        counts = collections.Counter(clause for clauses in open_ for clause in clauses)
        chosen |= max(counts, key=lambda clause: (not any(w in _USUAL or len(w) < 3 for w in clause), counts[clause] / len(clause), min(map(len, clause)), sorted(clause)))
        open_ = [clauses for clauses in open_ if not any(all(any(c in w for c in chosen) for w in clause) for clause in clauses)]
    return sorted(c for c in chosen if not any(other != c and other in c for other in chosen))


def spaced(pattern: str) -> str:
    words = " " + pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + " "
    return words.replace(" * ", _ANY)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(text: str, pattern: str, fields: str, kind: str) -> str:
    """Matches as word intervals: blanks in gaps and matches, two to a word, in turn."""
    count = "((length({0}) - length(replace({0}, ' ', ''))) div 2)"
    gap, hit = count.format("p.`0`"), count.format("p.`1`")
    pieces = f"arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0))"
    found = f"named_struct('first', acc.at + {gap}, 'last', -(acc.at + {gap} + {hit}), {fields})"
    return scans.placed(pieces, gap, hit, found, f"struct<{kind}>")


_BASE_KIND = "first:bigint,last:bigint,label:string"
_KIND = "first:bigint,last:bigint,priority:int,rule:int,confidence:double,label:string"


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` and ``detections``.

    ``base`` are the places of the base phrases ``(first, label)``, ``detections``
    what is left of the rules' matches after suppression ``(first, end, priority,
    confidence, label)``; word numbers from 0, ends exclusive.  A null text counts
    as empty.  Rows are never joined; columns named like the added ones are
    replaced.
    """
    table = ", ".join(
        f"named_struct('rule', {order}, 'priority', {priority}, 'confidence', {confidence}d, 'label', {_sql(label)}, 'keyword', {_sql(key)}, 'pattern', {_sql(pattern)})"
        for order, priority, confidence, label, key, pattern in rules()
    )
    df = docs.drop("n_words", "base", "detections", "_text", "_low", "_words", "_found")
    df = df.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("n_words", F.expr(f"cast(size(array_remove(split(_text, {_sql('[^0-9A-Za-z' + chr(92) + 'x{80}-' + chr(92) + 'x{10FFFF}]+')}, -1), '')) as bigint)"))
    df = df.withColumn("_low", F.lower("_text"))
    some = " or ".join(f"contains(_low, '{word}')" for word in gate())
    df = df.withColumn("_words", F.expr(f"case when {some} then concat(' ', array_join(array_remove(split(_low, {_sql(NOT_WORD)}, -1), ''), '  '), ' ') else '' end"))
    base = "|".join(phrase for phrase, _ in BASE)
    label = "element_at(array(" + ", ".join(_sql(x) for _, x in BASE) + "), cast(array_position(array(" + ", ".join(_sql(spaced(p)) for p, _ in BASE) + "), p.`1`) as int))"
    df = df.withColumn("base", F.expr(f"case when contains(_words, '  license ') then {_places('_words', _sql(spaced(f'(?:{base})')), f'{_sql('label')}, {label}', _BASE_KIND)} else cast(array() as array<struct<{_BASE_KIND}>>) end"))
    fields = "'priority', r.priority, 'rule', r.rule, 'confidence', r.confidence, 'label', r.label"
    every = f"flatten(transform(filter(array({table}), r -> contains(_words, r.keyword)), r -> {_places('_words', 'r.pattern', fields, _KIND)}))"
    df = df.withColumn("_found", F.expr(f"case when _words <> '' then array_sort({every}) else cast(array() as array<struct<{_KIND}>>) end"))
    # By first word, then longest, then priority: whatever suppresses a detection comes before it.
    levels = 1 + max(form[0] for form in FORMS)
    left = f"""aggregate(_found, named_struct('ends', array_repeat(0L, {levels}), 'out', cast(array() as array<struct<{_KIND}>>)), (acc, d) ->
        named_struct('ends', transform(acc.ends, (e, level) -> if(level = d.priority, greatest(e, -d.last), e)),
            'out', if(exists(slice(acc.ends, 1, d.priority + 1), e -> e >= -d.last), acc.out, concat(acc.out, array(d)))),
        acc -> transform(acc.out, d -> named_struct('first', d.first, 'end', -d.last, 'priority', d.priority, 'confidence', d.confidence, 'label', d.label)))"""
    return df.withColumn("detections", F.expr(left)).drop("_text", "_low", "_words", "_found")


def joined(labels: str) -> Column:
    return F.expr(f"array_join(array_sort(array_distinct({labels})), ',')")
