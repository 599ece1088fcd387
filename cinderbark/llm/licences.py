"""Licence scans by sentence rules.

A text's sentences are normalised (lower case, comment signs and punctuation
away, one space) and looked up in a table of known licence sentences.  That turns
the text into a short sequence of sentence identifiers with places, and ordered
rules over identifiers name the licence: the sentences of a rule have to follow
each other in order, at most ``GAP`` sentences apart.  Rules with more sentences
go first, and a place that one rule has used is not used again.

A sentence begins with a line or after a stop, colon or semicolon, and ends with
a line or before such a mark; in between it may go on over marks, line breaks,
comment signs and any white space, but not over a blank or bare comment line.
Known sentences are a trie of words, which each beginning is walked along, so no
length matters and a text costs one short look for each of its sentences.
A text without any of the words that every known sentence contains is skipped.

Results.  One row per licence found: doc_id, licence, rule, start, end (code
points of the source text, end exclusive), sentences.  Null and empty texts have
none; very long texts are read whole.  Rows are judged by themselves; repeated
rows and null ids are carried, an empty table gives an empty result, and other
columns are ignored, whatever their names.  Of known sentences that begin at one
place the longest counts, and those within it don't.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.llm.common import arrow_fields

#: Sentences that may lie between neighbours of a rule.
GAP = 3

# Names that notices give licences.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 License", "Apache-2.0 license", "Apache 2.0"],
    "MIT": ["MIT License", "MIT licence", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD license"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GPL version 2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GPL version 3", "GPLv3", "GPL-3.0", "GNU General Public License, version 3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal"],
}
# The long names of Creative Commons conditions.
_CONDITIONS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _long = "-".join(_CONDITIONS[c] for c in _kind.split("-"))
        NAMES[f"CC-{_kind}-{_version}"] = [f"CC {_kind} {_version}", f"CC-{_kind}-{_version}", f"CC {_kind} {_version} license", f"Creative Commons {_long} {_version} International License", f"Creative Commons {_long} {_version} License"]
# How notices begin.
NOTICES = ["Licensed under", "Released under", "Distributed under", "Published under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This program is licensed under", "This code is released under", "This file is licensed under", "License", "Licence", "SPDX-License-Identifier"]
# Sentences of licence texts and headers.
SENTENCES = {
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-use": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "rights": "All rights reserved.",
}
# Ordered rules over sentence identifiers.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-title"]),
    ("ISC", ["isc-grant", "as-is"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-use", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-use"]),
    ("MPL-2.0", ["mpl-header"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("LGPL-2.1-or-later", ["lgpl-free"]),
    ("Unlicense", ["unlicense"]),
]
#: Every known sentence contains one of these; single words, which no line break can part.
ANCHORS = ("licen", "copyright", "permission", "warrant", "redistribut", "spdx", "unencumbered", "reserved", "under")

_WORD = re.compile(r"[\w.+]+")
#: Where a sentence may begin: at the text's start, after a line break, or after a mark and white space.
_BEGIN = re.compile(r"\A|\n|[.;:!?](?=\s)")
#: What parts two pieces: marks, and blank or bare comment lines, over which no sentence goes on.
_END = re.compile(r"[.:!?](?=\s|\Z)|(?<=[^\s;]);(?=\s|\Z)|\n[ \t\r]*(?:(?:#+|//+|/?\*+/?|;+|--+|%+|<!--|-->)[ \t\r]*)?(?=\n)")
_BLANK = re.compile(r"\n[ \t\r]*(?:(?:#+|//+|/?\*+/?|;+|--+|%+|<!--|-->)[ \t\r]*)?\n")
#: Words that normal forms leave out; ``terms`` only before ``of``.
_LEFT_OUT = frozenset(["the", "a", "an", "of", ""])


def _kept(words: list[str]) -> list[str]:
    return [w for k, w in enumerate(words) if w not in _LEFT_OUT and not (w == "terms" and words[k + 1 : k + 2] == ["of"])]


def normalise(sentence: str) -> str:
    """Lower case, words only, one space between them; articles and closing stops go."""
    return " ".join(_kept([w.rstrip(".") for w in _WORD.findall(sentence.lower())]))


@lru_cache(maxsize=1)
def known() -> dict[str, str]:
    """Normalised sentence to identifier."""
    out = {}
    for licence, names in NAMES.items():
        for name in names:
            for begin in NOTICES:
                for link in (" ", " the ", ": ", " the terms of the "):
                    out[normalise(f"{begin}{link}{name}")] = f"notice:{licence}"
    for key, text in SENTENCES.items():
        out[normalise(text)] = key
    for licence, (name, *_) in NAMES.items():
        out[normalise(f"SPDX-License-Identifier: {licence}")] = f"notice:{licence}"
        out[normalise(f"SPDX-License-Identifier: {licence}-or-later")] = f"notice:{licence}-or-later"
    return out


@lru_cache(maxsize=1)
def ordered_rules() -> list[tuple[str, str, list[str]]]:
    """(name, licence, identifiers), longest first, else as given; notices are rules of one sentence."""
    notices = sorted({i for i in known().values() if i.startswith("notice:")})
    rules = [(f"{licence}:{len(ids)}", licence, ids) for licence, ids in RULES]
    rules += [(n, n.removeprefix("notice:"), [n]) for n in notices]
    return sorted(rules, key=lambda r: -len(r[2]))


@lru_cache(maxsize=1)
def trie() -> dict:
    """Known sentences by their words; the empty key holds the identifier of a sentence that ends there."""
    root: dict = {}
    for sentence, identifier in known().items():
        node = root
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[""] = identifier
    return root


def _closes(text: str, at: int) -> bool:
    """Whether a sentence may end at ``at``: a line's end or a mark comes next, but for signs and spaces."""
    while at < len(text) and not text[at].isalnum() and text[at] not in "_+":
        if text[at] == "\n" or (text[at] in ".;:!?" and (at + 1 == len(text) or text[at + 1].isspace())):
            return True
        at += 1
    return at == len(text)


def _walk(low: str, at: int) -> tuple[int, int, str] | None:
    """(start, end, identifier) of the longest known sentence that begins at the first word from ``at`` on."""
    node, start, end, best, held = trie(), -1, at, None, None
    for m in _WORD.finditer(low, at):
        if start >= 0 and low.find("\n", end, m.start()) >= 0 and _BLANK.search(low, end, m.start()):
            break
        if start < 0:
            start = m.start()
        word = m[0].rstrip(".")
        if held:  # "terms" goes only before "of"
            if word != "of":
                node = node.get(held)
            held = None
            if node is None:
                break
        if word == "terms":
            held = word
        elif word not in _LEFT_OUT:
            node = node.get(word)
            if node is None:
                break
        end = m.end()
        if "" in node and not held and word not in _LEFT_OUT and _closes(low, m.start() + len(word)):
            best = start, m.start() + len(word), node[""]
    return best


def identify(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, identifier, first and last piece) of known sentences, by place."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case has more code points
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not any(a in low for a in ANCHORS):
        return []
    root, out, reach, seen = trie(), [], -1, -1
    for m in _BEGIN.finditer(low):
        if m.end() <= seen:
            continue
        first = _WORD.search(low, m.end())
        if not first:
            break
        seen = first.start()
        word = first[0].rstrip(".")
        if word not in root and word not in _LEFT_OUT and word != "terms":
            continue
        found = _walk(low, first.start())
        if found and found[1] > reach:
            out.append(found)
            reach = found[1]
    if not out:
        return []
    ends = [m.start() for m in _END.finditer(low)]
    return [(a, b, found, bisect_left(ends, a), bisect_left(ends, b)) for a, b, found in out]


def _follow(found: list, used: list[bool], last: int, wanted: str, gap: int) -> int | None:
    """The next unused place of ``wanted`` within ``gap`` sentences of place ``last``."""
    for k in range(last + 1, len(found)):
        if found[k][3] - found[last][4] > gap + 1:
            return None
        if not used[k] and found[k][2] == wanted:
            return k
    return None


def match(found: list[tuple[int, int, str, int, int]], gap: int = GAP) -> list[tuple[str, str, int, int, int]]:
    """(licence, rule, start, end, sentences) of the rules that the identifiers satisfy."""
    used, out = [False] * len(found), []
    places: dict[str, list[int]] = {}
    for k, f in enumerate(found):
        places.setdefault(f[2], []).append(k)
    for name, licence, ids in ordered_rules():
        for first in places.get(ids[0], []):
            chain = [] if used[first] else [first]
            for wanted in ids[1:] if chain else []:
                follow = _follow(found, used, chain[-1], wanted, gap)
                if follow is None:
                    chain = []
                    break
                chain.append(follow)
            if chain:
                for k in chain:
                    used[k] = True
                out.append((licence, name, found[chain[0]][0], found[chain[-1]][1], len(chain)))
    return sorted(out, key=lambda r: (r[2], r[3], r[0]))


_FOUND = "doc_id bigint, licence string, rule string, start bigint, end bigint, sentences bigint"


def _scan(batches):
    fields = arrow_fields(_FOUND)
    for b in batches:
        rows = [(doc_id, *m) for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if text for m in match(identify(text))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)], schema=fields)


def scan(docs: DataFrame) -> DataFrame:
    """The licences of every whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _FOUND)
