import pytest

from cinderbark.llm import licences as op
from tests.llm.fixtures import docs, no_docs, words

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = [op.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")]


def found(text):
    return [(m[0], m[4]) for m in op.match(op.identify(text))]


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, [("MIT", 2)]),
        ("\n".join(" * " + x for x in MIT.splitlines()), [("MIT", 2)]),
        (MIT.upper(), [("MIT", 2)]),
        ("\n".join(BSD), [("BSD-3-Clause", 4)]),
        ("\n".join(BSD[:3]), [("BSD-2-Clause", 3)]),
        ("\n".join([BSD[0], BSD[2], BSD[1]]), []),  # the order counts
        ("\n".join([BSD[0], *["Other words."] * 9, BSD[1], BSD[2]]), []),  # too far apart
        ("Text.\nLicensed under the Apache License, Version 2.0.\nMore.", [("Apache-2.0", 1)]),
        ("This work is licensed under the GNU General Public License, version 3.", [("GPL-3.0", 1)]),
        ("Licensed under CC BY-NC 4.0.", [("CC-BY-NC-4.0", 1)]),
        ("Released under the MIT License.\nReleased under the MIT License.", [("MIT", 1), ("MIT", 1)]),
        ("# SPDX-License-Identifier: BSD-3-Clause", [("BSD-3-Clause", 1)]),
        ("We licensed the film under a new name.", []),
        ("", []),
        ("a driving licence under the seat", []),
    ],
)
def test_rules(text, want):
    assert found(text) == want


def test_places_are_of_the_source():
    text = words(30, 1) + ".\n\n" + MIT + "\nReleased under the MIT License.\n"
    spans = [text[m[2] : m[3]] for m in op.match(op.identify(text))]
    assert spans[0].startswith("Permission is") and spans[0].rstrip().endswith("the Software") and spans[1] == "Released under the MIT License"


def test_every_sentence_has_an_anchor():
    for text in [*op.SENTENCES.values(), *(f"{n} the {x}" for n in op.NOTICES for xs in op.NAMES.values() for x in xs)]:
        assert any(a in text.lower() for a in op.ANCHORS), text


def test_frames(spark):
    df = spark.createDataFrame([(1, MIT), (1, MIT), (None, "Licensed under CC BY 4.0."), (2, None), (3, "")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.licence) for r in op.scan(df).collect()) == [("1", "MIT"), ("1", "MIT"), ("None", "CC-BY-4.0")]
    assert op.scan(docs(spark)).count() == 0 == op.scan(no_docs(spark)).count()


def wrapped(keys, sign, width=60):
    import textwrap

    lines = ["Copyright 2020 The Authors", ""]
    for k in keys:
        lines += [*textwrap.wrap(op.SENTENCES[k], width), ""]
    return "\n".join(f"{sign} {x}".rstrip() for x in lines[:-1]) + "\n\nimport os\n"


@pytest.mark.parametrize("sign", ["", "#", "//", " *", ";;", "--", "%"])
@pytest.mark.parametrize("licence, ids", op.RULES)
def test_rules_on_wrapped_and_commented_headers(licence, ids, sign):
    for width in (40, 60, 75):
        assert found(wrapped(ids, sign, width)) == [(licence, len(ids))]


APACHE = """# Copyright 2020 Foo
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


def test_usual_headers():
    assert found(APACHE) == [("Apache-2.0", 3)] and found(MPL) == [("MPL-2.0", 1)]
    (m,) = op.match(op.identify(APACHE))
    assert APACHE[m[2] : m[3]].startswith("Licensed under") and APACHE[m[2] : m[3]].endswith("express or implied")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under\nGPLv3.", "GPL-3.0"),
        ("Distributed under\n the GPL-2.0", "GPL-2.0"),
        ("# Published\n# under\n# the MIT.", "MIT"),
        ("This is free and\nunencumbered software released into the public domain.", "Unlicense"),
        ("// This is free\n// and unencumbered software released into the\n// public domain.", "Unlicense"),
    ],
)
def test_anchors_hold_over_line_breaks(text, want):
    assert found(text) == [(want, 1)]
    assert not any(c.isspace() for a in op.ANCHORS for c in a)


def brute(text):
    """Every span between a beginning and an ending is normalised and looked up; the longest of a beginning, none within another."""
    import re

    begins = {0} | {m.end() for m in re.finditer(r"\n|[.;:!?](?=\s)", text)}
    ends = {len(text)} | {m.start() for m in re.finditer(r"\n|[.;:!?](?=\s|\Z)", text)}
    out, reach = [], -1
    for a in sorted(begins):
        first = re.search(r"[\w.+]+", text[a:])
        start = a + first.start() if first else a
        spans = []
        for b in sorted(ends):
            span = text[start:b].rstrip("".join(set(text) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+")))
            if b > start and not re.search(r"\n[ \t\r]*(?:#+|//+|\*+|;+)?[ \t\r]*\n", span) and op.normalise(span) in op.known():
                spans.append((len(op.normalise(span)), -start - len(span), op.known()[op.normalise(span)]))
        if spans and -max(spans)[1] > reach:
            reach = -max(spans)[1]
            out.append((start, reach, max(spans)[2]))
    return out


def test_identifiers_match_brute_force(spark):
    import random

    r = random.Random(4)
    parts = [*op.SENTENCES.values(), "Released under the MIT License.", "Some other words", "Licensed under GPLv3; see below.", "All rights", "the", "Version 2.", "terms of the"]
    texts = []
    for _ in range(150):
        glue = r.choice(["\n", " ", ".\n", "\n\n", "\n#\n", " " * 900, "; "])
        text = glue.join(r.choice(parts) for _ in range(r.randint(1, 5)))
        if r.random() < 0.6:
            sign = r.choice(["", "# ", " * ", "// "])
            text = "\n".join(sign + x for x in text.replace(" ", "\n", r.randint(0, 3)).split("\n"))
        texts.append(text)
    for text in texts:
        assert [(a, b, f) for a, b, f, *_ in op.identify(text)] == brute(text), text
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted((k, *m) for k, t in enumerate(texts) for m in op.match([(*x[:3], *y[3:]) for x, y in zip(brute(t), op.identify(t))]))
    assert sorted(tuple(x) for x in op.scan(df).collect()) == want and len(want) > 50


def test_no_length_matters():
    gap = " \t" * 5000
    assert found(f"Released under{gap}MIT.") == [("MIT", 1)] and found("Released\tunder\tCC0 1.0.") == [("CC0-1.0", 1)]
    text = "word " * 400_000 + "\n" * 200_000 + "." * 200_000 + "; " * 100_000 + "\nReleased under the MIT License"
    import time

    began = time.time()
    assert found(text) == [("MIT", 1)] and time.time() - began < 20


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, MIT)], "doc_id bigint, text string").selectExpr("*", "1 AS licence", "2 AS start", "3 AS `end`", "4 AS rule")
    assert op.scan(df).columns == ["doc_id", "licence", "rule", "start", "end", "sentences"] and op.scan(df).count() == 1
