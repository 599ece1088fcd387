import hashlib
import random
import re

import pytest

from cinderbark.llm import pii as op
from tests.llm.fixtures import docs, no_docs

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and op.luhn(digits), 9 <= len(digits) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_plain_spans_match_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("ab1234 56789.0-+@(). 0é") for _ in range(r.randint(1, 40)))
        assert op.find(t) == brute(t)


def test_luhn():
    assert op.luhn("4111111111111111") and not op.luhn("4111111111111112")


DISGUISED = [
    ("mail john [at] example [dot] com ok", "email", "john [at] example [dot] com"),
    ("john at example dot com is", "email", "john at example dot com"),
    ("write to john(at)mail.example.org!", "email", "john(at)mail.example.org"),
    ("аdmin@exаmple.com x", "email", "аdmin@exаmple.com"),
    ("card ４１１１ １１１１ １１１１ １１１１ z", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("call plus four nine one seven six five five five one two three four now", "phone", "plus four nine one seven six five five five one two three four"),
    ("ip one nine two dot one six eight dot one dot four", "ip", "one nine two dot one six eight dot one dot four"),
]


@pytest.mark.parametrize("text, kind, span", DISGUISED)
def test_disguises_map_back_to_the_source(text, kind, span):
    assert [(op.KINDS[k], text[a:b]) for a, k, b in op.disguised(text, op.find(text))] == [(kind, span)]


@pytest.mark.parametrize("text", ["meet at noon dot here", "one two three", "plain words at the end. Then dot", "", "un deux", "x" * 1000, "a (at) b"])
def test_clean_texts_stay_clean(text):
    assert op.find(text) == [] == op.disguised(text, [])


def test_plain_spans_stay_where_disguises_touch_them():
    text = "jo​hn@ex.org and john [at] b [dot] org"
    plain = op.find(text)
    assert [text[a:b] for a, _, b in plain] == ["hn@ex.org"]
    assert [text[a:b] for a, _, b in op.disguised(text, plain)] == ["john [at] b [dot] org"]


def test_offsets_after_many_edits():
    r = random.Random(1)
    for _ in range(300):
        head = "".join(r.choice(["аbc ", "​", "one two three four ", "x (at) y ", "w "]) for _ in range(r.randint(0, 8)))
        text = head + "| joe [at] site [dot] com |" + " tail аа"
        found = [text[a:b] for a, k, b in op.disguised(text, op.find(text)) if k == 0]
        assert "joe [at] site [dot] com" in found


def test_long_texts_are_linear():
    import time

    t = time.time()
    for text in ("a" * 1_000_000, "1" * 300_000, "1." * 200_000, "+1 " + "(" * 200_000, "@" * 100_000, "one " * 50_000):
        op.disguised(text, op.find(text))
    assert time.time() - t < 60


def test_texts_full_of_findings_are_linear():
    import time

    def seconds(k):
        text = "a@b.co then bob at example dot com, " * k
        began = time.time()
        assert len(op.disguised(text, op.find(text))) == k
        return time.time() - began

    seconds(500)
    assert seconds(16_000) < 3.5 * seconds(8_000)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id bigint, text string").selectExpr("*", "1 AS kinds", "2 AS starts", "3 AS spans", "'x' AS disguised")
    assert op.digest(op.detect(df)).first().spans == "email:0:6"


def test_query_columns(spark):
    table = [(1, "a@b.co 10.0.0.1"), (2, None), (3, ""), (4, "joe [at] b [dot] com"), (None, "x@y.z")]
    out = {r.doc_id: r for r in op.digest(op.detect(spark.createDataFrame(table, "doc_id bigint, text string"))).collect()}
    assert (out[1].n_email, out[1].n_ip, out[1].spans) == (1, 1, "email:0:6,ip:7:15")
    assert out[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert out[2].spans == "" and out[2].base_sha256 == hashlib.sha256(b"").hexdigest() == out[4].base_sha256
    assert out[4].spans == "email:0:20" and out[4].n_disguised == 1 and out[None].n_email == 1
    assert op.detect(docs(spark)).count() == docs(spark).count() and op.detect(no_docs(spark)).count() == 0


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("ask bob at example [dot] com ok", "email", "bob at example [dot] com"),
        ("ask bob at mail.example dot com ok", "email", "bob at mail.example dot com"),
        ("ask bob at mail dot example.com ok", "email", "bob at mail dot example.com"),
        ("ask bob at example dot co dot za ok", "email", "bob at example dot co dot za"),
        ("email bob at example.com ok", "email", "bob at example.com"),
        ("ask bob.lee at example.com ok", "email", "bob.lee at example.com"),
        ("bob at example dot com. Then dot", "email", "bob at example dot com"),
        ("host 192 dot 168 dot 1 dot 10 is up", "ip", "192 dot 168 dot 1 dot 10"),
        ("host 192 dot 168.1 [dot] 10 is up", "ip", "192 dot 168.1 [dot] 10"),
    ],
)
def test_dots_of_any_kind(text, kind, span):
    assert [(op.KINDS[k], text[a:b]) for a, k, b in op.disguised(text, op.find(text))] == [(kind, span)]


@pytest.mark.parametrize("text", ["look at example.com", "email us at example.com", "arrive at noon.Then go", "300 dot 1 dot 1 dot 1", "1 dot 22 dot 3 dot 4 dot 5", "item 12 at example.com"])
def test_prose_with_at_and_dot_stays_clean(text):
    assert op.disguised(text, op.find(text)) == []
