"""Long files: read by pieces, written as several records, with the facts of a whole reading."""

import ast

import pytest

from cinderbark.functions import extract, pieces
from cinderbark.operators import index
from cinderbark.operators.index import Facts
from cinderbark.plans.config import Config


def source(n: int) -> str:
    top = [f"def call_{k}(a):\n    left = 1\n    return order_{k}()\n    print('never')\ndef order_{k}():\n    return {k}\nT{k} = '''\ndef no_{k}():\nelse:\n'''" for k in range(n)]
    body = [f"    call_{k}(\n1)\n    if call_{k}:\n        json.dumps({k})\n    else:\n        order_{k}()" for k in range(n)]
    return "\n".join(["import json  # cinderbark: ignore[unused-import] -- kept", *top, "if __name__ == '__main__':", *body, "    raise SystemExit", "last = 1", ""])


def plain(found: dict) -> dict:
    return {k: v if isinstance(v, bool) else sorted(map(repr, v)) if k == "uses" else list(v) for k, v in found.items()}


@pytest.mark.parametrize("size, held", [(60, 3), (400, 10_000)])
def test_pieces_give_the_facts_of_the_whole(monkeypatch, size, held):
    text = source(40)
    whole = plain(extract.facts(text))
    most, parse = [], ast.parse
    monkeypatch.setattr(pieces, "LONG", 10)
    monkeypatch.setattr(pieces, "PIECE", size)
    monkeypatch.setattr(pieces, "HELD", held)
    monkeypatch.setattr(ast, "parse", lambda s, *a, **k: most.append(len(s.lstrip("\n"))) or parse(s, *a, **k))
    assert plain(extract.facts(text)) == whole
    assert max(most) < len(text) / 2


@pytest.mark.parametrize("bad", ["last = = 1", "x = '''", "  y = 1"])
def test_errors_keep_their_line(monkeypatch, bad):
    text = source(20).replace("last = 1", bad)
    with pytest.raises(SyntaxError) as whole:
        extract.facts(text)
    monkeypatch.setattr(pieces, "LONG", 10)
    monkeypatch.setattr(pieces, "PIECE", 100)
    with pytest.raises(SyntaxError) as split:
        extract.facts(text)
    assert split.value.lineno == whole.value.lineno


def test_records_of_one_file(spark):
    text = "".join(f"x_{k} = {k}\n" for k in range(2 * index.PIECE + 5))
    rows = spark.createDataFrame([("p", "long.py", text), ("p", "short.py", "y = 1\n"), ("p", "bad.py", "y = (\n")], "project_id string, path string, source string")
    table = index.index(rows, Config()).cache()
    assert table.filter("path = 'long.py'").count() == 3
    facts = Facts(table)
    assert facts.files.count() == 2 and facts.errors().count() == 1
    found = facts.bindings().filter("path = 'long.py'").select("ord", "name").collect()
    assert sorted((r.ord, r.name) for r in found) == [(k, f"x_{k}") for k in range(2 * index.PIECE + 5)]
