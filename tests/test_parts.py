"""Globs, settings, rewrites, sources and the stream of changes."""

import re

import pytest

from cinderbark.functions.globs import any_regex, ignore_regex, name_regex, rules_of
from cinderbark.functions.rewrite import rewrite
from cinderbark.functions.vocabulary import TEST_PATTERNS
from cinderbark.plans.config import Config, from_table, from_toml


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*.log", ["a.log", "x/a.log"], ["a.logs"]),
        ("/top", ["top", "top/a"], ["x/top"]),
        ("dir/", ["dir/a", "x/dir/a"], ["dir"]),
        ("a/*.py", ["a/b.py"], ["x/a/b.py", "a/c/b.py"]),
        ("**/migrations/*.py", ["migrations/a.py", "x/y/migrations/b.py"], ["migrations/x/a.py"]),
        ("build/**", ["build/a", "build/a/b"], ["build", "xbuild/a"]),
        ("f?o.[ab]", ["fxo.a"], ["foo.c"]),
    ],
)
def test_ignore_patterns(pattern, yes, no):
    regex = re.compile(ignore_regex(pattern))
    assert all(regex.match(p) for p in yes) and not any(regex.match(p) for p in no)


def test_pattern_sets():
    tests = re.compile(any_regex(TEST_PATTERNS))
    assert all(tests.match(p) for p in ("tests/a.py", "x/tests/b.py", "test/a.py", "a/test_b.py", "b_test.py", "x/conftest.py"))
    assert not any(tests.match(p) for p in ("testing/a.py", "x/test/a.py", "contest.py"))
    assert not re.match(any_regex([]), "a") and re.match(name_regex("x_*[ab]"), "x_1a")
    assert [(bool(re.match(r, "sub/x/keep.py")), n) for r, n in rules_of("sub", "*.py\n# c\n!keep.py\n")] == [(True, False), (True, True)]


def test_settings():
    c = from_toml("[tool.cinderbark]\nmin-confidence = 80\nignore_names = ['x*']\nallow = [{symbol = 'a', rule = 'unused-class'}]\nfold = {DEBUG = false}\nframeworks = 'django'\n")
    assert (c.min_confidence, c.ignore_names, c.allow[0].rule, c.fold, c.frameworks) == (80, ("x*",), "unused-class", {"DEBUG": "false"}, ("django",))
    for bad in ({"min_confidence": "x"}, {"ignore": "x"}, {"frameworks": ["rails"]}, {"allow": [{"rule": "x"}]}, {"allow": [{"symbol": "a", "rule": "zzz"}]}, {"include_tests": 1}, {"fold": []}):
        with pytest.raises(ValueError):
            from_table(bad)
    with pytest.warns(UserWarning):
        assert from_table({"unknown": 1}) == Config()


def finding(rule, line, column, symbol):
    return {"rule": rule, "line": line, "column": column, "symbol": symbol, "fingerprint": f"{rule}:{symbol}"}


@pytest.mark.parametrize(
    "source, found, want",
    [
        ("import os, sys\nsys\n", [finding("UNUSED_IMPORT", 1, 8, "os")], "import sys\nsys\n"),
        ("from a import (\n    b,\n    c,\n)\nc\n", [finding("UNUSED_IMPORT", 2, 5, "b")], "from a import c\nc\n"),
        ("def f():\n    import j\n", [finding("UNUSED_IMPORT", 2, 12, "j")], "def f():\n    pass\n"),
        ("import os; import sys\n", [finding("UNUSED_IMPORT", 1, 8, "os")], "import os; import sys\n"),
        ("def f():\n    x = 1\n    return 2\n", [finding("UNUSED_VARIABLE", 2, 5, "x")], "def f():\n    return 2\n"),
        ("def f():\n    x = g()\n    return 2\n", [finding("UNUSED_VARIABLE", 2, 5, "x")], "def f():\n    x = g()\n    return 2\n"),
        ("def f():\n    @d\n    def g():\n        return 1\n    return 2\n", [finding("UNUSED_FUNCTION", 3, 5, "g")], "def f():\n    return 2\n"),
        ("def f():\n    return 1\n    if x:\n        y()\n", [finding("UNREACHABLE_CODE", 3, 5, "if x:")], "def f():\n    return 1\n"),
        ("from a import (  # why\n    b,\n    c,\n)\nc\n", [finding("UNUSED_IMPORT", 2, 5, "b")], "from a import (  # why\n    b,\n    c,\n)\nc\n"),
        ("def (\n", [finding("UNUSED_IMPORT", 1, 1, "x")], "def (\n"),
    ],
)
def test_rewrites(source, found, want):
    assert rewrite(source, found)[0] == want


def test_sources_of_a_tree(spark, tmp_path):
    from cinderbark.sources import files

    for path, raw in {
        "a.py": b"x = 1\n", "latin.py": "# coding: latin-1\nx = 'é'\n".encode("latin-1"), "bad.py": b"\xff\xfe\xff", "build/b.py": b"", ".gitignore": b"*.gen.py\nsecret/\n!keep.gen.py\n",
        "c.gen.py": b"", "keep.gen.py": b"", "secret/d.py": b"", "requirements.txt": b"x\n", "node_modules/requirements.txt": b"y\n",
    }.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    sources, manifests = files.project_files(files.read_tree(spark, str(tmp_path), "p"), Config())
    got = {r.path: r.source for r in sources.collect()}
    assert set(got) == {"a.py", "latin.py", "bad.py", "keep.gen.py"} and "é" in got["latin.py"] and got["bad.py"] is None
    assert [r.path for r in manifests.collect()] == ["requirements.txt"]
    overlays = spark.createDataFrame([("p", "a.py", "y = 2\n"), ("p", "new.py", "z\n")], "project_id string, path string, text string")
    over = {r.path: r.source for r in files.with_overlays(sources, overlays).collect()}
    assert over["a.py"] == "y = 2\n" and over["new.py"] == "z\n"


def test_facts_are_reused_by_stamp(spark):
    from cinderbark.operators.index import index_changed

    rows = lambda *r: spark.createDataFrame(list(r), "project_id string, path string, source string, length bigint, modified string")
    first = index_changed(rows(("p", "a.py", "x = 1\n", 6, "t1"), ("p", "b.py", "y = 1\n", 6, "t1"), ("p", "c.py", "z = 1\n", 6, "t1")), None, Config()).cache()
    made = spark.sparkContext.accumulator(0)

    def counting(source, settings):
        from cinderbark.functions.extract import facts

        made.add(1)
        return facts(source, settings)

    second = index_changed(rows(("p", "a.py", "x = 1\n", 6, "t1"), ("p", "b.py", "w = 1\n", 6, "t2")), first, Config(), counting)
    assert sorted((r.path, r.bindings[0].name) for r in second.collect()) == [("a.py", "x"), ("b.py", "w")]


def test_stream_of_changes(spark, tmp_path):
    from cinderbark.streaming.incremental import CHANGES, FactStore, watch

    store, inbox = FactStore(spark, f"file://{tmp_path}/store"), f"{tmp_path}/in"
    seen = []
    for rows in ([("p", "a.py", "x = 1\n", 1), ("p", "b.py", "y = 1\n", 1)], [("p", "a.py", "x2 = 1\n", 2), ("p", "a.py", "x3 = 1\n", 3), ("p", "b.py", None, 2)]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(inbox)
        q = watch(spark.readStream.schema(CHANGES).parquet(inbox), store, Config(), f"{tmp_path}/cp", lambda facts, n: seen.append(n))
        assert q.awaitTermination(120)
    assert [(r.path, r.bindings[0].name) for r in store.read().collect()] == [("a.py", "x3")] and len(seen) == 2


def test_ignore_rules_of_one_project_leave_others_alone(spark):
    from pyspark.sql import functions as F

    from cinderbark.plans.config import Config
    from cinderbark.sources.files import project_files

    files = {
        "one": {".gitignore": "gen/\n*.tmp.py\n!keep.tmp.py\nskip/\n", "gen/a.py": "", "b.tmp.py": "", "keep.tmp.py": "", "skip/.gitignore": "!c.py\n", "skip/c.py": "", "main.py": "", "sub/.gitignore": "/d.py\n!e.tmp.py", "sub/d.py": "", "sub/x/d.py": "", "sub/e.tmp.py": "", ".git/info/exclude": "own_*.py\n", "own_x.py": "", "z.py": ""},
        "two": {"gen/a.py": "", "b.tmp.py": "", "own_x.py": "", "sub/.gitignore": "*.py", "sub/q.py": "", "z.py": ""},
    }
    rows = [(p, path, text.encode(), len(text), None) for p, tree in files.items() for path, text in tree.items()]
    table = spark.createDataFrame(rows, "project_id string, path string, content binary, length long, modified timestamp")
    kept, _ = project_files(table, Config())
    found = {(r.project_id, r.path) for r in kept.collect()}
    assert {p for k, p in found if k == "one"} == {"keep.tmp.py", "main.py", "sub/x/d.py", "sub/e.tmp.py", "z.py"}
    assert {p for k, p in found if k == "two"} == {"gen/a.py", "b.tmp.py", "own_x.py", "z.py"}
    assert kept.filter(F.col("source").isNull()).count() == 0


def test_planted_cases_are_whole():
    from cinderbark.plans.queries import CASES, ORACLE_SQL, QUERIES

    names = [c.name for found in CASES.values() for c in found]
    assert len(names) == len(set(names)) and set(names) <= set(QUERIES) and set(names) <= set(ORACLE_SQL)
    assert all(c.rows.strip() and c.source.strip() for found in CASES.values() for c in found)


def test_comment_parsers():
    from cinderbark.functions.comments import _noqa, _reason

    assert [_noqa(x) for x in ("# x", "# noqa", "# NOQA: F401", "# noqa:E1, f401 more", "# noqa something", "# noqa: not a code")] == [None, set(), {"F401"}, {"E1", "F401"}, set(), set()]
    assert [_reason(x) for x in ("", " -- why ", ' reason = "a -- b"', " reason='c'", " reason=", "reason -- d")] == [None, "why", "a -- b", "c", None, "d"]
