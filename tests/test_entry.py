"""The driver's contract."""

import importlib
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_and_keys(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "confidence" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folders(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("cinderbark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "cinderbark.llm", None)
    importlib.reload(entry)
    assert "r01_unused_import" in entry.queries() and not any(k.startswith("op") for k in entry.queries())


def test_other_failed_imports_are_raised(monkeypatch, tmp_path):
    (tmp_path / "broken_part.py").write_text("import surely_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._optional("no_package.part") is None and entry._optional("cinderbark.no_part") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_part")


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "orders", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("r01_unused_import", "r05_unreachable_code", "r09_duplicate_code", "a01_census", "o02_first_findings"):
        got, want = entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])
        columns = sorted(got.columns)
        want = want.df()
        assert columns == sorted(want.columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want[columns].itertuples(index=False, name=None))), name
