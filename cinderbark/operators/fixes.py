"""Fixes as a table: rewritten sources, diffs and edits of the files that safe findings name."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cinderbark.functions.rewrite import rewrite, statement_end, unified
from cinderbark.operators.present import applicability

FIX = """project_id string, path string, new_source string, diff string, applied array<string>, skipped array<string>,
edits array<struct<first:int,last:int,content:string>>"""
END = "project_id string, fingerprint string, end_line int, end_column int"
_FINDING = ["rule", "line", "column", "symbol", "fingerprint"]


def _by_file(found: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per file with findings: its source and a list of them; a file bounds the list."""
    lists = found.groupBy("project_id", "path").agg(F.array_sort(F.collect_list(F.struct("line", "column", "rule", "symbol", "fingerprint"))).alias("found"))
    return lists.join(sources.select("project_id", "path", "source"), ["project_id", "path"])


def _mapped(rows: DataFrame, schema: str, one) -> DataFrame:
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([x for r in b.to_pylist() for x in one(r)], schema=arrow)

    return rows.mapInArrow(run, schema)


def fixes(found: DataFrame, sources: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """Rewrites for safe findings.  Lines that ``dirty`` (project_id, path, line) names are left alone."""
    rows = _by_file(found.filter(applicability() == "safe"), sources)
    if dirty is None:
        rows = rows.withColumn("dirty", F.array().cast("array<int>"))
    else:
        lines = dirty.groupBy("project_id", "path").agg(F.collect_set(F.col("line").cast("int")).alias("dirty"))
        rows = rows.join(lines, ["project_id", "path"], "left")

    def one(r):
        new, applied, edits = rewrite(r["source"], r["found"], set(r["dirty"] or ()))
        skipped = [f["fingerprint"] for f in r["found"] if f["fingerprint"] not in applied]
        yield {
            "project_id": r["project_id"], "path": r["path"], "new_source": new, "diff": unified(r["path"], r["source"], new), "applied": applied, "skipped": skipped,
            "edits": [{"first": a, "last": b, "content": c} for a, b, c in edits],
        }

    return _mapped(rows, FIX, one)


def applied_sources(sources: DataFrame, fixed: DataFrame) -> DataFrame:
    """The sources after the fixes, for a scan that verifies them."""
    new = fixed.select("project_id", "path", "new_source")
    return sources.select("project_id", "path", "source").join(new, ["project_id", "path"], "left").select("project_id", "path", F.coalesce("new_source", "source").alias("source"))


def ends(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Where the statement of each finding ends; only reported files are parsed."""

    def one(r):
        try:
            tree = ast.parse(r["source"] or "")
        except SyntaxError:
            tree = ast.parse("")
        for f in r["found"]:
            line, column = statement_end(tree, f["line"], f["symbol"])
            yield {"project_id": r["project_id"], "fingerprint": f["fingerprint"], "end_line": line, "end_column": column}

    return _mapped(_by_file(found, sources), END, one)


def evaluate(found: DataFrame, live: DataFrame, least: int = 90) -> DataFrame:
    """One row: deletions a caller would make at ``least``, and how many of them hit names that ``live`` (project_id, path, qualname) needs."""
    claims = found.filter(F.col("confidence") >= least)
    wrong = claims.join(live.select("project_id", "path", "qualname").distinct().withColumn("needed", F.lit(True)), ["project_id", "path", "qualname"], "left")
    return wrong.agg(F.count(F.lit(1)).alias("claimed"), F.count_if(F.col("needed")).alias("wrong"))
