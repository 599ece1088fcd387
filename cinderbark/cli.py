"""Command line: scan, fix, baseline, explain and rules over a folder of Python files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cinderbark.functions.vocabulary import RULES
from cinderbark.operators import fixes, present
from cinderbark.plans.config import Config, from_toml
from cinderbark.plans.scan import Scan
from cinderbark.sources import files, reports

FORMATS = {"text": reports.plain, "concise": reports.concise, "github": reports.github, "jsonl": reports.jsonl}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cinderbark", description=__doc__)
    p.add_argument("command", choices=["scan", "fix", "baseline", "explain", "rules"])
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("selector", nargs="?")
    p.add_argument("--config", help="a TOML file with a [tool.cinderbark] table")
    p.add_argument("--format", choices=[*FORMATS, "json", "sarif"], default="text")
    p.add_argument("--min-confidence", type=int)
    p.add_argument("--max-findings", type=int)
    p.add_argument("--sort", choices=["path", "confidence", "rule"])
    p.add_argument("--select", action="append", default=[])
    p.add_argument("--ignore-rule", action="append", default=[])
    p.add_argument("--fixable-only", action="store_true")
    p.add_argument("--under", default="")
    p.add_argument("--baseline")
    p.add_argument("--output")
    p.add_argument("--fail-on", choices=list(present.FAIL_ON))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cinderbark").getOrCreate()
    if a.command == "rules":
        spark.createDataFrame(list(RULES.items()), "rule string, kind string").show(50, False)
        return 0
    config = from_toml(open(a.config, encoding="utf-8").read()) if a.config else Config()
    sources, manifests = files.project_files(files.read_tree(spark, a.root), config)
    scan = Scan(sources, config, manifests)
    known = reports.read_baseline(spark, a.baseline) if a.baseline else None
    found = scan.report(known, min_confidence=a.min_confidence)
    found = present.under(found, a.under) if a.under else found
    if a.command == "explain":
        one = present.located(found, a.selector)
        one.select("*", present.guidance().alias("guidance"), present.applicability().alias("fix")).show(1, False, True)
        return 0
    if a.command == "fix":
        for r in fixes.fixes(found, sources).orderBy("path").select("diff").toLocalIterator():
            sys.stdout.write(r["diff"])
        return 0
    if a.command == "baseline":
        text = reports.baseline_document(reports.entries(found))
        reports.write_text(text, a.output) if a.output else print(text.first()["text"])
        return 0
    rows, _ = present.present(found, a.sort, a.max_findings, select=a.select, ignore_rules=a.ignore_rule, fixable_only=a.fixable_only)
    if a.format == "json":
        out = reports.report(rows, scan.errors, scan.facts.table.filter("piece = 0").count())
    elif a.format == "sarif":
        out = reports.sarif(rows).select("text")
    else:
        out = FORMATS[a.format](rows)
    if a.output:
        reports.write_text(out, a.output)
    else:
        for r in out.select(F.col("text")).toLocalIterator():
            print(r["text"] + ("\n" if a.format == "text" else ""))
    return int(bool(a.fail_on) and present.fails(rows, a.fail_on).first()["fails"])


if __name__ == "__main__":
    sys.exit(main())
