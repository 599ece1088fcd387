"""Suppression: path and name globs, allow rules, comment directives, and what they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.functions.comments import rule_key
from cinderbark.functions.globs import any_regex, name_regex
from cinderbark.functions.vocabulary import REASONS as R
from cinderbark.operators import modules
from cinderbark.operators.index import Facts
from cinderbark.operators.resolve import KEYS
from cinderbark.operators.rules import finding
from cinderbark.plans.config import Config


def without_tests(found: DataFrame, config: Config) -> DataFrame:
    return found if config.include_tests else found.filter(~modules.is_test(F.col("path")))


def by_settings(found: DataFrame, config: Config) -> DataFrame:
    """Without findings that a path glob, a name glob or an allow rule covers."""
    out = found.filter(~F.col("path").rlike(any_regex(config.ignore))) if config.ignore else found
    for glob in config.ignore_names:
        out = out.filter(~F.col("symbol").rlike(name_regex(glob)))
    for allow in config.allow:
        named = F.col("symbol").rlike(name_regex(allow.symbol)) | F.col("qualname").rlike(name_regex(allow.symbol))
        ruled = F.lower("rule") == rule_key(allow.rule) if allow.rule else F.lit(True)
        out = out.filter(~(named & ruled))
    return out


def by_comments(found: DataFrame, facts: Facts, config: Config) -> DataFrame:
    """Without findings that a directive covers, with findings about the directives themselves.

    A trailing comment covers its own line, a comment on a line of its own also the
    next; of several the first in the file counts.
    """
    d = facts.each("ignores").withColumn("origin", F.when(F.col("origin") > 0, F.col("origin")).otherwise(F.col("line")))
    needs = F.col("reportable") & (F.coalesce(F.trim("reason"), F.lit("")) == "") & F.lit(config.require_ignore_reason)
    d = d.withColumn("bare", needs)
    covers = d.select(*KEYS, "rules", "origin", "bare", "ord", F.explode(F.when(F.col("exact"), F.array("line")).otherwise(F.array("line", F.col("line") + 1))).alias("line"))
    keys = [*KEYS, "line", "rule", "qualname"]
    hit = found.select(*keys).distinct().join(covers, [*KEYS, "line"]).filter(F.col("rules").isNull() | F.array_contains("rules", F.lower("rule")))
    first = hit.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).filter("rn = 1")
    done = first.filter("NOT bare")
    kept = found.join(done.select(*keys), keys, "left_anti")
    own = d.filter("reportable AND line = origin").dropDuplicates([*KEYS, "origin"])
    symbol = F.when(F.col("rules").isNull() | (F.size("rules") == 0), "*").otherwise(F.array_join("rules", ","))
    row = lambda rows, rule, message, code: finding(rows, rule, "DEAD", 100, message, [R[code]], symbol=symbol, qualname=F.col("line").cast("string"), column=1)
    out = kept.unionByName(row(own.filter("bare"), "IGNORE_WITHOUT_REASON", "Ignore directive has no reason.", "ignore_without_reason"))
    if config.report_unused_ignores:
        idle = own.filter("NOT bare").join(done.select(*KEYS, "origin").distinct(), [*KEYS, "origin"], "left_anti")
        out = out.unionByName(row(idle, "UNUSED_IGNORE", "Ignore directive suppressed nothing.", "unused_ignore"))
    return out


def by_baseline(found: DataFrame, baseline: DataFrame | None, mode: str = "new") -> DataFrame:
    """``new``: without findings whose fingerprint the baseline lists; ``all``: with ``baselined`` set."""
    if baseline is None:
        return found.withColumn("baselined", F.lit(False))
    known = baseline.select("fingerprint").distinct()
    if mode == "new":
        return found.join(known, "fingerprint", "left_anti").withColumn("baselined", F.lit(False))
    return found.join(known.withColumn("known", F.lit(True)), "fingerprint", "left").withColumn("baselined", F.coalesce("known", F.lit(False))).drop("known")
