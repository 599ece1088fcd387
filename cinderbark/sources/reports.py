"""Sinks: six report formats as text columns, the baseline, and their writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderbark.functions.vocabulary import REASONS
from cinderbark.operators.present import applicability, census, order

# What each rule's finding is called in text reports.
LABELS = {
    "UNUSED_IMPORT": "Import",
    "UNUSED_FUNCTION": "Function",
    "UNUSED_CLASS": "Class",
    "UNUSED_VARIABLE": "Variable",
    "UNREACHABLE_CODE": "Statement",
    "POSSIBLY_UNUSED_MODULE": "Module",
    "WILDCARD_IMPORT": "Import",
    "ORPHAN_FUNCTION": "Function",
    "UNUSED_DEPENDENCY": "Package",
    "DUPLICATE_CODE": "Function",
}
WITH_REASON = "UNREACHABLE_CODE POSSIBLY_UNUSED_MODULE WILDCARD_IMPORT ORPHAN_FUNCTION UNUSED_DEPENDENCY DUPLICATE_CODE".split()
BRIEF = [REASONS[k] for k in ("no_references", "no_decorators", "not_exported", "not_entry", "no_dynamic_refs")]
# Rule descriptions of SARIF reports.
RULE_TEXT = {
    "UNUSED_IMPORT": "An imported name is never used.",
    "UNUSED_FUNCTION": "A function or method is never used.",
    "UNUSED_CLASS": "A class is never used.",
    "UNUSED_VARIABLE": "A variable is never used.",
    "UNREACHABLE_CODE": "A statement never runs.",
    "POSSIBLY_UNUSED_MODULE": "No entry point imports this module.",
    "WILDCARD_IMPORT": "A wildcard import limits analysis.",
    "ORPHAN_FUNCTION": "A function is referenced, but no entry point reaches it.",
    "UNUSED_DEPENDENCY": "A declared package is never imported.",
    "DUPLICATE_CODE": "A function body duplicates an earlier function.",
}


def escaped(text: Column, prop: bool) -> Column:
    for a, b in [("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *([(":", "%3A"), (",", "%2C")] if prop else [])]:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def evidence(brief: bool) -> Column:
    return F.array_except("evidence", F.array(*map(F.lit, BRIEF))) if brief else F.col("evidence")


def concise(found: DataFrame, confidence: bool = False) -> DataFrame:
    line = F.concat_ws(":", "path", "line", "column", F.concat_ws(" ", F.lit(""), "rule", "message"))
    return found.select("*", (F.concat(line, F.lit(" ["), "confidence", F.lit("]")) if confidence else line).alias("text"))


def github(found: DataFrame, prefix: str = "") -> DataFrame:
    level = F.when(F.col("confidence") >= 90, "error").otherwise("warning")
    path = escaped(F.concat(F.lit(prefix), "path"), True)
    return found.select("*", F.concat(F.lit("::"), level, F.lit(" file="), path, F.lit(",line="), "line", F.lit(",title="), escaped(F.col("rule"), True), F.lit("::"), escaped(F.col("message"), False)).alias("text"))


def plain(found: DataFrame, brief: bool = False) -> DataFrame:
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv]), F.col("rule")), F.lit("Symbol"))
    reason = F.when(F.col("rule").isin(WITH_REASON) & (F.col("message") != ""), F.concat(F.lit("Reason: "), "message"))
    lines = F.array(F.col("rule"), F.concat(F.lit("File: "), "path"), F.concat(F.lit("Line: "), "line"), F.concat(label, F.lit(": "), "symbol"), F.concat(F.lit("Confidence: "), "confidence", F.lit("%")), reason)
    proofs = F.transform(evidence(brief), lambda e: F.concat(F.lit("Evidence: "), e))
    return found.select("*", F.array_join(F.concat(F.array_compact(lines), proofs), "\n").alias("text"))


def row_struct(brief: bool, jsonl: bool) -> Column:
    level = applicability()
    fields = ["id", "fingerprint", "rule", "path", "line", "column", "symbol", "status", "confidence", "message", "reasons"]
    fix = F.struct(level.alias("applicability"))
    if jsonl:
        return F.struct(*fields, evidence(brief).alias("evidence"), F.when(level != "none", fix).alias("fix"), F.when(F.array_contains("reasons", "no_dist_metadata"), True).alias("env_sensitive"))
    fields[3:3], fields[9:9] = ["kind"], ["qualname"]
    return F.struct(*fields, evidence(brief).alias("evidence"), fix.alias("fix"), "baselined", F.when(F.array_contains("reasons", "no_dist_metadata"), True).alias("env_sensitive"))


def jsonl(found: DataFrame, brief: bool = True) -> DataFrame:
    return found.select("*", F.to_json(row_struct(brief, True)).alias("text"))


def summary(found: DataFrame, shown: int | None = None) -> DataFrame:
    """One row ``text``: the summary line of a JSON-lines report."""
    c = census(found)
    count = F.col("total") if shown is None else F.least("total", F.lit(shown))
    fixable = F.struct("safe", "unsafe").alias("fixable")
    return c.select(F.to_json(F.struct(F.lit("summary").alias("type"), "total", count.alias("shown"), (count < F.col("total")).alias("truncated"), "by_rule", "by_band", fixable)).alias("text"))


def _in_order(value: Column) -> Column:
    """An aggregate: values by column ``place``, whatever order partial results come in."""
    return F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("value")))), lambda x: x["value"])


def report(found: DataFrame, errors: DataFrame, files_scanned: int, sort: str = "path", shown: int | None = None) -> DataFrame:
    """One row ``text``: the whole report as one JSON document; for reports that a reader can hold."""
    rows = found if shown is None else found.orderBy(*order(sort)).limit(shown)
    body = rows.withColumn("place", F.row_number().over(Window.orderBy(*order(sort)))).agg(_in_order(row_struct(False, False)).alias("findings"))
    bad = errors.agg(F.collect_list(F.struct("path", "line", "column", "message")).alias("errors"))
    c = census(found).select(F.struct("total", F.lit(shown).alias("limit"), "by_rule", "by_band", F.struct("safe", "unsafe").alias("fixable")).alias("summary"))
    one = c.crossJoin(body).crossJoin(bad)  # three single rows
    return one.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(files_scanned).alias("files_scanned"), "summary", "findings", "errors")).alias("text"))


def utf16_column(line: Column, column: Column) -> Column:
    """The UTF-16 column of a UTF-8 byte column in a line; both count from one."""
    head = F.expr("cast(substring(cast(text_line as binary), 1, text_column - 1) as string)")
    units = F.octet_length(F.encode(head, "UTF-16LE")) / 2 + 1
    return F.when(column <= 1, F.greatest(column, F.lit(1))).otherwise(units.cast("int"))


def with_utf16(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings with ``utf16``, their column in UTF-16 units."""
    lines = sources.select("project_id", "path", F.split("source", r"\r\n|\r|\n").alias("lines"))
    rows = found.join(lines, ["project_id", "path"], "left").withColumn("text_line", F.get("lines", F.col("line") - 1)).withColumn("text_column", F.col("column"))
    return rows.withColumn("utf16", F.coalesce(utf16_column(F.col("text_line"), F.col("column")), F.col("column"))).drop("lines", "text_line", "text_column")


def sarif(found: DataFrame, tool: str = "cinderbark") -> DataFrame:
    """(project_id, text): a SARIF 2.1.0 log for each project that has findings."""
    place = F.struct(
        F.struct(
            F.struct(F.col("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine"), (F.col("utf16") if "utf16" in found.columns else F.col("column")).alias("startColumn")).alias("region"),
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule").alias("ruleId"),
        F.when(F.col("confidence") >= 90, "error").otherwise("warning").alias("level"),
        F.col("confidence").alias("rank"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.struct(F.col("fingerprint").alias("fingerprint")).alias("partialFingerprints"),
        F.struct("confidence", "reasons", "evidence").alias("properties"),
        F.array(place).alias("locations"),
    )
    text = F.create_map(*[F.lit(v) for kv in RULE_TEXT.items() for v in kv])
    rules = F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.struct(r.alias("id"), F.struct(r.alias("text")).alias("shortDescription"), F.struct(F.coalesce(F.try_element_at(text, r), r).alias("text")).alias("fullDescription")))
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(*order("path"))))
    run = placed.groupBy("project_id").agg(rules.alias("rules"), _in_order(result).alias("results"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver"))
    return run.select("project_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(F.struct(driver.alias("tool"), "results")).alias("runs"))).alias("text"))


# --- baseline -------------------------------------------------------------------

ENTRY = "fingerprint string, id string, rule string, path string, symbol string, reason string, added string"
_COLUMNS = [x.split(" ")[0] for x in ENTRY.split(", ")]


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline of either version, or of plain fingerprints; anything else is an error."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    data = json.loads(text)
    rows = data.get("findings") if isinstance(data, dict) else None
    if not isinstance(rows, list):
        raise ValueError(f"baseline must contain a findings list: {path}")
    out = []
    for r in rows:
        if isinstance(r, str):
            r = {"fingerprint": r}
        if not isinstance(r, dict) or not isinstance(r.get("fingerprint"), str):
            raise ValueError(f"baseline finding is missing a fingerprint: {path}")
        out.append(tuple(r[c] if isinstance(r.get(c), str) else "" for c in _COLUMNS))
    return spark.createDataFrame(out, ENTRY)


def entries(found: DataFrame, reason: str = "") -> DataFrame:
    return found.select("fingerprint", "id", "rule", "path", "symbol", F.lit(reason).alias("reason"), F.current_date().cast("string").alias("added"))


def appended(baseline: DataFrame, found: DataFrame, reason: str) -> DataFrame:
    """The baseline and the findings that it does not list; a second time adds nothing."""
    new = entries(found, reason).dropDuplicates(["fingerprint"]).join(baseline.select("fingerprint"), "fingerprint", "left_anti")
    return baseline.select(*_COLUMNS).unionByName(new.select(*_COLUMNS)).orderBy("fingerprint")


def pruned(baseline: DataFrame, found: DataFrame) -> DataFrame:
    """The entries that the scan still reports."""
    return baseline.join(found.select("fingerprint").distinct(), "fingerprint", "left_semi").orderBy("fingerprint")


def baseline_document(baseline: DataFrame) -> DataFrame:
    """One row ``text``: the baseline file, sorted by fingerprint."""
    rows = F.array_sort(F.collect_list(F.struct(*_COLUMNS)))
    return baseline.agg(rows.alias("findings")).select(F.to_json(F.struct(F.lit(2).alias("version"), "findings")).alias("text"))


def write_text(rows: DataFrame, path: str) -> None:
    """Write the column ``text``, one row a line, in the order of the rows."""
    rows.select(F.col("text").alias("value")).write.mode("overwrite").text(path)
