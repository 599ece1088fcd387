"""Selection, order, limits and counts of findings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.functions import vocabulary as V
from cinderbark.functions.comments import rule_key
from cinderbark.session import ROW_GROUPS, cut, setting

BANDS = ["100", "90-99", "70-89", "0-69"]
#: Characters of a source that are split into lines at once, and where a line ends.
PART = 1 << 18
_LINE_END = re.compile(r"\r\n|\r|\n")
_PARTS = "project_id string, at string, before int, source string"
#: The least score that makes a run fail, by level.
FAIL_ON = {"certain": 90, "likely": 70, "any": 0}


def canonical_rules(names) -> list[str]:
    out = [rule_key(n).upper() for n in names]
    if bad := [n for n, r in zip(names, out) if r not in V.RULES]:
        raise ValueError(f"unknown rule: {bad[0]}")
    return out


def applicability() -> Column:
    """Whether a rewrite may delete what a finding names: safe, unsafe or none."""
    nested, rule = F.contains("qualname", F.lit(".")), F.col("rule")
    init = F.col("path").rlike(r"(^|/)__init__\.py$")
    safe = (rule == "UNUSED_IMPORT") & (F.col("status") == "DEAD") & ~init
    full = F.col("confidence") >= 100
    safe = safe | (full & ((rule == "UNREACHABLE_CODE") | (rule.isin("UNUSED_FUNCTION", "UNUSED_VARIABLE") & nested)))
    unsafe = nested & F.col("confidence").between(90, 99) & rule.isin("UNUSED_FUNCTION", "UNUSED_VARIABLE", "UNREACHABLE_CODE")
    return F.when(safe, "safe").when(unsafe, "unsafe").otherwise("none")


def band() -> Column:
    score = F.col("confidence")
    return F.when(score == 100, "100").when(score >= 90, "90-99").when(score >= 70, "70-89").otherwise("0-69")


def chosen(found: DataFrame, select=(), ignore_rules=(), fixable_only: bool = False) -> DataFrame:
    out = found.filter(F.col("rule").isin(canonical_rules(select))) if select else found
    out = out.filter(~F.col("rule").isin(canonical_rules(ignore_rules))) if ignore_rules else out
    return out.filter(applicability() == "safe") if fixable_only else out


def order(mode: str = "path") -> list[Column]:
    keys = {
        "confidence": [F.desc("confidence"), (applicability() != "safe").asc(), "path", "line", "column", "rule", "symbol"],
        "rule": ["rule", "path", "line", "column", "symbol"],
        "path": ["path", "line", "column", "rule", "symbol"],
    }
    if mode not in keys:
        raise ValueError(f"unknown sort: {mode}")
    return keys[mode]


def present(found: DataFrame, sort: str | None = None, max_findings: int | None = None, **choice) -> tuple[DataFrame, DataFrame]:
    """(sorted and cut findings, census of all that were chosen)."""
    rows = chosen(found, **choice)
    mode = sort or ("path" if max_findings is None else "confidence")
    out = rows.orderBy(*order(mode))
    return (out if max_findings is None else out.limit(max_findings)), census(rows)


def census(found: DataFrame) -> DataFrame:
    """One row: total, by_rule, by_band, safe, unsafe."""
    level = applicability()
    by = lambda c: found.groupBy(c.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    bands = found.agg(*(F.count_if(band() == b).alias(b) for b in BANDS)).select(F.create_map(*[x for b in BANDS for x in (F.lit(b), F.col(b))]).alias("by_band"))
    total = found.agg(F.count(F.lit(1)).alias("total"), F.count_if(level == "safe").alias("safe"), F.count_if(level == "unsafe").alias("unsafe"))
    return total.crossJoin(by(F.col("rule")).withColumnRenamed("m", "by_rule")).crossJoin(bands)  # three single rows


def top_rules(found: DataFrame, n: int = 3) -> DataFrame:
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), "rule").limit(n)


def paths_only(found: DataFrame) -> DataFrame:
    return found.select("path").distinct().orderBy("path")


def fails(found: DataFrame, level: str) -> DataFrame:
    """One row: whether any finding reaches the level's score."""
    return found.agg(F.coalesce(F.max("confidence") >= FAIL_ON[level], F.lit(False)).alias("fails"))


def under(found: DataFrame, folder: str) -> DataFrame:
    """Findings at or below a path; narrow first, then cut and count."""
    folder = folder.rstrip("/")
    return found.filter((F.col("path") == folder) | F.col("path").startswith(folder + "/"))


def guidance() -> Column:
    """How far a reader may trust a finding."""
    score, path = F.col("confidence"), F.col("path")
    say = lambda text: F.concat(F.lit("confidence "), score.cast("string"), F.lit(text))
    parts = F.split(path, "/")
    settings = path.rlike(r"(settings|_settings|conf)\.py$") | F.array_contains(parts, "settings")
    return (
        F.when(F.array_contains(parts, "migrations") & (score >= 90), say(" on a migration file: verify before deleting"))
        .when(settings & (score >= 90), say(" on a settings file: verify before deleting"))
        .when(score.between(90, 99), say(": review before deleting"))
        .when(score == 100, F.lit("confidence 100: static analysis shows this is unused"))
        .otherwise(say(": static analysis cannot prove this is unused"))
    )


def _parts(batches):
    """Sources in parts of some ``PART`` characters that end with a line, with the number of lines before."""
    fields = pa.schema([("project_id", pa.string()), ("at", pa.string()), ("before", pa.int32()), ("source", pa.string())])
    rows, size = [], 0
    for b in batches:
        for k in range(b.num_rows):
            project, path, source = (b.column(n)[k].as_py() for n in ("project_id", "path", "source"))
            at = before = 0
            while at < len(source):
                end = _LINE_END.search(source, at + PART)
                part = source[at : end.end() if end else len(source)]
                rows.append((project, path, before, part))
                at, before, size = at + len(part), before + len(_LINE_END.findall(part)), size + len(part)
                if size >= PART or len(rows) >= 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def mentions(found: DataFrame, sources: DataFrame, sample: int = 5) -> DataFrame:
    """(project_id, fingerprint, mentions, sample): other lines that spell a finding's name.

    Lines are split into words once and joined on the word, so no pattern meets every line; a long source is split by
    parts, so its lines are never held at once.
    """
    name = F.when(F.col("rule") != "POSSIBLY_UNUSED_MODULE", F.col("symbol")).otherwise(F.regexp_extract("path", r"([^/]*?)(/__init__)?\.py$", 1))
    wanted = found.select("project_id", "fingerprint", "path", "line", name.alias("word")).filter(F.col("word").rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"))
    with setting(sources.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", "8m"):  # sources may be long
        parts = cut(sources.filter("source IS NOT NULL").select("project_id", "path", "source").mapInArrow(_parts, _PARTS), "parts", **ROW_GROUPS)
    lines = parts.select("project_id", "at", "before", F.posexplode(F.split("source", r"\r\n|\r|\n")).alias("n", "text")).withColumn("n", F.col("n") + F.col("before") + 1).drop("before")
    words = lines.select("project_id", "at", "n", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}_][\p{L}\p{N}_]*)"), F.lit(1)))).alias("word"))
    hits = wanted.join(words, ["project_id", "word"]).filter("NOT (at = path AND n = line)")
    shown = F.struct("at", "n", F.concat_ws(":", "at", "n", F.concat(F.lit(" "), F.trim("text"))).alias("text"))
    keys = ["project_id", "fingerprint"]
    # only the first few of each finding leave a task (a window with a limit), however often its name is spelt
    first = hits.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "n"))).filter(F.col("place") <= sample)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(shown)).alias("s"))
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("mentions"))
    out = found.select(*keys).join(counts, keys, "left").join(first, keys, "left")
    return out.select("project_id", "fingerprint", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce(F.transform("s", lambda x: x["text"]), F.array().cast("array<string>")).alias("sample"))


def located(found: DataFrame, selector: str) -> DataFrame:
    """The one finding that an id, a fingerprint, ``path:line`` or the start of an id names; else the query fails."""
    path, _, line = selector.rpartition(":")
    at = (F.col("path") == path) & (F.col("line") == int(line)) if path and line.isdigit() else F.lit(False)
    rank = F.when((F.col("id") == selector) | (F.col("fingerprint") == selector), 1).when(at, 2).when(F.col("id").startswith(selector), 3)
    best = found.withColumn("rank", rank).filter("rank IS NOT NULL")
    rows = best.agg(F.min("rank").alias("rank"), F.count_if(F.col("rank") == 1).alias("a"), F.count_if(F.col("rank") == 2).alias("b"), F.count_if(F.col("rank") == 3).alias("c")).select(
        "rank", F.when(F.col("rank").isNull(), 0).when(F.col("rank") == 1, F.col("a")).when(F.col("rank") == 2, F.col("b")).otherwise(F.col("c")).alias("n")
    )
    bad = F.when(F.col("n") == 0, F.raise_error(F.lit(f"unknown id: {selector}"))).when(F.col("n") > 1, F.raise_error(F.lit(f"ambiguous id: {selector}")))
    one = rows.select(F.coalesce(bad.cast("int"), F.col("rank")).alias("rank"))
    kept = one.join(best, "rank", "left")
    return kept.withColumn("id", F.when(F.col("rank").isNotNull(), F.col("id"))).drop("rank")  # keeps the check in the plan
