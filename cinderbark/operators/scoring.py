"""Scores as ordered column rewrites, then ids, kinds and reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.functions import vocabulary as V
from cinderbark.operators import modules
from cinderbark.operators.index import Facts, sym
from cinderbark.operators.reach import Reached
from cinderbark.operators.resolve import KEYS

R = V.REASONS
CHECKLIST = ["no_references", "no_decorators", "not_exported", "not_entry", "no_dynamic_refs"]
#: The prefix and alphabet of ids.
ID_PREFIX, ALPHABET = "VY", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def rewrite(rows: DataFrame, *steps: tuple) -> DataFrame:
    """Lower scores.  Each step is (condition, score, note, set): where it is the first that holds, the score drops to
    ``score`` (with ``set`` it becomes that), a DEAD status is lowered and a note is added once; a note may also be a
    column of evidence that replaces the old."""
    case = None
    for k, (when, *_) in enumerate(steps):
        case = F.when(when, k) if case is None else case.when(when, k)
    score, status, evidence = F.col("confidence"), F.col("status"), F.col("evidence")
    new_score, new_evidence = score, evidence
    hit = F.col("case")
    for k, (_, to, *rest) in enumerate(steps):
        note, fixed = [*rest, None, False][:2]
        to = to if isinstance(to, Column) else F.lit(to)
        new_score = F.when(hit == k, to if fixed else F.least(score, to)).otherwise(new_score)
        if note is not None:
            told = note if isinstance(note, Column) else F.array_union(evidence, F.array(F.lit(R[note])))
            new_evidence = F.when(hit == k, told).otherwise(new_evidence)
    out = rows.withColumn("case", case)
    return out.withColumns({
        "confidence": new_score.cast("int"),
        "status": F.when(hit.isNotNull() & (status == "DEAD"), "POSSIBLY_DEAD").otherwise(status),
        "evidence": new_evidence,
    })


def flag(rows: DataFrame, keys: list[str], found: DataFrame, name: str) -> DataFrame:
    marked = found.select(*keys, F.lit(True).alias("found")).distinct()
    return rows.join(marked, keys, "left").select(*rows.columns, F.coalesce("found", F.lit(False)).alias(name))


def upper_name(name: Column) -> Column:
    return name.rlike(r"\p{L}") & ~name.rlike(r"\p{Ll}") & (F.upper(name) == name)


def notes(codes: list[str]) -> Column:
    return F.array(*(F.lit(R[c]) for c in codes))


def adjust(found: DataFrame, facts: Facts) -> DataFrame:
    """What a finding's own file says: probes, dynamic code, decorators, lambdas; first match wins."""
    markers = facts.each("dynamic_markers")
    importing = markers.filter(F.col("name").isin("__import__", "import_module") | F.col("name").startswith("importlib."))
    named = markers.groupBy(*KEYS).agg(F.array_distinct(F.flatten(F.collect_list("symbols"))).alias("dynamic"))
    side = facts.each("imports").filter("imported IS NULL AND NOT wildcard AND contains(module, '.')").select(*KEYS, "line", F.col("alias").alias("symbol"))
    odd = facts.each("decorators").filter(~F.substring_index("name", ".", -1).isin(V.NEUTRAL_DECORATORS)).select(*KEYS, "qualname")
    mentioned = facts.each("lambda_mentions").select(*KEYS, F.col("value").alias("qualname"))
    probes = facts.each("import_probes").select(*KEYS, F.col("value").alias("symbol"))
    x = flag(found, ["project_id"], importing, "any_dynamic")
    x = flag(x, KEYS, importing, "file_dynamic")
    x = flag(x, [*KEYS, "symbol"], probes, "probe")
    x = flag(x, [*KEYS, "line", "symbol"], side, "side")
    x = flag(x, [*KEYS, "qualname"], odd, "odd")
    x = flag(x, [*KEYS, "qualname"], mentioned, "in_lambda")
    x = x.join(named, KEYS, "left")
    leaf = F.substring_index("qualname", ".", -1)
    hit = F.exists("dynamic", lambda d: (d == "*") | (d.endswith("*") & (F.col("symbol").startswith(F.regexp_replace(d, r"\*$", "")) | leaf.startswith(F.regexp_replace(d, r"\*$", "")))) | (d == F.col("symbol")) | (d == leaf))
    is_import, name = F.col("rule") == "UNUSED_IMPORT", F.col("rule").isin("UNUSED_FUNCTION", "UNUSED_CLASS", "UNUSED_VARIABLE", "UNUSED_IGNORE", "IGNORE_WITHOUT_REASON")
    code = F.col("rule").isin("UNUSED_FUNCTION", "UNUSED_CLASS")
    init = modules.file_name(F.col("path")) == "__init__.py"
    kept_note = F.when(F.array_contains("evidence", R["public_name"]), F.concat(notes(CHECKLIST), notes(["public_name"]))).otherwise(notes(CHECKLIST))
    dynamic = name & F.coalesce(hit, F.lit(False))
    x = rewrite(
        x,
        ((F.col("rule") == "POSSIBLY_UNUSED_MODULE") & F.col("any_dynamic"), 60, None, True),
        (is_import & F.col("probe"), 70, "import_probe", True),
        (is_import & F.col("file_dynamic"), 70, None, True),
        (is_import & F.col("side"), 70, "side_effect_import", True),
        (is_import & init, 70, "package_init", True),
        (dynamic, 70, notes(["dynamic_usage"])),
        (code & F.col("in_lambda"), 60, "lambda_only", True),
        (code & F.col("odd"), 75, notes(["no_references", "unrecognized_decorator", "not_exported", "not_entry", "no_dynamic_refs"])),
        (code & ~F.contains("qualname", F.lit(".")), 96, kept_note),
    )
    return x.withColumn("message", F.when(F.col("case") == 5, R["dynamic_usage"]).otherwise(F.col("message"))).select(found.columns)


def caps(found: DataFrame, x: Reached, boot_sources: DataFrame | None = None) -> DataFrame:
    """Caps from a finding's surroundings, in order; ``boot_sources`` (project_id, path, source) names settings modules."""
    path, symbol, rule = F.col("path"), F.col("symbol"), F.col("rule")
    out = rewrite(found, (F.contains(path, F.lit("alembic/versions/")) & symbol.isin(V.ALEMBIC_NAMES) & rule.isin(V.CAPPED_RULES), 70, "alembic_name"))
    module = found.filter("rule = 'POSSIBLY_UNUSED_MODULE'").groupBy(*KEYS).agg(F.min("confidence").alias("module_score"))
    out = out.join(module, KEYS, "left")
    high = rule.isin(V.CAPPED_RULES) & (F.col("confidence") > F.col("module_score"))
    out = rewrite(out, (high, F.col("module_score"), "module_cap"))

    parts, name = F.split("qualname", r"\."), modules.file_name(path)
    parent = F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), -2)).otherwise("")
    meta = (F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(-2)) == "Meta") & (name.isin(V.META_FILES) | (parent.isin(V.META_DIRS) & name.endswith(".py")))
    top = ~F.contains("qualname", F.lit("."))
    migration = (rule == "UNUSED_CLASS") & (symbol == "Migration") & (parent == "migrations") & (name != "__init__.py")
    settings = F.lower(F.regexp_replace(name, r"\.py$", "")).contains("settings") | ((parent == "settings") & name.endswith(".py"))
    out = flag(out, KEYS, settings_files(found, boot_sources), "named_settings") if boot_sources is not None else out.withColumn("named_settings", F.lit(False))
    configs = x.r.classes_by_base(["AppConfig"], renamed=True).select(F.col("class_sym").alias("sym"))
    out = flag(out.withColumn("sym", sym("qualname")), ["sym"], configs, "app_config").drop("sym")
    urls = (name == "urls.py") & symbol.isin(V.URL_SYMBOLS)
    sphinx = (rule == "UNUSED_FUNCTION") & (symbol == "setup") & (name == "conf.py") & F.arrays_overlap(modules.folders(path), F.array(F.lit("docs"), F.lit("doc")))
    convention = meta | (top & (migration | ((settings | F.col("named_settings")) & upper_name(symbol)) | ((name == "apps.py") & (rule == "UNUSED_CLASS") & F.col("app_config")) | urls | sphinx))
    out = rewrite(out, (convention, 60, "framework_convention"))

    misses = x.string_symbols[1].select(*KEYS, F.col("name").alias("symbol"))
    out = flag(out, [*KEYS, "symbol"], misses, "missed")
    out = rewrite(out, (F.col("missed") & rule.isin("UNUSED_CLASS", "UNUSED_FUNCTION"), 60, "string_reference"))
    swept = x.r.facts.each("module_sweeps").select(*KEYS, F.col("value").alias("name")).join(x.r.symbols.filter("kind = 'import' AND scope_kind = 'module'").select(*KEYS, "name", "sym"), [*KEYS, "name"])
    swept = swept.select("sym").join(x.r.import_modules, "sym").select("project_id", F.col("module").alias("target")).join(x.r.module_files, ["project_id", "target"])
    out = flag(out, KEYS, swept.select("project_id", F.col("target_path").alias("path")), "swept")
    return rewrite(out, (F.col("swept") & top & upper_name(symbol) & rule.isin("UNUSED_VARIABLE", "UNUSED_CLASS", "UNUSED_FUNCTION"), 70, "settings_sweep")).select(found.columns)


def settings_files(found: DataFrame, boot_sources: DataFrame) -> DataFrame:
    """Files that a boot file names as the settings module."""
    pattern = r"""DJANGO_SETTINGS_MODULE["'](?:\s*\]\s*=\s*["']|\s*,\s*["'])([A-Za-z_][\w.]*)"""
    boots = boot_sources.filter(modules.file_name(F.col("path")).isin(V.BOOT_FILES))
    named = boots.select("project_id", F.explode(F.expr("regexp_extract_all(source, '%s', 1)" % pattern.replace("\\", "\\\\").replace("'", "\\'"))).alias("module")).distinct()
    base = F.replace("module", F.lit("."), F.lit("/"))
    files = named.select("project_id", F.contains("module", F.lit(".")).alias("deep"), F.explode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("file"))
    paths = found.select(*KEYS).distinct()
    both = paths.join(files, "project_id")
    return both.filter((F.col("path") == F.col("file")) | (F.col("path") == F.concat(F.lit("src/"), "file")) | (F.col("deep") & F.col("path").endswith(F.concat(F.lit("/"), "file")))).select(*KEYS)


def soften_for_errors(found: DataFrame, facts: Facts) -> DataFrame:
    """A claim drops to 70 where a file that failed to parse mentions the name it rests on, or could not be read."""
    broken = facts.table.filter("error IS NOT NULL").filter(~modules.is_test(F.col("path")))
    unread = broken.filter("words IS NULL").select("project_id")
    words = broken.select("project_id", F.explode("words").alias("word")).distinct()
    sensitive = ["UNUSED_FUNCTION", "UNUSED_CLASS", "ORPHAN_FUNCTION", "POSSIBLY_UNUSED_MODULE", "UNUSED_DEPENDENCY", "UNUSED_VARIABLE"]
    low, rule = F.lower("symbol"), F.col("rule")
    stem = F.filter(F.split(F.lower(F.regexp_replace("path", r"\.[^./]*$", "")), "/"), lambda p: p != "__init__")
    package = F.concat(F.array(low, F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("-"), F.lit(""))), F.filter(F.split(low, "-"), lambda p: F.length(p) > 2))
    wanted = F.when(rule == "UNUSED_DEPENDENCY", package).when(rule == "POSSIBLY_UNUSED_MODULE", stem).otherwise(F.array(low))
    mentions = found.select(*KEYS, "rule", "qualname", F.explode(wanted).alias("word")).join(words, ["project_id", "word"], "left_semi")
    local = facts.each("bindings").filter("scope_kind = 'function'").select(*KEYS, "qualname")
    out = flag(found, ["project_id"], unread, "unread")
    out = flag(out, [*KEYS, "rule", "qualname"], mentions, "mentioned")
    out = flag(out, [*KEYS, "qualname"], local, "is_local")
    hit = rule.isin(sensitive) & (F.col("confidence") > 70) & ~F.col("is_local") & (F.col("unread") | F.col("mentioned"))
    return rewrite(out, (hit, 70, "parse_error_nearby")).select(found.columns)


def fingerprint() -> Column:
    return F.concat_ws(":", "rule", "path", "qualname")


def id_of(text: Column, length: int = 8) -> Column:
    """The prefix and the first ``length`` base-32 digits of the SHA-1."""
    digest = F.sha1(text)
    out = F.lit(ID_PREFIX)
    for start in range(0, length, 8):
        number = F.conv(F.substring(digest, 1 + start // 8 * 10, 10), 16, 10).cast("long")
        digits = [F.substring(F.lit(ALPHABET), (F.shiftright(number, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(min(8, length - start))]
        out = F.concat(out, *digits)
    return out


def identify(found: DataFrame) -> DataFrame:
    """Findings with fingerprint, kind, reason codes and id; ids that collide within a project are longer."""
    out = found.withColumn("fingerprint", fingerprint())
    kinds = F.create_map(*[F.lit(v) for kv in V.RULES.items() for v in kv])
    codes = F.create_map(*[F.lit(v) for code, text in V.REASONS.items() for v in (text, code)])
    code = lambda e: F.coalesce(
        F.try_element_at(codes, e),
        F.when(e.startswith("Imported as "), "import_alias")
        .when(e.startswith("Function ") & e.contains(" duplicates "), "duplicate_body")
        .when(e.startswith("Declared in ") & e.contains("development or docs"), "dev_dependency")
        .when(e.startswith("Declared in ") & e.endswith("never imported."), "declared_unused"),
    )
    out = out.withColumn("kind", kinds[F.col("rule")]).withColumn("reasons", F.array_distinct(F.array_compact(F.transform("evidence", code))))
    short = id_of(F.col("fingerprint"))
    twins = F.count(F.lit(1)).over(Window.partitionBy("project_id", short))
    return out.withColumn("id", F.when(twins > 1, id_of(F.col("fingerprint"), 12)).otherwise(short))
