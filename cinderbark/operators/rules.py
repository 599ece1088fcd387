"""Rules: each returns findings (project_id, rule, path, line, column, symbol, qualname, status, confidence, message, evidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.functions import vocabulary as V
from cinderbark.operators import modules
from cinderbark.operators.index import Facts, sym
from cinderbark.operators.reach import Reached
from cinderbark.operators.resolve import KEYS
from cinderbark.session import cut

R = V.REASONS


def text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(rows: DataFrame, rule, status, confidence, message, evidence: list, symbol=None, qualname=None, line=None, column=None) -> DataFrame:
    """Rows in the shape of findings; columns of the same names are taken where nothing else is given."""
    return rows.select(
        "project_id",
        text(rule).alias("rule"),
        "path",
        (F.col("line") if line is None else text(line)).cast("int").alias("line"),
        (F.col("column") if column is None else text(column)).cast("int").alias("column"),
        (F.col("symbol") if symbol is None else text(symbol)).alias("symbol"),
        (F.col("qualname") if qualname is None else text(qualname)).cast("string").alias("qualname"),
        text(status).alias("status"),
        text(confidence).cast("int").alias("confidence"),
        text(message).alias("message"),
        (evidence if isinstance(evidence, Column) else F.array(*map(text, evidence))).alias("evidence"),
    )


def silent(name: Column) -> Column:
    """Names that are unused on purpose: ``_`` and dunders."""
    return (name == "_") | ((F.length(name) >= 5) & name.startswith("__") & name.endswith("__"))


def private(name: Column) -> Column:
    return name.startswith("_")


def unused_names(x: Reached) -> DataFrame:
    """Imports, functions, classes and variables that nothing uses."""
    b = x.r.bindings.filter("read_count = 0 AND NOT exported AND kind <> 'parameter'")
    b = b.filter("(kind = 'import') OR (NOT typing_only AND scope_kind <> 'class')").filter(~silent(F.col("name")))
    by_design = (F.col("kind") == "variable") & ((F.col("origin") != "") | (private(F.col("name")) & ~F.col("scope_kind").isin("module", "class")))
    b = b.filter(~by_design).join(x.referenced, "sym", "left_anti").join(x.reached[0], "sym", "left_anti")
    b = x.covered(b)
    rule = F.create_map(*[F.lit(v) for kv in V.KIND_RULES.items() for v in kv])[F.col("kind")]
    label = F.initcap("kind")
    public = F.col("kind").isin("function", "class", "variable") & ~F.contains("qualname", F.lit(".")) & ~private(F.col("name"))
    maybe = public & F.col("covered")
    score = F.when(maybe, 60).when(public & (F.col("kind") == "variable"), 96).otherwise(100)
    evidence = F.when(maybe, F.array(F.lit(R["no_references"]), F.lit(R["public_name"]))).otherwise(F.array(F.lit(R["no_references"])))
    return finding(b, rule, F.when(score < 100, "POSSIBLY_DEAD").otherwise("DEAD"), score, F.format_string("%s '%s' is never used.", label, "name"), evidence, symbol=F.col("name"))


def orphans(x: Reached) -> DataFrame:
    """Functions that are referenced but that nothing reaches, and methods that nothing uses."""
    reached, names = x.reached
    b = x.r.bindings.filter("kind = 'function' AND scope_kind IN ('module', 'class')").filter(~silent(F.col("name")))
    abstract = x.r.facts.each("abstract").select(sym("value").alias("sym"))
    for gone in (abstract, x.entry_symbols.select("sym"), reached, x.used_imports[1]):
        b = b.join(gone, "sym", "left_anti")
    said = lambda d, c: d.select("sym", F.lit(True).alias(c)).distinct()
    b = b.join(said(x.referenced, "referenced"), "sym", "left")
    b = b.join(names.select("project_id", "name", F.lit(True).alias("loaded")).distinct(), ["project_id", "name"], "left")
    b = cut(b.withColumn("seen", (F.col("read_count") > 0) | F.coalesce("referenced", F.lit(False))).withColumn("loaded", F.coalesce("loaded", F.lit(False))), "orphans")
    note = F.when(F.col("loaded"), F.array(F.lit(R["no_entry_reaches"]), F.lit(R["unresolved_attr_call"]))).otherwise(F.array(F.lit(R["no_entry_reaches"])))
    score = F.when(F.col("loaded"), 60).otherwise(80)
    orphan = lambda rows: finding(rows, "ORPHAN_FUNCTION", "POSSIBLY_DEAD", score, R["no_entry_reaches"], note, symbol=F.col("name"))
    top = orphan(b.filter("scope_kind = 'module' AND NOT exported AND seen"))

    properties = x.r.facts.each("decorators").filter(F.substring_index("name", ".", -1).isin(V.PROPERTY_DECORATORS)).select(sym("qualname").alias("sym"))
    m = b.filter("scope_kind = 'class'").join(properties, "sym", "left_anti").withColumn("class_sym", F.regexp_replace("sym", r"\.[^.\x1f]*$", ""))
    m = x.covered(m.join(used_classes(x), "class_sym", "left_semi").join(outside(x), "class_sym", "left"))
    near = orphan(m.filter("loaded OR seen"))
    never = m.filter("NOT loaded AND NOT seen")
    api = ~private(F.col("name")) & F.col("covered")
    score = F.when(F.col("outside") | api, 60).otherwise(96)
    evidence = F.when(F.col("outside"), F.array(F.lit(R["no_references"]), F.lit(R["may_override_external"]))).when(api, F.array(F.lit(R["no_references"]), F.lit(R["public_name"]))).otherwise(F.array(F.lit(R["no_references"])))
    methods = finding(never, "UNUSED_FUNCTION", "POSSIBLY_DEAD", score, F.format_string("Method '%s' is never used.", "name"), evidence, symbol=F.col("name"))
    return top.unionByName(near).unionByName(methods)


def used_classes(x: Reached) -> DataFrame:
    """(class_sym): classes that are read, exported, referenced or reached."""
    own = x.r.bindings.filter("kind = 'class' AND (read_count > 0 OR exported)").select("sym")
    return own.unionByName(x.referenced).unionByName(x.reached[0]).distinct().select(F.col("sym").alias("class_sym"))


def outside(x: Reached) -> DataFrame:
    return x.r.outside_bases.select("class_sym", F.lit(True).alias("outside"))


def unused_attributes(x: Reached, conventions: bool = False) -> DataFrame:
    """Class attributes that nothing loads; fields of declarative, enum and data classes are exempt."""
    reached, names = x.reached
    b = x.r.bindings.filter("kind = 'variable' AND scope_kind = 'class'").filter(~silent(F.col("name"))).withColumn("class_sym", F.regexp_replace("sym", r"\.[^.\x1f]*$", ""))
    fields = x.r.facts.each("decorators").filter(F.substring_index("name", ".", -1).isin(V.FIELD_DECORATORS) | F.col("name").isin(V.FIELD_NAMES)).select(sym("qualname").alias("ancestor"))
    named = x.r.bases.filter(F.col("leaf").isin(V.NAMED_FIELD_BASES)).select(F.col("class_sym").alias("ancestor"))
    exempt = x.r.ancestors.join(fields.unionByName(named).distinct(), "ancestor", "left_semi").select("class_sym")
    exempt = exempt.unionByName(x.r.classes_by_base(V.DECLARATIVE_BASES)).unionByName(x.r.classes_by_base(V.ENUM_BASES)).distinct()
    classes = used_classes(x)
    meta = x.r.symbols.filter(F.col("name") == "Meta").filter("kind = 'class'").select(F.col("sym").alias("class_sym"), F.lit(True).alias("meta"))
    b = b.join(exempt, "class_sym", "left_anti").join(meta if conventions else meta.filter("false"), "class_sym", "left").join(classes.withColumn("used", F.lit(True)), "class_sym", "left")
    b = b.filter("used OR meta").join(reached, "sym", "left_anti").join(x.referenced, "sym", "left_anti").filter("read_count = 0")
    owners = x.r.methods.join(classes, "class_sym", "left_semi").withColumn("project_id", F.split("class_sym", "\x1f")[0]).groupBy("project_id", F.col("attr").alias("name")).agg(F.count_distinct("class_sym").alias("owners"))
    b = b.join(names.withColumn("loaded", F.lit(True)), ["project_id", "name"], "left").join(owners, ["project_id", "name"], "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))
    b = x.covered(b.filter("NOT (loaded AND owners = 1 AND meta IS NULL)").join(outside(x), "class_sym", "left"))
    one = lambda *codes: F.array(*(F.lit(R[c]) for c in codes))
    score = F.when(F.col("loaded"), 60).when(private(F.col("name")), 96).when(F.col("outside") | F.col("covered"), 60).otherwise(96)
    evidence = F.when(F.col("loaded"), one("unresolved_attr_call")).when(private(F.col("name")), one("no_references")).when(F.col("outside"), one("no_references", "may_override_external")).when(F.col("covered"), one("no_references", "public_name")).otherwise(one("no_references"))
    return finding(b, "UNUSED_VARIABLE", "POSSIBLY_DEAD", score, F.format_string("Variable '%s' is never used.", "name"), evidence, symbol=F.col("name"))


def unreachable_code(facts: Facts) -> DataFrame:
    """Statements that control never reaches; equal ones in a scope are numbered."""
    spans = facts.each("unreachable")
    w = Window.partitionBy(*KEYS, "scope", "symbol").orderBy("ord")
    spans = spans.withColumn("n", F.row_number().over(w))
    base = F.concat_ws(":", "scope", "symbol")
    return finding(spans, "UNREACHABLE_CODE", "DEAD", 100, R["unreachable"], [R["unreachable"]], qualname=F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit("#"), "n")))


def unused_modules(x: Reached) -> DataFrame:
    """Modules that no entry can import."""
    named = x.r.named.filter("main").join(x.r.winners.select("project_id", "module", F.col("path").alias("won")), ["project_id", "module"]).filter("path = won")
    rows = named.join(x.modules, ["project_id", "module"], "left_anti")
    return finding(rows, "POSSIBLY_UNUSED_MODULE", "POSSIBLY_UNUSED_MODULE", 82, R["no_incoming_imports"], [R["no_incoming_imports"]], symbol=F.col("path"), qualname=F.col("module"), line=1, column=1)


def wildcard_imports(facts: Facts) -> DataFrame:
    """Every ``import *``; its column counts from zero."""
    rows = facts.each("imports").filter("wildcard")
    name = F.concat(F.repeat(F.lit("."), F.col("level")), F.coalesce("module", F.lit("")))
    symbol = F.concat(F.when(name == "", ".").otherwise(name), F.lit(".*"))
    return finding(rows, "WILDCARD_IMPORT", "ANALYSIS_LIMIT", 60, R["wildcard_import"], [R["wildcard_import"]], symbol=symbol, qualname=symbol)


def duplicate_bodies(facts: Facts, least: int) -> DataFrame:
    """Functions with the body of an earlier one; the earliest of a group by path, line and qualname is its origin.

    The origin is found by an aggregation, so a very common body is no hot key.
    """
    rows = facts.each("body_hashes").filter(F.col("digest") != "").filter(F.col("statements") >= least).filter(~modules.is_test(F.col("path")))
    first = rows.groupBy("project_id", "digest").agg(F.min(F.struct("path", "line", "qualname", "name")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = rows.join(first, ["project_id", "digest"]).filter("struct(path, line, qualname) <> struct(first.path, first.line, first.qualname)")
    origin = F.concat_ws(":", "first.path", "first.name")
    return finding(rows, "DUPLICATE_CODE", "POSSIBLY_DUPLICATE", 80, F.format_string("Function '%s' duplicates %s.", F.col("name"), origin), [origin], symbol=F.col("name"), column=1)


def soften_without_entries(found: DataFrame, x: Reached) -> DataFrame:
    """Where a project has no entry at all, an orphan is only a maybe."""
    rows = found.join(x.projects.select("project_id", "any_entry"), "project_id", "left")
    weak = (F.col("rule") == "ORPHAN_FUNCTION") & (F.col("confidence") > 60) & ~F.coalesce("any_entry", F.lit(False))
    return rows.withColumn("evidence", F.when(weak, F.concat("evidence", F.array(F.lit(R["no_scan_entry"])))).otherwise(F.col("evidence"))).withColumn("confidence", F.when(weak, 60).otherwise(F.col("confidence"))).drop("any_entry")
