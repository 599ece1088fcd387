"""Views of planted cases: (place, row) of one kind of fact or finding, a line of text each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.operators import dependencies, modules, present
from cinderbark.operators.index import Facts
from cinderbark.plans.cases import line


def _each(column: str, *fields, where: str = "true"):
    return lambda facts: facts.each(column).filter(where).select("project_id", "path", line(*fields))


def _values(column: str):
    return lambda facts: facts.good.select("project_id", "path", F.explode(column).alias("row"))


_TARGET = "concat_ws('.', nullif(owner, ''), nullif(attr, ''))"

#: View of the facts of single files.
FACTS = {
    "errors": lambda facts: facts.errors().select("project_id", "path", line("line")),
    "names": _each("bindings", "qualname", "kind", "read_count", where="kind <> 'parameter'"),
    "parameters": _each("bindings", "qualname", "kind", where="kind = 'parameter'"),
    "typing": _each("bindings", "qualname", "typing_only", where="kind = 'import'"),
    "origins": _each("bindings", "qualname", "origin", where="kind = 'variable'"),
    "order": _each("bindings", "ord", "qualname", "line"),
    "exports": _values("exports"),
    "probes": _values("import_probes"),
    "abstract": _values("abstract"),
    "strings": _values("module_strings"),
    "sweeps": _values("module_sweeps"),
    "dynimports": _values("dynamic_imports"),
    "unbound": _values("unbound_names"),
    "lambdas": _values("lambda_mentions"),
    "settings": _each("setting_strings", "owner", "text"),
    "uses": _each("uses", "caller", "kind", _TARGET, "if(call, 'call', 'mention')"),
    "decorators": _each("decorators", "qualname", "name", "array_join(arguments, ',')"),
    "returns": _each("returns", "qualname", "annotation"),
    "markers": _each("dynamic_markers", "name", "array_join(symbols, ',')"),
    "dead": _each("unreachable", "line", "scope"),
    "deadsymbols": _each("unreachable", "line", "symbol"),
    "ignores": _each("ignores", "line", "array_join(rules, ',')", "exact", "reason"),
    "bases": lambda facts: facts.each("class_bases").select("project_id", "path", "class", F.posexplode("bases").alias("at", "b")).select("project_id", "path", line("class", "b.kind", "b.target", "b.leaf")),
    "hashes": lambda facts: facts.each("body_hashes").groupBy("project_id", "path", "digest").agg(F.array_join(F.array_sort(F.collect_list("qualname")), ",").alias("names")).select("project_id", "path", line("names", "digest <> ''")),
}


def of_files(facts: Facts, view: str, name: str) -> DataFrame:
    """The view's rows of the files of one case."""
    rows = FACTS[view](facts)
    return rows.filter(F.col("path").startswith(f"{name}/")).select(F.col("path").alias("place"), "row")


def _symbols(column: str = "sym") -> str:
    """The path and qualname of a symbol key."""
    return f"replace(substring_index({column}, '\x1f', -2), '\x1f', ':')"


def _of(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.select("project_id", line(*fields))


def _keyed(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """Rows that name their project only within a symbol key."""
    return rows.select(F.substring_index(key, "\x1f", 1).alias("project_id"), line(*fields))


#: Views of whole projects, of a scan.
PROJECTS = {
    "findings": lambda s: _of(s.report(min_confidence=0), "rule", "path", "symbol", "confidence", "status"),
    "reasons": lambda s: _of(s.report(min_confidence=0), "rule", "symbol", "array_join(reasons, ',')"),
    "ids": lambda s: _of(s.report(min_confidence=0).filter("rule = 'UNUSED_FUNCTION'"), "path", "symbol", "length(id)", "fingerprint"),
    "sorted": lambda s: _of(s.report(min_confidence=0).withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(*present.order("confidence")))), "place", "rule", "line", "symbol"),
    "owned": lambda s: _of(s.resolved.owned, "line", "module", _symbols()),
    "edges": lambda s: _of(s.resolved.edges.join(s.resolved.module_files, ["project_id", "target"], "left"), "path", "line", "target", "target_path"),
    "modules": lambda s: _of(s.reached.modules, "module"),
    "targets": lambda s: _keyed(s.resolved.import_targets, "sym", _symbols(), _symbols("target")),
    "chains": lambda s: _keyed(s.resolved.chains, "sym", _symbols(), _symbols("target")),
    "visible": lambda s: _of(s.resolved.visible, "path", "name", _symbols()),
    "allbases": lambda s: _keyed(s.resolved.bases, "class_sym", _symbols("class_sym"), "place", _symbols("base_sym"), "leaf"),
    "overrides": lambda s: _keyed(s.resolved.overrides, "member", _symbols("member"), _symbols("override")),
    "methods": lambda s: _keyed(s.resolved.methods, "member", _symbols("class_sym"), "attr", "kind"),
    "reached": lambda s: _of(s.reached.reached[0].join(s.resolved.symbols.filter("kind IN ('function', 'class')"), "sym"), "path", "qualname"),
    "waiting": lambda s: _keyed(s.reached.waiting, "from", _symbols("`from`")),
    "projects": lambda s: _of(s.reached.projects, "app", "any_entry"),
    "modulesof": lambda s: _of(s.resolved.named, "path", "module"),
    "winners": lambda s: _of(s.resolved.winners, "module", "path"),
    "tests": lambda s: _of(s.reached.files, "path", "test"),
    "roots": lambda s: _of(modules.roots(s.facts.files.select("project_id", "path")), "concat('/', root)"),
    "packages": lambda s: _of(modules.packages(s.resolved.named), "path", "array_join(package, '.')"),
    "declared": lambda s: _of(s.declared.select("project_id", "path", F.explode("packages").alias("p")), "path", "p.name", "p.line", "p.dev", "p.optional"),
    "firstdeclared": lambda s: _of(dependencies.declared(s.declared), "package", "path", "line", "dev"),
    "imported": lambda s: _of(dependencies.imported_modules(s.facts), "module"),
    "entries": lambda s: _of(s.reached.entry_symbols, "path", _symbols(), "module_level", "app"),
    "referenced": lambda s: _keyed(s.reached.referenced, "sym", _symbols()),
    "lookup": lambda s: _keyed(s.resolved.lookup, "class_sym", _symbols("class_sym"), "attr", _symbols("member")),
    "symbols": lambda s: _of(s.resolved.symbols, "qualname", "kind"),
    "ancestors": lambda s: _keyed(s.resolved.ancestors, "class_sym", _symbols("class_sym"), _symbols("ancestor"), "route"),
    "scripts": lambda s: _of(s.declared.select("project_id", F.explode("scripts").alias("s")), "s.module", "s.qualname", "s.program"),
}


def of_projects(scan, view: str, name: str) -> DataFrame:
    """The view's rows of the projects of one case."""
    return PROJECTS[view](scan).filter(F.col("project_id").rlike(f"^{name}_[0-9]+$")).select(F.col("project_id").alias("place"), "row")
