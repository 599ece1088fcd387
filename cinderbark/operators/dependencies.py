"""Declared packages against imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.functions import vocabulary as V
from cinderbark.operators.index import Facts
from cinderbark.operators.rules import finding
from cinderbark.plans.config import Config
from cinderbark.session import cut

R = V.REASONS


def canonical(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")
    known = F.create_map(*[F.lit(v) for kv in V.CANONICAL.items() for v in kv])
    return F.coalesce(F.try_element_at(known, plain), plain)


def declared(manifests: DataFrame, within: str = "") -> DataFrame:
    """(project_id, package, path, line, dev): the first declaration of a package; a runtime one goes before dev ones.

    A scan of a whole project leaves out manifests of examples; one of a folder keeps
    that folder's and the project's own.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    example = F.exists(F.split(F.lower(folder), "/"), lambda p: p.isin(V.EXAMPLE_DIRS))
    inside = ~example if not within else (F.col("path").startswith(within.rstrip("/") + "/") | (folder == ""))
    rows = manifests.filter(inside).select("project_id", "path", F.posexplode("packages").alias("ord", "p"))
    rows = rows.select("project_id", "path", "ord", canonical(F.col("p.name")).alias("package"), "p.line", "p.dev", "p.optional").filter("package NOT IN ('', 'python')")
    w = Window.partitionBy("project_id", "package").orderBy("dev", "path", "ord")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "ord")


def imported_modules(facts: Facts) -> DataFrame:
    """(project_id, module): absolute imports and literal dynamic ones."""
    return facts.each("imports").filter("level = 0 AND module <> ''").select("project_id", "module").unionByName(facts.each("dynamic_imports").select("project_id", F.col("value").alias("module"))).distinct()


def unused_dependencies(facts: Facts, manifests: DataFrame, distributions: DataFrame | None, config: Config, within: str = "") -> DataFrame:
    """Declared packages that nothing imports.

    ``distributions`` (top, dist, file) says which installed package provides which
    top-level module; null means that nothing is known of the environment.
    """
    spark = facts.table.sparkSession
    dists = spark.createDataFrame([], "top string, dist string, file string") if distributions is None else distributions
    dists = dists.select("top", canonical(F.col("dist")).alias("package"), "file").distinct()
    pairs = cut(dists.select("top", "package").distinct(), "distributions")
    d = cut(declared(manifests, within), "declared")
    m = cut(imported_modules(facts).withColumn("top", F.substring_index("module", ".", 1)), "imported")
    keys = ["project_id", "package"]
    mark = lambda rows, name: rows.select(*keys).distinct().withColumn(name, F.lit(True))

    # Dotted names match on equal prefixes, so this is a hash join.
    parts = F.split("module", r"\.")
    ups = m.select("project_id", "module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("dotted"))
    dots = d.select(*keys, F.replace("package", F.lit("-"), F.lit(".")).alias("dotted"))
    below = mark(dots.join(ups, ["project_id", "dotted"]), "used_dotted")
    halves = F.split("dotted", r"\.")
    downs = dots.select(*keys, "dotted", F.explode(F.transform(F.sequence(F.lit(1), F.size(halves)), lambda n: F.array_join(F.slice(halves, 1, n), "."))).alias("module")).filter("module <> dotted")
    above = downs.join(m, ["project_id", "module"])
    part = mark(above.filter("contains(module, '.')"), "used_part")
    space = mark(above.filter("NOT contains(module, '.')"), "namespace")

    named = mark(m.select("project_id", canonical(F.col("top")).alias("package")), "by_name")
    sharing = pairs.groupBy("top").agg(F.count(F.lit(1)).alias("owners"))
    owners = m.join(pairs, "top").join(sharing, "top")
    files = dists.filter("file IS NOT NULL").select("top", "package", "file")
    path = F.replace("module", F.lit("."), F.lit("/"))
    exact = owners.filter("owners > 1 AND contains(module, '.')").join(files, ["top", "package"]).filter((F.col("file") == F.concat(path, F.lit(".py"))) | F.col("file").startswith(F.concat(path, F.lit("/"))))
    exact = exact.select("project_id", "module", "package").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("project_id", "module"))).filter("n = 1")
    provided = mark(owners.filter("owners = 1").select(*keys).unionByName(exact.select(*keys)), "by_distribution")
    shared = mark(owners.filter("owners > 1"), "shared")
    known = pairs.select("package").distinct().withColumn("installed", F.lit(True))

    texts = facts.each("module_strings").select("project_id", F.lower(F.substring_index("value", ".", 1)).alias("word")).distinct()
    alias = F.try_element_at(F.create_map(*[F.lit(v) for kv in V.IMPORT_ALIAS.items() for v in kv]), F.col("package"))
    spelled = d.select(*keys, F.explode(F.array_compact(F.array(F.replace("package", F.lit("-"), F.lit("_")), F.replace("package", F.lit("-"), F.lit("")), alias))).alias("word"))
    spelled = spelled.unionByName(d.join(pairs, "package").select(*keys, F.lower("top").alias("word")))
    in_text = mark(spelled.join(texts, ["project_id", "word"]), "in_text")
    aliased = mark(d.withColumn("alias", canonical(alias)).join(m.select("project_id", canonical(F.col("top")).alias("alias")).distinct(), ["project_id", "alias"]), "aliased")

    x = d
    for found in (named, provided, below, part, space, shared, in_text, aliased):
        x = x.join(found, keys, "left")
    x = x.join(known, "package", "left")
    yes = lambda *names: F.greatest(*(F.coalesce(F.col(n), F.lit(False)) for n in names), F.lit(False))
    x = x.filter(~yes("by_name", "by_distribution", "used_dotted", "used_part"))
    name = F.col("package")
    tooling = name.isin(V.TOOLING)
    for p in V.TOOLING_PREFIXES:
        tooling = tooling | name.startswith(p)
    for p in V.TOOLING_SUFFIXES:
        tooling = tooling | name.endswith(p)
    case = (
        F.when(yes("aliased"), "aliased").when(yes("namespace", "shared"), "namespace").when(F.col("dev"), "dev").when(tooling, "tooling")
        .when(yes("in_text"), "text").when(name.isin(V.RUNTIME_ONLY), "runtime").when(~yes("installed"), "unknown").otherwise("unused")
    )
    x = x.withColumn("case", case)
    if not config.report_dev_dependencies:
        x = x.filter("case <> 'dev'")
    evidence = (
        F.when(F.col("case") == "aliased", F.format_string("Imported as %s, so the package name cannot be proved unused.", alias))
        .when(F.col("case") == "namespace", R["namespace_import"])
        .when(F.col("case") == "dev", F.format_string("Declared in %s as a development or docs dependency and never imported.", F.col("path")))
        .when(F.col("case") == "tooling", R["tooling_package"])
        .when(F.col("case") == "text", R["string_names_package"])
        .when(F.col("case") == "runtime", R["runtime_package"])
        .when(F.col("case") == "unknown", R["no_dist_metadata"])
        .otherwise(F.format_string("Declared in %s and never imported.", F.col("path")))
    )
    return finding(x, "UNUSED_DEPENDENCY", "POSSIBLY_DEAD", F.when(F.col("case") == "unused", 95).otherwise(70), "No Python imports found.", [evidence], symbol=name, qualname=name, column=1)


def has_runtime_requirement(manifests: DataFrame, package: str) -> DataFrame:
    """(project_id): projects that require ``package`` at run time."""
    rows = manifests.select("project_id", F.explode("packages").alias("p")).filter("NOT p.dev AND NOT p.optional")
    return rows.filter(canonical(F.col("p.name")) == canonical(F.lit(package))).select("project_id").distinct()
