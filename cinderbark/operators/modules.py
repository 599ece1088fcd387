"""Module names of files, what imports load, and which modules an entry reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.functions import vocabulary as V
from cinderbark.functions.globs import any_regex
from cinderbark.operators.index import Facts
from cinderbark.plans.config import Config
from cinderbark.session import closure, cut

_NAME = r"[\p{L}_][\p{L}\p{N}_]*"


def is_test(path: Column) -> Column:
    return path.rlike(any_regex(V.TEST_PATTERNS))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def roots(paths: DataFrame) -> DataFrame:
    """(project_id, root): the project, ``src/``, and top folders that hold packages without being one."""
    parts = paths.select("project_id", F.split("path", "/").alias("p"))
    top = parts.filter(F.size("p") > 1).groupBy("project_id", F.col("p")[0].alias("top")).agg(
        F.bool_or((F.size("p") == 2) & (F.col("p")[1] == "__init__.py")).alias("package"),
        F.bool_or((F.size("p") == 3) & (F.col("p")[2] == "__init__.py")).alias("holds"),
    )
    inferred = top.filter("holds AND NOT package").filter(F.col("top").rlike(f"^{_NAME}$") & ~F.col("top").startswith("_") & ~F.col("top").isin([*V.NOT_IMPORT_ROOTS, "src"]))
    source = top.filter("top = 'src'")
    return (
        paths.select("project_id", F.lit("").alias("root")).distinct()
        .unionByName(source.unionByName(inferred).select("project_id", F.concat("top", F.lit("/")).alias("root")))
    )


def names(paths: DataFrame) -> DataFrame:
    """(project_id, path, module, root_length, main): every dotted name of a file; ``main`` is the longest root's."""
    rooted = paths.select("project_id", "path").distinct().join(roots(paths), "project_id").filter(F.col("path").startswith(F.col("root")))
    rest = F.regexp_replace(F.expr("substring(path, length(root) + 1)"), r"(/?__init__)?\.py$", "")
    found = rooted.select("project_id", "path", F.replace(rest, F.lit("/"), F.lit(".")).alias("module"), F.length("root").alias("root_length"), rest.alias("rest"))
    found = found.filter(F.col("rest").rlike(rf"^{_NAME}(/{_NAME})*$")).drop("rest")
    best = F.max("root_length").over(Window.partitionBy("project_id", "path"))
    return found.withColumn("main", F.col("root_length") == best)


def by_module(named: DataFrame) -> DataFrame:
    """(project_id, module, path): a longer root wins a name, then the first path."""
    w = Window.partitionBy("project_id", "module").orderBy(F.desc("root_length"), "path")
    return named.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("project_id", "module", "path")


def packages(named: DataFrame) -> DataFrame:
    """(project_id, path, package): the dotted parts of the package that a file lies in."""
    parts = F.split("module", r"\.")
    inner = F.when(file_name(F.col("path")) == "__init__.py", parts).otherwise(F.slice(parts, 1, F.size(parts) - 1))
    return named.filter("main").select("project_id", "path", inner.alias("package"))


def import_edges(facts: Facts, named: DataFrame) -> DataFrame:
    """All imports with ``target``, the module they load: null if it leaves the project's top, '' for nothing."""
    drop = F.col("level") - 1
    kept = F.slice("package", 1, F.greatest(F.size("package") - drop, F.lit(0)))
    relative = F.when(F.col("package").isNotNull() & (drop <= F.size("package")), F.concat_ws(".", kept, F.expr("filter(split(module, '[.]'), x -> x <> '')")))
    edges = facts.each("imports").join(packages(named), ["project_id", "path"], "left")
    return edges.withColumn("target", F.when(F.col("level") <= 0, F.coalesce("module", F.lit(""))).otherwise(relative)).drop("package")


def modules_used(edges: DataFrame) -> DataFrame:
    """(project_id, path, used): a module, all of its parents, and the child that a from-import names."""
    parts = F.split("target", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    child = F.when(F.col("imported").isNotNull() & (F.col("imported") != "*"), F.concat_ws(".", F.nullif("target", F.lit("")), "imported"))
    both = F.concat(F.when(F.col("target") != "", prefixes).otherwise(F.array()), F.array(child))
    return edges.filter("target IS NOT NULL").select("project_id", "path", F.explode(both).alias("used")).filter("used IS NOT NULL").distinct()


def reachable(seeds: DataFrame, edges: DataFrame, named: DataFrame, winners: DataFrame) -> DataFrame:
    """(project_id, module): all that an entry module can import, with packages along the way and other names."""
    parts = F.split("module", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    start = seeds.select("project_id", F.explode(parents).alias("module"))
    imports = modules_used(edges).join(winners, ["project_id", "path"]).select("project_id", "module", "used")
    own = named.join(winners.select("project_id", "path", F.col("module").alias("won")), ["project_id", "path"])
    aliases = own.select("project_id", F.col("won").alias("module"), F.col("module").alias("used")).filter("module <> used")
    steps = cut(imports.unionByName(aliases).distinct(), "module_steps")
    return closure(start, lambda new: new.join(steps, ["project_id", "module"]).select("project_id", F.col("used").alias("module")), ["project_id", "module"])


def entry_files(facts: Facts, named: DataFrame, config: Config) -> DataFrame:
    """Files with their main module, and whether they are entries, tests or programs."""
    main = named.filter("main").select("project_id", "path", "module")
    inits = facts.files.filter(file_name(F.col("path")) == "__init__.py").select("project_id", F.regexp_replace("path", "/?__init__[.]py$", "").alias("folder"), F.lit(True).alias("in_package"))
    files = facts.files.select("project_id", "path", "has_main_guard", F.array_join(folders(F.col("path")), "/").alias("folder"))
    files = files.join(main, ["project_id", "path"], "left").join(inits.distinct(), ["project_id", "folder"], "left")
    name, test = file_name(F.col("path")), is_test(F.col("path"))
    script = F.col("has_main_guard") & ~name.isin(V.TOOLING_FILES) & ~F.arrays_overlap(F.split("folder", "/"), F.array(*map(F.lit, V.SIDE_DIRS))) & F.col("in_package").isNull()
    return files.select(
        "project_id",
        "path",
        "module",
        test.alias("test"),
        (F.col("has_main_guard") | F.col("path").rlike(any_regex(config.entry_globs())) | test).alias("entry"),
        (~test & (name.isin(V.APP_FILES) | script)).alias("program"),
    )
