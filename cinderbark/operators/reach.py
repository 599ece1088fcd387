"""Entries, the closure of what runs, and what is referenced or public."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.functions import vocabulary as V
from cinderbark.operators import modules
from cinderbark.operators.index import SEP, sym
from cinderbark.operators.resolve import KEYS, Resolved, member
from cinderbark.plans.config import Config
from cinderbark.session import closure, cut


def entry_decorator(name, extras: list[str]):
    """Whether a decorator is one that a framework calls through."""
    last = F.substring_index(name, ".", -1)
    known = last.isin(V.ENTRY_DECORATORS)
    for x in extras:
        known = known | (name == x) | name.endswith("." + x)
    return known


class Reached:
    """What each project's entries reach."""

    def __init__(self, resolved: Resolved, config: Config, scripts: DataFrame | None = None):
        """``scripts``: configured entry points (project_id, module, qualname, program)."""
        self.r, self.config = resolved, config
        spark = resolved.facts.table.sparkSession
        own = [(None, *x.split(":", 1), True) for x in config.entry_points if ":" in x]
        own = spark.createDataFrame(own, "project_id string, module string, qualname string, program boolean")
        every = resolved.facts.files.select("project_id").distinct()
        own = every.crossJoin(own.drop("project_id")) if config.entry_points else own.filter("false")
        self.scripts = own if scripts is None else own.unionByName(scripts)

    @cached_property
    def files(self) -> DataFrame:
        return cut(modules.entry_files(self.r.facts, self.r.named, self.config), "entry_files")

    @cached_property
    def decorated(self) -> DataFrame:
        return self.r.facts.each("decorators").withColumn("sym", sym("qualname")).withColumn("entry", entry_decorator(F.col("name"), self.config.decorators()))

    @cached_property
    def entry_symbols(self) -> DataFrame:
        """(sym, project_id, path, module_level, app)"""
        b = self.r.bindings.join(self.files.select(*KEYS, "test"), KEYS)
        marks = self.decorated.filter("entry").groupBy("sym").agg(F.max(~F.substring_index("name", ".", -1).isin(V.NOT_APP_DECORATORS)).alias("app"))
        b = b.join(marks, "sym", "left")
        code = F.col("kind").isin("function", "class")
        top, fn = F.col("scope_kind") == "module", F.col("kind") == "function"
        named = (top & fn & (F.col("name").startswith("pytest_") | (F.col("name") == "lambda_handler"))) | (top & F.col("name").startswith("test_"))
        named = named | ((F.col("scope_kind") == "class") & (F.col("name") == "ready")) | (F.col("test") & fn & F.col("name").startswith("test_"))
        values = top & (F.col("kind") == "variable")
        sphinx = values & (modules.file_name(F.col("path")) == "conf.py") & F.arrays_overlap(modules.folders(F.col("path")), F.array(F.lit("docs"), F.lit("doc")))
        celery = values & (F.col("name") == "beat_schedule") & F.lit("celery" in self.config.frameworks)
        found = b.filter((code & (F.col("app").isNotNull() | named)) | sphinx | celery)
        out = found.select("sym", *KEYS, (top & code).alias("module_level"), (F.coalesce("app", F.lit(False)) & ~F.col("test")).alias("app"))
        named_files = self.scripts.join(self.r.winners, ["project_id", "module"])
        out = out.unionByName(named_files.select(member("path", "qualname").alias("sym"), *KEYS, F.lit(False).alias("module_level"), F.lit(False).alias("app")).join(self.r.symbols.select("sym"), "sym", "left_semi"))
        if self.config.ignore_bases:
            kept = self.r.bases.filter(F.col("leaf").isin(*self.config.ignore_bases)).select("class_sym").distinct()
            inside = self.r.symbols.join(kept, (F.col("sym") == F.col("class_sym")) | F.col("sym").startswith(F.concat("class_sym", F.lit("."))), "left_semi")
            out = out.unionByName(inside.select("sym", *KEYS, F.lit(False).alias("module_level"), F.lit(False).alias("app")))
        return cut(out.distinct(), "entries")

    @cached_property
    def projects(self) -> DataFrame:
        """(project_id, app, any_entry): whether a project is a program, and whether it has any entry."""
        files = self.files.groupBy("project_id").agg(F.bool_or("program").alias("program"), F.bool_or(F.col("entry") & F.col("module").isNotNull()).alias("file_entry"))
        symbols = self.entry_symbols.groupBy("project_id").agg(F.bool_or("app").alias("app"))
        scripts = self.scripts.groupBy("project_id").agg(F.bool_or("program").alias("script"))
        out = files.join(symbols, "project_id", "left").join(scripts, "project_id", "left")
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        return cut(out.select("project_id", (yes("program") | yes("app") | yes("script")).alias("app"), (F.col("app").isNotNull() | F.col("file_entry") | F.col("script").isNotNull()).alias("any_entry")), "projects")

    @cached_property
    def modules(self) -> DataFrame:
        """(project_id, module) that an entry can import."""
        from cinderbark.functions.globs import any_regex

        seeds = self.files.filter("entry OR " + str(bool(self.config.ignore)).lower()).filter(F.col("entry") | F.col("path").rlike(any_regex(self.config.ignore))).filter("module IS NOT NULL").select("project_id", "module")
        symbols = self.entry_symbols.filter("module_level").join(self.files.filter("module IS NOT NULL").select(*KEYS, "module"), KEYS).select("project_id", "module")
        return modules.reachable(seeds.unionByName(symbols).unionByName(self.scripts.select("project_id", "module")).distinct(), self.r.edges, self.r.named, self.r.winners)

    # --- references through imports -------------------------------------------

    @cached_property
    def used_imports(self) -> tuple[DataFrame, DataFrame]:
        """(all, from exports): symbols at or along the chains of imports that are used."""
        mine = self.r.bindings.filter("kind = 'import' AND (read_count > 0 OR exported)").groupBy("sym").agg(F.bool_or("exported").alias("exported"))
        rows = cut(self.r.chains.join(mine, "sym").groupBy(F.col("target").alias("sym")).agg(F.bool_or("exported").alias("exported")), "used_imports")
        return rows.select("sym"), rows.filter("exported").select("sym")

    @cached_property
    def string_symbols(self) -> tuple[DataFrame, DataFrame]:
        """(hits, misses): what dotted setting strings name, and (project_id, path, name) where the last part is missing."""
        texts = self.r.facts.each("setting_strings").select("project_id", "text").distinct()
        parts = F.split("text", r"\.")
        cuts = texts.select("project_id", "text", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("p"))
        cuts = cuts.select("project_id", "text", "n", F.array_join(F.slice("p", 1, F.col("n")), ".").alias("target"), F.get("p", F.col("n")).alias("name"))
        hit = cuts.join(self.r.module_files, ["project_id", "target"]).groupBy("project_id", "text").agg(F.max_by(F.struct("target_path", "name"), "n").alias("h"))
        rows = hit.filter("h.name IS NOT NULL").select("project_id", F.col("h.target_path").alias("path"), F.col("h.name").alias("name"))
        there = self.r.visible.select(*KEYS, "name", "sym")
        found = rows.join(there, [*KEYS, "name"])
        far = self.r.followed.select("sym", "target")
        hits = found.join(far, "sym", "left").select(F.coalesce("target", "sym").alias("sym")).unionByName(found.select("sym")).distinct()
        return hits, rows.join(there, [*KEYS, "name"], "left_anti").distinct()

    @cached_property
    def referenced(self) -> DataFrame:
        """(sym): kept alive by an import, an entry, a string, a wildcard or a subclass registry."""
        wild = self.r.facts.each("unbound_names").select(*KEYS, F.col("value").alias("name")).join(self.r.visible, [*KEYS, "name"]).select("sym")
        wild = wild.unionByName(wild.join(self.r.chains, "sym").select(F.col("target").alias("sym")))
        hops = self.r.uses.select(F.col("to").alias("sym")).join(self.r.chains.select("sym"), "sym", "left_semi")
        hops = hops.unionByName(self.r.chains.join(hops, "sym", "left_semi").select(F.col("target").alias("sym")))
        registry = self.r.methods.filter("attr = '__init_subclass__'").select(F.col("class_sym").alias("ancestor"))
        registry = self.r.ancestors.filter("class_sym <> ancestor").join(registry, "ancestor", "left_semi").select(F.col("class_sym").alias("sym"))
        own = self.r.edges.filter("imported IS NOT NULL AND NOT wildcard").select(*KEYS, F.col("alias").alias("name"), F.col("line").alias("imported_at"), "target", "imported")
        again = self.r.bindings.filter("scope_kind = 'module' AND kind <> 'import'").join(own, [*KEYS, "name"]).filter("line > imported_at")
        again = again.select("project_id", "target", F.col("imported").alias("name")).join(self.r.module_files, ["project_id", "target"])
        again = again.select("project_id", F.col("target_path").alias("path"), "name").join(self.r.visible, [*KEYS, "name"]).select("sym")
        parts = [self.used_imports[0], wild, hops, registry, self.entry_symbols.select("sym"), again, self.string_symbols[0]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cut(out.distinct(), "referenced")

    # --- closure --------------------------------------------------------------

    @cached_property
    def steps(self) -> DataFrame:
        """(from, to, walk): what runs when ``from`` does; a called class runs its constructor, a method its overrides."""
        u = self.r.uses.filter("to IS NOT NULL")
        init = self.r.lookup.filter("attr = '__init__'").select(F.col("class_sym").alias("to"), F.col("member").alias("init"))
        made = u.filter("call").join(init, "to").select("from", F.col("init").alias("to"), "walk")
        visits = self.r.lookup.filter(F.col("attr").startswith("visit_")).select("class_sym", F.col("member").alias("visitor"))
        called = self.r.lookup.filter("attr IN ('visit', 'generic_visit')").select("class_sym", F.col("member").alias("to")).join(visits, "class_sym")
        visited = u.filter("call").join(called, "to").select("from", F.col("visitor").alias("to"), "walk")
        over = self.r.overrides.select(F.col("member").alias("from"), F.col("override").alias("to"), F.lit(True).alias("walk"))
        return cut(u.select("from", "to", "walk").unionByName(made).unionByName(visited).unionByName(over).distinct(), "steps")

    @cached_property
    def waiting(self) -> DataFrame:
        """(from): functions and lambdas, whose code waits for a call; all other code of a file runs."""
        functions = self.r.symbols.filter("kind = 'function'").select(F.col("sym").alias("from"))
        lambdas = self.r.uses.filter(F.col("from").rlike(r"<lambda#\d+>$")).select("from")
        return cut(functions.unionByName(lambdas).distinct(), "waiting")

    def drain(self, seeds: DataFrame) -> DataFrame:
        """(sym, walk): all that ``seeds`` lead to; a touched symbol (walk false) runs nothing itself."""
        steps = self.steps.select(F.col("from").alias("sym"), F.col("to"), F.col("walk").alias("on"))
        return closure(seeds, lambda new: new.filter("walk").join(steps, "sym").select(F.col("to").alias("sym"), F.col("on").alias("walk")), ["sym", "walk"])

    @cached_property
    def reached(self) -> tuple[DataFrame, DataFrame]:
        """((sym) that run, (project_id, name) loaded from receivers of unknown type).

        Rounds keep the order that matters: calls drain first, then names with a
        single owner among the classes used so far, then implicit methods.
        """
        top = self.r.uses.join(self.waiting, "from", "left_anti")
        seeds = top.filter("to IS NOT NULL").select(F.col("to").alias("sym"), "walk")
        starts = self.steps.join(self.waiting, "from", "left_anti").select(F.col("to").alias("sym"), "walk")
        registry = self.r.methods.filter("attr = '__init_subclass__'").select(F.col("class_sym").alias("ancestor"))
        heirs = self.r.ancestors.filter("class_sym <> ancestor").join(registry, "ancestor", "left_semi").select("class_sym")
        heirs = self.r.methods.join(heirs, "class_sym", "left_semi").filter("kind = 'function'").select(F.col("member").alias("sym"), F.lit(True).alias("walk"))
        entries = self.entry_symbols.select("sym", F.lit(True).alias("walk"))
        seeds = seeds.unionByName(starts).unionByName(heirs).unionByName(entries).unionByName(self.string_symbols[0].select("sym", F.lit(True).alias("walk")))
        top_names = top.filter("name IS NOT NULL").select("project_id", "name")
        all_names = self.r.uses.filter("name IS NOT NULL").select(F.col("from").alias("sym"), "project_id", "name")
        methods = cut(self.r.methods.filter("kind = 'function'").join(self.r.symbols.select(F.col("sym").alias("class_sym"), "project_id"), "class_sym"), "owned_methods")
        properties = self.r.facts.each("decorators").filter(F.substring_index("name", ".", -1).isin(V.WALKED_PROPERTIES)).select(sym("qualname").alias("member")).distinct()
        visitors = self.r.classes_by_base(V.VISITOR_BASES)
        implicit = methods.filter(F.col("attr").rlike("^__.+__$"))
        implicit = implicit.unionByName(methods.join(properties, "member", "left_semi").select(*methods.columns))
        implicit = implicit.unionByName(methods.filter(F.col("attr").startswith("visit_")).join(visitors, "class_sym", "left_semi").select(*methods.columns))
        implicit = cut(implicit.select("class_sym", "member").distinct(), "implicit")
        used = self.r.bindings.filter("kind = 'class' AND (read_count > 0 OR exported)").select("sym").unionByName(self.referenced)
        known = self.drain(seeds)
        while True:
            walked = known.filter("walk").select("sym").distinct()
            names = cut(top_names.unionByName(all_names.join(walked, "sym", "left_semi").select("project_id", "name")).distinct(), "names")
            classes = cut(used.unionByName(known.select("sym")).distinct().select(F.col("sym").alias("class_sym")), "used_classes")
            owners = methods.join(names.withColumnRenamed("name", "attr"), ["project_id", "attr"]).join(classes, "class_sym", "left_semi")
            one = owners.groupBy("project_id", "attr").agg(F.count_distinct("class_sym").alias("owners"))
            shared = owners.join(self.r.ancestors, "class_sym").groupBy("project_id", "attr", "ancestor").agg(F.count_distinct("class_sym").alias("heirs"))
            shared = shared.groupBy("project_id", "attr").agg(F.max("heirs").alias("heirs"))
            sure = one.join(shared, ["project_id", "attr"], "left").filter("owners = 1 OR heirs = owners").select("project_id", "attr")
            new = owners.join(sure, ["project_id", "attr"], "left_semi").select(F.col("member").alias("sym"))
            new = cut(new.unionByName(implicit.join(classes, "class_sym", "left_semi").select(F.col("member").alias("sym"))).distinct().join(walked, "sym", "left_anti"), "added")
            if new.isEmpty():
                return cut(known.select("sym").distinct(), "reached"), names
            known = self.drain(known.unionByName(new.select("sym", F.lit(True).alias("walk"))))

    # --- public names -----------------------------------------------------------

    @cached_property
    def api(self) -> DataFrame:
        """(sym): names that a package's ``__init__`` or an ``__all__`` shows to others."""
        b = self.r.bindings
        listed = b.filter("exported").select("sym")
        inits = b.filter((modules.file_name(F.col("path")) == "__init__.py") & (F.col("scope_kind") == "module"))
        own = inits.filter("kind <> 'import' AND NOT startswith(name, '_')").select("sym")
        far = inits.filter("kind = 'import'").join(self.r.followed, "sym").select(F.col("target").alias("sym"))
        wild = self.r.visible.filter(modules.file_name(F.col("path")) == "__init__.py").select("sym")
        return cut(listed.unionByName(own).unionByName(far).unionByName(wild.join(b.filter("kind <> 'import' AND NOT startswith(name, '_')"), "sym", "left_semi")).distinct(), "api")

    def covered(self, rows: DataFrame) -> DataFrame:
        """``rows`` (project_id, path, qualname, ...) with ``covered``: whether outside code may load the name."""
        parts = F.split("qualname", r"\.")
        heads = rows.select("project_id", "path", "qualname").distinct().select(
            "*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("head")
        )
        shown = heads.withColumn("sym", F.concat_ws(SEP, "project_id", "path", "head")).join(self.api, "sym", "left_semi").select("project_id", "path", "qualname", F.lit(True).alias("shown")).distinct()
        out = rows.join(shown, ["project_id", "path", "qualname"], "left").join(self.projects, "project_id", "left")
        return out.withColumn("covered", F.coalesce("shown", F.lit(False)) | ~F.coalesce("app", F.lit(False))).drop("shown", "app", "any_entry")
