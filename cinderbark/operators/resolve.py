"""Joins that turn names into symbols across files: imports, bases, methods and uses."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.functions import vocabulary as V
from cinderbark.operators import modules
from cinderbark.operators.index import SEP, Facts, sym
from cinderbark.session import closure, cut

KEYS = ["project_id", "path"]


def member(path, name):
    """The key of ``name`` in the file ``path`` of this row's project."""
    return F.concat_ws(SEP, "project_id", path, name)


class Resolved:
    """The project graph of all scanned projects; every table is computed once."""

    def __init__(self, facts: Facts):
        self.facts = facts

    @cached_property
    def bindings(self) -> DataFrame:
        """Bindings with ``exported``; of equal qualnames in a file the last counts where one is needed."""
        rows = self.facts.bindings().join(self.facts.files.select(*KEYS, "exports"), KEYS)
        return cut(rows.withColumn("exported", (F.col("scope_kind") == "module") & F.array_contains("exports", F.col("name"))).drop("exports"), "bindings")

    @cached_property
    def symbols(self) -> DataFrame:
        """(sym, kind, project_id, path, qualname, name, scope_kind): one row a qualname."""
        w = Window.partitionBy("sym").orderBy(F.desc("ord"))
        one = self.bindings.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
        return cut(one.select("sym", "kind", *KEYS, "qualname", "name", "scope_kind", "read_count", "exported"), "symbols")

    @cached_property
    def named(self) -> DataFrame:
        return cut(modules.names(self.facts.files), "modules")

    @cached_property
    def winners(self) -> DataFrame:
        return cut(modules.by_module(self.named), "module_files")

    @cached_property
    def edges(self) -> DataFrame:
        return cut(modules.import_edges(self.facts, self.named), "imports")

    @cached_property
    def module_files(self) -> DataFrame:
        """(project_id, target, target_path)."""
        return self.winners.select("project_id", F.col("module").alias("target"), F.col("path").alias("target_path"))

    @cached_property
    def owned(self) -> DataFrame:
        """Imports with the binding they store (``sym``): the latest import binding of the name at or before the line."""
        b = self.bindings.filter("kind = 'import'").select(*KEYS, F.col("name").alias("alias"), "sym", F.col("line").alias("bound"))
        e = self.edges.filter("NOT wildcard AND alias IS NOT NULL")
        w = Window.partitionBy(*KEYS, "ord")
        both = e.join(b, [*KEYS, "alias"]).withColumn("others", F.count(F.lit(1)).over(w))
        both = both.withColumn("owner", F.max(F.when(F.col("bound") <= F.col("line"), F.col("bound"))).over(w))
        return cut(both.filter("others = 1 OR bound = owner").drop("others", "owner"), "owned")

    @cached_property
    def visible(self) -> DataFrame:
        """(project_id, path, name, sym): what each file has at module level, wildcard imports included."""
        own = self.bindings.filter("scope_kind = 'module'").select(*KEYS, "name", "sym")
        wild = self.edges.filter("wildcard").join(self.module_files, ["project_id", "target"]).select(*KEYS, "ord", F.col("target_path"))
        if wild.isEmpty():
            return own
        lists = self.facts.files.select("project_id", F.col("path").alias("target_path"), F.nullif("exports", F.array().cast("array<string>")).alias("listed"))
        wild = cut(wild.join(lists, ["project_id", "target_path"]), "wildcards")
        # a chain of wildcard imports passes each file of its project once at most; circles may swap names for ever
        longest = wild.groupBy("project_id").agg(F.count_distinct("path").alias("n")).agg(F.max("n")).first()[0]
        have, last = own, None
        for _ in range(longest):
            source = have.select("project_id", F.col("path").alias("target_path"), "name", "sym")
            seen = wild.join(source, ["project_id", "target_path"]).filter(F.coalesce(F.array_contains("listed", F.col("name")), ~F.col("name").startswith("_")))
            now = seen.groupBy(*KEYS, "name").agg(F.max_by("sym", "ord").alias("sym"))
            now = cut(now.join(own, [*KEYS, "name"], "left_anti"), "visible")
            have = own.unionByName(now)
            if last is not None and now.join(last, [*KEYS, "name", "sym"], "left_anti").isEmpty():
                break
            last = now
        return cut(have, "visible")

    @cached_property
    def import_targets(self) -> DataFrame:
        """(sym, target): an import binding and each symbol that it may stand for."""
        from_ = self.owned.filter("imported IS NOT NULL").join(self.module_files, ["project_id", "target"])
        there = self.visible.select("project_id", F.col("path").alias("target_path"), F.col("name").alias("imported"), F.col("sym").alias("to"))
        return cut(from_.join(there, ["project_id", "target_path", "imported"]).filter("sym <> to").select("sym", F.col("to").alias("target")).distinct(), "targets")

    @cached_property
    def import_modules(self) -> DataFrame:
        """(sym, project_id, module): the dotted module that an import binding names, if it were one."""
        plain = F.when(F.col("alias") == F.substring_index("module", ".", 1), F.substring_index("module", ".", 1)).otherwise(F.col("module"))
        plain = F.when(F.col("alias") == F.col("module"), F.col("module")).otherwise(plain)
        child = F.concat_ws(".", F.nullif("target", F.lit("")), "imported")
        return self.owned.filter("target IS NOT NULL").select("sym", "project_id", F.when(F.col("imported").isNull(), plain).otherwise(child).alias("module")).distinct()

    @cached_property
    def followed(self) -> DataFrame:
        """(sym, target): import bindings to all that stands at the end of their chains."""
        imports = self.symbols.filter("kind = 'import'").select(F.col("sym").alias("target"))
        steps = self.import_targets
        step = lambda new: new.join(steps.withColumnRenamed("target", "next"), F.col("target") == steps["sym"]).select(new["sym"], F.col("next").alias("target"))
        return cut(closure(steps, step, ["sym", "target"]).join(imports, "target", "left_anti"), "followed")

    @cached_property
    def chains(self) -> DataFrame:
        """(sym, target): import bindings to every binding that their chains pass."""
        steps = self.import_targets
        step = lambda new: new.join(steps.withColumnRenamed("target", "next"), F.col("target") == steps["sym"]).select(new["sym"], F.col("next").alias("target"))
        return closure(steps, step, ["sym", "target"])

    # --- classes ------------------------------------------------------------

    @cached_property
    def bases(self) -> DataFrame:
        """(class_sym, ord, base_sym, leaf): base_sym is null for a base from outside the project."""
        rows = self.facts.each("class_bases").select(*KEYS, sym("class").alias("class_sym"), F.posexplode("bases").alias("place", "base"))
        rows = rows.select(*KEYS, "class_sym", "place", "base.kind", "base.leaf", F.col("base.target").alias("spec"))
        rows = rows.withColumn("local", sym("spec"))
        follow = self.followed.select(F.col("sym").alias("local"), F.col("target").alias("far"))
        classes = self.symbols.filter("kind = 'class'").select(F.col("sym").alias("base_sym"))
        chained = self.chained(rows.filter("kind = 'chain'").select(*KEYS, F.col("spec"), "class_sym", "place"), "class_sym", "place")
        out = rows.join(follow, "local", "left").withColumn("base_sym", F.when(F.col("kind") == "class", F.col("local")).when(F.col("kind") == "import", F.col("far")))
        out = out.join(chained.select("class_sym", "place", F.col("member").alias("chain_sym")), ["class_sym", "place"], "left")
        out = out.withColumn("base_sym", F.coalesce("base_sym", "chain_sym"))
        known = out.join(classes, "base_sym", "left_semi").select("class_sym", "place", "base_sym", "leaf")
        rest = out.join(known.select("class_sym", "place"), ["class_sym", "place"], "left_anti").select("class_sym", "place", F.lit(None).cast("string").alias("base_sym"), "leaf")
        return cut(known.unionByName(rest).distinct(), "bases")

    def chained(self, rows: DataFrame, *keys: str) -> DataFrame:
        """``keys`` and ``member``, the symbol that the dotted ``spec`` (import, attributes) names."""
        parts = F.split("spec", r"\.")
        heads = rows.withColumn("sym", sym("head") if "head" in rows.columns else F.concat_ws(SEP, "project_id", "path", parts[0]))
        rest = F.slice(parts, 2, F.size(parts) - 2)
        found = heads.join(self.import_modules, ["sym", "project_id"]).select(
            *keys, "project_id", F.concat_ws(".", "module", rest).alias("target"), F.element_at(parts, -1).alias("name")
        )
        there = self.visible.select("project_id", F.col("path").alias("target_path"), "name", F.col("sym").alias("member"))
        found = found.join(self.module_files, ["project_id", "target"]).join(there, ["project_id", "target_path", "name"])
        far = self.followed.select(F.col("sym").alias("member"), F.col("target").alias("far"))
        return found.join(far, "member", "left").select(*keys, F.coalesce("far", "member").alias("member")).distinct()

    @cached_property
    def ancestors(self) -> DataFrame:
        """(class_sym, ancestor, route): a class, itself and its bases; routes sort in depth-first order."""
        classes = self.symbols.filter("kind = 'class'").select(F.col("sym").alias("class_sym"), F.col("sym").alias("ancestor"), F.lit("").alias("route"))
        up = self.bases.filter("base_sym IS NOT NULL").select(F.col("class_sym").alias("ancestor"), "base_sym", F.lpad(F.col("place").cast("string"), 3, "0").alias("step"))
        known = frontier = cut(classes, "ancestors")
        while not frontier.isEmpty():
            new = frontier.join(up, "ancestor").select("class_sym", F.col("base_sym").alias("ancestor"), F.concat("route", "step").alias("route"))
            new = new.groupBy("class_sym", "ancestor").agg(F.min("route").alias("route"))
            frontier = cut(new.join(known, ["class_sym", "ancestor"], "left_anti"), "ancestors")
            known = known.unionByName(frontier)
        return cut(known, "ancestors")

    @cached_property
    def methods(self) -> DataFrame:
        """(class_sym, attr, member): what classes define themselves."""
        owner = F.concat_ws(SEP, "project_id", "path", F.regexp_replace("qualname", r"\.[^.]*$", ""))
        return self.symbols.filter("scope_kind = 'class'").select(owner.alias("class_sym"), F.col("name").alias("attr"), F.col("sym").alias("member"), "kind")

    @cached_property
    def lookup(self) -> DataFrame:
        """(class_sym, attr, member): the first definition along a class's bases."""
        found = self.ancestors.join(self.methods.withColumnRenamed("class_sym", "ancestor"), "ancestor")
        return cut(found.groupBy("class_sym", "attr").agg(F.min_by("member", "route").alias("member")), "lookup")

    @cached_property
    def overrides(self) -> DataFrame:
        """(member, attr, class_sym, override): definitions of the same name in subclasses."""
        below = self.ancestors.filter("class_sym <> ancestor")
        mine = self.methods.select(F.col("class_sym").alias("ancestor"), "attr", "member")
        theirs = self.methods.select("class_sym", "attr", F.col("member").alias("override"))
        return below.join(mine, "ancestor").join(theirs, ["class_sym", "attr"]).select("member", "override").distinct()

    # --- uses ---------------------------------------------------------------

    @cached_property
    def uses(self) -> DataFrame:
        """(project_id, from, to, name, call, walk): resolved uses have ``to``, the rest a bare ``name``."""
        u = self.facts.each("uses").withColumn("id", F.concat_ws(SEP, "project_id", "path", F.col("ord").cast("string"))).withColumn("from", sym("caller")).withColumn("at", sym("owner"))
        u = cut(u, "uses")
        keep = ["id", "project_id", "from", "call", "walk"]
        far = self.followed.select(F.col("sym").alias("at"), F.col("target").alias("far"))
        kinds = self.symbols.select(F.col("sym").alias("at"), F.col("kind").alias("at_kind"))

        local = u.filter("kind IN ('local', 'lambda')").join(far, "at", "left").select(*keep, F.coalesce("far", "at").alias("to"))
        through_import = u.filter("kind = 'local'").join(kinds.filter("at_kind = 'import'"), "at").select(*keep, F.col("at").alias("to"))
        wild = u.filter("kind = 'wild'").join(self.visible.select(*KEYS, F.col("name").alias("owner"), F.col("sym").alias("to")), [*KEYS, "owner"])
        wild = wild.join(self.followed.select(F.col("sym").alias("to"), F.col("target").alias("far")), "to", "left").select(*keep, F.coalesce("far", "to").alias("to"))

        on_class = u.filter("kind = 'method'").join(far, "at", "left").withColumn("class_sym", F.coalesce("far", "at"))
        met = on_class.join(self.lookup, ["class_sym", "attr"]).select(*keep, F.col("member").alias("to"))
        above = self.bases.filter("base_sym IS NOT NULL").select(F.col("class_sym").alias("at"), "place", F.col("base_sym").alias("class_sym"))
        sup = u.filter("kind = 'super'").join(above, "at").join(self.lookup, ["class_sym", "attr"])
        sup = sup.groupBy(*keep).agg(F.min_by("member", "place").alias("to"))

        results = self.facts.each("returns").select(*KEYS, sym("qualname").alias("function"), "annotation")
        typed = self.visible.select(*KEYS, F.col("name").alias("annotation"), F.col("sym").alias("type_sym"))
        results = results.join(typed, [*KEYS, "annotation"]).join(self.followed.select(F.col("sym").alias("type_sym"), F.col("target").alias("end")), "type_sym", "left")
        results = results.select("function", F.coalesce("end", "type_sym").alias("class_sym"))
        made = u.filter("kind = 'returned'").join(far, "at", "left").withColumn("function", F.coalesce("far", "at"))
        made = made.join(results, "function").join(self.lookup, ["class_sym", "attr"]).select(*keep, F.col("member").alias("to"))

        dots = u.filter("kind IN ('chain', 'method', 'returned')").withColumn("spec", F.concat_ws(".", "owner", "attr"))
        dots = self.chained(dots, "id", "project_id", "from", "call", "walk").select(*keep, F.col("member").alias("to"))

        found = cut(local.unionByName(through_import).unionByName(wild).unionByName(met).unionByName(sup).unionByName(made).unionByName(dots).distinct(), "found")
        open_ = u.filter("attr <> ''").join(found.select("id").distinct(), "id", "left_anti")
        below = self.ancestors.filter("class_sym <> ancestor").join(self.methods, "class_sym")
        dangling = on_class.join(open_.select("id"), "id", "left_semi").withColumnRenamed("class_sym", "ancestor").join(below.select("ancestor", "attr", F.col("member").alias("to")), ["ancestor", "attr"])
        dangling = cut(dangling.select(*keep, "to").distinct(), "dangling")
        unknown = open_.join(dangling.select("id"), "id", "left_anti").filter("kind <> 'super'").select(*keep, F.lit(None).cast("string").alias("to"), F.col("attr").alias("name"))
        known = found.unionByName(dangling).withColumn("name", F.lit(None).cast("string"))
        return cut(known.unionByName(unknown).drop("id").distinct(), "uses")

    @cached_property
    def outside_bases(self) -> DataFrame:
        """(class_sym): classes with a base from outside, their own or inherited; some bases do not count."""
        rows = self.ancestors.join(self.bases.filter("base_sym IS NULL").select(F.col("class_sym").alias("ancestor"), "leaf"), "ancestor")
        inherited = F.col("class_sym") != F.col("ancestor")
        return rows.filter(~F.col("leaf").isin(V.TRIVIAL_BASES) & ~(inherited & F.col("leaf").isin(V.TYPING_BASES))).select("class_sym").distinct()

    def classes_by_base(self, leaves: list[str], renamed: bool = False) -> DataFrame:
        """(class_sym): classes that reach a base of one of these names from outside the project; ``renamed``: also as imported under another."""
        rows = self.bases.filter("base_sym IS NULL").filter(F.col("leaf").isin(leaves)).select(F.col("class_sym").alias("ancestor"))
        if renamed:
            imports = self.owned.filter(F.col("imported").isin(leaves) & (F.col("alias") != F.col("imported"))).select("sym").join(self.followed.select("sym"), "sym", "left_anti")
            specs = self.facts.each("class_bases").select(*KEYS, sym("class").alias("ancestor"), F.explode("bases").alias("b")).filter("b.kind = 'import'")
            rows = rows.unionByName(specs.withColumn("sym", sym("b.target")).join(imports, "sym", "left_semi").select("ancestor"))
        return self.ancestors.join(rows.distinct(), "ancestor", "left_semi").select("class_sym").distinct()
