"""A whole scan: sources and manifests in, findings out, for all projects at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.operators import dependencies, rules, scoring, suppress
from cinderbark.operators.index import Facts, backend, index
from cinderbark.operators.reach import Reached
from cinderbark.operators.resolve import Resolved
from cinderbark.plans.config import Config
from cinderbark.session import ROW_GROUPS, cut, setting
from cinderbark.sources.manifests import read_manifests

@dataclass
class Scan:
    """Stages of a scan; each is computed at most once, and only if something asks for it.

    ``sources`` and ``manifests``: (project_id, path, source).  ``stored`` takes the
    facts of an earlier scan instead of indexing.
    """

    sources: DataFrame
    config: Config = Config()
    manifests: DataFrame | None = None
    distributions: DataFrame | None = None
    stored: DataFrame | None = None
    within: str = ""
    index_source: object = backend

    @cached_property
    def facts(self) -> Facts:
        table = self.stored if self.stored is not None else index(self.sources, self.config, self.index_source)
        if self.stored is not None:
            return Facts(table)
        with setting(table.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", "8m"):  # sources may be long
            return Facts(cut(table, "facts", **ROW_GROUPS))

    @cached_property
    def declared(self) -> DataFrame | None:
        return None if self.manifests is None else cut(read_manifests(self.manifests), "manifests")

    @cached_property
    def resolved(self) -> Resolved:
        return Resolved(self.facts)

    @cached_property
    def reached(self) -> Reached:
        scripts = None
        if self.declared is not None:
            scripts = self.declared.select("project_id", F.explode("scripts").alias("s")).select("project_id", "s.module", "s.qualname", "s.program")
        return Reached(self.resolved, self.config, scripts)

    @cached_property
    def raw(self) -> DataFrame:
        """Findings of all rules before scoring."""
        x, c = self.reached, self.config
        parts = [
            rules.unused_names(x),
            rules.wildcard_imports(self.facts),
            rules.unreachable_code(self.facts),
            rules.orphans(x),
            rules.unused_attributes(x, c.report_framework_conventions),
        ]
        if c.check_modules:
            parts.append(rules.unused_modules(x))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = rules.soften_without_entries(found, x)
        if c.check_dependencies and self.declared is not None:
            found = found.unionByName(dependencies.unused_dependencies(self.facts, self.declared, self.distributions, c, self.within))
        if c.check_duplicates:
            found = found.unionByName(rules.duplicate_bodies(self.facts, c.duplicate_min_statements))
        return cut(found, "raw")

    @cached_property
    def scored(self) -> DataFrame:
        found = scoring.caps(cut(scoring.adjust(self.raw, self.facts), "adjusted"), self.reached, self.sources)
        return scoring.soften_for_errors(found, self.facts)

    @cached_property
    def findings(self) -> DataFrame:
        """Scored and suppressed findings with ids, before baseline and least score."""
        found = suppress.by_settings(suppress.without_tests(self.scored, self.config), self.config)
        return cut(scoring.identify(suppress.by_comments(found, self.facts, self.config)), "findings")

    def report(self, baseline: DataFrame | None = None, mode: str = "new", min_confidence: int | None = None, changed: DataFrame | None = None) -> DataFrame:
        """What a caller sees: baseline, least score and changed files applied."""
        least = self.config.min_confidence if min_confidence is None else min_confidence
        out = suppress.by_baseline(self.findings, baseline, mode).filter(F.col("confidence") >= least)
        return out if changed is None else out.join(changed.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")

    @property
    def errors(self) -> DataFrame:
        return self.facts.errors()
