"""Scan settings: a driver-side record, read from TOML text."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field, fields

from cinderbark.functions import vocabulary as V
from cinderbark.functions.comments import rule_key


@dataclass(frozen=True)
class Allow:
    symbol: str
    rule: str = ""
    reason: str = ""


@dataclass(frozen=True)
class Config:
    exclude: tuple[str, ...] = tuple(V.EXCLUDES)
    ignore: tuple[str, ...] = ()
    ignore_names: tuple[str, ...] = ()
    ignore_decorators: tuple[str, ...] = ()
    ignore_bases: tuple[str, ...] = ()
    allow: tuple[Allow, ...] = ()
    entry_points: tuple[str, ...] = ()
    entry_patterns: tuple[str, ...] = tuple(V.ENTRY_PATTERNS)
    frameworks: tuple[str, ...] = ()
    framework_decorators: tuple[str, ...] = ()
    fold: dict[str, str] = field(default_factory=dict)
    duplicate_min_statements: int = 5
    include_tests: bool = False
    check_modules: bool = True
    check_dependencies: bool = True
    check_duplicates: bool = True
    report_framework_conventions: bool = False
    report_dev_dependencies: bool = False
    report_unused_ignores: bool = False
    require_ignore_reason: bool = False
    min_confidence: int = 60
    directive_word: str = "cinderbark"

    def decorators(self) -> list[str]:
        extra = V.PYDANTIC_DECORATORS if "pydantic" in self.frameworks else []
        return [*self.framework_decorators, *self.ignore_decorators, *extra]

    def entry_globs(self) -> list[str]:
        return [*self.entry_patterns, *(V.DJANGO_PATTERNS if "django" in self.frameworks else [])]


FRAMEWORKS = ("django", "pydantic", "celery")


def from_table(table: dict) -> Config:
    """Validate and coerce a settings table; unknown keys warn, wrong types raise ``ValueError``."""
    known = {f.name: f for f in fields(Config)}
    out = {}
    for key, value in table.items():
        name = key.replace("-", "_")
        if name not in known:
            warnings.warn(f"unknown setting: {key}", stacklevel=2)
            continue
        default = getattr(Config, name, None)
        if name == "fold":
            if not isinstance(value, dict):
                raise ValueError("fold must be a table")
            out[name] = {str(k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in value.items()}
        elif name == "allow":
            out[name] = tuple(_allow(x) for x in value)
        elif name == "frameworks":
            items = [value] if isinstance(value, str) else value
            if bad := [x for x in items if x not in (*FRAMEWORKS, "auto")]:
                raise ValueError(f"unknown framework: {bad[0]}")
            out[name] = tuple(x for x in items if x != "auto")
        elif isinstance(default, bool):
            if not isinstance(value, bool):
                raise ValueError(f"{key} must be true or false")
            out[name] = value
        elif isinstance(default, int):
            if not isinstance(value, int) or isinstance(value, bool):
                raise ValueError(f"{key} must be a number")
            out[name] = value
        elif isinstance(default, tuple):
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ValueError(f"{key} must be a list of strings")
            out[name] = tuple(value)
        else:
            out[name] = value
    return Config(**out)


def _allow(item) -> Allow:
    if isinstance(item, str):
        return Allow(item)
    if not isinstance(item, dict) or not item.get("symbol"):
        raise ValueError("an allow rule needs a symbol")
    if item.get("rule") and rule_key(item["rule"]).upper() not in V.RULES:
        raise ValueError(f"unknown rule: {item['rule']}")
    return Allow(item["symbol"], item.get("rule", ""), item.get("reason", ""))


def from_toml(text: str, section: str = "tool.cinderbark") -> Config:
    """Settings of a TOML text: a section of it, or the whole where ``section`` is empty."""
    table = tomllib.loads(text)
    for part in section.split(".") if section else ():
        table = table.get(part, {})
    return from_table(table)
