"""Ignore-file patterns as regular expressions that Spark and Python read alike."""

from __future__ import annotations

import re


def _body(pattern: str) -> str:
    out, at = [], 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif pattern.startswith("/**", at) and at + 3 == len(pattern):
            out.append("/.+")
            at += 3
        elif pattern.startswith("**", at):
            out.append(".*")
            at += 2
        elif pattern[at] == "*":
            out.append("[^/]*")
            at += 1
        elif pattern[at] == "?":
            out.append("[^/]")
            at += 1
        elif pattern[at] == "[" and "]" in pattern[at + 2 :]:
            end = pattern.index("]", at + 2)
            out.append("[" + pattern[at + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]")
            at = end + 1
        else:
            out.append(re.escape(pattern[at]))
            at += 1
    return "".join(out)


def ignore_regex(pattern: str) -> str:
    """What a line of an ignore file matches: a path, or anything below a matching folder."""
    only_folder = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    pattern = pattern.lstrip("/")
    head = "" if anchored else "(?:.*/)?"
    return f"^{head}{_body(pattern)}{'/.*' if only_folder else '(?:/.*)?'}$"


def any_regex(patterns) -> str:
    """One expression for several patterns; matches nothing where there are none."""
    found = [ignore_regex(p)[1:-1] for p in patterns]
    return f"^(?:{'|'.join(found)})$" if found else "^(?!)$"


def name_regex(pattern: str) -> str:
    """A shell pattern for whole names, case-sensitive."""
    out = []
    for c in pattern:
        out.append(".*" if c == "*" else "." if c == "?" else c if c in "[]" else re.escape(c))
    return f"^{''.join(out).replace('[!', '[^')}$"


def rules_of(folder: str, text: str) -> list[tuple[str, bool]]:
    """(regex, negated) of an ignore file that lies in ``folder`` ('' for the root), in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        if folder:
            anchored = "/" in line.rstrip("/")
            line = f"{folder}/{line.lstrip('/')}" if anchored else f"{folder}/**/{line}"
        out.append((ignore_regex(line), negated))
    return out
