"""Control flow of one file's syntax tree: folded tests, exits and dead statements."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import cached_property

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOPS = (ast.For, ast.AsyncFor)
TRIES = (ast.Try, ast.TryStar)
WITHS = (ast.With, ast.AsyncWith)
DEAD_MESSAGE = "Control flow terminates before this statement."


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def dotted(node: ast.AST) -> str:
    """``a.b.c`` of names and attributes; what has no name in front is left out."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


class Folder:
    """Constant tests, with names and environment keys that settings fix."""

    def __init__(self, fixed: dict[str, str] | None = None):
        self.fixed = fixed or {}

    def truth(self, node: ast.expr) -> bool | None:
        """True, False, or None where the test's outcome is open."""
        match node:
            case ast.Constant(value=bool(v)):
                return v
            case ast.Constant(value=int(v)) if v in (0, 1):
                return bool(v)
            case ast.UnaryOp(op=ast.Not(), operand=inner):
                known = self.truth(inner)
                return None if known is None else not known
            case ast.BoolOp(op=op, values=values):
                stop = isinstance(op, ast.Or)
                found = [self.truth(v) for v in values]
                return stop if stop in found else None if None in found else not stop
            case ast.Name(id=name) if name in self.fixed:
                value = self._plain(self.fixed[name])
                return value if isinstance(value, bool) else None
            case ast.Compare(left=left, ops=[ast.Eq() | ast.NotEq() as op], comparators=[right]) if self.fixed:
                a, b = self._side(left, right), self._side(right, left)
                return None if a is None or b is None else (a == b) == isinstance(op, ast.Eq)
        return None

    @staticmethod
    def _plain(raw: str):
        return {"true": True, "false": False}.get(raw.lower(), raw)

    def _fixed_text(self, node: ast.expr) -> str | None:
        key = None
        match node:
            case ast.Name(id=name):
                key = name
            case ast.Subscript(value=ast.Attribute(value=ast.Name(id="os"), attr="environ"), slice=inner):
                key = text_of(inner)
            case ast.Call(func=ast.Attribute(value=ast.Attribute(value=ast.Name(id="os"), attr="environ"), attr="get"), args=[first, *_]):
                key = text_of(first)
            case ast.Call(func=ast.Attribute(value=ast.Name(id="os"), attr="getenv"), args=[first, *_]):
                key = text_of(first)
        return self.fixed.get(key) if key is not None else None

    def _side(self, node: ast.expr, other: ast.expr):
        if isinstance(node, ast.Constant) and isinstance(node.value, str | bool | int | float):
            return node.value
        raw = self._fixed_text(node)
        if raw is None:
            return None
        if not isinstance(other, ast.Constant):
            return self._plain(raw) if self._fixed_text(other) is not None else None
        if isinstance(other.value, bool):
            value = self._plain(raw)
            return value if isinstance(value, bool) else raw
        if isinstance(other.value, int | float):
            try:
                return type(other.value)(raw)
            except ValueError:
                return raw
        return raw if isinstance(other.value, str) else self._plain(raw)

    # --- exits ----------------------------------------------------------

    def exits(self, body: list[ast.stmt]) -> bool:
        """Whether control never runs past the end of ``body``."""
        known = getattr(body, "exits", None)  # of a block that is read by pieces
        return any(self.leaves(s) for s in body) if known is None else known

    def leaves(self, s: ast.stmt) -> bool:
        """Whether control never runs past ``s``; a ``with`` may swallow what leaves it."""
        match s:
            case ast.Return() | ast.Raise() | ast.Break() | ast.Continue():
                return True
            case ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id=a), attr=b))):
                return (a, b) in {("sys", "exit"), ("os", "_exit")}
            case ast.If():
                known = self.truth(s.test)
                arms = [s.body] if known else [s.orelse] if known is False else [s.body, s.orelse]
                return all(self.exits(arm) for arm in arms)
            case ast.While():
                known = self.truth(s.test)
                return self.exits(s.orelse) if known is False else known is True and not self.breaks(s.body)
            case ast.Try() | ast.TryStar():
                caught = all(self.exits(h.body) for h in s.handlers)
                return self.exits(s.finalbody) or caught and (self.exits(s.body) or self.exits(s.orelse))
            case ast.Match():
                last = s.cases[-1]
                total = last.guard is None and isinstance(last.pattern, ast.MatchAs) and last.pattern.pattern is None
                return total and all(self.exits(c.body) for c in s.cases)
        return False

    def breaks(self, body: list[ast.stmt]) -> bool:
        """Whether a ``break`` that can run leaves the loop around ``body``."""
        for s in body:
            if isinstance(s, ast.Break):
                return True
            if isinstance(s, (*FUNCTIONS, ast.ClassDef)):
                continue
            inner = [s.orelse] if isinstance(s, (*LOOPS, ast.While)) else list(self.blocks(s))
            if any(self.breaks(b) for b in inner):
                return True
            if self.leaves(s):
                return False
        return False

    @staticmethod
    def blocks(s: ast.stmt) -> Iterator[list[ast.stmt]]:
        """The statement lists directly inside ``s``."""
        for name in ("body", "orelse", "finalbody"):
            yield getattr(s, name, None) or []
        for part in [*getattr(s, "handlers", ()), *getattr(s, "cases", ())]:
            yield part.body

    def never_completes(self, body: list[ast.stmt]) -> bool:
        """Whether an entered loop body cannot end normally, so that its ``else`` does not run."""
        for s in body:
            if isinstance(s, ast.Continue):
                return False
            if isinstance(s, ast.If):
                known = self.truth(s.test)
                if known is not None:
                    return self.never_completes(s.body if known else s.orelse)
                return bool(s.orelse) and self.never_completes(s.body) and self.never_completes(s.orelse)
            if not isinstance(s, (*FUNCTIONS, ast.ClassDef)) and self.leaves(s):
                return True
        return False


def _count(node: ast.expr) -> int | None:
    """How many items a literal or a literal range yields, if that is known."""
    match node:
        case ast.List(elts=items) | ast.Tuple(elts=items) | ast.Set(elts=items) | ast.Dict(keys=items):
            return len(items)
        case ast.Constant(value=str(v)):
            return len(v)
        case ast.Call(func=ast.Name(id="range"), args=args) if 1 <= len(args) <= 3:
            numbers = [a.value if isinstance(a, ast.Constant) and type(a.value) is int else None for a in args]
            if None not in numbers and (len(numbers) < 3 or numbers[2]):
                return len(range(*numbers))
    return None


class DeadCode:
    """The statements that control never reaches: (line, column, symbol, scope, end line, end offset)."""

    def __init__(self, folder: Folder, source: str):
        self.folder, self.source, self.found = folder, source, []

    @cached_property
    def rows(self) -> list[str]:
        return self.source.splitlines()

    def of(self, tree: ast.Module) -> list[tuple]:
        self._block(tree.body, ())
        return self.found

    def _block(self, body: list[ast.stmt], scope: tuple[str, ...]) -> None:
        dead = False
        for s in body:
            if dead:
                self._add([s], scope)
            else:
                self._inside(s, scope)
                dead = self.folder.leaves(s)
        if not isinstance(body, list):
            body.exits = dead

    def _add(self, body: list[ast.stmt], scope: tuple[str, ...]) -> None:
        for s in body:
            end = (s.end_lineno, s.end_col_offset)
            if isinstance(s, (*FUNCTIONS, ast.ClassDef)):
                first = (s.body[0].lineno, s.body[0].col_offset)
                end = first if first > (s.lineno, s.col_offset) else end
            text = self.rows[s.lineno - 1].strip() if s.lineno <= len(self.rows) else ""
            text = text if len(text) <= 120 else text[:117] + "..."
            self.found.append((s.lineno, s.col_offset + 1, text, ".".join(scope) or "<module>", *end))

    def _inside(self, s: ast.stmt, scope: tuple[str, ...]) -> None:
        folder = self.folder
        if isinstance(s, (*FUNCTIONS, ast.ClassDef)):
            at, scope = len(self.found), (*scope, s.name)
            self._block(s.body, scope)
            if isinstance(s, FUNCTIONS) and len(self.found) > at:
                yields = list(_yields(s))
                if len(yields) == 1:  # it makes the function a generator
                    self.found[at:] = [d for d in self.found[at:] if (d[3], d[0]) != (".".join(scope), yields[0].lineno)]
        elif isinstance(s, ast.If | ast.While):
            known = folder.truth(s.test)
            if known is False:
                idiom = isinstance(s, ast.If) and isinstance(s.test, ast.Constant) and all(isinstance(x, ast.Import | ast.ImportFrom) for x in s.body)
                self._add([] if idiom else s.body, scope)
            else:
                self._block(s.body, scope)
            if known is True:
                self._add(s.orelse, scope)
            else:
                self._block(s.orelse, scope)
        elif isinstance(s, LOOPS):
            count = _count(s.iter)
            (self._add if count == 0 else self._block)(s.body, scope)
            skipped = bool(count) and folder.never_completes(s.body)
            (self._add if skipped else self._block)(s.orelse, scope)
        elif isinstance(s, TRIES):
            self._block(s.body, scope)
            for h in s.handlers:
                self._block(h.body, scope)
            (self._add if folder.exits(s.body) else self._block)(s.orelse, scope)
            self._block(s.finalbody, scope)
        elif isinstance(s, (*WITHS, ast.Match)):
            for body in folder.blocks(s):
                self._block(body, scope)


def _yields(node: ast.AST) -> Iterator[ast.AST]:
    """The yields that belong to this function itself."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (*FUNCTIONS, ast.Lambda, ast.ClassDef)):
            continue
        if isinstance(child, ast.Yield | ast.YieldFrom):
            yield child
        yield from _yields(child)


def inside(span: tuple, line: int, col: int) -> bool:
    """Whether a point lies in a dead statement; the end is exclusive."""
    return (span[0], span[1] - 1) <= (line, col) < (span[4], span[5])
