"""Very long sources: statements that are parsed piece by piece, and rows that go to a file beyond a bound."""

from __future__ import annotations

import ast
import marshal
import re
import tempfile
from collections.abc import Iterator

#: Characters of a source from which it is read by pieces, and of one piece.
LONG, PIECE = 1 << 20, 1 << 18
#: Rows that a list keeps in memory, and the files that unique rows are dealt to beyond that.
HELD, BUCKETS = 10_000, 64
_LINE_END = re.compile(r"\r\n|\r|\n")
_START = r"(?:@|(?!(?:else|elif|except|finally)\b)[^\W\d])"


class Unsplit(Exception):
    """A block that pieces do not render; its file is parsed as a whole."""


def _parsed(text: str, before: int, head: str = "") -> ast.Module:
    """``text`` after ``before`` lines; ``head`` stands on the last of these."""
    if before <= 50 * (text.count("\n") + 1):
        return ast.parse("\n" * (before - (head != "")) + head + text, type_comments=True)
    try:
        return ast.increment_lineno(ast.parse(head + text, type_comments=True), before - (head != ""))
    except SyntaxError as e:
        e.lineno = e.lineno and e.lineno + before - (head != "")
        raise


class Statements:
    """The statements of ``source[start:end]``, which begins a line at the indentation ``indent``.

    A piece that parses alone ends outside any string or bracket, and the line after it begins a statement at the same
    indentation: then both sides mean what they mean together.  Only pieces are ever held as trees.
    """

    def __init__(self, source: str, start: int, end: int, before: int, indent: str = "", owner: ast.If | None = None):
        self.source, self.start, self.end, self.before, self.indent, self.owner = source, start, end, before, indent, owner
        self.starts = re.compile(rf"(?m)^{indent}{_START}")
        self.cuts: list[tuple[int, int, int]] = []
        self.blocks: dict[int, ast.If] = {}
        self.known = False
        self.exits: bool | None = None

    def __iter__(self) -> Iterator[ast.stmt]:
        for start, end, before in self.cuts if self.known else self._cut():
            if start in self.blocks:
                yield self.blocks[start]
            elif self.known:
                yield from self._body(_parsed(self.source[start:end], before, "if 1:\n" if self.indent else ""))
            else:
                yield from self.fresh
        if not self.known and self.owner is not None:
            self.owner.end_lineno, self.owner.end_col_offset = self.last
        self.known, self.fresh = True, []

    def _body(self, tree: ast.Module) -> list[ast.stmt]:
        if not self.indent:
            return tree.body
        if len(tree.body) != 1 or tree.body[0].orelse:
            raise Unsplit
        return tree.body[0].body

    def _cut(self) -> Iterator[tuple[int, int, int]]:
        """The pieces; ``fresh`` has the statements of the last."""
        at, before = self.start, self.before
        while at < self.end:
            stop = self._after(at + PIECE)
            if stop - at > 4 * PIECE:
                near = [m.start() for m in self.starts.finditer(self.source, at + 1, min(at + PIECE, self.end))]
                stop = near[-1] if near else stop
                if not near and (block := self._block(at, stop, before)) is not None:
                    self.blocks[at] = block
                    self.cuts.append((at, stop, before))
                    yield self.cuts[-1]
                    self.last = block.end_lineno, block.end_col_offset
                    at, before = stop, before + self._lines(at, stop)
                    continue
            while True:
                try:
                    self.fresh = self._body(_parsed(self.source[at:stop], before, "if 1:\n" if self.indent else ""))
                    break
                except SyntaxError:
                    if stop >= self.end:
                        if self.indent:
                            raise Unsplit from None
                        raise
                    stop = self._after(max(stop + 1, 2 * stop - at))
            self.cuts.append((at, stop, before))
            if self.fresh:
                self.last = self.fresh[-1].end_lineno, self.fresh[-1].end_col_offset
            yield self.cuts[-1]
            at, before = stop, before + self._lines(at, stop)

    def _after(self, at: int) -> int:
        """The first line from ``at`` on that may begin a statement."""
        found = self.starts.search(self.source, at, self.end) if at < self.end else None
        return found.start() if found else self.end

    def _lines(self, start: int, stop: int) -> int:
        return sum(1 for _ in _LINE_END.finditer(self.source, start, stop)) if "\r" in self.source[start:stop] else self.source.count("\n", start, stop)

    def _block(self, at: int, stop: int, before: int) -> ast.If | None:
        """The one ``if`` of ``source[at:stop]`` with a body that is read by pieces, or None for anything else."""
        first = re.compile(rf"(?m)^({self.indent}[ \t]+)\S").search(self.source, at, stop)
        if first is None:
            return None
        head = self.source[at : first.start()]
        try:
            body = self._body(_parsed(f"{head}{first[1]}pass\n", before, "if 1:\n" if self.indent else ""))
        except (SyntaxError, Unsplit):
            return None
        match body:
            case [ast.If(body=[ast.Pass()], orelse=[]) as node]:
                node.body = Statements(self.source, first.start(), stop, before + self._lines(at, first.start()), first[1], node)
                return node
        return None


def read(source: str) -> ast.Module:
    """The tree of a source; the statements of a long one are a ``Statements``."""
    if len(source) <= LONG or "\f" in source:
        return ast.parse(source, type_comments=True)
    return ast.Module(Statements(source, 0, len(source), 0), [])


def walk(tree: ast.Module) -> Iterator[ast.AST]:
    """All nodes below ``tree``, those of pieces too."""
    if not isinstance(tree.body, Statements):
        yield from ast.walk(tree)
        return
    for s in tree.body:
        yield from walk(s) if isinstance(getattr(s, "body", None), Statements) else ast.walk(s)


class Spool:
    """Tuples of plain values in order; all but the last go to a temporary file beyond a bound."""

    def __init__(self):
        self.rows, self.file, self.batches = [], None, 0

    def append(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= HELD:
            self.file = self.file or tempfile.TemporaryFile()
            marshal.dump(self.rows, self.file)
            self.batches, self.rows = self.batches + 1, []

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            self.file.seek(0)
            for _ in range(self.batches):
                yield from marshal.load(self.file)
            self.file.seek(0, 2)
        yield from self.rows


    def result(self):
        """A list, or where rows went to a file this."""
        return self if self.file else self.rows


class Unique:
    """Tuples of plain values without repeats; beyond a bound dealt to files, whose order they then have."""

    def __init__(self):
        self.rows: dict[tuple, None] = {}
        self.files: list = []

    def add(self, row: tuple) -> None:
        self.rows[row] = None
        if len(self.rows) >= HELD:
            self._spill()

    def _spill(self) -> None:
        dealt = [[] for _ in range(BUCKETS)]
        for row in self.rows:
            dealt[hash(row) % BUCKETS].append(row)
        self.files = self.files or [[tempfile.TemporaryFile(), 0] for _ in range(BUCKETS)]
        for held, rows in zip(self.files, dealt):
            if rows:
                marshal.dump(rows, held[0])
                held[1] += 1
        self.rows = {}

    def result(self):
        """A list, or where rows went to files something that gives them one by one."""
        if not self.files:
            return list(self.rows)
        self._spill()
        return self._read()

    def _read(self) -> Iterator[tuple]:
        for file, batches in self.files:
            file.seek(0)
            yield from dict.fromkeys(row for _ in range(batches) for row in marshal.load(file))
