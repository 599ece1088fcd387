"""A digest of a function's shape that local names, positions and docstrings do not change."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

from cinderbark.functions.control import dotted


def without_docstring(body: list[ast.stmt]) -> list[ast.stmt]:
    first = body[0] if body else None
    is_doc = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    return body[1:] if is_doc else body


def all_arguments(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *args.kwonlyargs, *(a for a in (args.vararg, args.kwarg) if a)]


class _Shape:
    """Writes statements out with local names numbered by their first appearance; all other names stay."""

    def __init__(self, local: set[str], first: list[str]):
        self.local, self.numbers = local, {n: k for k, n in enumerate(dict.fromkeys(first))}

    def of(self, x) -> str:
        kind = x.__class__
        if kind is list:
            return f"[{', '.join(map(self.of, x))}]"
        if kind is ast.Name:
            return f"Name(${self.numbers.setdefault(x.id, len(self.numbers))})" if x.id in self.local else f"Name({x.id!r})"
        fields = _FIELDS.get(kind)
        if fields is None:
            if not isinstance(x, ast.AST):
                return repr(x)
            left_out = ("decorator_list", "type_comment") if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) else ()
            fields = _FIELDS[kind] = [f for f in x._fields if f not in left_out]
        if kind is ast.arg:
            return "arg"
        return f"{kind.__name__}({', '.join([self.of(getattr(x, f, None)) for f in fields])})"


#: The fields of each kind of node that a shape has.
_FIELDS: dict[type, list[str]] = {}


def _stored(node: ast.AST) -> Iterator[str]:
    """The names that code below ``node`` binds by a store or as a caught exception."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.__class__ is ast.Name:
            if x.ctx.__class__ is ast.Store:
                yield x.id
            continue
        if x.__class__ is ast.ExceptHandler and x.name:
            yield x.name
        for f in x._fields:
            value = getattr(x, f, None)
            if value.__class__ is list:
                todo += [y for y in value if isinstance(y, ast.AST)]
            elif isinstance(value, ast.AST):
                todo.append(value)


def shape(node: ast.FunctionDef | ast.AsyncFunctionDef, least: int) -> tuple[str, int]:
    """(digest, statements); the digest is empty for bodies of fewer than ``least`` statements."""
    body = without_docstring(node.body)
    if len(body) < least:
        return "", len(body)
    a = node.args
    names = [x.arg for x in all_arguments(a)]
    local = {*names, *_stored(node)}
    writer = _Shape(local, names)
    parts = [
        type(node).__name__,
        repr((len(a.posonlyargs), len(a.args), len(a.kwonlyargs), a.vararg is not None, a.kwarg is not None, len(a.defaults))),
        repr([dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]),
        *map(writer.of, body),
    ]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest(), len(body)


def is_abstract(node: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    """No body of its own: an abstract decorator, or nothing but a docstring, ``pass``, ``...`` or NotImplementedError."""
    leaves = {dotted(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2] for d in node.decorator_list}
    if leaves & {"abstractmethod", "abstractproperty", "abstractclassmethod", "abstractstaticmethod"}:
        return True
    match without_docstring(node.body):
        case [] | [ast.Pass()]:
            return True
        case [ast.Expr(value=ast.Constant(value=v))]:
            return v is ...
        case [ast.Raise(exc=ast.AST() as exc)]:
            return dotted(exc.func if isinstance(exc, ast.Call) else exc).rpartition(".")[2] == "NotImplementedError"
    return False
