"""Planted cases: for every nation a small file or project that shows one behaviour.

A case is text: its source, in which ``{k}`` is the nation's key and lines that
begin with ``+`` or ``-`` are there for nations of even or of odd regions only,
and the rows that follow, written alike.  ``## path`` starts another file of a
project.  The rows are known from the rules alone, so the SQL below lists them
over the nations without seeing any source.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MANIFESTS = ["requirements.txt", "requirements-dev.txt", "pyproject.toml", "Pipfile", "setup.py", "setup.cfg"]


@dataclass(frozen=True)
class Case:
    """``view`` names what is looked at; ``rows`` are the lines it gives."""

    name: str
    view: str
    source: str
    rows: str


def _side(text: str, even: bool) -> str:
    """The lines of one kind of region."""
    mark, other = ("+", "-") if even else ("-", "+")
    kept = [x for x in text.strip("\n").split("\n") if not x.startswith(other)]
    return "\n".join(x[1:] if x.startswith(mark) else x for x in kept)


def _files(source: str, main: str) -> list[tuple[str, str]]:
    """(path, text) of a case's files; text before the first ``##`` is the file ``main``."""
    head, *rest = ("\n" + source).split("\n## ")
    parts = [(main, head.lstrip("\n"))] if head.strip() else []
    return parts + [tuple(x.split("\n", 1)) if "\n" in x else (x, "") for x in rest]


def sources(spark: SparkSession, sf_dir: str, cases: list[Case], projects: bool) -> DataFrame:
    """(project_id, path, source): a file in one project for each case and nation, or a project of files."""
    made = []
    for c in cases:
        for even in (True, False):
            for path, text in _files(_side(c.source, even), "main.py" if projects else "{k}.py"):
                made.append((c.name, even, path if projects else f"{c.name}/{path}", text + "\n"))
    table = spark.createDataFrame(made, "name string, even boolean, path string, source string")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (F.col("n_regionkey") % 2 == 0).alias("even"))
    rows = nation.join(F.broadcast(table), "even")
    filled = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("n_nationkey").cast("string"))
    project = F.concat_ws("_", "name", "n_nationkey") if projects else F.lit("cases")
    return rows.select(project.alias("project_id"), filled("path").alias("path"), filled("source").alias("source"))


def line(*expressions: str) -> Column:
    """One line of text for a row; nulls are empty."""
    return F.concat_ws("|", *(F.coalesce(F.expr(e).cast("string"), F.lit("")) for e in expressions)).alias("row")


def oracle(case: Case, projects: bool) -> str:
    """SQL for (place, row): the written rows for every nation."""
    values = []
    for x in case.rows.strip("\n").split("\n"):
        when = {"+": "1", "-": "0"}.get(x[:1], "NULL")
        text = (x[1:] if when != "NULL" else x).strip().replace("'", "''")
        values.append(f"('{text}', {when}::INT)")
    place = f"'{case.name}_' || n_nationkey" if projects else f"'{case.name}/' || n_nationkey || '.py'"
    return (
        f"SELECT {place} AS place, replace(r, '{{k}}', n_nationkey::VARCHAR) AS \"row\" FROM nation, (VALUES {', '.join(values)}) t(r, even) "
        "WHERE even IS NULL OR even = (n_regionkey % 2 = 0)::INT"
    )


def parse(text: str) -> list[Case]:
    """Cases written as ``=== name view``, source, ``---``, rows."""
    out = []
    for block in text.split("\n=== ")[1:]:
        head, body = block.split("\n", 1)
        name, view = head.split()
        source, rows = body.split("\n---\n")
        out.append(Case(name, view, source, rows))
    return out


def read(name: str) -> list[Case]:
    """The cases of a file of this package's ``planted`` folder."""
    return parse(Path(__file__).with_name("planted").joinpath(f"{name}.txt").read_text(encoding="utf-8"))
