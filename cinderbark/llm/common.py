"""Helpers that the training-data operators share.

* ``cut`` ends lineage with a Parquet table in the shared folder that the
  cluster names in ``spark.checkpoint.dir``, so a lost executor costs a reread
  and not a recomputation.
* ``with_row_id`` gives rows an identity that survives retries, for inputs in
  which ``doc_id`` may repeat or be null, and however the input was made.
* ``heavy_join`` looks keys up without sending all rows of a hot key to one task.
* ``fresh`` finds column names that the input does not use.
* ``slices`` bounds what a Python worker holds of a batch of texts.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.session import cut, new_folder

__all__ = ["arrow_fields", "cut", "fresh", "heavy_join", "hot_keys", "new_folder", "slices", "strip_spaces", "with_row_id"]

#: Deletes ASCII white space, as ``[\x20\x09-\x0D]`` has it.
SPACES = [" ", "\t", "\n", "\x0b", "\f", "\r"]

def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def _rows_of_files(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a file: one file table below projections and filters only."""
    plan = df._jdf.queryExecution().analyzed()
    while True:
        name = plan.getClass().getSimpleName()
        if name not in ("Project", "Filter", "SubqueryAlias", "View", "LogicalRelation") or not plan.deterministic():
            return False
        if name == "LogicalRelation":
            relation = plan.relation()
            if relation.getClass().getSimpleName() != "HadoopFsRelation" or "ParquetFileFormat" not in relation.fileFormat().getClass().getName():
                return False
            paths = relation.location().rootPaths()
            return paths.distinct().size() == paths.size()
        plan = plan.children().head()


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` and a column ``name`` that tells rows apart, in every run alike.

    Rows of a Parquet table have their file and their place in it, also after
    projections and filters.  Any other input (joins, unions, generators, Python
    steps, one file read twice) may hold a file's row more than once; it is
    written to the shared folder first.
    """
    made = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    clash = [c for c in df.columns if c.lower() == "_metadata"]
    if not clash and _rows_of_files(df):
        return df.select("*", made.alias(name))
    void = [c for c, kind in df.dtypes if kind == "void"]
    hidden = dict(zip(clash, fresh(df, "metadata_column")))
    out = cut(df.withColumns({c: F.col(c).cast("string") for c in void}).withColumnsRenamed(hidden), "rows")
    return out.select("*", made.alias(name)).withColumnsRenamed({b: a for a, b in hidden.items()})


def hot_keys(table: DataFrame, key: str, tracked: int = 1024, least: int = 256) -> DataFrame:
    """At most ``tracked`` values of ``key`` with some ``least`` rows or more (a Misra-Gries pass), as a written table."""
    top = table.selectExpr(f"approx_top_k({key}, {tracked}, {4 * tracked}) AS top").select(F.explode("top").alias("t"))
    return cut(top.filter(F.col("t.count") >= least).select(F.col("t.item").alias(key)), "hot")


def heavy_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with the row of ``right`` of the same ``key``, of which ``right`` has one at most.

    The rows of ``right`` of hot keys (at most as many as ``hot_keys`` tracks)
    are broadcast, so rows of a hot key stay where they are.  All others go by an
    ordinary shuffle.  Both sides are read more than once and should be tables.
    """
    hot = F.broadcast(hot_keys(left, key) if hot is None else hot)
    large = left.join(F.broadcast(right.join(hot, key, "left_semi")), key)
    small = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key)
    return large.unionByName(small)


def strip_spaces(text):
    """``text`` without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


ROW = "struct<f:bigint,r:bigint>"


def arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of the few SQL types that the operators exchange."""
    if kind.startswith("array<"):
        return pa.list_(arrow_type(kind[6:-1]))
    if kind == ROW:
        return pa.struct([("f", pa.int64()), ("r", pa.int64())])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]


def arrow_fields(schema: str) -> pa.Schema:
    """The Arrow schema of ``name type, name type``; works without a session."""
    return pa.schema([(name, arrow_type(kind)) for name, kind in (x.split(" ") for x in schema.split(", "))])


#: Bytes of text that a Python worker takes from a batch at once; a longer text comes alone.
SLICE = 1 << 20


def slices(batches, column: str = "text"):
    """``batches`` in runs of rows with some ``SLICE`` bytes of ``column``, without a copy."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(ends.searchsorted(before + SLICE, "right")))
            yield b.slice(at, end - at)
            at = end
