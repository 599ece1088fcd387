"""Sources to facts: the one Python step of a scan, and typed views of its result."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cinderbark.functions.extract import FACTS_VERSION, Settings, facts
from cinderbark.plans.config import Config
from cinderbark.plans.schemas import FACTS

SEP = "\x1f"
#: Items that each list of a record has at most; a file with more has several records, numbered by ``piece``.
PIECE = 20_000
#: Items, and records, that are handed to Spark at once.
BATCH, RECORDS = 20_000, 1_000


def backend(source: str, settings: Settings) -> dict:
    """The default indexer; any callable of this form can replace it."""
    return facts(source, settings)


def index(sources: DataFrame, config: Config, index_source=backend) -> DataFrame:
    """Fact records of each file, more than one only for very long files; a file that cannot be parsed has ``error`` and
    its ``words`` instead."""
    settings = Settings(dict(config.fold), config.duplicate_min_statements, config.directive_word)
    schema = to_arrow_schema(sources.sparkSession.createDataFrame([], FACTS).schema)
    lists = [f.name for f in schema if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type)]

    def record(project: str, path: str, source: str | None) -> dict:
        row = {"project_id": project, "path": path}
        try:
            if source is None:
                raise SyntaxError("the file cannot be decoded")
            row |= index_source(source, settings)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            row["error"] = {"line": getattr(e, "lineno", None) or 1, "column": getattr(e, "offset", None) or 1, "message": getattr(e, "msg", None) or str(e)}
            row["words"] = sorted({m[0].lower() for m in re.finditer(r"\w+", source)}) if source is not None else None
        return row

    def run(batches):
        rows, items = [], 0
        gc.disable()  # trees have no circles, but looking for some takes half of the time
        gc.collect()
        gc.freeze()  # what modules hold is looked at no more
        try:
            for b in batches:
                columns = [b.column(n) for n in ("project_id", "path", "source")]
                for k in range(b.num_rows):
                    for row in pieces(record(*(c[k].as_py() for c in columns)), lists):
                        rows.append(row)
                        items += sum(len(row.get(n) or ()) for n in lists)
                        if items >= BATCH or len(rows) >= RECORDS:
                            yield _batch(rows, schema)
                            rows, items = [], 0
                            if not row["piece"]:
                                gc.collect()
                    if row["piece"]:  # the names and scopes of a long file go before the next is read
                        gc.collect()
            if rows:
                yield _batch(rows, schema)
        finally:
            gc.unfreeze()
            gc.enable()

    return sources.select("project_id", "path", "source").mapInArrow(run, FACTS)


def pieces(row: dict, lists: list[str]) -> Iterator[dict]:
    """``row`` as records whose ``lists`` have at most ``PIECE`` items; what is no such list is in the first."""
    rest = {n: iter(row[n]) for n in lists if row.get(n) is not None}
    out, number = row, 0
    while True:
        parts = {n: list(islice(r, PIECE)) for n, r in rest.items()}
        if number and not any(parts.values()):
            return
        yield out | parts | {"piece": number}
        if not any(len(p) == PIECE for p in parts.values()):
            return
        out, number = {"project_id": row["project_id"], "path": row["path"]}, number + 1


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as Arrow has them; lists of tuples go column by column."""
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        at, offsets = 0, []
        for v in values:
            offsets.append(None if v is None else at)
            at += len(v or ())
        flat = list(chain.from_iterable(v for v in values if v is not None))
        if all(type(x) is tuple and len(x) == kind.value_type.num_fields for x in flat):
            fields = list(kind.value_type)
            parts = list(zip(*flat)) if flat else [()] * len(fields)
            inner = pa.StructArray.from_arrays([_column(list(p), f.type) for p, f in zip(parts, fields)], fields=fields)
            return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), inner, type=kind)
    return pa.array([_shaped(v, kind) for v in values], kind)


def _shaped(value, kind: pa.DataType):
    """Tuples become the struct that ``kind`` wants."""
    if value is None or not pa.types.is_nested(kind):
        return value
    if pa.types.is_list(kind):
        return [_shaped(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind) and not isinstance(value, dict):
        return {f.name: _shaped(v, f.type) for f, v in zip(kind, value)}
    return value


def stamp(config: Config):
    """Column: the key under which a file's facts may be reused (size, time, settings, version)."""
    fold = ",".join(f"{k}={v}" for k, v in sorted(config.fold.items()))
    return F.sha2(F.concat_ws("|", "length", F.col("modified").cast("string"), F.lit(fold), F.lit(config.duplicate_min_statements), F.lit(config.directive_word), F.lit(FACTS_VERSION)), 256)


def index_changed(files: DataFrame, stored: DataFrame | None, config: Config, index_source=backend) -> DataFrame:
    """Facts with their stamp: reused where a stored record has the file's stamp, made anew elsewhere.

    Records of files that are gone are dropped.
    """
    stamped = files.withColumn("stamp", stamp(config))
    keys = ["project_id", "path", "stamp"]
    if stored is None:
        fresh = stamped
    else:
        fresh = stamped.join(stored.select(*keys), keys, "left_anti")
    new = index(fresh, config, index_source).join(fresh.select(*keys), ["project_id", "path"])
    return new if stored is None else stored.join(stamped.select(*keys), keys, "left_semi").unionByName(new.select(*stored.columns))


class Facts:
    """Typed views of indexed files.  ``sym`` names a symbol: project, path and qualname."""

    def __init__(self, table: DataFrame):
        self.table = table if "piece" in table.columns else table.withColumn("piece", F.lit(0))
        good = self.table.filter("error IS NULL")
        self.files = good.filter("piece = 0").select("project_id", "path", "has_main_guard", "exports", "import_probes", "lambda_mentions", "module_sweeps", "dynamic_imports", "module_strings", "abstract", "unbound_names")
        self.good = good

    def each(self, column: str) -> DataFrame:
        """The rows of a nested column with their file and their place ``ord``."""
        out = self.good.select("project_id", "path", "piece", F.posexplode(column).alias("ord", "item"))
        out = out.withColumn("ord", (F.col("ord") + F.col("piece") * PIECE).cast("int")).drop("piece")
        kind = dict(out.dtypes)["item"]
        return out.select("project_id", "path", "ord", "item.*") if kind.startswith("struct") else out.withColumnRenamed("item", "value")

    def bindings(self) -> DataFrame:
        return self.each("bindings").withColumn("sym", sym("qualname"))

    def errors(self) -> DataFrame:
        return self.table.filter("error IS NOT NULL").select("project_id", "path", "error.*")


def sym(*parts: str):
    """The symbol key of a qualname in this row's file."""
    return F.concat_ws(SEP, "project_id", "path", F.concat_ws(".", *parts))
