"""Session helpers: the shared folder, tables that end lineage, and loops that run to a fixpoint."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []

#: For tables with very long rows: a reader takes thousands of records of a row group at once.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only for a local master without that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cinderbark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` is ``value`` for what is planned meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a reread, no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """``seeds`` and all that ``step`` makes of new rows, until nothing is new (semi-naive rounds)."""
    known = frontier = cut(seeds.select(*keys).distinct(), "known")
    while not frontier.isEmpty():
        frontier = cut(step(frontier).select(*keys).distinct().join(known, keys, "left_anti"), "frontier")
        known = known.unionByName(frontier)
    return cut(known, "closed")
