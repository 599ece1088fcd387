"""Incremental scans: a stream of changed files keeps a fact store current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinderbark.operators.index import index
from cinderbark.plans.config import Config
from cinderbark.plans.schemas import FACTS

#: A file's new text; a null source means that the file is gone.
CHANGES = "project_id string, path string, source string, version bigint"


def merged(store: DataFrame | None, changes: DataFrame, config: Config) -> DataFrame:
    """The store's facts with those of changed files in place of the old; the latest version of a file counts."""
    w = Window.partitionBy("project_id", "path").orderBy(F.desc("version"))
    last = changes.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    new = index(last.filter("source IS NOT NULL"), config)
    if store is None:
        return new
    return store.join(last.select("project_id", "path"), ["project_id", "path"], "left_anti").unionByName(new)


class FactStore:
    """Facts in a folder, one subfolder a generation; readers see the last complete one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not self._fs.exists(path):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(path)]
        done = [int(n[1:]) for n in names if n[1:].isdigit() and self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return max(done, default=-1)

    def read(self) -> DataFrame | None:
        n = self.generation()
        return None if n < 0 else self.spark.read.schema(FACTS).parquet(f"{self.folder}/g{n}")

    def update(self, changes: DataFrame, config: Config) -> None:
        """Write the next generation.  Facts are the same whatever the number of batches, so a repeated batch changes nothing."""
        merged(self.read(), changes, config).write.mode("overwrite").parquet(f"{self.folder}/g{self.generation() + 1}")


def watch(changes: DataFrame, store: FactStore, config: Config, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep ``store`` current with a streaming table of changes; ``then(facts, batch)`` runs after each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            store.update(rows, config)
            if then:
                then(store.read(), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
