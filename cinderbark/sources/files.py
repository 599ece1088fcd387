"""Python sources and manifests as tables (project_id, path, source)."""

from __future__ import annotations

import codecs
import io
import tokenize

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbark.functions import vocabulary as V
from cinderbark.functions.globs import any_regex, rules_of
from cinderbark.plans.config import Config
from cinderbark.session import cut


def decode(raw: bytes) -> str:
    """Text by byte-order mark and coding cookie; raises SyntaxError or UnicodeDecodeError."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(raw).readline)
    return codecs.decode(raw, encoding)


def _listed(spark: SparkSession, root: str) -> list[tuple[str, str, int]]:
    """(path, text, modified) of files below ``root`` that Spark's reader passes over: empty ones and ignore files."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, out = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/", []
    found = fs.listFiles(top, True)
    while found.hasNext():
        f = found.next()
        path = f.getPath().toUri().getPath().removeprefix(base)
        if path.rpartition("/")[2] == ".gitignore" or path == ".git/info/exclude":
            stream = fs.open(f.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            out.append((path, text, f.getModificationTime()))
        elif f.getLen() == 0 and not any(p.startswith(".") for p in path.split("/")):
            out.append((path, "", f.getModificationTime()))
    return out


def read_tree(spark: SparkSession, root: str, project_id: str = "") -> DataFrame:
    """All files below ``root`` that a scan may need, as bytes: project_id, path, content, length, modified.

    Contents are read on the executors; the driver lists the tree, as it does for any file source.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = found.select(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("full"), "content", "length", "modificationTime")
    top = root.split("://")[-1].rstrip("/") + "/"
    read = base.select(
        F.lit(project_id).alias("project_id"),
        F.expr(f"substring(full, {len(top) + 1})").alias("path"),
        "content",
        "length",
        F.col("modificationTime").alias("modified"),
    )
    rest = spark.createDataFrame(_listed(spark, root), "path string, text string, at long")
    rest = rest.select(F.lit(project_id).alias("project_id"), "path", F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"), F.timestamp_millis("at").alias("modified"))
    return read.join(rest.select("path"), "path", "left_anti").select(rest.columns).unionByName(rest)


_RULES = "project_id string, folder string, source string, depth int, number int, regex string, negated boolean"


def _ignore_rules(ignores: DataFrame) -> DataFrame:
    """One row for each line of the ignore files; those of the repository's own exclude file come after the root's."""

    def run(batches):
        for b in batches:
            rows = []
            for project, path, text in zip(*(b.column(n).to_pylist() for n in ("project_id", "path", "text"))):
                own = path == ".git/info/exclude"
                folder = "" if own else path.rpartition("/")[0]
                depth = 1 if own else 2 * (folder.count("/") + 1) if folder else 0
                rows += [(project, folder, path, depth, k, regex, negated) for k, (regex, negated) in enumerate(rules_of(folder, text or ""))]
            fields = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, fields)], names=[x.split()[0] for x in _RULES.split(", ")])

    return ignores.select("project_id", "path", "text").mapInArrow(run, _RULES)


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(project_id, path) that the rules drop: of a project's rules for a path's folders the last that matches wins."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    at = paths.select("project_id", "path").distinct().withColumn("folder", F.explode(folders))
    met = at.join(rules, ["project_id", "folder"]).filter(F.expr("path RLIKE regex"))
    last = met.groupBy("project_id", "path").agg(F.max_by("negated", F.struct("depth", "source", "number")).alias("negated"))
    return last.filter("NOT negated").select("project_id", "path")


def project_files(files: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(sources, manifests) of trees: without excluded and git-ignored paths, decoded.

    Each project's ignore files rule its own paths; one that lies in an ignored folder is not read.
    """

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return decode(bytes(raw))
            except (SyntaxError, UnicodeDecodeError, LookupError):
                return None

        return content.map(one)

    kept = files.filter(~F.col("path").rlike(any_regex(config.exclude)))
    lists = kept.filter(F.col("path").rlike(r"(^|/)\.gitignore$")).unionByName(files.filter(F.col("path") == ".git/info/exclude")).dropDuplicates(["project_id", "path"])
    rules = _ignore_rules(lists.select("project_id", "path", F.col("content").cast("string").alias("text")))
    unread = ignored(lists, rules).select("project_id", F.col("path").alias("source"))
    rules = cut(rules.join(unread, ["project_id", "source"], "left_anti"), "ignore_rules")
    kept = kept.join(ignored(kept, rules), ["project_id", "path"], "left_anti")
    name = F.element_at(F.split("path", "/"), -1)
    skipped = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda d: d.isin(V.MANIFEST_SKIP_DIRS) | d.endswith(".egg-info"))
    columns = ["project_id", "path", text("content").alias("source"), "length", "modified"]
    return kept.filter(F.col("path").endswith(".py")).select(*columns), kept.filter(name.isin(V.MANIFESTS) & ~skipped).select(*columns)


def with_overlays(sources: DataFrame, overlays: DataFrame) -> DataFrame:
    """Unsaved texts (project_id, path, text) replace those of files and add new ones."""
    new = overlays.select("project_id", "path", F.col("text").alias("unsaved"))
    return sources.select("project_id", "path", "source").join(new, ["project_id", "path"], "full").select("project_id", "path", F.coalesce("unsaved", "source").alias("source"))


def changed_only(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on paths that changed (project_id, path)."""
    return findings.join(changed.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")
