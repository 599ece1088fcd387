"""Exact deduplication by a heavy-hitter split (DataFrame functions only).

A Misra-Gries pass (Spark's frequent-items sketch behind ``approx_top_k``) over
the digests finds every digest that could hold more than ``1/tracked`` of the
rows.  Their exact counts and winners are computed with map-side partial
aggregation, and the verified winners (at most ``candidates`` rows, so of
bounded size) are broadcast: rows of a heavy group are decided where they lie.
All other digests go through an ordinary shuffle: their groups are aggregated
map-side first, and the winners of groups of two and more are joined back, a
join whose large keys adaptive execution can split.  No task holds a group.

Results
-------
Texts are equal if they are identical without ``[\\x20\\x09-\\x0D]``; null
counts as empty, so null, empty and blank texts are one group.  The row with the
most code points in its original text stays, then the smallest ``doc_id`` (null
ids last), then the earliest row; of wholly repeated rows exactly one stays.
Very long texts are hashed whole, as expressions of the scan.  An empty table
gives an empty result.  Other columns are ignored (``exact_dedup``) or carried
(``keep_first``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.llm.common import cut, fresh, strip_spaces, with_row_id

#: Digests that the sketch keeps, and of these the most frequent that are verified.
TRACKED = 4096
CANDIDATES = 1024
#: A verified digest with fewer rows than this takes the ordinary way.
LEAST_HEAVY = 64


def digests(docs: DataFrame, row: str) -> DataFrame:
    """One narrow row for each document: ``row``, doc_id, text_sha256, points."""
    return docs.select(
        F.col(row).alias("row"),
        "doc_id",
        F.sha2(F.encode(strip_spaces(F.col("text")), "UTF-8"), 256).alias("text_sha256"),
        F.coalesce(F.length("text"), F.lit(0)).alias("points"),
    )


def _rank():
    """The order in a group: the smallest stays."""
    return F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "row")


def heavy_digests(narrow: DataFrame, tracked: int = TRACKED, candidates: int = CANDIDATES, least: int = LEAST_HEAVY) -> DataFrame:
    """Verified heavy digests with their winner and exact count; at most ``candidates`` rows."""
    found = narrow.selectExpr(f"approx_top_k(text_sha256, {candidates}, {tracked}) AS top").select(F.explode("top.item").alias("text_sha256"))
    return (
        narrow.join(F.broadcast(found), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min(_rank()).alias("win"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= least)
    )


def _decide(narrow: DataFrame, tracked: int, candidates: int, least: int) -> DataFrame:
    heavy = cut(heavy_digests(narrow, tracked, candidates, least), "heavy")
    kept = ["row", "doc_id", "text_sha256", F.col("win.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("win.row")).alias("kept")]
    large = narrow.join(F.broadcast(heavy), "text_sha256").select(*kept)
    rest = narrow.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.min(_rank()).alias("win"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    own = F.col("win").isNull()
    small = rest.join(groups, "text_sha256", "left").select(
        "row",
        "doc_id",
        "text_sha256",
        F.when(own, F.col("doc_id")).otherwise(F.col("win.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("row") == F.col("win.row"))).alias("kept"),
    )
    return large.unionByName(small)


def exact_dedup(docs: DataFrame, tracked: int = TRACKED, candidates: int = CANDIDATES, least: int = LEAST_HEAVY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    (row,) = fresh(docs, "row_id")
    narrow = cut(digests(with_row_id(docs.select("doc_id", "text"), row), row), "digests")
    return _decide(narrow, tracked, candidates, least).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, tracked: int = TRACKED, candidates: int = CANDIDATES, least: int = LEAST_HEAVY) -> DataFrame:
    """The documents that stay, with all of their columns."""
    (row,) = fresh(docs, "row_id")
    whole = with_row_id(docs, row)
    narrow = cut(digests(whole, row), "digests")
    lost = _decide(narrow, tracked, candidates, least).filter(~F.col("kept")).select(F.col("row").alias(row))
    return whole.join(lost, row, "left_anti").drop(row)
