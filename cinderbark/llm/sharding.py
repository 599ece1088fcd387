"""Sharding by histogram sort: splitters from exact counts, then one exchange.

A document's key is 64 bits: ``HEAD`` bits of its text's hash, then bits of the
hash of its id and row.  Equal texts are neighbours, yet a group of copies larger
than a shard can still be divided.  To cut the key range into shards of equal
bytes, probes are laid into the interval of every open splitter; each task counts
the exact bytes and rows below them, the sums (a bounded number a splitter, and
one splitter less than shards) go to the driver, and the intervals shrink to
where the wanted byte count lies.  This repeats until every splitter is within
``TOLERANCE`` of a shard, or one row is left in its interval.  The rows are then
exchanged once, by ranges of (shard, key) that hold like numbers of rows whatever
their texts, and ordered there; a shard may cover many ranges, and its slots run
on from range to range.

Law: ``bytes``.  Shard sizes (UTF-8 bytes of the text plus 8 a row) are within
the tolerance of each other, or within one document if that is larger.

Results.  Null texts count as empty, with crc32 0; very long texts are measured
whole.  Null ids, ties and repeated rows are dealt like others; a row's place
depends on its file and position.  Other columns are ignored, whatever their
names.  Empty shards are possible when there are fewer rows than shards; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.llm.common import arrow_fields, cut, fresh, with_row_id

SHARDS = 24
TOLERANCE = 0.001
PROBES = 32
HEAD = 40
#: Bytes that a row has besides its text.
ROW_BYTES = 8
#: Rows that one task of the exchange orders, about.
RANGE_ROWS = 500_000

_COUNTS = "bucket int, bytes bigint, number bigint"


def _counter(probes: np.ndarray):
    """Bytes and rows of a task between neighbouring probes, one row for each bucket in use."""

    def count(batches):
        size, number = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            bucket = np.searchsorted(probes, key, side="right")
            number += np.bincount(bucket, minlength=len(number))
            np.add.at(size, bucket, b.column("size").to_numpy(zero_copy_only=False))
        used = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(size[used]), pa.array(number[used])], schema=arrow_fields(_COUNTS))

    return count


def _below(keyed: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe."""
    rows = keyed.select("key", "size").mapInArrow(_counter(probes), _COUNTS).groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("number").alias("number")).collect()
    size, number = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in rows:  # at most one a probe
        size[r["bucket"]], number[r["bucket"]] = r["bytes"], r["number"]
    return np.cumsum(size)[:-1], np.cumsum(number)[:-1]


def splitters(keyed: DataFrame, shards: int, total: int, number: int, slack: int, probes: int = PROBES) -> list[int]:
    """``shards - 1`` ascending keys with nearly equal bytes between them; a shard starts at its splitter."""
    want = [total * k // shards for k in range(1, shards)]
    low, high = [0] * len(want), [1 << 64] * len(want)
    found: list[int | None] = [None] * len(want)
    while True:
        open_ = [k for k, f in enumerate(found) if f is None]
        if not open_:
            return found
        lines = {low[k] + (high[k] - low[k]) * j // (probes + 1) for k in open_ for j in range(1, probes + 1)}
        lines |= {low[k] for k in open_} | {high[k] for k in open_}
        at = np.array(sorted(x for x in lines if x < 1 << 64), np.uint64)
        below, rows = _below(keyed, at)
        for k in open_:
            best = int(np.abs(below - want[k]).argmin())
            if abs(int(below[best]) - want[k]) <= slack:
                found[k] = int(at[best])
                continue
            after = int(np.searchsorted(below, want[k], side="right"))
            lo = int(at[after - 1]) if after else 0
            hi = int(at[after]) if after < len(at) else 1 << 64
            between = (int(rows[after]) if after < len(at) else number) - (int(rows[after - 1]) if after else 0)
            if between <= 1 or hi - lo <= 1:
                found[k] = int(at[best])
            low[k], high[k] = max(low[k], lo), min(high[k], hi)


def _shard_of(bounds: list[int]):
    """The shard of column ``key`` (an unsigned number in a long): how many bounds are not above it."""
    flip = 1 << 63
    rank = F.col("key").bitwiseXOR(F.lit(-flip))
    return sum((F.when(rank >= F.lit((x ^ flip) - (1 << 64) if x ^ flip >= flip else x ^ flip), 1).otherwise(0) for x in bounds), F.lit(0)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    (row,) = fresh(docs, "row_id")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    head = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 64 - HEAD), 64 - HEAD)
    keyed = with_row_id(docs.select("doc_id", "text"), row).select(
        head.bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id", row), HEAD)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col(row).alias("row"),
    )
    keyed = cut(keyed, "keyed")
    total, number = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    found = splitters(keyed, shards, total, number, max(1, int(tolerance * total / shards / 2))) if number else []
    # a range is a partition of the exchange; its rows' ids are its number and their place there
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number // range_rows))
    order = ["shard", F.col("key").bitwiseXOR(F.lit(-(1 << 63))), "doc_id", "row"]
    placed = keyed.withColumn("shard", _shard_of(sorted(found))).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("place")), "placed")
    part = F.shiftright("place", 33)
    counts = placed.groupBy("shard", part.alias("part")).agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range and one a shard's boundary: rows / RANGE_ROWS or so
    firsts = F.broadcast(counts.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift")))
    return placed.withColumn("part", part).join(firsts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
