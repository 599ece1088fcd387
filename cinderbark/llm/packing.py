"""Sequence packing by non-negative least squares over a length histogram.

A document's ids (with the closing id) are cut into full windows and one rest;
rests stay whole.  Rest lengths are rounded up to units of ``UNIT`` tokens, and
the histogram of units, which has at most ``window / UNIT`` entries however
large the corpus, goes to the driver.  There

1. all combinations of at most ``DEPTH`` units that fill the window exactly are
   enumerated;
2. non-negative least squares gives the repeat count of each combination that
   consumes the histogram;
3. counts are rounded down, and what remains of the histogram is packed
   greedily, longest first with the largest that still fits.

The plan is a short list of (units, repeats).  Pieces find their place without
meeting each other: a piece's rank among those of its unit (its rank in its
task plus what earlier tasks counted) names a repetition of a combination.  One
narrow shuffle by sequence then adds up offsets.

Results.  Null and empty texts have the closing id alone.  Repeated rows and
null ids are packed like others.  An empty table gives an empty result.  Each
id lies in exactly one piece; padding is at most ``UNIT - 1`` tokens a piece
besides the last, greedy sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbark.llm.common import arrow_fields, cut
from cinderbark.llm.tokens import word_bpe

WINDOW = 2048
UNIT = 8
DEPTH = 3
CLOSING_ID = 1

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, unit int, place bigint"
_PIECES_IDS = _PIECES + ", ids binary"


# --- plan -------------------------------------------------------------------


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """All descending tuples of 1 to ``depth`` positive numbers that add up to ``total``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            slots = depth - len(head)
            for x in range(min(left, most), (left - 1) // slots, -1):
                grow((*head, x), left - x, x)

    grow((), total, total)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises ``|a x - b|``, by the active-set method."""
    x = np.zeros(a.shape[1])
    resid, scale = b.astype(float), max(1.0, float(np.abs(b).max(initial=0)))
    cols, part, gram, goal = np.zeros(0, int), a[:, :0], np.zeros((0, 0)), np.zeros(0)
    at = np.flatnonzero(a.T)
    where, by = at // a.shape[0], at % a.shape[0]
    weight = a.T.ravel()[at]
    for _ in range(rounds or 3 * a.shape[0]):
        grad = np.bincount(where, weight * resid[by], minlength=len(x))
        grad[cols] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= 1e-9 * scale:
            break
        edge = part.T @ a[:, j]
        gram = np.block([[gram, edge[:, None]], [edge[None, :], np.array([[a[:, j] @ a[:, j] + 1e-10]])]])
        cols, part, goal = np.append(cols, j), np.column_stack([part, a[:, j]]), np.append(goal, a[:, j] @ b)
        while True:
            s = np.linalg.solve(gram, goal)
            if s.min(initial=1) > 0:
                break
            bad, old = s <= 0, x[cols]
            step = (old[bad] / np.maximum(old[bad] - s[bad], 1e-300)).min()
            x[cols] = old + step * (s - old)
            gone = bad & (x[cols] <= 1e-12 * scale)
            gone = gone if gone.any() else bad
            x[cols[gone]] = 0.0
            cols, part, goal, gram = cols[~gone], part[:, ~gone], goal[~gone], gram[np.ix_(~gone, ~gone)]
        x[cols] = s
        resid = b - part @ s
    return x


def greedy(hist: np.ndarray, total: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack what ``hist`` (count by units) holds: the longest first, then the largest that fits."""
    hist, out = hist.copy(), []
    while hist.any():
        left, used, most = total, {}, total
        while left:
            most = min(most, left)
            have = [u for u in range(most, 0, -1) if hist[u] > used.get(u, 0)]
            if not have:
                break
            u = have[0]
            take = min(left // u, int(hist[u]) - used.get(u, 0))
            used[u] = used.get(u, 0) + take
            left, most = left - take * u, u - 1
        times = min(int(hist[u]) // k for u, k in used.items())
        for u, k in used.items():
            hist[u] -= times * k
        out.append((tuple(u for u, k in sorted(used.items(), reverse=True) for _ in range(k)), times))
    return out


def plan(hist: np.ndarray, total: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(units, repeats) that consume ``hist``, where ``hist[u]`` counts rests of u units."""
    hist = np.asarray(hist, np.int64)
    out = [((total,), int(hist[total]))] if hist[total] else []
    rest = hist.copy()
    rest[total] = 0
    combos = [c for c in combinations(total, depth) if all(rest[u] for u in c)]
    if combos:
        a = np.zeros((total, len(combos)))
        for k, c in enumerate(combos):
            for u in c:
                a[u - 1, k] += 1
        x = np.floor(nonnegative_least_squares(a, rest[1:].astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            times = min([int(x[k])] + [int(rest[u]) // combos[k].count(u) for u in set(combos[k])])
            if times > 0:
                out.append((combos[k], times))
                for u in combos[k]:
                    rest[u] -= times
    return out + greedy(rest, total)


def places(planned: list[tuple[tuple[int, ...], int]], total: int) -> dict[int, np.ndarray]:
    """For each unit: rows (first rank, copies in the combination, first sequence, first slot)."""
    out: dict[int, list] = {u: [] for u in range(1, total + 1)}
    taken = dict.fromkeys(out, 0)
    sequence = 0
    for units, times in planned:
        for u in dict.fromkeys(units):
            k = units.count(u)
            out[u].append((taken[u], k, sequence, units.index(u)))
            taken[u] += k * times
        sequence += times
    return {u: np.array(v, np.int64).reshape(-1, 4) for u, v in out.items() if v}


# --- operator ---------------------------------------------------------------


def _cutter(path: str, window: int, unit: int, with_ids: bool):
    def cut_up(batches):
        fields, encoder = arrow_fields(_PIECES_IDS if with_ids else _PIECES), word_bpe(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(window // unit + 1, np.int64)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                rows: list[list] = [[] for _ in fields]
                for doc_id, ids in zip(doc_ids[at : at + 512], encoder.ids(texts[at : at + 512])):
                    ids += closing
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        u = -(-len(piece) // (4 * unit))
                        for column, value in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total, task, u, int(seen[u]), piece)):
                            column.append(value)
                        seen[u] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, fields)], schema=fields)

    return cut_up


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``with_ids`` adds their ids (little-endian unsigned 32 bits)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cutter(tokenizer, window, unit, with_ids), _PIECES_IDS if with_ids else _PIECES)


_PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, unit int, place bigint, sequence_id bigint, slot bigint"


def _placer(table: dict[int, np.ndarray]):
    def place(batches):
        fields = arrow_fields(_PLACED)
        for b in batches:
            unit = b.column("unit").to_numpy()
            rank = b.column("place").to_numpy() + b.column("earlier").to_numpy()
            sequence, slot = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
            for u in np.unique(unit).tolist():
                at = np.flatnonzero(unit == u)
                rows = table[u]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                local = rank[at] - row[:, 0]
                sequence[at], slot[at] = row[:, 2] + local // row[:, 1], row[:, 3] + local % row[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in fields.names[:8]] + [pa.array(sequence), pa.array(slot)], schema=fields)

    return place


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` also returns each piece's ids, for writing sequences out.
    """
    made = cut(pieces(docs, tokenizer, window, unit, with_ids), "pieces")
    counts = cut(made.groupBy("unit", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    hist = np.zeros(window // unit + 1, np.int64)
    for r in counts.groupBy("unit").agg(F.sum("n").alias("n")).collect():  # at most window / unit rows
        hist[r["unit"]] = r["n"]
    table = places(plan(hist, window // unit, depth), window // unit)
    before = Window.partitionBy("unit").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("unit", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = made.drop("ids").join(earlier, ["unit", "task"])
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "unit", "place", "earlier").mapInArrow(_placer(table), _PLACED)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        return placed.join(made.select("task", "unit", "place", "ids"), ["task", "unit", "place"]).select(*names, "ids")
    return placed.select(*names)
