"""Quality classifier: gradient-boosted trees over statistics of whole texts.

The statistics are shares and means of a text's bytes, words and lines; the
label, language, source and id are never among them.  Training takes the
labelled rows outside the held-out fold (``crc32(doc_id as text) mod 5 = 0``),
at most ``SAMPLE`` of them, those with the smallest hash of their id; that bound
is the only one, and it holds for training alone.  The sample's ids, at most
``SAMPLE`` rows, are broadcast to find their texts.  The forest is flattened into
arrays, shipped to the workers, and every text is scored where it lies, without
a shuffle.

Results.  Null and empty texts have all-zero statistics and get a score too.
Rows with a null id are not held out and are scored.  Labels that name no
document, or have a null quality, train nothing.  Without labels every score is
0.5.  Empty tables give empty results; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.llm import boosting
from cinderbark.llm.common import arrow_fields, slices

SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\f",
    "line": b"\n",
    "stop": b".",
    "comma": b",",
    "bang": b"!?",
    "mark": b"#$%&*@^~+=",
    "bar": b"|<>{}[]\\_`",
    "quote": b"\"'():;-/",
}
_LOOKUP = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES.values()):
    _LOOKUP[list(_chars)] = _i
_LOOKUP[:32][_LOOKUP[:32] == len(_CLASSES)] = len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 2

#: Names of the statistics, in order.
STATISTICS = [
    *(f"share_{name}" for name in [*_CLASSES, "beyond_ascii", "control"]),
    "log_bytes",
    "log_words",
    "mean_word",
    "longest_word",
    "distinct_words",
    "top_word",
    "lines_per_word",
    "distinct_lines",
    "longest_line",
    "mean_line",
    "upper_words",
    "marked_words",
    "bare_words",
    "sentence_words",
]


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    out = np.zeros(len(STATISTICS))
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        out[_KINDS] = np.log1p(len(raw))
        return out
    counts = np.zeros(_KINDS)
    for at in range(0, len(raw), 1 << 22):
        counts += np.bincount(_LOOKUP[np.frombuffer(raw[at : at + (1 << 22)], np.uint8)], minlength=_KINDS)
    out[:_KINDS] = counts / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    often: dict[bytes, int] = {}
    for w in words:
        often[w] = often.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    widths = np.fromiter(map(len, lines), np.int64, len(lines))
    upper = sum(n for w, n in often.items() if w.isupper() and len(w) > 1)
    marked = sum(n for w, n in often.items() if not w[-1:].isalnum() and w[-1:] not in b".,;:" and w[-1] < 128)
    bare = sum(n for w, n in often.items() if not w.isalnum() and len(w) == 1)
    ended = sum(n for w, n in often.items() if w[-1:] in b".!?")
    out[_KINDS:] = (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sizes.mean(),
        np.log1p(sizes.max()),
        len(often) / len(words),
        max(often.values()) / len(words),
        len(lines) / len(words),
        len(set(lines)) / len(lines),
        np.log1p(widths.max()),
        np.log1p(widths.mean()),
        upper / len(words),
        marked / len(words),
        bare / len(words),
        len(words) / (ended + 1),
    )
    return out


def held_out(doc_id):
    """Whether a row is in the fold that no model may learn from; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


_STATS = "doc_id bigint, stats array<double>"


def _stats(batches):
    fields = arrow_fields(_STATS)
    for b in slices(batches):
        stats = [statistics(t).tolist() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(stats, fields.field("stats").type)], schema=fields)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> boosting.Forest:
    """A forest from at most ``sample`` labelled rows outside the held-out fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = {r["doc_id"]: r["quality"] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(k,) for k in rows], "doc_id long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    once = texts.mapInArrow(_stats, _STATS).groupBy("doc_id").agg(F.min("stats").alias("stats"))
    found = sorted(once.collect(), key=lambda r: r["doc_id"])  # at most ``sample`` rows of numbers
    x = np.array([r["stats"] for r in found], float).reshape(-1, len(STATISTICS))
    y = np.array([rows[r["doc_id"]] for r in found], float)
    return boosting.train(x, y, **options)


def _scores(forest: boosting.Forest, texts: pa.Array) -> np.ndarray:
    return forest.score(np.array([statistics(t) for t in texts.to_pylist()]).reshape(-1, len(STATISTICS)))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    forest = fit(docs, labels, sample)

    def score(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(forest, b.column("text")))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with all of their columns."""
    forest = fit(docs, labels, sample)

    def keep(batches):
        for b in slices(batches):
            yield b.filter(pa.array(_scores(forest, b.column("text")) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
