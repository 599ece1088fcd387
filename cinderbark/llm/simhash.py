"""SimHash near-duplicates, with pigeonring filtering of candidates.

Fingerprints.  Texts are lower-cased (A-Z), split into words
(``[^\\x20\\x09-\\x0D]+``) and into shingles of four words, repeats included; a
text with fewer words is one shingle, a text without words has fingerprint
zero.  Each shingle's XXH64 (seed 42) votes; a bit is set if it is set in over
half the hashes.  Fingerprints that differ in at most ``DISTANCE`` bits link.

Search.  The 64 bits form a ring of five segments (13, 13, 13, 13 and 12
bits).  Four differences among five segments: by the pigeonring principle there
is a start from which every chain of l consecutive segments has at most
``floor(4 l / 5)`` differences: none in the first segment, at most one in the
first two, two in three, three in four.  The second segment holds at most one
difference, so one of its halves is equal too: ten keys of 18 to 20 bits (a
start, its whole segment, one half of the next) meet every linked pair.  The
other 44 to 46 bits differ in at most four places, so of five parts of them one
is equal: with ``LONG_FROM`` fingerprints and more, each key becomes five of 26
to 29 bits, which meet the same pairs and keep runs of a key short.
Fingerprints of a key are compared in blocks with whole-array operations; the
chain condition prunes, then the full Hamming check decides.

Skew.  Exact copies collapse into one fingerprint first (partial aggregation).
A key with more than ``BLOCK`` distinct fingerprints is dealt out as pairs of
blocks to many tasks.  No pairs are emitted: each block gives a spanning forest
of its links, at most one edge for each fingerprint, which is enough for exact
components.  Classes of frequent fingerprints and of large components are
looked up by broadcast (a bounded number, found by a sketch), the others by a
shuffle.

Similar documents.  ``keep_one_similar`` links by similarity, not by bits: two
texts are near if the Jaccard similarity of their five-word shingles is
``SIMILARITY`` or more.  Candidates come from ``SKETCHES`` fingerprints over
two-word shingles, which one changed word moves less than longer ones; a pair
within ``DISTANCE`` bits in any of them is a candidate.  The same keys, chains
and blocks find candidates; each block gives a spanning forest of real
candidate pairs, nearest first, and each pair of it is verified on whole texts
before components are formed.  Keys are searched in three passes (``_PASSES``).
A later pass knows the parts that earlier ones have linked and gives only pairs
that join two of them, so texts that meet in many keys are few pairs; what it
leaves out is in one component of candidates already.  Where a pair of the forest fails and leaves texts
apart, all texts of its component are compared across the parts, whatever their
bits, so no candidate that is similar enough is left out.  They meet in pairs of
blocks that hold whole sets of shingles; each gives a spanning forest of its
similar pairs, so pairs that fail are never rows.  A text only goes if such
verified links lead to one that stays; a link may be missed if its texts are in
no component of candidates together.

Results.  Null texts count as empty; all texts without words link.  A null
``doc_id`` takes part, and is the smallest only in a component of nulls.
Repeated rows are documents like others.  Very long texts are hashed in steps of
bounded size.  Empty tables give empty results.  Other columns are ignored
(``near_duplicates``) or carried (``keep_one``), whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.llm.common import arrow_fields, cut, fresh, heavy_join, slices, with_row_id
from cinderbark.llm.graph import components

DISTANCE = 4
WORDS = 4
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
#: Distinct fingerprints of a key that one task compares at once.
BLOCK = 4096
#: Distinct fingerprints from which on keys are long: below, a key has a few hundred at most unless they cluster.
LONG_FROM = 1 << 28
#: Shingles that are held at once.
_STEP = 1 << 18
#: Links that are held before they are merged into the forest.
_LINKS = 1 << 20
#: Shingles of a component that is compared as one block; one with k squared times as many has k blocks.
_ONE_BLOCK = 1 << 14


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - WORDS + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        shingles = [joined[a:b] for a, b in zip(first[at : at + _STEP], last[at : at + _STEP])]
        raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


#: Of ``keep_one_similar``: words of a shingle and the similarity that links, words of a sketch's shingle, number of sketches.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
SKETCH_WORDS = 2
SKETCHES = 8
_MIXERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SKETCHES)]


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words; of all words where there are fewer."""
    n = max(1, len(words) - size + 1)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    raw = b"".join(xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(first, last))
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def sketches(text: str | None) -> tuple[int, list[int]]:
    """(hash of all words, fingerprints of the two-word shingles under different mixings), as signed numbers."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, [0] * SKETCHES
    base, out = _shingle_hashes(words, SKETCH_WORDS), []
    for factor in _MIXERS:
        votes = np.zeros(64, np.int64)
        for at in range(0, len(base), _STEP):
            h = base[at : at + _STEP]
            if factor != 1:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
                h ^= h >> np.uint64(29)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(votes * 2 > len(base), bitorder="little").view(np.int64)[0]))
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63), out


_PRINTS = "row struct<f:bigint,r:bigint>, doc_id bigint, fp bigint"


def _prints(batches):
    fields = arrow_fields(_PRINTS)
    for b in slices(batches):
        fps = np.fromiter(map(fingerprint, b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("row").cast(fields.field("row").type), b.column("doc_id"), pa.array(fps.view(np.int64))], schema=fields)


def fingerprints(docs: DataFrame, row: str) -> DataFrame:
    """row, doc_id, fp (the 64 bits as a signed long) for each document."""
    return docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, _PRINTS)


# --- search -----------------------------------------------------------------


def segments(fps: np.ndarray) -> list[np.ndarray]:
    """The five segments, from the highest bits on."""
    out, left = [], 64
    for width in WIDTHS:
        left -= width
        out.append((fps >> np.uint64(left)) & np.uint64((1 << width) - 1))
    return out


def _parts_of_rest(start: int, half: int) -> list[int]:
    """Masks of five parts of the bits that key (start, half) doesn't hold."""
    left, held = 64, []
    for k, width in enumerate(WIDTHS):
        left -= width
        low = width // 2
        if k == start:
            held += range(left, left + width)
        elif k == (start + 1) % 5:
            held += range(left, left + low) if half else range(left + low, left + width)
    rest = [bit for bit in range(63, -1, -1) if bit not in held]
    return [sum(1 << bit for bit in part.tolist()) for part in np.array_split(np.array(rest), 5)]


def keys(fps: np.ndarray, long: bool = False) -> list[np.ndarray]:
    """Ten keys of each fingerprint (start and half, the start's segment, a half of the next), or five longer ones of each.

    The highest four bits hold the start; long keys mix the rest, so a chance meeting of two adds comparisons and no links.
    """
    segs, out = segments(fps), []
    for i, seg in enumerate(segs):
        after, low = segs[(i + 1) % 5], np.uint64(WIDTHS[(i + 1) % 5] // 2)
        for half, part in enumerate((after >> low, after & np.uint64((1 << int(low)) - 1))):
            short = (np.uint64(i) << np.uint64(60)) | (np.uint64(half) << np.uint64(32)) | (seg << np.uint64(16)) | part
            if not long:
                out.append(short)
                continue
            for number, mask in enumerate(_parts_of_rest(i, half)):
                mixed = ((fps & np.uint64(mask)) + np.uint64(number + 1)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29)) ^ short) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((np.uint64(i) << np.uint64(60)) | (mixed >> np.uint64(4)))
    return out


_KEYS = "key bigint, fp bigint"


def _keyer(long: bool):
    def keyed(batches):
        fields = arrow_fields(_KEYS)
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for key in keys(fps, long):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], schema=fields)

    return keyed


def chain_holds(start: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """Whether the chain from ``start`` stays within floor(4 l / 5) differences for each length l."""
    counts = np.stack([np.bitwise_count(s) for s in segments(diff)])
    total, ok = np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
    at = np.arange(len(diff))
    for length in range(1, 6):
        total += counts[(start + length - 1) % 5, at]
        ok &= total <= DISTANCE * length // 5
    return ok


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray, used: list | None = None) -> np.ndarray:
    """Labels (the smallest index of a component) after linking a[i] and b[i]; ``used`` collects pairs that joined components."""
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        new = label.copy()
        np.minimum.at(new, high, low)
        if used is not None:
            won = np.flatnonzero((high != low) & (new[high] == low))
            won = won[np.unique(high[won], return_index=True)[1]]
            used.append((a[won], b[won]))
        while not np.array_equal(deep := new[new], new):
            new = deep
        label, open_ = new, new[a] != new[b]
        a, b = a[open_], b[open_]
    return label


def first_of_parts(run: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each place the first place of the same ``run`` and ``part``."""
    order = np.lexsort((part, run))
    r, p = run[order], part[order]
    new = np.ones(len(run), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    out = np.empty(len(run), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def forest(key: np.ndarray, fps: np.ndarray, start: np.ndarray, side: np.ndarray, real: bool = False, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that span the links within each run of equal ``key``; ``real`` ones are links themselves.

    ``side``: 0 for rows that meet all of their run, else 1 or 2 for rows that
    meet those of the other side only.  ``part``: rows of a run and part are linked already.
    """
    used: list = []
    n = len(key)
    label = np.arange(n) if part is None else first_of_parts(key, part)
    at, shift, held, count = np.arange(n), 0, [], 0
    while len(at):
        shift += 1
        at = at[at + shift < n]
        at = at[key[at] == key[at + shift]]
        other = at + shift
        meet = (side[at] == 0) | (side[at] != side[other])
        if part is not None:
            meet &= label[at] != label[other]
        a, b = at[meet], other[meet]
        diff = fps[a] ^ fps[b]
        ok = np.bitwise_count(diff) <= DISTANCE
        if ok.any():
            a, b, diff = a[ok], b[ok], diff[ok]
            ok = chain_holds(start[a], diff)
            a, b = a[ok], b[ok]
            held.append((a, b))
            count += len(a)
        if count > _LINKS or (held and not len(at)):
            a, b = (np.concatenate([pair[k] for pair in held]) for k in (0, 1))
            if real:  # the nearest pairs first, as they are verified
                apart = np.bitwise_count(fps[a] ^ fps[b])
                for bits in range(DISTANCE + 1):
                    label = _merge(label, a[apart == bits], b[apart == bits], used)
            else:
                label = _merge(label, a, b)
            held, count = [], 0
    if real:
        return tuple(np.concatenate([x[k] for x in used]) if used else np.zeros(0, np.int64) for k in (0, 1))
    joined = np.flatnonzero(label != np.arange(n))
    return joined, label[joined]


_EDGES = "a bigint, b bigint"


def _forests(batches, named: bool = False):
    """Rows come sorted by (key, pair); runs may reach over batches.  ``named``: edges are real links of parts between column ``id``."""
    fields, rest = arrow_fields(_EDGES), None
    names = ("key", "pair", "fp", "side", *(["id", "part"] if named else []))

    def edges(cols):
        key, pair = cols[:2]
        run = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
        if named:  # runs of one part hold nothing new
            part, starts = cols[5], np.flatnonzero(np.diff(run, prepend=0))
            several = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
            open_ = several[run - 1]
            run, cols = run[open_], [x[open_] for x in cols]
        key, _, fp, side, *ids = cols
        a, b = forest(run, fp.view(np.uint64), key >> 60, side, named, ids[1] if named else None)
        node = ids[0] if named else fp
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], schema=fields)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cutoff = int(np.argmax(last))
        rest = [x[cutoff:] for x in cols]
        if cutoff:
            yield edges([x[:cutoff] for x in cols])
    if rest is not None and len(rest[0]):
        yield edges(rest)


def links(distinct: DataFrame, block: int = BLOCK, long_from: int = LONG_FROM) -> DataFrame:
    """Edges (a, b) that span all links among the column ``fp`` of distinct fingerprints."""
    keyed = distinct.select("fp").mapInArrow(_keyer(distinct.count() >= long_from), _KEYS)
    return _dealt(keyed, block).mapInArrow(_forests, _EDGES)


def _pairs_of_blocks(rows: DataFrame, *by: str, own: bool = False) -> DataFrame:
    """Rows with ``pair`` and ``side``, one for each pair of blocks that holds the row's; ``blocks`` is the number of its group.

    ``own``: only the pair of the row's block with itself.
    """
    return (
        rows.withColumn("mine", F.pmod(F.xxhash64(*by), F.col("blocks")).cast("int"))
        .withColumn("other", F.col("mine") if own else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("pair", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
        .withColumn("side", F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2))
    )


def _dealt(keyed: DataFrame, block: int, own: bool = False) -> DataFrame:
    """Rows by key (key, pair, fp, side, ...), sorted; keys of more than ``block`` rows as pairs of blocks.

    Only such keys are looked up (a written table of a row for each ``block`` rows
    at most, whose size decides how it is joined); all others meet in the exchange.
    Large keys of one ``part`` hold nothing to link.  ``own``: blocks meet themselves only.
    """
    more = [c for c in keyed.columns if c not in ("key", "fp")]
    several = (F.min("part") < F.max("part") if "part" in more else F.lit(True)).alias("several")
    big = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), several).filter(F.col("n") > block), "big_keys")
    none = big.isEmpty()
    small = keyed if none else keyed.join(big, "key", "left_anti")
    small = small.select("key", F.lit(0).alias("pair"), "fp", F.lit(0).alias("side"), *more)
    large = keyed.join(big.filter("several"), "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    large = _pairs_of_blocks(large, "fp", *(c for c in more if c != "part"), own=own)
    large = large.select("key", "pair", "fp", "side", *more)
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = small if none else small.unionByName(large)
    return rows.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "side")


def _classes(prints: DataFrame, block: int, long_from: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint; only linked ones have to be looked up."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = distinct.join(components(links(distinct, block, long_from)), F.col("fp") == F.col("node"), "left").select("fp", "least", "root")
    rooted = cut(rooted, "roots")
    linked = rooted.filter("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = rooted.filter("root IS NULL").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return cut(heavy_join(linked, least, "root").select("fp", "root", "component_id").unionByName(alone), "classes")


def near_duplicates(docs: DataFrame, block: int = BLOCK, long_from: int = LONG_FROM) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    (row,) = fresh(docs, "row_id")
    prints = cut(fingerprints(with_row_id(docs.select("doc_id", "text"), row), row), "prints")
    found = heavy_join(prints, _classes(prints, block, long_from), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, block: int = BLOCK, long_from: int = LONG_FROM) -> DataFrame:
    """The documents, with all of their columns, without all but one of each component.

    The smallest ``doc_id`` stays (null last), then the earliest row.
    """
    (row,) = fresh(docs, "row_id")
    whole = with_row_id(docs, row)
    prints = cut(fingerprints(whole, row), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    placed = cut(heavy_join(prints, _classes(prints, block, long_from), "fp").select("root", "doc_id", "row"), "placed")
    stay = placed.groupBy("root").agg(F.min(rank).alias("win")).select("win.row")
    lost = placed.join(stay, "row", "left_anti").select(F.col("row").alias(row))
    return whole.join(lost, row, "left_anti").drop(row)


# --- similar documents ------------------------------------------------------------

_SKETCHED = "row struct<f:bigint,r:bigint>, doc_id bigint, whole bigint, fps array<bigint>"


def _sketched(batches):
    fields = arrow_fields(_SKETCHED)
    for b in slices(batches):
        found = [sketches(t) for t in b.column("text").to_pylist()]
        columns = [pa.array([x[k] for x in found], f.type) for k, f in enumerate(list(fields)[2:])]
        yield pa.RecordBatch.from_arrays([b.column("row").cast(fields.field("row").type), b.column("doc_id"), *columns], schema=fields)


_NAMED_KEYS = "key bigint, fp bigint, id bigint, part bigint"
#: Sketches, keys of each (all: None) and whether the blocks of a large key meet themselves only: one key of one sketch links most of a large group.
_PASSES = (((0,), 1, True), ((0,), None, False), (tuple(range(1, SKETCHES)), None, False))


def _sketch_keyer(long: bool, numbers: tuple[int, ...], first: int | None):
    def keyed(batches):
        fields = arrow_fields(_NAMED_KEYS)
        for b in batches:
            fps = np.array(b.column("fps").flatten().to_numpy(zero_copy_only=False)).reshape(-1, SKETCHES)
            for number in numbers:
                mine = np.ascontiguousarray(fps[:, number])
                for key in keys(mine.view(np.uint64), long)[:first]:
                    key = key ^ np.uint64(number << 40)  # a sketch's keys meet its own only; a chance meeting is checked like any other
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(mine), b.column("id"), b.column("part")], schema=fields)

    return keyed


def _candidates(reps: DataFrame, block: int, long_from: int) -> DataFrame:
    """(a, b): pairs of ``id`` that span all pairs within ``DISTANCE`` bits in a sketch."""
    long, found = reps.count() >= long_from, None
    parts = reps.select("id", "fps", F.col("id").alias("part"))
    for numbers, first, own in _PASSES:
        if found is not None:
            roots = components(found)
            parts = cut(reps.select("id", "fps").join(roots, F.col("id") == F.col("node"), "left").select("id", "fps", F.coalesce("root", "id").alias("part")), "parts")
        keyed = parts.mapInArrow(_sketch_keyer(long, numbers, first), _NAMED_KEYS)
        pairs = _dealt(keyed, block, own).mapInArrow(lambda batches: _forests(batches, named=True), _EDGES)
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        found = pairs if found is None else found.unionByName(pairs)
    return found


_SETS = "id bigint, shingles array<bigint>"


def _sets(batches):
    fields = arrow_fields(_SETS)
    for b in slices(batches):
        found = []
        for text in b.column("text").to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            found.append(np.unique(_shingle_hashes(words, SIMILAR_WORDS)).view(np.int64) if words else [])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, fields.field("shingles").type)], schema=fields)


def spanning(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that span the similar pairs of different ``part``s; ``side`` as in ``forest``."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    label, side = part[order], side[order]
    a, b = [], []
    if (label == label[0]).all():
        return np.array(a, np.int64), np.array(b, np.int64)
    sizes = np.array([len(sets[k]) for k in order])
    ends = np.cumsum(sizes)
    values, names = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mine = np.zeros(len(values), bool)
    last = np.searchsorted(sizes * SIMILARITY, sizes + 1e-6, "right")  # larger sets are too large
    for k, (size, start) in enumerate(zip(sizes.tolist(), (ends - sizes).tolist())):
        at, to = k + 1, int(last[k])
        meet = label[at:to] != label[k]
        if side[k]:
            meet &= side[at:to] != side[k]
        if not meet.any():
            continue
        own = names[start : start + size]
        mine[own] = True
        upto = np.concatenate([[0], np.cumsum(mine[names[ends[k] : ends[to - 1]]], dtype=np.int64)])
        mine[own] = False
        shared = np.diff(upto[ends[k:to] - ends[k]])
        both = size + sizes[at:to] - shared
        hits = np.flatnonzero(meet & ((shared / np.maximum(both, 1) >= SIMILARITY) | (both == 0)))
        if len(hits):
            labels, first = np.unique(label[at + hits], return_index=True)
            a += [int(order[k])] * len(first)
            b += order[at + hits[first]].tolist()
            label[np.isin(label, labels)] = label[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _crossings(batches):
    """Similar pairs of texts of different ``part``s; rows come sorted by (root, pair), runs may reach over batches."""
    fields, run, held = arrow_fields(_EDGES), None, []

    def pairs():
        side, ids, part = (np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in ("side", "id", "part"))
        a, b = spanning([x.values.to_numpy(zero_copy_only=False) for b in held for x in b.column("shingles")], part, side)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], schema=fields)

    for batch in batches:
        if not batch.num_rows:
            continue
        root, pair = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("root", "pair"))
        new = np.flatnonzero((root[1:] != root[:-1]) | (pair[1:] != pair[:-1])) + 1
        for at, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            if held and run != (root[at], pair[at]):
                yield pairs()
                held = []
            run = root[at], pair[at]
            held.append(batch.slice(at, end - at))
    if held:
        yield pairs()


def _shingle_sets(found: DataFrame, whole: DataFrame, row: str, reps: DataFrame) -> DataFrame:
    """id, shingles of each text of the pairs (a, b) of ``found``."""
    wanted = found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(reps.select("id", F.col("win.row").alias(row)), "id")
    return cut(whole.select(row, "text").join(wanted, row).select("id", "text").mapInArrow(_sets, _SETS), "sets")


def _similar(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``found`` whose whole texts are similar enough."""
    both = found.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    # two texts without words share all that they have
    near = F.when(F.size("x") + F.size("y") == 0, F.lit(1.0)).otherwise(shared / (F.size("x") + F.size("y") - shared))
    return both.filter(near >= SIMILARITY).select("a", "b")


def similar_pairs(whole: DataFrame, row: str, reps: DataFrame, block: int, long_from: int) -> DataFrame:
    """(a, b): pairs of ``id`` that are similar enough, and that span all such candidates."""
    found = _candidates(reps, block, long_from)
    sets = _shingle_sets(found, whole, row, reps)
    near = cut(_similar(found, sets), "similar")
    failed = cut(found.join(near, ["a", "b"], "left_anti"), "failed")
    if failed.isEmpty():
        return near
    # the forest spans all candidates: only its components with a failed pair between two parts hold more to verify
    sure = components(near)
    part = lambda c: sure.select(F.col("node").alias(c), F.col("root").alias(f"part_{c}"))
    apart = failed.join(part("a"), "a", "left").join(part("b"), "b", "left").filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
    every = components(found)
    open_ = every.join(apart.select(F.col("a").alias("node")), "node").select("root").distinct()
    sized = every.join(sets.select(F.col("id").alias("node"), F.size("shingles").alias("size")), "node").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.sqrt(F.col("size") / _ONE_BLOCK))).cast("int")
    sized = cut(sized.join(open_, "root", "left_semi").select("root", blocks.alias("blocks")), "open")
    left = heavy_join(every.withColumnRenamed("node", "id"), sized, "root").join(part("id"), "id", "left").join(sets, "id")
    left = _pairs_of_blocks(left, "id").select("root", "pair", "side", "id", F.coalesce("part_id", "id").alias("part"), "shingles")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = left.repartition(n, "root", "pair").sortWithinPartitions("root", "pair").mapInArrow(_crossings, _EDGES)
    return near.unionByName(cut(more, "crossings"))


def keep_one_similar(docs: DataFrame, block: int = BLOCK, long_from: int = LONG_FROM) -> DataFrame:
    """The documents, with all of their columns, without all but one of each group of similar ones.

    The smallest ``doc_id`` of a group stays (null last), then the earliest row.
    """
    (row,) = fresh(docs, "row_id")
    whole = with_row_id(docs, row)
    made = whole.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketched, _SKETCHED)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    # texts of the same words are one from here on
    reps = cut(made.groupBy("whole", "fps").agg(F.min(rank).alias("win")).withColumn("id", F.monotonically_increasing_id()), "reps")
    roots = components(similar_pairs(whole, row, reps, block, long_from))
    linked = cut(reps.select("id", "win").join(roots, F.col("id") == F.col("node"), "left").select("id", "win", "root"), "linked")
    stay = linked.filter("root IS NOT NULL").groupBy("root").agg(F.min("win").alias("win")).select("win.row")
    stay = stay.unionByName(linked.filter("root IS NULL").select("win.row")).select(F.col("row").alias(row))
    return whole.join(stay, row, "left_semi").drop(row)
