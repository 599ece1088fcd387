"""Benchmark decontamination by template canonicalisation.

Every text becomes a sequence of typed tokens: numbers, units and names (words
with a capital inside a sentence) turn into placeholders that remember their
value, all other words are lower-cased.  Windows of ``WINDOW`` template tokens
are hashed and joined with those of the benchmark items, once over single tokens
and once with each run of numbers or of names as one placeholder, so a value may
have another number of words.  Windows with fewer than ``PLAIN`` words (bare lists of
numbers or names, which any other list would meet) are left out there; a third
reading hashes all windows over the values as they stand, so verbatim copies are
always found.  A fourth reading takes every
capital for a name, so headings and line breaks before a question do not change
its windows; a sentence's first word counts there only if it is unchanged or
follows the other slots.  Along each alignment the slots are then checked: a value of the item has to stand for the same value
of the document everywhere, so a question with other numbers or names is caught
and a chance meeting of templates is not.  Near alignments, which inserted and
dropped words make, are summed under one slot table, each token counted once.  A
document is contaminated by an item if the agreeing tokens cover at least
``SHARE`` of the item, or ``RUN`` tokens of a longer one.

The benchmark's hashed windows are the build side.  Their size is checked
before: items are dealt into as many parts as keep each part's text under
``PART_CHARS``.  One part is the usual case; more are built, joined and written
one after the other, so driver and workers hold one at a time.  Documents are
never shuffled and never cut short.  A text and items that meet in very many
windows are judged in groups of items, so at most about ``PAIRS`` meetings are
held at once.

Results.  Null and empty texts match nothing, nor do items of one or two tokens.
Items of ``SHORT`` to ``LEAST - 1`` tokens match as a whole with the values as
they stand, items of ``LEAST`` to ``WINDOW - 1`` also as a whole template.
Repeated rows are judged alike; repeated items give a row each, and a document
that several items meet (ties included) gives a row each.  Null ids are carried,
empty tables give empty results.  Other columns are ignored (``contaminated``) or
carried (``keep_clean``), whatever their names.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.llm.common import arrow_fields, cut

WINDOW = 8
#: Plain words of a window of templates, and tokens of an item that templates match; shorter ones match as they stand.
PLAIN = 2
LEAST = 5
SHORT = 3
SHARE = 0.6
RUN = 30
#: Alignments whose shifts differ by this, or by half the item's tokens, are near.
NEAR = 8
#: Characters of benchmark text that one pass holds in each worker.
PART_CHARS = 16_000_000
#: Meetings of a document's and an item's windows that are held at once.
PAIRS = 2_000_000
REMEMBERED = 700_000

# Words that name a unit of measure or money.
UNITS = """mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week
months month years year meters metres meter metre kilometers kilometres miles mile feet foot inches inch grams gram kilograms
pounds pound ounces liters litres dollars dollar euros euro cents cent usd eur gbp percent degrees mph kmh kw w v hz kb mb gb""".split()
# Number words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

_TOKEN = re.compile(r"[0-9]+(?:[.,:][0-9]+)*|[^\W\d_]+|[^\W_]+")
_ENDS = re.compile(r"[.!?:;\"”)\]]\W*\Z")
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


_UNITS, _NUMBERS = frozenset(UNITS), frozenset(NUMBERS)
_UNITS_RAW, _NUMBERS_RAW = (frozenset(w.encode() for w in x) for x in (UNITS, NUMBERS))
_MARKS, _END_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b'.!?:;")]'
_NAME, _LAST = 4, 8


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


_PLACEHOLDERS = np.array([0, *(_hash(b"<%s>" % k) for k in (b"number", b"unit", b"name"))], np.uint64)


def _chunk(raw: bytes) -> bytes:
    """Tokens of a white-space-separated chunk: value hash, then kind and flags; 16 bytes each."""
    low = raw.lower()
    head = low.rstrip(_MARKS)
    if head.isalpha():
        flags = 1 if head in _NUMBERS_RAW else 2 if head in _UNITS_RAW else _NAME if raw[0] < 97 else 0
        tail = low[len(head) :]
        if tail.translate(None, _END_MARKS) != tail:
            flags |= _LAST
        return struct.pack("<QQ", _hash(head), flags)
    text = raw.decode("utf-8")
    found = []
    for word in _TOKEN.findall(text):
        low_word = word.lower()
        kind = 1 if low_word[0].isdigit() or low_word in _NUMBERS else 2 if low_word in _UNITS else 0
        found += _hash(low_word.encode()), kind | (_NAME if kind == 0 and word[0].isupper() else 0)
    if found and _ENDS.search(text):
        found[-1] |= _LAST
    return struct.pack(f"<{len(found)}Q", *found)


class Reader:
    """Turns texts into token arrays; remembers chunks."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    def raw(self, text: str | None) -> bytes:
        chunks = (text or "").encode("utf-8", "replace").split()
        found = list(map(self.known.get, chunks))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for k, c in enumerate(chunks):
                if found[k] is None:
                    found[k] = self.known.get(c) or _chunk(c)
                    if len(c) <= 48:
                        self.known[c] = found[k]
        return b"".join(found)

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """value, kind (0 word, 1 number, 2 unit, 3 capital), at a sentence's start, at its end, text of each token."""
        raws = [self.raw(t) for t in texts]
        both = np.frombuffer(b"".join(raws), np.uint64).reshape(-1, 2)
        value, flags = both[:, 0], both[:, 1]
        text = np.repeat(np.arange(len(raws)), [len(r) // 16 for r in raws])
        kind = (flags & np.uint64(3)).astype(np.int64)
        last = (flags & np.uint64(_LAST)) > 0
        first = np.ones(len(value), bool)
        first[1:] = (text[1:] != text[:-1]) | last[:-1]
        kind[(flags & np.uint64(_NAME)) > 0] = 3
        return value, kind, first, last, text


class Reading:
    """The units of a batch in one reading: tokens, or with runs of numbers and names as one unit."""

    def __init__(self, value, kind, text, merged: np.ndarray | None = None, literal: bool = False, loose: bool = False):
        n = len(value)
        self.start = np.arange(n) if merged is None else np.flatnonzero(~merged)
        self.size = np.diff(self.start, append=n)
        self.kind, self.text = kind[self.start], text[self.start]
        self.value = value
        if merged is not None and n:
            inner = np.arange(n) - np.repeat(self.start, self.size)
            self.value = np.add.reduceat(value * (np.uint64(1) + inner.astype(np.uint64) * _FACTORS[0]), self.start)
        self.literal, self.loose = literal, loose
        self.template = value if literal else np.where(self.kind > 0, _PLACEHOLDERS[self.kind], self.value)
        #: Units that count as words where windows are chosen.
        self.plain = np.ones(n, bool) if literal else self.kind == 0


def readings(value, kind, first, last, text) -> list[Reading]:
    """Single tokens, merged runs and values as they stand, where a capital at a sentence's start is a word; runs where it is a name."""
    loose = Reading(value, kind, text, _runs(kind, last, text), loose=True)
    kind = np.where(first & (kind == 3), 0, kind)
    return [Reading(value, kind, text), Reading(value, kind, text, _runs(kind, last, text)), Reading(value, kind, text, literal=True), loose]


def _runs(kind, last, text) -> np.ndarray:
    """Which tokens continue a run of numbers or of names in their sentence."""
    out = np.zeros(len(kind), bool)
    out[1:] = (text[1:] == text[:-1]) & (kind[1:] == kind[:-1]) & ((kind[1:] == 1) | (kind[1:] == 3)) & ~last[:-1]
    return out


def windows(template: np.ndarray, word: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows within one text with ``PLAIN`` words at least."""
    n = len(template) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += template[k : k + n] * _FACTORS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    plain = np.concatenate([[0], np.cumsum(word)])
    at = np.flatnonzero((text[:n] == text[size - 1 :]) & (plain[size:] - plain[:-size] >= PLAIN))
    return at, h[at]


class Index:
    """The hashed windows of benchmark items, in each reading."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        tokens = Reader().tokens([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.value, self.kind, self.starts, _, self.text = tokens
        self.first = np.searchsorted(self.text, np.arange(len(items)))
        self.size = np.bincount(self.text, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        self.readings = readings(*tokens)
        self.tables = [self._table(r, len(items)) for r in self.readings]

    def _table(self, r: Reading, n: int) -> dict:
        units = np.bincount(r.text, minlength=n) if n else np.zeros(0, np.int64)
        words = np.bincount(r.text, r.plain, minlength=n) if n else units
        short = (units < WINDOW) & ((self.size >= SHORT) if r.literal else (self.size >= LEAST) & (2 * words >= LEAST))
        out = {}
        for size in sorted({WINDOW, *units[short].tolist()}):
            at, h = windows(r.template, r.plain, r.text, size)
            if size < WINDOW:
                whole = (units[r.text[at]] == size) & short[r.text[at]]
                at, h = at[whole], h[whole]
            order = np.argsort(h, kind="stable")
            h = h[order]
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            out[size] = (seen, h, at[order])
        return out

    def meetings(self, found: list[Reading]) -> list[tuple]:
        """(reading, window size, document units, first and end of the equal windows in the table)."""
        out = []
        for number, (r, tables) in enumerate(zip(found, self.tables)):
            for size, (seen, hashes, _) in tables.items():
                if not len(hashes):
                    continue
                at, h = windows(r.template, r.plain, r.text, size)
                likely = seen[h >> np.uint64(44)]
                at, h = at[likely], h[likely]
                lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                if (hi > lo).any():
                    out.append((number, size, at[hi > lo], lo[hi > lo], hi[hi > lo]))
        return out

    def hits(self, found: list[Reading], met: list[tuple], first: int, end: int):
        """(reading, document unit, item unit, window size, text, item) of equal windows with items ``first`` to ``end - 1``."""
        for number, size, at, lo, hi in met:
            places, item_of = self.tables[number][size][2], self.readings[number].text
            steps = np.flatnonzero(np.diff(np.cumsum(hi - lo) // PAIRS, prepend=-1))
            for a, z in zip(steps, [*steps[1:], len(at)]):
                n = hi[a:z] - lo[a:z]
                d = np.repeat(at[a:z], n)
                k = np.repeat(lo[a:z] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                b = places[k]
                ours = (item_of[b] >= first) & (item_of[b] < end)
                d, b = d[ours], b[ours]
                if len(d):
                    yield np.full(len(d), number), d, b, np.full(len(d), size), found[number].text[d], item_of[b]

    def judge(self, value, kind, first, last, text, share: float, run: int):
        """(text, item, covered share, first token, tokens, changed slots) of contaminated texts."""
        found = readings(value, kind, first, last, text)
        met = self.meetings(found)
        total = sum(int((hi - lo).sum()) for *_, lo, hi in met)
        if total > PAIRS and text[0] != text[-1]:
            half = int(np.searchsorted(text, (text[0] + text[-1] + 1) // 2))
            for part in (slice(None, half), slice(half, None)):
                yield from self.judge(value[part], kind[part], first[part], last[part], text[part], share, run)
            return
        groups = np.linspace(0, len(self.ids), min(len(self.ids), total // PAIRS + 1) + 1).astype(int).tolist() if total else []
        for a, z in zip(groups, groups[1:]):
            yield from self._judged(found, list(self.hits(found, met, a, z)), value, text, share, run)

    def _judged(self, found: list[Reading], hits: list, value, text, share: float, run: int):
        if not hits:
            return
        number, d, b, size, doc, item = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((d, d - b, number, item, doc))
        number, d, b, size, doc, item = (x[order] for x in (number, d, b, size, doc, item))
        new = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        pair = np.flatnonzero(np.concatenate([[True], new]))
        lane = np.flatnonzero(np.concatenate([[True], new | (number[1:] != number[:-1]) | ((d - b)[1:] != (d - b)[:-1])]))
        for lo, hi in zip(pair, [*pair[1:], len(d)]):
            it = int(item[lo])
            bounds = [*lane[np.searchsorted(lane, lo) : np.searchsorted(lane, hi)], hi]
            lanes = [
                Lane(self, found[number[x]], self.readings[number[x]], value, d[x:y], b[x:y], size[x:y]) for x, y in zip(bounds, bounds[1:])
            ]
            lanes = [x for x in lanes if not x.astray]
            if not lanes:
                continue
            tokens, at, changed = self._best(lanes, int(self.size[it]))
            covered = tokens / int(self.size[it])
            if covered >= share or tokens >= run:
                yield int(doc[lo]), it, covered, int(at - np.searchsorted(text, doc[lo])), tokens, changed

    def _best(self, lanes: list[Lane], size: int) -> tuple[int, int, int]:
        """(tokens, first token, changed slots) of the best alignment or sum of near ones."""
        best = max((x.result() for x in lanes), key=lambda r: (r[0], -r[1]))
        if len(lanes) == 1 or best[0] == size:
            return best
        lanes = sorted(lanes, key=lambda x: x.shift)
        shifts, spread, done = np.array([x.shift for x in lanes]), max(NEAR, size // 2), 0
        for k, end in enumerate(np.searchsorted(shifts, shifts + spread, "right").tolist()):
            if end > max(done, k + 1):
                got = _summed(lanes[k:end])
                best = max(best, got, key=lambda r: (r[0], -r[1]))
            done = max(done, end)
        return best


class Lane:
    """Units of a document and an item that face each other along one alignment."""

    def __init__(self, index: Index, mine: Reading, theirs: Reading, value, d, b, size):
        at = np.unique(np.concatenate([np.arange(x, x + s) for x, s in zip(d, size)]))
        to = at + (b[0] - d[0])
        self.d, self.d_end = mine.start[at], mine.start[at] + mine.size[at]
        self.b, self.b_end = theirs.start[to], theirs.start[to] + theirs.size[to]
        self.slot, self.mine, self.theirs = mine.kind[at] > 0, mine.value[at], theirs.value[to]
        self.sure = np.full(len(at), mine.literal)
        # a capital that only its place may have given: it counts if unchanged, or as other slots say
        self.open = theirs.loose & index.starts[self.b] & (index.kind[self.b] == 3)
        for k in np.flatnonzero(self.open):
            own, n = value[self.d[k] : self.d_end[k]], self.b_end[k] - self.b[k]
            item = index.value[self.b[k] : self.b_end[k]]
            self.sure[k] = np.array_equal(own[-n:], item) or np.array_equal(own[:n], item)
        #: A short item that is matched as a whole needs all such words.
        self.astray = bool(size[0] < WINDOW and (self.open & ~_agree(*self.columns()[4:])).any())
        self.shift = int(self.d[0] - self.b[0])

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.d, self.d_end, self.b, self.b_end, self.slot, self.mine, self.theirs, self.sure, self.open

    def result(self) -> tuple[int, int, int]:
        return _counted(*self.columns())


def _agree(slot, mine, theirs, sure, open_) -> np.ndarray:
    """Which units agree under one slot table, to which ``open_`` ones add nothing."""
    votes = slot & ~open_
    agree = ~slot
    agree[votes] = consistent(theirs[votes], mine[votes])
    if open_.any():
        held = votes & agree
        held = set(zip(theirs[held].tolist(), mine[held].tolist()))
        agree[open_] = [x in held for x in zip(theirs[open_].tolist(), mine[open_].tolist())]
    return agree | sure


def _counted(d, d_end, b, b_end, *rest) -> tuple[int, int, int]:
    """(item tokens that agree, first token, changed slots)."""
    slot, mine, theirs, sure, _ = rest
    return int((b_end - b)[_agree(*rest)].sum()), int(d.min()), int((slot & ~sure & (mine != theirs)).sum())


def _summed(lanes: list[Lane]) -> tuple[int, int, int]:
    """Near alignments together, the best first; each token of either side counts once."""
    low_d, low_b = min(int(x.d[0]) for x in lanes), min(int(x.b[0]) for x in lanes)
    used_d = np.zeros(max(int(x.d_end[-1]) for x in lanes) - low_d, bool)
    used_b = np.zeros(max(int(x.b_end[-1]) for x in lanes) - low_b, bool)
    kept = []
    for x in sorted(lanes, key=lambda x: -x.result()[0]):
        free = _free(used_d, x.d - low_d, x.d_end - low_d) & _free(used_b, x.b - low_b, x.b_end - low_b)
        if free.any():
            columns = [c[free] for c in x.columns()]
            for used, low, start, end in ((used_d, low_d, *columns[:2]), (used_b, low_b, *columns[2:4])):
                for s, e in zip((start - low).tolist(), (end - low).tolist()):
                    used[s:e] = True
            kept.append(columns)
    return _counted(*(np.concatenate(c) for c in zip(*kept)))


def _free(used: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans hold no used token."""
    total = np.concatenate([[0], np.cumsum(used)])
    return total[end] == total[start]


def consistent(theirs: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Which slots follow the most frequent value that each of ``theirs`` stands for."""
    counts: dict[tuple, int] = {}
    for pair in zip(theirs.tolist(), mine.tolist()):
        counts[pair] = counts.get(pair, 0) + 1
    best: dict[int, tuple] = {}
    for (t, m), n in counts.items():
        best[t] = max(best.get(t, (0, 0)), (n, m))
    return np.array([best[t][1] == m for t, m in zip(theirs.tolist(), mine.tolist())], bool)


def item_parts(benchmark: DataFrame, chars: int = PART_CHARS) -> Iterator[tuple[Index, bool]]:
    """Indexes of all items, each of at most about ``chars`` characters of text, and whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // chars + 1
    for part in range(n):
        rows = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part)
        yield Index([(r["item_id"], r["text"]) for r in rows.orderBy("item_id", "text").collect()]), n == 1


def _batches(texts: list[str | None]):
    """Slices of the list whose texts have some 2 MB together."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held > 1 << 21:
            yield at, texts[at : k + 1]
            at, held = k + 1, 0
    yield at, texts[at:]


_FOUND = "doc_id bigint, item_id bigint, covered double, first_token bigint, tokens bigint, changed_slots bigint"


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN, chars: int = PART_CHARS) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, covered, first_token, tokens, changed_slots."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finder(index: Index):
        def find(batches):
            fields, reader = arrow_fields(_FOUND), Reader()
            for b in batches:
                doc_ids, out = b.column("doc_id").to_pylist(), []
                for at, texts in _batches(b.column("text").to_pylist()):
                    for doc, item, *rest in index.judge(*reader.tokens(texts), share, run):
                        out.append((doc_ids[at + doc], index.ids[item], *rest))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(fields), fields)], schema=fields)

        return find

    out = None
    for index, only in item_parts(benchmark, chars):
        part = rows.mapInArrow(finder(index), _FOUND)
        part = part if only else cut(part, "contaminated")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN, chars: int = PART_CHARS) -> DataFrame:
    """The documents that no item contaminates, with all of their columns."""

    def keeper(index: Index):
        def keep(batches):
            reader = Reader()
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                for at, texts in _batches(b.column("text").to_pylist()):
                    for doc, *_ in index.judge(*reader.tokens(texts), share, run):
                        ok[at + doc] = False
                yield b.filter(pa.array(ok))

        return keep

    for index, only in item_parts(benchmark, chars):
        docs = docs.mapInArrow(keeper(index), docs.schema)
        docs = docs if only else cut(docs, "clean")
    return docs
