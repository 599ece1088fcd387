"""Token ids of whole texts with a public word BPE, at the speed of a dictionary.

The vocabulary's normaliser and pre-tokeniser never reach across ASCII white
space, so a text's ids are those of its white-space-separated chunks in a row,
and a chunk's ids are those of its runs of letters and of other characters.
Each worker remembers chunks.  New plain chunks (Latin letters, then
punctuation) are merged together by whole-array rounds, one merge per word and
round, lowest rank first and leftmost among equals, as the library does; all
other chunks go to the library itself.
"""

from __future__ import annotations

import gc
import json
import re
from functools import lru_cache

import numpy as np

#: Chunks that a worker remembers; beyond, it forgets all and starts anew.
REMEMBERED = 700_000
#: Longer chunks (bytes) are not remembered and go to the library.
LONGEST = 48
#: Texts are worked off in parts of about so many bytes, cut at white space.
PART = 1 << 20

_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile("([A-Za-zß-öø-ÿÀ-ÖØ-Þ]*)([!-&(-/:-@\\[-`{-~]*)\\Z")


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in kept}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


class WordBpe:
    """``ids(text)``: little-endian unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, chars = model["vocab"], _byte_chars()
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + end] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks, self.made = pairs[order], order, made
        self.none = len(merges)
        self.chunks: dict[bytes, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.none)

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens of one length in bytes."""
        n, size = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, size)
        tok = self.inner[raw]
        tok[:, -1] = self.final[raw[:, -1]]
        out: list[bytes] = [b""] * n
        at = np.arange(n)
        rank = self._rank(tok[:, :-1], tok[:, 1:])
        while True:
            if tok.shape[1] > 1:
                best = rank.argmin(axis=1)
                low = rank[np.arange(len(at)), best]
                done = low == self.none
            else:
                done = np.ones(len(at), bool)
            if done.any():
                step, blob = 4 * tok.shape[1], tok[done].astype("<u4").tobytes()
                for k, i in enumerate(at[done].tolist()):
                    out[i] = blob[k * step : (k + 1) * step]
                open_ = ~done
                if not open_.any():
                    return out
                at, tok, rank, best, low = at[open_], tok[open_], rank[open_], best[open_], low[open_]
            rows, width = np.arange(len(at)), tok.shape[1]
            cols = np.arange(width - 1)
            keep = cols + (cols > best[:, None])
            tok = np.take_along_axis(tok, keep, 1)
            tok[rows, best] = self.made[low]
            if width > 2:
                rank = np.take_along_axis(rank, keep[:, : width - 2] + (cols[: width - 2] == best[:, None]), 1)
                has = best < width - 2
                rank[rows[has], best[has]] = self._rank(tok[rows[has], best[has]], tok[rows[has], best[has] + 1])
                has = best > 0
                rank[rows[has], best[has] - 1] = self._rank(tok[rows[has], best[has] - 1], tok[rows[has], best[has]])

    def _from_library(self, chunk: bytes) -> bytes:
        return np.array(self.library.encode(chunk.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[bytes]) -> None:
        """Remember the ids of new chunks."""
        plain, heads, tails, words = [], [], [], set()
        for c in chunks:
            if len(c) > LONGEST:
                continue
            if c.isascii():
                low = c.lower()
                head = low.rstrip(_MARKS)
                tail, fits = low[len(head) :], head.isalpha() or not head
            else:
                m = _LATIN.match(c.decode("utf-8"))
                fits = m is not None
                head, tail = (x.lower().encode() for x in m.groups()) if m else (b"", b"")
            if not fits:
                self.chunks[c] = self._from_library(c)
                continue
            plain.append(c)
            heads.append(head)
            tails.append(tail)
        words.update(heads, tails)
        words.discard(b"")
        by_size: dict[int, list[bytes]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        ids = {b"": b""}
        for same in by_size.values():
            for at in range(0, len(same), 1 << 16):
                part = same[at : at + (1 << 16)]
                ids.update(zip(part, self._merge(part)))
        self.chunks.update(zip(plain, [ids[h] + ids[t] for h, t in zip(heads, tails)]))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        gc.disable()  # millions of short-lived lists without cycles
        try:
            return self._ids(texts)
        finally:
            gc.enable()

    def _ids(self, texts: list[str | None]) -> list[bytes]:
        out, held = [], []
        new: set[bytes] = set()
        size, get = 0, self.chunks.get
        for text in texts:
            for p in _parts((text or "").encode("utf-8")):
                chunks = p.split()
                ids = list(map(get, chunks))
                if None in ids:
                    missing = [c for c, i in zip(chunks, ids) if i is None]
                    new.update(missing)
                    held.append((ids, missing))
                    size += len(p)
                else:
                    held.append((b"".join(ids), None))
            held.append((None, None))
            if size > 8 * PART:
                out += self._joined(held, new)
                held, size = [], 0
                new = set()
        return out + self._joined(held, new)

    def _joined(self, held: list, new: set[bytes]) -> list[bytes]:
        self.learn(new)
        get, library = self.chunks.get, self._from_library
        out, parts = [], []
        for ids, missing in held:
            if ids is None:
                out.append(b"".join(parts))
                parts = []
            elif missing is None:
                parts.append(ids)
            else:
                rest = iter(missing)
                parts.append(b"".join([get(c := next(rest)) or library(c) if i is None else i for i in ids]))
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        return out


def _parts(raw: bytes):
    """``raw`` in parts of about PART bytes that end at white space."""
    at = 0
    while len(raw) - at > PART:
        m = re.compile(rb"[\x20\x09-\x0D]").search(raw, at + PART)
        if not m:
            break
        yield raw[at : m.start()]
        at = m.start()
    yield raw[at:]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The worker's own encoder for the vocabulary file at ``path``."""
    return WordBpe(path)
