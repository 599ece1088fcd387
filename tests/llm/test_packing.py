import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cinderbark.llm import packing as op
from cinderbark.llm.tokens import WordBpe
from tests.llm.fixtures import docs, no_docs, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_library():
    t, own = Tokenizer.from_file(PATH), WordBpe(PATH)
    texts = [r[1] for r in rows()] + ["don't it's ÀÉ aé́ İstanbul ΣΑΣ <|endoftext|> x²", "a b c\x1cd 12ab34 !!??", "aaaa bbbb." * 30, "Straße ÷× naïve,co-op", "\x00\x85 "]
    for text, got in zip(texts, own.ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_least_squares_and_plan():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = op.nonnegative_least_squares(a, np.array([3.0, 5.0]))
    assert np.allclose(a @ x, [3, 5]) and (x >= 0).all()
    assert set(op.combinations(4, 3)) == {(4,), (3, 1), (2, 2), (2, 1, 1)}
    rng = np.random.default_rng(0)
    hist = np.bincount(np.clip(rng.lognormal(3.5, 1, 5000).astype(int), 1, 256), minlength=257)
    planned = op.plan(hist, 256)
    used = np.zeros(257, int)
    for units, times in planned:
        assert sum(units) <= 256
        np.add.at(used, list(units), times)
    assert (used == hist).all()
    assert sum(t for _, t in planned) * 256 <= 1.02 * (hist * np.arange(257)).sum() + 256


def test_every_id_once_and_no_gap(spark):
    table = rows() * 3
    df = spark.createDataFrame(table, docs(spark, clash=False).schema)
    out = op.pack(df, PATH, with_ids=False).collect()
    own = WordBpe(PATH)
    ids = {t: own.ids([t])[0] + np.array([1], "<u4").tobytes() for _, t, *_ in table}
    want = defaultdict(int)
    for i, t, *_ in table:
        raw = ids[t]
        for s in range(0, len(raw) // 4, op.WINDOW):
            piece = raw[4 * s : 4 * (s + op.WINDOW)]
            want[i, s, len(piece) // 4, zlib.crc32(piece), len(raw) // 4] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in out:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= op.WINDOW


def test_ids_on_request_and_empty(spark):
    out = op.pack(docs(spark), PATH, with_ids=True).collect()
    assert len(out) == op.pack(docs(spark), PATH).count() and all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    assert op.pack(no_docs(spark), PATH).count() == 0
