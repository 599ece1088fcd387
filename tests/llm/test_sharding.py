import zlib

from pyspark.sql import functions as F

from cinderbark.llm import sharding as op
from tests.llm.fixtures import DOCS, docs, no_docs, rows, words


def test_bytes_are_even_and_slots_have_no_gap(spark):
    table = [(i, words(1 + i % 50, i) if i % 3 else "the same text " * 8, "en", "s", 0) for i in range(3000)]
    out = op.shard(spark.createDataFrame(table, DOCS), shards=8, tolerance=0.01, range_rows=50).collect()
    assert len(out) == 3000 and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and max(abs(s - mean) for s in sizes.values()) < 0.01 * mean + 500
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark):
    out = op.shard(docs(spark)).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want
    slots = {}
    for r in out:
        assert 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert op.shard(no_docs(spark)).count() == 0


def test_counts_are_exact(spark):
    import numpy as np

    keyed = spark.range(1000).select((F.col("id") * 1000).alias("key"), (F.col("id") % 7 + 1).alias("size"))
    below, number = op._below(keyed, np.array([0, 500, 1000, 50_000, 10**6], np.uint64))
    assert number.tolist() == [0, 1, 1, 50, 1000]
    assert below.tolist() == [sum(i % 7 + 1 for i in range(n)) for n in number]


def test_splitters_match_a_sorted_list(spark):
    """Brute force: the bytes below each splitter are as near to the wanted ones as the slack asks."""
    import random

    r = random.Random(3)
    table = sorted((r.getrandbits(64), r.randint(8, 900)) for _ in range(4000))
    keyed = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k, s) for k, s in table], "key bigint, size bigint")
    total = sum(s for _, s in table)
    for shards in (2, 5, 24):
        found = op.splitters(keyed, shards, total, len(table), 450)
        assert found == sorted(found) and len(found) == shards - 1
        for k, x in enumerate(found, 1):
            below = sum(s for key, s in table if key < x)
            assert abs(below - total * k // shards) <= 900


def test_many_empty_texts_do_not_fill_one_shard(spark):
    table = [(i, None if i % 6 else words(30, i), "en", "s", 0) for i in range(6000)]
    out = op.shard(spark.createDataFrame(table, DOCS), shards=6, range_rows=100).collect()
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) < 600
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_hold_ascending_keys_of_their_own(spark):
    """Equal texts are neighbours: a group smaller than a shard lies in two at most, next to each other."""
    table = [(i, words(20, i // 9), "en", "s", 0) for i in range(3600)]
    groups = {}
    for r in op.shard(spark.createDataFrame(table, DOCS), range_rows=100).collect():
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(max(s) - min(s) <= 1 for s in groups.values())
