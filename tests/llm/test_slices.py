"""Batches of texts in small slices."""

import pyarrow as pa

from cinderbark.llm.common import slices


def test_texts_come_in_small_slices():
    texts = ["a" * 10, None, "b" * 300, "", "c" * 2_000_000, "d"] * 3
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(len(texts)))})
    parts = list(slices([batch, batch.slice(0, 0), batch.slice(5, 7)]))
    assert [n for p in parts for n in p.column("n").to_pylist()] == [*range(len(texts)), *range(5, 12)]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 1 << 20 for p in parts) and len(parts) > 6
