"""Tables and files of unusual size: how tasks, row groups and parts are dealt."""

import re

import pyarrow as pa
import pyarrow.parquet as pq

from __spark_entry__ import SMOKE_DIR
from cinderbark.operators import present
from cinderbark.plans import corpus
from cinderbark.plans.config import Config
from cinderbark.plans.scan import Scan


def test_parts_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FILES", 50)
    rows = corpus.parts(spark, SMOKE_DIR)
    assert rows.rdd.getNumPartitions() > 2
    assert rows.select("path").distinct().count() == corpus.table(spark, SMOKE_DIR, "part").count()


def test_records_of_a_long_file_lie_in_small_row_groups(spark):
    uses = [(f"caller_{k}", "local", f"owner_{k}", f"attr_{k}", True, True) for k in range(600_000)]
    rows = spark.createDataFrame([("p", "long.py", "x")], "project_id string, path string, source string")
    found = Scan(rows, Config(), index_source=lambda source, settings: {"uses": uses}).facts
    groups = [pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in found.table.inputFiles()]
    assert max(groups) > 1
    assert found.each("uses").select("owner").distinct().count() == len(uses)


def test_mentions_split_a_long_source_by_parts(spark, monkeypatch):
    lines = [f"call_{k}(order_{k % 7}){end}" for k, end in zip(range(30_000), ["\n", "\r\n", "\r"] * 10_000)]
    text = "".join(lines)
    sources = spark.createDataFrame([("p", "long.py", text), ("p", "empty.py", ""), ("p", "none.py", None)], "project_id string, path string, source string")
    names = ["order_3", "call_0", "call_29999", "call_30000"]
    found = spark.createDataFrame([("p", n, "a.py", 1, "ORPHAN_FUNCTION", n) for n in names], "project_id string, fingerprint string, path string, line int, rule string, symbol string")
    assert len(text) > 2 * present.PART
    got = {r.fingerprint: (r.mentions, r.sample) for r in present.mentions(found, sources).collect()}
    assert got["order_3"] == (4286, [f"long.py:{k + 1}: call_{k}(order_3)" for k in (3, 10, 17, 24, 31)])
    assert got["call_29999"] == (1, ["long.py:30000: call_29999(order_4)"]) and got["call_0"][0] == 1 and got["call_30000"] == (0, [])
    monkeypatch.setattr(present, "PART", 40)
    batch = pa.RecordBatch.from_pydict({"project_id": ["p", "p"], "path": ["a.py", "b.py"], "source": [text[:3000], ""]})
    parts = [r for b in present._parts([batch]) for r in b.to_pylist()]
    assert "".join(r["source"] for r in parts) == text[:3000] and max(len(r["source"]) for r in parts) < 80
    assert [r["before"] for r in parts] == [len(re.findall("\r\n|\r|\n", text[: sum(len(x["source"]) for x in parts[:k])])) for k in range(len(parts))]
