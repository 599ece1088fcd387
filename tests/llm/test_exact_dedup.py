import hashlib
import re
from collections import defaultdict

import pytest

from cinderbark.llm import exact_dedup as op
from tests.llm.fixtures import DOCS, docs, no_docs, rows


def brute(table):
    groups = defaultdict(list)
    for k, (i, t, *_) in enumerate(table):
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, k, i))
    return sorted((str(i), str(min(g)[4]), len(g), d) for d, g in groups.items() for *_, i in g)


@pytest.mark.parametrize("least", [1, 64])
def test_matches_brute_force(spark, least):
    out = op.exact_dedup(docs(spark), least=least).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == brute(rows())
    assert sum(r.kept for r in out) == len({r.text_sha256 for r in out})


def test_heavy_group_takes_the_broadcast_way(spark):
    table = [(i, "same text" + " " * (i % 3), "en", "s", 0) for i in range(500)] + [(1000 + i, f"t{i}", "en", "s", 0) for i in range(200)]
    df = spark.createDataFrame(table, DOCS)
    narrow = op.digests(df.selectExpr("*", "struct(doc_id AS f, doc_id AS r) AS row_id"), "row_id")
    heavy = op.heavy_digests(narrow).collect()
    assert [(h.group_size, h.win.doc_id) for h in heavy] == [(500, 2)]
    kept = op.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, *range(1000, 1200)]


def test_empty_and_clashing_columns(spark):
    assert op.exact_dedup(no_docs(spark)).count() == 0
    kept = op.keep_first(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == len({d for *_, d in brute(rows())})


def test_native_plan(spark):
    plan = op.exact_dedup(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def derived(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "docs")
    docs(spark).write.parquet(path)
    table = spark.read.parquet(path)
    return table, {
        "explode": table.withColumn("part", F.explode(F.array(F.lit(1), F.lit(2)))),
        "union": table.union(table),
        "join": table.crossJoin(spark.range(2)),
        "twice": spark.read.parquet(path, path),
        "metadata": table.union(table).withColumn("_metadata", F.lit(1)),
    }


def test_rows_of_derived_inputs_are_told_apart(spark, tmp_path):
    from cinderbark.llm.common import with_row_id

    table, tables = derived(spark, tmp_path)
    for name, df in tables.items():
        out = with_row_id(df, "own_row")
        assert out.columns == [*df.columns, "own_row"], name
        assert out.select("own_row").distinct().count() == df.count() == 2 * table.count(), name
    assert with_row_id(table.filter("doc_id > 3").select("doc_id"), "own_row").select("own_row").distinct().count() == table.filter("doc_id > 3").count()


def test_operators_on_a_derived_input(spark, tmp_path):
    """Copies of a file's rows are documents of their own for every operator that names rows."""
    from pyspark.sql import functions as F

    from cinderbark.llm import archives, sharding, simhash

    table, tables = derived(spark, tmp_path)
    df, n = tables["explode"], 2 * table.count()
    texts = len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows()})
    out = op.exact_dedup(df).collect()
    assert len(out) == n and sum(r.kept for r in out) == texts == op.keep_first(df).count()
    assert simhash.keep_one(df).count() == simhash.keep_one(table).count()
    slots = [(r.shard, r.slot) for r in sharding.shard(df).collect()]
    assert len(slots) == len(set(slots)) == n
    kinds = archives.round_trip(df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).groupBy("record_type").count().collect()
    large = [t for _, t, *_ in rows() if len((t or "").encode()) >= 1000]
    revisits = 2 * len(large) - len(set(large))
    assert {r["record_type"]: r["count"] for r in kinds} == {"response": n - revisits, "revisit": revisits}
