import hashlib
import re
import zlib

import corpus_pipeline
from cinderbark.llm import decontaminate, quality
from cinderbark.llm.tokens import word_bpe
from cinderbark.llm.queries import tokenizer
from tests.llm.fixtures import docs as odd_docs
from tests.llm.fixtures import no_docs
from tests.llm.test_simhash import similar_components

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    forest = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [(i, t) for i, t in kept if forest.score(quality.statistics(t)[None])[0] >= 0.3]
    groups = {}
    for i, t in kept:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).digest()
        groups.setdefault(key, []).append((-len(t or ""), i, t))
    kept = [(i, t) for _, i, t in (min(g) for g in groups.values())]
    labels = similar_components([t for _, t in kept])
    first = {}
    for label, row in zip(labels, kept):
        first[label] = min(first.get(label, row), row)
    kept = sorted(first.values())
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not any(b in " ".join(t.split()) for b in items if len(b.split()) >= decontaminate.LEAST)]
    own, want = word_bpe(tokenizer()), set()
    for i, t in kept:
        raw = own.ids([t])[0] + b"\1\0\0\0"
        want |= {(i, s, zlib.crc32(raw[4 * s : 4 * (s + 2048)])) for s in range(0, len(raw) // 4, 2048)}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in out} == want and len(out) == len(want)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_odd_empty_and_clashing_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeats and clashing names go through all stages; an empty table gives none."""
    for name, table in (("odd", odd_docs(spark)), ("none", no_docs(spark))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
        if name == "none":
            assert out == []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, table, folder)
            assert kept.columns == table.columns and kept.count() <= table.count()
