"""The queries ``opN_<name>``: each applies its operator to a whole table."""

from __future__ import annotations

from cinderbark.llm import archives, decontaminate, exact_dedup, licences, packing, pii, quality, sharding, simhash, url_filter


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """The vocabulary file that op1 packs with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_nnls_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer())


def op2_quality_boosting(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_licence_sentences(spark, sf_dir):
    return licences.scan(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_pii_transducers(spark, sf_dir):
    return pii.digest(pii.detect(_table(spark, sf_dir, "documents")))


def op6_template_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_histogram_sort(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_zip_warc(spark, sf_dir):
    return archives.round_trip(_table(spark, sf_dir, "pages"))


def op9_url_boosting(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("score")


def op10_simhash_pigeonring(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_nnls_packing": op1_nnls_packing,
    "op2_quality_boosting": op2_quality_boosting,
    "op3_licence_sentences": op3_licence_sentences,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii_transducers": op5_pii_transducers,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_histogram_sort": op7_histogram_sort,
    "op8_zip_warc": op8_zip_warc,
    "op9_url_boosting": op9_url_boosting,
    "op10_simhash_pigeonring": op10_simhash_pigeonring,
}

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, COALESCE(LENGTH(text), 0) AS points,
         sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, ROW_NUMBER() OVER w AS rn, FIRST_VALUE(doc_id) OVER w AS keep_id, COUNT(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, text_sha256 FROM r
"""

OP8_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, ROW_NUMBER() OVER w AS rn, FIRST_VALUE(page_id) OVER w AS first_page
  FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND rn > 1 THEN first_page END AS refers_to
FROM r
"""

ORACLE_SQL = {
    "op8_zip_warc": OP8_SQL,
    "op4_exact_dedup": OP4_SQL,
}
