"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary that op4 uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_rotated_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.ann import search

    return search(_read(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.licenses import scan

    return scan(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.toxicity import detect

    return detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.bpe import encode

    return encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).drop("text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.secrets import scan

    return scan(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.simhash import group

    return group(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.html import extract

    return extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.decontam import digest

    return digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.pii import scan

    return scan(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {
    "op1_rotated_bits": op1_rotated_bits,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash_golay": op6_simhash_golay,
    "op7_quality": op7_quality,
    "op8_html_text": op8_html_text,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
}

#: op2's and the learned operators' rows depend on their method, op4's on its vocabulary: they have brute-force tests.
ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op9_decontamination"] = rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc, sizes WHERE len(w) >= size)
),
met AS (SELECT doc_id, pos.size, i, item FROM pos JOIN win ON pos.size = win.size AND pos.win = win.win),
places AS (SELECT DISTINCT doc_id, size, i FROM met),
hit AS (
  SELECT doc_id, CAST(count(DISTINCT k) AS BIGINT) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM places) GROUP BY doc_id
),
items AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
