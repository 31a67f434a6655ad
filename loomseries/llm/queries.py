"""The dealt operators as queries over the given tables, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, importance, langid, licenses, linededup, minhash, mixing, quality, rules, sharding, topk, warczip, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, for work in Python."""
    words.text_batches(spark)
    return table(spark, sf_dir, name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards: 4 regions of 2 racks of 5 shards."""
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.balanced_tree(4, 2, 5))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(
        texts(spark, sf_dir),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(texts(spark, sf_dir))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("id % 50 = 0"), 5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their bytes, as many bytes out as in."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(texts(spark, sf_dir))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document, as a digest of the text."""
    cleaned = linededup.dedup_lines(texts(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", "removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warczip.archive(texts(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that resemble the benchmark are drawn more often."""
    return importance.resample(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(texts(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        texts(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN,
    )


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_sharding, op2_bpe, op3_topk, op4_quality, op5_minhash, op6_mixing, op7_language, op8_rules, op9_lines, op10_warc, op11_importance, op12_licenses, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": TOP_K_SQL, "op6_mixing": mixing.ORACLE, "op8_rules": rules.ORACLE, "op11_importance": importance.ORACLE, "op12_licenses": licenses.ORACLE,
    }
