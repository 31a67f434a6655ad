"""From raw documents to tokens: language, line dedup, near duplicates, mixing, encoding.

Each stage takes the documents that the stage before has kept, and all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseries.llm import bpe, langid, linededup, minhash, mixing, words
from loomseries.session import saved

# The classifier, the joins and the random draws are no SQL; tests compare them with brute force.
ORACLE_SQL = None


def _rows_of(docs: DataFrame, decided: DataFrame, keep: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id is decided with ``keep``; rows with one doc_id are decided alike.

    The decisions are few bytes a row; Spark broadcasts them if they are small
    and else splits what is skewed.
    """
    gone = decided.where(f"not ({keep})").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone["_gone"]), "left_anti")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and all other columns as ``rest``, so that no operator's names clash with theirs."""
    return docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))


def _unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns ``names`` of what was packed, some of them anew."""
    new.setdefault("text", F.col("text"))
    return df.select(*[(new[c] if c in new else F.col(f"rest.`{c}`")).alias(c) for c in names])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``) go; a missing language is filled in."""
    words.text_batches(spark)
    named = langid.predict(_packed(docs), langid.train(docs), keep=["text", "rest"])
    known = named.where(F.col("lang_pred") != langid.UNKNOWN)
    return _unpacked(known, docs.columns, lang=F.coalesce("rest.lang", "lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents of which nothing is left with them."""
    words.text_batches(spark)
    cleaned = linededup.dedup_lines(_packed(docs)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _unpacked(cleaned, docs.columns, n_chars=F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays; rows without a doc_id of their own are documents like any other.

    Texts that are NULL or without a word are near to nothing and stay; of equal
    texts the smallest doc_id stays. Rows are taken whole, so columns may have
    any names. An empty table gives an empty one.
    """
    words.text_batches(spark)
    repeated = saved(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")))
    if repeated.isEmpty():
        return _rows_of(docs, minhash.near_duplicates(docs), "kept")
    # Rows with a repeated doc_id or none get a key beyond all doc_ids, so that each is compared on its own.
    match = docs.doc_id.eqNullSafe(repeated["_id"])
    top = F.lit(docs.agg(F.max("doc_id")).first()[0] or 0).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    odd = saved(docs.join(repeated, match, "left_semi").select(row).withColumn("key", top + 1 + F.monotonically_increasing_id()))
    even = docs.join(repeated, match, "left_anti")
    keyed = even.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(odd.select(F.col("key").alias("doc_id"), "row.text"))
    decided = saved(minhash.near_duplicates(saved(keyed)).select("doc_id", "kept"))
    kept = odd.join(decided.where("kept").select(F.col("doc_id").alias("key")), "key", "left_semi")
    return _rows_of(even, decided, "kept").unionByName(kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, at their source's rate, and shuffled.

    A NULL source is a source; a NULL or empty text weighs nothing and goes at
    its source's rate. Rows with one doc_id are drawn alike. The other columns
    travel in a struct, so none clashes with the operator's own.
    """
    return _unpacked(mixing.mix(_packed(docs)), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the text decoded from them.

    A row in gives a row out: NULL and empty texts have no tokens, repeated rows
    repeat, and an empty table stays empty. Only doc_id and text are read.
    """
    words.text_batches(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last is written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
