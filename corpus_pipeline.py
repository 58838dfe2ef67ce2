"""Corpus preparation: quality rules, line dedup, near-dedup by shingles, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and is written as Parquet and read again before the next one.  All stages but
the last return the columns of ``documents``; a text that a stage changes gets its new
n_chars.  Odd rows: null texts have no words and go in the first stage; repeated rows
are one document to line dedup and near-dedup keeps one row of them; texts of any length
are taken whole; further columns, whatever their names, go through unchanged (near-dedup
orders equal doc_ids by the whole row, so they must be of types that can be ordered); an
empty table stays empty through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm import line_dedup, line_quality, packing, pii_boost
from vigil.llm._common import ensure_checkpoint_dir, name, remove_table, table
from vigil.llm.near_copies import components as near_copies_by_shingles


#: The columns that stages work on; all others travel in one struct, out of the operators' way.
OWN, CARRIED = ("doc_id", "text", "lang", "source", "n_chars"), "carried_columns"


def _packed(docs: DataFrame) -> DataFrame:
    more = [c for c in docs.columns if c not in OWN]
    return docs.select(*[c for c in docs.columns if c in OWN], *[F.struct(*[name(c) for c in more]).alias(CARRIED)][: len(more)])


def _unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*[F.col(c) if c in OWN else F.col(CARRIED).getField(c).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that more than 20 texts of their source hold."""
    judged = line_quality.judge_lines(_packed(docs)).where("kept")
    text = F.when(F.col("n_removed_lines") > 0, F.col("clean_text")).otherwise(F.col("text"))
    return _unpacked(judged.withColumn("text", text), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a line that at least five of them hold stays in the last one only."""
    return _unpacked(line_dedup.apply(line_dedup.build(docs), _packed(docs)), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word Jaccard of 0.8 or more) the document with the smallest doc_id (one row of it)."""
    named = near_copies_by_shingles(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = named.select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(F.struct(*[name(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"))
    rows = rows.join(first, F.col("id").eqNullSafe(F.col("first")), "left_semi")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("row"))).where("n = 1")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return _unpacked(pii_boost.redact(pii_boost.find_spans(_packed(docs))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document goes."""
    return packing.pack(packing.token_pieces(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("private", private), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder until the next stage has its own."""
    docs, path = table(spark, sf_dir, "documents"), None
    for title, stage in STAGES[:-1]:
        before, path = path, f"{ensure_checkpoint_dir(spark)}/pipeline-{title}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_table(spark, before)
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are checkpointed, so the last copy is not read again
    remove_table(spark, path)
    return packed


#: Fingerprints, boosted trees and token ids have no SQL form: the stages are tested against plain versions.
ORACLE_SQL = None
