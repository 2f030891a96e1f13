"""Bounded samples of labelled documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Longer texts (UTF-8 bytes) are no examples to learn from, so a sample has at most limit times as many bytes.
EXAMPLE_BYTES = 1 << 16


def bucket(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where: Column | None = None) -> pa.Table:
    """text and label of at most limit labelled documents, those of the smallest hashes of doc_id, in that order.

    The ids are a top-k list of limit numbers, so broadcasting them is bounded. Conflicting or
    repeated labels of a document count by their largest; null labels and ids don't count. Texts of
    more than EXAMPLE_BYTES are left out here (they are scored like any other). Of several rows with one doc_id the least text counts, so an id of any number of rows sends one.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).filter("doc_id is not null and label is not null")
    if where is not None:
        known = known.filter(where)
    top = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(top), "doc_id").filter(F.octet_length("text") <= EXAMPLE_BYTES)
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).toArrow().sort_by("doc_id")
