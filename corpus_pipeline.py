"""A corpus pipeline of five of the text operators. Each stage takes (spark, docs, sf_dir) and its rows are written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import decontaminate, minhash, pieces, pii, quality_rules
from sparkquarry.store import Shelf


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; repeated rows are judged each. Labels may be missing or an empty table."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id; of equal rows one stays. Null and empty texts are no copies of each other."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go, in whole texts of any length; null and empty ones stay. An empty benchmark keeps all."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; all rows stay, null texts stay null, and n_chars is the new length."""
    return pii.masked(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids, mark_positions, round_trip of all rows; null texts have null pieces, empty ones none, long ones are cut into chunks and put together again."""
    out = pieces.encode(docs, check="round_trip")
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "mark_positions", "round_trip")


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontamination), ("personal data", personal_data), ("sentencepiece", encoding)]
#: The learned rules, the tagger and the pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = shelf.put(f"stage_{k}", stage(spark, docs, sf_dir))
        if k:
            shelf.drop(f"stage_{k - 1}")
    return docs
