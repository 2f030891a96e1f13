"""An audit log that a stream appends to: numbered, redacted rows whose hashes form a chain for each kind of event.

A batch of the stream is one folder of each table, written over when the batch comes again, and it goes
on from the heads that the batch before left. So a replay after a crash changes nothing, wherever the
crash was. Rows of a chain are put together in blocks of BLOCK rows, and the chain goes over the blocks:
rows are hashed and blocks digested in parallel, only one link for each block is made in order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators.layout import ranked
from sparkquarry.store import Shelf, shared_dir
from sparkquarry.streaming.operations import run, stream_of

BLOCK = 1000
LOG = "chain string, seq long, block long, event_id long, user string, row_hash string"
LINKS = "chain string, block long, n long, digest string, link string"
HEADS = "chain string, seq long, block long, link string"


def redacted_user(user: Column) -> Column:
    """The first 12 digits of the hash of a user id."""
    return F.left(F.sha2(F.coalesce(user.cast("string"), F.lit("")), 256), F.lit(12))


def row_hash() -> Column:
    text = F.concat_ws("|", "chain", F.coalesce(F.col("event_id").cast("string"), F.lit("")), "user", F.coalesce(F.unix_micros("ts").cast("string"), F.lit("")))
    return F.sha2(text, 256)


def entries(events: DataFrame, heads: DataFrame, shelf: Shelf) -> DataFrame:
    """Log rows of events (event_id, event_type, user_id, ts) behind heads (chain, seq, block, link).

    A batch begins a new block in each of its chains. Numbers follow (ts, event_id, row_hash) and are dealt
    by ranges, so a chain that holds most rows is no single task; equal rows stand next to each other. Null types are the chain ''.
    """
    rows = events.select(F.coalesce("event_type", F.lit("")).alias("chain"), "event_id", redacted_user(F.col("user_id")).alias("user"), "ts").withColumn("row_hash", row_hash())
    rows = ranked(rows, [F.col(c) for c in ("chain", "ts", "event_id", "row_hash")], shelf, "ranked")
    first = rows.groupBy("chain").agg(F.min("rank").alias("first"))
    rows = rows.join(first, "chain").withColumn("place", F.col("rank") - F.col("first") + 1).join(heads.select("chain", F.col("seq").alias("seq_before"), F.col("block").alias("block_before")), "chain", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.select("chain", (number("seq_before") + F.col("place")).alias("seq"), (number("block_before") + 1 + F.expr(f"(place - 1) div {BLOCK}")).alias("block"), "event_id", "user", "row_hash")


def links(log: DataFrame, heads: DataFrame) -> DataFrame:
    """One link for each block: the hash of the link before and the block's digest."""
    blocks = log.groupBy("chain", "block").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "row_hash"))), lambda x: x["row_hash"]), ""), 256).alias("digest"))
    chains = blocks.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("block", "n", "digest"))).alias("blocks")).join(heads.select("chain", F.col("link").alias("before")), "chain", "left")
    start = F.struct(F.coalesce("before", F.lit("")).alias("link"), F.array().cast("array<struct<block: long, n: long, digest: string, link: string>>").alias("out"))

    def step(acc, b):
        link = F.sha2(F.concat(acc["link"], b["digest"]), 256)
        return F.struct(link.alias("link"), F.concat(acc["out"], F.array(F.struct(b["block"].alias("block"), b["n"].alias("n"), b["digest"].alias("digest"), link.alias("link")))).alias("out"))

    return chains.select("chain", F.explode(F.aggregate("blocks", start, step, lambda acc: acc["out"])).alias("b")).select("chain", "b.*")


class AuditLog:
    """Tables log, links and heads under root, one folder for each batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{name}")

    def heads(self, before: int) -> DataFrame:
        """The last head of each chain in batches before the given one."""
        rows = self._table("heads", HEADS).filter(F.col("batch") < before)
        return rows.groupBy("chain").agg(*(F.max_by(c, "batch").alias(c) for c in ("seq", "block", "link")))

    def append(self, batch: DataFrame, k: int) -> None:
        """Batch k; the same batch again writes the same rows in the same places. Heads come last."""
        heads = self.heads(k)
        shelf = Shelf(self.spark, "audit-batch")
        log = entries(batch, heads, shelf)
        at = lambda name: f"{self.root}/{name}/batch={k}"
        log.write.mode("overwrite").parquet(at("log"))
        shelf.drop("ranked")
        log = self.spark.read.schema(LOG).parquet(at("log"))
        links(log, heads).write.mode("overwrite").parquet(at("links"))
        made = self.spark.read.schema(LINKS).parquet(at("links"))
        ends = log.groupBy("chain").agg(F.max("seq").alias("seq")).join(made.groupBy("chain").agg(F.max("block").alias("block"), F.max_by("link", "block").alias("link")), "chain")
        ends.write.mode("overwrite").parquet(at("heads"))

    def log(self) -> DataFrame:
        return self._table("log", LOG).drop("batch")

    def links(self) -> DataFrame:
        return self._table("links", LINKS).drop("batch")

    def broken(self) -> DataFrame:
        """chain, block of the links that do not follow from the rows: a row was changed, added, taken out or moved since."""
        none = self.spark.createDataFrame([], HEADS)
        want = links(self.log(), none).select("chain", "block", F.col("link").alias("want"))
        both = self.links().join(want, ["chain", "block"], "full")
        return both.filter(~F.col("link").eqNullSafe(F.col("want"))).select("chain", "block")


def run_available(spark: SparkSession, path: str, files_at_once: int | None = None, root: str | None = None) -> AuditLog:
    """The log of all events of a parquet table, taken as a stream."""
    log = AuditLog(spark, root or f"{shared_dir(spark)}/audit-{uuid.uuid4().hex[:12]}")
    run(stream_of(spark, path, files_at_once), log.append, log.root)
    return log
