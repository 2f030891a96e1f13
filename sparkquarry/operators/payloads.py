"""Nested JSON payloads of schema-free properties, at four levels of size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators.layout import ranked
from sparkquarry.store import Shelf

PAGE, TOP = 100, 5
LEVELS = ("full", "truncated", "summary", "dropped")


def _numbered(events: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """Events with their number in their user's history, counted from 0 over ranges, not in one task for each user."""
    rows = ranked(events, [F.col("user_id"), F.col("ts"), F.col("event_id")], shelf, name)
    first = rows.groupBy("user_id").agg(F.min("rank").alias("first"))
    return rows.join(first, "user_id").withColumn("at", F.col("rank") - F.col("first"))


def _entry() -> Column:
    return F.struct("at", F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("v").alias("props")).alias("entry"))


def payloads(events: DataFrame, shelf: Shelf, page: int = PAGE, top: int = TOP) -> DataFrame:
    """user_id, level, page, payload (JSON), bytes, for events (event_id, user_id, event_type, ts, props).

    Properties are parsed as they come, without a schema (what is no JSON counts as null). Levels:
    `full` lists all events, in pages of at most `page`, so no row grows with a user's history;
    `truncated` lists the first `top` and how many more there are; `summary` gives counts and the
    sum of the property k by type; `dropped` only the number of events. Rows without a user are left out.
    """
    rows = _numbered(events.filter("user_id is not null").withColumn("v", F.try_parse_json("props")), shelf, "numbered")
    listed = F.transform(F.array_sort(F.collect_list(_entry()), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda x: x["entry"]).alias("events")
    out = lambda df, level, *fields: df.select("user_id", F.lit(level).alias("level"), "page", F.to_json(F.struct(F.col("user_id").alias("user"), *fields)).alias("payload"))
    pages = rows.withColumn("page", F.expr(f"at div {page}")).groupBy("user_id", "page").agg(listed)
    head = rows.filter(F.col("at") < top).groupBy("user_id").agg(listed)
    types = rows.groupBy("user_id", F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.try_variant_get("v", "$.k", "long")), F.lit(0).cast("long")).alias("k"))
    brief = types.groupBy("user_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("type", "n", "k"))).alias("types")).withColumn("page", F.lit(0).cast("long"))
    short = head.join(brief.select("user_id", "n", "page"), "user_id").withColumn("more", F.col("n") - F.size("events"))
    all_ = out(pages, "full", "page", "events").unionByName(out(short, "truncated", "events", "more")).unionByName(out(brief, "summary", "n", "types")).unionByName(out(brief, "dropped", "n"))
    return all_.withColumn("bytes", F.octet_length("payload").cast("long"))


def fitting(all_: DataFrame, most: int) -> DataFrame:
    """Of each user the most detailed level whose payloads are together at most `most` bytes, else `dropped`: user_id, level, bytes."""
    order = F.when(F.col("level") == LEVELS[0], 0).when(F.col("level") == LEVELS[1], 1).when(F.col("level") == LEVELS[2], 2).otherwise(3)
    total = all_.groupBy("user_id", "level").agg(F.sum("bytes").alias("bytes")).withColumn("order", order).filter((F.col("bytes") <= most) | (F.col("order") == 3))
    best = total.groupBy("user_id").agg(F.min_by(F.struct("level", "bytes"), "order").alias("b"))
    return best.select("user_id", "b.level", "b.bytes")
