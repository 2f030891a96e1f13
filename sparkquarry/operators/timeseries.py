"""Operators over events(user_id, ts, event_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.rules import above, first_of, six


def ewma(events: DataFrame, keep: float = 0.9) -> DataFrame:
    """Exponential mean of each user's values in order of (ts, event_id). It is the sum of values weighted by keep ** (rows after it), so it is a plain aggregate over a window's row numbers."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.filter("value is not null").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    weight = F.when(F.col("k") == 1, 1.0).otherwise(1 - keep) * F.pow(F.lit(keep), F.col("n") - F.col("k"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * weight), 4).alias("ewma"))


def halving(events: DataFrame) -> DataFrame:
    """Each user's mean by (old + new) / 2 in order of (ts, event_id)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.filter("value is not null").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    weight = F.pow(F.lit(0.5), F.col("n") - F.col("k") + F.when(F.col("k") == 1, 0).otherwise(1))
    return rows.groupBy("user_id").agg(six(F.sum(F.col("value") * weight)).alias("mean"))


def trend(events: DataFrame, last: int = 10) -> DataFrame:
    """Slope of the last values of each user over their order, the direction (over 1 % of the mean), and how sure it is: ten times the slope over the mean, 1 at most; for a stable one what is left to 1; 0 for a single value."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = events.filter("value is not null").withColumn("back", F.row_number().over(w)).filter(F.col("back") <= last)
    out = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope("value", -F.col("back")).alias("s"), F.avg("value").alias("m"))
    direction = first_of((F.abs("s") <= 0.01 * F.abs("m"), "stable"), (F.col("s") > 0, "increasing"), (F.col("s") < 0, "decreasing"), default="stable")
    sure = F.least(10 * F.abs("s") / F.nullif(F.abs("m"), F.lit(0.0)), F.lit(1.0))
    sure = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(F.when(direction == "stable", 1 - sure).otherwise(sure), F.lit(0.0)))
    return out.select("user_id", "n", F.round("s", 4).alias("slope"), direction.alias("direction"), six(sure).alias("confidence"))


def health(events: DataFrame, limit_us: int = 3_600_000_000, healthy: float = 0.10) -> DataFrame:
    """event_type, operations, timeouts, rate, healthy, mean_seconds, longest_seconds: an event is an operation that the user's next event ends, a timeout if that takes longer than the limit; rates below `healthy` are healthy. A user's last event is still running and counts for neither."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("took", F.lead(F.unix_micros("ts")).over(w) - F.unix_micros("ts")).filter("took is not null")
    out = rows.groupBy("event_type").agg(F.count("*").alias("operations"), F.count_if(F.col("took") > limit_us).alias("timeouts"), F.round(F.avg(F.col("took") / 1e6), 4).alias("mean_seconds"), F.round(F.max("took") / 1e6, 4).alias("longest_seconds"))
    rate = F.col("timeouts") / F.col("operations")
    return out.withColumn("rate", six(rate)).withColumn("healthy", rate < healthy)


def pressure(events: DataFrame, capacity: float) -> DataFrame:
    """Level of each value against the capacity, counted."""
    use = F.col("value") / capacity
    level = first_of((use < 0.5, "low"), (use < 0.7, "medium"), (use < 0.85, "high"), default="critical")
    return events.filter("value is not null").groupBy("event_type", level.alias("level")).agg(F.count("*").alias("n"), six(F.avg("value")).alias("mean"))


def violations(events: DataFrame, warning: float, critical: float) -> DataFrame:
    """Values over a limit; critical shadows warning."""
    return events.select("event_id", "user_id", above(F.col("value"), (critical, "critical"), (warning, "warning")).alias("severity")).filter("severity is not null")


def gap_histogram(events: DataFrame) -> DataFrame:
    """Buckets of the time between a user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    rows = events.withColumn("gap", gap).filter("gap is not null")
    bucket = first_of((F.col("gap") < 5_000_000, "fast"), (F.col("gap") < 30_000_000, "slow"), (F.col("gap") < 3_600_000_000, "very_slow"), default="idle")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def transitions(events: DataFrame) -> DataFrame:
    """Counts of a user's consecutive event types."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn("before", F.lag("event_type").over(w)).filter("before is not null").groupBy(F.col("before").alias("src"), F.col("event_type").alias("dst")).agg(F.count("*").alias("n"))


def latest(events: DataFrame, k: int = 100) -> DataFrame:
    """Ring buffer: the last k events of each type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def context(turns: DataFrame, reach: int = 2) -> DataFrame:
    """Turns of a conversation with the sizes of those around."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-reach, reach)
    return turns.select("conv_id", "turn", F.count("*").over(w).alias("n_around"), F.sum(F.length("text")).over(w).alias("chars_around"))
