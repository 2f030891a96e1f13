"""Quality report: overall score, recommendations, roadmap; progress and cleanup of running work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.rules import at_least, clamp, first_of, six

# Weights of the components.
WEIGHTS = {"complexity": 0.20, "duplication": 0.15, "debt": 0.25, "coverage": 0.20, "performance": 0.10, "maintainability": 0.10}


def overall(components: DataFrame) -> DataFrame:
    """The six components, their weighted sum and the grade, for each row."""
    total = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    grade = at_least(total, (90, "excellent"), (75, "good"), (60, "fair"), default="poor")
    return components.select(*(F.round(c, 4).alias(c) for c in WEIGHTS), F.round(total, 4).alias("overall"), grade.alias("grade"))


def recommendations(clusters: DataFrame, tested: DataFrame, measured: DataFrame) -> DataFrame:
    """kind, target, effort (hours, in quarters), benefit, roi, priority, effort_band from duplicate clusters, testability below 65 and maintainability below 40."""
    row = lambda df, kind, target, effort, benefit: df.select(F.lit(kind).alias("kind"), target.alias("target"), effort.cast("double").alias("effort"), benefit.cast("double").alias("benefit"))
    base = first_of((F.col("score") < 40, 8), (F.col("score") < 60, 4), default=2)
    rows = reduce(DataFrame.unionByName, [
        row(clusters.filter(F.col("priority").isin("critical", "high")), "duplication", F.col("cluster"), clamp(0.1 * F.col("lines") * F.greatest(F.lit(1.0), 0.3 * F.col("n")), 1.0, 24.0), F.col("lines") * F.col("n")),
        row(tested.filter("score < 65"), "testing", F.col("name"), F.least(F.lit(32.0), base * (1 + 0.5 * F.col("mocks"))), 2 * (100 - F.col("score"))),
        row(measured.filter("mi < 40"), "maintainability", F.col("name"), clamp(0.3 * (80 - F.col("mi")), 2.0, 20.0), 1.2 * (100 - F.col("mi"))),
    ])
    return _weighed(rows)


def _weighed(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("effort", F.round(F.col("effort") * 4) / 4).withColumn("benefit", six(F.col("benefit")))
    out = out.withColumn("roi", F.round(F.col("benefit") / F.col("effort"), 2))
    return out.withColumn("priority", at_least(F.col("roi"), (40, "critical"), (20, "high"), (10, "medium"), default="low")).withColumn("effort_band", at_least(F.col("effort"), (16, "high"), (4, "medium"), default="low"))


# Hours of a performance fix by kind of finding.
FIX_HOURS = {"nested_loops": 6.0, "sync_in_async": 6.0, "memory_leak_risk": 8.0}


def six_sources(clusters: DataFrame, tested: DataFrame, measured: DataFrame, scored: DataFrame, files: DataFrame, items: DataFrame, worst: int = 10) -> DataFrame:
    """recommendations() and those of the other three sources: functions of a cyclomatic complexity above 15; the `worst` files by debt whose health (100 less the debt score) is 60 or below; performance items of high or critical severity."""
    row = lambda df, kind, target, effort, benefit: df.select(F.lit(kind).alias("kind"), target.alias("target"), effort.cast("double").alias("effort"), benefit.cast("double").alias("benefit"))
    health = F.greatest(F.lit(0.0), 100 - F.col("score"))
    indebted = files.withColumn("health", health).filter("health <= 60 and file_path is not null").orderBy("health", "file_path").limit(worst)
    hours = first_of(*((F.col("item") == k, h) for k, h in FIX_HOURS.items()), default=5.0)
    rows = reduce(DataFrame.unionByName, [
        row(scored.filter("cyclomatic > 15"), "complexity", F.col("name"), clamp((F.col("cyclomatic") - 10) * 0.5 * F.greatest(F.lit(1.0), F.col("lines") / 100), 2.0, 40.0), F.col("cyclomatic")),
        row(indebted, "debt", F.col("file_path"), F.greatest(F.col("hours"), F.lit(0.25)), 100 - F.col("health")),
        row(items.filter((F.col("category") == "performance") & F.col("severity").isin("high", "critical")), "performance", F.concat_ws("/", "name", "item"), F.least(F.lit(24.0), hours * (1 + F.col("impact") / 100)), 1.5 * F.col("impact")),
    ])
    return recommendations(clusters, tested, measured).unionByName(_weighed(rows))


def ranked(rows: DataFrame, top: int = 20) -> DataFrame:
    return rows.orderBy(F.desc("roi"), F.desc("benefit"), "kind", "target").limit(top)


def roadmap(rows: DataFrame) -> DataFrame:
    """A phase for each kind, the best mean return first; its window holds one row for each kind."""
    g = rows.groupBy("kind").agg(F.count("*").alias("n"), six(F.sum("effort")).alias("hours"), F.avg("roi").alias("r"))
    w = Window.orderBy(F.desc("r"), "kind")
    weeks = F.ceil(F.col("hours") / 40)
    share = lambda x: six(x * F.col("hours"))
    out = g.withColumn("phase", F.row_number().over(w).cast("long")).withColumn("until_week", F.sum(weeks).over(w).cast("long"))
    return out.select("kind", "n", "hours", "phase", "until_week", share(0.7).alias("work_hours"), share(0.2).alias("test_hours"), share(0.1).alias("review_hours"), F.greatest(F.lit(2), F.ceil(F.col("hours") / (40 * weeks))).cast("long").alias("team"), share(100.0).alias("cost"))


def progress(done: DataFrame, total: int, *keys: str) -> DataFrame:
    """done(ts, ..) -> processed, throughput (for each second), eta_seconds (null without throughput), share."""
    out = done.groupBy(*keys).agg(F.count("*").alias("processed"), (F.max("ts").cast("double") - F.min("ts").cast("double")).alias("elapsed"))
    rate = F.when(F.col("elapsed") > 0, F.col("processed") / F.col("elapsed"))
    left = F.greatest(F.lit(total) - F.col("processed"), F.lit(0))
    return out.select(*keys, "processed", F.round(F.coalesce(rate, F.lit(0.0)), 9).alias("throughput"), F.round(F.coalesce(left / rate, F.lit(-1.0)), 3).alias("eta_seconds"), six(F.least(F.lit(1.0), F.col("processed") / total)).alias("share"))


def cleanup_queue(tasks: DataFrame, now, retention_hours: int = 24) -> DataFrame:
    """tasks(id, kind, ts, priority) that are older than the retention: age, and the place in the queue of their kind by priority, then age."""
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("ts").cast("double")) / 3600
    w = Window.partitionBy("kind").orderBy(F.desc("priority"), "ts", "id")
    return tasks.withColumn("age_hours", six(age)).filter(F.col("age_hours") > retention_hours).select("id", "kind", "priority", "age_hours", F.row_number().over(w).cast("long").alias("place"))
