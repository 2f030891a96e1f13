"""Technical debt: items from rules, scores, and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions.rules import above, first_of, six
from sparkquarry.operators.layout import ranked
from sparkquarry.store import Shelf

# Base score of each severity.
BASE = {"critical": 10.0, "severe": 10.0, "high": 6.0, "medium": 3.0, "low": 1.0}


def _item(kind: str, category: str, severity, hours):
    return F.struct(F.lit(kind).alias("item"), F.lit(category).alias("category"), severity.alias("severity"), hours.cast("double").alias("hours"))


def _holding(rows: DataFrame, keep: list, rules) -> DataFrame:
    """A row for each rule that holds, in one pass over rows."""
    return rows.select(*keep, F.explode(F.array_compact(F.array(*(F.when(when, item) for when, item in rules)))).alias("x")).select("file_path", "name", "x.*")


def function_items(scored: DataFrame) -> DataFrame:
    """Items of single functions."""
    lines, params = F.col("lines"), F.col("params")
    rules = (
        (lines > 30, _item("long_method", "smell", above(lines, (100, "high"), (50, "medium"), default="low"), 2 + lines / 50)), (params > 5, _item("too_many_parameters", "smell", above(params, (10, "high"), (7, "medium"), default="low"), 0.25 * params)),
        ((lines > 20) & (params > 2), _item("nested_loops", "performance", above(lines, (50, "high"), (25, "medium"), default="low"), F.lit(2.0))), (F.col("is_async") & (lines > 15), _item("sync_in_async", "performance", F.lit("high"), F.lit(1.5))),
        ((lines > 30) & (params > 3), _item("memory_leak_risk", "performance", F.lit("medium"), F.lit(1.0))), (F.col("level").isin("high", "severe"), _item("high_complexity", "complexity", F.col("level"), 1 + F.col("weighted") / 10 * 2)),
    )
    return _holding(scored, ["file_path", "name"], rules)


def file_items(files: DataFrame) -> DataFrame:
    """Items of files(file_path, imports, exports, functions, classes)."""
    rules = (
        ((F.col("imports") > 10) & (F.col("exports") > 5), _item("circular_dependency", "architecture", F.lit("high"), F.lit(4.0))), (F.col("functions") + 3 * F.col("classes") > 50, _item("god_object", "architecture", F.lit("high"), F.lit(6.0))),
        (F.col("imports") > 15, _item("tight_coupling", "architecture", F.lit("medium"), F.lit(3.0))), (F.col("imports") > 20, _item("excessive_imports", "architecture", F.lit("low"), F.lit(0.5))),
    )
    return _holding(files, ["file_path", F.lit(None).cast("string").alias("name")], rules)


def class_items(classes: DataFrame) -> DataFrame:
    """Items of classes(file_path, name, methods, lines)."""
    m, n = F.col("methods"), F.col("lines")
    severity = first_of(((m > 50) | (n > 1000), "high"), ((m > 30) | (n > 750), "medium"), default="low")
    rules = (((m > 20) | (n > 500), _item("large_class", "smell", severity, 4 + 2 * m / 10)), (m > 15, _item("too_many_methods", "smell", F.lit("medium"), 0.5 * m)))
    return _holding(classes, ["file_path", "name"], rules)


def duplication_items(clusters: DataFrame) -> DataFrame:
    """Items of exact clusters (cluster, burden, priority)."""
    rules = ((F.col("priority").isin("critical", "high"), _item("exact_duplication", "duplication", F.lit("high"), 0.1 * F.col("burden"))),)
    return _holding(clusters, [F.lit(None).cast("string").alias("file_path"), F.col("cluster").alias("name")], rules)


def scored_items(items: DataFrame) -> DataFrame:
    """Adds score, confidence, impact, change_frequency, priority."""
    base = first_of(*((F.col("severity") == s, v) for s, v in BASE.items()), default=1.0)
    out = items.withColumn("score", base * (1 + F.least(F.col("hours") / 10, F.lit(2.0))))
    confidence = 0.7 + first_of((F.col("item").isin("high_complexity", "exact_duplication"), 0.2), (F.col("item").isin("memory_leak_risk", "circular_dependency"), -0.1), default=0.0)
    out = out.withColumn("confidence", F.round(F.least(confidence, F.lit(1.0)), 2)).withColumn("impact", F.col("score") * F.col("confidence"))
    path = F.coalesce(F.lower("file_path"), F.lit(""))
    frequency = 0.3 + F.when(path.contains("service") | path.contains("controller"), 0.3).otherwise(0.0) + F.when(path.contains("component"), 0.2).otherwise(0.0) - F.when(path.contains("util") | path.contains("helper"), 0.1).otherwise(0.0)
    out = out.withColumn("change_frequency", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), frequency)), 2))
    return out.withColumn("priority", above(0.4 * F.col("impact") + 0.3 * F.col("change_frequency"), (8, "critical"), (6, "high"), (3, "medium"), default="low"))


def by_category(scored: DataFrame) -> DataFrame:
    high = F.count_if(F.col("severity").isin("high", "severe", "critical")) / F.count("*")
    out = scored.groupBy("category").agg(F.count("*").alias("n_items"), six(F.sum("score")).alias("score"), six(F.sum("hours")).alias("hours"), six(high).alias("high_share"))
    return out.withColumn("trend", above(F.col("high_share"), (0.5, "worsening"), (0.2, "stable"), default="improving")).withColumn("effort", above(F.col("hours"), (40, "large"), (16, "medium"), default="small"))


def by_file(scored: DataFrame, shelf: Shelf, categories=("smell", "architecture", "performance", "complexity")) -> DataFrame:
    """Pivot of scores by category, priority, and rank, which is counted over ranges. Items of no file are one row."""
    out = scored.groupBy("file_path").agg(F.count("*").alias("n_items"), six(F.sum("score")).alias("score"), six(F.sum("hours")).alias("hours"), *(six(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("score"))), F.lit(0.0))).alias(c) for c in categories))
    out = out.withColumn("priority", above(F.col("score"), (50, "critical"), (30, "high"), (15, "medium"), default="low"))
    return ranked(out, [F.desc("score"), F.asc_nulls_last("file_path")], shelf, "by_file", "position")


def quick_wins(scored: DataFrame) -> DataFrame:
    return scored.filter((F.col("hours") <= 2) & (F.col("impact") > 5))


def dashboard(scored: DataFrame) -> DataFrame:
    """One row: health, focus category, weeks, hours, quick wins, long-term items."""
    per = scored.groupBy("category").agg(F.sum("score").alias("s"))
    focus = per.agg(F.max_by("category", F.struct("s", "category")).alias("focus"))
    total = scored.agg(six(100 - F.least(5 * F.avg("score"), F.lit(100.0))).alias("health"), six(F.sum("hours")).alias("hours"), F.ceil(F.sum("hours") / 40).cast("long").alias("weeks"), F.count_if((F.col("hours") <= 2) & (F.col("impact") > 5)).alias("n_quick"), F.count_if(F.col("hours") > 8).alias("n_long"))
    return total.join(F.broadcast(focus))  # one row each


def remediation_plan(scored: DataFrame) -> DataFrame:
    roi = F.col("impact") / F.greatest(F.col("hours"), F.lit(0.5))
    return scored.groupBy("category").agg(six(F.sum("hours")).alias("hours"), six(F.avg(roi)).alias("roi"), six(F.sum("impact")).alias("impact"), F.count_distinct("file_path").alias("n_files"))
