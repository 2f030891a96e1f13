"""Testability of functions(file_path, name, lines, params, is_async, cyclomatic, external, internal, db, net, fs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions.rules import at_least, clamp, first_of, six


def testability(functions: DataFrame) -> DataFrame:
    """Adds factors, score, difficulty, risk, effort and approach."""
    step = lambda x, low, high: first_of((x <= low, 20), (x <= high, 50), default=80)
    out = functions.withColumn("complexity_factor", step(F.col("cyclomatic"), 5, 15)).withColumn("coupling_factor", step(2 * F.col("external") + F.col("internal"), 3, 8)).withColumn("dependency_factor", step(3 * F.col("db") + 2 * F.col("net") + F.col("fs"), 2, 6))
    size = first_of((F.col("lines") <= 20, 20), (F.col("lines") <= 50, 50), default=80)
    pattern = F.when(F.col("is_async"), 50).otherwise(20)
    score = 0.30 * (100 - F.col("complexity_factor")) + 0.25 * (100 - F.col("coupling_factor")) + 0.20 * (100 - F.col("dependency_factor")) + 0.15 * (100 - size) + 0.10 * (100 - pattern)
    out = out.withColumn("score", six(clamp(score, 0.0, 100.0)))
    mocks = (F.col("db") + F.col("net") + F.col("fs")).cast("long")
    return out.select("*", at_least(F.col("score"), (80, "easy"), (60, "moderate"), (40, "hard"), default="very_hard").alias("difficulty"), mocks.alias("mocks"), F.round((first_of((F.col("score") < 40, 8.0), (F.col("score") < 60, 4.0), (F.col("score") < 80, 3.0), default=2.0) * (1 + 0.5 * mocks)) * 4) .alias("quarter_hours"))


def untested_paths(functions: DataFrame) -> DataFrame:
    """Row expansion: conditional paths, a loop, an exception, two async paths."""
    n = (F.col("params") + F.floor(F.col("lines") / 10)).cast("long")
    numbers = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    path = lambda kind, no, risk: F.struct(F.lit(kind).alias("path_type"), no.cast("long").alias("path_no"), risk.alias("risk"))
    conditional = F.transform(numbers, lambda k: path("conditional", k, F.when(F.col("lines") > 50, "high").otherwise("medium")))
    fixed = F.array_compact(F.array(F.when(F.col("lines") > 20, path("loop", F.lit(0), F.lit("medium"))), path("exception", F.lit(0), F.lit("high")), *(F.when(F.col("is_async"), path("async", F.lit(k), F.lit("high"))) for k in (0, 1))))
    return functions.select("file_path", "name", F.explode(F.concat(conditional, fixed)).alias("x")).select("file_path", "name", "x.*")


def gaps(paths: DataFrame, more_than: int = 2) -> DataFrame:
    out = paths.groupBy("file_path", "path_type").agg(F.count("*").alias("n_paths"), F.count_if(F.col("risk") == "high").alias("n_high")).filter(F.col("n_paths") > more_than)
    return out.withColumn("severity", first_of((F.col("path_type").isin("exception", "async") & (F.col("n_paths") > 5), "high"), (F.col("n_paths") > 10, "high"), default="medium"))


def priority_matrix(scored: DataFrame) -> DataFrame:
    impact = 100 - F.col("score") + 2 * F.col("cyclomatic")
    out = scored.withColumn("impact", six(impact)).withColumn("roi", six(impact / F.greatest(F.col("quarter_hours") / 4, F.lit(0.25))))
    i, r = F.col("impact"), F.col("roi")
    return out.withColumn("band", first_of(((i >= 80) & (r >= 8), "critical"), ((i >= 60) & (r >= 4), "high"), ((i >= 40) & (r >= 2), "medium"), default="low"))


def outlook(scored: DataFrame) -> DataFrame:
    """Of testability()'s rows: open_paths, open_gaps, coverage (what tests can reach), risk, hours and approach."""
    wide = (F.col("params") > 3).cast("long")
    asks = F.col("is_async").cast("long")
    out = scored.withColumn("open_paths", 2 * asks + 2 * wide).withColumn("open_gaps", asks + F.when(F.col("params") > 0, 2).otherwise(0))
    out = out.withColumn("coverage", six(clamp(F.col("score") - 5 * F.col("open_paths") - 8 * F.col("mocks"), 0.0, 100.0)))
    s, m = F.col("score"), F.col("mocks")
    out = out.withColumn("risk", first_of((s < 40, "critical"), (s < 60, "high"), (s < 80, "medium"), default="low"))
    out = out.withColumn("hours", (2 + first_of((s < 40, 6), (s < 60, 4), (s < 80, 2), default=0) + m + F.col("open_paths") + F.col("open_gaps")).cast("long"))
    return out.withColumn("approach", first_of((m > 3, "integration_testing_with_test_doubles"), (s < 40, "refactor_then_unit_test"), (m > 0, "unit_testing_with_mocks"), default="pure_unit_testing"))


def by_file(looked: DataFrame) -> DataFrame:
    """file_path, score, tested, untested, complexity, mocks, hours, gaps, priority of outlook()'s rows; one aggregation by file."""
    out = looked.groupBy("file_path").agg(
        six(F.avg("score")).alias("score"), F.count_if(F.col("score") >= 60).alias("tested"), F.count_if(F.col("score") < 60).alias("untested"),
        F.least(F.lit(100), 10 * F.count("*") + 15 * F.count_distinct("class_name") + 5 * F.sum("external")).cast("long").alias("complexity"),
        F.sum("mocks").alias("mocks"), F.sum("hours").alias("hours"), (F.count_if("is_async") + F.count_if(F.col("params") > 3)).alias("gaps"),
    )
    s, u, m = F.col("score"), F.col("untested"), F.col("mocks")
    return out.withColumn("priority", first_of(((s < 40) | (u > 3) | (m > 5), "critical"), ((s < 60) | (u > 1) | (m > 2), "high"), ((s < 80) | (u > 0), "medium"), default="low"))


def strategy(looked: DataFrame, bands: DataFrame) -> DataFrame:
    """One row: totals of outlook()'s rows, hours with 30 % on top, weeks, focus, gate, and the approach and phases that follow from bands (a band for each function)."""
    n = F.col("n")
    total = looked.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 60).alias("tested"), F.count_if(F.col("risk").isin("high", "critical")).alias("high_risk"), six(F.avg("score")).alias("score"), six(F.avg("coverage")).alias("coverage"), F.sum("mocks").alias("mocks"), F.sum("hours").alias("net"))
    total = total.withColumn("hours", F.col("net") + F.floor(F.col("net") * 3 / 10)).withColumn("weeks", F.ceil(F.col("hours") / 40).cast("long")).drop("net")
    m, risky, s = F.col("mocks"), F.col("high_risk"), F.col("score")
    total = total.withColumn("mocking", first_of((m > 2 * n, "very_high"), (m > n, "high"), (m > F.expr("n div 2"), "medium"), default="low")).withColumn("focus", first_of((risky > F.expr("n div 3"), "high_risk_functions"), (m > n, "integration_testing"), (s < 60, "refactoring_for_testability"), default="balanced_coverage"))
    total = total.withColumn("gate", first_of((n == 0, "pass"), ((s < 40) | (risky > F.expr("n div 2")), "fail"), ((s < 60) | (risky > F.expr("n div 4")), "warning"), default="pass"))
    weeks = lambda x: F.when(x == 0, 1).otherwise(F.greatest(F.lit(2), F.ceil(x / 5))).cast("long")
    per = bands.agg(*(F.count_if(F.col("band") == b).alias(b) for b in ("critical", "high", "medium", "low")))
    out = total.join(F.broadcast(per))  # one row each
    out = out.withColumn("approach", first_of((F.col("critical") > F.expr("n div 4"), "risk_driven_testing_with_immediate_critical_focus"), (F.col("high") > F.expr("n div 3"), "balanced_testing_with_priority_focus"), default="comprehensive_coverage_driven_testing"))
    out = out.withColumn("unit_share", F.when(m > n, 60).otherwise(70).cast("long")).withColumn("immediate_weeks", weeks(F.col("critical"))).withColumn("short_weeks", weeks(F.col("high") + F.col("medium"))).withColumn("long_weeks", weeks(F.col("low")))
    return out.drop("critical", "high", "medium", "low")
