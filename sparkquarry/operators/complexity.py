"""Complexity of functions(file_path, class_name, name, lines, params, is_async, ...) and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.rules import above, at_least, first_of, six


def complexity(functions: DataFrame) -> DataFrame:
    """Adds cyclomatic, cognitive, nesting, weighted, severity, refactor_risk, test_difficulty, level."""
    lines, params = F.col("lines"), F.col("params")
    out = functions.withColumn("cyclomatic", (1 + F.floor(params / 3) + F.col("is_async").cast("int") + above(lines, (50, 2), (20, 1), default=0)).cast("long"))
    out = out.withColumn("cognitive", (F.col("cyclomatic") + F.when(lines - 1 > 30, 2).otherwise(0)).cast("long"))
    out = out.withColumn("nesting", above(lines, (100, 5), (50, 4), (30, 3), (15, 2), default=1).cast("long"))
    cyc, nest = F.col("cyclomatic"), F.col("nesting")
    return out.select(
        "*",
        F.round(0.4 * cyc + 0.3 * F.col("cognitive") + 0.2 * nest, 2).alias("weighted"),
        at_least(cyc, (20, "severe"), (15, "high"), (10, "medium"), default="low").alias("severity"),
        first_of(((cyc > 25) | (nest > 4), "high"), ((cyc > 15) | (nest > 3), "medium"), default="low").alias("refactor_risk"),
        above(cyc + 2 * nest, (30, "very_hard"), (20, "hard"), (10, "moderate"), default="easy").alias("test_difficulty"),
        at_least(cyc + nest, (9, "severe"), (7, "high"), (5, "medium"), default="low").alias("level"),
    )


def rollup(scored: DataFrame, *keys: str) -> DataFrame:
    """Sum, mean, maximum, count and risk by class or file."""
    out = scored.groupBy(*keys).agg(F.count("*").alias("n_functions"), F.sum("cyclomatic").alias("total"), six(F.avg("cyclomatic")).alias("mean"), F.max("cyclomatic").alias("most"), F.count_if(F.col("level").isin("high", "severe")).alias("n_high"))
    return out.withColumn("risk", first_of(((F.col("mean") > 15) | (F.col("n_high") > 5), "high"), ((F.col("mean") > 10) | (F.col("n_high") > 2), "medium"), default="low"))


def levels(scored: DataFrame) -> DataFrame:
    """Count and share of each level; the total is a window over the few level rows."""
    counts = scored.groupBy("level").agg(F.count("*").alias("n"))
    return counts.withColumn("share", six(100 * F.col("n") / F.sum("n").over(Window.partitionBy())))


def worst(scored: DataFrame, k: int = 20) -> DataFrame:
    """Top-k report by weighted score, ties by name."""
    return scored.orderBy(F.desc("weighted"), "name").limit(k)


def overall(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n_functions"), six(F.greatest(F.lit(0.0), 100 - 5 * F.avg("cyclomatic"))).alias("score"), F.max("cyclomatic").alias("most"))


def halstead(functions: DataFrame) -> DataFrame:
    """Halstead measures of (n1, n2, N1, N2 columns), maintainability index and class."""
    n1, n2, t1, t2 = (F.col(c).cast("double") for c in ("n1", "n2", "t1", "t2"))
    volume = (t1 + t2) * F.log2(F.greatest(n1 + n2, F.lit(1.0)))
    difficulty = (n1 / 2) * F.when(n2 > 0, t2 / n2).otherwise(0.0)
    out = functions.withColumn("volume", volume).withColumn("difficulty", difficulty).withColumn("effort", volume * difficulty)
    loc = F.greatest(F.col("lines").cast("double"), F.lit(1.0))
    mi = 171 - 0.23 * 4 * 5.2 * F.log(F.greatest(F.col("volume"), F.lit(1.0))) - 0.12 * 8 * 0.23 * F.col("cyclomatic") - 0.40 * 2.5 * 16.2 * F.log(loc) + 0.25 * 50 * F.sin(F.sqrt(2.4 * F.col("comment_ratio")))
    out = out.withColumn("mi", F.greatest(F.lit(0.0), F.least(F.lit(100.0), mi)))
    return out.withColumn("maintainability", at_least(F.col("mi"), (85, "high"), (70, "medium"), default="low"))


def weighted_index(scored: DataFrame, *keys: str) -> DataFrame:
    """Line-weighted mean index by file."""
    out = scored.groupBy(*keys).agg(F.count("*").alias("n_functions"), six(F.sum(F.col("mi") * F.col("lines")) / F.sum("lines")).alias("mi"), F.count_if(F.col("maintainability") == "low").alias("n_low"))
    return out
