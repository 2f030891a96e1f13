"""History of quality by snapshots: as-of joins between them, what changed, and the trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.rules import six

#: Change of a score, in points, from which a trend counts; change of a share, in percent of all, from which a part counts as changed.
STEP, SHIFT = 1.0, 2.0


def as_of(left: DataFrame, right: DataFrame, at: str, by: list[str], carry: list[str], shift: Column | None = None) -> DataFrame:
    """left with the columns carry of the last right row of the same by at or before left's `at` plus shift; null where there is none.

    Both tables go through one window by key in order of time (right rows first at equal times), so there
    is one shuffle and no pair of rows. Rows of right with equal times count in the order of carry. Null
    times on the left find nothing; keys compare as equal where both are null.
    """
    key = [F.col(c) for c in by]
    l = left.select(*key, F.struct(*(F.col(c) for c in left.columns)).alias("_l"), (F.col(at) if shift is None else F.col(at) + shift).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*carry).alias("r")).schema["r"].dataType).alias("_r"))
    r = right.filter(F.col(at).isNotNull()).select(*key, F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct(*carry).alias("_r"))
    own = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_t"), "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(own)).filter("_side = 1")
    return both.select("_l.*", *(F.col(f"_r.{c}").alias(f"prior_{c}") for c in carry))


def weekly(events: DataFrame) -> DataFrame:
    """week, kind, n, failures, score: snapshots by week and kind of events (ts, kind, failed); the score is 100 less the percentage that failed, in 6 digits."""
    out = events.groupBy(F.date_trunc("week", "ts").alias("week"), "kind").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))
    return out.withColumn("score", six(100 - 100 * F.col("failures") / F.col("n")))


def trend(snapshots: DataFrame, weeks: int = 1) -> DataFrame:
    """week, kind, n, score, prior_score, delta, trend: each snapshot against the last one at least `weeks` weeks older of its kind; without one the trend is `new`."""
    prior = as_of(snapshots, snapshots, "week", ["kind"], ["score"], F.expr(f"interval -{weeks} weeks"))
    delta = six(F.col("score") - F.col("prior_score"))
    label = F.when(F.col("prior_score").isNull(), "new").when(delta >= STEP, "improving").when(delta <= -STEP, "declining").otherwise("stable")
    return prior.select("week", "kind", "n", "score", "prior_score", delta.alias("delta"), label.alias("trend"))


def changes(snapshots: DataFrame) -> DataFrame:
    """week, kind, share, prior_share, change: kinds whose share of the week's events moved by SHIFT points or more since the week before that has events; a kind that is gone or new has the share 0."""
    weeks = snapshots.groupBy("week").agg(F.sum("n").alias("all"))
    weeks = weeks.withColumn("next", F.lead("week").over(Window.orderBy("week"))).withColumn("first", F.col("week") == F.min("week").over(Window.partitionBy()))  # one row for each week
    now = snapshots.join(weeks, "week").withColumn("share", six(100 * F.col("n") / F.col("all")))
    old = now.filter("next is not null").select(F.col("next").alias("week"), "kind", F.col("share").alias("prior_share"))
    out = now.filter("not first").select("week", "kind", "share").join(old, ["week", "kind"], "full").fillna(0.0, ["share", "prior_share"])
    return out.withColumn("change", six(F.col("share") - F.col("prior_share"))).filter(F.abs("change") >= SHIFT).select("week", "kind", "share", "prior_share", "change")
