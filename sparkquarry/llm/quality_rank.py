"""Quality scores by Bradley-Terry pairwise ranking.

All labelled texts outside the held-out fold are learned from. They are dealt by hashes of doc_id into
groups of about GROUP rows, and in each every text is paired with one of the other kind; logistic loss
on the differences of their features gives the weights, by Newton steps whose sums are taken over the
groups where they lie. The threshold is the quantile of their scores at the share of bad texts; a score
is the logistic function of the distance from it. Quantiles are Spark's over all rows, to a rank of
1 / ACCURACY.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.llm.labelled import bucket
from sparkquarry.llm.quality_rules import FEATURES, features, statistics
from sparkquarry.store import Shelf

GROUP, STEPS_AT_MOST, ACCURACY = 2_048, 12, 20_000
FOLDS, HELD = 3, 1


#: Shares of the labelled texts at which the steps of a statistic stand.
STEPS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98)


def squashed(stats: dict[str, np.ndarray]) -> np.ndarray:
    x = features(stats)
    return np.hstack([np.log1p(x[:, :1]), np.sqrt(np.minimum(x[:, 1:], 64.0))])


class Ranker:
    """Features are the squashed statistics, and for each the steps (1 above, else 0) at quantiles of the labelled texts."""

    def __init__(self, steps: list[np.ndarray], cut: float = -1.0):
        self.steps, self.cut, self.scale = steps, cut, 1.0
        n = sum(1 + len(c) for c in steps)
        self.mean, self.std, self.w = np.zeros(n), np.ones(n), np.zeros(n)

    def expanded(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, *((x[:, i : i + 1] > cuts) for i, cuts in enumerate(self.steps))]).astype(float)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((self.expanded(x) - self.mean) / self.std) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.scale, -30, 30)))


def _groups(batches, width: int):
    """x and good of each group."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows = batch.column("rows")[k].values
            x = rows.field("x").flatten().to_numpy().reshape(-1, width)
            yield x, rows.field("good").to_numpy(zero_copy_only=False).astype(bool)


def _summed(groups: DataFrame, width: int, of, n: int) -> np.ndarray:
    """The sum of the n numbers of(x, good) over all groups; a task sends one row."""

    def run(batches):
        total = np.zeros(n)
        for x, good in _groups(batches, width):
            total += of(x, good)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = np.zeros(n)
    for r in groups.select("rows").mapInArrow(run, "total binary").toLocalIterator():
        total += np.frombuffer(r.total)
    return total


def _differences(z: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Good less bad, for each text of a group with one of the other kind; the smaller kind is gone through again and again."""
    a, b = z[good], z[~good]
    n = max(len(a), len(b)) if len(a) and len(b) else 0
    at = np.arange(n)
    return a[at % max(1, len(a))] - b[at % max(1, len(b))]


def _examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good, x of each labelled document outside the held-out fold. The largest of several labels counts, and the least statistics of several rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(bucket("doc_id", FOLDS) != HELD).groupBy("doc_id").agg((F.max("label") == 1).alias("good"))

    def make():
        def kernel(buf, offs, part):
            x = squashed(statistics(buf, offs))
            return {"doc_id": part.column("doc_id"), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))}

        return kernel

    rows = K.map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null"), make, "doc_id long, x array<double>")
    return rows.join(known, "doc_id").groupBy("doc_id", "good").agg(F.min("x").alias("x"))


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    """From labels.quality of all rows outside the held-out fold."""
    shelf, width = Shelf(docs.sparkSession, "ranker"), len(FEATURES)
    rows = shelf.put("rows", _examples(docs, labels))
    n_good, n = (int(v or 0) for v in rows.agg(F.count_if("good"), F.count("*")).first())
    if not n_good or n_good == n:
        return Ranker([np.zeros(0)] * width, -1.0 if n_good else 1.0)
    at = rows.agg(*(F.percentile_approx(F.col("x")[i], list(STEPS), ACCURACY) for i in range(width))).first()
    ranker = Ranker([np.unique(c) for c in at])
    own = rows.withColumn("hash", F.xxhash64("doc_id")).withColumn("group", F.pmod("hash", F.lit(-(-n // GROUP))))
    groups = shelf.put("groups", own.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("hash", "doc_id", "x", "good"))).alias("rows")), 16 << 20)
    d = len(ranker.w)

    def moments(x, good):
        e = ranker.expanded(x)
        return np.concatenate([e.sum(0), (e * e).sum(0)])

    first, second = np.split(_summed(groups, width, moments, 2 * d) / n, 2)
    ranker.mean, ranker.std = first, np.sqrt(np.maximum(0, second - first * first)) + 1e-6

    def slopes(x, good):
        u = _differences((ranker.expanded(x) - ranker.mean) / ranker.std, good)
        p = 1 / (1 + np.exp(np.clip(u @ ranker.w, -30, 30)))
        return np.concatenate([p @ u, ((u * (p * (1 - p))[:, None]).T @ u).ravel(), [len(u)]])

    for _ in range(STEPS_AT_MOST):
        total = _summed(groups, width, slopes, d + d * d + 1)
        pairs = max(1.0, total[-1])
        step = np.linalg.solve(total[d:-1].reshape(d, d) / pairs + 1e-3 * np.eye(d), total[:d] / pairs - 1e-3 * ranker.w)
        ranker.w = ranker.w + step
        if np.abs(step).max() < 1e-3:
            break

    def raw(batches):
        for x, good in _groups(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(ranker.raw(x))], ["s"])

    s = shelf.put("scores", groups.select("rows").mapInArrow(raw, "s double"))
    low = float(s.agg(F.percentile_approx("s", 1 - n_good / n, ACCURACY)).first()[0])
    high = s.filter(F.col("s") > low + 1e-9).agg(F.min("s")).first()[0]
    ranker.cut = low if high is None else (low + high) / 2  # between two texts, not at one
    ranker.scale = max(1e-6, float(s.agg(F.percentile_approx(F.abs(F.col("s") - ranker.cut), 0.5, ACCURACY)).first()[0]) / 3)
    shelf.drop("rows", "groups", "scores")
    return ranker


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null texts count as empty; empty texts get a score like any other. held_out of a null doc_id is
    null. Without labels of both kinds every text gets one score. Repeated rows are scored each, ties
    alike. Long texts take time in proportion. Other columns of docs are not looked at. An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make():
        ranker = shared.value

        def kernel(buf, offs, part):
            return {"doc_id": part.column("doc_id"), "score": ranker.score(squashed(statistics(buf, offs)))}

        return kernel

    out = K.map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double")
    return out.select("doc_id", (bucket("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
