"""Manifests, lock files and source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAP = "map<string,string>"
MANIFEST = f"name string, version string, dependencies {MAP}, devDependencies {MAP}, peerDependencies {MAP}, optionalDependencies {MAP}"
# Weight of each kind of dependency.
WEIGHTS = {"dependencies": 1.0, "devDependencies": 0.5, "peerDependencies": 0.8, "optionalDependencies": 0.3}


def files(spark: SparkSession, path: str, pattern: str = "*.{js,jsx,ts,tsx}") -> DataFrame:
    """path, content of each file below a folder."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def manifests(texts: DataFrame, column: str = "content") -> DataFrame:
    """The fields of package manifests in a JSON column; broken ones give nulls."""
    return texts.withColumn("m", F.from_json(column, MANIFEST)).select(*[c for c in texts.columns if c != column], "m.*")


def declared(parsed: DataFrame) -> DataFrame:
    """name, package, range, kind, weight: a row for each declared dependency; of equal names the last kind counts."""
    rows = None
    for k, (kind, weight) in enumerate(WEIGHTS.items()):
        part = parsed.filter(F.col(kind).isNotNull()).select(F.col("name"), F.explode(kind).alias("package", "range"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.lit(k).alias("order"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("name", "package").agg(F.max_by(F.struct("range", "kind", "weight"), "order").alias("d")).select("name", "package", "d.range", "d.kind", "d.weight")


def props(events: DataFrame) -> DataFrame:
    """The numeric field k of events.props."""
    return events.withColumn("k", F.from_json("props", "k long")["k"])
