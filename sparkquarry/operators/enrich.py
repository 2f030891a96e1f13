"""Enrichment of packages: vulnerabilities, licences, sizes, load times, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import semver
from sparkquarry.functions.rules import above, at_least, first_of, six

# Network (KiB/s, ms, loss) and device (cpu, parse) profiles; licence kinds; matrix rows that differ from the default.
NETWORKS = [("3g", 400.0, 400.0, 0.02), ("4g", 1500.0, 150.0, 0.005), ("wifi", 5000.0, 50.0, 0.001), ("cable", 10000.0, 20.0, 0.0005)]
DEVICES = [("low", 3.0, 4.0), ("mid", 1.5, 2.0), ("high", 1.0, 1.0)]
LICENSE_KINDS = {"MIT": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "ISC": "permissive", "Apache-2.0": "permissive", "LGPL-2.1": "weak-copyleft", "LGPL-3.0": "weak-copyleft", "MPL-2.0": "weak-copyleft", "EPL-2.0": "weak-copyleft", "GPL-2.0": "strong-copyleft", "GPL-3.0": "strong-copyleft", "AGPL-3.0": "strong-copyleft", "CC0-1.0": "public-domain", "Unlicense": "public-domain", "proprietary": "proprietary"}
KIND_RISK = {"permissive": "low", "weak-copyleft": "medium", "strong-copyleft": "high", "public-domain": "low", "proprietary": "critical"}
MATRIX = [("Apache-2.0", "GPL-2.0", "high"), ("GPL-3.0", "proprietary", "critical")]


def match_advisories(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """packages(package, version) x advisories(id, package, affected range, cvss): equi-join on the package, then the range."""
    kind = semver.matches(F.col("version"), F.col("affected"))
    out = packages.join(advisories, "package").withColumn("match", kind).filter("match <> 'none'")
    confidence = F.when(F.col("match") == "exact", 1.0).when(F.col("match") == "range", 0.8).otherwise(0.6)
    out = out.withColumn("confidence", confidence)
    weighted = F.col("cvss") * F.col("confidence")
    return out.withColumn("severity", severity(F.col("cvss"))).withColumn("priority", at_least(weighted, (8.5, "immediate"), (7, "urgent"), (5, "high"), (3, "medium"), default="low"))


def severity(cvss):
    return first_of((cvss >= 9, "critical"), (cvss >= 7, "high"), (cvss >= 4, "medium"), (cvss > 0, "low"), default="none")


def risk_score(vulnerabilities: DataFrame, *keys: str) -> DataFrame:
    weight = first_of((F.col("severity") == "critical", 10.0), (F.col("severity") == "high", 7.5), (F.col("severity") == "medium", 5.0), default=2.5)
    out = vulnerabilities.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.avg(weight).alias("w"), six(F.avg("cvss")).alias("mean_cvss"))
    raw = F.col("w") * 10 * F.when(F.col("n") > 20, 1.2).when(F.col("n") > 10, 1.1).otherwise(1.0) * (1 + 0.1 * F.col("n_critical"))
    return out.withColumn("risk", six(F.least(raw, F.lit(100.0)))).drop("w")


def normalized_license(text):
    """SPDX name of a declared licence; aliases by substring, in this order."""
    low = F.lower(text)
    rules = [("apache", "Apache-2.0"), ("lesser general public", "LGPL-3.0"), ("affero", "AGPL-3.0"), ("general public license, version 2", "GPL-2.0"), ("general public", "GPL-3.0"), ("gpl", "GPL-3.0"), ("mozilla", "MPL-2.0"), ("bsd", "BSD-3-Clause"), ("cc0", "CC0-1.0"), ("cc by", "CC-BY"), ("mit license", "MIT")]
    return first_of(*((low.contains(k), v) for k, v in rules), default="UNKNOWN")


def classified(licenses: DataFrame) -> DataFrame:
    kind = first_of(*((F.col("spdx") == k, v) for k, v in LICENSE_KINDS.items()), default="other")
    return licenses.withColumn("kind", kind).withColumn("risk", first_of(*((F.col("kind") == k, v) for k, v in KIND_RISK.items()), default="medium"))


def license_conflicts(packages: DataFrame) -> DataFrame:
    """Conflicts by pair of licences with the number of package pairs: licences are counted first, so packages are never paired."""
    n = classified(packages).groupBy("spdx", "kind").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("spdx").alias("a"), F.col("kind").alias("kind_a"), F.col("n").alias("n_a")), n.select(F.col("spdx").alias("b"), F.col("kind").alias("kind_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, F.col("a") < F.col("b"))  # a row for each licence name
    listed = first_of(*((((F.col("a") == x) & (F.col("b") == y)) | ((F.col("a") == y) & (F.col("b") == x)), risk) for x, y, risk in MATRIX))
    strong = (F.col("kind_a") == "strong-copyleft") & (F.col("kind_b") == "proprietary") | (F.col("kind_b") == "strong-copyleft") & (F.col("kind_a") == "proprietary")
    return pairs.withColumn("risk", F.coalesce(listed, F.when(strong, "high"))).filter("risk is not null").select("a", "b", "risk", (F.col("n_a") * F.col("n_b")).alias("n_pairs"))


def contributions(packages: DataFrame, category: str) -> DataFrame:
    """Size by category, share of all, impact."""
    out = packages.groupBy(category).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    out = out.withColumn("share", six(100 * F.col("size") / F.sum("size").over(Window.partitionBy())))
    return out.withColumn("impact", above(F.col("share"), (20, "high"), (10, "medium"), default="low"))


def budget(totals: DataFrame, limit: int) -> DataFrame:
    """Of (.., size) rows those over the limit, with overage and severity."""
    over = 100.0 * (F.col("size") - limit) / limit
    return totals.filter(F.col("size") > limit).withColumn("overage", six(over)).withColumn("severity", above(over, (150, "critical"), (50, "high"), (10, "medium"), default="low"))


def load_times(packages: DataFrame) -> DataFrame:
    """packages(package, size in bytes) x networks and x devices, by arrays of the fixed profiles: no join."""
    parse = F.col("size") / 1048576 * 10
    mini = F.floor(F.col("size") * 0.7)
    net = lambda bw, lat, loss: (F.col("size") / 1024 / bw * 1000 + lat) * (1 + 5 * loss) + parse + 2 * parse
    dev = lambda cpu, pm: parse * pm + 0.5 * parse * cpu + 2 * parse * cpu
    rows = [F.struct(F.lit(n).alias("profile"), six(net(bw, lat, loss)).alias("ms")) for n, bw, lat, loss in NETWORKS] + [F.struct(F.lit(n).alias("profile"), six(dev(c, p)).alias("ms")) for n, c, p in DEVICES]
    return packages.select("package", mini.cast("long").alias("min_size"), F.floor(mini * 0.7).cast("long").alias("gzip_size"), F.explode(F.array(*rows)).alias("x")).select("package", "min_size", "gzip_size", "x.profile", "x.ms")
