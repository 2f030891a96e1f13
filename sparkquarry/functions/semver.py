"""Versions as comparable expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def parse(v: Column) -> Column:
    """struct(major, minor, patch, release, pre), null where v is no version; structs compare as versions do (a release is above its prereleases)."""
    part = lambda k: F.regexp_extract(v, STRICT, k)
    return F.when(F.regexp_like(v, F.lit(STRICT)), F.struct(part(1).cast("long").alias("major"), part(2).cast("long").alias("minor"), part(3).cast("long").alias("patch"), (part(4) == "").alias("release"), part(4).alias("pre")))


def parts(v: Column) -> Column:
    """Lenient: the leading digits of the first three dotted parts, missing ones 0; arrays compare like versions."""
    pieces = F.transform(F.slice(F.split(F.regexp_replace(v, "^v", ""), r"\."), 1, 3), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d*)", 1).try_cast("long"), F.lit(0).cast("long")))
    return F.slice(F.concat(pieces, F.array_repeat(F.lit(0).cast("long"), 3)), 1, 3)


def update_type(old: Column, new: Column) -> Column:
    a, b = parse(old), parse(new)
    return F.when(~(a < b), F.lit("none")).when(a["major"] < b["major"], "major").when(a["minor"] < b["minor"], "minor").when(a["patch"] < b["patch"], "patch").otherwise("prerelease")


def matches(version: Column, rng: Column) -> Column:
    """exact, range, wildcard or none; the longest operator counts first."""
    op = F.regexp_extract(rng, r"^(>=|<=|>|<|\^|~)", 1)
    v, r = parts(version), parts(F.trim(F.regexp_replace(rng, r"^(>=|<=|>|<|\^|~)", "")))
    inside = F.when(op == ">=", v >= r).when(op == "<=", v <= r).when(op == ">", v > r).when(op == "<", v < r).when(op == "^", (v >= r) & (v[0] == r[0])).when(op == "~", (v >= r) & (v[0] == r[0]) & (v[1] == r[1])).otherwise(F.lit(False))
    wild = rng.contains("*") & F.regexp_like(version, F.concat(F.lit("^"), F.replace(F.replace(rng, F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$")))
    return F.when(version == rng, "exact").when(inside, "range").when(wild, "wildcard").otherwise("none")
