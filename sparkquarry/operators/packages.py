"""Lock files, workspaces, dependency trees, advisories, licence policy, updates and sizes of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import semver
from sparkquarry.functions.rules import above, at_least, contains_any, first_of, six
from sparkquarry.operators.enrich import KIND_RISK, LICENSE_KINDS, match_advisories
from sparkquarry.store import Shelf

MAP = "map<string,string>"
#: Levels of a dependency tree.
MAX_DEPTH = 10


def lock_v1(texts: DataFrame, column: str = "content") -> DataFrame:
    """package, version, resolved, integrity, dev, optional, bundled, requires of npm locks of version 1; broken files give no row."""
    entry = f"map<string,struct<version:string,resolved:string,integrity:string,dev:boolean,optional:boolean,bundled:boolean,requires:{MAP}>>"
    rows = texts.select(F.explode(F.from_json(column, f"dependencies {entry}")["dependencies"]).alias("package", "e"))
    flag = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(False)).alias(c)
    return rows.select("package", "e.version", "e.resolved", "e.integrity", flag("dev"), flag("optional"), flag("bundled"), "e.requires")


def lock_v2(texts: DataFrame, column: str = "content") -> DataFrame:
    """package, version, resolved, integrity, dev, peer, requires of npm locks of version 2 and 3. The root is skipped; nested paths name their top package, whose own row counts."""
    entry = f"map<string,struct<version:string,resolved:string,integrity:string,dev:boolean,devOptional:boolean,peer:boolean,dependencies:{MAP}>>"
    rows = texts.select(F.explode(F.from_json(column, f"packages {entry}")["packages"]).alias("path", "e")).filter("path <> ''")
    rows = rows.withColumn("package", F.regexp_extract("path", r"^(?:node_modules/)?(@[^/]+/[^/]+|[^/]+)", 1))
    rows = rows.groupBy("package").agg(F.min_by("e", F.struct(F.length("path"), F.col("path"))).alias("e"))
    return rows.select("package", "e.version", "e.resolved", "e.integrity", F.coalesce("e.dev", "e.devOptional", F.lit(False)).alias("dev"), F.coalesce("e.peer", F.lit(False)).alias("peer"), F.col("e.dependencies").alias("requires"))


def yarn_lock(texts: DataFrame, column: str = "content") -> DataFrame:
    """package, range, version, resolved, requires: a row for each name of each header. Entries are the parts between empty lines."""
    entry = texts.select(F.explode(F.split(column, r"\n\s*\n")).alias("entry")).withColumn("head", F.regexp_extract("entry", r"(?m)^([^#\s][^\n]*):[ ]*$", 1)).filter("head <> ''")
    field = lambda name: F.regexp_extract("entry", rf'(?m)^  {name} "?([^"\n]+)"?', 1)
    wanted = F.transform(F.regexp_extract_all("entry", F.lit(r'(?m)^    ("?[^"\s]+"? "[^"]+")'), F.lit(1)), lambda x: F.regexp_replace(x, '"', ""))
    out = entry.select(F.explode(F.split("head", r",\s*")).alias("spec"), field("version").alias("version"), field("resolved").alias("resolved"), wanted.alias("requires"))
    spec = spec_of(F.regexp_replace("spec", '"', ""))
    return out.select(spec["package"].alias("package"), spec["range"].alias("range"), "version", "resolved", "requires")


def spec_of(spec: Column) -> Column:
    """struct(package, range) of `name@range`; scoped names keep their first @."""
    return F.struct(F.regexp_extract(spec, r"^(@?[^@]+)", 1).alias("package"), F.regexp_extract(spec, r"^@?[^@]+@(.*)$", 1).alias("range"))


def workspaces(manifests: DataFrame, default: tuple[str, ...] = ("packages/*", "apps/*", "libs/*")) -> DataFrame:
    """path, name, version, package, range of the packages below the root's workspace patterns (or the default ones) and what they need; of equal names the later kind counts."""
    kinds = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parsed = manifests.withColumn("m", F.from_json("content", f"name string, version string, workspaces array<string>, {', '.join(f'{k} {MAP}' for k in kinds)}")).filter("m.name is not null").select("path", "m.*")
    root = parsed.filter("path = '/package.json'").select(F.coalesce("workspaces", F.array(*map(F.lit, default))).alias("patterns")).limit(1)
    found = parsed.filter("path <> '/package.json'").join(F.broadcast(root)).filter(F.exists("patterns", lambda g: F.regexp_like(F.col("path"), F.concat(F.lit("^/"), F.replace(g, F.lit("*"), F.lit("[^/]+")), F.lit("/package\\.json$")))))  # one root row
    merged = F.aggregate(F.array(*(F.coalesce(F.col(k), F.from_json(F.lit("{}"), MAP)) for k in kinds)), F.from_json(F.lit("{}"), MAP), lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))
    return found.select("path", "name", "version", F.explode(merged).alias("package", "range"))


def cross_package(needs: DataFrame) -> DataFrame:
    """needs of workspaces() with whether the package is a workspace itself."""
    own = needs.select(F.col("name").alias("package")).distinct().withColumn("internal", F.lit(True))
    return needs.join(own, "package", "left").select("name", "package", "range", F.coalesce("internal", F.lit(False)).alias("internal"))


def tree(direct: DataFrame, lock: DataFrame, shelf: Shelf, deepest: int = MAX_DEPTH) -> DataFrame:
    """package, version, depth of all that direct(package) reaches through lock(package, version, requires), each at its least depth; levels below deepest are not followed, as in the contract."""
    edges = shelf.put("tree_edges", lock.select(F.col("package").alias("parent"), F.explode("requires").alias("package", "range")).select("parent", "package"))
    front = shelf.put("tree_0", direct.select("package").distinct().withColumn("depth", F.lit(0).cast("long")))
    seen = front
    for k in range(1, deepest + 1):
        step = front.join(edges, front.package == edges.parent).select(edges.package).distinct().join(seen.select("package"), "package", "left_anti")
        front = shelf.put(f"tree_{k}", step.withColumn("depth", F.lit(k).cast("long")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(lock.select("package", "version"), "package")


def alerts(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """id, package, version, match, severity, priority, effort of each advisory that meets an installed version."""
    out = match_advisories(packages.select("package", "version"), advisories)
    return out.select("id", "package", "version", "match", "severity", "priority", first_of((F.col("priority").isin("immediate", "urgent"), "high"), (F.col("priority") == "high", "medium"), default="low").alias("effort"))


def vulnerability_report(found: DataFrame, cvss: str = "cvss") -> DataFrame:
    """A row for each severity: advisories, packages, mean CVSS, in the order of ranks."""
    rank = first_of((F.col("severity") == "critical", 4), (F.col("severity") == "high", 3), (F.col("severity") == "medium", 2), default=1)
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("package").alias("n_packages"), six(F.avg(cvss)).alias("mean_cvss")).orderBy(F.desc(rank))


def security_advice(found: DataFrame) -> DataFrame:
    """priority, advice: rules over counts, in order; one row where nothing was found."""
    c = found.agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h"), F.count("*").alias("n"), F.count_distinct("package").alias("p"))
    rules = ((F.col("c") > 0, "immediate", "update packages with critical advisories"), (F.col("h") > 0, "high", "update packages with high advisories"), (F.col("n") > 10, "high", "review dependencies as a whole"), (F.col("n") > 5, "medium", "plan regular updates"), (F.col("p") >= 3, "medium", "watch packages with several advisories"), (F.col("n") == 0, "low", "nothing to do"))
    return c.select(F.explode(F.array_compact(F.array(*(F.when(k, F.struct(F.lit(p).alias("priority"), F.lit(t).alias("advice"))) for k, p, t in rules)))).alias("x")).select("x.*")


def licensed(packages: DataFrame) -> DataFrame:
    """package, license, kind, risk."""
    kind = first_of(*((F.col("license") == name, k) for name, k in LICENSE_KINDS.items()), (F.col("license") == "proprietary", "proprietary"), default="other")
    out = packages.select("package", "license", kind.alias("kind"))
    return out.withColumn("risk", first_of(*((F.col("kind") == k, r) for k, r in KIND_RISK.items()), default="medium"))


def policy_violations(rows: DataFrame, forbidden: tuple[str, ...], approval: tuple[str, ...]) -> DataFrame:
    """package, license, rule, severity: licences equal to, or holding (in any case), a forbidden name or one that needs approval."""
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.lower("license").contains(F.lower(n)))
    rule = first_of((has(forbidden), "forbidden"), (has(approval), "requires approval"))
    return rows.withColumn("rule", rule).filter("rule is not null").select("package", "license", "rule", F.when(F.col("rule") == "forbidden", "high").otherwise("medium").alias("severity"))


def license_compliance(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """score: 4, 3, 2, 1 for each package by risk, as a mean; level at 4, 3, 2; compliant without violations."""
    weight = first_of((F.col("risk") == "critical", 4), (F.col("risk") == "high", 3), (F.col("risk") == "medium", 2), default=1)
    v = violations.agg(F.count("*").alias("n_violations"))
    out = rows.agg(F.count("*").alias("n"), six(F.avg(weight)).alias("score"), F.count_if(F.col("kind") == "other").alias("n_unknown")).join(F.broadcast(v))  # one row each
    return out.withColumn("level", at_least(F.col("score"), (4, "critical"), (3, "high"), (2, "medium"), default="low")).withColumn("compliant", F.col("n_violations") == 0)


def update_plan(packages: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """package, version, latest, type, level, risk, security, priority of each package with a later release that is no prerelease."""
    kind = semver.update_type(F.col("version"), F.col("latest"))
    out = packages.withColumn("type", kind).filter((F.col("type") != "none") & semver.parse(F.col("latest"))["release"])
    out = out.join(vulnerable.select("package").distinct().withColumn("v", F.lit(True)), "package", "left").withColumn("security", F.coalesce("v", F.lit(False)))
    level = first_of((F.col("type") == "major", "breaking"), (F.col("type") == "minor", "minor-risk"), default="safe")
    out = out.withColumn("level", level).withColumn("risk", six(first_of((F.col("level") == "breaking", 0.8), (F.col("level") == "minor-risk", 0.3), default=0.1) + F.when(F.col("deprecated"), 0.2).otherwise(0.0)))
    score = F.when(F.col("security"), 0.4).otherwise(0.0) - F.when(F.col("type") == "major", 0.2).otherwise(0.0) - 0.3 * F.col("risk")
    out = out.withColumn("score", six(score)).withColumn("priority", at_least(F.col("score"), (0.7, "critical"), (0.5, "high"), (0.3, "medium"), default="low"))
    return out.select("package", "version", "latest", "type", "level", "risk", "security", "score", "priority")


def update_strategy(plan: DataFrame) -> DataFrame:
    """Counts by type and the strategy: security first, else conservative if over half have a risk above 0.6, else balanced."""
    out = plan.agg(F.count("*").alias("n"), *(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("major", "minor", "patch")), F.count_if("security").alias("n_security"), F.count_if(F.col("risk") > 0.6).alias("n_risky"))
    return out.withColumn("strategy", first_of((F.col("n_security") > 0, "security-first"), (2 * F.col("n_risky") > F.col("n"), "conservative"), default="balanced"))


# Size ladders (KB) and shares saved by tree-shaking.
def size_ladder(package: Column) -> Column:
    return first_of((contains_any(package, "react", "vue"), 150), (contains_any(package, "lodash", "moment"), 200), (package.startswith("@types"), 5), default=50)


def size_category(package: Column) -> Column:
    return first_of((contains_any(package, "react", "vue", "angular"), "framework"), (contains_any(package, "lodash", "moment", "date-fns"), "utilities"), (contains_any(package, "polyfill", "core-js"), "polyfills"), (contains_any(package, "webpack", "babel", "jest"), "build-tools"), default="libraries")


def package_scores(packages: DataFrame) -> DataFrame:
    """package, category, estimate_kb, min_kb, gzip_kb, shake_kb (each cut to whole numbers), score."""
    size = F.col("size_kb")
    score = 100 - F.least(F.lit(50.0), 10 * size / 1024) + F.when(F.col("shakable"), 10).otherwise(0) - F.when(F.col("side_effects"), 15).otherwise(0)
    small = F.floor(size * 0.7)
    return packages.select("package", size_category(F.col("package")).alias("category"), size_ladder(F.col("package")).cast("long").alias("estimate_kb"), small.alias("min_kb"), F.floor(small * 0.7).alias("gzip_kb"), F.floor(size * 0.3).alias("shake_kb"), six(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).alias("score"))


def tree_shaking(packages: DataFrame) -> DataFrame:
    """package, saved_kb, share: what shaking saves (lodash 60, rxjs 30, material-ui 200, date-fns 15, else 10 KB, at most the size), for packages without side effects or with a known saving."""
    p = F.col("package")
    known = first_of((p.contains("lodash"), 60), (p.contains("rxjs"), 30), (p.contains("material-ui"), 200), (p.contains("date-fns"), 15), default=10)
    rows = packages.filter(F.col("shakable") | (known != 10)).withColumn("saved_kb", F.least(known, F.col("size_kb")).cast("long"))
    return rows.select("package", "saved_kb", six(100 * F.col("saved_kb") / F.col("size_kb")).alias("share"))


def budget(packages: DataFrame, total_kb: int, initial_kb: int) -> DataFrame:
    """A row for each budget, total and initial (packages without tree-shaking): size, overage in percent, severity and the older pass, warn (from 80 %) or fail."""
    sums = packages.agg(F.sum("size_kb").alias("total"), F.coalesce(F.sum(F.when(~F.col("shakable"), F.col("size_kb"))), F.lit(0)).alias("initial"))
    item = lambda name, limit: F.struct(F.lit(name).alias("budget"), F.col(name).alias("size_kb"), F.lit(limit).cast("long").alias("limit_kb"))
    out = sums.select(F.explode(F.array(item("total", total_kb), item("initial", initial_kb))).alias("x")).select("x.*")
    over = six(100 * (F.col("size_kb") - F.col("limit_kb")) / F.col("limit_kb"))
    out = out.withColumn("overage", F.greatest(over, F.lit(0.0)))
    return out.withColumn("severity", above(F.col("overage"), (150, "critical"), (50, "high"), (10, "medium"), default="low")).withColumn("status", first_of((F.col("size_kb") > F.col("limit_kb"), "fail"), (F.col("size_kb") >= 0.8 * F.col("limit_kb"), "warn"), default="pass"))


def cvss_of(vector: Column) -> Column:
    """Of a vector that names its CVSS version: network attacks of low complexity count 7.5, others 5.0. Anything else, null too, counts 0."""
    return F.when(~F.coalesce(vector.contains("CVSS:"), F.lit(False)), 0.0).when(vector.contains("AV:N") & vector.contains("AC:L"), 7.5).otherwise(5.0)


def bytes_of(size: Column) -> Column:
    """Bytes of `12.5MiB`, `3 kB` or a mere number; null where the unit is unknown."""
    number, unit = F.regexp_extract(size, r"^\s*([0-9.]+)", 1).try_cast("double"), F.regexp_extract(size, r"([A-Za-z]*)\s*$", 1)
    scale = first_of((unit.isin("", "B"), 1.0), (unit.isin("KiB", "kB", "KB"), 1024.0), (unit.isin("MiB", "MB"), 1024.0**2), (unit.isin("GiB", "GB"), 1024.0**3), (unit.isin("TiB", "TB"), 1024.0**4))
    return F.floor(number * scale).cast("long")


def container_stats(lines: DataFrame) -> DataFrame:
    """id, cpu, used, limit_bytes, pids of lines (id, stats) with `cpu% used / limit pids`; broken ones give nulls."""
    part = F.split(F.trim("stats"), r"\s+")
    at = lambda k: F.try_element_at(part, F.lit(k))
    return lines.select("id", F.regexp_replace(at(1), "%$", "").try_cast("double").alias("cpu"), bytes_of(at(2)).alias("used"), bytes_of(at(4)).alias("limit_bytes"), at(5).try_cast("long").alias("pids"))


def image_findings(reports: DataFrame) -> DataFrame:
    """image, target, id, package, severity of scan reports (image, content)."""
    shape = "Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,Severity:string>>>>"
    rows = reports.select("image", F.explode(F.from_json("content", shape)["Results"]).alias("r")).select("image", F.col("r.Target").alias("target"), F.explode("r.Vulnerabilities").alias("v"))
    return rows.select("image", "target", F.col("v.VulnerabilityID").alias("id"), F.col("v.PkgName").alias("package"), F.upper("v.Severity").alias("severity"))


def image_gate(images: DataFrame, found: DataFrame, limits=(("CRITICAL", 0), ("HIGH", 5), ("MEDIUM", 20), ("LOW", 100))) -> DataFrame:
    """image, counts by severity, decision: the first severity whose count exceeds its limit blocks."""
    counts = found.groupBy("image").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s, _ in limits))
    out = images.select("image").distinct().join(counts, "image", "left").fillna(0)
    return out.withColumn("decision", first_of(*((F.col(f"n_{s.lower()}") > k, f"blocked: {s.lower()}") for s, k in limits), default="passed"))


def node_risk(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """package, risk: 4, 3, 2, 1 for each advisory by severity, 0.5 without a known licence, 10 at most."""
    weight = first_of((F.col("severity") == "critical", 4.0), (F.col("severity") == "high", 3.0), (F.col("severity") == "medium", 2.0), default=1.0)
    per = found.groupBy("package").agg(F.sum(weight).alias("w"))
    return nodes.join(per, "package", "left").select("package", six(F.least(F.lit(10.0), F.coalesce("w", F.lit(0.0)) + F.when(F.col("license").isin("UNKNOWN", ""), 0.5).otherwise(0.0))).alias("risk"))
