"""Queries on manifests, lock files, advisories, licences, updates and sizes; literal tables of fixture.py, and parts of the driver's tables as packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquarry.operators import graph as g
from sparkquarry.operators import packages as pk
from sparkquarry.operators import source as so
from sparkquarry.plans.fixture import ADVISORIES, INSTALLED, LOCK_V1, LOCK_V2, MANIFESTS, YARN, Table, literal
from sparkquarry.plans.repo import EDGES, sources
from sparkquarry.store import Shelf

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(spark, content: str):
    return spark.createDataFrame([(content,), ("{broken",), (None,)], "content string")


def joined(column: str):
    """A map as sorted text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("@", e["key"], e["value"]))), ",")


V1 = f"WITH l AS (SELECT unnest(map_entries(from_json({literal(LOCK_V1)}, '{{\"dependencies\": \"MAP(VARCHAR, JSON)\"}}').dependencies)) AS x), lock AS (SELECT x.key AS package, x.value->>'version' AS version, x.value->>'resolved' AS resolved, x.value->>'integrity' AS integrity, coalesce((x.value->>'dev')::BOOLEAN, FALSE) AS dev, coalesce((x.value->>'optional')::BOOLEAN, FALSE) AS optional, coalesce((x.value->>'bundled')::BOOLEAN, FALSE) AS bundled, from_json(x.value->'requires', '\"MAP(VARCHAR, VARCHAR)\"') AS requires FROM l)"
FLAT = "list_aggregate(list_sort(list_transform(map_entries(requires), lambda e: e.key || '@' || e.value)), 'string_agg', ',')"


@query(V1 + f" SELECT * REPLACE ({FLAT} AS requires) FROM lock")
def lock_v1_parse(spark, d):
    return pk.lock_v1(text(spark, LOCK_V1)).withColumn("requires", joined("requires"))


@query(f"WITH l AS (SELECT unnest(map_entries(from_json({literal(LOCK_V2)}, '{{\"packages\": \"MAP(VARCHAR, JSON)\"}}').packages)) AS x), e AS (SELECT regexp_extract(x.key, '^(?:node_modules/)?(@[^/]+/[^/]+|[^/]+)', 1) AS package, x.key AS path, x.value AS v FROM l WHERE x.key <> ''), b AS (SELECT package, arg_min(v, length(path) * 1000 + row_num) AS v FROM (SELECT *, row_number() OVER (ORDER BY path) AS row_num FROM e) GROUP BY package), r AS (SELECT *, from_json(v->'dependencies', '\"MAP(VARCHAR, VARCHAR)\"') AS requires FROM b) SELECT package, v->>'version' AS version, v->>'resolved' AS resolved, v->>'integrity' AS integrity, coalesce((v->>'dev')::BOOLEAN, (v->>'devOptional')::BOOLEAN, FALSE) AS dev, coalesce((v->>'peer')::BOOLEAN, FALSE) AS peer, {FLAT} AS requires FROM r")
def lock_v2_parse(spark, d):
    return pk.lock_v2(text(spark, LOCK_V2)).withColumn("requires", joined("requires"))


@query(f"WITH e AS (SELECT unnest(regexp_split_to_array({literal(YARN)}, '\\n\\s*\\n')) AS entry), h AS (SELECT *, regexp_extract(entry, '(?m)^([^#\\s][^\\n]*):[ ]*$', 1) AS head FROM e), s AS (SELECT entry, replace(unnest(regexp_split_to_array(head, ',\\s*')), '\"', '') AS spec FROM h WHERE head <> '') SELECT regexp_extract(spec, '^(@?[^@]+)', 1) AS package, regexp_extract(spec, '^@?[^@]+@(.*)$', 1) AS range, regexp_extract(entry, '(?m)^  version \"?([^\"\\n]+)\"?', 1) AS version, regexp_extract(entry, '(?m)^  resolved \"?([^\"\\n]+)\"?', 1) AS resolved, replace(array_to_string(regexp_extract_all(entry, '(?m)^    (\"?[^\"\\s]+\"? \"[^\"]+\")', 1), ','), '\"', '') AS requires FROM s")
def yarn_lock_parse(spark, d):
    return pk.yarn_lock(text(spark, YARN)).withColumn("requires", F.array_join("requires", ","))


MAN = f"WITH {MANIFESTS.sql}, p AS (SELECT path, content::JSON AS j FROM manifests WHERE json_valid(content)), n AS (SELECT path, j->>'name' AS name, j->>'version' AS version, unnest([from_json(j->'dependencies', '\"MAP(VARCHAR, VARCHAR)\"'), from_json(j->'devDependencies', '\"MAP(VARCHAR, VARCHAR)\"'), from_json(j->'peerDependencies', '\"MAP(VARCHAR, VARCHAR)\"'), from_json(j->'optionalDependencies', '\"MAP(VARCHAR, VARCHAR)\"')]) AS m, unnest([0, 1, 2, 3]) AS k FROM p), e AS (SELECT path, name, version, k, unnest(map_entries(m)) AS x FROM n WHERE m IS NOT NULL), need AS (SELECT path, name, version, x.key AS package, arg_max(x.value, k) AS range FROM e GROUP BY 1, 2, 3, 4), ws AS (SELECT * FROM need WHERE regexp_matches(path, '^/packages/[^/]+/package[.]json$'))"


@query(MAN + " SELECT * FROM ws")
def workspace_needs(spark, d):
    return pk.workspaces(MANIFESTS.df(spark))


@query(MAN + " SELECT name, package, range, package IN (SELECT name FROM ws) AS internal FROM ws")
def workspace_cross(spark, d):
    return pk.cross_package(pk.workspaces(MANIFESTS.df(spark)))


DIRECT = Table("direct", "package string", [("orbit",), ("sail",), ("lamp",), ("tide",), ("absent",)])
TREE = V1.replace("WITH ", "WITH RECURSIVE ", 1) + f", {DIRECT.sql}, req AS (SELECT package AS parent, unnest(map_keys(requires)) AS package FROM lock WHERE requires IS NOT NULL), walk AS (SELECT package, 0 AS depth FROM direct UNION SELECT r.package, w.depth + 1 FROM walk w JOIN req r ON r.parent = w.package WHERE w.depth < 10), tree AS (SELECT w.package, version, min(depth)::BIGINT AS depth FROM walk w JOIN lock USING (package) GROUP BY 1, 2)"


def _tree(spark):
    return pk.tree(DIRECT.df(spark), pk.lock_v1(text(spark, LOCK_V1)), Shelf(spark, "tree"))


@query(TREE + " SELECT * FROM tree")
def dep_tree(spark, d):
    return _tree(spark)


@query(TREE + " SELECT count(*) AS n, count(*) FILTER (depth = 0) AS n_direct, count(*) FILTER (depth > 0) AS n_indirect, max(depth) AS max_depth FROM tree")
def dep_tree_stats(spark, d):
    return _tree(spark).agg(F.count("*").alias("n"), F.count_if(F.col("depth") == 0).alias("n_direct"), F.count_if(F.col("depth") > 0).alias("n_indirect"), F.max("depth").alias("max_depth"))


VULN = f"""WITH {INSTALLED.sql}, {ADVISORIES.sql}, pv AS (SELECT a.id, a.package, i.version, a.affected, a.cvss, i.license, list_transform(string_split(i.version, '.'), lambda x: try_cast(regexp_extract(x, '^[0-9]*') AS BIGINT)) AS v, regexp_extract(a.affected, '^(>=|<=|>|<|\\^|~)') AS op, list_transform(string_split(regexp_replace(a.affected, '^(>=|<=|>|<|\\^|~)', ''), '.'), lambda x: try_cast(regexp_extract(x, '^[0-9]*') AS BIGINT)) AS r FROM installed i JOIN advisories a USING (package)
), mt AS (SELECT *, CASE WHEN version = affected THEN 'exact' WHEN op = '>=' AND v >= r OR op = '<=' AND v <= r OR op = '>' AND v > r OR op = '<' AND v < r OR op = '^' AND v >= r AND v[1] = r[1] OR op = '~' AND v >= r AND v[1] = r[1] AND v[2] = r[2] THEN 'range' WHEN contains(affected, '*') AND regexp_matches(version, '^' || replace(replace(affected, '.', '\\.'), '*', '.*') || '$') THEN 'wildcard' END AS match FROM pv
), al AS (SELECT *, cvss * CASE match WHEN 'exact' THEN 1.0 WHEN 'range' THEN 0.8 ELSE 0.6 END AS w, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' WHEN cvss > 0 THEN 'low' ELSE 'none' END AS severity FROM mt WHERE match IS NOT NULL
), alert AS (SELECT *, CASE WHEN w >= 8.5 THEN 'immediate' WHEN w >= 7 THEN 'urgent' WHEN w >= 5 THEN 'high' WHEN w >= 3 THEN 'medium' ELSE 'low' END AS priority FROM al)"""


def _alerts(spark):
    return pk.alerts(INSTALLED.df(spark), ADVISORIES.df(spark))


@query(VULN + " SELECT id, package, version, match, severity, priority, CASE WHEN priority IN ('immediate', 'urgent') THEN 'high' WHEN priority = 'high' THEN 'medium' ELSE 'low' END AS effort FROM alert")
def vuln_alerts(spark, d):
    return _alerts(spark)


@query(VULN + " SELECT severity, count(*) AS n, count(DISTINCT package) AS n_packages, round(avg(cvss), 6) AS mean_cvss FROM alert GROUP BY severity")
def vuln_report(spark, d):
    return pk.vulnerability_report(_alerts(spark).join(ADVISORIES.df(spark).select("id", "cvss"), "id"))


@query(VULN + ", c AS (SELECT count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) AS n, count(DISTINCT package) AS p FROM alert) SELECT priority, advice FROM (SELECT 'immediate' AS priority, 'update packages with critical advisories' AS advice FROM c WHERE c > 0 UNION ALL SELECT 'high', 'update packages with high advisories' FROM c WHERE h > 0 UNION ALL SELECT 'high', 'review dependencies as a whole' FROM c WHERE n > 10 UNION ALL SELECT 'medium', 'plan regular updates' FROM c WHERE n > 5 UNION ALL SELECT 'medium', 'watch packages with several advisories' FROM c WHERE p >= 3 UNION ALL SELECT 'low', 'nothing to do' FROM c WHERE n = 0)")
def vuln_advice(spark, d):
    return pk.security_advice(_alerts(spark))


@query(VULN + " SELECT i.package, round(least(10.0, coalesce((SELECT sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) FROM alert a WHERE a.package = i.package), 0) + CASE WHEN license IN ('UNKNOWN', '') THEN 0.5 ELSE 0 END), 6)::DOUBLE AS risk FROM installed i")
def dep_node_risk(spark, d):
    return pk.node_risk(INSTALLED.df(spark), _alerts(spark))


LIC = f"WITH {INSTALLED.sql}, lic AS (SELECT package, license, CASE WHEN license IN ('MIT', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC', 'Apache-2.0') THEN 'permissive' WHEN license IN ('LGPL-2.1', 'LGPL-3.0', 'MPL-2.0', 'EPL-2.0') THEN 'weak-copyleft' WHEN license IN ('GPL-2.0', 'GPL-3.0', 'AGPL-3.0') THEN 'strong-copyleft' WHEN license IN ('CC0-1.0', 'Unlicense') THEN 'public-domain' WHEN license = 'proprietary' THEN 'proprietary' ELSE 'other' END AS kind FROM installed), risk AS (SELECT *, CASE kind WHEN 'permissive' THEN 'low' WHEN 'public-domain' THEN 'low' WHEN 'strong-copyleft' THEN 'high' WHEN 'proprietary' THEN 'critical' ELSE 'medium' END AS risk FROM lic), viol AS (SELECT package, license, CASE WHEN license ILIKE '%gpl-3%' AND license NOT ILIKE 'x%' OR license ILIKE '%proprietary%' THEN 'forbidden' WHEN license ILIKE '%mpl%' THEN 'requires approval' END AS rule FROM risk)"


def _violations(spark):
    return pk.policy_violations(pk.licensed(INSTALLED.df(spark)), ("GPL-3", "Proprietary"), ("MPL",))


@query(LIC + " SELECT package, license, kind, risk FROM risk")
def license_kinds(spark, d):
    return pk.licensed(INSTALLED.df(spark))


@query(LIC + " SELECT package, license, rule, CASE rule WHEN 'forbidden' THEN 'high' ELSE 'medium' END AS severity FROM viol WHERE rule IS NOT NULL")
def license_policy(spark, d):
    return _violations(spark)


@query(LIC + ", s AS (SELECT count(*) AS n, round(avg(CASE risk WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END), 6) AS score, count(*) FILTER (kind = 'other') AS n_unknown, (SELECT count(*) FROM viol WHERE rule IS NOT NULL) AS n_violations FROM risk) SELECT *, CASE WHEN score >= 4 THEN 'critical' WHEN score >= 3 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS level, n_violations = 0 AS compliant FROM s")
def license_compliance(spark, d):
    return pk.license_compliance(pk.licensed(INSTALLED.df(spark)), _violations(spark))


PLAN = VULN + """, u0 AS (SELECT *, list_transform(string_split(version, '.'), lambda x: x::BIGINT) AS a, list_transform(string_split(latest, '.'), lambda x: x::BIGINT) AS b FROM installed WHERE NOT contains(latest, '-')
), u1 AS (SELECT *, CASE WHEN a[1] < b[1] THEN 'major' WHEN a[2] < b[2] THEN 'minor' ELSE 'patch' END AS type, package IN (SELECT package FROM alert) AS security FROM u0 WHERE a < b
), u2 AS (SELECT *, CASE type WHEN 'major' THEN 'breaking' WHEN 'minor' THEN 'minor-risk' ELSE 'safe' END AS level, round(CASE type WHEN 'major' THEN 0.8 WHEN 'minor' THEN 0.3 ELSE 0.1 END + CASE WHEN deprecated THEN 0.2 ELSE 0 END, 6)::DOUBLE AS risk FROM u1
), u3 AS (SELECT *, round(CASE WHEN security THEN 0.4 ELSE 0 END - CASE type WHEN 'major' THEN 0.2 ELSE 0 END - 0.3 * risk, 6)::DOUBLE AS score FROM u2
), plan AS (SELECT package, version, latest, type, level, risk, security, score, CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS priority FROM u3)"""


def _plan(spark):
    return pk.update_plan(INSTALLED.df(spark), _alerts(spark))


@query(PLAN + " SELECT * FROM plan")
def update_plan(spark, d):
    return _plan(spark)


@query(PLAN + ", c AS (SELECT count(*) AS n, count(*) FILTER (type = 'major') AS n_major, count(*) FILTER (type = 'minor') AS n_minor, count(*) FILTER (type = 'patch') AS n_patch, count(*) FILTER (security) AS n_security, count(*) FILTER (risk > 0.6) AS n_risky FROM plan) SELECT *, CASE WHEN n_security > 0 THEN 'security-first' WHEN 2 * n_risky > n THEN 'conservative' ELSE 'balanced' END AS strategy FROM c")
def update_strategy(spark, d):
    return pk.update_strategy(_plan(spark))


@query(f"WITH {INSTALLED.sql} SELECT package, CASE WHEN regexp_matches(package, 'react|vue|angular') THEN 'framework' WHEN regexp_matches(package, 'lodash|moment|date-fns') THEN 'utilities' WHEN regexp_matches(package, 'polyfill|core-js') THEN 'polyfills' WHEN regexp_matches(package, 'webpack|babel|jest') THEN 'build-tools' ELSE 'libraries' END AS category, (CASE WHEN regexp_matches(package, 'react|vue') THEN 150 WHEN regexp_matches(package, 'lodash|moment') THEN 200 WHEN package LIKE '@types%' THEN 5 ELSE 50 END)::BIGINT AS estimate_kb, floor(size_kb * 0.7::DOUBLE)::BIGINT AS min_kb, floor(floor(size_kb * 0.7::DOUBLE) * 0.7::DOUBLE)::BIGINT AS gzip_kb, floor(size_kb * 0.3::DOUBLE)::BIGINT AS shake_kb, round(greatest(0.0, least(100.0, 100 - least(50.0, 10.0::DOUBLE * size_kb / 1024) + CASE WHEN shakable THEN 10 ELSE 0 END - CASE WHEN side_effects THEN 15 ELSE 0 END)), 6)::DOUBLE AS score FROM installed")
def package_scores(spark, d):
    return pk.package_scores(INSTALLED.df(spark))


@query(f"WITH {INSTALLED.sql}, k AS (SELECT *, CASE WHEN contains(package, 'lodash') THEN 60 WHEN contains(package, 'rxjs') THEN 30 WHEN contains(package, 'material-ui') THEN 200 WHEN contains(package, 'date-fns') THEN 15 ELSE 10 END AS known FROM installed) SELECT package, least(known, size_kb)::BIGINT AS saved_kb, round(100.0::DOUBLE * least(known, size_kb) / size_kb, 6) AS share FROM k WHERE shakable OR known <> 10")
def tree_shaking(spark, d):
    return pk.tree_shaking(INSTALLED.df(spark))


@query(f"WITH {INSTALLED.sql}, s AS (SELECT 'total' AS budget, sum(size_kb)::BIGINT AS size_kb, 1000::BIGINT AS limit_kb FROM installed UNION ALL SELECT 'initial', (sum(size_kb) FILTER (NOT shakable))::BIGINT, 2500 FROM installed), o AS (SELECT *, greatest(0.0, round(100.0::DOUBLE * (size_kb - limit_kb) / limit_kb, 6))::DOUBLE AS overage FROM s) SELECT *, CASE WHEN overage > 150 THEN 'critical' WHEN overage > 50 THEN 'high' WHEN overage > 10 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN size_kb > limit_kb THEN 'fail' WHEN size_kb >= 0.8 * limit_kb THEN 'warn' ELSE 'pass' END AS status FROM o")
def bundle_budgets(spark, d):
    return pk.budget(INSTALLED.df(spark), 1000, 2500)


STATS = Table("stats", "id string, stats string", [("a", "12.5% 10.5MiB / 2GiB 14"), ("b", "0.00% 512B / 1KiB 1"), ("c", "broken"), ("d", "99.9% 3kB / 1TiB x"), ("e", None)])


def _bytes(part: str) -> str:
    return f"coalesce(floor(try_cast(regexp_extract({part}, '^\\s*([0-9.]+)', 1) AS DOUBLE) * (SELECT f FROM s WHERE u = regexp_extract({part}, '([A-Za-z]*)\\s*$', 1)))::BIGINT, -1)"


@query(f"WITH {STATS.sql}, p AS (SELECT id, regexp_split_to_array(trim(stats), '\\s+') AS p FROM stats), s(u, f) AS (VALUES ('B', 1.0::DOUBLE), ('', 1), ('KiB', 1024), ('kB', 1024), ('KB', 1024), ('MiB', 1048576), ('MB', 1048576), ('GiB', 1073741824), ('GB', 1073741824), ('TiB', 1099511627776), ('TB', 1099511627776)) SELECT id, coalesce(try_cast(regexp_replace(p[1], '%$', '') AS DOUBLE), -1) AS cpu, {_bytes('p[2]')} AS used, {_bytes('p[4]')} AS limit_bytes, coalesce(try_cast(p[5] AS BIGINT), -1) AS pids FROM p")
def container_stats(spark, d):
    return pk.container_stats(STATS.df(spark)).fillna(-1, ["cpu", "used", "limit_bytes", "pids"])


def _report(*severities: str) -> str:
    return '{"Results": [{"Target": "layer", "Vulnerabilities": [' + ", ".join(f'{{"VulnerabilityID": "V{k}", "PkgName": "p{k % 3}", "Severity": "{s}"}}' for k, s in enumerate(severities)) + "]}]}"


IMAGES = Table("images", "image string, content string", [("web", _report("low", "HIGH", "medium")), ("db", _report(*["HIGH"] * 6)), ("bad", _report("critical", "LOW")), ("clean", '{"Results": []}'), ("broken", "{")])
IMG = f"WITH {IMAGES.sql}, found AS (SELECT image, r->>'Target' AS target, v->>'VulnerabilityID' AS id, v->>'PkgName' AS package, upper(v->>'Severity') AS severity FROM (SELECT image, r, unnest((r->'Vulnerabilities')::JSON[]) AS v FROM (SELECT image, unnest((content::JSON->'Results')::JSON[]) AS r FROM images WHERE json_valid(content))))"


@query(IMG + " SELECT * FROM found")
def image_findings(spark, d):
    return pk.image_findings(IMAGES.df(spark))


@query(IMG + ", c AS (SELECT i.image, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium, count(*) FILTER (severity = 'LOW') AS n_low FROM images i LEFT JOIN found f ON f.image = i.image GROUP BY 1) SELECT *, CASE WHEN n_critical > 0 THEN 'blocked: critical' WHEN n_high > 5 THEN 'blocked: high' WHEN n_medium > 20 THEN 'blocked: medium' WHEN n_low > 100 THEN 'blocked: low' ELSE 'passed' END AS decision FROM c")
def image_gate(spark, d):
    return pk.image_gate(IMAGES.df(spark), pk.image_findings(IMAGES.df(spark)))


VECTORS = Table("vectors", "id long, vector string, spec string", [(1, "CVSS:3.1/AV:N/AC:L/PR:N", "lodash@^4.0.0"), (2, "CVSS:3.1/AV:L/AC:L", "@scope/pkg@1.2.3"), (3, None, "bare"), (4, "AC:L/AV:N", "@scope/pkg")])


@query(f"WITH {VECTORS.sql} SELECT id, CASE WHEN NOT coalesce(contains(vector, 'CVSS:'), FALSE) THEN 0.0 WHEN contains(vector, 'AV:N') AND contains(vector, 'AC:L') THEN 7.5 ELSE 5.0 END::DOUBLE AS cvss, regexp_extract(spec, '^(@?[^@]+)', 1) AS package, regexp_extract(spec, '^@?[^@]+@(.*)$', 1) AS range FROM vectors")
def package_specs(spark, d):
    spec = pk.spec_of(F.col("spec"))
    return VECTORS.df(spark).select("id", pk.cvss_of(F.col("vector")).alias("cvss"), spec["package"].alias("package"), spec["range"].alias("range"))


RING = Table("ring", "src string, dst string", [(f"n{k}", f"n{(k + 1) % 7}") for k in range(7)] + [("n3", "n1"), ("a", "b"), ("b", "a"), ("b", "n0"), ("x", "a"), ("n6", "end"), ("self", "self")])
SHORT = """, walk AS (SELECT src AS start, dst AS last, [src, dst] AS path FROM e WHERE src <> dst UNION ALL SELECT w.start, e.dst, list_append(w.path, e.dst) FROM walk w JOIN e ON e.src = w.last WHERE NOT list_contains(w.path, e.dst)
), closed AS (SELECT w.start, w.path, len(w.path) AS n FROM walk w JOIN e ON e.src = w.last AND e.dst = w.start
), best AS (SELECT start, min(path) AS path FROM (SELECT *, min(n) OVER (PARTITION BY start) AS least FROM closed) WHERE n = least GROUP BY start
), turned AS (SELECT DISTINCT list_concat(path[list_position(path, list_min(path)):], path[:list_position(path, list_min(path)) - 1]) AS path FROM best
) SELECT array_to_string(path, ',') AS path, len(path)::BIGINT AS length, CASE WHEN len(path) >= 5 THEN 'critical' WHEN len(path) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM turned"""


@query(f"WITH RECURSIVE {RING.sql}, e AS (SELECT DISTINCT src, dst FROM ring)" + SHORT)
def graph_shortest_cycles(spark, d):
    """A ring of seven with a chord, and a pair."""
    return g.shortest_cycles(RING.df(spark), Shelf(spark, "cycles")).withColumn("path", F.array_join("path", ","))


MODULE_CYCLES = EDGES + ", e AS (SELECT DISTINCT src, dst FROM edges WHERE NOT is_external)" + SHORT


@query(MODULE_CYCLES.replace(") SELECT array_to_string(path", "), out AS (SELECT path AS p, array_to_string(path", 1) + ") SELECT path, length, severity, CASE WHEN regexp_matches(lower(path), '/types/|[.]d[.]ts') THEN 'type' WHEN contains(lower(path), 'component') THEN 'component' WHEN contains(lower(path), 'service') THEN 'service' WHEN regexp_matches(lower(path), 'util|helper') THEN 'utility' ELSE 'import' END AS type FROM out")
def cycle_severity(spark, d):
    """Import cycles of the made-up tree and of the documents as files, with their type."""
    edges = so.module_edges(sources(spark, d)).filter("not is_external")
    out = g.shortest_cycles(edges, Shelf(spark, "cycles"))
    return out.select(F.array_join("path", ",").alias("path"), "length", "severity", g.cycle_type(F.col("path")).alias("type"))
