"""Queries on graphs, packages, scans and time series over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import semver
from sparkquarry.functions.rules import six
from sparkquarry.operators import enrich, graph, reports, scan
from sparkquarry.operators import timeseries as ts
from sparkquarry.plans.quality import table
from sparkquarry.sources import exports, manifests
from sparkquarry.store import Shelf
from sparkquarry.streaming import pressure as stream

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


# --- graphs -----------------------------------------------------------------------------------


def nation_edges(spark, d) -> DataFrame:
    """Distinct (customer nation, supplier nation) pairs of order lines."""
    c, o, l, s = (table(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier"))
    lines = l.select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    buyers = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


NE = "WITH RECURSIVE ne AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
DEG = ", dg AS (SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM ne UNION ALL SELECT dst, 0, 1 FROM ne) GROUP BY 1)"


@query(NE + DEG + " SELECT node, in_degree, out_degree, in_degree + out_degree AS centrality, greatest((in_degree + out_degree) / 2, 1.0)::DOUBLE AS weight FROM dg")
def graph_degrees(spark, d):
    return graph.degrees(nation_edges(spark, d))


@query(NE + DEG + " SELECT (SELECT count(*) FROM dg) AS n_nodes, (SELECT max(in_degree + out_degree) FROM dg) AS max_centrality, count(*) AS n_edges, round(count(*) / ((SELECT count(*) FROM dg) * ((SELECT count(*) FROM dg) - 1)), 6)::DOUBLE AS density FROM ne")
def graph_density(spark, d):
    return graph.density(nation_edges(spark, d))


def tree_edges(spark, d) -> DataFrame:
    """region -> nation -> customer, with names as ids."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return n.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")).unionByName(c.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")))


TREE = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"
BFS = f"WITH RECURSIVE {TREE}, nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), walk AS (SELECT node, 0 AS depth FROM nodes WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, depth + 1 FROM walk JOIN e ON walk.node = e.src WHERE depth < 64), dp AS (SELECT n.node, coalesce(min(depth), 0)::BIGINT AS depth FROM nodes n LEFT JOIN walk w ON n.node = w.node GROUP BY 1)"


@query(BFS + " SELECT node, depth FROM dp")
def graph_bfs_depth(spark, d):
    return graph.bfs_depth(tree_edges(spark, d), Shelf(spark, "bfs"))


@query(BFS + " SELECT round(avg(depth), 6) AS mean_depth, max(depth) AS diameter, count(*) AS n_nodes FROM dp")
def graph_paths(spark, d):
    return graph.bfs_depth(tree_edges(spark, d), Shelf(spark, "bfs")).agg(six(F.avg("depth")).alias("mean_depth"), F.max("depth").alias("diameter"), F.count("*").alias("n_nodes"))


@query(BFS + """, dg AS (SELECT node, sum(i) AS ind, sum(o) AS outd FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1),
sc AS (SELECT dg.node, round((least(ind, 5) + least(0.1 * outd, 3.0) + 2.0 * ((SELECT max(depth) FROM dp) - depth) / (SELECT max(depth) FROM dp))::DOUBLE, 6) AS score FROM dg JOIN dp ON dg.node = dp.node),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, node) AS position FROM sc)
SELECT node, score, position FROM rk WHERE position <= greatest(floor((SELECT count(*) FROM sc) * 0.1), 5)""")
def graph_critical_nodes(spark, d):
    e = tree_edges(spark, d)
    return graph.critical_nodes(e, graph.bfs_depth(e, Shelf(spark, "bfs")), Shelf(spark, "critical"))


def part_edges(spark, d) -> DataFrame:
    """Supplier to part, for lines of quantity 50."""
    l = table(spark, d, "lineitem").filter("l_quantity >= 50")
    return l.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem WHERE l_quantity >= 50), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def graph_components(spark, d):
    return graph.connected_components(part_edges(spark, d), Shelf(spark, "components"))


@query("""WITH e AS (SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS n FROM customer), x AS (SELECT n_nationkey AS src, n_regionkey AS dst FROM nation), k AS (SELECT src, string_agg(DISTINCT dst::VARCHAR, ',') AS key, count(*) AS od FROM x GROUP BY 1),
s AS (SELECT key, count(*) AS size, arg_min(src, {'w': -greatest(od / 2, 1.0), 's': src}) AS main, sum(od) AS edges FROM k GROUP BY 1 HAVING count(*) > 1), i AS (SELECT a.key, count(*) AS c FROM x JOIN k a ON x.src = a.src JOIN k b ON x.dst = b.src AND a.key = b.key GROUP BY 1)
SELECT main, size, round(coalesce(c, 0) / (size * (size - 1)), 6)::DOUBLE AS cohesion, round((edges - coalesce(c, 0)) / edges, 6)::DOUBLE AS coupling FROM s LEFT JOIN i ON s.key = i.key""")
def graph_clusters(spark, d):
    return graph.target_clusters(table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")))


def transition_edges(spark, d) -> DataFrame:
    return ts.transitions(events(spark, d))


TR = "tr AS (SELECT before AS src, event_type AS dst, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1, 2)"
CY = f"WITH RECURSIVE {TR}, e AS (SELECT src, dst FROM tr WHERE src <> dst), p AS (SELECT src AS start, dst AS last, [src, dst] AS path FROM e WHERE src < dst UNION ALL SELECT start, e.dst, list_append(path, e.dst) FROM p JOIN e ON p.last = e.src WHERE e.dst > start AND NOT list_contains(path, e.dst) AND len(path) < 5), cy AS (SELECT path, len(path) AS length, CASE WHEN len(path) >= 5 THEN 'critical' WHEN len(path) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM p JOIN e ON p.last = e.src AND p.start = e.dst)"


@query(CY + " SELECT array_to_string(path, '>') AS path, length, severity FROM cy")
def graph_cycles(spark, d):
    return graph.cycles(transition_edges(spark, d)).select(F.array_join("path", ">").alias("path"), "length", "severity")


@query(CY + " SELECT count(*) AS n_cycles, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, round(avg(length), 6) AS mean_length, least(sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 ELSE 8 END), 100)::BIGINT AS score FROM cy")
def cycle_stats(spark, d):
    return graph.cycle_stats(graph.cycles(transition_edges(spark, d)))


@query(CY + """, g AS (SELECT node, greatest(count(*) / 2, 1.0) AS weight FROM (SELECT src AS node FROM tr UNION ALL SELECT dst FROM tr) GROUP BY 1), n AS (SELECT path, unnest(list_append(path, path[1])) AS node FROM cy), w AS (SELECT path, avg(weight) AS mean FROM n JOIN g USING (node) GROUP BY 1)
SELECT array_to_string(path, '>') AS path, len(path) AS length, CASE WHEN len(path) + 1 <= 2 THEN 'critical' WHEN len(path) + 1 <= 4 THEN 'high' WHEN len(path) + 1 <= 6 THEN 'medium' ELSE 'low' END AS severity, round(10 * mean / (len(path) + 1), 6)::DOUBLE AS impact FROM w""")
def graph_cycle_impact(spark, d):
    e = transition_edges(spark, d)
    return graph.cycle_impact(graph.cycles(e), graph.degrees(e)).withColumn("path", F.array_join("path", ">"))


@query(CY + " SELECT node, count(*) AS n FROM (SELECT unnest(list_append(path, path[1])) AS node FROM cy) GROUP BY 1 ORDER BY n DESC, node LIMIT 5")
def graph_cycle_hotspots(spark, d):
    """The five nodes that lie on most cycles, a limit of the report itself."""
    return graph.cycle_hotspots(graph.cycles(transition_edges(spark, d)))


@query(NE + """ SELECT 'digraph g {' || chr(10) || string_agg('  "' || src || '" -> "' || dst || '";', chr(10) ORDER BY '  "' || src || '" -> "' || dst || '";') || chr(10) || '}' AS dot FROM ne""")
def graph_export_dot(spark, d):
    return exports.dot(nation_edges(spark, d))


@query(NE + """ SELECT '{"source":' || src || ',"target":' || dst || '}' AS link FROM ne""")
def graph_export_links(spark, d):
    return exports.node_link(nation_edges(spark, d))


@query(NE + DEG + """ SELECT '{"id":' || node || ',"in":' || in_degree || ',"out":' || out_degree || '}' AS node FROM dg""")
def graph_export_nodes(spark, d):
    return exports.node_objects(graph.degrees(nation_edges(spark, d)))


@query(NE + DEG + """ SELECT '{"nodes":' || (SELECT count(*) FROM dg) || ',"edges":' || count(*) || ',"most":' || (SELECT max(in_degree + out_degree) FROM dg) || ',"loops":' || count(*) FILTER (src = dst) || ',"sources":' || (SELECT count(*) FROM dg WHERE in_degree = 0) || ',"sinks":' || (SELECT count(*) FROM dg WHERE out_degree = 0) || '}' AS summary FROM ne""")
def graph_export_summary(spark, d):
    return exports.graph_summary(nation_edges(spark, d), graph.degrees(nation_edges(spark, d)))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS direct FROM customer")
def dep_direct_indirect(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("direct", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("direct", F.lit(False)))


# --- packages ---------------------------------------------------------------------------------


def packages(spark, d) -> DataFrame:
    """A synthetic version for each part: size.key modulo 10.key modulo 7."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_brand").alias("package"), F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 10).cast("string"), (F.col("p_partkey") % 7).cast("string")).alias("version"))


PK = "WITH pk AS (SELECT p_partkey, p_brand AS package, p_size % 4 AS ma, p_partkey % 10 AS mi, p_partkey % 7 AS pa, (p_size % 4) || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) AS version FROM part)"


@query(PK + " SELECT p_partkey, version, CASE WHEN [ma, mi, pa] >= [2, 3, 1] THEN 'none' WHEN ma < 2 THEN 'major' WHEN mi < 3 THEN 'minor' ELSE 'patch' END AS update_type FROM pk")
def semver_compare(spark, d):
    return packages(spark, d).select("p_partkey", "version", semver.update_type(F.col("version"), F.lit("2.3.1")).alias("update_type"))


RANGES = ("1.2.3", ">=2.0.0", "<1.5.0", "^1.2.0", "~2.3.0", "3.*", ">1.0.0", "<=0.4.2")


@query(PK + """ SELECT p_partkey, r AS affected, CASE WHEN version = r THEN 'exact' WHEN CASE r WHEN '>=2.0.0' THEN [ma, mi, pa] >= [2, 0, 0] WHEN '<1.5.0' THEN [ma, mi, pa] < [1, 5, 0] WHEN '^1.2.0' THEN [ma, mi, pa] >= [1, 2, 0] AND ma = 1 WHEN '~2.3.0' THEN [ma, mi, pa] >= [2, 3, 0] AND ma = 2 AND mi = 3 WHEN '>1.0.0' THEN [ma, mi, pa] > [1, 0, 0] WHEN '<=0.4.2' THEN [ma, mi, pa] <= [0, 4, 2] ELSE false END THEN 'range' WHEN r = '3.*' AND ma = 3 THEN 'wildcard' ELSE 'none' END AS match
FROM pk, (VALUES ('1.2.3'), ('>=2.0.0'), ('<1.5.0'), ('^1.2.0'), ('~2.3.0'), ('3.*'), ('>1.0.0'), ('<=0.4.2')) v(r)""")
def semver_range_match(spark, d):
    rows = packages(spark, d).withColumn("affected", F.explode(F.array(*(F.lit(r) for r in RANGES))))
    return rows.select("p_partkey", "affected", semver.matches(F.col("version"), F.col("affected")).alias("match"))


@query(PK + " SELECT package, max([ma, mi, pa])[1] || '.' || max([ma, mi, pa])[2] || '.' || max([ma, mi, pa])[3] AS latest, count(*) AS n FROM pk GROUP BY 1")
def update_recommend(spark, d):
    v = semver.parse(F.col("version"))
    return packages(spark, d).groupBy("package").agg(F.max_by("version", v).alias("latest"), F.count("*").alias("n"))


@query("""WITH v AS (SELECT l_suppkey, round(l_discount * 100, 1) AS cvss FROM lineitem), s AS (SELECT *, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' WHEN cvss > 0 THEN 'low' ELSE 'none' END AS severity FROM v),
g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (severity = 'critical') AS n_critical, avg(CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 7.5 WHEN 'medium' THEN 5.0 ELSE 2.5 END) AS w, round(avg(cvss), 6) AS mean_cvss FROM s GROUP BY 1)
SELECT l_suppkey, n, n_critical, mean_cvss, round(least(w * 10 * CASE WHEN n > 20 THEN 1.2 WHEN n > 10 THEN 1.1 ELSE 1.0 END * (1 + 0.1 * n_critical), 100.0)::DOUBLE, 6) AS risk FROM g""")
def vuln_risk_score(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.round(F.col("l_discount") * 100, 1).alias("cvss")).withColumn("severity", enrich.severity(F.col("cvss")))
    return enrich.risk_score(rows, "l_suppkey")


LIC = r"""WITH li AS (SELECT doc_id, lower(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)(licensed under|under the mit license)')),
nl AS (SELECT doc_id, CASE WHEN contains(line, 'apache') THEN 'Apache-2.0' WHEN contains(line, 'lesser general public') THEN 'LGPL-3.0' WHEN contains(line, 'affero') THEN 'AGPL-3.0' WHEN contains(line, 'general public license, version 2') THEN 'GPL-2.0' WHEN contains(line, 'general public') THEN 'GPL-3.0' WHEN contains(line, 'gpl') THEN 'GPL-3.0' WHEN contains(line, 'mozilla') THEN 'MPL-2.0' WHEN contains(line, 'bsd') THEN 'BSD-3-Clause' WHEN contains(line, 'cc0') THEN 'CC0-1.0' WHEN contains(line, 'cc by') THEN 'CC-BY' WHEN contains(line, 'mit license') THEN 'MIT' ELSE 'UNKNOWN' END AS spdx FROM li),
kl AS (SELECT *, CASE WHEN spdx IN ('MIT', 'BSD-3-Clause', 'Apache-2.0') THEN 'permissive' WHEN spdx IN ('LGPL-3.0', 'MPL-2.0') THEN 'weak-copyleft' WHEN spdx IN ('GPL-2.0', 'GPL-3.0', 'AGPL-3.0') THEN 'strong-copyleft' WHEN spdx = 'CC0-1.0' THEN 'public-domain' ELSE 'other' END AS kind FROM nl)
"""


def license_lines(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.regexp_like("line", F.lit("(?i)(licensed under|under the mit license)")))
    return rows.select("doc_id", enrich.normalized_license(F.col("line")).alias("spdx"))


@query(LIC + "SELECT spdx, kind, CASE kind WHEN 'permissive' THEN 'low' WHEN 'public-domain' THEN 'low' WHEN 'strong-copyleft' THEN 'high' ELSE 'medium' END AS risk, count(*) AS n FROM kl GROUP BY ALL")
def license_normalize(spark, d):
    return enrich.classified(license_lines(spark, d)).groupBy("spdx", "kind", "risk").agg(F.count("*").alias("n"))


@query(LIC + ", pr AS (SELECT spdx, kind, count(*) AS n FROM (SELECT spdx, kind FROM kl UNION ALL SELECT 'proprietary', 'proprietary' FROM region UNION ALL SELECT 'GPL-2.0', 'strong-copyleft' FROM nation) GROUP BY 1, 2), x AS (SELECT a.spdx AS a, b.spdx AS b, CASE WHEN a.spdx || '|' || b.spdx IN ('Apache-2.0|GPL-2.0') THEN 'high' WHEN a.spdx || '|' || b.spdx = 'GPL-3.0|proprietary' THEN 'critical' WHEN (a.kind = 'strong-copyleft' AND b.kind = 'proprietary') OR (b.kind = 'strong-copyleft' AND a.kind = 'proprietary') THEN 'high' END AS risk, a.n * b.n AS n_pairs FROM pr a JOIN pr b ON a.spdx < b.spdx) SELECT * FROM x WHERE risk IS NOT NULL")
def license_conflicts(spark, d):
    more = table(spark, d, "region").select(F.lit("proprietary").alias("spdx")).unionByName(table(spark, d, "nation").select(F.lit("GPL-2.0").alias("spdx")))
    return enrich.license_conflicts(license_lines(spark, d).select("spdx").unionByName(more))


@query("WITH g AS (SELECT p_brand, count(*) AS n, sum(p_size * 1024)::BIGINT AS size FROM part GROUP BY 1), s AS (SELECT *, round(100.0 * size / sum(size) OVER (), 6)::DOUBLE AS share FROM g) SELECT *, CASE WHEN share > 20 THEN 'high' WHEN share > 10 THEN 'medium' ELSE 'low' END AS impact FROM s")
def bundle_contributions(spark, d):
    return enrich.contributions(table(spark, d, "part").withColumn("size", F.col("p_size").cast("long") * 1024), "p_brand")


@query("WITH g AS (SELECT p_brand, sum(p_size * 1024)::BIGINT AS size FROM part GROUP BY 1), o AS (SELECT *, 100.0 * (size - 512000) / 512000 AS v FROM g WHERE size > 512000) SELECT p_brand, size, round(v, 6)::DOUBLE AS overage, CASE WHEN v > 150 THEN 'critical' WHEN v > 50 THEN 'high' WHEN v > 10 THEN 'medium' ELSE 'low' END AS severity FROM o")
def budget_violations(spark, d):
    return enrich.budget(table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.col("p_size").cast("long") * 1024).alias("size")), 512_000)


@query("""WITH p AS (SELECT p_partkey AS package, p_size * 10240::BIGINT AS size FROM part), v AS (
 SELECT package, size, n AS profile, (size / 1024.0::DOUBLE / bw * 1000 + lat) * (1 + 5 * loss) + 3 * (size / 1048576.0::DOUBLE * 10) AS ms FROM p, (VALUES ('3g', 400.0::DOUBLE, 400.0::DOUBLE, 0.02::DOUBLE), ('4g', 1500, 150, 0.005), ('wifi', 5000, 50, 0.001), ('cable', 10000, 20, 0.0005)) v(n, bw, lat, loss)
 UNION ALL SELECT package, size, n, size / 1048576.0::DOUBLE * 10 * (pm + 2.5 * cpu) FROM p, (VALUES ('low', 3.0::DOUBLE, 4.0::DOUBLE), ('mid', 1.5, 2.0), ('high', 1.0, 1.0)) v(n, cpu, pm))
SELECT package, floor(size * 0.7::DOUBLE)::BIGINT AS min_size, floor(floor(size * 0.7::DOUBLE) * 0.7::DOUBLE)::BIGINT AS gzip_size, profile, round(ms + 1e-7, 4)::DOUBLE AS ms FROM v""")
def load_time_matrix(spark, d):
    return enrich.load_times(table(spark, d, "part").select(F.col("p_partkey").alias("package"), (F.col("p_size").cast("long") * 10240).alias("size"))).withColumn("ms", F.round(F.col("ms") + 1e-7, 4))


# --- scans ------------------------------------------------------------------------------------


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


BARE = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '//[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'), ' ')"


@query(f"WITH b AS (SELECT page_id, {BARE.format('html')} AS bare FROM pages), t AS (SELECT *, " + r"""regexp_replace(regexp_replace(regexp_replace(bare, '\b[A-Za-z_][A-Za-z0-9_]*', 'IDENTIFIER', 'g'), '["''][^"'']*["'']', 'STRING_LITERAL', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', 'NUMBER_LITERAL', 'g') AS tokens FROM b)
SELECT page_id, CASE WHEN coalesce(bare, '') = '' THEN 0 ELSE len(string_split(bare, ' ')) END::BIGINT AS n_tokens, md5(tokens) AS form, length(tokens) AS form_chars FROM t""")
def page_tokens(spark, d):
    """Token count and tokenised form of each page without comments."""
    form = scan.tokenised(F.col("html"))
    return table(spark, d, "pages").select("page_id", scan.token_count(F.col("html")).alias("n_tokens"), F.md5(form).alias("form"), F.length(form).cast("long").alias("form_chars"))


@query(r"""WITH t AS (SELECT page_id, html || ' ' || url AS t FROM pages), x AS (SELECT page_id, 'url' AS kind, unnest(regexp_extract_all(t, 'https?://[^\s"''<>()]+')) AS value FROM t UNION ALL SELECT page_id, 'endpoint', unnest(regexp_extract_all(t, '(?:href|src|action)=["''](/[^"'']*)["'']', 1)) FROM t)
SELECT page_id, kind, value, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def page_endpoints(spark, d):
    """Addresses and paths in the markup and the URL of each page."""
    return scan.endpoints(table(spark, d, "pages").select("page_id", F.concat_ws(" ", "html", "url").alias("t")), "t")


@query("""WITH f AS (SELECT doc_id, regexp_matches(text, '(password|passwd)[ ]*[:=]') AS has_password, regexp_matches(text, 'token[ ]*[:=]') AS has_token, regexp_matches(text, 'AKIA[A-Z0-9]{16}') AS has_key, contains(text, 'process.env') AS has_env FROM documents)
SELECT *, CASE WHEN has_password OR has_key THEN 'critical' WHEN has_token THEN 'high' WHEN has_env THEN 'medium' ELSE 'low' END AS risk FROM f""")
def credential_scan(spark, d):
    return scan.credentials(table(spark, d, "documents").select("doc_id", "text"), "text")


def _pattern_sql() -> str:
    parts = [f"SELECT page_id, '{name}' AS pattern, " + " + ".join(f"CASE WHEN {_any('html', words)} THEN {w} ELSE 0 END" for words, w in weights) + f" AS tenths, {threshold} AS least FROM pages" for name, (weights, threshold) in scan.PATTERNS.items()]
    return "SELECT page_id, pattern, tenths::BIGINT AS tenths FROM (" + " UNION ALL ".join(parts) + ") WHERE tenths > least"


@query(f"WITH ps AS ({_pattern_sql()}) SELECT page_id, arg_min(pattern, {{'w': -tenths, 'p': pattern}}) AS pattern, max(tenths) AS tenths, count(*) AS n_patterns, CASE count(*) WHEN 1 THEN 'clear' WHEN 2 THEN 'mixed' ELSE 'unclear' END AS clarity FROM ps GROUP BY 1")
def page_primary_pattern(spark, d):
    return scan.primary_pattern(scan.pattern_scores(table(spark, d, "pages").select("page_id", "html"), "html"), "page_id")


@query(_pattern_sql())
def pattern_scores(spark, d):
    return scan.pattern_scores(table(spark, d, "pages").select("page_id", "html"), "html")


@query("SELECT page_id, CASE WHEN contains(html, 'React') OR contains(html, 'useState') THEN 'react' WHEN contains(html, 'next(') OR contains(html, 'middleware') THEN 'middleware' WHEN contains(html, 'config') OR contains(html, 'module.exports') THEN 'config' WHEN contains(html, 'fetch') OR contains(html, 'href=') THEN 'service' ELSE 'utility' END AS kind, round((0.1 * (length(html) - length(replace(html, '<div', ''))) / 4 + 0.2 * (length(html) - length(replace(html, '<script', ''))) / 7 + 0.05 * (length(html) - length(replace(html, 'href=', ''))) / 5)::DOUBLE, 6) AS importance FROM pages")
def component_classify(spark, d):
    return table(spark, d, "pages").select("page_id", scan.component_type(F.col("html")).alias("kind"), scan.importance(F.col("html")).cast("double").alias("importance"))


URL = r"""WITH u AS (SELECT page_id, trim(url) AS url, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1) AS host FROM pages)
"""


@query(URL + f"SELECT page_id, scheme, host, CASE WHEN url = '' THEN 'empty' WHEN length(url) > 2048 THEN 'too long' WHEN {_any('lower(url)', scan.BAD_URL)} THEN 'malicious' WHEN scheme NOT IN ('https', 'http', 'git', 'ssh') THEN 'scheme' WHEN host = '' THEN 'host' END AS reason FROM u")
def url_validate(spark, d):
    return scan.url_check(table(spark, d, "pages").select("page_id", "url")).select("page_id", "scheme", "host", "reason")


@query(r"SELECT page_id, regexp_replace(regexp_replace(url || '?token=abc&x=1', '://[^/@]*@', '://***@', 'g'), '(token|key|password|secret)=[^&#]*', '\1=***', 'g') AS url FROM pages")
def url_redact(spark, d):
    return table(spark, d, "pages").select("page_id", scan.redacted(F.concat("url", F.lit("?token=abc&x=1"))).alias("url"))


@query(URL + r"SELECT CASE WHEN scheme = '' THEN 'no scheme' WHEN regexp_matches(host, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') THEN 'private address' WHEN suffix(host, '.local') OR suffix(host, '.internal') THEN 'blocked host' WHEN scheme <> 'https' THEN 'not https' ELSE 'allowed' END AS decision, count(*) AS n FROM u GROUP BY 1")
def network_policy(spark, d):
    return scan.network_policy(table(spark, d, "pages").select("page_id", "url")).groupBy("decision").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT page_id, regexp_extract_all(html, '[<>]') AS m FROM pages), x AS (SELECT page_id, i, CASE WHEN m[i] = '<' THEN 1 ELSE -1 END AS v FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM b)),
r AS (SELECT page_id, sum(v) OVER (PARTITION BY page_id ORDER BY i) AS run FROM x), l AS (SELECT page_id, min(run) AS lo FROM r GROUP BY 1), t AS (SELECT page_id, sum(v) AS bal FROM x GROUP BY 1)
SELECT b.page_id, len(m)::BIGINT AS n_brackets, coalesce(bal, 0)::BIGINT AS balance, least(coalesce(lo, 0), 0)::BIGINT AS lowest FROM b LEFT JOIN l ON l.page_id = b.page_id LEFT JOIN t ON t.page_id = b.page_id""")
def bracket_balance(spark, d):
    return scan.bracket_balance(table(spark, d, "pages").select("page_id", "html"), "html")


@query("SELECT conv_id, turn, count(*) OVER w AS n_around, (sum(length(text)) OVER w)::BIGINT AS chars_around FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def context_window(spark, d):
    return ts.context(table(spark, d, "conversations"))


@query("SELECT event_type, count(*) AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def event_props(spark, d):
    return manifests.props(events(spark, d)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# --- time series ------------------------------------------------------------------------------


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, round(sum(value * CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END * pow(0.9::DOUBLE, n - k)), 4) AS ewma FROM r GROUP BY 1""")
def mem_ewma(spark, d):
    return ts.ewma(events(spark, d))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events WHERE value IS NOT NULL), g AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) > 1 THEN regr_slope(value, -b) END AS s, avg(value) AS m FROM r WHERE b <= 10 GROUP BY 1)
SELECT user_id, n, round(s, 4) AS slope, CASE WHEN abs(s) <= 0.01 * abs(m) THEN 'stable' WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS direction, round(CASE WHEN n < 2 THEN 0 ELSE coalesce(CASE WHEN abs(s) <= 0.01 * abs(m) OR s = 0 THEN 1 - least(10 * abs(s) / nullif(abs(m), 0), 1) ELSE least(10 * abs(s) / nullif(abs(m), 0), 1) END, 0) END, 6)::DOUBLE AS confidence FROM g""")
def mem_trend(spark, d):
    return ts.trend(events(spark, d))


@query("SELECT event_type, CASE WHEN value / 100 < 0.5 THEN 'low' WHEN value / 100 < 0.7 THEN 'medium' WHEN value / 100 < 0.85 THEN 'high' ELSE 'critical' END AS level, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def pressure_levels(spark, d):
    return ts.pressure(events(spark, d), 100.0)


@query("SELECT event_id, user_id, CASE WHEN value > 90 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE value > 70")
def violations(spark, d):
    return ts.violations(events(spark, d), 70, 90)


@query("WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT CASE WHEN gap < 5000000 THEN 'fast' WHEN gap < 30000000 THEN 'slow' WHEN gap < 3600000000 THEN 'very_slow' ELSE 'idle' END AS bucket, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1")
def timeout_histogram(spark, d):
    return ts.gap_histogram(events(spark, d))


@query("""WITH g AS (SELECT event_type, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS took FROM events)
SELECT event_type, count(*) AS operations, count(*) FILTER (took > 3600000000) AS timeouts, round(avg(took / 1e6), 4) AS mean_seconds, round(max(took) / 1e6, 4) AS longest_seconds, round(count(*) FILTER (took > 3600000000) / count(*), 6)::DOUBLE AS rate, count(*) FILTER (took > 3600000000) / count(*) < 0.1 AS healthy FROM g WHERE took IS NOT NULL GROUP BY 1""")
def timeout_health(spark, d):
    return ts.health(events(spark, d))


@query(f"WITH {TR} SELECT src, dst, n FROM tr")
def state_transitions(spark, d):
    return transition_edges(spark, d)


@query("SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def ring_buffer(spark, d):
    return ts.latest(events(spark, d).select("event_id", "ts", "event_type", "value")).drop("ts")


WINDOWS = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"


@query(WINDOWS)
def pressure_windows(spark, d):
    return stream.windowed(events(spark, d))


@query(WINDOWS)
def streaming_pressure(spark, d):
    return stream.run_available(spark, f"{d}/events.parquet")


@query("WITH g AS (SELECT user_id, count(*) AS processed, epoch(max(ts)) - epoch(min(ts)) AS elapsed FROM events GROUP BY 1) SELECT user_id, processed, round(coalesce(CASE WHEN elapsed > 0 THEN processed / elapsed END, 0), 9) AS throughput, round(coalesce(CASE WHEN elapsed > 0 THEN greatest(200 - processed, 0) / (processed / elapsed) END, -1), 3)::DOUBLE AS eta_seconds, round(least(1.0, processed / 200), 6)::DOUBLE AS share FROM g")
def progress_eta(spark, d):
    return reports.progress(events(spark, d), 200, "user_id")


@query("WITH t AS (SELECT event_id AS id, event_type AS kind, ts, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END::BIGINT AS priority FROM events), a AS (SELECT *, round((epoch(TIMESTAMP '2024-06-01') - epoch(ts)) / 3600, 6) AS age_hours FROM t) SELECT id, kind, priority, age_hours, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, ts, id) AS place FROM a WHERE age_hours > 24")
def cleanup_queue(spark, d):
    tasks = events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "ts", F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1).cast("long").alias("priority"))
    return reports.cleanup_queue(tasks, "2024-06-01 00:00:00")


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) SELECT user_id, round(sum(value * pow(0.5::DOUBLE, n - k + CASE WHEN k = 1 THEN 0 ELSE 1 END)), 6) AS mean FROM r GROUP BY 1")
def halving_mean(spark, d):
    return ts.halving(events(spark, d))


@query("""WITH e AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)
SELECT 0::BIGINT AS part, '<node id="' || n || '"/>' AS line FROM (SELECT src AS n FROM e UNION SELECT dst FROM e) UNION ALL SELECT 1, '<edge source="' || src || '" target="' || dst || '"/>' FROM e""")
def graph_export_graphml(spark, d):
    return exports.graphml_lines(nation_edges(spark, d))
