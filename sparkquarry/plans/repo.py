"""Queries on source files: every page with its markup and scripts, and the made-up tree of fixture.py, which has the forms that no page has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions.rules import six
from sparkquarry.operators import complexity as cx
from sparkquarry.operators import source as so
from sparkquarry.plans.fixture import FILES, PATHS, Table, literal
from sparkquarry.plans.quality import table
from sparkquarry.store import Shelf

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sources(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").filter("html is not null").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return FILES.df(spark).unionByName(pages)


LIT = FILES.sql.replace("files AS", "lit AS", 1)
SRC = f"WITH {LIT}, files AS (SELECT * FROM lit UNION ALL SELECT '/pages/' || page_id || '.html', html FROM pages WHERE html IS NOT NULL), parts AS (SELECT path, string_split(content, chr(10)) AS p FROM files), lines AS (SELECT path, unnest(range(1, len(p) + 1))::BIGINT AS line_no, trim(unnest(p), ' ') AS line FROM parts)"


def _case(patterns, value) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(line, {literal(p)}) THEN {value(k, p)}" for k, p in patterns) + " END"


def _group(patterns, g) -> str:
    return _case([(None, p) for p in patterns], lambda _, p: f"regexp_extract(line, {literal(p)}, {g})")


NAMES = "list_filter(list_transform(string_split({}, ','), lambda x: regexp_replace(trim(x, ' '), '\\s+as\\s+.*$', '')), lambda x: x <> '')"


@query(f"WITH {PATHS.sql} SELECT path, CASE WHEN path LIKE '%.jsx' OR path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.ts' THEN 'typescript' END AS language FROM paths WHERE size <= 10485760 AND NOT regexp_matches(path, 'node_modules|[.]git|[.]vscode|dist|build|coverage|[.]nyc_output') AND NOT regexp_matches(path, '[.](min|bundle)[.]js$') AND regexp_matches(path, '[.](js|jsx|ts|tsx)$')")
def src_scan(spark, d):
    return so.scan(PATHS.df(spark)).drop("size")


IMP = SRC + f", imp0 AS (SELECT path, line_no, line, {_case(so.IMPORTS, lambda k, _: literal(k))} AS import_type, {_group([p for _, p in so.IMPORTS], 2)} AS source, {_group([p for _, p in so.IMPORTS], 1)} AS listed FROM lines), imp AS (SELECT path, line_no, source, import_type, CASE WHEN import_type = 'side-effect' THEN [] ELSE {NAMES.format('listed')} END AS names, NOT (source LIKE '.%' OR source LIKE '/%') AS is_external FROM imp0 WHERE import_type IS NOT NULL)"


@query(IMP + " SELECT path, line_no, source, import_type, array_to_string(names, ',') AS names, is_external FROM imp")
def src_imports(spark, d):
    return so.imports(sources(spark, d)).withColumn("names", F.array_join("names", ","))


@query(SRC + f", e AS (SELECT path, line_no, {_case(so.EXPORTS, lambda k, _: literal(k))} AS export_type, {_group([p for _, p in so.EXPORTS], 1)} AS listed FROM lines) SELECT path, line_no, export_type, unnest({NAMES.format('listed')}) AS name FROM e WHERE export_type IS NOT NULL")
def src_exports(spark, d):
    return so.exports(sources(spark, d))


@query(SRC + f" SELECT path, line_no, regexp_extract(line, {literal(so.CLASS)}, 1) AS name, nullif(regexp_extract(line, {literal(so.CLASS)}, 2), '') AS parent, contains(line, 'export') AS is_exported FROM lines WHERE regexp_matches(line, {literal(so.CLASS)})")
def src_classes(spark, d):
    return so.classes(sources(spark, d))


@query(SRC + f" SELECT path, line_no, {_group(so.VARIABLES, 1)} AS kind, {_group(so.VARIABLES, 2)} AS name, nullif(trim({_group(so.VARIABLES, 3)}, ' '), '') AS type, contains(line, 'export') AS is_exported FROM lines WHERE {_group(so.VARIABLES, 2)} IS NOT NULL")
def src_variables(spark, d):
    return so.variables(sources(spark, d))


FNS = SRC + f""", d0 AS (SELECT *, (length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', ''))) AS net, {_group(so.FUNCTIONS, 1)} AS name, {_group(so.FUNCTIONS, 2)} AS listed FROM lines
), dep AS (SELECT *, sum(net) OVER (PARTITION BY path ORDER BY line_no) AS depth FROM d0
), f0 AS (SELECT path, line_no, name, list_filter(list_transform(string_split(listed, ','), lambda x: trim(regexp_replace(x, '[:=].*$', ''), ' ')), lambda x: x <> '') AS params, contains(line, 'async') AS is_async, contains(line, 'export') AS is_exported, depth - net AS before, contains(line, '{{') AS opens FROM dep WHERE name IS NOT NULL
), fns AS (SELECT f.path, f.name, f.params, f.is_async, f.is_exported, f.line_no AS start_line, coalesce(CASE WHEN f.opens THEN (SELECT min(l.line_no) FROM dep l WHERE l.path = f.path AND l.line_no >= f.line_no AND l.depth <= f.before) END, f.line_no) AS end_line FROM f0 f
), fn1 AS (SELECT *, end_line - start_line + 1 AS lines, len(params) AS n_params FROM fns)"""


@query(FNS + " SELECT path, name, array_to_string(params, ',') AS params, is_async, is_exported, start_line, end_line, lines FROM fn1")
def src_functions(spark, d):
    return so.functions(sources(spark, d)).withColumn("params", F.array_join("params", ","))


CX = FNS + """, c0 AS (SELECT *, 1 + n_params // 3 + is_async::INT + CASE WHEN lines > 50 THEN 2 WHEN lines > 20 THEN 1 ELSE 0 END AS cyclomatic, CASE WHEN lines > 100 THEN 5 WHEN lines > 50 THEN 4 WHEN lines > 30 THEN 3 WHEN lines > 15 THEN 2 ELSE 1 END AS nesting FROM fn1
), c1 AS (SELECT *, cyclomatic + CASE WHEN lines - 1 > 30 THEN 2 ELSE 0 END AS cognitive FROM c0), c2 AS (SELECT *, round((4 * cyclomatic + 3 * cognitive + 2 * nesting) / 10.0, 2)::DOUBLE AS weighted FROM c1)"""


def measured(spark, d) -> DataFrame:
    return cx.complexity(so.functions(sources(spark, d)).withColumn("n_params", F.size("params").cast("long")).withColumnRenamed("params", "param_names").withColumnRenamed("n_params", "params"))


@query(CX + " SELECT path, name, cyclomatic::BIGINT AS cyclomatic, cognitive::BIGINT AS cognitive, nesting::BIGINT AS nesting, weighted FROM c2")
def src_complexity(spark, d):
    """The complexity of functions that were extracted, from files to scores."""
    return measured(spark, d).select("path", "name", "cyclomatic", "cognitive", "nesting", "weighted")


@query(SRC + """, chars AS (SELECT path, unnest(range(1, length(content) + 1)) AS i, unnest(string_split(content, '')) AS c FROM files
), walk AS (SELECT path, i, sum(CASE WHEN c IN ('(', '[', '{') THEN 1 WHEN c IN (')', ']', '}') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS open FROM chars
), spot AS (SELECT path, coalesce(min(i) FILTER (open < 0), CASE WHEN arg_max(open, i) > 0 THEN max(i) END) AS i, CASE WHEN count(*) FILTER (open < 0) > 0 THEN 'unexpected closing' ELSE 'never closed' END AS problem FROM walk GROUP BY path)
SELECT path, (1 + length(b) - length(replace(b, chr(10), '')))::BIGINT AS line, (i - CASE WHEN contains(b, chr(10)) THEN length(b) - position(chr(10) IN reverse(b)) + 1 ELSE 0 END)::BIGINT AS col, problem FROM (SELECT spot.*, left(content, i - 1) AS b FROM spot JOIN files USING (path) WHERE i IS NOT NULL)""")
def src_imbalance(spark, d):
    return so.imbalance(sources(spark, d))


AT = Table("spots", "path string, line long", [("/src/index.js", 3), ("/src/broken.js", 1), ("/src/models/user.model.ts", 4), ("/none.js", 1)])


@query(SRC + ", " + AT.sql + " SELECT l.path, s.line, string_agg(CASE WHEN l.line_no = s.line THEN '> ' ELSE '  ' END || l.line_no || ': ' || l.line, chr(10) ORDER BY l.line_no) AS shown FROM lines l JOIN spots s ON s.path = l.path AND abs(l.line_no - s.line) <= 2 GROUP BY 1, 2")
def src_context(spark, d):
    return so.context(sources(spark, d), AT.df(spark))


ERRORS = Table("errors", "id long, message string", [(1, "Syntax error near }"), (2, "operation TIMEOUT after 30s"), (3, "out of memory"), (4, "open x: no such file or directory"), (5, "Permission denied"), (6, "bad UTF-8 at 4"), (7, "who knows"), (8, "syntax error: memory of tokens"), (9, None)])
KIND = "CASE WHEN message ILIKE '%syntax%' THEN 'syntax' WHEN message ILIKE '%timeout%' THEN 'timeout' WHEN message ILIKE '%memory%' THEN 'memory' WHEN message ILIKE '%no such file%' OR message ILIKE '%permission%' THEN 'io' WHEN message ILIKE '%encoding%' OR message ILIKE '%utf%' THEN 'encoding' ELSE 'unknown' END"


@query(f"WITH {ERRORS.sql} SELECT id, {KIND} AS kind, {KIND} IN ('syntax', 'encoding') AS recoverable, CASE WHEN {KIND} = 'timeout' THEN 'warning' ELSE 'error' END AS severity FROM errors")
def error_classify(spark, d):
    kind = so.error_kind(F.col("message"))
    return ERRORS.df(spark).select("id", kind.alias("kind"), kind.isin("syntax", "encoding").alias("recoverable"), F.when(kind == "timeout", "warning").otherwise("error").alias("severity"))


@query(f"WITH {ERRORS.sql} SELECT count(*) AS n_errors, count(*) FILTER ({KIND} IN ('syntax', 'encoding')) AS n_recoverable, CASE WHEN count(*) = 0 THEN 'success' WHEN count(*) / 40.0 <= 0.1 THEN 'warning' WHEN count(*) / 40.0 <= 0.5 THEN 'error' ELSE 'critical' END AS status, round(count(*) FILTER ({KIND} IN ('syntax', 'encoding')) / count(*), 6) AS recovery_rate, count(*) >= 100 OR count(*) / 40.0 > 0.5 AS over_budget FROM errors")
def error_report(spark, d):
    return so.error_report(ERRORS.df(spark).withColumn("kind", so.error_kind(F.col("message"))), 40)


@query(SRC + ", way AS (SELECT path, line_no, 'from' AS how, unnest(regexp_extract_all(line, 'from\\s*[''\"]([^''\"]+)[''\"]', 1)) AS source FROM lines UNION ALL SELECT path, line_no, 'require', unnest(regexp_extract_all(line, 'require\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)', 1)) FROM lines UNION ALL SELECT path, line_no, 'import()', unnest(regexp_extract_all(line, 'import\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)', 1)) FROM lines) SELECT * FROM way")
def src_loads(spark, d):
    return so.loads(sources(spark, d))


#: Folds `..` step by step: each round takes out one folder and the `..` after it.
RESOLVE = """, base AS (SELECT *, regexp_replace(CASE WHEN source LIKE '/%' THEN source ELSE regexp_replace(path, '/[^/]*$', '') || '/' || source END, '/(\\./)+', '/', 'g') AS pos FROM {} WHERE source LIKE '.%' OR source LIKE '/%'
), fold AS (SELECT *, 0 AS k FROM base UNION ALL SELECT * EXCLUDE (pos, k), regexp_replace(pos, '/[^/]+/\\.\\./', '/') AS pos, k + 1 FROM fold WHERE pos LIKE '%/../%' AND k < 20
), flat AS (SELECT * EXCLUDE (pos, k), pos FROM fold WHERE pos NOT LIKE '%/../%'
), tried AS (SELECT flat.*, pos || e AS target, o FROM flat, (VALUES ('', 0), ('.js', 1), ('.ts', 2), ('.jsx', 3), ('.tsx', 4), ('/index.js', 5), ('/index.ts', 6)) c(e, o) WHERE pos || e IN (SELECT path FROM files))"""


@query(IMP.replace("WITH ", "WITH RECURSIVE ", 1) + RESOLVE.format("imp") + " SELECT path, line_no, source, arg_min(target, o) AS target FROM tried GROUP BY 1, 2, 3")
def src_resolved(spark, d):
    f = sources(spark, d)
    return so.resolved(so.imports(f).select("path", "line_no", "source"), f)


EDGES = IMP.replace("WITH ", "WITH RECURSIVE ", 1) + RESOLVE.format("imp") + """, w AS (SELECT path, line_no, source, 1 + CASE import_type WHEN 'named' THEN len(names) WHEN 'namespace' THEN 2 WHEN 'default' THEN 1 ELSE 0 END AS weight, is_external FROM imp
), inner_ AS (SELECT path, line_no, source, arg_min(target, o) AS dst FROM tried GROUP BY 1, 2, 3
), edges AS (SELECT src, dst, is_external, sum(weight)::BIGINT AS weight FROM (SELECT w.path AS src, i.dst, FALSE AS is_external, weight FROM w JOIN inner_ i USING (path, line_no, source) UNION ALL SELECT path, 'ext:' || regexp_extract(source, '^(@[^/]+/[^/]+|[^/]+)', 1), TRUE, weight FROM w WHERE is_external) GROUP BY ALL)"""


@query(EDGES + " SELECT * FROM edges")
def module_edges(spark, d):
    return so.module_edges(sources(spark, d))


@query(IMP + " SELECT package, count(DISTINCT path) AS n_files, coalesce(string_agg(DISTINCT n, ',' ORDER BY n), '') AS features FROM (SELECT regexp_extract(source, '^(@[^/]+/[^/]+|[^/]+)', 1) AS package, path, unnest(CASE WHEN len(names) = 0 THEN [NULL] ELSE names END) AS n FROM imp WHERE is_external) GROUP BY package")
def module_external(spark, d):
    return so.external_usage(sources(spark, d))


@query(EDGES + " SELECT (SELECT count(*) FROM files) + (SELECT count(DISTINCT dst) FROM edges WHERE is_external) AS n_nodes, (SELECT count(DISTINCT dst) FROM edges WHERE is_external) AS n_external_nodes, count(*) AS n_edges, count(*) FILTER (is_external) AS n_external, round(count(*) / ((SELECT count(*) FROM files) + (SELECT count(DISTINCT dst) FROM edges WHERE is_external)), 6) AS edges_per_node FROM edges")
def module_stats(spark, d):
    f = sources(spark, d)
    return so.module_stats(so.module_edges(f), f)


@query(EDGES + " SELECT dst AS node, count(*) AS n_users, string_agg(src, ',' ORDER BY src) AS users FROM edges GROUP BY dst")
def module_reverse(spark, d):
    return so.module_edges(sources(spark, d)).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_users"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("users"))


COUNTS = FNS + f""", n AS (SELECT f.path, (SELECT count(*) FROM fn1 WHERE fn1.path = f.path) AS n_functions, (SELECT count(*) FROM lines l WHERE l.path = f.path AND regexp_matches(line, {literal(so.CLASS)})) AS n_classes FROM files f)"""
TYPE = "CASE WHEN regexp_matches(first, 'service|api') THEN 'service' WHEN regexp_matches(first, 'component|ui') THEN 'component' WHEN regexp_matches(first, 'util|helper') THEN 'utility' WHEN regexp_matches(first, 'model|entity') THEN 'model' ELSE 'module' END"
LAYER = "CASE WHEN regexp_matches(first, 'ui|component|view') THEN 'presentation' WHEN regexp_matches(first, 'service|business|logic') THEN 'business' WHEN regexp_matches(first, 'data|repository|model') THEN 'data' ELSE 'core' END"
MAP = COUNTS + f", c AS (SELECT coalesce(nullif(regexp_extract(path, '^/[^/]+/([^/]+)/', 1), ''), 'root') AS component, min(path) AS first, count(*) AS n_files, sum(n_functions + n_classes)::BIGINT AS complexity FROM n GROUP BY 1), comp AS (SELECT component, {TYPE} AS type, {LAYER} AS layer, n_files, complexity FROM c)"


@query(MAP + " SELECT * FROM comp")
def component_map(spark, d):
    return so.component_map(so.per_file(sources(spark, d)))


@query(MAP + " SELECT layer, count(*) AS n, round(avg(complexity), 6) AS mean_complexity FROM comp GROUP BY layer")
def component_stats(spark, d):
    return so.component_map(so.per_file(sources(spark, d))).groupBy("layer").agg(F.count("*").alias("n"), six(F.avg("complexity")).alias("mean_complexity"))


EXPORTED = f"x0 AS (SELECT path, line_no, {_case(so.EXPORTS, lambda k, _: literal(k))} AS export_type, {_group([p for _, p in so.EXPORTS], 1)} AS listed FROM lines), ex AS (SELECT DISTINCT path, export_type, unnest({NAMES.format('listed')}) AS name FROM x0 WHERE export_type IS NOT NULL)"


@query(EDGES + f""", {EXPORTED}, used AS (SELECT i.dst AS path, import_type, unnest(CASE WHEN len(names) = 0 THEN [NULL] ELSE names END) AS name FROM imp JOIN inner_ i USING (path, line_no, source)),
unused AS (SELECT count(*) AS n FROM ex WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.path = ex.path AND (u.import_type = 'namespace' OR (u.import_type = 'default' AND ex.export_type = 'default') OR (u.import_type = 'named' AND u.name = ex.name)))),
reach AS (SELECT src AS a, dst AS b FROM edges WHERE NOT is_external UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src WHERE NOT e.is_external), cyc AS (SELECT count(DISTINCT c) AS n FROM (SELECT x.a, least(x.a, min(x.b)) AS c FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)),
fn AS ({FNS.replace("WITH ", "WITH ", 1)} SELECT path, count(*) AS n FROM fn1 GROUP BY 1), cl AS (SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, {literal(so.CLASS)}) GROUP BY 1)
SELECT round(avg(coalesce(fn.n, 0)), 6) AS functions_per_file, round(avg(coalesce(cl.n, 0)), 6) AS classes_per_file, count(*) AS n_files, (SELECT n FROM cyc) AS n_cycles, (SELECT n FROM unused) AS n_unused, greatest(100 - 5 * (SELECT n FROM cyc) - 2 * (SELECT n FROM unused), 0)::BIGINT AS score FROM files LEFT JOIN fn ON fn.path = files.path LEFT JOIN cl ON cl.path = files.path""")
def structural_metrics(spark, d):
    f = sources(spark, d)
    return so.structural_score(so.per_file(f), so.module_edges(f), so.unused_exports(f), Shelf(spark, "structure"))


ANTI = CX + """, a0 AS (SELECT *, lower(name) AS l, lower(params[1]) AS p1 FROM c2
), a1 AS (SELECT *, regexp_matches(l, 'find|query|select|get|fetch|load|retrieve|search') AS q, regexp_matches(l, 'process|handle|iterate|loop|foreach|map|filter|transform|convert|parse|validate|check|update|modify') AS it, regexp_matches(l, 'nested|double|deep|multi|cross|matrix|grid|intersect|cartesian') AS nest FROM a0
), antis AS (
  SELECT path, name, 'n_plus_one' AS pattern, 'high' AS severity, 85.0 AS impact FROM a1 WHERE q AND ((n_params = 1 AND regexp_matches(p1, 'id|key|item|element')) OR contains(l, 'byid'))
  UNION ALL SELECT path, name, 'sequential_async', 'high', 80 FROM a1 WHERE is_async AND q AND len(list_filter(params, lambda x: contains(lower(x), 'list'))) > 0
  UNION ALL SELECT path, name, 'sync_in_loop', 'high', 75 FROM a1 WHERE is_async AND it
  UNION ALL SELECT path, name, 'nested_iteration', 'medium', 60 FROM a1 WHERE nest
  UNION ALL SELECT path, name, 'potential_leak', 'medium', 50 FROM a1 WHERE lines - 1 > 50 OR n_params > 5
  UNION ALL SELECT path, name, 'nested_loops', CASE WHEN lines - 1 > 100 THEN 'high' ELSE 'medium' END, CASE WHEN lines - 1 > 100 THEN 90 ELSE 67.5 END FROM a1 WHERE nest
  UNION ALL SELECT path, name, 'large_function', CASE WHEN lines > 200 THEN 'critical' ELSE 'high' END, 40 + lines // 10 FROM a1 WHERE lines > 100
  UNION ALL SELECT path, name, 'string_concat', 'medium', 40 FROM a1 WHERE regexp_matches(l, 'concat|append|build|join') AND it
  UNION ALL SELECT path, name, 'blocking', 'high', 70 FROM a1 WHERE contains(l, 'sync') AND NOT is_async)"""


@query(ANTI + " SELECT path, name, pattern, severity, impact::DOUBLE AS impact FROM antis")
def anti_patterns(spark, d):
    return so.anti_patterns(so.functions(sources(spark, d)))


HEAVY = "(VALUES " + ", ".join(f"('{w}', {kb})" for w, kb in so.HEAVY) + ") h(library, size_kb)"


@query(IMP + f" SELECT path, source, import_type, library, size_kb::BIGINT AS size_kb FROM imp, {HEAVY} WHERE contains(source, library)")
def heavy_imports(spark, d):
    return so.heavy_imports(so.imports(sources(spark, d)))


@query(ANTI + " SELECT * FROM (SELECT pattern, count(*) AS n, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority, round(sum(impact) / (4 * count(*)), 6)::DOUBLE AS roi FROM antis GROUP BY pattern)")
def opportunities_ranked(spark, d):
    """One opportunity for each pattern: priority the worst severity, return 1 for each 4 points of impact."""
    rank = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    out = so.anti_patterns(so.functions(sources(spark, d))).groupBy("pattern").agg(F.count("*").alias("n"), F.max(rank).alias("r"), six(F.sum("impact") / (4 * F.count("*"))).alias("roi"))
    return out.orderBy(F.desc("r"), F.desc("roi"), "pattern").select("pattern", "n", F.when(F.col("r") == 4, "critical").when(F.col("r") == 3, "high").when(F.col("r") == 2, "medium").otherwise("low").alias("priority"), "roi")


@query(ANTI + f""", i1 AS (SELECT count(*) AS n FROM c2 WHERE weighted > 20), {IMP[IMP.index('imp0 AS'):]}, b AS (SELECT coalesce(sum(size_kb), 0)::BIGINT + 2 * (SELECT count(*) FROM imp) AS kb FROM imp, {HEAVY} WHERE contains(source, library)
), g AS (SELECT count(*) AS n_patterns, (SELECT n FROM i1) AS n_bottlenecks, (SELECT kb FROM b) AS bundle_kb, sum(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END) AS minus FROM antis
), s AS (SELECT *, round(greatest(0.0, 100 - minus - 12 * n_bottlenecks - greatest(0.0, (bundle_kb - 500) / 100.0)), 6)::DOUBLE AS score FROM g)
SELECT n_patterns, n_bottlenecks, bundle_kb, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def perf_grade(spark, d):
    f = sources(spark, d)
    imported = so.imports(f)
    kb = so.heavy_imports(imported).agg(F.coalesce(F.sum("size_kb"), F.lit(0)).alias("h")).join(F.broadcast(imported.agg(F.count("*").alias("n")))).select((F.col("h") + 2 * F.col("n")).alias("bundle_kb"))  # one row each
    return so.performance_grade(so.anti_patterns(so.functions(f)), so.bottlenecks(measured(spark, d)).agg(F.count("*").alias("n_bottlenecks")), kb)


FLOW = SRC + """, flow AS (SELECT path, line_no, unnest(list_filter([
  CASE WHEN contains(line, 'useState') AND (contains(line, 'const ') OR contains(line, 'let ')) THEN 'state' END, CASE WHEN contains(line, 'useReducer') AND (contains(line, 'const ') OR contains(line, 'let ')) THEN 'reducer' END,
  CASE WHEN contains(line, 'set') AND contains(line, '(') AND contains(line, ')') THEN 'setter' END, CASE WHEN contains(line, 'const {') OR contains(line, 'let {') OR contains(line, '= ({ ') OR contains(line, '= (props') THEN 'props' END,
  CASE WHEN contains(line, '=') AND contains(line, '{') AND contains(line, '}') THEN 'prop_flow' END, CASE WHEN contains(line, 'fetch(') THEN 'fetch' END, CASE WHEN regexp_matches(line, 'axios\\.(get|post|put|delete)\\(') THEN 'axios' END,
  CASE WHEN contains(line, 'onClick') OR contains(line, 'onChange') OR contains(line, 'onSubmit') THEN 'event' END, CASE WHEN contains(line, 'createContext') THEN 'context_create' END, CASE WHEN contains(line, 'useContext') THEN 'context_use' END, CASE WHEN contains(line, '.Provider') THEN 'context_provide' END], lambda x: x IS NOT NULL)) AS kind FROM lines)"""


@query(FLOW + " SELECT * FROM flow")
def data_flow_scan(spark, d):
    return so.data_flow(sources(spark, d))


@query(FLOW + ", b AS (SELECT path, count(*) FILTER (kind = 'prop_flow') AS prop_edges, count(*) FILTER (kind IN ('state', 'reducer', 'context_use')) AS hooks FROM flow GROUP BY path), c AS (SELECT *, (CASE WHEN prop_edges > 10 THEN 4 WHEN prop_edges > 5 THEN 3 WHEN prop_edges > 2 THEN 2 ELSE 1 END)::BIGINT AS depth FROM b) SELECT *, depth > 3 OR hooks > 5 AS flagged FROM c")
def state_bottlenecks(spark, d):
    return so.state_bottlenecks(so.data_flow(sources(spark, d)))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(line, {literal(w)})" for w in words) + ")"


INTEGRATE = SRC + ", hits AS (" + " UNION ALL ".join(f"SELECT path, line_no, line, '{k}' AS kind, '{t}' AS type FROM lines WHERE {_has(w)}" for k, w, t in so.DETECTORS) + f""" UNION ALL SELECT path, line_no, line, kind, CASE WHEN kind = 'websocket' THEN 'service' ELSE 'api' END FROM (SELECT *, CASE WHEN contains(line, 'apollo') AND contains(line, 'new ') OR contains(line, 'graphql') AND contains(line, '://') THEN 'graphql' WHEN contains(line, 'ws://') OR contains(line, 'wss://') OR contains(line, 'WebSocket') AND contains(line, 'new ') OR contains(line, 'socket.io') AND NOT contains(line, 'import') THEN 'websocket' WHEN (contains(line, 'http://') OR contains(line, 'https://')) AND {_has(('fetch', 'axios', 'request', 'get', 'post'))} THEN 'http' END AS kind FROM lines) WHERE kind IS NOT NULL
  UNION ALL SELECT path, line_no, line, 'oauth', 'auth' FROM lines WHERE contains(lower(line), 'oauth') UNION ALL SELECT path, line_no, line, 'ldap', 'auth' FROM lines WHERE contains(lower(line), 'ldap')
), h AS (SELECT hits.*, regexp_matches(content, {literal(so.HARDCODED)}) AS hard, contains(line, 'localhost') OR contains(line, '127.0.0.1') AS local FROM hits JOIN files USING (path)
), found AS (SELECT path, line_no, kind, type, CASE WHEN local THEN 'development' WHEN contains(line, 'staging') OR contains(line, 'test') THEN 'staging' WHEN contains(line, 'prod') OR contains(line, '.com') OR contains(line, '.net') THEN 'production' ELSE 'unknown' END AS environment,
  CASE WHEN type IN ('database', 'storage') THEN CASE WHEN hard THEN 'critical' WHEN local THEN 'low' ELSE 'medium' END WHEN type = 'api' THEN CASE WHEN hard THEN 'high' WHEN contains(line, 'http://') THEN 'medium' WHEN contains(line, 'https://') THEN 'low' ELSE 'medium' END WHEN kind = 'websocket' THEN CASE WHEN contains(line, 'ws://') THEN 'medium' ELSE 'low' END
    WHEN type = 'cloud' THEN CASE WHEN hard THEN 'critical' ELSE 'medium' END WHEN type = 'payment' THEN 'critical' WHEN type = 'auth' THEN 'high' WHEN kind = 'environment' THEN CASE WHEN regexp_matches(lower(line), 'password|secret|key|token|credential') THEN 'high' ELSE 'low' END ELSE 'medium' END AS risk FROM h)"""


@query(INTEGRATE + " SELECT * FROM found")
def integration_scan(spark, d):
    return so.integrations(sources(spark, d))


@query(INTEGRATE + " SELECT count(*) AS n, count(*) FILTER (risk IN ('high', 'critical')) AS n_high, count(DISTINCT type) AS n_types, round(100.0 * count(*) FILTER (risk IN ('high', 'critical')) / count(*), 6)::DOUBLE AS high_share, CASE WHEN 100.0 * count(*) FILTER (risk IN ('high', 'critical')) / count(*) > 50 THEN 'high' WHEN 100.0 * count(*) FILTER (risk IN ('high', 'critical')) / count(*) > 25 THEN 'medium' ELSE 'low' END AS assessment FROM found")
def integration_stats(spark, d):
    return so.integration_stats(so.integrations(sources(spark, d)))
