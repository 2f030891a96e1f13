"""Queries on complexity, duplication, debt, testability and maintainability over documents, each text taken as a function and each source as a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions.rules import six
from sparkquarry.operators import complexity as cx
from sparkquarry.operators import debt, duplication, reports, testability
from sparkquarry.store import Shelf

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark, sf_dir: str) -> DataFrame:
    t = F.col("text")
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("file_path"), F.col("lang").alias("class_name"), F.concat(F.lit("fn"), F.col("doc_id").cast("string")).alias("name"), (count("\n") * 4 + 1).cast("long").alias("lines"), (count(",") % 13).cast("long").alias("params"), (F.col("doc_id") % 3 == 0).alias("is_async"), (count(".") % 5).cast("long").alias("external"), (count("\n") % 3).cast("long").alias("internal"), (count("!") % 2).cast("long").alias("db"), (count("|") % 2).cast("long").alias("net"), (count("(") % 2).cast("long").alias("fs"), "text",
    )


FN = """WITH fn AS (
  SELECT doc_id, source AS file_path, lang AS class_name, 'fn' || doc_id AS name, (length(text) - length(replace(text, chr(10), ''))) * 4 + 1 AS lines, (length(text) - length(replace(text, ',', ''))) % 13 AS params,
    doc_id % 3 = 0 AS is_async, (length(text) - length(replace(text, '.', ''))) % 5 AS external, (length(text) - length(replace(text, chr(10), ''))) % 3 AS internal,
    (length(text) - length(replace(text, '!', ''))) % 2 AS db, (length(text) - length(replace(text, '|', ''))) % 2 AS net, (length(text) - length(replace(text, '(', ''))) % 2 AS fs, text FROM documents
), c0 AS (
  SELECT *, 1 + params // 3 + is_async::INT + CASE WHEN lines > 50 THEN 2 WHEN lines > 20 THEN 1 ELSE 0 END AS cyclomatic,
    CASE WHEN lines > 100 THEN 5 WHEN lines > 50 THEN 4 WHEN lines > 30 THEN 3 WHEN lines > 15 THEN 2 ELSE 1 END AS nesting FROM fn
), cx AS (
  SELECT *, cyclomatic + CASE WHEN lines - 1 > 30 THEN 2 ELSE 0 END AS cognitive,
    round((4 * cyclomatic + 3 * (cyclomatic + CASE WHEN lines - 1 > 30 THEN 2 ELSE 0 END) + 2 * nesting) / 10.0, 2) AS weighted,
    CASE WHEN cyclomatic >= 20 THEN 'severe' WHEN cyclomatic >= 15 THEN 'high' WHEN cyclomatic >= 10 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN cyclomatic > 25 OR nesting > 4 THEN 'high' WHEN cyclomatic > 15 OR nesting > 3 THEN 'medium' ELSE 'low' END AS refactor_risk,
    CASE WHEN cyclomatic + 2 * nesting > 30 THEN 'very_hard' WHEN cyclomatic + 2 * nesting > 20 THEN 'hard' WHEN cyclomatic + 2 * nesting > 10 THEN 'moderate' ELSE 'easy' END AS test_difficulty,
    CASE WHEN cyclomatic + nesting >= 9 THEN 'severe' WHEN cyclomatic + nesting >= 7 THEN 'high' WHEN cyclomatic + nesting >= 5 THEN 'medium' ELSE 'low' END AS level FROM c0
)
"""
ITEMS = FN + """, items AS (
  SELECT file_path, name, 'long_method' AS item, 'smell' AS category, CASE WHEN lines > 100 THEN 'high' WHEN lines > 50 THEN 'medium' ELSE 'low' END AS severity, 2 + lines / 50.0 AS hours FROM cx WHERE lines > 30
  UNION ALL SELECT file_path, name, 'too_many_parameters', 'smell', CASE WHEN params > 10 THEN 'high' WHEN params > 7 THEN 'medium' ELSE 'low' END, 0.25 * params FROM cx WHERE params > 5
  UNION ALL SELECT file_path, name, 'nested_loops', 'performance', CASE WHEN lines > 50 THEN 'high' WHEN lines > 25 THEN 'medium' ELSE 'low' END, 2.0 FROM cx WHERE lines > 20 AND params > 2
  UNION ALL SELECT file_path, name, 'sync_in_async', 'performance', 'high', 1.5 FROM cx WHERE is_async AND lines > 15
  UNION ALL SELECT file_path, name, 'memory_leak_risk', 'performance', 'medium', 1.0 FROM cx WHERE lines > 30 AND params > 3
  UNION ALL SELECT file_path, name, 'high_complexity', 'complexity', level, 1 + weighted / 10 * 2 FROM cx WHERE level IN ('high', 'severe')
  UNION ALL SELECT file_path, NULL, item, 'architecture', sev, h FROM (SELECT file_path, sum(external) AS imports, sum(internal) AS exports, count(*) AS functions, count(DISTINCT class_name) AS classes FROM fn GROUP BY 1) f,
    (VALUES ('circular_dependency', 'high', 4.0), ('god_object', 'high', 6.0), ('tight_coupling', 'medium', 3.0), ('excessive_imports', 'low', 0.5)) v(item, sev, h)
    WHERE CASE item WHEN 'circular_dependency' THEN imports > 10 AND exports > 5 WHEN 'god_object' THEN functions + 3 * classes > 50 WHEN 'tight_coupling' THEN imports > 15 ELSE imports > 20 END
  UNION ALL SELECT file_path, class_name, 'large_class', 'smell', CASE WHEN m > 50 OR l > 1000 THEN 'high' WHEN m > 30 OR l > 750 THEN 'medium' ELSE 'low' END, 4 + 2 * m / 10.0 FROM (SELECT file_path, class_name, count(*) AS m, sum(lines) AS l FROM fn GROUP BY 1, 2) WHERE m > 20 OR l > 500
  UNION ALL SELECT file_path, class_name, 'too_many_methods', 'smell', 'medium', 0.5 * m FROM (SELECT file_path, class_name, count(*) AS m FROM fn GROUP BY 1, 2) WHERE m > 15
  UNION ALL SELECT NULL, same, 'exact_duplication', 'duplication', 'high', 0.1 * burden FROM (SELECT sha256(regexp_replace(text, '[ \\t]', '', 'g')) AS same, round(count(*) * min(length(text) - length(replace(text, chr(10), '')) + 1) * 0.9, 6) AS burden FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) WHERE burden > 50
), s0 AS (
  SELECT *, CASE severity WHEN 'critical' THEN 10.0 WHEN 'severe' THEN 10.0 WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.0 ELSE 1.0 END * (1 + least(hours::DOUBLE / 10, 2.0)) AS score,
    CASE WHEN item IN ('high_complexity', 'exact_duplication') THEN 0.9 WHEN item IN ('memory_leak_risk', 'circular_dependency') THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence FROM items
), sc AS (SELECT *, score * confidence AS impact, 0.3::DOUBLE AS change_frequency, CASE WHEN 0.4 * score * confidence + 0.09 > 8 THEN 'critical' WHEN 0.4 * score * confidence + 0.09 > 6 THEN 'high' WHEN 0.4 * score * confidence + 0.09 > 3 THEN 'medium' ELSE 'low' END AS priority FROM s0)
"""


@query(FN + "SELECT name, cyclomatic::BIGINT AS cyclomatic, cognitive::BIGINT AS cognitive, nesting::BIGINT AS nesting, weighted::DOUBLE AS weighted, severity, refactor_risk, test_difficulty, level FROM cx")
def fn_complexity(spark, d):
    return cx.complexity(functions(spark, d)).select("name", "cyclomatic", "cognitive", "nesting", "weighted", "severity", "refactor_risk", "test_difficulty", "level")


@query(FN + "SELECT level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM cx GROUP BY level")
def complexity_levels(spark, d):
    return cx.levels(cx.complexity(functions(spark, d)))


ROLLUP = "count(*) AS n_functions, sum(cyclomatic)::BIGINT AS total, round(avg(cyclomatic), 6) AS mean, max(cyclomatic)::BIGINT AS most, count(*) FILTER (level IN ('high', 'severe')) AS n_high, CASE WHEN avg(cyclomatic) > 15 OR count(*) FILTER (level IN ('high', 'severe')) > 5 THEN 'high' WHEN avg(cyclomatic) > 10 OR count(*) FILTER (level IN ('high', 'severe')) > 2 THEN 'medium' ELSE 'low' END AS risk FROM cx"


@query(FN + f"SELECT file_path, {ROLLUP} GROUP BY file_path")
def complexity_file_rollup(spark, d):
    return cx.rollup(cx.complexity(functions(spark, d)), "file_path")


@query(FN + f"SELECT file_path, class_name, {ROLLUP} GROUP BY file_path, class_name")
def complexity_class_rollup(spark, d):
    return cx.rollup(cx.complexity(functions(spark, d)), "file_path", "class_name")


@query(FN + "SELECT name, weighted::DOUBLE AS weighted, level FROM cx ORDER BY weighted DESC, name LIMIT 20")
def complexity_top20(spark, d):
    return cx.worst(cx.complexity(functions(spark, d)).select("name", "weighted", "level"))


@query(FN + "SELECT count(*) AS n_functions, round(greatest(0.0, 100 - 5 * avg(cyclomatic)), 6) AS score, max(cyclomatic)::BIGINT AS most FROM cx")
def complexity_overall(spark, d):
    return cx.overall(cx.complexity(functions(spark, d)))


def _halstead(spark, d):
    t = F.col("text")
    found = lambda p: F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1))
    count, distinct = F.size, lambda c: F.size(F.array_distinct(c))
    # One search of the text for each kind; a projection of its own, so that sizes are taken of what it found.
    rows = cx.complexity(functions(spark, d)).withColumn("_ops", found("[,.;!?|]")).withColumn("_words", found("[A-Za-z]+"))
    rows = rows.withColumn("n1", distinct("_ops")).withColumn("n2", distinct("_words")).withColumn("t1", count("_ops")).withColumn("t2", count("_words")).withColumn("comment_ratio", F.lit(0.0)).drop("_ops", "_words")
    return cx.halstead(rows)


HALSTEAD = FN + """, h0 AS (
  SELECT *, len(list_distinct(regexp_extract_all(text, '[,.;!?|]')))::DOUBLE AS n1, len(list_distinct(regexp_extract_all(text, '[A-Za-z]+')))::DOUBLE AS n2, len(regexp_extract_all(text, '[,.;!?|]'))::DOUBLE AS t1, len(regexp_extract_all(text, '[A-Za-z]+'))::DOUBLE AS t2 FROM cx
), h1 AS (SELECT *, (t1 + t2) * log2(greatest(n1 + n2, 1)) AS volume, n1 / 2 * CASE WHEN n2 > 0 THEN t2 / n2 ELSE 0 END AS difficulty FROM h0
), h AS (SELECT *, greatest(0.0, least(100.0, 171 - 0.23 * 4 * 5.2 * ln(greatest(volume, 1)) - 0.12 * 8 * 0.23 * cyclomatic - 0.40 * 2.5 * 16.2 * ln(greatest(lines, 1)))) AS mi FROM h1)
"""


@query(HALSTEAD + "SELECT name, round(volume, 4) AS volume, round(difficulty, 4) AS difficulty, round(mi, 4) AS mi, CASE WHEN mi >= 85 THEN 'high' WHEN mi >= 70 THEN 'medium' ELSE 'low' END AS maintainability FROM h")
def halstead_mi(spark, d):
    return _halstead(spark, d).select("name", F.round("volume", 4).alias("volume"), F.round("difficulty", 4).alias("difficulty"), F.round("mi", 4).alias("mi"), "maintainability")


@query(HALSTEAD + "SELECT file_path, count(*) AS n_functions, round(sum(mi * lines) / sum(lines), 6) AS mi, count(*) FILTER (mi < 70) AS n_low FROM h GROUP BY file_path")
def mi_weighted_rollup(spark, d):
    return cx.weighted_index(_halstead(spark, d), "file_path")


def blocks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("block_id"), F.col("source").alias("file_path"), F.col("text").alias("content"))


EXACT = """WITH b AS (SELECT doc_id, source, text, sha256(regexp_replace(text, '[ \\t]', '', 'g')) AS cluster, length(text) - length(replace(text, chr(10), '')) + 1 AS ln FROM documents),
cl AS (SELECT cluster, count(*) AS n, min(doc_id) AS first_block, min(ln) AS lines, count(DISTINCT source) AS n_files FROM b GROUP BY cluster HAVING count(*) > 1),
m AS (SELECT b.doc_id, b.source, cl.* FROM b JOIN cl USING (cluster))
"""


@query(EXACT + "SELECT cluster, n, first_block, lines::BIGINT AS lines, n_files, round(n * lines * 0.9, 6)::DOUBLE AS burden, CASE WHEN n * lines * 0.9 > 100 THEN 'critical' WHEN n * lines * 0.9 > 50 THEN 'high' WHEN n * lines * 0.9 > 20 THEN 'medium' ELSE 'low' END AS priority FROM cl")
def dup_exact_clusters(spark, d):
    return duplication.exact_clusters(blocks(spark, d))


@query("SELECT md5(array_to_string(regexp_extract_all(text, '\\b(if|else|for|while|function|class|return|var|let|const)\\b|[{}\\[\\]();,.]'), '')) AS skeleton, count(*) AS n, min(doc_id) AS first_block, max(doc_id) AS last_block FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_structural_hash(spark, d):
    return duplication.structural_clusters(blocks(spark, d))


@query("""WITH s AS (SELECT md5(array_to_string(regexp_extract_all(text, '\\b(if|else|for|while|function|class|return|var|let|const)\\b|[{}\\[\\]();,.]'), '')) AS skeleton, doc_id, text FROM documents WHERE text IS NOT NULL),
k AS (SELECT skeleton, text, count(*) AS c, min(doc_id) AS lo, max(doc_id) AS hi FROM s GROUP BY 1, 2), g AS (SELECT skeleton, sum(c)::BIGINT AS n, min(lo) AS first_block, max(hi) AS last_block, sum(c * (c - 1) / 2) AS same FROM k GROUP BY 1 HAVING sum(c) > 1),
p AS (SELECT a.skeleton, sum(a.c * b.c * (1 - levenshtein(a.text, b.text) / greatest(strlen(a.text), strlen(b.text)))) AS unlike FROM k a JOIN k b ON a.skeleton = b.skeleton AND a.text < b.text GROUP BY 1)
SELECT skeleton, n, first_block, last_block, round((same + coalesce(unlike, 0)) / (n * (n - 1) / 2), 6)::DOUBLE AS similarity FROM g LEFT JOIN p USING (skeleton) WHERE (same + coalesce(unlike, 0)) / (n * (n - 1) / 2) >= 0.85""")
def dup_structural_clusters(spark, d):
    return duplication.similar_clusters(blocks(spark, d))


@query(EXACT + ", p AS (SELECT DISTINCT cluster, source, lines FROM m) SELECT a.source AS file_a, b.source AS file_b, count(*) AS n_clusters, sum(a.lines)::BIGINT AS shared_lines FROM p a JOIN p b ON a.cluster = b.cluster AND a.source < b.source GROUP BY 1, 2")
def dup_cross_source_pairs(spark, d):
    b = blocks(spark, d)
    return duplication.cross_file_pairs(duplication.members(b, duplication.exact_clusters(b)))


@query(EXACT + ", t AS (SELECT source, sum(ln) AS total FROM b GROUP BY 1), u AS (SELECT source, sum(lines) AS dup, count(*) FILTER (n_files > 1) AS ext FROM m GROUP BY 1) SELECT t.source AS file_path, total::BIGINT AS total, coalesce(dup, 0)::BIGINT AS duplicated, coalesce(ext, 0)::BIGINT AS n_external, round(100.0 * coalesce(dup, 0) / total, 6)::DOUBLE AS hotspot, CASE WHEN coalesce(dup, 0)::DOUBLE / total > 0.3 THEN 'critical' WHEN coalesce(dup, 0)::DOUBLE / total > 0.2 THEN 'high' WHEN coalesce(dup, 0)::DOUBLE / total > 0.1 THEN 'medium' ELSE 'low' END AS priority FROM t LEFT JOIN u ON t.source = u.source")
def dup_file_hotspots(spark, d):
    b = blocks(spark, d)
    return duplication.file_hotspots(duplication.members(b, duplication.exact_clusters(b)), b)


@query("""WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda t: t <> ''))) AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT t, min(doc_id) AS id, count(*) AS copies, len(t) AS n FROM s WHERE len(t) > 0 GROUP BY t), u AS (SELECT id, copies, n, unnest(t) AS tok FROM k),
p AS (SELECT a.id AS a, b.id AS b, a.copies AS copies_a, b.copies AS copies_b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.tok = b.tok AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL)
SELECT a, b, copies_a, copies_b, round(c / (na + nb - c), 6)::DOUBLE AS jaccard FROM p WHERE 100 * c >= 75 * (na + nb - c)""")
def dup_token_jaccard(spark, d):
    return duplication.token_pairs(blocks(spark, d))


@query(EXACT + ", c AS (SELECT *, n * lines * 0.9 AS burden FROM cl) SELECT cluster, (2.0 * n)::DOUBLE AS hours, (lines * (n - 1))::BIGINT AS saved_lines, round(0.2 * burden / (2.0 * n), 6)::DOUBLE AS roi, CASE WHEN n_files > 1 THEN 'new_utility_file' ELSE 'same_file' END AS target FROM c WHERE burden > 50")
def dup_consolidation(spark, d):
    return duplication.consolidation(duplication.exact_clusters(blocks(spark, d)))


@query(EXACT + ", c AS (SELECT count(*) AS n_clusters, sum(n)::BIGINT AS n_instances, round(sum(round(n * lines * 0.9, 6)) / 100, 6)::DOUBLE AS debt FROM cl) SELECT *, round(n_instances / n_clusters, 6) AS multiplier, CASE WHEN debt > 50 THEN 'critical' WHEN debt > 30 THEN 'poor' WHEN debt > 15 THEN 'fair' ELSE 'good' END AS health FROM c")
def dup_impact(spark, d):
    return duplication.impact(duplication.exact_clusters(blocks(spark, d)))


def items(spark, d, f=None, clusters=None):
    """f, clusters: functions and exact clusters, where the caller has them as tables."""
    f = functions(spark, d) if f is None else f
    clusters = duplication.exact_clusters(blocks(spark, d)) if clusters is None else clusters
    files = f.groupBy("file_path").agg(F.sum("external").alias("imports"), F.sum("internal").alias("exports"), F.count("*").alias("functions"), F.count_distinct("class_name").alias("classes"))
    classes = f.groupBy("file_path", F.col("class_name").alias("name")).agg(F.count("*").alias("methods"), F.sum("lines").alias("lines"))
    found = debt.function_items(cx.complexity(f)).unionByName(debt.file_items(files)).unionByName(debt.class_items(classes)).unionByName(debt.duplication_items(clusters))
    return debt.scored_items(found)


@query(ITEMS + "SELECT file_path, name, item, category, severity, round(hours::DOUBLE, 6) AS hours, round(score, 6) AS score, round(impact, 6) AS impact, priority FROM sc")
def debt_items_union(spark, d):
    return items(spark, d).select("file_path", "name", "item", "category", "severity", six(F.col("hours")).alias("hours"), six(F.col("score")).alias("score"), six(F.col("impact")).alias("impact"), "priority")


@query(ITEMS + ", g AS (SELECT category, count(*) AS n_items, round(sum(score), 6) AS score, round(sum(hours::DOUBLE), 6) AS hours, round(count(*) FILTER (severity IN ('high', 'severe', 'critical')) / count(*), 6) AS high_share FROM sc GROUP BY 1) SELECT *, CASE WHEN high_share > 0.5 THEN 'worsening' WHEN high_share > 0.2 THEN 'stable' ELSE 'improving' END AS trend, CASE WHEN hours > 40 THEN 'large' WHEN hours > 16 THEN 'medium' ELSE 'small' END AS effort FROM g")
def debt_category_rollup(spark, d):
    return debt.by_category(items(spark, d))


@query(ITEMS + ", g AS (SELECT file_path, count(*) AS n_items, round(sum(score), 6) AS score, round(sum(hours::DOUBLE), 6) AS hours, round(coalesce(sum(score) FILTER (category = 'smell'), 0), 6) AS smell, round(coalesce(sum(score) FILTER (category = 'architecture'), 0), 6) AS architecture, round(coalesce(sum(score) FILTER (category = 'performance'), 0), 6) AS performance, round(coalesce(sum(score) FILTER (category = 'complexity'), 0), 6) AS complexity FROM sc GROUP BY 1) SELECT *, CASE WHEN score > 50 THEN 'critical' WHEN score > 30 THEN 'high' WHEN score > 15 THEN 'medium' ELSE 'low' END AS priority, row_number() OVER (ORDER BY score DESC, file_path) AS position FROM g")
def debt_file_pivot(spark, d):
    return debt.by_file(items(spark, d), Shelf(spark, "debt"))


@query(ITEMS + "SELECT file_path, name, item, round(impact, 6) AS impact FROM sc WHERE hours <= 2 AND impact > 5")
def debt_quick_wins(spark, d):
    return debt.quick_wins(items(spark, d)).select("file_path", "name", "item", six(F.col("impact")).alias("impact"))


@query(ITEMS + ", g AS (SELECT category, sum(score) AS s FROM sc GROUP BY 1) SELECT round(100 - least(5 * avg(score), 100.0), 6) AS health, round(sum(hours::DOUBLE), 6) AS hours, ceil(sum(hours::DOUBLE) / 40)::BIGINT AS weeks, count(*) FILTER (hours <= 2 AND impact > 5) AS n_quick, count(*) FILTER (hours > 8) AS n_long, (SELECT category FROM g ORDER BY s DESC, category DESC LIMIT 1) AS focus FROM sc")
def debt_focus(spark, d):
    return debt.dashboard(items(spark, d))


@query(ITEMS + "SELECT category, round(sum(hours::DOUBLE), 6) AS hours, round(avg(impact / greatest(hours::DOUBLE, 0.5)), 6) AS roi, round(sum(impact), 6) AS impact, count(DISTINCT file_path) AS n_files FROM sc GROUP BY 1")
def debt_remediation_plan(spark, d):
    return debt.remediation_plan(items(spark, d))


TEST = FN + """, f AS (SELECT *, CASE WHEN cyclomatic <= 5 THEN 20 WHEN cyclomatic <= 15 THEN 50 ELSE 80 END AS f1, CASE WHEN 2 * external + internal <= 3 THEN 20 WHEN 2 * external + internal <= 8 THEN 50 ELSE 80 END AS f2, CASE WHEN 3 * db + 2 * net + fs <= 2 THEN 20 WHEN 3 * db + 2 * net + fs <= 6 THEN 50 ELSE 80 END AS f3,
 CASE WHEN lines <= 20 THEN 20 WHEN lines <= 50 THEN 50 ELSE 80 END AS f4, CASE WHEN is_async THEN 50 ELSE 20 END AS f5, db + net + fs AS mocks FROM cx),
ts AS (SELECT *, round((0.30 * (100 - f1) + 0.25 * (100 - f2) + 0.20 * (100 - f3) + 0.15 * (100 - f4) + 0.10 * (100 - f5))::DOUBLE, 6) AS score FROM f)
"""


@query(TEST + "SELECT name, score, CASE WHEN score >= 80 THEN 'easy' WHEN score >= 60 THEN 'moderate' WHEN score >= 40 THEN 'hard' ELSE 'very_hard' END AS difficulty, mocks::BIGINT AS mocks FROM ts")
def testability_score(spark, d):
    return testability.testability(cx.complexity(functions(spark, d))).select("name", "score", "difficulty", "mocks")


PATHS = FN + """, paths AS (
 SELECT file_path, name, 'conditional' AS path_type, unnest(range(params + lines // 10)) AS path_no, CASE WHEN lines > 50 THEN 'high' ELSE 'medium' END AS risk FROM fn WHERE params + lines // 10 > 0
 UNION ALL SELECT file_path, name, 'loop', 0, 'medium' FROM fn WHERE lines > 20 UNION ALL SELECT file_path, name, 'exception', 0, 'high' FROM fn
 UNION ALL SELECT file_path, name, 'async', unnest(range(2)), 'high' FROM fn WHERE is_async)
"""


@query(PATHS + "SELECT name, path_type, path_no::BIGINT AS path_no, risk FROM paths")
def untested_paths(spark, d):
    return testability.untested_paths(functions(spark, d)).select("name", "path_type", "path_no", "risk")


@query(PATHS + "SELECT file_path, path_type, count(*) AS n_paths, count(*) FILTER (risk = 'high') AS n_high, CASE WHEN path_type IN ('exception', 'async') AND count(*) > 5 THEN 'high' WHEN count(*) > 10 THEN 'high' ELSE 'medium' END AS severity FROM paths GROUP BY 1, 2 HAVING count(*) > 2")
def gap_rollup(spark, d):
    return testability.gaps(testability.untested_paths(functions(spark, d)))


@query(TEST + ", q AS (SELECT *, round((CASE WHEN score < 40 THEN 8.0 WHEN score < 60 THEN 4.0 WHEN score < 80 THEN 3.0 ELSE 2.0 END * (1 + 0.5 * mocks)) * 4) AS qh FROM ts), r AS (SELECT name, round(100 - score + 2 * cyclomatic, 6) AS impact, round((100 - score + 2 * cyclomatic) / greatest(qh / 4, 0.25), 6)::DOUBLE AS roi FROM q) SELECT *, CASE WHEN impact >= 80 AND roi >= 8 THEN 'critical' WHEN impact >= 60 AND roi >= 4 THEN 'high' WHEN impact >= 40 AND roi >= 2 THEN 'medium' ELSE 'low' END AS band FROM r")
def priority_matrix(spark, d):
    return testability.priority_matrix(testability.testability(cx.complexity(functions(spark, d)))).select("name", "impact", "roi", "band")


@query(ITEMS + HALSTEAD[len(FN):].rstrip() + TEST[len(FN):].rstrip() + """, c AS (SELECT
  (SELECT greatest(0.0, 100 - 5 * avg(cyclomatic)) FROM cx) AS complexity, (SELECT greatest(0.0, 100 * (1 - 2.0 * coalesce(sum(n - 1), 0) / (SELECT count(*) FROM documents))) FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(regexp_replace(text, '[ \\t]', '', 'g')) HAVING count(*) > 1)) AS duplication,
  (SELECT 100 - least(5 * avg(score), 100.0) FROM sc) AS debt, (SELECT avg(score) FROM ts) AS coverage, (SELECT 100.0 * (1 - (SELECT count(DISTINCT name) FROM sc WHERE category = 'performance') / count(*)) FROM fn) AS performance, (SELECT sum(mi * lines) / sum(lines) FROM h) AS maintainability
), o AS (SELECT *, 0.20 * complexity + 0.15 * duplication + 0.25 * debt + 0.20 * coverage + 0.10 * performance + 0.10 * maintainability AS overall FROM c)
SELECT round(complexity, 4) AS complexity, round(duplication, 4)::DOUBLE AS duplication, round(debt, 4) AS debt, round(coverage, 4) AS coverage, round(performance, 4)::DOUBLE AS performance, round(maintainability, 4) AS maintainability, round(overall, 4) AS overall, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'fair' ELSE 'poor' END AS grade FROM o""")
def quality_overall(spark, d):
    """Six components and their weighted sum. Performance is the share of functions without performance items."""
    scored = testability.testability(cx.complexity(functions(spark, d)))
    found = items(spark, d)
    parts = (
        scored.agg(F.greatest(F.lit(0.0), 100 - 5 * F.avg("cyclomatic")).alias("complexity"), F.avg("score").alias("coverage"), F.count("*").alias("all")), duplication.exact_clusters(blocks(spark, d)).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra")),
        found.agg((100 - F.least(5 * F.avg("score"), F.lit(100.0))).alias("debt"), F.count_distinct(F.when(F.col("category") == "performance", F.col("name"))).alias("slow")), _halstead(spark, d).agg((F.sum(F.col("mi") * F.col("lines")) / F.sum("lines")).alias("maintainability")),
    )
    one = parts[0]
    for part in parts[1:]:
        one = one.join(F.broadcast(part))  # one row each
    one = one.withColumn("duplication", F.greatest(F.lit(0.0), 100 * (1 - 2.0 * F.col("extra") / F.col("all")))).withColumn("performance", 100 * (1 - F.col("slow") / F.col("all")))
    return reports.overall(one)


def _recommended(spark, d):
    return reports.recommendations(duplication.exact_clusters(blocks(spark, d)), testability.testability(cx.complexity(functions(spark, d))), _halstead(spark, d))


RECS = HALSTEAD.rstrip() + TEST[len(FN):].rstrip() + ", " + EXACT[len("WITH "):].rstrip() + """, r0 AS (
  SELECT 'duplication' AS kind, cluster AS target, least(24.0, greatest(1.0, 0.1 * lines * greatest(1.0, 0.3 * n)))::DOUBLE AS effort, (lines * n)::DOUBLE AS benefit FROM cl WHERE n * lines * 0.9 > 50
  UNION ALL SELECT 'testing', name, least(32.0, CASE WHEN score < 40 THEN 8 WHEN score < 60 THEN 4 ELSE 2 END * (1 + 0.5 * mocks))::DOUBLE, (2 * (100 - score))::DOUBLE FROM ts WHERE score < 65
  UNION ALL SELECT 'maintainability', name, least(20.0, greatest(2.0, 0.3 * (80 - mi)))::DOUBLE, (1.2 * (100 - mi))::DOUBLE FROM h WHERE mi < 40
), r1 AS (SELECT kind, target, round(effort * 4) / 4 AS effort, round(benefit, 6) AS benefit FROM r0), r2 AS (SELECT *, round(benefit / effort, 2) AS roi FROM r1
), recs AS (SELECT *, CASE WHEN roi >= 40 THEN 'critical' WHEN roi >= 20 THEN 'high' WHEN roi >= 10 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN effort >= 16 THEN 'high' WHEN effort >= 4 THEN 'medium' ELSE 'low' END AS effort_band FROM r2)"""


@query(RECS + " SELECT * FROM recs ORDER BY roi DESC, benefit DESC, kind, target LIMIT 20")
def quality_recommendations(spark, d):
    """The top 20, a limit of the report itself."""
    return reports.ranked(_recommended(spark, d))


@query(RECS + ", g AS (SELECT kind, count(*) AS n, round(sum(effort), 6) AS hours, avg(roi) AS r FROM recs GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY r DESC, kind) AS phase, sum(ceil(hours / 40)) OVER (ORDER BY r DESC, kind) AS until_week FROM g) SELECT kind, n, hours, phase, until_week::BIGINT AS until_week, round(0.7 * hours, 6)::DOUBLE AS work_hours, round(0.2 * hours, 6)::DOUBLE AS test_hours, round(0.1 * hours, 6)::DOUBLE AS review_hours, greatest(2, ceil(hours / (40.0 * ceil(hours / 40))))::BIGINT AS team, round(100.0 * hours, 6)::DOUBLE AS cost FROM o")
def quality_roadmap(spark, d):
    return reports.roadmap(_recommended(spark, d))


LOOK = TEST.rstrip() + """, lk0 AS (SELECT *, 2 * is_async::INT + 2 * (params > 3)::INT AS open_paths, is_async::INT + CASE WHEN params > 0 THEN 2 ELSE 0 END AS open_gaps FROM ts),
lk AS (SELECT *, round(greatest(0.0, least(100.0, score - 5 * open_paths - 8 * mocks)), 6)::DOUBLE AS coverage, CASE WHEN score < 40 THEN 'critical' WHEN score < 60 THEN 'high' WHEN score < 80 THEN 'medium' ELSE 'low' END AS risk,
  2 + CASE WHEN score < 40 THEN 6 WHEN score < 60 THEN 4 WHEN score < 80 THEN 2 ELSE 0 END + mocks + open_paths + open_gaps AS hours, CASE WHEN mocks > 3 THEN 'integration_testing_with_test_doubles' WHEN score < 40 THEN 'refactor_then_unit_test' WHEN mocks > 0 THEN 'unit_testing_with_mocks' ELSE 'pure_unit_testing' END AS approach FROM lk0)"""


def _looked(spark, d):
    return testability.outlook(testability.testability(cx.complexity(functions(spark, d))))


@query(LOOK + " SELECT name, coverage, risk, hours::BIGINT AS hours, approach FROM lk")
def testability_outlook(spark, d):
    return _looked(spark, d).select("name", "coverage", "risk", "hours", "approach")


@query(LOOK + """, g AS (SELECT file_path, round(avg(score), 6) AS score, count(*) FILTER (score >= 60) AS tested, count(*) FILTER (score < 60) AS untested, least(100, 10 * count(*) + 15 * count(DISTINCT class_name) + 5 * sum(external))::BIGINT AS complexity, sum(mocks)::BIGINT AS mocks, sum(hours)::BIGINT AS hours, count(*) FILTER (is_async) + count(*) FILTER (params > 3) AS gaps FROM lk GROUP BY 1)
SELECT *, CASE WHEN score < 40 OR untested > 3 OR mocks > 5 THEN 'critical' WHEN score < 60 OR untested > 1 OR mocks > 2 THEN 'high' WHEN score < 80 OR untested > 0 THEN 'medium' ELSE 'low' END AS priority FROM g""")
def testability_by_file(spark, d):
    return testability.by_file(_looked(spark, d))


@query(LOOK + """, q AS (SELECT *, round((CASE WHEN score < 40 THEN 8.0 WHEN score < 60 THEN 4.0 WHEN score < 80 THEN 3.0 ELSE 2.0 END * (1 + 0.5 * mocks)) * 4) AS qh FROM ts), r AS (SELECT round(100 - score + 2 * cyclomatic, 6) AS impact, round((100 - score + 2 * cyclomatic) / greatest(qh / 4, 0.25), 6)::DOUBLE AS roi FROM q), bands AS (SELECT CASE WHEN impact >= 80 AND roi >= 8 THEN 'critical' WHEN impact >= 60 AND roi >= 4 THEN 'high' WHEN impact >= 40 AND roi >= 2 THEN 'medium' ELSE 'low' END AS band FROM r),
b AS (SELECT count(*) FILTER (band = 'critical') AS critical, count(*) FILTER (band = 'high') AS high, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'low') AS low FROM bands),
t AS (SELECT count(*) AS n, count(*) FILTER (score >= 60) AS tested, count(*) FILTER (risk IN ('high', 'critical')) AS high_risk, round(avg(score), 6) AS score, round(avg(coverage), 6) AS coverage, sum(mocks)::BIGINT AS mocks, sum(hours)::BIGINT AS net FROM lk), u AS (SELECT *, net + net * 3 // 10 AS hours FROM t)
SELECT n, tested, high_risk, score, coverage, mocks, hours, ceil(hours / 40)::BIGINT AS weeks, CASE WHEN mocks > 2 * n THEN 'very_high' WHEN mocks > n THEN 'high' WHEN mocks > n // 2 THEN 'medium' ELSE 'low' END AS mocking, CASE WHEN high_risk > n // 3 THEN 'high_risk_functions' WHEN mocks > n THEN 'integration_testing' WHEN score < 60 THEN 'refactoring_for_testability' ELSE 'balanced_coverage' END AS focus,
  CASE WHEN n = 0 THEN 'pass' WHEN score < 40 OR high_risk > n // 2 THEN 'fail' WHEN score < 60 OR high_risk > n // 4 THEN 'warning' ELSE 'pass' END AS gate, CASE WHEN critical > n // 4 THEN 'risk_driven_testing_with_immediate_critical_focus' WHEN high > n // 3 THEN 'balanced_testing_with_priority_focus' ELSE 'comprehensive_coverage_driven_testing' END AS approach, CASE WHEN mocks > n THEN 60 ELSE 70 END::BIGINT AS unit_share,
  CASE WHEN critical = 0 THEN 1 ELSE greatest(2, ceil(critical / 5)) END::BIGINT AS immediate_weeks, CASE WHEN high + medium = 0 THEN 1 ELSE greatest(2, ceil((high + medium) / 5)) END::BIGINT AS short_weeks, CASE WHEN low = 0 THEN 1 ELSE greatest(2, ceil(low / 5)) END::BIGINT AS long_weeks FROM u, b""")
def testing_strategy(spark, d):
    scored = testability.testability(cx.complexity(functions(spark, d)))
    return testability.strategy(testability.outlook(scored), testability.priority_matrix(scored))


#: The six sources, over the items of debt beside what the three have.
RECS6 = RECS[: RECS.index("), r1 AS")] + """
  UNION ALL SELECT 'complexity', name, least(40.0, greatest(2.0, (cyclomatic - 10) * 0.5 * greatest(1.0, lines / 100.0)))::DOUBLE, cyclomatic::DOUBLE FROM cx WHERE cyclomatic > 15
  UNION ALL SELECT * FROM (SELECT 'debt', file_path, greatest(hours, 0.25)::DOUBLE, (100 - health)::DOUBLE FROM (SELECT file_path, round(sum(hours::DOUBLE), 6) AS hours, greatest(0.0, 100 - round(sum(score), 6)) AS health FROM sc GROUP BY 1) WHERE health <= 60 AND file_path IS NOT NULL ORDER BY health, file_path LIMIT 10)
  UNION ALL SELECT 'performance', concat_ws('/', name, item), least(24.0, CASE item WHEN 'nested_loops' THEN 6.0 WHEN 'sync_in_async' THEN 6.0 WHEN 'memory_leak_risk' THEN 8.0 ELSE 5.0 END * (1 + impact / 100))::DOUBLE, 1.5 * impact FROM sc WHERE category = 'performance' AND severity IN ('high', 'critical')
""" + RECS[RECS.index("), r1 AS") :]
RECS6 = ITEMS.rstrip() + RECS6[len(FN) :] if RECS6.startswith(FN) else RECS6


def _six(spark, d):
    """Texts are read once for the functions and their measures, once for the clusters; the six sources read those narrow tables."""
    shelf = Shelf(spark, "debt")
    measured = shelf.put("measured", _halstead(spark, d).drop("text"))
    clusters = shelf.put("clusters", duplication.exact_clusters(blocks(spark, d)))
    found = items(spark, d, measured.select(*functions(spark, d).drop("text").columns), clusters)
    return reports.six_sources(clusters, testability.testability(measured), measured, measured, debt.by_file(found, shelf), found)


@query(RECS6 + " SELECT kind, priority, count(*) AS n, round(sum(effort), 6) AS hours, round(avg(roi), 6) AS roi FROM recs GROUP BY 1, 2")
def quality_recommendations_by_source(spark, d):
    """All recommendations of the six sources, by source and priority."""
    return _six(spark, d).groupBy("kind", "priority").agg(F.count("*").alias("n"), six(F.sum("effort")).alias("hours"), six(F.avg("roi")).alias("roi"))


@query(RECS6 + " SELECT kind, target, effort, benefit, roi, priority FROM recs WHERE kind <> 'duplication' AND kind <> 'testing' AND kind <> 'maintainability'")
def quality_recommendations_more(spark, d):
    """Each recommendation of the sources complexity, debt and performance."""
    return _six(spark, d).filter(F.col("kind").isin("complexity", "debt", "performance")).select("kind", "target", "effort", "benefit", "roi", "priority")
