"""Source files to tables: functions, classes, variables, imports, exports; module graph and roll-ups.

Extraction goes by patterns on trimmed lines; of the patterns of one kind the first that matches a
line counts. A function ends on the line where its braces close (its own line if it opens none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.rules import above, contains_any, first_of, occurrences, six
from sparkquarry.operators.components import strong_components
from sparkquarry.store import Shelf

# Excluded names, extensions, extraction patterns, ladders.
EXCLUDED = ("node_modules", ".git", ".vscode", "dist", "build", "coverage", ".nyc_output")
EXCLUDED_ENDS = (".min.js", ".bundle.js")
LANGUAGES = ((".jsx", "javascript"), (".js", "javascript"), (".tsx", "tsx"), (".ts", "typescript"))
MAX_SIZE = 10 << 20
IMPORTS = (
    ("named", r"import\s*\{\s*([^}]+)\s*\}\s*from\s*['\"]([^'\"]+)['\"]"), ("default", r"import\s+(\w+)\s+from\s*['\"]([^'\"]+)['\"]"), ("namespace", r"import\s*\*\s*as\s+(\w+)\s+from\s*['\"]([^'\"]+)['\"]"), ("side-effect", r"import\s*()['\"]([^'\"]+)['\"]"),
)
EXPORTS = (("named", r"export\s*\{\s*([^}]+)\s*\}"), ("default", r"export\s+default\s+(\w+)"), ("function", r"export\s+function\s+(\w+)"), ("class", r"export\s+class\s+(\w+)"), ("variable", r"export\s+(?:const|let|var)\s+(\w+)"))
FUNCTIONS = (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?function\s*\(([^)]*)\)", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*=>", r"(?:export\s+)?const\s+(\w+)\s*=\s*async\s*\(([^)]*)\)\s*=>")
CLASS = r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"
VARIABLES = (r"(?:export\s+)?(const|let|var)\s+(\w+)(?:\s*:\s*([^=]+))?\s*=", r"(?:export\s+)?(const|let|var)\s+(\w+)\s*:\s*([^;,\n]+)")
CHUNK = 1 << 20
_STEP = np.zeros(256, np.int8)
_STEP[list(b"([{")], _STEP[list(b")]}")] = 1, -1
CANDIDATES = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")


def scan(paths: DataFrame, more_excluded: tuple[str, ...] = (), max_size: int = MAX_SIZE) -> DataFrame:
    """paths(path, size) that are source files, with their language."""
    p = F.col("path")
    skip = contains_any(p, *EXCLUDED, *more_excluded)
    for end in EXCLUDED_ENDS:
        skip = skip | p.endswith(end)
    language = first_of(*((p.endswith(e), name) for e, name in LANGUAGES))
    return paths.filter(~skip & (F.col("size") <= max_size)).withColumn("language", language).filter("language is not null")


def lines(files: DataFrame) -> DataFrame:
    """path, line_no from 1, line (trimmed)."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("k", "line")).select("path", (F.col("k") + 1).cast("long").alias("line_no"), F.trim("line").alias("line"))


def _first(patterns, group: int) -> Column:
    """The group of the first pattern that matches the line; null: none does."""
    out = None
    for p in patterns:
        hit, value = F.regexp_like("line", F.lit(p)), F.regexp_extract("line", p, group)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _names(listed: Column) -> Column:
    """The names of a comma-separated list, of `a as b` the first."""
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$", "")), lambda x: x != "")


def imports(files: DataFrame) -> DataFrame:
    """path, line_no, source, import_type, names, is_external."""
    kind = first_of(*((F.regexp_like("line", F.lit(p)), k) for k, p in IMPORTS))
    out = lines(files).withColumn("import_type", kind).filter("import_type is not null")
    names = F.when(F.col("import_type") == "side-effect", F.array().cast("array<string>")).otherwise(_names(_first([p for _, p in IMPORTS], 1)))
    out = out.select("path", "line_no", _first([p for _, p in IMPORTS], 2).alias("source"), "import_type", names.alias("names"))
    return out.withColumn("is_external", ~F.col("source").startswith(".") & ~F.col("source").startswith("/"))


def loads(files: DataFrame) -> DataFrame:
    """path, line_no, source, how: every `from`, `require()` and `import()` of a line."""
    ways = (("from", r"from\s*['\"]([^'\"]+)['\"]"), ("require", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"), ("import()", r"import\(\s*['\"]([^'\"]+)['\"]\s*\)"))

    def of(way, pattern):
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda s: F.struct(F.lit(way).alias("how"), s.alias("source")))

    found = F.flatten(F.array(*(of(*w) for w in ways)))
    return lines(files).select("path", "line_no", F.explode(found).alias("x")).select("path", "line_no", "x.how", "x.source")


def exports(files: DataFrame) -> DataFrame:
    """path, line_no, export_type, name: a row for each exported name."""
    kind = first_of(*((F.regexp_like("line", F.lit(p)), k) for k, p in EXPORTS))
    return lines(files).withColumn("export_type", kind).filter("export_type is not null").select("path", "line_no", "export_type", F.explode(_names(_first([p for _, p in EXPORTS], 1))).alias("name"))


def classes(files: DataFrame) -> DataFrame:
    """path, line_no, name, parent (null: none), is_exported."""
    parent = F.regexp_extract("line", CLASS, 2)
    return lines(files).filter(F.regexp_like("line", F.lit(CLASS))).select("path", "line_no", F.regexp_extract("line", CLASS, 1).alias("name"), F.when(parent != "", parent).alias("parent"), F.col("line").contains("export").alias("is_exported"))


def variables(files: DataFrame) -> DataFrame:
    """path, line_no, kind, name, type (null: none), is_exported."""
    declared = F.trim(_first(VARIABLES, 3))
    return lines(files).select("path", "line_no", _first(VARIABLES, 1).alias("kind"), _first(VARIABLES, 2).alias("name"), F.when(declared != "", declared).alias("type"), F.col("line").contains("export").alias("is_exported")).filter("name is not null")


def functions(files: DataFrame) -> DataFrame:
    """path, name, params (names), is_async, is_exported, start_line, end_line, lines. The braces of a file are summed in one window over its lines."""
    rows = lines(files)
    net = occurrences(F.col("line"), "{") - occurrences(F.col("line"), "}")
    depth = rows.select("path", "line_no", F.sum(net).over(Window.partitionBy("path").orderBy("line_no")).alias("depth"))
    listed = F.filter(F.transform(F.split(_first(FUNCTIONS, 2), ","), lambda x: F.trim(F.regexp_replace(x, "[:=].*$", ""))), lambda x: x != "")
    found = rows.select("path", "line_no", _first(FUNCTIONS, 1).alias("name"), listed.alias("params"), F.col("line").contains("async").alias("is_async"), F.col("line").contains("export").alias("is_exported"), net.alias("net"), F.col("line").contains("{").alias("opens")).filter("name is not null")
    own = found.join(depth, ["path", "line_no"]).withColumn("before", F.col("depth") - F.col("net")).drop("depth")
    # A line closes each depth from its own up to the one before it; a function ends where its own is closed next.
    fell = depth.withColumn("above", F.lag("depth").over(Window.partitionBy("path").orderBy("line_no"))).filter("depth < above")
    marks = fell.select("path", F.explode(F.expr("sequence(depth, above - 1)")).alias("before"), "line_no", F.col("line_no").alias("closed"))
    starts = own.filter("opens").select("path", "before", "line_no", F.when(F.col("net") <= 0, F.col("line_no")).alias("here"))
    nearest = F.last("closed", ignorenulls=True).over(Window.partitionBy("path", "before").orderBy(F.desc("line_no"), F.col("closed").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = starts.withColumn("closed", F.lit(None).cast("int")).unionByName(marks.withColumn("here", F.lit(None).cast("int")).withColumn("closed", F.col("closed").cast("int")), allowMissingColumns=True)
    ends = both.withColumn("next", nearest).filter("closed is null").select("path", F.col("line_no").alias("start_line"), F.coalesce("here", "next").alias("closed"))
    out = own.withColumnRenamed("line_no", "start_line").join(ends, ["path", "start_line"], "left").withColumn("end_line", F.coalesce("closed", "start_line"))
    return out.select("path", "name", "params", "is_async", "is_exported", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))


def imbalance(files: DataFrame) -> DataFrame:
    """path, line, col of the first closing bracket without an opening one, else the end of the text where some stay open; balanced files give no row. Kinds of brackets are not told apart.

    A text goes through in chunks of CHUNK bytes; of each one only the running depth, its lowest point and the lines are kept.
    """

    def first_fault(text: bytes):
        depth, at, line, start = 0, 0, 1, 0  # depth, characters, line and its first character before the chunk
        for a in range(0, len(text), CHUNK):
            buf = np.frombuffer(text, np.uint8, min(CHUNK, len(text) - a), a)
            run = depth + np.cumsum(_STEP[buf], dtype=np.int64)
            chars = at + np.cumsum((buf & 0xC0) != 0x80)  # number of the character from 1
            low = int(np.argmax(run < 0)) if (run < 0).any() else -1
            ends = np.flatnonzero(buf == 10)
            # For an end of text that is a newline, the place is on the line that it ends.
            stop = low if low >= 0 else len(buf) - 1
            ends = ends[ends < stop] if low >= 0 or a + len(buf) == len(text) else ends
            if len(ends):
                line, start = line + len(ends), int(chars[ends[-1]])
            if low >= 0:
                return line, int(chars[low]) - start, "unexpected closing"
            depth, at = int(run[-1]), int(chars[-1])
        return (line, at - start, "never closed") if depth > 0 else None

    def run(batches):
        for batch in batches:
            found = [(p, *f) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c and (f := first_fault(c.encode()))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else ((),) * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "line", "col", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, line long, col long, problem string")


def context(files: DataFrame, at: DataFrame, radius: int = 2) -> DataFrame:
    """path, line, shown: the lines around each row of at(path, line), the line itself with a marker."""
    near = lines(files).join(at.select("path", "line").withColumnRenamed("line", "at_line"), "path").filter(F.abs(F.col("line_no") - F.col("at_line")) <= radius)
    text = F.concat(F.when(F.col("line_no") == F.col("at_line"), "> ").otherwise("  "), F.col("line_no").cast("string"), F.lit(": "), F.col("line"))
    return near.groupBy("path", F.col("at_line").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), "\n").alias("shown"))


def error_kind(message: Column) -> Column:
    """First rule of the ladder over a lower-cased message."""
    m = F.lower(message)
    return first_of((m.contains("syntax"), "syntax"), (m.contains("timeout"), "timeout"), (m.contains("memory"), "memory"), (contains_any(m, "no such file", "permission"), "io"), (contains_any(m, "encoding", "utf"), "encoding"), default="unknown")


def error_report(errors: DataFrame, n_files: int) -> DataFrame:
    """n_errors, n_recoverable, status, recovery_rate, over_budget of errors(kind)."""
    good = F.count_if(F.col("kind").isin("syntax", "encoding"))
    out = errors.agg(F.count("*").alias("n_errors"), good.alias("n_recoverable"))
    rate = F.col("n_errors") / n_files
    status = first_of((F.col("n_errors") == 0, "success"), (rate <= 0.1, "warning"), (rate <= 0.5, "error"), default="critical")
    return out.withColumn("status", status).withColumn("recovery_rate", F.when(F.col("n_errors") > 0, six(F.col("n_recoverable") / F.col("n_errors"))).otherwise(1.0)).withColumn("over_budget", (F.col("n_errors") >= 100) | (rate > 0.5))


def normal_path(path: Column) -> Column:
    """Folds `.` and `..` of any depth; `..` above the root is dropped."""
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p)))), "/"))


def resolved(loaded: DataFrame, files: DataFrame) -> DataFrame:
    """loaded(path, source, ...) with the first existing candidate in target; sources that name no file are left out."""
    base = F.when(F.col("source").startswith("/"), F.col("source")).otherwise(F.concat(F.regexp_replace("path", r"/[^/]*$", ""), F.lit("/"), F.col("source")))
    keys = loaded.columns
    inner = loaded.filter(F.col("source").startswith(".") | F.col("source").startswith("/"))
    tried = inner.withColumn("at", normal_path(base)).select(*keys, F.posexplode(F.array(*(F.concat("at", F.lit(e)) for e in CANDIDATES))).alias("order", "target"))
    found = tried.join(files.select(F.col("path").alias("target")), "target")
    return found.groupBy(*keys).agg(F.min_by("target", "order").alias("target"))


def module_edges(files: DataFrame) -> DataFrame:
    """src, dst, weight, is_external: 1 + the imported names (namespace 2, else 1 at least) for each import; external ends are ext:package."""
    found = imports(files)
    weight = 1 + F.when(F.col("import_type") == "named", F.size("names")).when(F.col("import_type") == "namespace", 2).when(F.col("import_type") == "default", 1).otherwise(0)
    found = found.withColumn("weight", weight.cast("long"))
    inner = resolved(found.select("path", "line_no", "source", "weight"), files).select(F.col("path").alias("src"), F.col("target").alias("dst"), "weight", F.lit(False).alias("is_external"))
    outer = found.filter("is_external").select(F.col("path").alias("src"), F.concat(F.lit("ext:"), package_of(F.col("source"))).alias("dst"), "weight", F.lit(True).alias("is_external"))
    return inner.unionByName(outer).groupBy("src", "dst", "is_external").agg(F.sum("weight").alias("weight"))


def package_of(source: Column) -> Column:
    """The package of an external import: the first part, of scoped ones the first two."""
    return F.regexp_extract(source, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def external_usage(files: DataFrame) -> DataFrame:
    """package, n_files, features (distinct imported names, sorted)."""
    rows = imports(files).filter("is_external").withColumn("package", package_of(F.col("source")))
    return rows.groupBy("package").agg(F.count_distinct("path").alias("n_files"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("features"))


def module_stats(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Totals of the module graph."""
    nodes = files.select(F.col("path").alias("node")).union(edges.filter("is_external").select("dst")).distinct().agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node").startswith("ext:")).alias("n_external_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if("is_external").alias("n_external"))
    return nodes.join(F.broadcast(e)).withColumn("edges_per_node", six(F.col("n_edges") / F.col("n_nodes")))  # one row each


def component_type(path: Column) -> Column:
    return first_of((contains_any(path, "service", "api"), "service"), (contains_any(path, "component", "ui"), "component"), (contains_any(path, "util", "helper"), "utility"), (contains_any(path, "model", "entity"), "model"), default="module")


def component_layer(path: Column) -> Column:
    return first_of((contains_any(path, "ui", "component", "view"), "presentation"), (contains_any(path, "service", "business", "logic"), "business"), (contains_any(path, "data", "repository", "model"), "data"), default="core")


def per_file(files: DataFrame) -> DataFrame:
    """path, n_functions, n_classes, n_imports, n_exports of every file."""
    out = files.select("path")
    for name, rows in (("n_functions", functions(files)), ("n_classes", classes(files)), ("n_imports", imports(files)), ("n_exports", exports(files))):
        out = out.join(rows.groupBy("path").agg(F.count("*").alias(name)), "path", "left")
    return out.fillna(0)


def component_map(counts: DataFrame) -> DataFrame:
    """A row for each folder below the first one (`root` where there is none): type and layer of its first file, files, complexity."""
    part = F.regexp_extract("path", r"^/[^/]+/([^/]+)/", 1)
    rows = counts.withColumn("component", F.when(part != "", part).otherwise("root"))
    out = rows.groupBy("component").agg(F.min("path").alias("first"), F.count("*").alias("n_files"), F.sum(F.col("n_functions") + F.col("n_classes")).alias("complexity"))
    return out.select("component", component_type(F.col("first")).alias("type"), component_layer(F.col("first")).alias("layer"), "n_files", "complexity")


def unused_exports(files: DataFrame) -> DataFrame:
    """path, export_type, name of exports that no file imports: by name, by a default import, or with all others by a namespace import. Imports that resolve to no file use nothing."""
    out = exports(files).select("path", "export_type", "name").distinct()
    found = imports(files)
    at = resolved(found.select("path", "line_no", "source"), files)
    used = found.join(at, ["path", "line_no", "source"]).select(F.col("target").alias("path"), "import_type", F.explode_outer("names").alias("name"))
    named = used.filter("import_type = 'named'").select("path", "name").distinct()
    whole = used.filter("import_type = 'namespace'").select("path").distinct()
    default = used.filter("import_type = 'default'").select("path", F.lit("default").alias("export_type")).distinct()
    return out.join(named, ["path", "name"], "left_anti").join(whole, "path", "left_anti").join(default, ["path", "export_type"], "left_anti").select("path", "export_type", "name")


def structural_score(counts: DataFrame, edges: DataFrame, unused: DataFrame, shelf: Shelf, documented: float = 0.0) -> DataFrame:
    """Mean functions and classes of a file, files, import cycles (components of several files, or a file that imports itself), unused exports, and the score: 100 - 5 for each cycle - 2 for each unused export + 5 if documented above 0.8, from 0 to 100."""
    inner = shelf.put("inner", edges.filter("not is_external").select("src", "dst"))
    many = strong_components(inner, shelf).filter("size > 1").select("node", "component")
    loops = inner.filter("src = dst").select(F.col("src").alias("node")).join(many, "node", "left_anti").select(F.col("node").alias("component"))
    n_cycles = many.select("component").unionByName(loops).distinct().agg(F.count("*").alias("n_cycles"))
    means = counts.agg(six(F.avg("n_functions")).alias("functions_per_file"), six(F.avg("n_classes")).alias("classes_per_file"), F.count("*").alias("n_files"))
    out = means.join(F.broadcast(n_cycles)).join(F.broadcast(unused.agg(F.count("*").alias("n_unused"))))  # one row each
    score = 100 - 5 * F.col("n_cycles") - 2 * F.col("n_unused") + (5 if documented > 0.8 else 0)
    return out.withColumn("score", F.greatest(F.least(score, F.lit(100)), F.lit(0)).cast("long"))


# Words of function names, impacts and severities of anti-patterns.
QUERY_WORDS = ("find", "query", "select", "get", "fetch", "load", "retrieve", "search")
ITERATION_WORDS = ("process", "handle", "iterate", "loop", "foreach", "map", "filter", "transform", "convert", "parse", "validate", "check", "update", "modify")
NESTED_WORDS = ("nested", "double", "deep", "multi", "cross", "matrix", "grid", "intersect", "cartesian")
HEAVY = (("lodash", 70), ("moment", 67), ("jquery", 85), ("rxjs", 45), ("three", 600), ("d3", 250), ("chart.js", 60), ("bootstrap", 150), ("material-ui", 340), ("antd", 2000), ("react", 45), ("vue", 35), ("angular", 130))


def anti_patterns(fns: DataFrame) -> DataFrame:
    """path, name, pattern, severity, impact: one pass over the functions, a row for each rule that holds."""
    name, n = F.lower("name"), F.col("lines")
    first = F.lower(F.element_at("params", 1))
    looped = (F.size("params") == 1) & contains_any(first, "id", "key", "item", "element") | name.contains("byid")
    query, iterates, nested = contains_any(name, *QUERY_WORDS), contains_any(name, *ITERATION_WORDS), contains_any(name, *NESTED_WORDS)
    lists = F.exists("params", lambda p: F.lower(p).contains("list"))
    item = lambda kind, severity, impact: F.struct(F.lit(kind).alias("pattern"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (impact if isinstance(impact, Column) else F.lit(float(impact))).cast("double").alias("impact"))
    depth = F.when(n - 1 > 100, 3).otherwise(2)
    rules = (
        (query & looped, item("n_plus_one", "high", 85)), (F.col("is_async") & query & lists, item("sequential_async", "high", 80)), (F.col("is_async") & iterates, item("sync_in_loop", "high", 75)), (nested, item("nested_iteration", "medium", 60)),
        ((n - 1 > 50) | (F.size("params") > 5), item("potential_leak", "medium", 50)), (nested, item("nested_loops", F.when(depth >= 3, "high").otherwise("medium"), F.least(F.lit(90.0), six(30 * F.pow(F.lit(1.5), depth))))),
        (n > 100, item("large_function", F.when(n > 200, "critical").otherwise("high"), 40 + F.floor(n / 10))), (contains_any(name, "concat", "append", "build", "join") & iterates, item("string_concat", "medium", 40)), (name.contains("sync") & ~F.col("is_async"), item("blocking", "high", 70)),
    )
    return fns.select("path", "name", F.explode(F.array_compact(F.array(*(F.when(c, s) for c, s in rules)))).alias("x")).select("path", "name", "x.*")


def heavy_imports(imported: DataFrame) -> DataFrame:
    """path, source, library, size_kb: imports that hold a heavy library's name; the dimension has 13 rows, so it is an array, not a join."""
    dim = F.array(*(F.struct(F.lit(w).alias("library"), F.lit(kb).cast("long").alias("size_kb")) for w, kb in HEAVY))
    return imported.select("path", "source", "import_type", F.explode(F.filter(dim, lambda x: F.contains(F.col("source"), x["library"]))).alias("x")).select("path", "source", "import_type", "x.*")


def bottlenecks(scored: DataFrame) -> DataFrame:
    """Functions of a weighted complexity above 20 are bottlenecks."""
    return scored.filter("weighted > 20").select("path", "name", "weighted", F.when(F.col("weighted") > 30, "critical").otherwise("high").alias("severity"))


def performance_grade(found: DataFrame, n_bottlenecks: DataFrame, bundle_kb: DataFrame) -> DataFrame:
    """score, grade: 100 less 15, 10, 5, 2 for each anti-pattern by severity, 12 for each bottleneck, and 1 for each 100 KB over 500."""
    weight = first_of((F.col("severity") == "critical", 15), (F.col("severity") == "high", 10), (F.col("severity") == "medium", 5), default=2)
    rows = found.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("minus"), F.count("*").alias("n_patterns")).join(F.broadcast(n_bottlenecks)).join(F.broadcast(bundle_kb))  # one row each
    score = F.greatest(F.lit(0.0), 100 - F.col("minus") - 12 * F.col("n_bottlenecks") - F.greatest(F.lit(0.0), (F.col("bundle_kb") - 500) / 100))
    return rows.withColumn("score", six(score)).withColumn("grade", first_of((F.col("score") >= 90, "A"), (F.col("score") >= 80, "B"), (F.col("score") >= 70, "C"), (F.col("score") >= 60, "D"), default="F")).drop("minus")


def data_flow(files: DataFrame) -> DataFrame:
    """path, line_no, kind of each data-flow rule that a line meets."""
    s = F.col("line")
    declares = contains_any(s, "const ", "let ")
    rules = (
        (s.contains("useState") & declares, "state"), (s.contains("useReducer") & declares, "reducer"), (s.contains("set") & s.contains("(") & s.contains(")"), "setter"), (contains_any(s, "const {", "let {", "= ({ ", "= (props"), "props"), (s.contains("=") & s.contains("{") & s.contains("}"), "prop_flow"),
        (s.contains("fetch("), "fetch"), (F.regexp_like(s, F.lit(r"axios\.(get|post|put|delete)\(")), "axios"), (contains_any(s, "onClick", "onChange", "onSubmit"), "event"), (s.contains("createContext"), "context_create"), (s.contains("useContext"), "context_use"), (s.contains(".Provider"), "context_provide"),
    )
    return lines(files).select("path", "line_no", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for c, k in rules)))).alias("kind"))


def state_bottlenecks(flow: DataFrame) -> DataFrame:
    """path, prop_edges, depth, hooks, flagged: more than 10, 5, 2 prop edges count as depth 4, 3, 2; flagged above depth 3 or 5 hooks."""
    out = flow.groupBy("path").agg(F.count_if(F.col("kind") == "prop_flow").alias("prop_edges"), F.count_if(F.col("kind").isin("state", "reducer", "context_use")).alias("hooks"))
    out = out.withColumn("depth", above(F.col("prop_edges"), (10, 4), (5, 3), (2, 2), default=1).cast("long"))
    return out.withColumn("flagged", (F.col("depth") > 3) | (F.col("hooks") > 5))


# Words of the integration detectors, in order.
DETECTORS = (
    ("mongodb", ("mongodb://", "mongodb+srv://", "MongoClient", "mongoose.connect"), "database"), ("postgresql", ("postgresql://", "postgres://", "pg.Client", "new Pool"), "database"), ("mysql", ("mysql://", "mysql.createConnection", "mysql2"), "database"), ("redis", ("redis://", "createClient", "new Redis"), "storage"),
    ("aws", ("aws-sdk", ".amazonaws.com", "AWS.", "S3", "DynamoDB", "Lambda"), "cloud"), ("gcp", ("google-cloud", ".googleapis.com", "firebase", "firestore"), "cloud"), ("payment", ("stripe", "paypal", "payment", "checkout"), "payment"), ("analytics", ("analytics", "gtag", "mixpanel", "amplitude"), "analytics"),
    ("messaging", ("kafka", "rabbitmq", "sqs", "pubsub"), "messaging"), ("jwt", ("jwt", "jsonwebtoken", "bearer"), "auth"), ("environment", ("process.env", "os.Getenv"), "unknown"),
)
HARDCODED = r"(?i)(password|api_?key|token)\s*[:=]\s*['\"][^'\"]+['\"]"


def integrations(files: DataFrame) -> DataFrame:
    """path, line_no, kind, type, environment, risk of each detector that a line meets. Of graphql, websocket and http the first counts. Hard-coded credentials anywhere in the file raise the risk."""
    s, low = F.col("line"), F.lower("line")
    url = s.contains("http://") | s.contains("https://")
    socket = contains_any(s, "ws://", "wss://") | s.contains("WebSocket") & s.contains("new ") | s.contains("socket.io") & ~s.contains("import")
    call = F.when(s.contains("apollo") & s.contains("new ") | s.contains("graphql") & s.contains("://"), F.struct(F.lit("graphql").alias("kind"), F.lit("api").alias("type"))).when(socket, F.struct(F.lit("websocket").alias("kind"), F.lit("service").alias("type"))).when(url & contains_any(s, "fetch", "axios", "request", "get", "post"), F.struct(F.lit("http").alias("kind"), F.lit("api").alias("type")))
    hit = F.array_compact(F.array(*(F.when(contains_any(s, *words), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("type"))) for k, words, t in DETECTORS), call, F.when(low.contains("oauth"), F.struct(F.lit("oauth").alias("kind"), F.lit("auth").alias("type"))), F.when(low.contains("ldap"), F.struct(F.lit("ldap").alias("kind"), F.lit("auth").alias("type")))))
    hard = files.select("path", F.regexp_like("content", F.lit(HARDCODED)).alias("hard"))
    rows = lines(files).select("path", "line_no", "line", F.explode(hit).alias("x")).join(hard, "path")
    local = contains_any(s, "localhost", "127.0.0.1")
    environment = first_of((local, "development"), (contains_any(s, "staging", "test"), "staging"), (contains_any(s, "prod", ".com", ".net"), "production"), default="unknown")
    kind, of = F.col("x.kind"), F.col("x.type")
    secret = contains_any(low, "password", "secret", "key", "token", "credential")
    risk = first_of(
        (of.isin("database", "storage"), F.when(F.col("hard"), "critical").when(local, "low").otherwise("medium")), (of == "api", F.when(F.col("hard"), "high").when(s.contains("http://"), "medium").when(s.contains("https://"), "low").otherwise("medium")), (kind == "websocket", F.when(s.contains("ws://"), "medium").otherwise("low")),
        (of == "cloud", F.when(F.col("hard"), "critical").otherwise("medium")), (of == "payment", "critical"), (of == "auth", "high"), (kind == "environment", F.when(secret, "high").otherwise("low")), default="medium",
    )
    return rows.select("path", "line_no", kind.alias("kind"), of.alias("type"), environment.alias("environment"), risk.alias("risk"))


def integration_stats(found: DataFrame) -> DataFrame:
    """Totals, share of high risks and the assessment."""
    out = found.agg(F.count("*").alias("n"), F.count_if(F.col("risk").isin("high", "critical")).alias("n_high"), F.count_distinct("type").alias("n_types"))
    share = F.when(F.col("n") > 0, 100 * F.col("n_high") / F.col("n")).otherwise(0.0)
    return out.withColumn("high_share", six(share)).withColumn("assessment", above(share, (50, "high"), (25, "medium"), default="low"))
