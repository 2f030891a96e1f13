"""Rule scans over texts and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions.rules import contains_any, first_of, occurrences

#: Weights in tenths and thresholds in tenths, compared strictly.
PATTERNS = {
    "mvc": (((("controller", "model", "view"), 4), (("Controller", "Model", "View"), 3), (("router",), 2), (("req",), 1)), 6),
    "component": (((("components/",), 3), (("Component", "const "), 3), (("props", "children"), 2), (("render", "return"), 2)), 7),
    "observer": (((("addEventListener", ".on("), 3), (("onclick", "onClick", "onChange"), 3), (("subscribe", "observer"), 2), (("callback", "=>"), 2)), 6),
    "page": (((("<html",), 4), (("<script",), 3), (("href=",), 2), (("<div",), 1)), 6),
}
URL = r"https?://[^\s\"'<>()]+"
PATH = r"(?:href|src|action)=[\"'](/[^\"']*)[\"']"
# What a URL must not hold, in any case of letters.
BAD_URL = ("javascript:", "data:", "file:", "ftp:", "../", "..\\\\", "<script", "${", "$(")


def lines(texts: DataFrame, column: str) -> DataFrame:
    """A row for each trimmed line that is not empty, with its number from 1."""
    out = texts.select("*", F.posexplode(F.split(column, "\n")).alias("line_no", "line")).drop(column)
    return out.withColumn("line_no", (F.col("line_no") + 1).cast("long")).withColumn("line", F.trim("line")).filter("line <> ''")


def credentials(texts: DataFrame, column: str) -> DataFrame:
    """Flags of whole texts and the risk: hard-coded values are critical."""
    t = F.col(column)
    out = texts.withColumn("has_password", F.regexp_like(t, F.lit("(password|passwd)[ ]*[:=]"))).withColumn("has_token", F.regexp_like(t, F.lit("token[ ]*[:=]"))).withColumn("has_key", F.regexp_like(t, F.lit("AKIA[A-Z0-9]{16}"))).withColumn("has_env", t.contains("process.env"))
    return out.withColumn("risk", first_of((F.col("has_password") | F.col("has_key"), "critical"), (F.col("has_token"), "high"), (F.col("has_env"), "medium"), default="low")).drop(column)


def pattern_scores(texts: DataFrame, column: str) -> DataFrame:
    """A row for each pattern above its threshold: pattern, tenths."""
    t = F.col(column)
    scored = []
    for name, (weights, threshold) in PATTERNS.items():
        total = sum((F.when(contains_any(t, *words), w).otherwise(0) for words, w in weights), F.lit(0))
        scored.append(F.when(total > threshold, F.struct(F.lit(name).alias("pattern"), total.cast("long").alias("tenths"))))
    return texts.select("*", F.explode(F.array_compact(F.array(*scored))).alias("x")).drop(column).select("*", "x.pattern", "x.tenths").drop("x")


def component_type(text: Column) -> Column:
    """Ordered classifier."""
    return first_of((text.contains("React") | text.contains("useState"), "react"), (text.contains("next(") | text.contains("middleware"), "middleware"), (text.contains("config") | text.contains("module.exports"), "config"), (text.contains("fetch") | text.contains("href="), "service"), default="utility")


def importance(text: Column) -> Column:
    """Substring complexity: weighted occurrences of tokens."""
    return F.round(0.1 * occurrences(text, "<div") + 0.2 * occurrences(text, "<script") + 0.05 * occurrences(text, "href="), 6)


def url_check(urls: DataFrame, column: str = "url", schemes=("https", "http", "git", "ssh")) -> DataFrame:
    """scheme, host, reason (first failing rule) and valid."""
    u = F.trim(F.col(column))
    out = urls.withColumn("scheme", F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))).withColumn("host", F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    reason = first_of((u == "", "empty"), (F.length(u) > 2048, "too long"), (contains_any(F.lower(u), *BAD_URL), "malicious"), (~F.col("scheme").isin(*schemes), "scheme"), (F.col("host") == "", "host"))
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def redacted(url: Column) -> Column:
    """User part of a URL and values of secret parameters replaced."""
    out = F.regexp_replace(url, r"://[^/@]*@", "://***@")
    return F.regexp_replace(out, r"(token|key|password|secret)=[^&#]*", "$1=***")


def network_policy(urls: DataFrame, allowed_hosts: tuple[str, ...] = (), blocked_suffixes: tuple[str, ...] = (".local", ".internal"), column: str = "url") -> DataFrame:
    """First failing rule of an ordered chain, else allowed."""
    out = url_check(urls, column).drop("reason", "valid")
    private = F.regexp_like(F.col("host"), F.lit(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)"))
    blocked = F.lit(False)
    for s in blocked_suffixes:
        blocked = blocked | F.col("host").endswith(s)
    rules = [(F.col("scheme") == "", "no scheme"), (private, "private address"), (blocked, "blocked host"), (F.col("scheme") != "https", "not https")]
    if allowed_hosts:
        rules.append((~F.col("host").isin(*allowed_hosts), "not listed"))
    return out.withColumn("decision", first_of(*rules, default="allowed"))


def bracket_balance(texts: DataFrame, column: str, opening: str = "<", closing: str = ">") -> DataFrame:
    """Count of each bracket and the lowest running balance, by a fold over the brackets of a text."""
    marks = F.regexp_extract_all(F.col(column), F.lit(f"([{opening}{closing}])"), F.lit(1))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("least"))
    def step(acc, m):
        now = acc["now"] + F.when(m == opening, 1).otherwise(-1)
        return F.struct(now.alias("now"), F.least(acc["least"], now).alias("least"))
    out = texts.withColumn("b", F.aggregate(marks, zero, step))
    return out.select("*", F.size(marks).cast("long").alias("n_brackets"), F.col("b.now").cast("long").alias("balance"), F.col("b.least").cast("long").alias("lowest")).drop("b", column)


def bare(text: Column) -> Column:
    """A text without comments (`//` to the end of the line, then `/* */`), blanks made one and trimmed."""
    out = F.regexp_replace(text, r"//[^\n]*", "")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(out, r"[ \t\n\f\r]+", " "))


def tokenised(text: Column) -> Column:
    """bare() with identifiers, then quoted strings, then numbers replaced by the name of their kind."""
    out = F.regexp_replace(bare(text), r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*", "IDENTIFIER")
    out = F.regexp_replace(out, "[\"'][^\"']*[\"']", "STRING_LITERAL")
    return F.regexp_replace(out, r"(?<![A-Za-z0-9_])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])", "NUMBER_LITERAL")


def token_count(text: Column) -> Column:
    """Tokens of bare(); 0 for null, empty and mere comments."""
    return F.when(F.coalesce(bare(text), F.lit("")) == "", 0).otherwise(F.size(F.split(bare(text), " "))).cast("long")


def endpoints(texts: DataFrame, column: str) -> DataFrame:
    """The other columns, kind (url, endpoint), value, n: addresses with a scheme anywhere in a text, and quoted paths of href, src and action; equal ones of a text count together. Null texts have none."""
    named = lambda kind, pattern, group: F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    keys = [c for c in texts.columns if c != column]
    return texts.select(*keys, F.explode(F.concat(named("url", URL, 0), named("endpoint", PATH, 1))).alias("x")).groupBy(*keys, "x.kind", "x.value").agg(F.count("*").alias("n"))


def primary_pattern(scores: DataFrame, key: str) -> DataFrame:
    """key, pattern, tenths, n_patterns, clarity of pattern_scores(): the one with most tenths (the first by name of equal ones); one pattern is clear, two are mixed, more are unclear."""
    out = scores.groupBy(key).agg(F.min_by("pattern", F.struct(-F.col("tenths"), F.col("pattern"))).alias("pattern"), F.max("tenths").alias("tenths"), F.count("*").alias("n_patterns"))
    return out.withColumn("clarity", first_of((F.col("n_patterns") == 1, "clear"), (F.col("n_patterns") == 2, "mixed"), default="unclear"))
