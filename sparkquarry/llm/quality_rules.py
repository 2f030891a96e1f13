"""Quality rules: statistics of each text and a learned decision list over them.

The list is learned by sequential covering from labelled statistics: a rule for bad texts is grown
on two thirds of the examples, one threshold condition after another, by information gain; then its
last conditions are dropped while that does not worsen it on the other third; then the texts that
it covers leave. Learning ends when a rule is not precise enough. The list is emitted as an ordered
Spark CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.llm.labelled import sample

#: Labelled texts to learn from, at most (those of the smallest hashes of doc_id).
LABELLED = 4_000
MAX_RULES, MAX_CONDITIONS, THRESHOLDS, PRECISION = 12, 4, 24, 0.97

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_bytes", "n_letters")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?{}[]\\^~=_")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_LINE = K.table([0x0A])
#: Ratios that conditions may test: name, numerator, denominator.
RATIOS = (("symbols_per_char", "n_symbols", "word_chars"), ("mean_word", "word_chars", "n_words"), ("dup_line_share", "n_dup_lines", "n_lines"), ("repeat_share", "n_repeat_words", "n_words"), ("upper_share", "n_upper", "n_letters"), ("marks_per_word", "n_marks", "n_words"), ("letter_share", "n_letters", "n_bytes"))
FEATURES = ("n_words", *(r[0] for r in RATIOS))


def statistics(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text. A line is a \\n-split part with a word; bytes, not code points, are counted by n_upper, n_marks, n_letters, n_bytes."""
    w = K.tokenize(buf, offs, K.BLANK_WORDS, lower=False)
    n_docs = len(w.counts)
    inside = K.BLANK_WORDS[buf]
    counted = inside & ((buf & 0xC0) != 0x80)
    lines = K.tokenize(buf, offs, _LINE, lower=False)
    full = np.searchsorted(w.s, lines.e) > np.searchsorted(w.s, lines.s)
    doc = lines.doc[full]
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    h = lines.h[full]
    K.sort_within(h, first)
    dup = np.zeros(len(h), bool)
    dup[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    win, at = K.windows(w, 5)
    wdoc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    wfirst = np.searchsorted(wdoc, np.arange(n_docs + 1))
    ordered = win.copy()
    K.sort_within(ordered, wfirst)
    twice = np.zeros(len(win), bool)
    same = (ordered[1:] == ordered[:-1]) & (wdoc[1:] == wdoc[:-1])
    for d in np.unique(wdoc[1:][same]).tolist():
        a, b = wfirst[d], wfirst[d + 1]
        twice[a:b] = np.isin(win[a:b], ordered[a + 1 : b][same[a : b - 1]])
    edge = np.zeros(len(w.h) + 1, np.int64)
    starts = at[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + 5, -1)
    return {
        "n_words": w.counts, "word_chars": K.sums(counted, offs), "n_symbols": K.sums(_SYMBOLS[buf], offs), "n_dup_lines": K.sums(dup, first), "n_repeat_words": K.sums(np.cumsum(edge[:-1]) > 0, w.first),
        "n_lines": np.diff(first), "n_upper": K.sums(_UPPER[buf], offs), "n_marks": K.sums(_MARKS[buf], offs), "n_bytes": np.diff(offs), "n_letters": K.sums(_LETTERS[buf], offs),
    }


def sample_statistics(t) -> dict[str, np.ndarray]:
    parts = [statistics(*x) for x in K.sliced(t)]
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    ratio = lambda a, b: stats[a] / np.maximum(stats[b], 1)
    return np.column_stack([stats["n_words"], *(ratio(a, b) for _, a, b in RATIOS)]).astype(float)


def base_failed(n_words, n_repeat):
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        v = of[FEATURES[self.feature]]
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
        if not p0 or not n0:
            break
        base, best, gain = log2(p0 / (p0 + n0)), None, 1e-9
        for f in range(x.shape[1]):
            v = x[live, f]
            for t in np.unique(np.quantile(v[bad[live]], np.linspace(0, 1, THRESHOLDS))):
                for above in (False, True):
                    t_ = float(np.nextafter(t, -np.inf)) if above else float(t)
                    on = v > t_ if above else v <= t_
                    p, n = int((on & bad[live]).sum()), int((on & ~bad[live]).sum())
                    if p and (g := p * (log2(p / (p + n)) - base)) > gain:
                        best, gain = Condition(f, above, t_), g
        if best is None:
            break
        rule.append(best)
        live &= best.holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    on = covers(rule, x)
    p, n = int((on & bad).sum()), int((on & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Ordered rules for bad texts. None where the examples are of one kind only."""
    third = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < MAX_RULES and bad[left & ~third].any():
        rule = _grow(x[left & ~third], bad[left & ~third])
        px, pbad = x[left & third], bad[left & third]
        while len(rule) > 1 and _worth(rule[:-1], px, pbad) >= _worth(rule, px, pbad):
            rule = rule[:-1]
        on = covers(rule, x) & left
        if not rule or not on.any() or bad[on].mean() < PRECISION or bad[on].sum() < 3:
            break
        rules.append(rule)
        left &= ~on
    return rules


def ratio_columns(stat: Column) -> dict[str, Column]:
    """The features as expressions over a struct of COUNTS."""
    out = {"n_words": stat["n_words"].cast("double")}
    for name, a, b in RATIOS:
        out[name] = stat[a].cast("double") / F.greatest(stat[b], F.lit(1)).cast("double")
    return out


def verdict(rules: list[Rule], stat: Column) -> Column:
    """CASE WHEN rule THEN false ... ELSE true END, in the order learned."""
    of = ratio_columns(stat)
    out = F.lit(True)
    for rule in reversed(rules):
        condition = rule[0].column(of)
        for c in rule[1:]:
            condition = condition & c.column(of)
        out = F.when(condition, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> list[Rule]:
    """From labels.quality (0: bad) of a bounded sample; texts that fail the base rules are not examples."""
    t = sample(docs, labels, "quality", limit)
    if not t.num_rows:
        return []
    stats = sample_statistics(t)
    use = ~base_failed(stats["n_words"], stats["n_repeat_words"])
    return learn(features(stats)[use], (t.column("label").to_numpy() == 0)[use])


_DDL = ", ".join(f"{c} long" for c in COUNTS)


def _with_statistics(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns keep of docs and a struct of COUNTS under a name that docs does not have."""
    import pyarrow as pa
    from pyspark.sql.types import StructField, StructType

    text = docs["text"]
    name, inner = K.free_name(docs, "quality_stats"), K.free_name(docs, "quality_text")
    rows = docs.select(*[docs[c] for c in keep], F.coalesce(text, F.lit("")).alias(inner))

    def make():
        def kernel(buf, offs, part):
            stats = statistics(buf, offs)
            return {c: part.column(c) for c in keep} | {name: pa.StructArray.from_arrays([pa.array(stats[c].astype(np.int64)) for c in COUNTS], list(COUNTS))}

        return kernel

    schema = StructType([*docs.select(*keep).schema.fields, StructField(name, StructType.fromDDL(_DDL))])
    return K.map_text(rows, make, schema, text=inner), name


def judged(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs.

    Null and empty texts have no words, so they fail the base rules. Repeated rows are judged each,
    ties alike. Long texts take time in proportion (but for sorting). Without labels only the base
    rules judge. Other columns of docs are not looked at, whatever their names. An empty table gives
    an empty result.
    """
    rows, name = _with_statistics(docs, ["doc_id"])
    stat = F.col(name)
    failed = base_failed(stat["n_words"], stat["n_repeat_words"])
    return rows.select("doc_id", *(stat[c].alias(c) for c in COUNTS[:5]), failed.alias("base_failed"), (~failed & verdict(fit(docs, labels, limit), stat)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Null and empty texts have no words, so they fail the base rules and go. Repeated rows are judged
    each and stay or go together; long texts are judged whole, in time in proportion; documents
    without a label, or without a doc_id, are judged like others. Columns may have any other names,
    those of the statistics too. An empty table gives an empty result.
    """
    rows, name = _with_statistics(docs, docs.columns)
    stat = F.col(name)
    return rows.filter(~base_failed(stat["n_words"], stat["n_repeat_words"]) & verdict(fit(docs, labels, limit), stat)).drop(name)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The base columns in SQL (kept comes from the learned list and has no SQL form).
BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM lines GROUP BY ALL) GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed
FROM t LEFT JOIN dup ON dup.doc_id = t.doc_id LEFT JOIN rep ON rep.doc_id = t.doc_id
"""

