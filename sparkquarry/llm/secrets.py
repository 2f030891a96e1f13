"""Secret scans: patterns, and guess cost of values in credential context.

A value that follows a credential word is cut into words, dates, repeats, keyboard walks and
brute-force stretches so that an attacker's guesses for all of them are fewest (dynamic programming
over the value's positions, costs in decimal logarithms). A value that still costs THRESHOLD or more
is a secret; weak ones, such as a plain word, are not. After a mere blank or `is`, where prose goes on as
often as a value follows, a single word in ordinary spelling is taken for prose, whatever its cost.

Words have ranks: COMMON first, then the RANKS most frequent words of all texts, counted over the
whole table (values in credential context are left out, so that no secret makes itself a word).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.llm.spans import detect, digest
from sparkquarry.store import Shelf

KINDS = ("assign", "access", "hex")
#: Log10 of the guesses that make a value a secret.
THRESHOLD = 8.0
#: Words that are ranked at most, how often they occur at least, their longest, and distinct words that a task holds.
RANKS, LEAST, LONGEST, HELD = 50_000, 3, 24, 200_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|(?:access|auth|bearer|api|session)?[_\x20-]?token|(?:api|access|private|secret|signing)[_\x20-]?key|credentials?|authorization|bearer)["']?(?:[\x20\t]*+([:=]{1,2}>?)[\x20\t]*+|[\x20\t]*+\bis\b[\x20\t]*+|[\x20\t]++)["'`]?([^\x00-\x20"'`<>,;]{6,})""", re.I | re.A)
_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"authorization", b"bearer")

# Frequent words in passwords, most frequent first, and keyboard rows.
COMMON = "password the and for you love admin welcome login master dragon monkey letmein sunshine princess football shadow secret token test user guest hello world summer winter spring autumn access private public server client default change example sample demo root mysql oracle money happy house music baby angel star super power magic freedom family flower computer internet google apple company office manager london paris berlin madrid monday friday january december bearer basic digest credential credentials authorization passphrase passcode".split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "0987654321", "poiuytrewq", "lkjhgfdsa", "mnbvcxz", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")
_LEET = str.maketrans("@4310$5!7", "aaeiossit")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def ranked(words=()) -> dict[str, int]:
    """Ranks of COMMON and then of words, from 1."""
    return {w: k + 1 for k, w in enumerate(dict.fromkeys([*COMMON, *words]))}


_RANK = ranked()


def _alphabet(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isalpha() and c.isascii() else log10(33) if c.isascii() else 2.0


def segmentation(value: str, ranks: dict[str, int] = _RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """Log10 of the guesses, and the (kind, start, end) segments of the cheapest cut.

    brute costs each character's alphabet; a word its rank, doubled for capitals or look-alike
    digits; a date 365 days in 100 years; a repeat its unit times its count; a walk its start, row
    and length. Each segment after the first doubles the guesses. Time and memory are linear in the
    length of the value.
    """
    n = len(value)
    low = value.lower()
    plain = low.translate(_LEET)
    ways: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]  # by end: start, cost, kind
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                if form in ranks:
                    ways[j].append((i, log10(ranks[form] + 1) + extra + (0.3 if value[i:j] != low[i:j] else 0.0), "word"))
                    break
        if m := _DATE.match(value, i):
            ways[m.end()].append((i, log10(36500) if m.end() - i > 4 else 2.0, "date"))
        for row in ROWS:
            j, at = i + 1, row.find(low[i])
            while at >= 0 and j < n and at + j - i < len(row) and row[at + j - i] == low[j]:
                j += 1
            if at >= 0 and j - i >= 3:
                for e in range(i + 3, j + 1):
                    ways[e].append((i, log10(47 * len(ROWS) * (e - i)), "walk"))
    for unit in range(1, min(8, n // 2) + 1):
        more = [0] * (n + 1)  # further copies of the unit at i that follow it
        for i in range(n - 2 * unit, -1, -1):
            if value[i : i + unit] == value[i + unit : i + 2 * unit]:
                more[i] = more[i + unit] + 1
        for i in range(n - 2 * unit + 1):
            j = i + unit * (more[i] + 1)
            if j - i >= max(3, 2 * unit):
                ways[j].append((i, sum(map(_alphabet, value[i : i + unit])) + log10(more[i] + 1), "repeat"))
    cost, back = [0.0] + [float("inf")] * n, [(0, "")] * (n + 1)
    run, begin = float("inf"), 0  # the cheapest cut that ends with a brute-force stretch, and where that begins
    for j in range(1, n + 1):
        if (fresh := cost[j - 1] + (log10(2) if j > 1 else 0.0)) < run:
            run, begin = fresh, j - 1
        run += _alphabet(value[j - 1])
        cost[j], back[j] = run, (begin, "brute")
        for i, c, kind in ways[j]:
            if (c := cost[i] + c + (log10(2) if i else 0.0)) < cost[j]:
                cost[j], back[j] = c, (i, kind)
    out, j = [], n
    while j:
        i, kind = back[j]
        out.append((kind, i, j))
        j = i
    return cost[n], out[::-1]


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    return segmentation(value, ranks)[0]


_JOINT = re.compile(r"[-'’/.]")


def looks_plain(value: str) -> bool:
    """A word in ordinary spelling (lower case, capitalised or all capitals), or two of them joined."""
    parts = _JOINT.split(value)
    return len(parts) <= 2 and all(not p or p.isalpha() and (p[1:].islower() or len(p) == 1 or p.isupper()) for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def spans(text: str, ranks: dict[str, int] = _RANK) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, from the base patterns) by start, then kind as listed. A value that a base span touches is not added. Linear in the text but for sorting."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    by_start = sorted((s, e) for _, s, e in base)
    starts, ends = [s for s, _ in by_start], list(accumulate((e for _, e in by_start), max))
    at = 0
    while m := _CONTEXT.search(text, at):
        value, start = m[2].rstrip(".:!?)]}"), m.start(2)
        end = start + len(value)
        at = m.end()
        before = bisect_left(starts, end)  # base spans that begin before the value ends; does one end after its start?
        if len(value) >= 6 and (m[1] or not looks_plain(value)) and not (before and ends[before - 1] > start) and guess_cost(value, ranks) >= THRESHOLD:
            out.append(("credential", start, end, False))
        elif len(m[2]) <= LONGEST:
            at = start  # the value may itself be a credential word: "authorization: bearer ..."
    order = {k: i for i, k in enumerate((*KINDS, "credential"))}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


_HEXBYTE = np.zeros(256, bool)
_HEXBYTE[list(b"0123456789abcdef")] = True


def anchors(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts with a credential word, AKIA or 24 hexadecimal digits in a row; no others can hold a span."""
    hit = np.zeros(len(offs) - 1, bool)
    at = []
    for data, words in ((K.LOWER[buf].tobytes(), _WORDS), (buf.tobytes(), (b"AKIA",))):
        for word in words:
            p = data.find(word)
            while p >= 0:
                at.append(p)
                p = data.find(word, p + 1)
    m = _HEXBYTE[buf]
    for step in (1, 2, 4, 8, 8):  # runs of 2, 4, 8, 16, 24
        m = m[: max(0, len(m) - step)] & m[step:] if len(m) > step else m[:0]
    at = np.concatenate([np.array(at, np.int64), np.flatnonzero(m)])
    hit[np.searchsorted(offs, at, "right") - 1] = True
    return hit


_LETTERS = K.table([b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122)])
_CONTEXT_BYTES = re.compile(_CONTEXT.pattern.encode(), re.I)


def _counted(batches):
    """Words and how often they occur in the texts of a task; a task holds HELD distinct words at most and hands them on beyond that."""
    held: dict[bytes, int] = {}

    def flush():
        rows = list(held.items())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    for batch in batches:
        for part in K.slices(batch, "text"):
            buf, offs = K.flat(part.column("text"))
            buf = K.LOWER[buf]
            for d in np.flatnonzero(anchors(buf, offs)).tolist():
                for m in _CONTEXT_BYTES.finditer(buf[offs[d] : offs[d + 1]].tobytes()):
                    buf[offs[d] + m.start(2) : offs[d] + m.end(2)] = 32
            w = K.tokenize(buf, offs, _LETTERS, lower=False)
            size = w.e - w.s
            use = np.flatnonzero((size >= 3) & (size <= LONGEST))
            _, at, count = np.unique(w.h[use], return_index=True, return_counts=True)
            data = buf.tobytes()
            for s, e, n in zip(w.s[use[at]].tolist(), w.e[use[at]].tolist(), count.tolist()):
                word = data[s:e]
                held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield flush()
    if held:
        yield flush()


def common_words(docs: DataFrame, limit: int = RANKS) -> list[str]:
    """The most frequent words (3 to LONGEST letters A-Z, lower-cased, LEAST occurrences) of all texts, the most frequent first; ties by spelling.

    Counts are combined in each task before they are dealt by word. How many words have which count
    (in steps of a sixteenth of a power of e, so some hundred rows) tells the least count that gives
    limit words at most; only those go to the driver.
    """
    K.bound_batches(docs.sparkSession)
    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counted, "word string, n long")
    shelf = Shelf(docs.sparkSession, "words")
    counts = shelf.put("counts", counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).withColumn("step", F.floor(16 * F.log("n"))))
    total, least = 0, None
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > limit:
            break
        least = r.step
    top = [] if least is None else counts.filter(F.col("step") >= least).collect()
    shelf.drop("counts")
    return [r.word for r in sorted(top, key=lambda r: (-r.n, r.word))]


def secrets(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id, spans for each row of docs; words: ranked words (None: those of docs).

    Null and empty texts have none. Repeated rows are scanned each, and count each for the words.
    Long texts take time in proportion. Ties between cuts of a value have one cost. Columns other
    than doc_id and text are not looked at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranked(common_words(docs) if words is None else words))
    return detect(docs, lambda: (anchors, lambda texts: [spans(t, shared.value) for t in texts]))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS)
