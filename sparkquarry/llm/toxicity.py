"""Toxic passages by maximum-scoring segment search.

A word's score is its log-odds between toxic and other labelled texts (those that hold it) under a Dirichlet prior, where
that is significant, less a small constant, so that scores drift down in ordinary text. One linear
scan finds all maximal scoring segments of a text. The distribution of the best segment of a random
text of n words is an extreme-value one, 1 - exp(-K n exp(-lambda S)); lambda solves
sum p exp(lambda s) = 1 over the words of the other texts, and K is the likeliest value for the best
segments of other texts. The significances of a text's segments are added up, and a one-variable
logistic fit turns the sum into a score.

K and the logistic fit see no text by a table that was learned from it: the sample is halved, and
the texts of each half are scored by the log-odds of the other half. The final table is of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.llm.labelled import bucket, sample

#: Labelled texts to learn from; words in the table at most.
LABELLED, VOCABULARY = 6_000, 50_000
FOLDS, HELD = 5, 0
PRIOR, PRIOR_TOTAL, Z, DRIFT, LEAST = 0.5, 500.0, 2.6, 0.1, 1.0
#: A segment counts as a passage at this chance in a random text, at most.
SIGNIFICANT = 0.01


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in linear time: candidates are kept on a stack and merged where a later one ends higher."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    positive = np.flatnonzero(score > 0)
    stack: list[list] = []  # first, end, sum before, sum after, index of the last one that begins lower
    for i in positive.tolist():
        first, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([first, end, left, right, j])
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in stack]


def _part(w: K.Words, docs: np.ndarray) -> K.Words:
    """The words of some documents."""
    at = np.concatenate([np.arange(w.first[d], w.first[d + 1]) for d in docs.tolist()] or [np.zeros(0, np.int64)])
    return K.Words(w.h[at], None, None, np.concatenate([[0], np.cumsum(w.counts[docs])]))


class Model:
    def __init__(self, w: K.Words, toxic: np.ndarray, calibrate: bool = True):
        self.background, self.k = -DRIFT, 1.0
        self.keys, self.values, self.lam = np.zeros(0, np.uint64), np.zeros(0), 1.0
        self.a, self.b = 0.0, 3.0 if len(toxic) and toxic.all() else -3.0
        if toxic.any() and not toxic.all() and len(w.h):
            self._learn(w, toxic)
            if calibrate:
                self._calibrate(w, toxic)

    def _learn(self, w: K.Words, toxic: np.ndarray) -> None:
        """The table of word scores, and lambda."""
        keys, inverse = np.unique(w.h, return_inverse=True)
        once = np.unique(w.doc * len(keys) + inverse)  # a word counts once for each text
        label, word = toxic[once // len(keys)], once % len(keys)
        y1 = np.bincount(word, label, len(keys))
        y0 = np.bincount(word, ~label, len(keys))
        prior = PRIOR + PRIOR_TOTAL * (y1 + y0) / (y1 + y0).sum()
        n1, n0 = (y.sum() + prior.sum() for y in (y1, y0))
        odds = lambda y, n: np.log((y + prior) / (n - y - prior))
        delta = odds(y1, n1) - odds(y0, n0)
        z = delta / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        use = ((z > Z) & (delta > LEAST)) | (z < -Z)
        if use.sum() > VOCABULARY:
            use &= np.abs(z) >= np.sort(np.abs(z[use]))[-VOCABULARY]
        self.keys, self.values = keys[use], delta[use] - DRIFT
        s = np.full(len(keys), self.background)
        s[use] = self.values
        p = (y0 + PRIOR / len(keys)) / (y0 + PRIOR / len(keys)).sum()
        self.lam = self._root(p, s)

    def best(self, w: K.Words) -> np.ndarray:
        """The best segment's score of each text; 0 where none is positive."""
        out, s = np.zeros(len(w.counts)), self.word_scores(w)
        for d in np.flatnonzero(K.sums(s > 0, w.first)).tolist():
            total = np.concatenate([[0.0], np.cumsum(s[w.first[d] : w.first[d + 1]])])
            out[d] = (total - np.minimum.accumulate(total)).max()
        return out

    def _calibrate(self, w: K.Words, toxic: np.ndarray) -> None:
        """K and the logistic fit, of each half by the table of the other."""
        half = np.arange(len(toxic)) % 2 == 0
        parts = [(Model(_part(w, np.flatnonzero(~on)), toxic[~on], calibrate=False), np.flatnonzero(on)) for on in (half, ~half)]
        if not all(len(m.keys) for m, _ in parts):
            parts = [(self, np.arange(len(toxic)))]
        exposed = n = 0.0
        for m, docs in parts:
            of = _part(w, docs[~toxic[docs]])
            exposed += float((of.counts * np.exp(-m.lam * m.best(of))).sum())
            n += int((of.counts > 0).sum())
        # Chance of a best segment of at most x: exp(-K n exp(-lambda x)); likelihood is largest at this K.
        self.k = n / exposed if exposed > 0 else 1.0
        strength = np.zeros(len(toxic))
        for m, docs in parts:
            m.k = self.k
            strength[docs] = m.strengths(_part(w, docs))
        self.a, self.b = self._logistic(np.log1p(strength), toxic)

    @staticmethod
    def _root(p: np.ndarray, s: np.ndarray) -> float:
        lo, hi = 1e-3, 1.0
        with np.errstate(over="ignore"):
            while (p * np.exp(hi * s)).sum() < 1 and hi < 64:
                hi *= 2
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if (p * np.exp(mid * s)).sum() > 1 else (mid, hi)
        return hi

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, -1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            r, v = p - y, np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
            step = np.linalg.solve(h, [(r * x).sum() + 1e-2 * a, r.sum()])
            a, b = a - step[0], b - step[1]
        return float(a), float(b)

    def word_scores(self, w: K.Words) -> np.ndarray:
        out = np.full(len(w.h), self.background)
        if len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, w.h), len(self.keys) - 1)
            on = self.keys[k] == w.h
            out[on] = self.values[k[on]]
        return out

    def passages(self, w: K.Words):
        """(text, [(first word, end word, score, -log chance)]) of the texts that have segments."""
        s = self.word_scores(w)
        counts = K.sums(s > 0, w.first)
        for d in np.flatnonzero(counts).tolist():
            a, b = w.first[d], w.first[d + 1]
            out = []
            for i, j, score in segments(s[a:b]):
                log_e = np.log(self.k * (b - a)) - self.lam * score
                chance = -np.expm1(-np.exp(min(log_e, 50.0))) if log_e > -30 else np.exp(log_e)
                out.append((i, j, score, -float(np.log(max(chance, 1e-300)))))
            yield d, out

    def strengths(self, w: K.Words) -> np.ndarray:
        out = np.zeros(len(w.counts))
        for d, found in self.passages(w):
            out[d] = sum(x[3] for x in found if x[3] > 0.05)
        return out

    def score(self, strength: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * np.log1p(strength) + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """From labels.toxic of the rows outside the held-out fold."""
    t = sample(docs, labels, "toxic", limit, bucket("doc_id", FOLDS) != HELD)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for buf, offs in K.sliced(t):
        w = K.tokenize(buf, offs, K.ALNUM_WORDS)
        hashes.append(w.h)
        counts.append(w.counts)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return Model(K.Words(np.concatenate(hashes), None, None, first), t.column("label").to_numpy() == 1)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, strength, passages array<struct<start, end, score, log_chance>> (UTF-8 byte offsets) for each row of docs.

    Null and empty texts have no passages and strength 0. Repeated rows are searched each. Long texts
    take time in proportion. Columns other than doc_id and text are not looked at. An empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def kernel(buf, offs, part):
            w = K.tokenize(buf, offs, K.ALNUM_WORDS)
            strength, spans = np.zeros(len(offs) - 1), [[] for _ in offs[1:]]
            for d, found in m.passages(w):
                a = w.first[d]
                strength[d] = sum(x[3] for x in found if x[3] > 0.05)
                spans[d] = [{"start": int(w.s[a + i] - offs[d]), "end": int(w.e[a + j - 1] - offs[d]), "score": s, "log_chance": c} for i, j, s, c in found if c >= -np.log(SIGNIFICANT)]
            return {"doc_id": part.column("doc_id"), "strength": strength, "passages": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_chance", pa.float64())])))}

        return kernel

    return K.map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, strength double, passages array<struct<start: long, end: long, score: double, log_chance: double>>")


def scored(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages for each row of docs.

    Null texts count as empty and get the score of a text without passages. held_out of a null
    doc_id is null. Without labels of both kinds all texts get one score. Equal texts get equal
    scores, so repeated rows do; of segments of one sum the first counts. Long texts are scanned
    whole, in linear time. Columns other than doc_id and text are not looked at. An empty table gives
    an empty result.
    """
    model = fit(docs, labels, limit)
    score = 1 / (1 + F.exp(-(F.lit(model.a) * F.log1p("strength") + F.lit(model.b))))
    out = passages(docs, model).withColumn("score", score)
    return out.select("doc_id", (bucket("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
