"""Language identification by a convolutional network over bytes.

Texts are cut into windows of WINDOW bytes. Filters of several widths run over the embedded bytes,
the maximum over each window is taken, and a softmax gives the languages. As embedding and filter
are linear, each filter is a sum of table entries, one for each pair of bytes; so a window costs a
few table look-ups for each byte. All windows of a text are scored, and their log-probabilities are
averaged. Training is plain numpy (Adam) on windows of a bounded sample of labelled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.llm.labelled import bucket, sample

#: Labelled texts to learn from, windows of each, bytes of a window.
LABELLED, EACH, WINDOW = 2_000, 3, 128
WIDTHS, FILTERS, EMBED, EPOCHS, BATCH, RATE = (2, 3, 4), 8, 8, 6, 64, 0.01
FOLDS, HELD = 5, 0
PART = 1 << 16


class Net:
    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 1):
        """x: windows (uint8), y: index of the language."""
        self.names = names
        rng = np.random.default_rng(seed)
        f = FILTERS * len(WIDTHS)
        p = {"e": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(f), "o": rng.normal(0, 0.2, (f, max(1, len(names)))), "c": np.zeros(max(1, len(names)))}
        p |= {f"w{k}": rng.normal(0, (k * EMBED) ** -0.5, (k, EMBED, FILTERS)) for k in WIDTHS}
        self.p = p
        m, v, t = ({k: np.zeros_like(a) for k, a in p.items()} for _ in "mv"), None, 0
        m, v = m
        for _ in range(EPOCHS if len(names) > 1 else 0):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                g = self._gradient(x[order[a : a + BATCH]], y[order[a : a + BATCH]])
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        self._compile()

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, where = [], []
        for k in WIDTHS:
            span = x.shape[1] - k + 1
            conv = sum(e[:, j : j + span] @ p[f"w{k}"][j] for j in range(k))
            at = conv.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
        z = np.hstack(pooled) + p["b"]
        h = np.maximum(z, 0)
        logit = h @ p["o"] + p["c"]
        q = np.exp(logit - logit.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        dz = (q @ p["o"].T) * (z > 0)
        g = {"o": h.T @ q, "c": q.sum(0), "b": dz.sum(0), "e": np.zeros_like(p["e"])}
        for i, k in enumerate(WIDTHS):
            d, at, rows = dz[:, i * FILTERS : (i + 1) * FILTERS], where[i], np.arange(n)[:, None]
            g[f"w{k}"] = np.zeros_like(p[f"w{k}"])
            for j in range(k):
                byte = x[rows, at + j]
                g[f"w{k}"][j] = np.einsum("nfe,nf->ef", p["e"][byte], d)
                np.add.at(g["e"], byte, d[:, :, None] * p[f"w{k}"][j].T[None])
        return g

    def _compile(self) -> None:
        """Tables over pairs of bytes, in single precision; 65,536 x FILTERS entries each."""
        single = lambda k, j: (self.p["e"] @ self.p[f"w{k}"][j]).astype(np.float32)
        self.tables = {}
        for k in WIDTHS:
            for j in range(0, k - 1, 2):
                self.tables[k, j] = (single(k, j)[:, None] + single(k, j + 1)[None]).reshape(65536, FILTERS)
            if k % 2:
                self.tables[k, k - 1] = single(k, k - 1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows (uint8, any number of rows)."""
        out = []
        for a in range(0, len(x), PART // WINDOW):
            part = np.ascontiguousarray(x[a : a + PART // WINDOW].T).astype(np.int64)  # bytes of a window run down
            pair = part[:-1] * 256 + part[1:]
            pooled = []
            for k in WIDTHS:
                span = len(part) - k + 1
                conv = None
                for (width, j), table in self.tables.items():
                    if width == k:
                        add = np.take(table, (pair if len(table) > 256 else part)[j : j + span], axis=0, mode="clip")
                        conv = add if conv is None else np.add(conv, add, out=conv)
                pooled.append(conv.max(0))
            h = np.maximum(np.hstack(pooled) + self.p["b"], 0)
            logit = h @ self.p["o"] + self.p["c"]
            logit -= logit.max(1, keepdims=True)
            out.append(logit - np.log(np.exp(logit).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.p["c"])))


def windows_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, and the offsets of each text's windows. A text's last window ends with its last byte and overlaps the one before; shorter texts are filled up with spaces."""
    low = K.LOWER[buf]
    length = np.diff(offs)
    count = -(-length // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(length)), count)
    start = (np.arange(first[-1]) - first[doc]) * WINDOW
    start = np.maximum(np.minimum(start, length[doc] - WINDOW), 0) + offs[doc]
    padded = np.concatenate([low, np.full(WINDOW, 32, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start]
    for i in np.flatnonzero(length[doc] < WINDOW).tolist():
        x[i, length[doc[i]] :] = 32
    return x, first


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    low = K.LOWER[buf]
    out = K.sums((low >= 97) & (low <= 122), offs) > 0
    for d in np.flatnonzero(~out & (np.diff(offs) > 0)).tolist():
        out[d] = any(c.isalpha() for c in buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def fit(docs: DataFrame, limit: int = LABELLED) -> Net:
    """From text and non-null lang of the documents outside the held-out fold."""
    t = sample(docs, docs, "lang", limit, bucket("doc_id", FOLDS) != HELD)
    names = sorted(set(t.column("label").to_pylist()))
    y = np.array([names.index(v) for v in t.column("label").to_pylist()], np.int64)
    rng = np.random.default_rng(3)
    xs, ys, done = [np.zeros((0, WINDOW), np.uint8)], [np.zeros(0, np.int64)], 0
    for buf, offs in K.sliced(t):
        x, first = windows_of(buf, offs)
        for d in np.flatnonzero(has_letter(buf, offs)).tolist():
            at = rng.choice(np.arange(first[d], first[d + 1]), min(EACH, first[d + 1] - first[d]), replace=False)
            xs.append(x[at])
            ys.append(np.full(len(at), y[done + d]))
        done += len(offs) - 1
    return Net(np.concatenate(xs), np.concatenate(ys), names)


def identified(docs: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    Null texts and texts without a letter are `und` with score 0, and so are all if no text has a
    lang to learn from. held_out of a null doc_id is null. Repeated rows are identified each. Of equal
    probabilities the first language by name counts. Long texts take time in proportion. Other columns
    are not looked at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, limit))

    def make():
        net = shared.value

        def kernel(buf, offs, part):
            ok = has_letter(buf, offs) & bool(net.names)
            x, first = windows_of(buf, offs)
            logp = net.log_probabilities(x)
            mean = np.column_stack([K.sums(np.ascontiguousarray(c), first) for c in logp.T]) / np.maximum(np.diff(first), 1)[:, None]
            best = mean.argmax(1)
            p = np.exp(mean)
            score = np.where(ok, p[np.arange(len(p)), best] / p.sum(1), 0.0)
            return {"doc_id": part.column("doc_id"), "lang_pred": pa.array([net.names[b] if k else "und" for b, k in zip(best.tolist(), ok.tolist())]), "score": np.clip(score, 0, 1)}

        return kernel

    out = K.map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (bucket("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
