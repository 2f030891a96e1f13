"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The network reads windows of WINDOW characters and tags each character as outside or as begin or
inside of a span; transition scores between tags are learned with it, and the Viterbi path is taken.
Windows are laid over the whole of every text and overlap by OVERLAP characters; where two disagree,
the tag counts that is further from its window's edge, and spans are read from the reconciled tags of
the whole text. Spans that the patterns miss (written-out mail addresses, with or without digits,
phone numbers without `+`) are added if their form is sound; pattern spans always stay.

Windows whose best path weighs as much as the one that is outside all along are not traced back, as
that one is their path.

Training is plain numpy, from labelled spans: sentences made up by labelled_text(), or any given
list of (text, spans). The weights are stored beside this module; another trained Tagger can be handed
in instead.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.spans import detect, digest

KINDS = ("email", "ip", "card", "phone")
WINDOW, OVERLAP = 384, 48
#: Characters of a training example; windows that are decoded at once.
EXAMPLE, AT_ONCE = 64, 4096
EMBED, HIDDEN, BATCH, STEPS, RATE = 12, 8, 64, 4000, 0.02
CHARS = {c: i + 2 for i, c in enumerate(map(chr, range(32, 127)))}  # 0: beyond the text, 1: any other
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2 k, 2 + 2 k: begin, inside of kind k

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = r"(?: {0,2}(?:@|\(at\)|\[at\]) {0,2}| {1,2}at {1,2})"
_DOT = r"(?: {0,2}(?:\.|\(dot\)|\[dot\]) {0,2}| {1,2}dot {1,2})"
_NAME_DOT = r"(?: {0,2}(?:\(dot\)|\[dot\]) {0,2}| {1,2}dot {1,2})"
_HOST = rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
_AT = re.compile(rf"[A-Za-z0-9._%+-]++(?:{_NAME_DOT}[A-Za-z0-9._%+-]++)*+{_SIGN}{_HOST}\Z", re.I | re.A)
_WRITTEN = re.compile(rf"{_SIGN}(?={_HOST})", re.I | re.A)
_WRITTEN_HOST = re.compile(_HOST, re.I | re.A)
_BEFORE = re.compile(rf"{_NAME_DOT}\Z", re.I | re.A)
_SENTENCE = re.compile(r"\. ")
_GROUPED = re.compile(r"(?:\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,4}){2,4}|0[0-9]{9,10}|[2-9][0-9]{9})\Z")
#: A plain `at` before a host with plain full stops: what prose says of any host ("hosted at github.com"), unless the part before it has the marks of an address.
_PROSE_HOST = re.compile(r"([A-Za-z0-9._%+-]+) {1,2}at {1,2}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z", re.I | re.A)
_MARKED = re.compile(r"[A-Za-z0-9][._%+-][A-Za-z0-9]|[A-Za-z][0-9]", re.A)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start. Linear in the text: the part before an @ is looked up backwards from it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append(("email", i, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def sound(kind: str, s: str) -> bool:
    """The check of an added span."""
    d = _digits(s)
    if kind == "email":
        # Without digit or @, a full stop and a blank end a sentence: "look at home. Then" is no address.
        if (m := _PROSE_HOST.match(s)) and not _MARKED.search(m[1]):
            return False
        return bool(_AT.match(s)) and bool(d or "@" in s or not _SENTENCE.search(s))
    if kind == "ip":
        return (m := _IP.fullmatch(s)) is not None and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(_GROUPED.match(s))


def written(text: str) -> list[tuple[int, int]]:
    """Passages with the form of an address, as long as they can be: all that sound() could take for a written-out one lies in them."""
    out = []
    for m in _WRITTEN.finditer(text):
        i = start = m.start()
        while True:
            while i > 0 and text[i - 1] in _LOCAL:
                i -= 1
            if i == start:
                break  # nothing before the sign or the dot
            start = i
            if not (dot := _BEFORE.search(text, max(0, i - 9), i)):
                break
            i = start = dot.start()
        if i < m.start():
            out.append((i, _WRITTEN_HOST.match(text, m.end()).end()))
    return out


#: Letters of made-up prose, as often as they shall occur.
_PROSE = "eeeeettttaaaaooooiiiinnnnssshhhrrrddllluuccmmffwwyyppvbbggkkxqjzéèàçêüñóäößíá"


def labelled_text(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up sentence and its spans (kind, start, end)."""
    pick = lambda *a: a[rng.integers(len(a))]

    def word() -> str:
        w = "".join([_PROSE[i] for i in rng.integers(0, len(_PROSE), rng.integers(1, 13)).tolist()])
        return w.capitalize() if (r := rng.random()) < 0.12 else w.upper() if r < 0.16 else w

    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    out, spans, n = "", [], rng.integers(6, 16)
    for _ in range(n):
        r = rng.random()
        if r < 0.16:
            kind = int(rng.integers(len(KINDS)))
            if kind == 0:
                out += pick("", "", "mail ", "mail me: ", "contact ", "write to ", "or ")
                plain = lambda: word().encode("ascii", "ignore").decode() or "a"
                digits, dot = rng.random() < 0.5, pick(".", " dot ", " dot ", " (dot) ", "(dot)", " [dot] ", "[dot]")
                name = plain() + pick("", ".", "_", dot) + plain() + (pick("", num(2)) if digits else "")
                host = [pick("mail", "web", "box", "post") + (num(1) if digits else ""), plain(), pick("com", "org", "net", "example", "edu", "de", "io", "fr")][rng.integers(2) :]
                s = name.replace(dot, ".") + "@" + ".".join(host) if rng.random() < 0.5 else name + pick(" at ", " at ", " (at) ", "(at)", "[at]", " [at] ") + dot.join(host)
                s = s.encode("ascii", "ignore").decode()
            elif kind == 1:
                s = ".".join(str(x) for x in rng.integers(0, 256, 4))
            elif kind == 2:
                body = pick("4", "5", "37") + num(14)
                body = body[:15]
                body += next(c for c in "0123456789" if luhn(body + c))
                s = body if rng.random() < 0.6 else pick(" ", "-").join(body[i : i + 4] for i in range(0, 16, 4))
            else:
                a, b, c = num(3), num(3), num(4)
                trunk = pick("0", "0", "2", "4", "7") + num(9)
                s = pick(f"+{num(1)} ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a} {b} {c}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)} {b} {a}", trunk, trunk)
                if s == trunk:  # digits in one run are a phone after a word that says so
                    out += pick("call", "phone", "tel", "tel.", "mobile", "fax", "Phone:", "ring", "number is", "Tel:", "text") + " "
            spans.append((kind, len(out), len(out) + len(s)))
            out += s
        elif r < 0.24:
            out += pick(num(1), num(2), str(1900 + rng.integers(130)), "$" + num(3), num(2) + "." + num(1), "version " + num(1) + "." + num(1), num(6), "AKIA" + num(6), "".join(rng.choice(list("0123456789abcdef"), rng.integers(12, 30))), num(2) + ":" + num(2), num(20), pick("order", "id", "no.", "item", "ref", "total") + " " + num(10), num(4) + " " + num(4), num(3) + " " + word() + " " + num(4), str(1900 + rng.integers(130)) + " " + str(1900 + rng.integers(130)))
        elif r < 0.32:
            out += pick("at", "dot", "at " + word() + ". " + word(), word() + " at " + word() + ".", "at the " + word(), "a " + word() + " dot on", pick("us", "more", "it", "hosted", "look", word()) + " at " + pick("", "", "www.", "news.", "shop.") + (word().encode("ascii", "ignore").decode() or "a").lower() + pick(".com", ".org", ".co.uk", ".net", ".example.com"), pick("contact", "mail", "write to", "mail me:") + " " + word())
        else:
            out += word()
        out += pick(" ", " ", " ", " ", " ", ", ", ". ", "\n", "!! ", "### ", "; ")
    return out, spans


_CODE = np.array([CHARS.get(chr(c), 1) for c in range(128)], np.int16)


def coded(text: str) -> np.ndarray:
    """The character codes of a text, one for each code point."""
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 127)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _squash(z: np.ndarray) -> None:
    """1 / (1 + exp(z)), in place."""
    np.exp(z, out=z)
    z += 1
    np.reciprocal(z, out=z)


class Tagger:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        p = {"emb": rng.normal(0, 0.3, (len(CHARS) + 2, e)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "trans": rng.normal(0, 0.05, (TAGS, TAGS))}
        for d in "fb":
            p |= {f"x{d}": rng.normal(0, e**-0.5, (e, 4 * h)), f"h{d}": rng.normal(0, h**-0.5, (h, 4 * h)), f"g{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _run(self, d: str, x: np.ndarray, keep: bool):
        """Hidden states (time, batch, h) of one direction; x: embedded characters, time first, already reversed for the backward one."""
        w, u, b, h = self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"g{d}"], HIDDEN
        pre = x @ w + b
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        out, tape = np.empty((*x.shape[:2], h), np.float32), []
        for t in range(len(x)):
            z = pre[t] + state @ u
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, old = cell, state
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[t] = state
            if keep:
                tape.append((i, f, o, g, before, tc, old))
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        e = self.p["emb"][x.T]
        hf, tf = self._run("f", e, keep)
        hb, tb = self._run("b", e[::-1], keep)
        h = np.concatenate([hf, hb[::-1]], 2)
        return h @ self.p["out"] + self.p["bias"], (e, h, tf, tb)

    def _back(self, d: str, x: np.ndarray, dh: np.ndarray, tape: list, g: dict):
        w, u, h = self.p[f"x{d}"], self.p[f"h{d}"], HIDDEN
        dx = np.empty_like(x)
        ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, c, before, tc, old = tape[t]
            ds = ds + dh[t]
            dc = dc + ds * o * (1 - tc * tc)
            dz = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - c * c)], 1)
            g[f"x{d}"] += x[t].T @ dz
            g[f"h{d}"] += old.T @ dz
            g[f"g{d}"] += dz.sum(0)
            dx[t] = dz @ w.T
            ds, dc = dz @ u.T, dc * f
        return dx

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Of the mean negative log-likelihood of the tag paths y (batch, time)."""
        em, (e, h, tf, tb) = self.emissions(x, True)
        steps, n, a = *em.shape[:2], self.p["trans"]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0]
        for t in range(1, steps):
            alpha[t] = em[t] + _logsumexp(alpha[t - 1][:, :, None] + a, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(a + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        d = np.exp(alpha + beta - z[:, None])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        yt, rows = y.T, np.arange(n)
        gold = sum(em[t, rows, yt[t]].sum() for t in range(steps))
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + a + (em[t] + beta[t])[:, None, :] - z[:, None, None])
            g["trans"] += pair.sum(0)
            np.add.at(g["trans"], (yt[t - 1], yt[t]), -1)
            gold += a[yt[t - 1], yt[t]].sum()
        for t in range(steps):
            d[t, rows, yt[t]] -= 1
        g["out"] = np.einsum("tnh,tnk->hk", h, d)
        g["bias"] = d.sum((0, 1))
        dh = d @ self.p["out"].T
        de = self._back("f", e, dh[:, :, :HIDDEN], tf, g) + self._back("b", e[::-1], dh[::-1, :, HIDDEN:], tb, g)[::-1]
        np.add.at(g["emb"], x.T, de)
        return float((z.sum() - gold) / n), {k: v / n for k, v in g.items()}

    def train(self, examples, steps: int = STEPS) -> "Tagger":
        """examples: function that gives the next (text, spans)."""
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in "mv")
        for t in range(1, steps + 1):
            x, y = np.zeros((BATCH, EXAMPLE), np.int16), np.zeros((BATCH, EXAMPLE), np.int64)
            for r in range(BATCH):
                text, spans = examples()
                tags = np.zeros(len(text), np.int64)
                for kind, s, e in spans:
                    tags[s:e] = 2 + 2 * kind
                    tags[s] = 1 + 2 * kind
                # Windows begin anywhere, before the text too, but not inside a span.
                at = (7919 * (t * BATCH + r)) % max(1, len(text) - EXAMPLE // 2)
                at = next((s for _, s, e in spans if s < at < e), at)
                part = coded(text)[at : at + EXAMPLE]
                x[r, : len(part)], y[r, : len(part)] = part, tags[at : at + EXAMPLE]
            _, g = self.gradient(x, y)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k in self.p:
                d = g[k] * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emissions (time, tag, window) of windows (window, time): what emissions() gives, by look-up tables and over whole batches."""
        p, h, (n, steps) = self.p, HIDDEN, x.shape
        # sigmoid(z) = 1 / (1 + exp(-z)) and tanh(z) = 2 sigmoid(2 z) - 1: the factors inside are in the weights, as numpy's exp is many times faster than its tanh.
        inside = np.concatenate([np.full(3 * h, -1.0), np.full(h, -2.0)])
        gates = lambda w: np.ascontiguousarray(np.split((w * inside).astype(np.float32), 4, axis=-1))
        em = np.empty((steps, TAGS, n), np.float32)
        em[:] = p["bias"].astype(np.float32)[:, None]
        at = np.ascontiguousarray(x.T).astype(np.intp)
        for k, d in enumerate("fb"):
            table, out = gates(p["emb"] @ p[f"x{d}"] + p[f"g{d}"]), np.ascontiguousarray(p["out"][k * h : k * h + h].T.astype(np.float32))
            u = gates(p[f"h{d}"])
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            z, more = np.empty((4, n, h), np.float32), np.empty((4, n, h), np.float32)
            with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0, as it should be
                for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                    for g in range(4):
                        np.take(table[g], at[t], axis=0, out=z[g], mode="clip")
                        np.matmul(state, u[g], out=more[g])
                    z += more
                    _squash(z)
                    z[3] *= 2
                    z[3] -= 1
                    cell *= z[1]
                    np.multiply(z[0], z[3], out=state)
                    cell += state
                    np.multiply(cell, -2, out=state)
                    _squash(state)
                    state *= 2
                    state -= 1
                    state *= z[2]
                    em[t] += out @ state.T
        return em

    def tags(self, x: np.ndarray) -> np.ndarray:
        """The Viterbi paths of windows (window, time)."""
        best, a = self.scores(x), self.p["trans"].astype(np.float32)  # emissions turn into the weights of the best paths
        steps, _, n = best.shape
        outside = best[0, 0].copy()
        more, top = np.empty((TAGS, n), np.float32), np.empty((TAGS, n), np.float32)
        entered = np.zeros((steps, n), bool)  # outside, after a span
        for t in range(1, steps):
            outside = best[t, 0] + (outside + a[0, 0])
            np.add(best[t - 1, 0], a[0, :, None], out=top)
            stay = top[0].copy()
            for i in range(1, TAGS):
                np.add(best[t - 1, i], a[i, :, None], out=more)
                np.maximum(top, more, out=top)
            np.greater(top[0], stay, out=entered[t])
            best[t] += top
        out = np.zeros((steps, n), np.int8)
        inside = best[-1].max(0) > outside
        tag = np.where(inside, best[-1].argmax(0), 0)
        for t in range(steps - 1, -1, -1):
            out[t] = tag
            if t:
                # From outside the path mostly goes on outside: only the others need a look at all tags.
                at = np.flatnonzero(((tag != 0) | entered[t]) & inside)
                tag[at] = (best[t - 1][:, at] + a[:, tag[at]]).argmax(0)
        return np.ascontiguousarray(out.T)


def train_anew(seed: int = 11, steps: int = STEPS) -> Tagger:
    rng = np.random.default_rng(seed)
    return Tagger(seed).train(lambda: labelled_text(rng), steps)


#: What train_anew() gave, some 2,700 numbers; `python -m sparkquarry.llm.pii` writes it.
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


#: How much more easily a span of an address begins than training alone would have it: the check of its form comes after, so a miss costs more than a false start.
LEAN = 2.0


@lru_cache(1)
def trained() -> Tagger:
    """The tagger with the stored weights and LEAN."""
    tagger = Tagger()
    with np.load(WEIGHTS) as stored:
        tagger.p = {k: stored[k] for k in tagger.p}
    tagger.p["trans"][0, 1] += LEAN
    tagger.p["bias"][1:3] += LEAN / 4
    return tagger


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first character of each window."""
    step = WINDOW - OVERLAP
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // step)), 0)
    text = np.repeat(np.arange(len(lengths)), count)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step


def find(texts: list[str], tagger: Tagger, at_once: int = AT_ONCE):
    """The reconciled spans (kind, start, end) of each text."""
    codes = [coded(t) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([*codes, np.zeros(WINDOW, np.int16)])
    text, start = windows(lengths)
    paths: dict[int, np.ndarray] = {}
    for k in range(0, len(text), at_once):
        of, begin = text[k : k + at_once], start[k : k + at_once]
        x = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[first[of] + begin].copy()
        for r in np.flatnonzero(begin + WINDOW > lengths[of]).tolist():
            x[r, lengths[of[r]] - begin[r] :] = 0
        path = tagger.tags(x)
        paths.update((k + r, path[r]) for r in np.flatnonzero(path.any(1)).tolist())
    tags: dict[int, np.ndarray] = {}
    for k, path in sorted(paths.items()):
        d, s = int(text[k]), int(start[k])
        whole = tags.setdefault(d, np.zeros(lengths[d], np.int8))
        # Each character belongs to the window whose edge is further away; a text's own ends are no edges.
        lo = 0 if s == 0 else OVERLAP // 2
        hi = lengths[d] - s if s + WINDOW >= lengths[d] else WINDOW - OVERLAP + OVERLAP // 2
        whole[s + lo : s + hi] = path[lo:hi]
    for d in range(len(texts)):
        if d not in tags:
            yield []
            continue
        at = np.flatnonzero(tags[d])
        tag = tags[d][at]
        kind = (tag - 1) // 2
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)])[: len(at)])
        ends = at[np.append(begin[1:], len(at)) - 1] + 1 if len(at) else at
        yield [(KINDS[k], s, e) for k, s, e in zip(kind[begin].tolist(), at[begin].tolist(), ends.tolist())]


def fitted(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """A tagged address begins where the passage of its form does and ends in it at a whole word; the tagger's own bounds may take in words before and after."""
    if not any(kind == "email" for kind, _, _ in found):
        return found
    passages, out, k = written(text), [], 0  # both by start
    for kind, s, e in found:
        while k < len(passages) and passages[k][1] <= s:
            k += 1
        near, i = [], k
        while kind == "email" and i < len(passages) and passages[i][0] < e:
            near.append(passages[i])
            i += 1
        for a, b in near:
            end = min(e, b)
            while end < b and text[end].isalnum():
                end += 1
            part = text[a:end]
            if not _digits(part) and "@" not in part and (stop := _SENTENCE.search(part)):
                end = a + stop.start()
            out.append((kind, a, end))
        if not near:
            out.append((kind, s, e))
    return out


class Taken:
    """Spans that touch no other, by bisection."""

    def __init__(self, spans):
        self.at: list[tuple[int, int]] = []
        for s, e in sorted(spans):  # base spans of different kinds may overlap: kept as their union
            if self.at and s < self.at[-1][1]:
                self.at[-1] = (self.at[-1][0], max(e, self.at[-1][1]))
            else:
                self.at.append((s, e))

    def add(self, s: int, e: int) -> bool:
        i = bisect_left(self.at, (s, e))
        if i and self.at[i - 1][1] > s or i < len(self.at) and self.at[i][0] < e:
            return False
        self.at.insert(i, (s, e))
        return True


def spans(texts: list[str], tagger: Tagger):
    """All spans (kind, start, end, from the patterns) of each text, by kind as listed, then start. An added span touches no other."""
    for text, found in zip(texts, find(texts, tagger)):
        base = base_spans(text)
        out = [(*s, True) for s in base]
        taken = Taken((s, e) for _, s, e in base)
        for kind, s, e in fitted(text, found):
            while s < e and text[s] in " .,;:\n":
                s += 1
            while s < e and text[e - 1] in " .,;:\n":
                e -= 1
            whole = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
            if whole and e > s and sound(kind, text[s:e]) and taken.add(s, e):
                out.append((kind, s, e, False))
        yield sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def anchors(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """All texts that are not empty."""
    return np.diff(offs) > 0


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, spans for each row of docs.

    Null and empty texts have none. Repeated rows are searched each. Long texts take time in
    proportion. Of added spans that overlap, the first counts. Columns other than doc_id and text are
    not looked at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    return detect(docs, lambda: (anchors, lambda texts: spans(texts, shared.value)))


def masked(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with all spans of text replaced by [KIND] (spans that meet become one, named after the first); n_chars, where docs has it, is the new length. Null texts stay null.

    Empty texts stay empty; repeated rows are masked alike; long texts are read in windows, all of
    them, in time in proportion. Other columns stay as they are, whatever their names. An empty table
    gives an empty result.
    """
    import pyarrow as pa

    from sparkquarry.llm.kernels import map_text

    shared, columns = docs.sparkSession.sparkContext.broadcast(tagger or trained()), docs.columns

    def make():
        def kernel(buf, offs, part):
            texts = part.column("text").to_pylist()
            at = np.flatnonzero(anchors(buf, offs)).tolist()
            for d, found in zip(at, spans([texts[d] for d in at], shared.value)):
                text, out, done = texts[d], [], 0
                joined: list[list] = []
                for kind, s, e, _ in sorted(found, key=lambda x: (x[1], x[2])):
                    if joined and s < joined[-1][2]:
                        joined[-1][2] = max(e, joined[-1][2])
                    else:
                        joined.append([kind, s, e])
                for kind, s, e in joined:
                    out += [text[done:s], f"[{kind.upper()}]"]
                    done = e
                texts[d] = "".join([*out, text[done:]])
            return {c: part.column(c) for c in columns} | {"text": pa.array(texts, pa.string())}

        return kernel

    out = map_text(docs, make, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return digest(personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS)


if __name__ == "__main__":
    np.savez(WEIGHTS, **train_anew().p)
