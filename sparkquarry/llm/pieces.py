"""SentencePiece encoding and decoding by a max-plus scan.

A sequence of pieces is the model's own BPE segmentation of its text exactly if every two neighbours
are compatible, that is, if merging their joined text gives back these two pieces: as no merge ever
crosses a border of the result, each pair is merged as it would be alone. So the segmentation is the
one path of weight 0 in a max-plus lattice whose states are pieces and whose steps weigh 0 between
compatible pieces and minus infinity otherwise. A prefix of a text has one such path, so one piece
per position is remembered.

Texts of more than CHUNK characters are split into chunks of CHUNK characters that are rows of their
own; cuts fall where they fall, inside words too. A boundary state is a piece that covers the
boundary; each chunk yields the max-plus matrix from the states at its begin to those at its end.
The matrices of a document are multiplied as a tree, FAN neighbours at a time in tasks of their own
(the product is associative), up to one matrix for the document; then, downwards, the states at the
ends of each product fix those between its factors, and each chunk is traced back by itself.

No piece holds a space after another character, so the lattice has a single state before each space.
A chunk's matrix is thus the product of the one of its first, cut word, a column, and of the one of
its last, cut word, a row; words between are solved once (depth first, as there is only one path) for
each Python worker and remembered (MEMO words at most). A chunk without a space is swept whole.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.kernels import bound_batches, free_name, map_text
from sparkquarry.store import Shelf

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, SNAP, FAN, MEMO, LONG_WORD = 32_768, 0, 32, 150_000, 48
MARK = "▁"


def read_model(path: str = MODEL) -> dict:
    """Pieces of a BPE model with byte fallback, on the driver; executors get them by broadcast (tens of thousands of short strings)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {"pieces": [sp.id_to_piece(i) for i in ids], "scores": [sp.get_score(i) for i in ids], "normal": normal, "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}}


class Lattice:
    """Encoder of one Python worker."""

    def __init__(self, model: dict):
        pieces, scores = model["pieces"], model["scores"]
        self.id = {pieces[i]: i for i in model["normal"]}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.byte = model["bytes"]
        self.longest = max(map(len, self.id), default=1)
        self.space_safe = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.line_safe = not any("\n" in p for p in self.id)
        self.trie: dict = {}  # by character: [deeper level, the piece that ends here or None]
        for p in self.id:
            node = [self.trie, None]
            for c in p:
                node = node[0].setdefault(c, [{}, None])
            node[1] = p
        self.fits: dict[str | None, dict[str, bool]] = {}
        self.known = 0
        self.with_mark: dict[str, bytes] = _Memo(lambda w: self._solve(MARK + w))
        self.plain: dict[str, bytes] = _Memo(self._solve)
        self.out = [bytes([int(p[3:5], 16)]) if i in set(self.byte.values()) else p.encode() for i, p in enumerate(pieces)]
        self._ids: dict[str, bytes] = {}

    def merged(self, s: str) -> list[str]:
        """The model's segmentation of a short string, by its definition: the best-scored adjacent pair is merged first, the leftmost of equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str | None, b: str) -> bool:
        """Whether b may follow a (None: whether b may begin a text)."""
        after = self.fits.get(a)
        if after is None:
            after = self.fits[a] = {}
        known = after.get(b)
        if known is None:
            self.known += 1
            if self.known > 2 * MEMO:
                self.fits.clear()
                self.known = 0
                after = self.fits[a] = {}
            known = after[b] = self.merged(b) == [b] if a is None else self.merged(a + b) == [a, b]
        return known

    def pieces_at(self, s: str, i: int) -> list[str]:
        """The pieces that begin at i, shortest first; the character itself always counts."""
        level, out = self.trie, []
        for c in s[i : i + self.longest]:
            node = level.get(c)
            if node is None:
                break
            level, piece = node
            if piece is not None:
                out.append(piece)
        if not out or len(out[0]) > 1:
            out.insert(0, s[i])
        return out

    def forward(self, s: str, begin: int, last: str | None, end: int) -> list[str | None]:
        """For each position after begin, the piece that ends there on the path of weight 0; None: no path. Pieces begin before end and may end after it."""
        compatible, fits, n = self.compatible, self.fits, len(s)
        ending: list[str | None] = [None] * (n + 1)
        for i in range(begin, end):
            before = last if i == begin else ending[i]
            if before is None and i != begin:
                continue
            after = fits.get(before) or {}
            for t in self.pieces_at(s, i):
                j = i + len(t)
                if ending[j] is None:
                    ok = after.get(t)
                    if compatible(before, t) if ok is None else ok:
                        ending[j] = t
        return ending

    def path(self, s: str) -> list[str]:
        """The path of weight 0 through all of s, searched depth first, longest pieces first. One such path at most leads to a position, so a position that failed is not tried again."""
        compatible, fits, n = self.compatible, self.fits, len(s)
        out: list[str] = []
        at, left, dead = [0], [self.pieces_at(s, 0)], set()
        while True:
            before, i, more = out[-1] if out else None, at[-1], left[-1]
            after = fits.get(before) or {}
            while more:
                t = more.pop()
                j = i + len(t)
                if j not in dead:
                    ok = after.get(t)
                    if compatible(before, t) if ok is None else ok:
                        break
            else:
                dead.add(i)
                at.pop()
                left.pop()
                out.pop()
                continue
            out.append(t)
            if j == n:
                return out
            at.append(j)
            left.append(self.pieces_at(s, j))

    def _coded(self, piece: str) -> bytes:
        known = self._ids.get(piece)
        if known is None:
            i = self.id.get(piece)
            known = np.array([i] if i is not None else [self.byte[b] for b in piece.encode()], np.int32).tobytes()
            if len(self._ids) < MEMO:
                self._ids[piece] = known
        return known

    def trace(self, ending: list, begin: int, end: int) -> bytes:
        out = []
        while end > begin:
            out.append(self._coded(ending[end]))
            end -= len(ending[end])
        out.reverse()
        return b"".join(out)

    def _solve(self, s: str) -> bytes:
        return b"".join(map(self._coded, self.path(s))) if s else b""

    def encode(self, text: str, first: bool = True) -> bytes:
        """Ids (int32) of a text, or of a chunk of one between two safe cuts."""
        if not text:
            return b""
        if not self.space_safe:
            return self._solve((MARK if first else "") + text.replace(" ", MARK))
        if MARK in text:
            text = text.replace(MARK, " ")
        if first:
            text = " " + text
        out = []
        lines = text.split("\n") if self.line_safe else [text]
        newline = self._coded("\n") if self.line_safe else b""
        for k, line in enumerate(lines):
            if k:
                out.append(newline)
            if "  " in line:
                for unit in re.findall(" *[^ ]+| +", line):
                    out.append(self.plain[unit.replace(" ", MARK)])
            else:
                words = line.split(" ")
                if words[0]:
                    out.append(self.plain[words[0]])
                del words[0]
                out += map(self.with_mark.__getitem__, words)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        return b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")[1:]

    def covering(self, s: str, at: int) -> list[tuple[int, int]]:
        """The states at a boundary: pieces (start, end) with start < at <= end."""
        return [(i, j) for i in range(max(0, at - self.longest), at) for j in range(at, min(len(s), i + self.longest) + 1) if s[i:j] in self.id or j == i + 1]

    def sweep(self, s: str, enter: list[tuple[int, int]], stop: int) -> list[dict]:
        """For each position the pieces that end there on a path of weight 0, with the set (as bits) of the states enter that such paths come from. Pieces begin before stop."""
        compatible, fits = self.compatible, self.fits
        at: list[dict] = [{} for _ in range(len(s) + 1)]
        for r, (i, j) in enumerate(enter):
            key = s[i:j] if j > i else None
            at[j][key] = at[j].get(key, 0) | 1 << r
        for p in range(min((j for _, j in enter), default=stop), stop):
            if not at[p]:
                continue
            pieces = self.pieces_at(s, p)
            for before, bits in at[p].items():
                after = fits.get(before) or {}
                for t in pieces:
                    ok = after.get(t)
                    if compatible(before, t) if ok is None else ok:
                        to = at[p + len(t)]
                        to[t] = to.get(t, 0) | bits
        return at

    def breaks(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last space in s[lo:hi] that follows another character, where the lattice has one state; None: there is none."""
        if not self.space_safe:
            return None
        first, last = s.find(MARK, lo + 1, hi), s.rfind(MARK, lo + 1, hi)
        while first > 0 and s[first - 1] == MARK:
            first = s.find(MARK, first + 1, hi)
        while last > lo and s[last - 1] == MARK:
            last = s.rfind(MARK, lo + 1, last)
        return (first, last) if lo < first <= last else None

    def matrix(self, s: str, lo: int, hi: int, open_lo: bool, open_hi: bool) -> tuple[list, list, list]:
        """States at lo and hi, and the entries of weight 0 of the matrix between them, as (row, column)."""
        enter = self.covering(s, lo) if open_lo else [(lo, lo)]
        leave = self.covering(s, hi) if open_hi else [(hi, hi)]
        through, inner = [], []
        for r, (i, j) in enumerate(enter):
            (through if j > hi or j == hi and open_hi and lo != hi else inner).append(r)
        entries = [(r, c) for r in through for c, x in enumerate(leave) if x == enter[r]]  # one piece covers both boundaries
        starts = [enter[r] for r in inner]
        if inner and (cut := self.breaks(s, lo, hi)):
            at = self.sweep(s[: cut[0]], starts, cut[0])
            begin = 0
            for bits in at[cut[0]].values():
                begin |= bits
            at = self.sweep(s, [(cut[1], cut[1])], hi)
            ends = [c for c, (a, b) in enumerate(leave) if (s[a:b] in at[b] and a >= cut[1] if open_hi else at[b])]
            return enter, leave, entries + [(r, c) for k, r in enumerate(inner) if begin >> k & 1 for c in ends]
        at = self.sweep(s, starts, hi)
        for c, (a, b) in enumerate(leave):
            bits = at[b].get(s[a:b], 0) if open_hi else 0
            if not open_hi:
                for more in at[b].values():
                    bits |= more
            entries += [(r, c) for k, r in enumerate(inner) if bits >> k & 1]
        return enter, leave, entries

    def between(self, s: str, enter: tuple[int, int], leave: tuple[int, int], lo: int, hi: int) -> bytes:
        """Ids of the one path from the end of the piece enter to the end of the piece leave."""
        (i, j), (a, b) = enter, leave
        last = s[i:j] if j > i else None
        cut = self.breaks(s, lo, hi)
        if cut is None or cut[0] < j or cut[1] > b:
            return self.trace(self.forward(s, j, last, hi), j, b)
        f, g = cut
        head = self.trace(self.forward(s[:f], j, last, f), j, f)
        return head + self.encode(s[f:g].replace(MARK, " "), first=False) + self.trace(self.forward(s, g, None, hi), g, b)


class _Memo(dict):
    """Two generations of MEMO words each at most; words used again move to the young one."""

    def __init__(self, solve):
        self.solve, self.old = solve, {}

    def __missing__(self, word):
        if len(word) > LONG_WORD:
            return self.solve(word)
        out = self.old.get(word)
        if out is None:
            out = self.solve(word)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


_worker: dict[str, Lattice] = {}


def _lattice(shared) -> Lattice:
    """One for each Python worker and model; what it remembers serves later tasks too."""
    key, model = shared.value
    if key not in _worker:
        _worker.clear()
        _worker[key] = Lattice(model)
    return _worker[key]


def _share(spark, path: str):
    model = read_model(path)
    return spark.sparkContext.broadcast((hashlib.sha256(repr(model).encode()).hexdigest(), model))


def marks_of(text: str) -> list[int]:
    """Where the text itself has the mark that stands for a space in pieces."""
    return [m.start() for m in re.finditer(MARK, text)] if MARK in text else []


def restored(text: str, marks) -> str:
    if not len(marks):
        return text
    chars = list(text)
    for i in marks:
        chars[i] = MARK
    return "".join(chars)


def _ids(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def split(text: str, lattice: Lattice, chunk: int, snap: int) -> list[tuple[int, int, bool, bool]]:
    """(begin, end, open at begin, open at end) of each chunk: cut after chunk characters, or before a space in the last snap of them."""
    out, lo, open_lo = [], 0, False
    while lo < len(text):
        hi = lo + chunk
        if hi >= len(text):
            out.append((lo, len(text), open_lo, False))
            break
        cut, open_hi = hi, True
        if snap and lattice.space_safe:
            p = text.rfind(" ", max(lo + 1, hi - snap), hi)
            while p > lo and text[p - 1] in f" {MARK}":
                p -= 1
            if p > lo and p >= hi - snap:
                cut, open_hi = p, False
        out.append((lo, cut, open_lo, open_hi))
        lo, open_lo = cut, open_hi
    return out


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, snap: int = SNAP, keep: list[str] | None = None, check: str | None = None, shelf: Shelf | None = None) -> DataFrame:
    """The columns keep of docs (default: doc_id), piece_ids array<int>, mark_positions array<int>, equal to the model's own encoding.

    Null texts give null arrays, empty ones empty arrays. mark_positions says where the text itself
    has U+2581, which the model can't tell from a space. snap: a chunk's cut is moved before a space
    in its last snap characters (off by default). With check, a column of that name says
    whether decoding the ids gives the text back; null texts do. Rows are encoded each, repeated or
    not, by one path (there are no ties). Other columns may have any names. An empty table gives an
    empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = _share(docs.sparkSession, model)
    text = free_name(docs, "piece_text")
    rows = docs.select(*[docs[c] for c in keep], docs["text"].alias(text))
    ids, marks = free_name(rows, "piece_ids"), free_name(rows, "mark_positions")
    giant = F.length(text) > chunk
    fields = rows.drop(text).withColumn(ids, F.lit(None).cast("array<int>")).withColumn(marks, F.lit(None).cast("array<int>")).schema

    def whole():
        lattice = _lattice(shared)

        def kernel(buf, offs, part):
            texts = part.column(text).to_pylist()
            parts = [lattice.encode(t or "") for t in texts]
            null = pa.array([t is None for t in texts])
            arrays = _ids(parts), pa.array([marks_of(t or "") for t in texts], pa.list_(pa.int32()))
            if part.column(text).null_count:
                import pyarrow.compute as pc

                arrays = [pc.if_else(null, pa.scalar(None, pa.list_(pa.int32())), a) for a in arrays]
            out = {c: part.column(c) for c in keep} | {ids: arrays[0], marks: arrays[1]}
            if check:
                out[check] = [restored(lattice.decode(np.frombuffer(p, np.int32)), marks_of(t or "")) == (t or "") for t, p in zip(texts, parts)]
            return out

        return kernel

    if check:
        fields = rows.drop(text).withColumn(ids, F.lit(None).cast("array<int>")).withColumn(marks, F.lit(None).cast("array<int>")).withColumn(check, F.lit(None).cast("boolean")).schema
    short = map_text(rows.filter(~F.coalesce(giant, F.lit(False))), whole, fields, text=text)
    long = rows.filter(giant)
    shelf = shelf or Shelf(docs.sparkSession, "pieces")
    row, k = free_name(rows, "row_key"), "k"
    long = shelf.put("giants", long.withColumn(row, F.expr("uuid()")))
    if long.isEmpty():
        return short

    def cut():
        lattice = _lattice(shared)

        def kernel(buf, offs, part):
            out = []
            for key, t in zip(part.column(row).to_pylist(), part.column(text).to_pylist()):
                full = MARK + t.replace(" ", MARK)
                pad = lattice.longest
                for n, (lo, hi, open_lo, open_hi) in enumerate(split(t, lattice, chunk, snap)):
                    a, b = (lo + 1 if lo else 0), hi + 1  # in full, which has the mark in front
                    left, right = (max(0, a - pad) if open_lo else a), (min(len(full), b + pad) if open_hi else b)
                    out.append((key, n, full[left:right], a - left, b - left, open_lo, open_hi))
            return dict(zip(("row", "k", "piece", "lo", "hi", "open_lo", "open_hi"), map(list, zip(*out)))) if out else None

        return kernel

    chunks = shelf.put("chunks", map_text(long.select(row, text), cut, "row string, k long, piece string, lo int, hi int, open_lo boolean, open_hi boolean", text=text))
    dealt = chunks.repartition("row", "k")

    def matrices():
        lattice = _lattice(shared)

        def kernel(buf, offs, part):
            rows_ = part.to_pylist()
            found = [lattice.matrix(r["piece"], r["lo"], r["hi"], r["open_lo"], r["open_hi"]) if r["open_lo"] or r["open_hi"] else ([(r["lo"], r["lo"])], [(r["hi"], r["hi"])], [(0, 0)]) for r in rows_]
            pairs = lambda x, r: [[a - r["lo"], b - r["lo"]] for a, b in x]
            return {"row": part.column("row"), "k": part.column("k"), "enter": [pairs(f[0], r) for f, r in zip(found, rows_)], "leave": [[[a - r["hi"], b - r["hi"]] for a, b in f[1]] for f, r in zip(found, rows_)], "entries": [[list(e) for e in f[2]] for f in found]}

        return kernel

    per_chunk = shelf.put("matrices_0", map_text(dealt, matrices, MATRIX, text="piece"))
    chosen = _scan(per_chunk, shelf)

    def backtrace():
        lattice = _lattice(shared)

        def kernel(buf, offs, part):
            parts = []
            for r in part.to_pylist():
                s, lo, hi = r["piece"], r["lo"], r["hi"]
                enter, leave = tuple(x + lo for x in r["enter"]), tuple(x + hi for x in r["leave"])
                same = enter == leave and r["open_lo"] and r["open_hi"]  # one piece covers the chunk
                parts.append(b"" if same else lattice.between(s, enter, leave, lo, hi))
            return {"row": part.column("row"), "k": part.column("k"), "ids": _ids(parts)}

        return kernel

    traced = map_text(chunks.join(chosen, ["row", "k"]), backtrace, "row string, k long, ids array<int>", text="piece")
    joined = traced.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias(ids)).withColumnRenamed("row", row)

    def mark():
        def kernel(buf, offs, part):
            return {c: part.column(c) for c in [*keep, row]} | {marks: pa.array([marks_of(t) for t in part.column(text).to_pylist()], pa.list_(pa.int32()))}

        return kernel

    with_marks = map_text(long, mark, long.drop(text).withColumn(marks, F.lit(None).cast("array<int>")).schema, text=text)
    done = with_marks.join(joined, row)
    if check:
        again = decode(done.select(row, ids, marks), model, ids, marks, "again").select(row, F.xxhash64("again").alias("h"))
        done = done.join(again, row).join(long.select(row, F.xxhash64(text).alias("own")), row).withColumn(check, F.col("h") == F.col("own"))
    return short.unionByName(done.select(*short.columns))


MATRIX = "row string, k long, enter array<array<int>>, leave array<array<int>>, entries array<array<int>>"
STATES = "row string, k long, enter array<int>, leave array<int>"


def product(a: dict, b: dict) -> dict:
    """The max-plus product of two neighbours; entries of weight 0 only. A state is a piece's offsets from the boundary."""
    row = {tuple(x): n for n, x in enumerate(b["enter"])}
    after: dict[int, list[int]] = {}
    for i, j in b["entries"]:
        after.setdefault(i, []).append(j)
    entries = {(i, k) for i, j in a["entries"] if (n := row.get(tuple(a["leave"][j]))) is not None for k in after.get(n, ())}
    return {"enter": a["enter"], "leave": b["leave"], "entries": sorted(entries)}


def resolved(factors: list[dict], enter: tuple, leave: tuple) -> list[tuple[tuple, tuple]]:
    """The states at the begin and the end of each factor on the one path from enter to leave."""
    back, states = [], {enter}
    for x in factors:
        names = [tuple(e) for e in x["enter"]]
        step = {}
        for i, j in x["entries"]:
            if names[i] in states:
                step.setdefault(tuple(x["leave"][j]), names[i])
        back.append(step)
        states = set(step)
    out, at = [], leave
    for step in reversed(back):
        out.append((step[at], at))
        at = step[at]
    return out[::-1]


_STATE = pa.list_(pa.int32())
_MATRIX = pa.schema([("row", pa.string()), ("k", pa.int64()), *((c, pa.list_(_STATE)) for c in ("enter", "leave", "entries"))])
_STATES = pa.schema([("row", pa.string()), ("k", pa.int64()), ("enter", _STATE), ("leave", _STATE)])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _products(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            m = reduce(product, r["m"])
            out.append((r["row"], r["k"], m["enter"], m["leave"], [list(e) for e in m["entries"]]))
        if out:
            yield _table(out, _MATRIX)


def _resolve(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for x, (enter, leave) in zip(r["m"], resolved(r["m"], tuple(r["enter"]), tuple(r["leave"]))):
                out.append((r["row"], x["k"], list(enter), list(leave)))
        if out:
            yield _table(out, _STATES)


def _scan(matrices: DataFrame, shelf: Shelf, fan: int | None = None) -> DataFrame:
    """The states at both ends of each chunk (STATES): products of fan neighbours upwards to one matrix for each document, then the states downwards."""
    fan = fan or FAN
    most = (matrices.agg(F.max("k")).first()[0] or 0) + 1
    grouped = lambda m: m.groupBy("row", F.floor(F.col("k") / fan).alias("g")).agg(F.sort_array(F.collect_list(F.struct("k", "enter", "leave", "entries"))).alias("m")).withColumnRenamed("g", "k")
    levels = [matrices]
    while True:
        levels.append(shelf.put(f"matrices_{len(levels)}", grouped(levels[-1]).mapInArrow(_products, MATRIX)))
        most = -(-most // fan)
        if most <= 1:
            break
    end = F.array(F.lit(0), F.lit(0))  # before and after the text there is one state
    states = levels[-1].select("row", "k", end.alias("enter"), end.alias("leave"))
    for m in reversed(levels[:-1]):
        states = grouped(m).join(states, ["row", "k"]).mapInArrow(_resolve, STATES)
    return states


def decode(rows: DataFrame, model: str = MODEL, ids: str = "piece_ids", marks: str = "mark_positions", into: str = "decoded") -> DataFrame:
    """rows with the texts of their piece ids in column into; null ids give null.

    Empty ids give an empty text. U+2581 comes back where marks says so, elsewhere it is a space. Bytes
    that are no UTF-8 become U+FFFD. Rows are decoded each, repeated or not, long ones whole; other
    columns stay as they are. An empty table gives an empty result.
    """
    shared = _share(rows.sparkSession, model)
    schema = rows.withColumn(into, F.lit(None).cast("string")).schema
    bound_batches(rows.sparkSession)

    def run(batches):
        lattice = _lattice(shared)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                col = part.column(ids)
                values, offs = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                known = col.is_valid().to_pylist()
                where = part.column(marks).to_pylist()
                texts = [restored(lattice.decode(values[offs[i] : offs[i + 1]]), where[i] or ()) if known[i] else None for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return rows.mapInArrow(run, schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the comma-joined ids), round_trip for each document."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check="round_trip")
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"), "round_trip")
