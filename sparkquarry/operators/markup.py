"""Brackets and elements of marked-up text: faults, a node table by intervals, walks as interval joins.

Texts go through Arrow batches in chunks, so that a long text is no long list of characters; positions are
in characters, lines and columns count from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.store import Shelf, bound_batches

PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
CHUNK = 1 << 20
#: Elements without contents (fixed values of the HTML standard), and elements whose contents are no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")
#: Rows of results and pages of input that a Python worker holds at once, whatever the size of Arrow's batches.
ROWS, PAGES = 1 << 14, 64
_MARK = re.compile(rb"[()\[\]{}<>]")
_OPEN = {a.encode(): b.encode() for a, b in PAIRS.items()}
_RESIDUE = "id long, chunk long, at long, line long, col long, kind string, opens boolean, pairs long, crossed long, crossed_at long, crossed_line long, crossed_col long, crossed_kind string"


def _chunks(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about size bytes that end at characters."""
    a = 0
    while a < len(text):
        b = min(len(text), a + size)
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        yield text[a:b]
        a = b


def _reduce(raw: bytes, at: int, line: int, col: int):
    """Of one chunk that begins at character `at`, line and col: its brackets without a partner here as (place, line, col, bracket), the number of pairs, the crossed ones, the first crossed closer, and where the next chunk begins.

    Brackets pair by depth whatever their kind; a pair of two kinds is crossed. So the result of a
    chunk is unmatched closers, then unmatched openers: a monoid.
    """
    buf = np.frombuffer(raw, np.uint8)
    starts = (buf & 0xC0) != 0x80
    chars = np.cumsum(starts) - 1
    newline = buf == 10
    lines = np.cumsum(newline) - newline
    last = np.maximum.accumulate(np.where(newline, np.arange(len(buf)), -1))
    last = np.concatenate([[-1], last[:-1]])  # the newline before each byte
    where = lambda i: (at + int(chars[i]), line + int(lines[i]), (int(chars[i] - chars[last[i]]) if last[i] >= 0 else col + int(chars[i])))
    stack, closers, pairs, crossed, first = [], [], 0, 0, None
    for m in _MARK.finditer(raw):
        c, i = m.group(), m.start()
        if c in _OPEN:
            stack.append((i, c))
        elif not stack:
            closers.append((i, c))
        else:
            _, o = stack.pop()
            pairs += 1
            if _OPEN[o] != c:
                crossed += 1
                first = first or (*where(i), c.decode())
    n = int(starts.sum())
    total = int(newline.sum())
    end_col = n - int(chars[int(np.flatnonzero(newline)[-1])]) if total else col + n
    return [(*where(i), c.decode(), False) for i, c in closers] + [(*where(i), c.decode(), True) for i, c in stack], pairs, crossed, first, (at + n, line + total, end_col)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    """The rows (id, text) of a batch, few of them as Python values at a time."""
    for k in range(0, len(batch), PAGES):
        part = batch.slice(k, PAGES)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _flushed(rows: Iterator[list[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Record batches of about ROWS rows."""
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held) if held else [()] * len(names), types)], names)

    for part in rows:
        for k in range(0, len(part), ROWS):
            held += part[k : k + ROWS]
            if len(held) >= ROWS:
                yield batch()
                held = []
    if held:
        yield batch()


def residues(texts: DataFrame, id_: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """One row for each bracket without a partner in its chunk, and one row (kind null) for each chunk with the counts of its pairs."""

    def rows(batches):
        for batch in batches:
            for doc, s in _texts(batch):
                place = (0, 1, 1)
                for k, raw in enumerate(_chunks((s or "").encode(), chunk)):
                    left, pairs, crossed, first, place = _reduce(raw, *place)
                    yield [(doc, k, None, None, None, None, None, pairs, crossed, *(first or (None,) * 4))]
                    yield [(doc, k, a, l, c, kind, opens, None, None, None, None, None, None) for a, l, c, kind, opens in left]

    def run(batches):
        yield from _flushed(rows(batches), _RESIDUE_NAMES, _RESIDUE_TYPES)

    bound_batches(texts.sparkSession)
    return texts.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _RESIDUE)


_RESIDUE_NAMES = [f.split()[0] for f in _RESIDUE.split(", ")]
_RESIDUE_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in _RESIDUE.split(", ")]


def bracket_faults(texts: DataFrame, shelf: Shelf, id_: str = "id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, pairs, crossed, unopened, unclosed, line, col, kind: brackets of each text and the first fault.

    Brackets of all kinds pair by depth. The first fault is the first closer that crosses its opener or
    has none; without such, the first opener that is never closed. Chunks are reduced by themselves;
    what is left of them is matched by running depths: of the brackets on one level of a text, in order
    of place, an opener pairs with the closer next to it. Null and empty texts, and texts without a
    fault, have a null place; rows of one id are one text each only if ids are unique, which is the caller's to see to.
    """
    r = shelf.put("residues", residues(texts, id_, text, chunk))
    chunks = r.filter("kind is null").groupBy("id").agg(F.sum("pairs").alias("pairs"), F.sum("crossed").alias("crossed"), F.min(F.when(F.col("crossed_at").isNotNull(), F.struct(F.col("crossed_at").alias("at"), F.col("crossed_line").alias("line"), F.col("crossed_col").alias("col"), F.col("crossed_kind").alias("kind")))).alias("fault"))
    order = Window.partitionBy("id").orderBy("at")
    step = F.when(F.col("opens"), 1).otherwise(-1)
    left = r.filter("kind is not null").select("id", "at", "line", "col", "kind", "opens")
    level = left.withColumn("level", F.sum(step).over(order) + F.when(F.col("opens"), 0).otherwise(1))
    beside = Window.partitionBy("id", "level").orderBy("at")
    met = level.withColumn("before", F.lag(F.struct("kind", "opens")).over(beside)).withColumn("behind", F.lead("opens").over(beside))
    partner = F.lit(None).cast("string")
    for a, b in PAIRS.items():
        partner = F.when(F.col("before.kind") == a, b).otherwise(partner)
    paired = ~F.col("opens") & F.coalesce(F.col("before.opens"), F.lit(False))
    unopened, unclosed = ~F.col("opens") & ~paired, F.col("opens") & F.coalesce(F.col("behind"), F.lit(True))
    crossed = paired & (F.col("kind") != partner)
    place = F.struct("at", "line", "col", "kind")
    ends = met.groupBy("id").agg(F.count_if(paired).alias("p"), F.count_if(crossed).alias("x"), F.count_if(unopened).alias("unopened"), F.count_if(unclosed).alias("unclosed"), F.min(F.when(crossed | unopened, place)).alias("closer"), F.min(F.when(unclosed, place)).alias("opener"))
    ids = texts.select(F.col(id_).cast("long").alias("id"))
    out = ids.join(chunks, "id", "left").join(ends, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    fault = F.coalesce(F.least("fault", "closer"), "opener")
    return out.select("id", (zero("pairs") + zero("p")).alias("pairs"), (zero("crossed") + zero("x")).alias("crossed"), zero("unopened").alias("unopened"), zero("unclosed").alias("unclosed"), fault["line"].alias("line"), fault["col"].alias("col"), fault["kind"].alias("kind"))


_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>", re.S)


def _elements(html: str) -> list[tuple]:
    """(node, parent, tag, depth, size) in document order."""
    out: list[list] = []
    open_: list[int] = []
    at = 0

    def close(down_to: int):
        while len(open_) > down_to:
            i = open_.pop()
            out[i][4] = len(out) - i

    while m := _TAG.search(html, at):
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            hit = next((k for k in range(len(open_) - 1, -1, -1) if out[open_[k]][2] == tag), None)
            if hit is not None:
                close(hit)
            continue
        out.append([len(out), open_[-1] if open_ else None, tag, len(open_), 1])
        if tag in VOID or m.group(3).endswith("/"):
            continue
        open_.append(len(out) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.start() if end else len(html)
    close(0)
    return [tuple(r) for r in out]


def elements(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, node, parent, tag, depth, size: the elements of each page in document order (node counts from 0), so the descendants of a node are the size - 1 nodes behind it.

    Malformed markup has a tree all the same: an end tag closes the nearest open element of its name and
    all inside it; one without such an element counts for nothing; what is open at the end of the page is
    closed there. Void elements and tags that end in a slash have no contents; what script, style, title
    and textarea hold is text. Comments are skipped. Null and empty pages have no elements.
    """

    def run(batches):
        rows = ([(page, *r) for r in _elements(s or "")] for batch in batches for page, s in _texts(batch))
        yield from _flushed(rows, ["page_id", "node", "parent", "tag", "depth", "size"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    bound_batches(pages.sparkSession)
    return pages.select(F.col(id_).cast("long").alias("page_id"), F.col(html).alias("html")).mapInArrow(run, "page_id long, node long, parent long, tag string, depth long, size long")


def walk(nodes: DataFrame, ancestor: str, descendant: str) -> DataFrame:
    """page_id, ancestor, node: each element named descendant inside one named ancestor, nested ones with each of them."""
    a = nodes.filter(F.col("tag") == ancestor).select("page_id", F.col("node").alias("ancestor"), (F.col("node") + F.col("size")).alias("end"))
    d = nodes.filter(F.col("tag") == descendant).select("page_id", "node")
    return a.join(d, "page_id").filter("node > ancestor and node < end").select("page_id", "ancestor", "node")


def tag_profile(nodes: DataFrame) -> DataFrame:
    """tag, n, n_pages, deepest, children, subtree: how often each element stands where, over all pages."""
    kids = nodes.filter("parent is not null").groupBy("page_id", F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    return nodes.join(kids, ["page_id", "node"], "left").groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"), F.max("depth").alias("deepest"), F.coalesce(F.sum("kids"), F.lit(0)).alias("children"), F.max("size").alias("largest"))
