"""Spans in code points: what the detectors of personal data and of secrets share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K

DDL = "spans array<struct<kind: string, start: long, end: long, base: boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def detect(docs: DataFrame, make) -> DataFrame:
    """doc_id and spans. make() gives (anchors, find): anchors(buf, offs) says which texts may hold a span at all, find(texts) the (kind, start, end, base) lists of those."""

    def outer():
        anchors, find = make()

        def kernel(buf, offs, part):
            out = [[] for _ in offs[1:]]
            at = np.flatnonzero(anchors(buf, offs)).tolist()
            for d, found in zip(at, find([buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace") for d in at])):
                out[d] = [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in found]
            return {"doc_id": part.column("doc_id"), "spans": pa.array(out, ARROW)}

        return kernel

    return K.map_text(docs.select(F.col("doc_id").cast("long"), "text"), outer, f"doc_id long, {DDL}")


def digest(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans (kind:start:end, comma-joined) of detect()'s rows."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base: Column = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return rows.select("doc_id", *count, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
