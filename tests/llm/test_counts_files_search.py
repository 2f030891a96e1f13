"""Divergence audit, token files and ranked search."""

import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import divergence, lexical, token_files
from sparkquarry.llm import terms as T
from sparkquarry.store import Shelf

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, Term string, rank int"


def odd_rows(n=300, seed=5):
    """Nulls in every column, empty texts, ties, repeated rows, columns with clashing names."""
    r = random.Random(seed)
    words = ["a", "the", "The", "über", "ÜBER", "x1y", "don't", "日本", "z", "rare", "of"]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 12))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", "s4", "s5", None]), "x", 1) for k in range(n)]
    return rows + [(None, "the rare of", "en", "s1", None, None), (7, None, None, None, None, None), (8, "", "en", "lonely", "", 0), (9, "12 ..", "nowords", "s1", "", 0), (9, "34", "nowords", "s2", "", 0), rows[0], rows[0], rows[1]]


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.execute(sql).df()


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))


def frame(rows, names):
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"} if "doc_id" in names else {"item_id": "Int64"})


# --- divergence -------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2, 256])
def test_audit_equals_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    monkeypatch.setattr(divergence, "MATRICES", 1)
    rows = odd_rows()
    got = divergence.audit(spark.createDataFrame(rows, ODD).repartition(5)).toPandas()
    want = duck(divergence.OP11_SQL, documents=frame(rows, ["doc_id", "text", "lang", "source", "Term", "rank"]))
    assert rows_of(got) == rows_of(want)
    assert set(got[got.lang == "nowords"].value) == {0} and not len(got[(got.lang == "nowords") & (got.part == "term")])
    assert ("en", "lonely") in set(zip(got.lang, got.source))


def test_audit_keeps_the_top_terms_and_takes_empty_tables(spark):
    rows = [(k, f"w{chr(97 + k % 7) * 3} common", "en", f"s{k % 2}", "", 0) for k in range(60)]
    got = divergence.audit(spark.createDataFrame(rows, ODD), top=2).toPandas()
    assert got[got.part == "term"].groupby("source")["rank"].max().max() <= 2
    assert divergence.audit(spark.createDataFrame([], ODD)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, words, v = 10**13 + 7, 3 * 10**13 + 1, 12345
    df = spark.createDataFrame([(n, words, v), (0, 0, 1), (0, 0, 0)], "n long, words long, v long")
    got = [r[0] for r in df.select(divergence.share(df.n, df.words, df.v)).collect()]
    assert got == [1 + 10**9 * (n + 1) // (words + v), 1 + 10**9, None]


def test_counts_of_a_long_text_equal_those_of_its_words(monkeypatch):
    monkeypatch.setattr(T, "PART", 50)
    text = "abc Def ünd " * 40 + "x" * 300 + " abc"
    raw = text.encode()
    c = T.counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), T.LETTER_WORDS)
    assert dict(zip(c.names.take(pa.array(c.code)).to_pylist(), c.n.tolist())) == {"abc": 41, "def": 40, "ünd": 40, "x" * 300: 1}
    assert c.totals.tolist() == [122]


# --- token files ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spec():
    with open(token_files.tokenizer_path()) as f:
        return f.read()


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    return lambda texts: [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_elias_fano_values_and_space():
    r = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 3000):
        for u in (1, 2, 1000, 10**12, 2**62):
            v = np.sort(r.integers(0, u, n))
            e = token_files.EliasFano(token_files.EliasFano.encode(v))
            assert (e.values() == v).all()
            if n:
                at = r.integers(0, n, 40)
                assert (e[at] == v[at]).all()
    v = np.array([0] * 500 + [10**9] * 3 + [10**9 + 5])
    assert (token_files.EliasFano(token_files.EliasFano.encode(v)).values() == v).all()
    v = np.cumsum(r.integers(1, 3000, 50_000))
    assert len(token_files.EliasFano.encode(v)) * 8 / len(v) < 2 + math.log2(v[-1] / len(v)) + 1


def test_chunks_encode_like_the_library(spec, library):
    signs = ["a", "B", " ", "  ", "\n", "'s", "'", "ll", "é", " ", " ", "　", "\u0085", "\x1c", "\t", "1", "23", ".", ",", "!?", "日本", "ש", "<|endoftext|>", "😀", "_", "-", "the", "\r\n", "\x00"]
    r = random.Random(3)
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(2000)] + ["", ""]
    raw = [t.encode() for t in texts]
    ids, n = token_files.Encoder(spec).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert ids.tolist() == [i for x in library(texts) for i in x]
    assert n.tolist() == [len(x) for x in library(texts)]


def contents(spark, rows, spec, shard_ids, label, parts=3):
    shelf = Shelf(spark, label)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, Ids string").repartition(parts)
    token_files.write(docs, f"{shelf.root}/files", spec, shard_ids)
    return token_files.contents(spark, f"{shelf.root}/files", shelf), f"{shelf.root}/files"


@pytest.mark.parametrize("shard_ids", [1, 40, 1 << 22])
def test_files_give_back_every_document(spark, spec, library, shard_ids):
    rows = [(k * 7 - 300, t, 0, None) for k, (_, t, *_) in enumerate(odd_rows(60))] + [(None, "no id", 0, ""), (None, None, 0, ""), (5, "twin", 0, ""), (5, "twin", 0, ""), (5, "twin a", 0, ""), (10**15, "", 0, "")]
    got = contents(spark, rows, spec, shard_ids, "t")[0].toPandas()
    assert len(got) == len(rows)
    got = got.sort_values(["start"])
    assert (got.start.to_numpy() == np.cumsum(got.n_tokens) - got.n_tokens).all()
    ids = got.doc_id.astype("Int64")
    assert ids.isna().sum() == 2 and ids.isna().to_numpy()[:2].all() and ids.dropna().is_monotonic_increasing
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = sorted((str(d), len(x), crc(x)) for (d, *_), x in zip(rows, library([t for _, t, *_ in rows])))
    assert sorted(zip([str(None if pd.isna(d) else int(d)) for d in ids], got.n_tokens, got.ids_crc32)) == want


def test_long_texts_are_encoded_in_parts(monkeypatch, spec, library):
    monkeypatch.setattr(T, "PART", 64)
    text = "One two  three.\n\nFour " * 60 + "a1" * 100 + " tail"
    batch = pa.record_batch({"text": pa.array([text], pa.string())})
    encoder, out = token_files.Encoder(spec), []
    for _, buf, offs, last in token_files._portions(batch, True):
        ids, _ = encoder.encode(buf, offs)
        out += ids.tolist()[: None if last else -1]
    assert out == library([text])[0]


def test_other_tokenizers_take_whole_texts():
    path = token_files.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    with open(path) as f:
        encoder = token_files.Encoder(f.read())
    assert not encoder.by_chunk
    texts, t = ["Hello, world's end", "", "two  words"], Tokenizer.from_file(path)
    raw = [x.encode() for x in texts]
    ids, n = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert ids.tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 0]]


def test_files_are_checked_and_read_alone(spark, spec, library):
    rows = [(k, f"text number {k}", 0, "") for k in range(50)]
    _, path = contents(spark, rows, spec, 60, "u", 1)
    files = [r.content for r in spark.read.format("binaryFile").load(path).filter("length > 0").select("content").collect()]
    found = {}
    for data in files:
        f = token_files.TokenFile(data)
        found |= {d: f.document(i).tolist() for i, d in enumerate(f.doc_ids())}
        assert f.n_docs == 1 or f.n_ids <= 60
    assert found == dict(zip(range(50), library([t for _, t, *_ in rows])))
    broken = bytearray(files[0])
    broken[-5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.TokenFile(bytes(broken))
    with pytest.raises(ValueError, match="no token file"):
        token_files.TokenFile(b"")


def test_memory_of_a_worker_does_not_grow_with_its_tasks(spark, spec):
    """60 tasks, each with the same 8,000 words; the workers' own memory after them and after a first round."""
    r = random.Random(8)
    text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(8000))
    docs = spark.range(0, 240, 1, 4).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))

    def held():
        def run(batches):
            for _ in batches:
                pass
            time.sleep(1)  # each task in a worker of its own
            with open("/proc/self/smaps_rollup") as f:
                kb = int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1])
            yield pa.RecordBatch.from_pydict({"mb": pa.array([kb / 1024])})

        return max(row.mb for row in spark.range(0, 4, 1, 4).mapInArrow(run, "mb double").collect())

    was = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        after = []
        for tasks in (8, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
            token_files.write(docs, f"{Shelf(spark, 'w').root}/files", spec)
            after.append(held())
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    assert after[1] < after[0] + 20, after


def test_remembered_chunks_are_bounded_in_bytes(monkeypatch, spec, library):
    monkeypatch.setattr(token_files, "MEMO_BYTES", 20_000, raising=False)
    encoder = token_files.Encoder(spec)
    for k in range(20):  # few chunks, all long
        texts = [f"{k}{n}" + "日本" * 500 for n in range(5)]
        raw = [t.encode() for t in texts]
        ids, _ = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert ids.tolist() == [i for x in library(texts) for i in x]
        assert encoder.known.nbytes < 20_000 + sum(map(len, raw)) + 100


def test_empty_table_of_documents(spark, spec):
    assert contents(spark, [], spec, 10, "v")[0].count() == 0


# --- ranked search ----------------------------------------------------------------------------


def searched(spark, docs, items, k=50):
    n_docs, n_words = lexical.statistics(docs)
    return lexical.search(lexical.build(docs, n_docs, n_words), n_docs, items, k)


@pytest.mark.parametrize(("shard_docs", "step"), [(1 << 15, 2048), (13, 3)])
def test_search_equals_plain_scoring(spark, monkeypatch, shard_docs, step):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "PART_BYTES", 20)
    rows = odd_rows(400)
    items = [(1, "the rare über"), (2, "OF z don"), (3, None), (4, ""), (5, "absent"), (6, "日本 x1y the a z of"), (None, "the"), (6, "rare rare"), (7, "the")]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    docs = docs.unionByName(docs.sparkSession.createDataFrame([], ODD))
    got = searched(spark, docs, spark.createDataFrame(items, "item_id long, text string")).toPandas()
    want = duck(lexical.OP13_SQL, documents=frame(rows, ["doc_id", "text", "lang", "source", "Term", "rank"]), benchmark=frame(items, ["item_id", "text"]))
    assert rows_of(got) == rows_of(want)
    assert set(got.item_id) == {1, 2, 6, 7}


def test_search_takes_empty_tables(spark):
    docs, items = spark.createDataFrame([], ODD), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert searched(spark, docs, items).count() == 0
    assert searched(spark, spark.createDataFrame(odd_rows(5), ODD), items.limit(0)).count() == 0


def test_treaps_are_search_trees_and_heaps():
    r = np.random.default_rng(4)
    sizes = np.array([1, 500, 3, 4000])
    doc = np.concatenate([np.sort(r.choice(5000, n, replace=False)) for n in sizes])
    impact = np.where(r.random(len(doc)) < 0.7, 7, r.integers(1, 900, len(doc)))  # many ties
    left, right, root = lexical.link(impact, doc, sizes)
    assert len(root) == len(sizes)
    for top, a, n in zip(root.tolist(), np.cumsum(sizes) - sizes, sizes):
        order, deepest, stack = [], 0, [(top, a, a + n, 0, 10**9)]
        while stack:
            v, lo, hi, depth, above = stack.pop()
            if v < 0:
                continue
            assert lo <= v < hi and impact[v] <= above
            deepest = max(deepest, depth)
            order.append(v)
            stack += [(int(left[v]), lo, v, depth + 1, impact[v]), (int(right[v]), v + 1, hi, depth + 1, impact[v])]
        assert sorted(order) == list(range(a, a + n))
        assert deepest <= 6 * math.log2(n + 1)


def test_subtrees_are_pruned(monkeypatch):
    """A rare term of great weight decides; most of the frequent term's documents are never opened."""
    r = np.random.default_rng(8)
    n = 20_000
    text = [("rare " * 3 if k % 400 == 0 else "") + "often " + " ".join(f"w{x}" for x in r.integers(0, 50, 20)) for k in range(n)]
    raw = [t.encode() for t in text]
    c = T.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lexical.K.ALNUM_WORDS)
    total = int(c.totals.sum())
    shard = lexical.Shard(lexical._row(lexical._shard(list(range(n)), [c], n, total), 0), ["rare", "often"])
    opened = []
    monkeypatch.setattr(lexical, "_cut", lambda *a, f=lexical._cut: (opened.append(len(a[1]) // 2), f(*a))[1])
    (docs, scores), = lexical.top_of_shard(shard, [[("rare", 5000), ("often", 1)]], 10)
    impact = {t: dict(zip(shard.doc[m].tolist(), shard.impact[m].tolist())) for t, m in (("rare", shard.impact >= 0),)}
    assert impact
    assert all(d % 400 == 0 for d in docs.tolist()) and (np.diff(scores) <= 0).all()
    assert sum(opened) < n / 20


def test_words_are_those_of_the_pattern():
    text = "A-b_c 1É2 日本ab\tx\x00y Ünd"
    raw = text.encode()
    w, n = T.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lexical.K.ALNUM_WORDS)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert w.to_pylist() == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower)) and n.tolist() == [len(w)]


def test_a_table_of_large_rows_has_small_row_groups(spark):
    """Writer and reader of an index hold a row group whole, so it may not grow with the rows of a task."""

    def rows(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(k).bytes(4 << 20)], pa.binary())], ["raw"])

    kept = Shelf(spark, "large").put("rows", spark.range(0, 48, 1, 1).mapInArrow(rows, "raw binary"))
    import pyarrow.parquet as pq

    (file,) = kept.inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file:")).metadata
    assert groups.num_rows == 48 and groups.num_row_groups > 1
    assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 160 << 20
