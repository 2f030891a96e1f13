"""Token ids in binary files: one concatenated id array and Elias-Fano coded document boundaries.

A file holds the documents of one shard in ascending doc_id order:

    magic      8 bytes  b"SQTOKEF1"
    header     12 little-endian int64: width of an id in bytes, documents, documents without doc_id,
               ids, doc_id of the first document that has one, partition, number in the partition,
               size in bytes of the boundaries, of the doc_ids, of the ids, crc32 of all that follows
               the header, 0
    boundaries Elias-Fano of the end of each document in the id array
    doc_ids    Elias-Fano of doc_id minus the first one (documents without one stand first and are left out)
    ids        little-endian unsigned, 2 bytes where the vocabulary fits, else 4
    newline    1 byte

Elias-Fano of n ascending values below u: the low l = floor(log2(u / n)) bits of each value are packed
one behind the other; the high bits are written in unary, one 1 bit for each value at place (high part +
number of the value). That is 2 + l bits a value. Value i is found by selecting 1 bit number i: a
directory holds the place of every SAMPLE-th 1 bit in 32 bits (half a bit a value), the words from there
on are counted by their set bits.

The files are plain ones: Spark's text writer writes the bytes as they are, one file a row, through
whatever store the cluster has and with its commit protocol, so a lost executor leaves no half file; the
binaryFile reader reads them.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.llm import terms as T
from sparkquarry.store import Shelf

MAGIC, SAMPLE, END = b"SQTOKEF1", 64, 0
_HEADER = struct.Struct("<12q")
#: Ids in a file (a longer document has a file of its own), chunks that a worker remembers, bytes of them and their ids.
SHARD_IDS, MEMO, MEMO_BYTES = 4 << 20, 500_000, 16 << 20
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of set bit number r of a byte.
_PLACE = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)


# --- Elias-Fano -------------------------------------------------------------------------------


class EliasFano:
    """n ascending values from 0; reads straight from its bytes."""

    HEAD = struct.Struct("<4q")  # n, low bits, words of high bits, samples

    def __init__(self, data):
        data = memoryview(data)
        self.n, self.low_bits, n_high, n_samples = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        n_low = (self.n * self.low_bits + 63) // 64
        self.low = np.frombuffer(data, "<u8", n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high * 8, at + 8 * n_low)
        self.samples = np.frombuffer(data, "<u4", n_samples, at + 8 * n_low + 8 * n_high)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls.HEAD.pack(0, 0, 0, 0)
        universe = int(values[-1]) + 1
        low_bits = max(0, (universe // n).bit_length() - 1)
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        if int(place[-1]) >= 1 << 32:
            raise ValueError("more than 2^32 bits in one directory; use smaller shards")
        high = np.zeros((int(place[-1]) // 64 + 1) * 64, np.uint8)
        high[place] = 1
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        if low_bits:
            rest = values & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, rest << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        samples = place[::SAMPLE].astype("<u4")
        return cls.HEAD.pack(n, low_bits, len(high) // 64, len(samples)) + low[:-1].astype("<u8").tobytes() + np.packbits(high, bitorder="little").tobytes() + samples.tobytes()

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the 1 bits numbered i."""
        i = np.asarray(i, np.int64)
        start = self.samples[i // SAMPLE].astype(np.int64)
        left, byte = i % SAMPLE, start >> 3
        # Bits of the first byte before the sampled one do not count.
        left = left + _BITS[self.high[byte] & ((1 << (start & 7)) - 1).astype(np.uint8)]
        on = np.arange(len(i))
        while len(on):
            here = _BITS[self.high[byte[on]]]
            on = on[(more := left[on] >= here)]
            left[on] -= here[more]
            byte[on] += 1
        return (byte << 3) + _PLACE[self.high[byte], left]

    def __getitem__(self, i) -> np.ndarray:
        """Values number i (an array of numbers)."""
        i = np.asarray(i, np.int64)
        value = (self.select(i) - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = i.astype(np.uint64) * np.uint64(self.low_bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            rest = self.low[word] >> shift
            over = shift + np.uint64(self.low_bits) > 64
            rest[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
            value |= rest & np.uint64((1 << self.low_bits) - 1)
        return value.astype(np.int64)

    def values(self) -> np.ndarray:
        return self[np.arange(self.n)]


# --- files ------------------------------------------------------------------------------------


class TokenFile:
    """One file's bytes, ready for reading: ids of document i are ids[start(i):end(i)]."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC or len(data) < 8 + _HEADER.size:
            raise ValueError("no token file")
        self.width, self.n_docs, self.n_null, self.n_ids, self.first_id, self.partition, self.number, a, b, c, crc, _ = _HEADER.unpack_from(data, 8)
        at = 8 + _HEADER.size
        if len(data) < at + a + b + c or zlib.crc32(data[at : at + a + b + c]) != crc:
            raise ValueError(f"token file {self.partition}/{self.number} is damaged")
        self.ends, self.known = EliasFano(data[at : at + a]), EliasFano(data[at + a : at + a + b])
        self.ids = np.frombuffer(data, "<u2" if self.width == 2 else "<u4", self.n_ids, at + a + b)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.known.values() + self.first_id).tolist()

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and end of documents number i."""
        i = np.asarray(i, np.int64)
        return np.where(i > 0, self.ends[np.maximum(i - 1, 0)], 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(np.array([i]))
        return self.ids[int(a[0]) : int(b[0])]


def file_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, partition: int, number: int) -> bytes:
    """ids: an array of the width that the file shall have; doc_ids ascend, None first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    a, b, c = EliasFano.encode(np.cumsum(sizes)), EliasFano.encode(known.astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)), ids.tobytes()
    crc = zlib.crc32(c, zlib.crc32(b, zlib.crc32(a)))
    return b"".join([MAGIC, _HEADER.pack(ids.itemsize, len(doc_ids), len(doc_ids) - len(known), len(ids), first, partition, number, len(a), len(b), len(c), crc, 0), a, b, c])


# --- encoding ---------------------------------------------------------------------------------


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places where a byte-level BPE of words surely begins a new word, so that both sides may be encoded alone.

    Such a place is white space after what is none, or one of `.,;:!?` after an ASCII letter: the
    word pattern joins neither with what stands before. Places after a character that is white space
    outside ASCII, or may be, are left out.
    """
    if len(buf) < 2:
        return np.zeros(0, np.int64)
    before, here = buf[:-1], buf[1:]
    blank = np.zeros(256, bool)
    blank[[*range(0x09, 0x0E), 0x20]] = True
    doubtful = np.zeros(256, bool)  # controls that some patterns count as blank
    doubtful[0x1C:0x20] = True
    # Last bytes of white space outside ASCII: U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000.
    doubtful[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
    safe = ~(blank | doubtful)
    after_second = np.zeros(256, bool)  # second-last bytes with which those last bytes are white space
    after_second[[0xC2, 0x9A, 0x80, 0x81]] = True
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    mark = np.zeros(256, bool)
    mark[list(b".,;:!?")] = True
    fine = safe[before]
    fine[1:] |= (before[1:] >= 0x80) & ~after_second[buf[:-2]]
    return np.flatnonzero((blank[here] & fine) | (mark[here] & letter[before])) + 1


#: Characters that stand for the bytes in a byte-level vocabulary: printable Latin-1 characters for themselves, U+0100 and on for the others in order. Fixed values.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: A chunk that surely is one word of the byte-level word pattern.
ONE_WORD = "^ ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+$"


class Encoder:
    """Token ids of texts with one tokenizer file, in one worker.

    With a byte-level tokenizer a text is cut where words surely end; equal chunks are encoded once by
    the tokenizers library and remembered (about MEMO or MEMO_BYTES, then anew). A chunk that is one word
    goes to the library's model at once, any other through the whole tokenizer. With another kind of
    tokenizer whole texts go to the library. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        split = spec.get("pre_tokenizer") or {}
        self.by_chunk = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and spec.get("normalizer") is None and all(t["special"] for t in spec.get("added_tokens", ())) and spec["model"]["type"] == "BPE"
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        """Known chunks, the places of their ids in flat, and flat."""
        self.known, self.begin, self.length, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of distinct chunks among the known ones; those that were not are encoded first."""
        if len(self.known) > MEMO or self.known.nbytes + self.flat.nbytes > MEMO_BYTES:
            self._forget()
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(pc.is_null(at))
        model, flat, length, other = self.model, [], np.zeros(len(new), np.int64), []
        for k, (c, one) in enumerate(zip(new.to_pylist(), pc.match_substring_regex(new, ONE_WORD).to_pylist())):
            if one:
                ids = [t.id for t in model.tokenize(c.encode().decode("latin-1").translate(BYTE_SIGNS))]
                length[k] = len(ids)
                flat += ids
            else:
                other.append((k, c))
        order = np.flatnonzero(length).tolist()  # a word has an id at least
        for a in range(0, len(other), 10_000):
            part = other[a : a + 10_000]
            for (k, _), e in zip(part, self.tok.encode_batch_fast([c for _, c in part], add_special_tokens=False)):
                length[k] = len(e.ids)
                flat += e.ids
        order = np.array([*order, *(k for k, _ in other)], np.int64)
        begin = np.zeros(len(new), np.int64)
        begin[order] = len(self.flat) + np.cumsum(length[order]) - length[order]
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        out[out < 0] = len(self.known) + np.arange(len(new))
        # All four at once: a task that fails leaves nothing half done to the next one.
        self.known, self.begin, self.length, self.flat = pa.concat_arrays([self.known, new]), np.concatenate([self.begin, begin]), np.concatenate([self.length, length]), np.concatenate([self.flat, np.array(flat, self.dtype)])
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents in order, each document's followed by END, and their numbers."""
        n = len(offs) - 1
        if not self.by_chunk:
            texts = [buf[a:b].tobytes().decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            ids = [np.array([*e.ids, END], self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.dtype), *ids]), np.array([len(x) for x in ids], np.int64)
        begins = np.zeros(len(buf) + 1, bool)
        begins[cuts(buf)] = begins[offs] = True
        at = np.flatnonzero(begins)
        sizes = np.diff(at)
        coded = T.strings(buf, sizes).dictionary_encode()
        code = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.length[code]
        doc = np.searchsorted(offs, at[:-1], "right") - 1 if len(sizes) else np.zeros(0, np.int64)
        tokens = np.bincount(doc, each, n).astype(np.int64) + 1 if len(sizes) else np.ones(n, np.int64)
        # A chunk's ids go behind those of all chunks before and one END for each earlier document.
        source = np.arange(int(each.sum())) + np.repeat(self.begin[code] - (np.cumsum(each) - each), each)
        out = np.full(int(tokens.sum()), END, self.dtype)
        ends = np.zeros(len(out), bool)
        ends[np.cumsum(tokens) - 1] = True
        out[~ends] = self.flat[source]
        return out, tokens


@lru_cache(1)
def worker_encoder(tokenizer_json: str) -> Encoder:
    """The encoder of all tasks of a worker. The library keeps some 4 MB of each tokenizer that has encoded for good, so with an encoder for each task a worker would grow with its tasks."""
    return Encoder(tokenizer_json)


def _portions(batch: pa.RecordBatch, by_chunk: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes, offsets, whether the last document ends here) of at most about a slice each; a long text comes in parts that are cut where words surely end."""
    row = 0
    for part in K.slices(batch, "text", T.PART):
        buf, offs = K.flat(part.column("text"))
        if len(offs) != 2 or len(buf) <= T.PART or not by_chunk:
            yield row, buf, offs, True
        else:
            a = 0
            while a < len(buf):
                b, step = min(len(buf), a + T.PART), T.PART
                while b < len(buf):
                    found = cuts(buf[a : min(len(buf), b + step)])
                    found = found[found >= b - a]
                    if len(found):
                        b = a + int(found[0])
                        break
                    b, step = min(len(buf), b + step), 2 * step
                yield row, buf[a:b], np.array([0, b - a]), b == len(buf)
                a = b
        row += part.num_rows


def write(docs: DataFrame, path: str, tokenizer_json: str, shard_ids: int = SHARD_IDS) -> None:
    """Writes docs (doc_id, text) as token files to the folder path.

    Texts are dealt by ranges of doc_id, sorted and encoded where they arrive, so ids are shuffled
    nowhere. Null texts are empty documents (END alone); rows without doc_id stand first, repeated
    doc_ids next to each other in the order of their texts; an empty table gives no file. A long text
    is encoded in parts. Other columns are ignored. A partition's files are numbered, and partitions
    ascend, so a task that runs again writes the same files.
    """
    spark = docs.sparkSession
    K.bound_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)  # one tokenizer file: bounded by its vocabulary

    def run(batches):
        encoder, partition, number = worker_encoder(shared.value), TaskContext.get().partitionId(), 0
        doc_ids, sizes, held, size, open_size, open_ids = [], [], [], 0, 0, []

        def shard():
            nonlocal doc_ids, sizes, held, size, number
            data = file_bytes(doc_ids, np.array(sizes, np.int64), np.concatenate(held), partition, number)
            number += 1
            doc_ids, sizes, held, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, buf, offs, last in _portions(batch, encoder.by_chunk):
                out, tokens = encoder.encode(buf, offs)
                if not last:  # the END of this part is none
                    open_ids.append(out[:-1])
                    open_size += len(out) - 1
                    continue
                if open_ids:
                    tokens[0] += open_size
                    out = np.concatenate([*open_ids, out])
                    open_ids, open_size = [], 0
                done, begin = 0, 0
                while done < len(tokens):
                    room = np.searchsorted(np.cumsum(tokens[done:]), shard_ids - size, "right")
                    take = max(int(room), 1 if not size else 0)
                    if take:
                        stop = begin + int(tokens[done : done + take].sum())
                        held.append(out[begin:stop])
                        doc_ids += ids[row + done : row + done + take]
                        sizes += tokens[done : done + take].tolist()
                        size, done, begin = size + stop - begin, done + take, stop
                    if done < len(tokens):
                        yield shard()
        if doc_ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")  # the range's sample holds no texts
    rows.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read(spark: SparkSession, path: str, make: Callable[[], Callable[[TokenFile], dict]], schema: str) -> DataFrame:
    """Rows that make()'s function gives for each file of the folder."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    K.bound_batches(spark)

    def run(batches):
        of_file = make()
        for batch in batches:
            for k in range(batch.num_rows):
                out = of_file(TokenFile(batch.column("content")[k].as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).filter("length > 0").select("content").mapInArrow(run, fields)


def _documents(file: TokenFile) -> dict:
    start, end = file.bounds(np.arange(file.n_docs))
    crc = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(start.tolist(), end.tolist())]
    n = file.n_docs
    return {"doc_id": file.doc_ids(), "partition": [file.partition] * n, "number": [file.number] * n, "start": start, "n_tokens": end - start, "ids_crc32": crc}


def contents(spark: SparkSession, path: str, shelf: Shelf) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the files.

    A file knows the places inside itself; what stands before it is the sum of the partitions before
    (one row each) and of the files before in its own.
    """
    rows = shelf.put("documents", read(spark, path, lambda: _documents, "doc_id long, partition long, number long, start long, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("partition", "number").agg(F.sum("n_tokens").alias("ids"))
    whole = files.groupBy("partition").agg(F.sum("ids").alias("ids"))
    before = whole.select("partition", (F.sum("ids").over(Window.orderBy("partition")) - F.col("ids")).alias("before"))
    inside = Window.partitionBy("partition").orderBy("number")
    bases = files.select("partition", "number", (F.sum("ids").over(inside) - F.col("ids")).alias("inside")).join(before, "partition")
    return rows.join(bases, ["partition", "number"]).select("doc_id", (F.col("before") + F.col("inside") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on the driver."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark, "tokens")
    path = f"{shelf.root}/files"
    with open(tokenizer_path()) as f:
        write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, f.read())
    return contents(spark, path, shelf)
