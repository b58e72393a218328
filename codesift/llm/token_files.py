"""Token files: concatenated ids with Elias-Fano document boundaries.

One file holds a run of documents in ascending doc_id order:

    magic "CSTF", version u16, id width u16, documents u64, ids u64, null doc_ids u64, smallest doc_id i64,
    two Elias-Fano sections (ends of the documents, doc_ids less the smallest), the ids.

An Elias-Fano section keeps a non-decreasing sequence in 2 + log2(range / n) bits a value: the low bits packed, the high
bits in unary, and the place of every 64th one for ``select``.  There is no table of 64-bit offsets.

``write_token_files`` sorts by range, so the files in name order hold all documents in ascending doc_id order (null ids
first); each task writes its files below a temporary name and renames them, so a repeated task leaves the same files.
A file ends at ``FILE_IDS`` ids; a longer document has a file for itself.

Cases: null and empty texts have the end id only; equal doc_ids stand side by side; an empty table gives no files and no
rows; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codesift.llm.arrays import bounded_batches
from codesift.llm.tokens import encoder, vocabulary_path
from codesift.session import work_dir

FILE_IDS = 2 << 20
SELECT_STEP = 64
MAGIC = b"CSTF"
_HEAD = struct.Struct("<4sHHQQQq")
_PART = struct.Struct("<QBQQQ")


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(v[-1] + np.uint64(1)) // n).bit_length() - 1)
        low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SELECT_STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _PART.pack(self.n, self.low_bits, self.low.nbytes, self.high.nbytes, self.marks.nbytes) + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes | memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = _PART.unpack_from(raw, at)
        at += _PART.size
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        marks = np.frombuffer(bytes(raw[at + a + b: at + a + b + c]), np.uint32)
        return cls(n, low_bits, low, high, marks), at + a + b + c

    def _low(self, i: int, j: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(j - i, np.uint64)
        a, b = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[a // 8: -(-b // 8)], bitorder="little")[a % 8: a % 8 + b - a].reshape(j - i, -1)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def _ones(self, k: int) -> np.ndarray:
        """Places of the ones from mark ``k`` up to the next."""
        start = int(self.marks[k])
        stop = int(self.marks[k + 1]) if k + 1 < len(self.marks) else len(self.high) * 8
        bits = np.unpackbits(self.high[start // 8: -(-stop // 8)], bitorder="little")[start % 8: start % 8 + stop - start]
        return start + np.flatnonzero(bits)

    def select(self, i: int) -> int:
        """The i-th value, reading the bits from the nearest mark on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        one = int(self._ones(i // SELECT_STEP)[i % SELECT_STEP])
        return ((one - i) << self.low_bits) + int(self._low(i, i + 1)[0])

    def blocks(self) -> Iterator[np.ndarray]:
        """All values, the ``SELECT_STEP`` of one mark at a time."""
        for k in range(len(self.marks)):
            i = k * SELECT_STEP
            ones = self._ones(k)
            yield ((ones - np.arange(i, i + len(ones))).astype(np.uint64) << np.uint64(self.low_bits)) + self._low(i, i + len(ones))

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) + self._low(0, self.n)


def dump(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """A file's bytes; doc_ids ascending, nulls first."""
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    ends = np.cumsum([len(x) for x in ids])
    body = np.concatenate(ids).astype(f"<u{width}") if ids else np.zeros(0, f"<u{width}")
    gaps = (named.astype(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)) if len(named) else named
    return (_HEAD.pack(MAGIC, 1, width, len(doc_ids), len(body), len(doc_ids) - len(named), least)
            + EliasFano.of(ends).to_bytes() + EliasFano.of(gaps).to_bytes() + body.tobytes())


class TokenFile:
    """A file's content: ``doc_ids``, ``start(i)``, ``ids(i)``."""

    def __init__(self, raw: bytes) -> None:
        magic, version, width, self.n_docs, self.n_ids, self.nulls, self.least = _HEAD.unpack_from(raw, 0)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.from_bytes(raw, _HEAD.size)
        self._ids, at = EliasFano.from_bytes(raw, at)
        self.body = np.frombuffer(raw, f"<u{width}", self.n_ids, at)

    def doc_ids(self) -> list[int | None]:
        named = (self._ids.values() + np.uint64(self.least & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist() if self._ids.n else []
        return [None] * self.nulls + named

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def ids(self, i: int) -> np.ndarray:
        return self.body[self.start(i): self.ends.select(i)]


def put(folder: str, name: str, content: bytes) -> None:
    """Writes a file of a shared folder under a temporary name and renames it."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, f"{base}/{name}")


FILES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("file", T.StringType()),
                      T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
DOCS = T.StructType([T.StructField("file", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("at", T.LongType()),
                     T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def write_token_files(docs: DataFrame, folder: str, end_id: int, vocabulary: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text), appends ``end_id`` and writes the files below ``folder``.

    Returns the list of files: part, k, file, n_docs, n_ids, and ``base``, the ids of all files before it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        coder = encoder(path)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        held: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{part:08d}-{k:08d}.tok"
            put(folder, name, dump(held, ids, width))
            return pa.RecordBatch.from_pydict({"part": [part], "k": [k], "file": [name], "n_docs": [len(held)], "n_ids": [size]}, names(FILES))

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), coder.encode(b.column(1))):
                if held and size + len(x) + 1 > file_ids:
                    yield flush()
                    held, ids, size, k = [], [], 0, k + 1
                held.append(d)
                ids.append(np.append(x, np.uint32(end_id)).astype(f"<u{width}"))
                size += len(x) + 1
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, FILES).write.parquet(f"{folder}-list")
    files = spark.read.schema(FILES).parquet(f"{folder}-list")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(parts, "part").withColumn("base", F.col("first") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop("first")


def names(schema: T.StructType) -> pa.Schema:
    kinds = {"integer": pa.int32(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Offsets come from the select marks, for the documents of one mark at a time."""
    spark = files.sparkSession
    bounded_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                f = TokenFile(memoryview(raw.as_buffer()))
                name, ids, start, done = path.rsplit("/", 1)[1], f.doc_ids(), 0, 0
                for block in f.ends.blocks():
                    ends = block.astype(np.int64)
                    starts = np.append(start, ends[:-1])
                    crc = [zlib.crc32(f.body[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(ends), "doc_id": ids[done: done + len(ends)], "at": starts, "n_tokens": ends - starts, "ids_crc32": crc}, names(DOCS))
                    start, done = int(ends[-1]), done + len(ends)

    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    found = raw.mapInArrow(read, DOCS)
    return found.join(files.select("file", "base"), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/tokens"
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, end_id=2)
    return read_token_files(files, folder)
