"""Vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.  A bin is filled by taking, again and
again, the example that fits in every dimension and has the largest product of its sizes with the room left, each
dimension scaled by its limit and weighted by how scarce it is in the pool.  Where cutting is allowed, the room that no
whole example fits is filled with the head of the longest one, whose rest goes back to the pool.

Every task packs its own partition from a pool of bounded size, so there is no shuffle, a hot source makes no hot task,
and a task that runs again makes the same sequences.  The price is at most one part-filled sequence a partition.

Cases: null and empty texts consist of the end id; a text of any length is cut; repeated rows and ids, null ids are
packed like any others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm.arrays import bounded_batches
from codesift.llm.token_files import names
from codesift.llm.tokens import encoder, vocabulary_path

MAX_TOKENS = 1024
MAX_SEGMENTS = 64  # of instruction data
MAX_LOSS = 1024

# Examples in a task's pool at which it packs, and down to which it does.
POOL_HIGH = 1024
POOL_LOW = 512


@dataclass
class Packer:
    """Streams examples in, sequences out.  An example is (key, tokens, loss tokens); pieces are (key, start, length)."""

    limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)
    cut: bool = True
    keys: list = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    sizes: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, key, tokens: int, loss: int) -> Iterator[list[tuple]]:
        """Takes an example; one longer than a sequence gives full sequences at once (or, uncut, is refused)."""
        start = 0
        if not self.cut:
            if tokens > self.limits[0] or loss > self.limits[2]:
                raise ValueError(f"example of {tokens} tokens, {loss} with loss, is over the limits")
        elif loss == tokens:
            full = min(self.limits[0], self.limits[2])
            while tokens - start >= full:
                yield [(key, start, full)]
                start += full
        if tokens - start:
            self.keys.append(key)
            self.starts.append(start)
            self.sizes.append((tokens - start, 1, loss - start if loss == tokens else loss))
        if len(self.keys) >= POOL_HIGH:
            yield from self.pack(POOL_LOW)

    def pack(self, down_to: int = 0) -> Iterator[list[tuple]]:
        """Packs until at most ``down_to`` examples are left in the pool."""
        if not self.keys:
            return
        limits = np.array(self.limits, np.float64)
        size = np.array(self.sizes, np.float64)
        start = np.array(self.starts)
        left = np.ones(len(size), bool)
        scaled = size / limits
        weight = scaled.sum(axis=0) / len(size)
        whole = scaled * weight
        while left.sum() > down_to:
            room = limits.copy()
            bin_: list[tuple] = []
            while left.any():
                fits = left & (size <= room).all(axis=1)
                if fits.any():
                    i = int(np.argmax(np.where(fits, whole @ (room / limits), -1.0)))
                    bin_.append((self.keys[i], int(start[i]), int(size[i, 0])))
                    room -= size[i]
                    left[i] = False
                    continue
                take = int(min(room[0], room[2]))
                if self.cut and take > 0 and room[1] >= 1:
                    i = int(np.argmax(np.where(left, size[:, 0], -1)))
                    if size[i, 0] == size[i, 2] and size[i, 0] > take:
                        bin_.append((self.keys[i], int(start[i]), take))
                        start[i] += take
                        size[i, 0] -= take
                        size[i, 2] -= take
                        whole[i] = size[i] / limits * weight
                break
            yield bin_
        keep = np.flatnonzero(left)
        self.keys = [self.keys[i] for i in keep]
        self.starts = start[keep].tolist()
        self.sizes = [tuple(int(v) for v in size[i]) for i in keep]


PIECES = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_documents(docs: DataFrame, end_id: int = 0, vocabulary: str | None = None, max_segments: int = MAX_TOKENS) -> DataFrame:
    """Pieces of the documents' ids (``end_id`` after each document, every id bears loss) in sequences.

    A document has one id at least, so by default the limit on segments leaves no room unused.
    """
    bounded_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(path), Packer((MAX_TOKENS, max_segments, MAX_LOSS))
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def placed(bins: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for b in bins:
                offset = 0
                for (doc, ids), start, n in b:
                    rows.append((doc, start, n, zlib.crc32(ids[start: start + n].tobytes()), len(ids), sequence, offset))
                    offset += n
                sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(PIECES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=names(PIECES))

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), coder.encode(b.column(1))):
                ids = np.append(x, np.uint32(end_id)).astype("<u4")
                placed(packer.add((doc, ids), len(ids), len(ids)))
            yield out()
        placed(packer.pack())
        yield out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, PIECES)


EXAMPLES = T.StructType([T.StructField("example_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("tokens", "loss_tokens", "sequence_id", "position")])


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """Whole instruction examples (example_id, tokens, loss_tokens) in sequences under all three limits.

    Null counts are read as 0; an example over a limit on its own cannot be placed and has a null sequence_id.
    """
    bounded_batches(examples.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut=False)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def placed(bins: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for b in bins:
                rows.extend((*key, sequence, k) for k, (key, _, _) in enumerate(b))
                sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(EXAMPLES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=names(EXAMPLES))

        for b in batches:
            for key in zip(*(b.column(i).to_pylist() for i in range(3))):
                if key[1] > limits[0] or key[2] > limits[2]:
                    rows.append((*key, None, None))
                else:
                    placed(packer.add(key, max(key[1], 1), key[2]))
            yield out()
        placed(packer.pack())
        yield out()

    zero = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c)
    return examples.select(F.col("example_id").cast("long"), zero("tokens"), zero("loss_tokens")).mapInArrow(pack, EXAMPLES)


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
