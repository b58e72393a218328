"""Tokens per document of flat token files that have no index.

A stream is a row of equal blocks of bare ids (little-endian, two bytes where the vocabulary allows); documents are told
apart by the end-of-text id only and may run over any number of blocks.

1. Every block is scanned on its own: one vectorised search gives the places of the end ids.
2. A prefix scan over the blocks' summaries (ids, ends, place of the last end) gives each block the ids and the ends
   before it and where the document that is open at its start began.
3. The ends become documents: ordinal in the stream, start and length.  Ids after a stream's last end are a document
   without an end and are reported with ``ended`` false.

Cases: null and empty texts are documents of the end id alone; equal rows and doc_ids are documents of their own; an
empty table has no streams and no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codesift.llm.arrays import bounded_batches
from codesift.llm.token_files import names, put
from codesift.llm.tokens import END_OF_TEXT, encoder, vocabulary_path
from codesift.session import work_dir

BLOCK_IDS = 1 << 20

ORDER = T.StructType([T.StructField("stream", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField("doc_id", T.LongType())])
SCAN = "stream int, block int, n_ids long, ends array<long>"


def write_streams(docs: DataFrame, folder: str, vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the ids of each input partition, with the end id after every document, as a stream of blocks.  No shuffle.

    Returns which document stands where: stream, ordinal, doc_id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, block, ordinal, size = TaskContext.get().partitionId(), 0, 0, 0
        coder = encoder(path, False)
        held: list[np.ndarray] = []
        end = np.array([END_OF_TEXT], np.uint32)
        for b in batches:
            for x in coder.encode(b.column(1)):
                held += [x.astype("<u2"), end.astype("<u2")]
                size += len(x) + 1
            while size >= block_ids:
                ids = np.concatenate(held)
                put(folder, f"{stream:08d}-{block:08d}.bin", ids[:block_ids].tobytes())
                held, size, block = [ids[block_ids:].copy()], size - block_ids, block + 1
            yield pa.RecordBatch.from_pydict({"stream": np.full(b.num_rows, stream, np.int32), "ordinal": np.arange(ordinal, ordinal + b.num_rows), "doc_id": b.column(0)}, names(ORDER))
            ordinal += b.num_rows
        if size:
            put(folder, f"{stream:08d}-{block:08d}.bin", np.concatenate(held).tobytes())

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, ORDER).write.parquet(f"{folder}-order")
    return spark.read.schema(ORDER).parquet(f"{folder}-order")


def scan_blocks(spark: SparkSession, folder: str, end_id: int = END_OF_TEXT) -> DataFrame:
    """stream, block, n_ids and the places of the end ids in every block."""
    bounded_batches(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(raw.as_buffer(), "<u2")
                stream, block = path.rsplit("/", 1)[1].split(".")[0].split("-")
                ends = pa.array([np.flatnonzero(ids == end_id).astype(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([int(stream)], pa.int32()), pa.array([int(block)], pa.int32()), pa.array([len(ids)], pa.int64()), ends], ["stream", "block", "n_ids", "ends"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return raw.select("path", "content").mapInArrow(scan, SCAN)


def stitch(blocks: DataFrame) -> DataFrame:
    """stream, ordinal, start, n_tokens (with the end id), ended."""
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    scanned = scanned.withColumn("last", F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", -1) + 1))
    carried = scanned.select("stream", "first", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("n_before"),
                             F.coalesce(F.max("last").over(before), F.lit(0)).alias("open"))
    starts = F.concat(F.array("open"), F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + F.col("first") + 1))
    rows = carried.filter(F.size("ends") > 0).select("stream", "n_before", "first", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), starts.alias("start"))))
    done = rows.select("stream", (F.col("n_before") + F.col("pos")).cast("long").alias("ordinal"), F.col("col.start").alias("start"),
                       (F.col("first") + F.col("col.end") + 1 - F.col("col.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = scanned.groupBy("stream").agg(F.sum("n_ids").alias("n"), F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max("last"), F.lit(0)).alias("start"))
    open_ = tails.filter("n > start").select("stream", F.col("ordinal").cast("long"), "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.unionByName(open_)


def count_tokens(order: DataFrame, folder: str) -> DataFrame:
    """doc_id, stream, ordinal, start, n_tokens of every document of the streams."""
    spark = order.sparkSession
    if order.isEmpty():
        return spark.createDataFrame([], "doc_id long, stream int, ordinal long, start long, n_tokens long")
    return stitch(scan_blocks(spark, folder)).join(order, ["stream", "ordinal"]).select("doc_id", "stream", "ordinal", "start", "n_tokens")


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/flat"
    order = write_streams(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return count_tokens(order, folder)
