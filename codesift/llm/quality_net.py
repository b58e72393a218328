"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by the filter width less one, so that every window of bytes of
the whole text lies in a chunk.  Bytes are embedded, ``FILTERS`` learned filters run over every window of ``WIDTH`` bytes,
and each filter's largest answer in a chunk is kept (max-pooling).  The mean and the largest of the chunks' answers, for
each filter, are combined into one probability that the text is good.

The network is fitted on the driver with Adam on chunks of a bounded sample of labelled documents (``FIT_DOCS`` of each
class, up to ``FIT_CHUNKS`` chunks from all over each), and applied to every whole text in a narrow job.  Labels of rows with
crc32(doc_id) mod 3 = 1 are held out; labels, lang, source and doc_id are never inputs.

Cases: null and empty texts are one chunk of padding and have a score like any other; equal texts have equal scores; null
labels and labels without a document are not learned from; without labels of both classes every score is 0.5; an empty
table gives no rows; other columns are not read by ``score_quality`` and come back unchanged from ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm.arrays import bounded_batches, flat, slices

CHUNK = 512
WIDTH = 8
FILTERS = 16
EMBED = 4
STEP = CHUNK - WIDTH + 1

FIT_DOCS = 1200
FIT_CHUNKS = 6
ROUNDS = 600
BATCH_DOCS = 48
SEED = 3

HELD_OUT = "coalesce(pmod(crc32(cast(doc_id as string)), 3) = 1, false)"


@dataclass
class Net:
    table: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    top: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> Net:
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(257, EMBED, scale=0.5), draw(WIDTH * EMBED, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, scale=0.1), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.conv, self.bias, self.head, self.top]

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Largest answer of each filter in each chunk (chunks x CHUNK of symbols 0..256), and its place if asked for."""
        n = len(chunks)
        x = self.table[chunks].reshape(n, CHUNK * EMBED)
        best = np.full((n, FILTERS), -np.inf, np.float32)
        at = np.zeros((n, FILTERS), np.int32)
        for o in range(WIDTH):
            k = (CHUNK - o) // WIDTH
            y = x[:, o * EMBED: (o + k * WIDTH) * EMBED].reshape(n * k, WIDTH * EMBED) @ self.conv
            y = y.reshape(n, k, FILTERS)
            top = y.max(axis=1)
            if where:
                at = np.where(top > best, y.argmax(axis=1) * WIDTH + o, at)
            best = np.maximum(best, top)
        best = np.maximum(best + self.bias, 0)
        return (best, at) if where else best

    def combine(self, pooled: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of each document from its chunks' answers."""
        total = np.add.reduceat(pooled, offs[:-1], axis=0) / np.diff(offs)[:, None]
        most = np.maximum.reduceat(pooled, offs[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip(np.concatenate([total, most], axis=1) @ self.head + self.top, -30, 30)))


def chunked(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts as symbols (byte + 1, padding 0), and the chunks before each text."""
    size = np.diff(offs)
    count = np.maximum(1, -(-(size - WIDTH + 1) // STEP))
    coffs = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(size)), count)
    start = (np.arange(int(coffs[-1])) - coffs[doc]) * STEP
    left = size[doc] - start
    at = (offs[:-1][doc] + start)[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros((len(doc), CHUNK), np.uint16), coffs
    out = data[np.minimum(at, len(data) - 1)].astype(np.uint16) + np.uint16(1)
    out[np.arange(CHUNK) >= left[:, None]] = 0
    return out, coffs


def fit(chunks: np.ndarray, offs: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Net:
    """Adam on the cross-entropy; classes are drawn evenly."""
    net, rng = Net.fresh(seed), np.random.default_rng(seed)
    sides = [np.flatnonzero(label == v) for v in (0, 1)]
    m, v = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    for step in range(1, rounds + 1):
        docs = np.concatenate([rng.choice(s, BATCH_DOCS // 2) for s in sides])
        rows = np.concatenate([np.arange(offs[d], offs[d + 1]) for d in docs])
        at = np.concatenate([[0], np.cumsum(offs[docs + 1] - offs[docs])])
        x = chunks[rows]
        pooled, where = net.pooled(x, True)
        p = net.combine(pooled, at)
        g = ((p - label[docs]) / len(docs)).astype(np.float32)
        count = np.diff(at)
        doc = np.repeat(np.arange(len(docs)), count)
        mean, most = np.add.reduceat(pooled, at[:-1], axis=0) / count[:, None], np.maximum.reduceat(pooled, at[:-1], axis=0)
        g_head = np.concatenate([mean, most], axis=1).T @ g
        g_pool = (g / count)[doc, None] * net.head[:FILTERS] + g[doc, None] * net.head[FILTERS:] * ((pooled == most[doc]) & (pooled > 0))
        g_pool = np.where(pooled > 0, g_pool, 0).astype(np.float32)
        spots = where[:, :, None] + np.arange(WIDTH)
        symbols = x[np.arange(len(x))[:, None, None], spots]
        e = net.table[symbols].reshape(len(x), FILTERS, WIDTH * EMBED)
        g_conv = np.einsum("nf,nfk->kf", g_pool, e)
        g_table = np.zeros_like(net.table)
        np.add.at(g_table, symbols, (g_pool[:, :, None] * net.conv.T[None]).reshape(len(x), FILTERS, WIDTH, EMBED))
        rate = 0.01 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for i, (w, d) in enumerate(zip(net.parts(), [g_table, g_conv, g_pool.sum(axis=0), g_head + 1e-4 * net.head, np.array([g.sum()], np.float32)])):
            m[i] += 0.1 * (d - m[i])
            v[i] += 0.01 * (d * d - v[i])
            w -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


SAMPLE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("chunks", T.BinaryType())])


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, offsets, labels) of at most ``per_class`` documents a class, the smallest by a hash of doc_id."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(f"doc_id is not null and quality in (0, 1) and not {HELD_OUT}").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    known = known.filter("label = other").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    spread = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    picked = [r for v in (0, 1) for r in known.filter(F.col("label") == v).orderBy(*spread).limit(per_class).collect()]
    # At most 2 * per_class pairs of numbers, so the small side of the join has a fixed bound.
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.label) for r in picked], "doc_id long, label int")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(2))
            out = []
            for i, d in enumerate(b.column(0).to_pylist()):
                c, _ = chunked(data[offs[i]: offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
                rng = np.random.default_rng(abs(d))
                out.append(c[np.sort(rng.choice(len(c), min(FIT_CHUNKS, len(c)), replace=False))].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], SAMPLE.fieldNames())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(take, SAMPLE).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, bytes(r.chunks)))
    found = [np.frombuffer(bytes(r.chunks), np.uint16).reshape(-1, CHUNK) for r in rows]
    if not found:
        return np.zeros((0, CHUNK), np.uint16), np.zeros(1, np.int64), np.zeros(0)
    return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]), np.array([r.label for r in rows], float)


def fit_quality(docs: DataFrame, labels: DataFrame) -> Net | None:
    """The network fitted on the bounded sample, or None without both classes.

    Training sees the classes evenly; the intercept then moves by the log of their shares among all labels that may be
    learned from, so that 0.5 is the limit of the likelier class.
    """
    chunks, offs, label = training_sample(docs, labels)
    if len(set(label.tolist())) < 2:
        return None
    net = fit(chunks, offs, label)
    bad, good = labels.filter(f"not {HELD_OUT}").selectExpr("count_if(quality = 0)", "count_if(quality = 1)").first()
    net.top += np.float32(np.log(good / bad))
    return net


SCORES = T.StructType([T.StructField("score", T.DoubleType())])


def scorer(net: Net | None):
    """A function from a text column to probabilities."""
    def score(column: pa.Array) -> np.ndarray:
        if net is None:
            return np.full(len(column), 0.5)
        data, offs = flat(column)
        out = np.empty(len(column))
        for i, j in slices(offs, 64 << 10):
            c, coffs = chunked(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
            pooled = np.concatenate([net.pooled(c[k: k + 128]) for k in range(0, len(c), 128)])
            out[i:j] = net.combine(pooled, coffs)
        return out

    return score


def score_quality(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    score = scorer(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *SCORES.fields]))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is 0.5 or more, with the input's columns."""
    bounded_batches(docs.sparkSession)
    score = scorer(fit_quality(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(b.column(at)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
