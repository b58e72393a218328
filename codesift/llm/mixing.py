"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should have.  The whole part is taken as it
is; the fractions are rounded so that the words taken stay on target: two documents with fractional probabilities trade
mass along the direction that keeps ``size * probability`` constant until one of them is 0 or 1, at random with the
chances that keep every document's expectation.  Each group of documents leaves at most one fraction, and the residual
documents of ``FAN_IN`` groups meet again in the next level of a reduction tree.  What is left at the root of a source is
rounded to the nearer side, so a source misses its target by at most half a document.

Groups are hash buckets of the rows, whose number follows the source's rows; a hot source has many groups and no task
holds more than a few groups' rows of (key, size, probability).  Random numbers are hashes of the rows and the seed, so
reruns agree, whatever the partitions.

Cases: null text has size 0 and is taken as often as its chance says; a null source is the last source; rows that agree
in doc_id, source and text count as copies of one unit and share its takes evenly; an empty table gives no rows; a table
without words has targets 0; other columns are not read by ``plan_mix`` and come back unchanged from ``mix_documents``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codesift.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
GROUP_ROWS = 4096
FAN_IN = 64
SEED = 20
_EPS = 1e-9


def size_of(text) -> F.Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """The sources numbered from 0 in the order of their code points, null last: a range sort, then the place within a
    range plus the rows of the ranges before it, so no task holds all sources."""
    order = F.col("source").asc_nulls_last()
    ranged = cut_lineage(sizes.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    before = ranged.groupBy("range").count().select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1)
    return placed.join(before, "range").select("source", "source_size", (F.col("before") + F.col("place")).alias("rank"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also target.  ``sizes`` has one row a source.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  A target stops at three times the source's size
    and the excess goes to the others by weight, until none is above: each round needs the two sums of the free and the
    stopped sources only.
    """
    ranked = _numbered(sizes)
    ranked = cut_lineage(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size").cast("double") * MAX_COPIES
    unit, stopped = 0.0, -1
    while True:
        over = F.col("weight") * unit > limit
        free, held, n = ranked.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, limit)), F.count_if(over)).first()
        if n == stopped or not free:
            break
        unit, stopped = (total - (held or 0.0)) / free, n
    target = F.least(F.col("weight") * F.lit(float(unit)), limit)
    return ranked.select("source", "source_size", target.alias("target"))


def _round(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Probabilities after trading mass in the given order; at most one is still fractional.  ``u`` are uniform."""
    p = p.tolist()
    size = size.tolist()
    u = u.tolist()
    i = -1
    for j in range(len(p)):
        if not _EPS < p[j] < 1 - _EPS:
            p[j] = float(p[j] > 0.5)
            continue
        if i < 0:
            i = j
            continue
        a, b = size[i], size[j]
        up = min((1 - p[i]) * a, p[j] * b)
        down = min(p[i] * a, (1 - p[j]) * b)
        move = up if u[j] < down / (up + down) else -down
        p[i] += move / a
        p[j] -= move / b
        settled_i, settled_j = not _EPS < p[i] < 1 - _EPS, not _EPS < p[j] < 1 - _EPS
        if settled_i:
            p[i] = float(p[i] > 0.5)
        if settled_j:
            p[j] = float(p[j] > 0.5)
        i = (-1 if settled_j else j) if settled_i else i
    return np.array(p)


UNIT = T.StructType([T.StructField("key", T.LongType()), T.StructField("source", T.StringType()), T.StructField("bucket", T.LongType()),
                     T.StructField("size", T.LongType()), T.StructField("p", T.DoubleType())])


def _level(units: DataFrame, level: int) -> DataFrame:
    """Rounds within each (source, bucket)."""
    spread = F.xxhash64("key", F.lit(SEED), F.lit(level))
    named = units.select("key", "source", "bucket", "size", "p", spread.alias("h"))

    def trade(group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy()
        # Large documents first: what is still open at the end is then mostly a small one.
        order = np.lexsort((group.column("key").to_numpy(), h, -group.column("size").to_numpy()))
        x = h.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        p = np.empty(len(h))
        p[order] = _round(group.column("size").to_numpy()[order], group.column("p").to_numpy()[order], u[order])
        return pa.table([*(group.column(c) for c in ("key", "source", "bucket", "size")), pa.array(p)], names=UNIT.fieldNames())

    return named.groupBy("source", "bucket").applyInArrow(trade, UNIT)


def round_units(units: DataFrame) -> DataFrame:
    """units (key, source, size > 0, p in (0, 1)) -> (key, take).  Level by level of the tree, each written once."""
    spark = units.sparkSession
    counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    groups = F.ceil(F.col("n") / GROUP_ROWS)
    counts = counts.select(F.col("source").alias("s"), groups.alias("groups"))
    bucketed = units.join(counts, F.col("source").eqNullSafe(F.col("s"))).select("key", "source", F.pmod(F.xxhash64("key"), F.col("groups")).alias("bucket"), "size", "p")
    most = (counts.agg(F.max("groups")).first()[0]) or 1
    level, done = 0, None
    state = cut_lineage(_level(bucketed, level))
    while True:
        settled = state.filter(F.col("p").isin(0.0, 1.0)).select("key", F.col("p").cast("long").alias("take"))
        done = settled if done is None else done.unionByName(settled)
        rest = state.filter(~F.col("p").isin(0.0, 1.0))
        if most <= 1:
            return done.unionByName(rest.select("key", (F.col("p") >= 0.5).cast("long").alias("take")))
        level, most = level + 1, -(-most // FAN_IN)
        state = cut_lineage(_level(rest.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)), level))


def plan_mix(docs: DataFrame) -> DataFrame:
    """How often to take each unit: key (a hash of doc_id, source and text), doc_id, source, size, n (rows of the unit),
    source_size, target, takes (for all its rows together)."""
    key = F.xxhash64("doc_id", "source", "text", F.col("text").isNull(), F.col("source").isNull(), F.col("doc_id").isNull())
    rows = docs.select(key.alias("key"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    units = cut_lineage(rows.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes).withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_COPIES)))).otherwise(0.0)
    units = units.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("copies", F.col("n") * rate)
    units = units.withColumn("whole", F.floor(F.col("copies") + _EPS).cast("long"))
    units = units.withColumn("p", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))
    open_ = units.filter((F.col("p") > _EPS) & (F.col("size") > 0)).select("key", "source", "size", "p")
    takes = round_units(open_)
    blank = F.when((F.col("size") == 0) & (F.col("p") > _EPS), ((F.xxhash64("key", F.lit(SEED)).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / float(1 << 53) < F.col("p")).cast("long"))
    return units.join(takes, "key", "left").select("key", "doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.coalesce("take", blank, F.lit(0))).alias("takes"))


def _each(total, n, k):
    """Takes of the k-th (from 1) of n equal rows that share ``total``."""
    return F.floor(total / n) + (k <= total % n).cast("long")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the input's columns; a document taken twice stands there twice."""
    own = f"mix_{uuid.uuid4().hex}"  # no column of the input is named so
    key = F.xxhash64("doc_id", "source", "text", F.col("text").isNull(), F.col("source").isNull(), F.col("doc_id").isNull())
    plan = cut_lineage(plan_mix(docs).filter("takes > 0").select(F.col("key").alias(f"{own}_k"), F.col("n").alias(f"{own}_n"), F.col("takes").alias(f"{own}_takes")))
    keyed = docs.withColumn(f"{own}_key", key)
    taken = keyed.join(plan.filter(f"{own}_n = 1"), F.col(f"{own}_key") == F.col(f"{own}_k")).withColumn(f"{own}_t", F.col(f"{own}_takes"))
    if not plan.filter(f"{own}_n > 1").isEmpty():
        # Rows of one unit are numbered by runs of the scan, so that a unit with very many rows is spread.
        runs = keyed.withColumn(f"{own}_run", F.floor(F.monotonically_increasing_id() / GROUP_ROWS))
        more = cut_lineage(runs.join(plan.filter(f"{own}_n > 1"), F.col(f"{own}_key") == F.col(f"{own}_k")))
        counts = more.groupBy(f"{own}_key", f"{own}_run").count()
        before = counts.select(f"{own}_key", f"{own}_run", (F.sum("count").over(Window.partitionBy(f"{own}_key").orderBy(f"{own}_run")) - F.col("count")).alias(f"{own}_before"))
        place = F.row_number().over(Window.partitionBy(f"{own}_key", f"{own}_run").orderBy(F.lit(1)))
        placed = more.withColumn(f"{own}_r", place).join(before, [f"{own}_key", f"{own}_run"]).withColumn(f"{own}_r", F.col(f"{own}_r") + F.col(f"{own}_before"))
        taken = taken.unionByName(placed.withColumn(f"{own}_t", _each(F.col(f"{own}_takes"), F.col(f"{own}_n"), F.col(f"{own}_r"))).drop(f"{own}_r", f"{own}_run", f"{own}_before")).filter(f"{own}_t > 0")
    return taken.withColumn(f"{own}_i", F.explode(F.sequence(F.lit(1), F.col(f"{own}_t").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = plan.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _each(F.col("takes"), F.col("n"), F.col("k"))).alias("taken"))
