"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one kept per group.

1. Vectors of one label are compared with each other only.  Equal vectors of a label are one node with a count.
2. Spherical k-means (unit vectors, unit centroids) splits the labels that have more than ``CELL_ROWS`` nodes into cells.
   It is fitted on a bounded sample (``FIT_ROWS`` a label, ``FIT_BYTES`` in all); every vector is then assigned.
3. A pair over the limit may lie in two cells.  If y is nearest to centroid d, and x to c, then y.(d - c) >= 0, and since
   the angle between x and y is at most ``acos(limit)``, x.(c - d) <= sin(angle) * |c - d|.  So x also visits each cell d
   that meets this bound, and no pair is lost.
4. Cells are cut into blocks of ``BLOCK_ROWS``; each block of residents meets each block of residents and visitors of its
   cell in one task, as a matrix product in double precision.  Only counts of links and a spanning set of them leave the
   task, never all pairs.  Components of the spanning links give the groups.

Cases: a label may be a number of any size or a text; null label, null or empty vector, null or non-finite component, zero vector: linked with nothing, kept; vectors of
different widths never link; repeated rows are links of each other; rows of one vec_id with different vectors share their
links; a null vec_id takes part in no link; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm.arrays import bounded_batches
from codesift.llm.graph import lowest
from codesift.operators.components import connected_components
from codesift.session import cut_lineage

LIMIT = 0.98
CELL_ROWS = 2048
BLOCK_ROWS = 1024
FIT_ROWS = 5_000
FIT_BYTES = 32 << 20
MAX_CELLS = 1024
ROUNDS = 8
SEED = 7

CELLS = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("label", T.StringType()), T.StructField("v", T.BinaryType()),
                      T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType())])
FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("root", T.LongType())])


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the largest component is divided out first, so no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit rows: assign by largest cosine, add up, scale to length one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([np.argmax(x[i: i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        length = np.sqrt((total * total).sum(axis=1))
        c[length > 1e-12] = total[length > 1e-12] / length[length > 1e-12, None]
    return c


def fit_cells(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Centroids by label, for labels with more than ``CELL_ROWS`` nodes.  Only the bounded sample reaches the driver."""
    counts = {r[0]: r[1] for r in nodes.groupBy("label").count().filter(F.col("count") > CELL_ROWS).orderBy(F.desc("count")).limit(10_000).collect()}
    if not counts:
        return {}
    share = {k: min(1.0, FIT_ROWS / n) for k, n in counts.items()}
    budget = sum(min(FIT_ROWS, n) for n in counts.values()) * nodes.agg(F.max(F.octet_length("v"))).first()[0]
    scale = min(1.0, FIT_BYTES / budget)
    # At most 10,000 rows, the labels counted above.
    rates = nodes.sparkSession.createDataFrame([(k, r * scale) for k, r in share.items()], "label string, rate double")
    drawn = F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1_000_000)) < F.col("rate") * 1_000_000
    sample = nodes.join(F.broadcast(rates), "label").filter(drawn).select("label", "node", "v").toPandas().sort_values(["label", "node"])
    out = {}
    for label, rows in sample.groupby("label"):
        x = unit(np.stack([np.frombuffer(v, np.float64) for v in rows["v"]]))
        k = min(MAX_CELLS, -(-counts[label] // (CELL_ROWS // 2)), len(x))
        if k > 1:
            out[label] = spherical_kmeans(x, k)
    return out


def _assign(cells: dict[str, np.ndarray], limit: float):
    reach = float(np.sqrt(max(0.0, 1 - limit * limit))) + 1e-9
    gaps = {k: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) * reach for k, c in cells.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(2).to_numpy(zero_copy_only=False).astype(str)
            x = [np.frombuffer(v.as_buffer(), np.float64) for v in b.column(3)]
            row, cell, home = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for k in np.unique(label).tolist():
                at = np.flatnonzero(label == k)
                if k not in cells:
                    row.append(at)
                    cell.append(np.zeros(len(at), np.int64))
                    home.append(np.ones(len(at), bool))
                    continue
                s = unit(np.stack([x[i] for i in at])) @ cells[k].T
                best = np.argmax(s, axis=1)
                near = s[np.arange(len(at)), best][:, None] - s <= gaps[k][best]
                near[np.arange(len(at)), best] = True
                r, c = np.nonzero(near)
                row.append(at[r])
                cell.append(c)
                home.append(c == best[r])
            row, cell, home = map(np.concatenate, (row, cell, home))
            took = pa.RecordBatch.from_pydict({n: b.column(i) for i, n in enumerate(("node", "n", "label", "v"))}).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell, pa.int64()), pa.array(home)], CELLS.fieldNames())

    return assign


def _compare(limit: float):
    def compare(group: pa.Table) -> pa.Table:
        """One block of residents (a) against one block (b) of residents and visitors of the cell."""
        side = group.column("side").to_numpy()
        node, n = (group.column(c).to_numpy() for c in ("node", "n"))
        x = unit(np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in group.column("v").combine_chunks()]))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        linked = (x[a] @ x[b].T >= limit) & (node[a][:, None] != node[b][None, :])
        rows, cols = lowest(linked)
        # Every link of a resident is met in its home cell, so counts are taken from residents only.
        links = linked @ n[b]
        met = cols >= 0
        out = [np.concatenate(x) for x in ((node[a], node[b][met]), (links, np.zeros(met.sum(), np.int64)), (node[a][rows], node[a][cols[met]]))]
        keep = (out[1] > 0) | (out[0] != out[2])
        return pa.table([pa.array(x[keep].astype(np.int64)) for x in out], names=FOUND.fieldNames())

    return compare


def dedup_embeddings(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    d = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), d.alias("v")).withColumn("good", good)
    # Width belongs to what is compared: vectors of different widths never link.
    named = ["label", F.size("v"), F.transform("v", lambda x: x + F.lit(0.0))]
    key = F.when(F.col("good"), F.concat(*[F.hex(F.xxhash64(F.lit(n), *named)) for n in (1, 2)]))
    rows = cut_lineage(rows.withColumn("key", key))
    width = F.size("v").cast("long")
    nodes = rows.filter("good").groupBy("key", "label", width.alias("width")).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    # What is compared is named by label and width together.
    packed = cut_lineage(_pack(nodes.select("key", "node", "n", F.concat_ws(":", "label", "width").alias("label"), "v")))
    cells = fit_cells(packed)
    assigned = cut_lineage(packed.select("node", "n", "label", "v").mapInArrow(_assign(cells, limit), CELLS))
    sizes = assigned.groupBy("label", "cell").agg(F.count_if("home").alias("n_home"), F.count(F.lit(1)).alias("n_all"))
    sizes = sizes.select("label", "cell", F.greatest(F.ceil(F.col("n_home") / BLOCK_ROWS), F.lit(1)).alias("ka"), F.greatest(F.ceil(F.col("n_all") / BLOCK_ROWS), F.lit(1)).alias("kb"))
    placed = assigned.join(sizes, ["label", "cell"])
    h = F.xxhash64("node", F.lit(3))
    left = placed.filter("home").select("*", F.pmod(h, F.col("ka")).alias("ba"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("kb") - 1)).alias("bb"), F.lit(0).alias("side"))
    right = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ka") - 1)).alias("ba"), F.pmod(h, F.col("kb")).alias("bb"), F.lit(1).alias("side"))
    pairs = left.unionByName(right).select("label", "cell", "ba", "bb", "side", "node", "n", "v")
    found = cut_lineage(pairs.groupBy("label", "cell", "ba", "bb").applyInArrow(_compare(limit), FOUND))
    links = found.groupBy("node").agg(F.sum("n_links").alias("other"))
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    parts = connected_components(edges).select("node", "root")
    result = packed.select("key", "node", "n").join(links, "node", "left").join(parts, "node", "left")
    result = result.select("key", (F.col("n") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.join(result, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.coalesce(component == F.col("vec_id"), F.lit(True))).alias("kept"))


def _pack(nodes: DataFrame) -> DataFrame:
    """The vectors as bytes of doubles."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = pa.array([x.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes() for x in b.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], v], ["key", "node", "n", "label", "v"])

    return nodes.mapInArrow(pack, "key string, node long, n long, label string, v binary")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = f"""
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
u as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as n from e),
g as (select * from u where label is not null and n > 0 and isfinite(n)),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id
    and list_dot_product(a.v, b.v) / (a.n * b.n) >= {LIMIT}),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
m as (select a, min(b) as low from r group by a), c as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(c.n, 0) as n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) as component_id,
    e.vec_id = least(e.vec_id, coalesce(m.low, e.vec_id)) as kept
from e left join m on m.a = e.vec_id left join c on c.a = e.vec_id
"""
