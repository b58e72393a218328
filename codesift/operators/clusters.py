"""k-means clusters over embedding tables: fit, assign, centroids, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.operators.nearest import topk_in_group
from codesift.session import collect_bounded, cut_lineage

N_CLUSTERS = 10
SAMPLE = 7

# ---------------------------------------------------------------------------
# Words that tell apart clusters with the same base label.
KEYWORDS = [
    "callback", "hook", "flash_loan", "delegatecall", "proxy", "permit", "signature", "deadline", "slippage", "rounding",
    "truncation", "overflow", "underflow", "sandwich", "frontrun", "backrun", "mev", "governance", "timelock", "multisig",
    "pausable", "upgrade", "initializer", "storage", "slot", "collision", "shadowing", "assembly", "selfdestruct", "create2",
    "cross_chain", "bridge", "relayer", "sequencer", "l2", "rollup", "erc20", "erc721", "erc1155", "erc4626", "erc777",
    "erc2612", "twap", "chainlink", "pyth", "uniswap", "balancer", "curve", "aave", "compound", "yield", "vault", "pool",
    "pair", "router", "factory",
]
# ---------------------------------------------------------------------------


def fit_clusters(embeddings: DataFrame, k: int = N_CLUSTERS, seed: int = 42, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """embeddings(vec_id, embedding) -> (assignments(vec_id, cluster_id),
    centroids(cluster_id, vector))."""
    vectors = embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if vectors.limit(k).count() < k:
        raise ValueError(f"too few embeddings for {k} clusters")
    model = KMeans(k=k, initMode="k-means||", seed=seed, maxIter=max_iter).fit(vectors)
    assigned = model.transform(vectors).select("vec_id", F.col("prediction").alias("cluster_id"))
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = embeddings.sparkSession.createDataFrame(centers, "cluster_id int, vector array<double>")
    return assigned, centroids


def kmeans_assign(embeddings: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, cluster_id): nearest centroid by squared distance."""
    left = embeddings.select(F.col("vec_id").alias("id"), F.lit(0).alias("grp"), F.col("embedding").alias("vec"))
    right = centroids.select(F.col("cluster_id").cast("long").alias("id"), F.lit(0).alias("grp"), F.col("vector").alias("vec"))
    return topk_in_group(left, right, 1, "l2").select(
        F.col("left_id").alias("vec_id"), F.col("right_id").cast("int").alias("cluster_id"))


def agg_centroid(assigned: DataFrame) -> DataFrame:
    """assigned(cluster_id, embedding) -> (cluster_id, vector, size); partial sums
    are built before the shuffle."""
    return assigned.groupBy("cluster_id").agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias("vector"),
        F.count(F.lit(1)).alias("size"))


def kmeans_step(embeddings: DataFrame, centroids: DataFrame) -> DataFrame:
    """One round: (cluster_id, vector, size) of the means of the vectors nearest to each centroid.  A task assigns its
    vectors and hands on one sum per centroid and component; vectors are not shuffled.  Only centroids too many to be
    held by every task take the way through :func:`kmeans_assign`."""
    held = collect_bounded(centroids.select("cluster_id", "vector"), 8 * 1024)
    if held is None:
        return agg_centroid(join_cluster_assign(embeddings, kmeans_assign(embeddings, centroids)))
    sums = embeddings.select("embedding").mapInArrow(_sums(held), "cluster_id int, pos int, value double, n long")
    total = sums.groupBy("cluster_id", "pos").agg(F.sum("value").alias("value"), F.sum("n").alias("size"))
    mean = F.sort_array(F.collect_list(F.struct("pos", (F.col("value") / F.col("size")).alias("value"))))
    return total.groupBy("cluster_id", "size").agg(F.transform(mean, lambda x: x["value"]).alias("vector")).select("cluster_id", "vector", "size")


def _sums(centroids: pd.DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task's vectors per nearest centroid; a vector without a centroid of its length is left out."""
    ordered = centroids.sort_values("cluster_id")
    vectors = [np.asarray(v, np.float64) for v in ordered["vector"]]
    by_length = {n: [i for i, v in enumerate(vectors) if len(v) == n] for n in {len(v) for v in vectors}}
    ids = ordered["cluster_id"].tolist()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(v)) for v in vectors]
        count = [0] * len(vectors)
        for b in batches:
            column = b.column(0)
            lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
            for n, own in by_length.items():
                rows = column.filter(pa.array(lengths == n))
                if not len(rows) or not n:
                    continue
                x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                far = np.stack([((x - vectors[i]) ** 2).sum(axis=1) for i in own])
                near = far.argmin(axis=0)  # ties go to the smaller id
                for k, i in enumerate(own):
                    mine = x[near == k]
                    total[i] += mine.sum(axis=0)
                    count[i] += len(mine)
        for i, v in enumerate(total):
            if count[i]:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v),
                                                  pa.array([count[i]] * len(v), pa.int64())], ["cluster_id", "pos", "value", "n"])

    return add


def fit_from(embeddings: DataFrame, starts: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``rounds`` rounds from given centroids (cluster_id, vector): (assignments, centroids).  A centroid without vectors
    stays where it is."""
    centroids = cut_lineage(starts.select("cluster_id", "vector"))
    for _ in range(rounds):
        moved = kmeans_step(embeddings, centroids).select("cluster_id", F.col("vector").alias("new"))
        centroids = cut_lineage(centroids.join(moved, "cluster_id", "left").select("cluster_id", F.coalesce("new", "vector").alias("vector")))
    return kmeans_assign(embeddings, centroids), centroids


def join_cluster_assign(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Attach cluster ids by key; vectors without a document are dropped."""
    return docs.join(assigned.select("vec_id", "cluster_id"), "vec_id")


def agg_cluster_size(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def cluster_sample(docs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """First ``n`` documents of each cluster; a large cluster is first cut in
    parts so that no task sorts it whole."""
    part = docs.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    by_part = Window.partitionBy("cluster_id", "part").orderBy("vec_id")
    cut = part.withColumn("rn", F.row_number().over(by_part)).filter(F.col("rn") <= n).drop("rn", "part")
    w = Window.partitionBy("cluster_id").orderBy("vec_id")
    return cut.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def label_clusters(docs: DataFrame, n: int = 5) -> DataFrame:
    """docs(vec_id, cluster_id, category, page_content) -> (cluster_id, label).

    The base label is the most frequent category.  Clusters after the first with
    the same base get a keyword their sample mentions, or their id.
    """
    counts = docs.groupBy("cluster_id", "category").agg(F.count(F.lit(1)).alias("n"))
    base = counts.groupBy("cluster_id").agg(F.max_by("category", F.struct("n", "category")).alias("base"))
    sample = (cluster_sample(docs.select("vec_id", "cluster_id", "page_content"), n).groupBy("cluster_id")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.lower("page_content").alias("t")))),
                                            lambda x: x["t"]), " ").alias("sample")))
    bare = F.regexp_replace("base", r"_\d+$", "")
    word = F.get(F.filter(F.array(*[F.lit(k) for k in KEYWORDS]),
                          lambda k: F.col("sample").contains(F.replace(k, F.lit("_"), F.lit("")))
                          & ~bare.contains(F.replace(k, F.lit("_"), F.lit("")))), F.lit(0))
    # One row per cluster from here on: clusters sharing a base are few.
    turn = F.row_number().over(Window.partitionBy("base").orderBy("cluster_id"))
    named = base.join(sample, "cluster_id").withColumn("turn", turn).select(
        "cluster_id", "base", "turn",
        F.concat_ws("_", bare, F.coalesce(word, F.col("cluster_id").cast("string"))).alias("second"))
    repeat = F.row_number().over(Window.partitionBy("base", "second", F.col("turn") > 1).orderBy("cluster_id"))
    label = (F.when(F.col("turn") == 1, F.col("base")).when(repeat == 1, F.col("second"))
             .otherwise(F.concat_ws("_", "second", F.col("cluster_id").cast("string"))))
    return named.select("cluster_id", F.replace(label, F.lit("-"), F.lit("_")).alias("label"))


def build_store(docs: DataFrame, k: int = N_CLUSTERS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Cluster, attach and label: docs(vec_id, embedding, category, page_content)
    -> (clustered docs, centroids with label and size)."""
    assigned, centroids = fit_clusters(docs, k, seed)
    clustered = cut_lineage(join_cluster_assign(docs, assigned))
    rows = centroids.join(label_clusters(clustered), "cluster_id", "left").join(agg_cluster_size(clustered), "cluster_id", "left")
    return clustered, rows.select(
        "cluster_id", F.coalesce("label", F.concat(F.lit("cluster-"), F.col("cluster_id").cast("string"))).alias("label"), "vector",
        F.coalesce("size", F.lit(0)).alias("size"))
