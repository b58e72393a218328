"""Retrieve past findings for many queries at once: cluster-diverse or plain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.operators.nearest import topk_in_group

CLUSTERS = 10
PER_CLUSTER = 3
PLAIN = 10
SHOWN = 15
COMPACT = 30

NOTHING = "No relevant past vulnerability findings retrieved."
SOURCE_NAME = "Solodit audit database"


def _side(df: DataFrame, key: str, vector: str, group: Column | None = None) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), (F.lit(0) if group is None else group.cast("int")).alias("grp"),
                     F.col(vector).alias("vec"))


def vector_centroids(vectors: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """(query_id, cluster_id, similarity) of the best ``n`` centroids per vector."""
    return topk_in_group(_side(vectors, "query_id", "embedding"), _side(centroids, "cluster_id", "vector"), n).select(
        F.col("left_id").alias("query_id"), F.col("right_id").cast("int").alias("cluster_id"), F.col("score").alias("similarity"))


def topk_clusters(queries: DataFrame, centroids: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    return vector_centroids(queries, centroids, clusters)


def topk_per_cluster(queries: DataFrame, docs: DataFrame, chosen: DataFrame, per_cluster: int = PER_CLUSTER) -> DataFrame:
    """Best documents of each chosen cluster.  ``docs`` may be a table partitioned
    by cluster_id: clusters nobody chose are then not read."""
    asked = queries.join(chosen.select("query_id", "cluster_id"), "query_id")
    near = topk_in_group(_side(asked, "query_id", "embedding", F.col("cluster_id")),
                         _side(docs, "vec_id", "embedding", F.col("cluster_id")), per_cluster)
    return near.select(F.col("left_id").alias("query_id"), F.col("grp").alias("cluster_id"), F.col("right_id").alias("vec_id"),
                       F.col("score").alias("similarity"))


def retrieve_topk(queries: DataFrame, docs: DataFrame, k: int = PLAIN) -> DataFrame:
    """Plain top ``k`` over all documents, for stores without clusters."""
    near = topk_in_group(_side(queries, "query_id", "embedding"), _side(docs, "vec_id", "embedding"), k)
    return near.select(F.col("left_id").alias("query_id"), F.lit(None).cast("int").alias("cluster_id"),
                       F.col("right_id").alias("vec_id"), F.col("score").alias("similarity"))


def retrieve_diverse(queries: DataFrame, docs: DataFrame, centroids: DataFrame, clusters: int = CLUSTERS,
                     per_cluster: int = PER_CLUSTER, k: int = PLAIN) -> DataFrame:
    """queries(query_id, embedding) -> (query_id, rank, label, vec_id, similarity).

    Each query gets the best documents of its best clusters; without centroids,
    or where no document was found, the plain top ``k``.
    """
    if centroids.isEmpty():
        hits = retrieve_topk(queries, docs, k)
    else:
        chosen = topk_clusters(queries, centroids, clusters)
        hits = topk_per_cluster(queries, docs, chosen, per_cluster)
        missed = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
        if not missed.isEmpty():
            hits = hits.unionByName(retrieve_topk(missed, docs, k))
    names = centroids.select("cluster_id", "label")
    # At most clusters * per_cluster rows per query remain.
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vec_id")))
    return (hits.withColumn("rank", order).join(F.broadcast(names), "cluster_id", "left")
            .select("query_id", "rank", "label", "vec_id", "similarity"))


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    meta = docs.select("vec_id", "page_content", "severity", "protocol", "category")
    return hits.join(meta, "vec_id").select(
        "query_id", "rank", F.coalesce("label", "category", F.lit("unknown")).alias("label"),
        F.coalesce("severity", F.lit("Unknown")).alias("severity"), F.coalesce("protocol", F.lit("Unknown")).alias("protocol"),
        "page_content")


def _listed(rows: DataFrame, text: Column, sep: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["text"]), sep).alias("body"))


def retrieve_format(queries: DataFrame, found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(query_id, context): the first ``shown`` findings as text blocks."""
    block = F.concat_ws(
        "\n", F.concat(F.lit("[Finding "), F.col("rank").cast("string"), F.lit("] Category: "), "label", F.lit(" | Severity: "),
                       "severity", F.lit(" | Protocol: "), "protocol"), F.substring("page_content", 1, 400), F.lit(""))
    body = _listed(found.filter(F.col("rank") <= shown), block, "\n")
    total = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit(f" relevant vulnerability patterns from {SOURCE_NAME}:\n\n"), F.col("body"))
    return queries.select("query_id").join(body.join(total, "query_id"), "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit(NOTHING)).alias("context"))


def retrieve_compact(found: DataFrame, shown: int = COMPACT) -> DataFrame:
    """(query_id, digest): numbered short excerpts, the input of a briefing."""
    text = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "label", F.lit(" | "), "severity", F.lit(" | "), "protocol",
                    F.lit("\n"), F.regexp_replace(F.substring("page_content", 1, 300), "\n+", " "))
    return _listed(found.filter(F.col("rank") <= shown), text, "\n\n").withColumnRenamed("body", "digest")


def limit_raw_findings(found: DataFrame, n: int = SHOWN) -> DataFrame:
    return found.filter(F.col("rank") <= n)
