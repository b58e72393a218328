"""Queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codesift.llm.centroid_clusters import OP11_SQL, op11_pca_clusters
from codesift.llm.embedding_dedup import OP5_SQL, op5_embedding_dedup
from codesift.llm.fill_middle import OP13_SQL, op13_fill_middle
from codesift.llm.mixing import op6_pivotal_mixing
from codesift.llm.ngram_join import OP1_SQL, op1_ngram_join
from codesift.llm.packing import op4_vector_packing
from codesift.llm.pii import op3_pii
from codesift.llm.quality_net import op7_quality_net
from codesift.llm.quality_rules import OP8_SQL, op8_quality_cascade
from codesift.llm.sharding import op12_label_sharding
from codesift.llm.substring_dedup import op10_collinear_chaining
from codesift.llm.token_counts import op9_separator_scan
from codesift.llm.token_files import op2_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_join, op2_token_files, op3_pii, op4_vector_packing, op5_embedding_dedup, op6_pivotal_mixing, op7_quality_net,
    op8_quality_cascade, op9_separator_scan, op10_collinear_chaining, op11_pca_clusters, op12_label_sharding,
    op13_fill_middle)}

SQL: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op5_embedding_dedup": OP5_SQL, "op8_quality_cascade": OP8_SQL,
                       "op11_pca_clusters": OP11_SQL, "op13_fill_middle": OP13_SQL}
