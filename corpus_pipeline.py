"""From raw documents to packed sequences: each stage is written as Parquet and read again by the next.

1. ``quality``: documents that the byte-level network rejects go.
2. ``near_copies``: of each group of near copies one document stays.
3. ``pii``: personal data is replaced by its kind.
4. ``mixing``: documents are dropped or repeated so that the sources meet their target weights.
5. ``packing``: the texts become pieces of sequences of 1,024 tokens.

All but the last return the columns of ``documents``.  Each stage works on all that the stage before it kept.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from codesift.llm.mixing import mix_documents  # noqa: E402
from codesift.llm.ngram_join import drop_near_copies  # noqa: E402
from codesift.llm.packing import pack_documents  # noqa: E402
from codesift.llm.pii import mask_pii  # noqa: E402
from codesift.llm.quality_net import keep_good  # noqa: E402
from codesift.session import work_dir  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_copies", near_copies), ("pii", pii), ("mixing", mixing), ("packing", packing)]

# A trained network, random rounding and a tokenizer cannot be written in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared work folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = work_dir(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
