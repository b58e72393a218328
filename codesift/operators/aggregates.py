"""Per-project and per-run figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token budgets of a prompt.
MAP_TOKENS = 2_000
CONTEXT_TOKENS = 4_800
FOCUS_TOKENS = 800
THINKING_TOKENS = 6_000
OUTPUT_TOKENS = 4_096
CHARS_PER_TOKEN = 4


def code_budget(context: int = 65_536, thinking: bool = False) -> int:
    """Characters of code that fit a prompt."""
    free = context - MAP_TOKENS - CONTEXT_TOKENS - FOCUS_TOKENS - OUTPUT_TOKENS - (THINKING_TOKENS if thinking else 0)
    return max(free, 0) * CHARS_PER_TOKEN


def batch_tokens(used_chars: Column, focus: Column) -> Column:
    """Estimated tokens of a batch from the characters of its files."""
    return (F.floor(used_chars / CHARS_PER_TOKEN + 0.5) + MAP_TOKENS + CONTEXT_TOKENS
            + F.when(focus, FOCUS_TOKENS).otherwise(0)).cast("long")


def classify_projects(files: DataFrame, context: int = 65_536, thinking: bool = False) -> DataFrame:
    budget = code_budget(context, thinking)
    total = F.col("total_chars")
    size = F.when(total <= budget * 0.85, "small").when(total <= budget * 3.0, "medium").otherwise("large")
    return files.groupBy("project_id").agg(F.sum("size").alias("total_chars")).withColumn("project_size", size)


def dominant_language(files: DataFrame) -> DataFrame:
    counts = files.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("project_id").agg(F.max_by("language", F.struct("n", "language")).alias("language"))


def coverage(files: DataFrame, seen: DataFrame, above: float = 0.3) -> DataFrame:
    """(project_id, covered): all files with a high score were seen."""
    marked = files.join(seen.select("project_id", "path").distinct().withColumn("seen", F.lit(True)), ["project_id", "path"], "left")
    ok = (F.col("attack_score") <= above) | F.coalesce("seen", F.lit(False))
    return marked.groupBy("project_id").agg(F.bool_and(ok).alias("covered"))


def response_status(responses: DataFrame, findings: DataFrame) -> DataFrame:
    """(auditor_id, status, n): failed without text, empty without findings."""
    counts = findings.groupBy("resp_id").agg(F.count(F.lit(1)).alias("n_findings"))
    status = (F.when(F.col("raw").isNull(), "failed").when(F.coalesce("n_findings", F.lit(0)) > 0, "ok").otherwise("empty"))
    return (responses.join(counts, "resp_id", "left").withColumn("status", status)
            .groupBy("auditor_id", "status").agg(F.count(F.lit(1)).alias("n")))


def run_stats(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files read, without findings, unreadable, and chunks written."""
    per_file = chunks.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_chunks"))
    n = F.coalesce("n_chunks", F.lit(0))
    return reports.join(per_file, "rel_path", "left").agg(
        F.count_if(F.col("content").isNotNull() & (n > 0)).alias("processed"),
        F.count_if(F.col("content").isNotNull() & (n == 0)).alias("empty"),
        F.count_if(F.col("content").isNull()).alias("skipped"), F.sum(n).alias("chunks"))
