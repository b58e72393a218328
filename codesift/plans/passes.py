"""Audit passes over many projects: which files go into which batch of which pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.operators.aggregates import code_budget, coverage
from codesift.operators.packing import MAX_FILES, pack_initial, pack_next
from codesift.operators.paths import confidence_filter
from codesift.session import cut_lineage


def plan_passes(files: DataFrame, notes: DataFrame, max_passes: int = 3, min_confidence: float = 0.7, budget: int | None = None,
                max_files: int = MAX_FILES) -> DataFrame:
    """files, notes(project_id, pass_no, target_file, confidence, ...) ->
    (project_id, pass_no, batch_no, place, path, size, est_tokens, is_reaudit).

    A project stops when a pass has no batch for it, or when the pass left no
    confident note and all its high-scored files were seen.  Each pass is written
    to the shared folder, so the plan of a pass does not hold those before it.
    """
    budget = code_budget() if budget is None else budget
    strong = confidence_filter(notes, min_confidence)
    active = files.select("project_id").distinct()
    done: DataFrame | None = None
    for pass_no in range(1, max_passes + 1):
        own = files.join(active, "project_id", "left_semi")
        if pass_no == 1:
            batches = pack_initial(own, budget, max_files)
        else:
            last = strong.filter(F.col("pass_no") == pass_no - 1).join(active, "project_id", "left_semi")
            batches = pack_next(own, done, last, budget, max_files)
        batches = cut_lineage(batches.withColumn("pass_no", F.lit(pass_no)))
        if batches.isEmpty():
            break
        done = batches if done is None else done.unionByName(batches)
        told = strong.filter(F.col("pass_no") == pass_no).select("project_id").distinct().withColumn("told", F.lit(True))
        state = coverage(own, done).join(told, "project_id", "left")
        going = state.filter(F.coalesce("told", F.lit(False)) | ~F.col("covered")).select("project_id")
        active = cut_lineage(going.join(batches.select("project_id").distinct(), "project_id", "left_semi"))
    if done is None:
        raise ValueError("no file fits a batch")
    return done.select("project_id", "pass_no", "batch_no", "place", "path", "size", "est_tokens", "is_reaudit")
