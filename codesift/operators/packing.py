"""Prompt batches: files picked by score under a character budget.

A batch takes, in score order, every file that still fits, up to ``max_files``;
files left over go to the next batch, until every file that fits a batch at all is
placed.  Files over the budget are reported by ``unplaced``.

Picking is sequential within a project.  A file goes into the first batch that has
room for it when its turn comes, so one pass in score order fills all batches.  A
project is cut into segments of about ``SEGMENT_FILES`` files in score order, one is
filled at a time, and the next one starts from the batches left open; every file is
read once, and no task ever sees a whole project.  Where only the first batches are
asked for, a file is out of reach when as many better files as those hold are no
larger (whenever it would fit, one of them fits too): per project and size only so
many leading files are kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.operators.aggregates import batch_tokens
from codesift.operators.features import score_filter
from codesift.operators.paths import import_neighbours, suspicion_targets
from codesift.session import cut_lineage, shuffled, work_dir

SEGMENT_FILES = 50_000  # files that one task fills between two writes, no bound on the number of segments
MAX_FILES = 10

_PLACED = "project_id string, batch_no int, place int, path string, size long, attack_score double, open boolean"


def candidates(files: DataFrame, budget: int, reach: int, order: list[Column]) -> DataFrame:
    """Files that can be picked: at most ``reach`` per size, and no file with
    ``reach`` better ones among the clearly smaller sizes."""
    fit = files.filter(F.col("size") <= budget).select("project_id", "path", F.col("size").cast("long").alias("size"), "attack_score",
                                                       F.struct(*order).alias("sort_key"))
    # Each map task forwards at most ``reach`` rows per project and size (the rank
    # limit is applied before the shuffle), however hot that key is.
    exact = Window.partitionBy("project_id", "size").orderBy("sort_key")
    lead = fit.withColumn("rn", F.row_number().over(exact)).filter(F.col("rn") <= reach).drop("rn")
    # Size classes an eighth of an octave wide; the reach-th best of all smaller
    # classes closes a class to everything behind it.
    size_class = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))) * 8).cast("int")
    classed = lead.withColumn("cls", size_class)
    best = classed.withColumn("rn", F.row_number().over(Window.partitionBy("project_id", "cls").orderBy("sort_key"))).filter(F.col("rn") <= reach)
    classes = best.select("project_id", "cls").distinct()
    smaller = (classes.withColumnRenamed("cls", "upper").join(best.select("project_id", "cls", "sort_key"), "project_id")
               .filter(F.col("cls") < F.col("upper")))
    nth = Window.partitionBy("project_id", "upper").orderBy("sort_key")
    closed = (smaller.withColumn("rn", F.row_number().over(nth)).filter(F.col("rn") == reach)
              .select("project_id", F.col("upper").alias("cls"), F.col("sort_key").alias("limit_key")))
    open_ = classed.join(closed, ["project_id", "cls"], "left")
    return open_.filter(F.col("limit_key").isNull() | (F.col("sort_key") < F.col("limit_key"))).drop("cls", "limit_key")


class Room:
    """The free room of each batch; the first batch with room enough is found in a tree of maxima."""

    def __init__(self, left: list[int], spare: int) -> None:
        self.width = 1 << max(len(left) + spare - 1, 0).bit_length()
        self.most = [-1] * self.width + left + [-1] * (self.width - len(left))
        for i in range(self.width - 1, 0, -1):
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def put(self, slot: int, left: int) -> None:
        i = slot + self.width
        self.most[i] = left
        while i > 1:
            i //= 2
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def first(self, size: int) -> int:
        """The first slot with room for ``size``, -1 if there is none."""
        if self.most[1] < size:
            return -1
        i = 1
        while i < self.width:
            i *= 2
            if self.most[i] < size:
                i += 1
        return i - self.width


def _fill(budget: int, max_files: int, max_batches: int | None):
    """Batches filled in turn, each in score order, take what one pass gives that puts every file into the first batch with room."""
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        opened = pdf[pdf["open"]].sort_values("batch_no")
        files = pdf[~pdf["open"]].sort_values("place", kind="stable")
        # Batches by slot: number, files taken, room; a full batch has room -1.
        number, taken, left = opened["batch_no"].tolist(), opened["place"].tolist(), opened["size"].tolist()
        room, last = Room(left, len(files)), max(number, default=0)
        batch_of, place_of = [], []
        for size in files["size"].tolist():
            slot = room.first(size)
            if slot < 0:
                if max_batches is not None and last >= max_batches:
                    batch_of.append(0)
                    place_of.append(0)
                    continue
                last, slot = last + 1, len(number)
                number.append(last)
                taken.append(0)
                left.append(budget)
            taken[slot] += 1
            left[slot] = left[slot] - size if taken[slot] < max_files else -1
            room.put(slot, left[slot])
            batch_of.append(number[slot])
            place_of.append(taken[slot])
        out = files.assign(batch_no=batch_of, place=place_of)
        kept = [i for i in range(len(number)) if left[i] >= 0 or number[i] == last]
        state = pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "batch_no": [number[i] for i in kept], "place": [taken[i] for i in kept],
                              "path": None, "size": [left[i] for i in kept], "attack_score": None, "open": True})
        names = ["project_id", "batch_no", "place", "path", "size", "attack_score", "open"]
        return pd.concat([out.loc[out["batch_no"] > 0, names], state[names].astype({"attack_score": float})])

    return fill


def _segments(fit: DataFrame) -> tuple[DataFrame, int]:
    """The files with the turn at which their segment of the project is filled, and the number of turns.

    A range sort by project and order cuts every project into segments of about ``SEGMENT_FILES``, however large it is.
    """
    stored = cut_lineage(fit)
    parts = max(1, -(-stored.count() // SEGMENT_FILES))
    if parts == 1:
        return stored.withColumn("turn", F.lit(0)), 1
    cut = cut_lineage(stored.repartitionByRange(parts, "project_id", "sort_key").withColumn("seg", F.spark_partition_id()))
    spans = cut.groupBy(F.col("project_id").alias("p")).agg(F.min("seg").alias("low"), F.max("seg").alias("high"))
    turns = cut.join(spans, cut["project_id"].eqNullSafe(F.col("p"))).withColumn("turn", F.col("seg") - F.col("low"))
    path = work_dir(fit.sparkSession)
    turns.drop("p", "seg", "low", "high").write.partitionBy("turn").parquet(path)
    schema = stored.withColumn("turn", F.lit(0)).schema
    return fit.sparkSession.read.schema(schema).parquet(path), 1 + (spans.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0)


def greedy_pack(files: DataFrame, budget: int, max_files: int = MAX_FILES, max_batches: int | None = None,
                order: list[Column] | None = None) -> DataFrame:
    """files(project_id, path, size, attack_score) -> (project_id, batch_no, place,
    path, size, attack_score).  Every file that fits is placed, unless the caller
    asks for the first ``max_batches`` batches only."""
    order = order or [-F.col("attack_score"), F.col("path")]
    if max_batches is None:
        fit = files.filter(F.col("size") <= budget).select("project_id", "path", F.col("size").cast("long").alias("size"), "attack_score",
                                                           F.struct(*order).alias("sort_key"))
    else:
        fit = candidates(files, budget, max_files * max_batches, order)
    ready, turns = _segments(fit)
    spark, base = files.sparkSession, work_dir(files.sparkSession)
    by_order = Window.partitionBy("project_id").orderBy("sort_key")
    for turn in range(turns):
        own = ready.filter(F.col("turn") == turn).select("project_id", F.lit(0).alias("batch_no"), F.row_number().over(by_order).alias("place"),
                                                         "path", "size", "attack_score", F.lit(False).alias("open"))
        if turn:  # with the batches that the turn before left open
            own = own.unionByName(spark.read.schema(_PLACED).parquet(f"{base}/turn={turn - 1}").filter("open"))
        own.groupBy("project_id").applyInPandas(_fill(budget, max_files, max_batches), _PLACED).write.parquet(f"{base}/turn={turn}")
    return spark.read.schema(_PLACED).parquet(base).filter("not open").select("project_id", "batch_no", "place", "path", "size", "attack_score")


def unplaced(files: DataFrame, packed: DataFrame, budget: int) -> DataFrame:
    """The files in no batch: (project_id, path, size, reason)."""
    left = files.join(shuffled(packed.select("project_id", "path")), ["project_id", "path"], "left_anti")
    reason = F.when(F.col("size") > budget, F.lit("over budget")).otherwise(F.lit("not asked for"))
    return left.select("project_id", "path", F.col("size").cast("long").alias("size"), reason.alias("reason"))


def empty_batches(files: DataFrame, packed: DataFrame, budget: int) -> DataFrame:
    """Projects with files over the budget end with one batch without files."""
    left = unplaced(files, packed, budget).select("project_id").distinct()
    last = packed.groupBy("project_id").agg(F.max("batch_no").alias("last"))
    return left.join(last, "project_id", "left").select("project_id", (F.coalesce("last", F.lit(0)) + 1).alias("batch_no"))


def with_tokens(packed: DataFrame, focus: Column) -> DataFrame:
    used = packed.groupBy("project_id", "batch_no").agg(F.sum("size").alias("used"))
    return packed.join(shuffled(used), ["project_id", "batch_no"]).withColumn("est_tokens", batch_tokens(F.col("used"), focus)).drop("used")


def pack_initial(files: DataFrame, budget: int, max_files: int = MAX_FILES) -> DataFrame:
    """First pass: all files by score."""
    return with_tokens(greedy_pack(files, budget, max_files), F.lit(False)).withColumn("is_reaudit", F.lit(False))


def pack_suspicion(files: DataFrame, notes: DataFrame, budget: int, max_files: int = MAX_FILES) -> DataFrame:
    """One batch per project: files the notes point at, then their neighbours in
    the import graph.  Projects where nothing fits have none."""
    lean = files.select("project_id", "path", "size", "attack_score", "imports")
    targets = suspicion_targets(notes, lean)
    near = import_neighbours(lean, targets)
    both = targets.withColumn("turn", F.lit(0)).unionByName(near.withColumn("turn", F.lit(1)))
    packed = greedy_pack(both, budget, max_files, 1, [F.col("turn"), -F.col("attack_score"), F.col("path")])
    return with_tokens(packed, F.lit(True)).withColumn("is_reaudit", F.lit(True))


def pack_next(files: DataFrame, seen: DataFrame, notes: DataFrame, budget: int, max_files: int = MAX_FILES) -> DataFrame:
    """Later passes: the re-audit batch is number 0, unseen files follow from 1."""
    again = pack_suspicion(files, notes, budget, max_files).withColumn("batch_no", F.lit(0))
    fresh = pack_initial(score_filter(files, seen), budget, max_files)
    return again.unionByName(fresh)
