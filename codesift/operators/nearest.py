"""Exact nearest neighbours inside groups, without emitting all pairs.

Both sides are tables of vectors with a group column.  For each left row the best
``k`` right rows of its group are found.  A matrix product inside the task does
the scoring; only the best rows leave it.  A side that fits the broadcast bound
is held by every task, otherwise both sides are cut into blocks and matched block
by block, so a group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.session import collect_bounded

LEFT_BLOCK = 2_048
RIGHT_BLOCK = 16_384

CHUNK = 512  # left rows scored at a time

# Cosines are rounded so that equal vectors tie and ids decide.
DIGITS = 6


def _scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return -(np.square(a).sum(1)[:, None] - 2 * a @ b.T + np.square(b).sum(1)[None, :])
    na, nb = np.sqrt(np.square(a).sum(1)), np.sqrt(np.square(b).sum(1))
    norm = na[:, None] * nb[None, :]
    return np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0)


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _by_length(vectors) -> dict[int, np.ndarray]:
    """Positions of the vectors by their length; other lengths score 0."""
    sizes = np.fromiter((len(v) for v in vectors), dtype=np.int64, count=len(vectors))
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def _score_matrix(left, right, metric: str) -> np.ndarray:
    out = np.zeros((len(left), len(right)))
    ls, rs = _by_length(left), _by_length(right)
    for n, li in ls.items():
        if n in rs and n > 0:
            ri = rs[n]
            out[np.ix_(li, ri)] = _scores(_stack([left[i] for i in li]), _stack([right[i] for i in ri]), metric)
    return np.round(out, DIGITS) + 0.0 if metric == "cosine" else out


def _best(left_id, left_vec, right_id, right_vec, group, k: int, metric: str) -> pd.DataFrame:
    """Top ``k`` right rows per left row of one block pair; ties go to the smaller id."""
    left_id, order = np.asarray(left_id), np.argsort(np.asarray(right_id), kind="stable")
    right_id, right_vec = np.asarray(right_id)[order], [right_vec[i] for i in order]
    parts = []
    for start in range(0, len(left_vec), CHUNK):
        score = _score_matrix(left_vec[start:start + CHUNK], right_vec, metric)
        n = min(k, score.shape[1])
        if n == 1:
            rows, cols = np.arange(len(score)), score.argmax(axis=1)
        else:
            cut = np.partition(score, -n, axis=1)[:, -n]
            rows, cols = np.nonzero(score >= cut[:, None])
            ranked = np.lexsort((cols, -score[rows, cols], rows))
            rows, cols = rows[ranked], cols[ranked]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols = rows[place < n], cols[place < n]
        parts.append(pd.DataFrame({"left_id": left_id[start:start + CHUNK][rows], "grp": group, "right_id": right_id[cols],
                                   "score": score[rows, cols]}))
    return pd.concat(parts, ignore_index=True)


_SCHEMA = "left_id long, grp int, right_id long, score double"


def _shrink(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    df = pd.concat(parts, ignore_index=True).sort_values(["left_id", "grp", "score", "right_id"], ascending=[True, True, False, True])
    return df.groupby(["left_id", "grp"], sort=False).head(k)


def _small_side(side: DataFrame, row_bytes: int) -> dict[int, tuple[np.ndarray, list]] | None:
    pdf = collect_bounded(side.select("id", "grp", "vec"), row_bytes)
    return None if pdf is None else {int(g): (p["id"].to_numpy(), list(p["vec"])) for g, p in pdf.groupby("grp")}


def topk_in_group(left: DataFrame, right: DataFrame, k: int, metric: str = "cosine", dim_hint: int = 1024) -> DataFrame:
    """left(id, grp, vec), right(id, grp, vec) -> (left_id, grp, right_id, score)
    holding the best ``k`` right rows for every left row and group."""
    row_bytes = 8 * dim_hint
    small = _small_side(left, row_bytes)
    if small is not None:

        def from_right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: dict[int, pd.DataFrame] = {}
            for pdf in batches:
                for g, part in pdf.groupby("grp"):
                    if g in small:
                        ids, vecs = small[g]
                        best = _best(ids, vecs, part["id"].to_numpy(), list(part["vec"]), g, k, metric)
                        kept[g] = _shrink([kept[g], best], k) if g in kept else best
            yield from kept.values()

        groups = sorted(small)
        near = right.filter(F.col("grp").isin(groups)).select("id", "grp", "vec").mapInPandas(from_right, _SCHEMA)
    elif (small := _small_side(right, row_bytes)) is not None:

        def from_left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, part in pdf.groupby("grp"):
                    if g in small:
                        ids, vecs = small[g]
                        yield _best(part["id"].to_numpy(), list(part["vec"]), ids, vecs, g, k, metric)

        return left.select("id", "grp", "vec").mapInPandas(from_left, _SCHEMA)
    else:
        near = _blocked(left, right, k, metric)
    w = Window.partitionBy("left_id", "grp").orderBy(F.col("score").desc(), F.col("right_id"))
    return near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def _blocked(left: DataFrame, right: DataFrame, k: int, metric: str,
             left_block: int = LEFT_BLOCK, right_block: int = RIGHT_BLOCK) -> DataFrame:
    """Match every left block of a group with every right block of it."""
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    counts = blocks(left, left_block, "nl").join(blocks(right, right_block, "nr"), "grp")

    def cut(df: DataFrame, own: str, other: str, own_col: str, other_col: str) -> DataFrame:
        return (df.join(counts, "grp")
                .withColumn(own_col, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
                .withColumn(other_col, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .select("grp", "lb", "rb", "id", "vec"))

    def match(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"left_id": [], "grp": [], "right_id": [], "score": []})
        return _best(lp["id"].to_numpy(), list(lp["vec"]), rp["id"].to_numpy(), list(rp["vec"]), int(lp["grp"].iloc[0]), k, metric)

    lcut = cut(left, "nl", "nr", "lb", "rb").groupBy("grp", "lb", "rb")
    rcut = cut(right, "nr", "nl", "rb", "lb").groupBy("grp", "lb", "rb")
    return lcut.cogroup(rcut).applyInPandas(match, _SCHEMA)
