"""Exact integer k-means over vectors, with centroids ruled out in a PCA-rotated space.

1. Vectors of the wanted width become integers ``floor(scale * x)``.  A bounded sample gives their principal axes; each
   vector is stored once with its ``LEADING`` rotated coordinates and the norm of the rest.
2. For a vector x and a centroid c, the squared distance of the leading coordinates plus the squared difference of the two
   residual norms is never above the squared distance of x and c.  A round measures the centroid of the least bound in
   integers, and then, again in integers, only centroids whose bound (less the error of its arithmetic) is not above that.
3. A round leaves a task as sums per centroid: counts and component sums, as 32-bit limbs, so sums of any size are exact.
   Spark adds them up; the driver holds the centroids, ``k`` times ``width`` numbers.

Vectors are never shuffled.  The stored table lies in the shared folder, so a lost executor costs its tasks only.

Cases: a null vector, another width, and null or non-finite components are left out; a null vec_id is hashed as no digits;
repeated rows each count, and equal hashes go by the vector's components; fewer than ``k`` vectors start as many centroids;
components beyond 2**27 in integers are compared exactly in unbounded integers, and a distance or sum that a long cannot
hold is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm.arrays import bounded_batches, spread
from codesift.session import cut_lineage

WIDTH = 64
SCALE = 1024
K = 8
ROUNDS = 10
LEADING = 16
SEED = 3
# Rows from which the axes are learned; they steer only how many centroids are ruled out.
FIT_ROWS = 10_000
# Integers up to here have squared distances that fit in a long.
_SMALL = 1 << 27
_LIMB = 32

STORED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("ints", T.BinaryType()), T.StructField("wide", T.ArrayType(T.StringType())),
                       T.StructField("lead", T.BinaryType())])
SUMS = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("limb", T.IntegerType()), T.StructField("amount", T.LongType())])
NEAREST = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("exact", T.StringType())])


def whole(x: float, scale: int) -> int:
    """floor(scale * x) without rounding or overflow."""
    a, b = float(x).as_integer_ratio()
    return scale * a // b


def principal_axes(x: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the leading axes (width x leading) of rows."""
    if not len(x):
        return np.zeros(x.shape[1]), np.eye(x.shape[1])[:, :leading]
    mean = x.mean(axis=0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    return mean, vectors[:, ::-1][:, :leading].copy()


def rotate(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates and, last, the norm of the rest."""
    y = (x - mean) @ axes
    rest = (x - mean) - y @ axes.T
    return np.column_stack([y, np.sqrt((rest * rest).sum(axis=1))])


def nearest(x: np.ndarray, lead: np.ndarray, c: np.ndarray, c_lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of integer rows, and the number of distances measured."""
    d = lead[:, None, :] - c_lead[None, :, :]
    bound = (d * d).sum(axis=2)
    size = (lead * lead).sum(axis=1)[:, None] + (c_lead * c_lead).sum(axis=1)[None, :]
    bound -= 1e-9 * size + 1e-6
    first = bound.argmin(axis=1)
    gap = x - c[first]
    best = (gap * gap).sum(axis=1)
    open_ = bound <= best[:, None].astype(np.float64) * (1 + 1e-12)
    open_[np.arange(len(x)), first] = False
    at, measured = first.copy(), len(x)
    for k in range(len(c)):
        rows = np.flatnonzero(open_[:, k])
        gap = x[rows] - c[k]
        dist = (gap * gap).sum(axis=1)
        better = (dist < best[rows]) | ((dist == best[rows]) & (k < at[rows]))
        at[rows[better]], best[rows[better]] = k, dist[better]
        measured += len(rows)
    return at, best, measured


def _nearest_wide(x: list[int], c: list[list[int]]) -> tuple[int, int]:
    """The same in unbounded integers."""
    return min((sum((a - b) ** 2 for a, b in zip(x, row)), k) for k, row in enumerate(c))[::-1]


class _Rounds:
    """One round's centroids inside a task."""

    def __init__(self, centroids: list[list[int]], mean: np.ndarray, axes: np.ndarray) -> None:
        self.exact = centroids
        self.small = all(abs(v) <= _SMALL for row in centroids for v in row)
        if self.small:
            self.c = np.array(centroids, np.int64)
            self.lead = rotate(self.c.astype(np.float64), mean, axes)

    def of(self, b: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, np.ndarray | list[int], np.ndarray | list[list[int]]]]:
        """(row numbers, clusters, distances, components) of the small rows and of the wide ones."""
        ints, wide, lead = b.column(1), b.column(2), b.column(3)
        known = np.array(ints.is_valid(), bool)
        rows = np.flatnonzero(known)
        width = len(self.exact[0])
        if len(rows):
            x = np.frombuffer(b"".join(ints.take(pa.array(rows)).to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
            if self.small:
                y = np.frombuffer(b"".join(lead.take(pa.array(rows)).to_pylist()), "<f8").reshape(len(rows), -1)
                at, dist, _ = nearest(x, y, self.c, self.lead)
                yield rows.tolist(), at, dist, x
            else:
                found = [_nearest_wide(v, self.exact) for v in x.tolist()]
                yield rows.tolist(), np.array([k for k, _ in found]), [d for _, d in found], x
        rows = np.flatnonzero(~known)
        if len(rows):
            x = [[int(v) for v in wide[i].as_py()] for i in rows.tolist()]
            found = [_nearest_wide(v, self.exact) for v in x]
            yield rows.tolist(), np.array([k for k, _ in found]), [d for _, d in found], x


def _store(vectors: DataFrame, width: int, scale: int, leading: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The vectors as integers with their rotated coordinates, written once, and the rotation."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    sound = (F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), d.alias("v")).filter(F.coalesce(sound, F.lit(False)))
    n = rows.count()
    drawn = F.pmod(F.xxhash64("vec_id", "v", F.lit(SEED)), F.lit(1_000_000)) < (1_000_000 * FIT_ROWS) // max(n, 1)
    sample = rows.filter(drawn).select("v").limit(2 * FIT_ROWS).toPandas()["v"]
    # A component of any size must not spoil the axes: they are learned from those that count as small.
    x = np.array([v for v in sample if np.abs(v).max() <= _SMALL / scale], np.float64).reshape(-1, width)
    mean, axes = principal_axes(np.floor(scale * x), leading)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            small = np.abs(x).max(axis=1) <= _SMALL / scale
            v = np.floor(scale * np.where(small[:, None], x, 0.0))
            ints, lead = v.astype("<i4"), rotate(v, mean, axes)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([r.tobytes() if s else None for r, s in zip(ints, small)], pa.binary()),
                pa.array([None if s else [str(whole(u, scale)) for u in r] for r, s in zip(x, small)], pa.list_(pa.string())),
                pa.array([r.tobytes() if s else None for r, s in zip(lead, small)], pa.binary())], STORED.fieldNames())

    return cut_lineage(spread(rows).mapInArrow(store, STORED)), mean, axes


def _starts(stored: DataFrame, k: int, width: int) -> list[list[int]]:
    """The ``k`` vectors of the smallest hashes of their ids."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))

    def part(rows: list) -> list[list[int]]:
        return [np.frombuffer(r.ints, "<i4").tolist() if r.ints is not None else [int(v) for v in r.wide] for r in rows]

    h = F.sha2(name, 256)
    rows = stored.select("vec_id", "ints", "wide", h.alias("h")).orderBy("h", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), _component)).limit(k).collect()
    return part(rows)


def _component(i):
    """The i-th integer of a stored vector, as a decimal; ties of hashes are ordered by it."""
    low = F.hex(F.substring(F.col("ints"), i * 4 + 1, F.lit(4)))  # little-endian
    n = F.conv(F.concat(*[F.substring(low, j, 2) for j in (7, 5, 3, 1)]), 16, 10).cast("decimal(38,0)")
    return F.coalesce(F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n), F.element_at("wide", i + 1).try_cast("decimal(38,0)"))


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """value = sum of amount * 2**(32 * limb), amounts below 2**32 in size and of one sign."""
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & 0xFFFFFFFF:
            yield limb, sign * (value & 0xFFFFFFFF)
        value >>= _LIMB
        limb += 1


def _sums(stored: DataFrame, centroids: list[list[int]], mean: np.ndarray, axes: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (count, component sums) after assigning every vector."""
    width = len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Rounds(centroids, mean, axes)
        total = [[0] * (width + 1) for _ in centroids]
        for b in batches:
            for _, at, _, x in state.of(b):
                for k in np.unique(at).tolist():
                    mine = np.flatnonzero(at == k)
                    total[k][0] += len(mine)
                    own = x[mine].sum(axis=0).tolist() if isinstance(x, np.ndarray) else [sum(v) for v in zip(*(x[i] for i in mine.tolist()))]
                    total[k][1:] = [s + v for s, v in zip(total[k][1:], own)]
        found = [(k, place, limb, amount) for k, row in enumerate(total) for place, v in enumerate(row) for limb, amount in _limbs(v)]
        if found:
            columns = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], SUMS.fieldNames())

    parts = stored.mapInArrow(add, SUMS).groupBy("cluster", "place", "limb").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    out: dict[int, list[int]] = {}
    for r in parts.collect():
        row = out.setdefault(r.cluster, [0] * (width + 1))
        row[r.place] += int(r.amount) << (_LIMB * r.limb)
    return {k: (row[0], row[1:]) for k, row in out.items()}


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, leading: int = LEADING) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, exact) for every sound row of ``vectors`` (vec_id, embedding), ``exact`` being the squared distance
    in decimal digits, and the final centroids."""
    bounded_batches(vectors.sparkSession)
    stored, mean, axes = _store(vectors, width, scale, leading)
    centroids = _starts(stored, k, width)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], NEAREST), []
    for _ in range(rounds):
        sums = _sums(stored, centroids, mean, axes)
        moved = [[s // sums[i][0] for s in sums[i][1]] if i in sums else row for i, row in enumerate(centroids)]
        if moved == centroids:  # no later round changes anything
            break
        centroids = moved

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Rounds(centroids, mean, axes)
        for b in batches:
            for rows, at, dist, _ in state.of(b):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(at, pa.int32()), pa.array([str(d) for d in (dist.tolist() if isinstance(dist, np.ndarray) else dist)])],
                                                 NEAREST.fieldNames())

    return stored.mapInArrow(last, NEAREST), centroids


def op11_pca_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = cut_lineage(found.select("vec_id", "cluster", F.col("exact").try_cast("long").alias("distance")))
    # At most K rows; a sum that a long cannot hold is null, as is one with such a distance in it.
    each = {r[0]: None if r[2] else r[1] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")), F.count_if(F.col("distance").isNull())).collect()}
    fit = lambda v: None if v is None or v >= 1 << 63 else int(v)
    whole_sum = fit(sum(each.values())) if None not in each.values() else None
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = [(i, fit(each.get(i)), whole_sum, m) for i, m in enumerate(marks)]
    table = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql() -> str:
    """The rounds one after another; a centroid is a list of integers."""
    near = """a{r} as materialized (select vec_id, x, s.d as distance, s.c as cluster from (select e.n, any_value(e.vec_id) as vec_id, any_value(e.x) as x,
    min(struct_pack(d := list_sum(list_transform(list_zip(e.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, c := c.c)) as s from e, c{r} c group by e.n))"""
    move = """c{n} as materialized (select c.c, coalesce(m.x, c.x) as x from c{r} c left join (select cluster, list((s - ((s % n) + n) % n) // n order by i) as x
    from (select cluster, i, sum(v)::bigint as s, count(*) as n from (select cluster, unnest(x) as v, unnest(range(1, {w1})) as i from a{r}) group by cluster, i) group by cluster) m on m.cluster = c.c)"""
    steps = [f"""v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
e as materialized (select row_number() over () as n, vec_id, list_transform(v, lambda x: cast(floor({SCALE} * x) as bigint)) as x from v
    where len(v) = {WIDTH} and len(list_filter(v, lambda x: x is not null and isfinite(x))) = {WIDTH}),
c0 as materialized (select cast(row_number() over (order by sha256('{SEED}:' || vec_id), x) - 1 as integer) as c, x from e
    order by sha256('{SEED}:' || vec_id), x limit {K})"""]
    for r in range(ROUNDS):
        steps += [near.format(r=r, w1=WIDTH + 1), move.format(r=r, n=r + 1, w1=WIDTH + 1)]
    steps.append(near.format(r=ROUNDS, w1=WIDTH + 1))
    return "with " + ",\n".join(steps) + f"""
select a.vec_id, a.cluster, a.distance, cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia,
    cast(sum(a.distance) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on c.c = a.cluster"""


OP11_SQL = _op11_sql()
