"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide.

1. A text's set of five-word n-grams (64-bit hashes) is made in arrays; texts with equal sets are one class, so copies
   cost one row.
2. MinHash: ``BANDS`` bands of ``ROWS`` rows.  A pair of similarity s meets in a band with chance
   ``1 - (1 - s**ROWS)**BANDS``; 20 bands of 4 rows give 0.99997 at 0.8, and 0.15 at 0.3.
3. Only band hashes are shuffled.  The classes of a band bucket are joined to its smallest member, not to each other, and
   the components of these links are the candidate groups.  Every true pair that meets in a band lies in one group.
4. Groups are cut into blocks of ``BLOCK_ROWS`` classes; each pair of blocks is one task row group, where exact
   intersections of the full sets come from products of slabs of the incidence matrix.  Counts of links and a spanning set
   of them leave the task; pairs are never listed.

Cases: a text of one to four words has one n-gram of all its words; null, empty and blank texts have none and link with
nothing, not even each other; a null doc_id takes part in no link; equal rows are copies of one class (each is the
other's link); rows that repeat a doc_id with different texts are judged one by one; an empty table gives no rows; other
columns are not read by ``join_ngrams`` and come back unchanged from ``drop_near_copies``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm.arrays import as_long, bounded_batches, gram_hashes, mix, text_words
from codesift.llm.graph import lowest
from codesift.operators.components import connected_components
from codesift.session import cut_lineage

WORDS = 5
LIMIT = 0.8
BANDS = 20
ROWS = 4
BLOCK_ROWS = 256
_SLAB = 4096

SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_grams", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
                       T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("root", T.LongType()), T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("grams", T.BinaryType())])
FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("root", T.LongType())])


def _constants(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    k = bands * rows
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, one after another, and the offsets."""
    words, woffs = text_words(column)
    grams, goffs = gram_hashes(words, woffs, n)
    parts = [np.unique(grams[a:b]) for a, b in zip(goffs[:-1].tolist(), goffs[1:].tolist())]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def marks_of(sets: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Two sums of mixed n-gram hashes, which tell sets apart."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(s)))]) for s in (0x1234567, 0x89ABCDEF01)]
    return [as_long(t[offs[1:]] - t[offs[:-1]]) for t in sums]


def minhash(sets: np.ndarray, offs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, texts x bands; texts without n-grams have zeros."""
    a, b = _constants(bands, rows)
    n = len(offs) - 1
    out = np.zeros((n, bands), np.uint64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + (1 << 15), "right")) - 1)
        part, at = sets[offs[i]: offs[j]], offs[i:j] - offs[i]
        full = np.flatnonzero(np.diff(offs[i: j + 1]))
        if len(full):
            for band in range(bands):
                h = np.zeros(len(full), np.uint64)
                for r in range(band * rows, band * rows + rows):
                    x = part * a[r]
                    x ^= b[r]
                    x *= np.uint64(0x9E3779B97F4A7C15)
                    h = h * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(x, at[full])
                out[i + full, band] = mix(h)
        i = j
    return out


def sign(docs: DataFrame, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, number of n-grams, a 128-bit mark of the set, band hashes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, offs = sets_of(b.column(1), n)
            size = np.diff(offs)
            marks = [pa.array(m) for m in marks_of(sets, offs)]
            hashes = pa.FixedSizeListArray.from_arrays(pa.array(as_long(minhash(sets, offs, bands, rows)).ravel()), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), *marks, hashes], SIGNED.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


def _intersections(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Sizes of the intersections of the first m sets with the others, by slabs of the incidence matrix."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    row, code = row[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((m, len(sets) - m), np.float32)
    width = int(code[-1]) + 1 if len(code) else 0
    for start in range(0, width, _SLAB):
        i, j = np.searchsorted(code, [start, start + _SLAB])
        x = np.zeros((len(sets), min(_SLAB, width - start)), np.float32)
        x[row[i:j], code[i:j] - start] = 1
        out += x[:m] @ x[m:].T
    return out


def _verify(limit: float):
    def verify(group: pa.Table) -> pa.Table:
        """Links between block a and block b of a candidate group; b is a itself on the diagonal."""
        side, node, copies = (group.column(c).to_numpy() for c in ("side", "node", "copies"))
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in group.column("grams").combine_chunks()]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        size = np.array([len(s) for s in sets], np.float64)
        both = _intersections([sets[i] for i in a] + [sets[i] for i in b], len(a)).astype(np.float64)
        linked = (both >= limit * (size[a][:, None] + size[b][None, :] - both) - 1e-9) & (node[a][:, None] != node[b][None, :])
        rows, cols = lowest(linked)
        met = cols >= 0
        out = [np.concatenate(x) for x in ((node[a], node[b][met]), (linked @ copies[b], np.zeros(met.sum(), np.int64)), (node[a][rows], node[a][cols[met]]))]
        keep = (out[1] > 0) | (out[0] != out[2])
        return pa.table([pa.array(x[keep].astype(np.int64)) for x in out], names=FOUND.fieldNames())

    return verify


def join_ngrams(docs: DataFrame, n: int = WORDS, limit: float = LIMIT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same n-grams), group_id (smallest doc_id reachable by links), n_links
    (other documents of similarity ``limit`` or more), kept (the document that stays for its group).  A row for each row of ``docs``.
    """
    signed = cut_lineage(sign(docs, n, bands, rows).withColumn("node", F.when(F.col("n_grams") > 0, F.xxhash64("n_grams", "set_a", "set_b"))))
    usable = signed.filter("n_grams > 0 and doc_id is not null")
    # Equal sets have equal bands, so any row's bands are the class's.
    classes = cut_lineage(usable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("set_a").alias("set_a"), F.min("set_b").alias("set_b"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands")))
    band = classes.select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("band"))
    hubs = band.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    links = band.join(hubs, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    groups = connected_components(links)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    members = groups.join(sizes, "root").join(classes.drop("bands"), "node")
    members = cut_lineage(members.select(F.col("rep").alias("doc_id"), "root", "node", "copies", "parts", "set_a", "set_b"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, offs = sets_of(b.column(6), n)
            own = np.logical_and(*(m == b.column(i).to_numpy() for m, i in zip(marks_of(sets, offs), (4, 5))))
            cuts = zip(offs[:-1].tolist(), offs[1:].tolist())
            grams = pa.array([sets[i:j].tobytes() for i, j in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], grams], SETS.fieldNames()).filter(pa.array(own))

    # The text of a class is that of a row whose id names it and whose set is the class's.  The members grow with the
    # documents, so they are never broadcast, not even where they happen to be few.
    named = docs.select(F.col("doc_id").cast("long"), "text").join(members.hint("merge"), "doc_id").select(*members.columns[1:], "text")
    full = named.mapInArrow(fetch, SETS)
    if not signed.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        full = full.dropDuplicates(["node"])
    part = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = full.select("root", "node", "copies", "grams", part.alias("pa"), every.alias("pb"), F.lit(0).alias("side"))
    right = full.select("root", "node", "copies", "grams", every.alias("pa"), part.alias("pb"), F.lit(1).alias("side"))
    found = cut_lineage(left.unionByName(right).groupBy("root", "pa", "pb").applyInArrow(_verify(limit), FOUND))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("other"))
    parts = connected_components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    known = classes.select("node", "rep", "copies").join(counts, "node", "left").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("rep").alias("group_id"))
    known = known.join(least, "root").select("node", "rep", "group_id", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("links"))
    named = F.col("n_grams") > 0
    out = signed.join(known, "node", "left").withColumn("named", named & F.col("doc_id").isNotNull())
    pick = lambda c: F.when(F.col("named"), F.col(c)).otherwise(F.col("doc_id"))
    return out.select("doc_id", pick("rep").alias("class_id"), pick("group_id").alias("group_id"), F.when(F.col("named"), F.col("links")).otherwise(0).alias("n_links"),
                      (~F.col("named") | (F.col("group_id") == F.col("doc_id"))).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest doc_id stays.

    Where ids repeat or are null, every row is a document of its own, and the first one stored stays for its group.
    """
    row, gone = f"row_{uuid.uuid4().hex}", f"gone_{uuid.uuid4().hex}"
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        rows, key = docs, F.col("doc_id")
    else:
        rows, key = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id())), F.col(row)
    marks = join_ngrams(rows.select(key.alias("doc_id"), "text")).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    # What goes grows with the documents, so it is never broadcast.
    return rows.join(marks.hint("merge"), key == F.col(gone), "left_anti").drop(row)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, list_distinct(case when len(w) < {WORDS} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {WORDS - 2}),
    lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end) as g from w where len(w) > 0),
c as (select min(doc_id) as rep, count(*) as n, g from (select doc_id, list_sort(g) as g from g) group by g),
m as (select doc_id, rep from (select doc_id, list_sort(g) as g from g) join c using (g)),
e as (select rep, len(g) as size, unnest(g) as s from c),
p as (select a.rep as a, b.rep as b, count(*) as k, any_value(a.size) as sa, any_value(b.size) as sb from e a join e b on a.s = b.s and a.rep <> b.rep group by all),
l as (select a, b from p where k >= {LIMIT} * (sa + sb - k) - 1e-9),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
lo as (select a, min(b) as low from r group by a),
k as (select l.a, sum(c.n) as n from l join c on c.rep = l.b group by l.a)
select d.doc_id, coalesce(m.rep, d.doc_id) as class_id, least(coalesce(m.rep, d.doc_id), coalesce(lo.low, m.rep, d.doc_id)) as group_id,
    cast(case when m.rep is null then 0 else c.n - 1 + coalesce(k.n, 0) end as bigint) as n_links,
    d.doc_id = least(coalesce(m.rep, d.doc_id), coalesce(lo.low, m.rep, d.doc_id)) as kept
from documents d left join m using (doc_id) left join c on c.rep = m.rep left join lo on lo.a = m.rep left join k on k.a = m.rep
"""
