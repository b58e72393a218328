"""Shards of near equal size that keep linked documents together, by balanced label propagation.

Documents with equal texts are linked.  Law: ``bytes``.

1. Every document starts in a shard drawn from its hash.  The documents of a group that start in one shard are one piece
   with a size, so a group has at most as many pieces as there are shards, however many documents it has.  A group larger
   than ``CUT_ABOVE`` of a shard is cut by a hash of its rows into parts of ``PART_SHARE``, and each part is a group.
2. A round: each group that still lies in several shards asks to move its other pieces to the shard where most of its
   documents are (for a part: most of the documents of all parts), among those with room for all of it.  The bytes asked for between each two shards (a small table) give
   every shard a quota, so that what comes in less what goes out keeps it below its capacity; a join of the asking groups
   with prefix sums of their sizes lets those move that fit the quota.  Rounds end when nobody asks, or when
   in two of them nobody may move.
3. What is not linked then evens the sizes out: sizes go down tier by tier, each tier laid out on a line in order of
   hashes and cut where the lowest shards reach a common level.  A shard that groups have filled above its capacity first
   gives back small groups, whole.
4. A document's slot is its place in its shard, in order of hashes.

All sums over prefixes are sums inside buckets of the hash plus the sums of the buckets before, so no task holds a shard.
Only tables with a row for a shard, or a pair of shards, reach the driver.

Cases: null text counts as empty, and empty texts are a group; a null doc_id is a document like others; repeated rows are
documents of one group, each with its own slot; a text larger than a shard's share stands alone as far as sizes allow;
fewer documents than shards leave shards empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.session import cut_lineage

SHARDS = 40
OVERHEAD = 16
# Groups above the first share of a shard are cut into parts of about the second.
CUT_ABOVE = 0.5
PART_SHARE = 0.2
# Units above a shard's share over this are placed one by one: there are at most GIANT for each shard.
GIANT = 8
# What small groups may fill of a shard's equal share: they can be given back whole, when the sizes are evened out.
FILL = 1.25
MAX_ROUNDS = 24
TIER = 8
BUCKET_ROWS = 2_000


def _line(row_hash: str) -> Column:
    """A 63-bit place on the line of hashes."""
    return F.shiftrightunsigned(F.col(row_hash), 1)


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, rows: int) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, within ``keys``, in order of the 64-bit hash
    ``order[0]`` and then the other columns.  ``rows`` is about the number of rows of ``df``."""
    per = max(BUCKET_ROWS, math.isqrt(max(rows, 1)))
    bits = max(0, math.ceil(math.log2(max(1, rows / per))))
    df = cut_lineage(df.withColumn("bucket__", F.shiftright(_line(order[0]), 63 - bits) if bits else F.lit(0).cast("long")))
    sums = df.groupBy(*keys, "bucket__").agg(F.sum(value).alias("sum__"))
    before = sums.select(*keys, "bucket__", (F.sum("sum__").over(Window.partitionBy(*keys).orderBy("bucket__")) - F.col("sum__")).alias("before__"))
    inside = Window.partitionBy(*keys, "bucket__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(before, [*keys, "bucket__"]).withColumn(name, F.col(name) + F.col("before__")).drop("bucket__", "before__")


def quotas(size: np.ndarray, wanted: np.ndarray, capacity: float) -> np.ndarray:
    """Bytes each shard may take in, given ``wanted[s, t]`` bytes that ask to move from s to t.

    Quotas start at all that is asked and shrink until no shard ends above its capacity (or above its size, where it
    already is), what goes out of a shard being counted in proportion to the quotas.
    """
    asked = wanted.sum(axis=0)
    share = np.ones(len(size))
    top = np.maximum(size, capacity)
    for _ in range(200):
        out = wanted @ share
        room = np.maximum(top - size + out, 0.0)
        new = np.minimum(share, np.divide(room, asked, out=np.ones(len(size)), where=asked > 0))
        if np.allclose(new, share, rtol=0, atol=1e-9):
            break
        share = new
    return np.floor(asked * new)


def level(size: np.ndarray, amount: int) -> np.ndarray:
    """How much of ``amount`` each shard gets so that the lowest ones reach a common level."""
    order = np.sort(size)
    top = (order.cumsum() + amount) / np.arange(1, len(size) + 1)
    n = next(i for i in range(len(size)) if i == len(size) - 1 or top[i] <= order[i + 1])
    return np.maximum(top[n] - size, 0.0)


def _per_shard(df: DataFrame, value: str, shards: int) -> np.ndarray:
    out = np.zeros(shards)
    for r in df.groupBy("shard").agg(F.sum(value)).collect():
        out[r[0]] = r[1]
    return out


def _in_shard(field: str, t: Column) -> Column:
    """Sum of a field of the pieces that lie in shard t."""
    none = F.lit(0).cast("long")
    return F.aggregate("pieces", none, lambda a, p: a + F.when(p["shard"] == t, p[field]).otherwise(none))


def _places() -> Column:
    return F.array_distinct(F.transform("pieces", lambda p: p["shard"]))


def _table(rows: list[np.ndarray]) -> Column:
    return F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in rows])


def propagate(groups: DataFrame, shards: int, share: float, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Label propagation.  ``groups``: unit, h (hash), size, pieces array of (home, shard, n, size), family (null, or what
    the parts of a cut group have in common).  Returns it with new shards in the pieces."""
    groups = groups.withColumn("big", (F.col("size") > share * PART_SHARE / 4).cast("int"))
    capacity = [FILL * share, share]  # of small and of big groups
    done = cut_lineage(groups.filter(F.size(_places()) == 1))
    state = cut_lineage(groups.filter(F.size(_places()) > 1))
    finished, refused, idle = [done], np.zeros((2, shards), bool), 0
    for turn in range(max_rounds):
        pieces = _union([*finished, state]).select("family", F.explode("pieces").alias("p")).select("family", "p.shard", "p.n", "p.size")
        size = _per_shard(pieces, "size", shards)
        # The parts of a cut group pull each other.  There are at most shards / CUT_ABOVE such groups.
        pull = pieces.filter("family is not null").groupBy("family").pivot("shard", list(range(shards))).agg(F.sum("n"))
        pull = pull.select("family", F.array(*[F.coalesce(F.col(f"`{i}`"), F.lit(0)) for i in range(shards)]).alias("pull"))
        # A shard has room for a group if its other pieces fit under the capacity, allowing for what may leave in this
        # round unless the shard refused some in the last one; shards above it are closed.
        room = F.element_at(_table([np.maximum(c - size, 0) + 0.5 * c * (size <= c) * ~full for c, full in zip(capacity, refused)]), F.col("big") + 1)
        scored = F.transform(_places(), lambda t: F.struct(
            F.coalesce(F.element_at("pull", t + 1), _in_shard("n", t)).alias("n"), F.pmod(F.xxhash64("h", t, F.lit(turn // 4)), F.lit(1 << 40)).alias("tie"),
            t.alias("t"), (F.col("size") - _in_shard("size", t)).alias("need")))
        fits = F.filter(scored, lambda s: s.need <= F.element_at(room, s.t + 1))
        asking = state.join(F.broadcast(pull), "family", "left").withColumn("to", F.array_max(fits))
        asking = cut_lineage(asking.select(*state.columns, F.col("to.t").alias("target"), F.col("to.need").alias("need")))
        flows = asking.filter("target is not null").select("big", "target", F.explode("pieces").alias("p")).filter("p.shard <> target")
        wanted = np.zeros((2, shards, shards))
        for kind, s, t, amount in flows.groupBy("big", F.col("p.shard"), "target").agg(F.sum("p.size")).collect():
            wanted[kind, s, t] = amount
        if not wanted.any():
            break
        quota = F.element_at(F.element_at(_table([quotas(size, w, c) for w, c in zip(wanted, capacity)]), F.col("big") + 1), F.col("target") + 1)
        # Who alone is above the quota must not hold up those behind.
        able = asking.filter(F.col("target").isNotNull() & (F.col("need") <= quota)).select("big", "target", "h", "unit", "need")
        placed = running(able, ["big", "target"], ["h", "unit"], "need", "ahead", asking.count())
        movers = placed.filter(F.col("ahead") + F.col("need") <= quota).select("unit", F.col("target").alias("goal"))
        moved = F.when(F.col("goal").isNotNull(), F.transform("pieces", lambda p: p.withField("shard", F.col("goal")))).otherwise(F.col("pieces"))
        after = asking.join(movers.hint("merge"), "unit", "left").withColumn("pieces", moved)
        after = cut_lineage(after.select(*state.columns, "target", F.col("goal").isNotNull().alias("went")))
        finished.append(after.filter("went").select(state.columns))
        state = after.filter("not went").select(state.columns)
        refused = np.zeros((2, shards), bool)
        for kind, t in after.filter("not went and target is not null").select("big", "target").distinct().collect():
            refused[kind, t] = True
        idle = idle + 1 if finished[-1].isEmpty() else 0
        if idle == 2:  # neither the wanted shards nor others take anyone
            break
    return _union([*finished, state])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill(units: DataFrame, size: np.ndarray, share: float, n: int) -> DataFrame:
    """Places ``units`` (unit, h, size) so that the shards' sizes come out near equal: (unit, shard).  Large ones first:
    those above ``share / GIANT`` each in the lowest shard, the others tier by tier, every tier raising the lowest shards
    to a common level."""
    spark, size, top = units.sparkSession, size.copy(), int(share / GIANT)
    giants = units.filter(F.col("size") > top).orderBy(F.desc("size"), "h", "unit").collect()
    placed = []
    for r in giants:
        placed.append((r["unit"], int(size.argmin())))
        size[placed[-1][1]] += r["size"]
    out = [spark.createDataFrame(placed, units.select("unit", F.lit(0).alias("shard")).schema)]
    while top > 0:
        last = top <= 64
        tier = units.filter((F.col("size") <= top) & (F.lit(last) | (F.col("size") > top // TIER)))
        total = tier.agg(F.sum("size")).first()[0]
        if total is not None:
            ends = np.cumsum(level(size, int(total)))
            middle = F.col("ahead") + F.col("size") / 2
            shard = sum((middle >= float(e)).cast("int") for e in ends[:-1]) if len(ends) > 1 else F.lit(0)
            found = cut_lineage(running(tier.select("unit", "h", "size"), [], ["h", "unit"], "size", "ahead", n).select("unit", "size", shard.alias("shard")))
            size += _per_shard(found, "size", len(size))
            out.append(found.select("unit", "shard"))
        top = 0 if last else top // TIER
    return _union(out)


def shard_documents(docs: DataFrame, shards: int = SHARDS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text); and ``group_id``, the same for
    documents with equal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(F.lit(1), text).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2"))
    # A row's own number tells equal rows apart; it is written with the row, so it stays the same for all steps.
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64(F.lit(12), "doc_id", "g1", "g2", "row")))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit("").alias("group_id"))
    share = total / shards
    # Groups that are cut into parts are above CUT_ABOVE of a shard, so there are at most shards / CUT_ABOVE of them.
    counts = rows.groupBy("g1", "g2").agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("group_rows"))
    large = counts.filter((F.col("group_size") > CUT_ABOVE * share) & (F.col("group_rows") > 1))
    large = large.select("g1", "g2", F.least(F.ceil(F.col("group_size") / (PART_SHARE * share)), F.col("group_rows")).cast("long").alias("parts"),
                         (F.col("group_size") > F.col("group_rows") * PART_SHARE / 4 * share).alias("heavy"))
    named = rows.join(F.broadcast(large), ["g1", "g2"], "left")
    # Of a group that is cut, one row in eight stays by itself to even the shards out, and all rows do where they are large.
    alone = F.col("heavy") | (F.pmod(F.xxhash64("row", F.lit(14)), F.lit(8)) == 0)
    part = F.when(alone, -1 - F.col("row")).otherwise(F.pmod(F.xxhash64("row", F.lit(13)), F.col("parts")))
    unit = [F.when(F.col("parts") > 1, F.xxhash64(g, part)).otherwise(F.col(g)) for g in ("g1", "g2")]
    family = F.when(F.col("parts") > 1, F.struct("g1", "g2"))
    home = F.pmod(F.xxhash64("row", F.lit(15)), F.lit(shards)).cast("int")
    named = cut_lineage(named.select("row", "doc_id", "size", "text_crc32", "h", "g1", "g2", F.struct(*unit).alias("unit"), home.alias("home"), family.alias("family")))
    pieces = named.groupBy("unit", "home").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.any_value("family").alias("family"))
    units = pieces.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.any_value("family").alias("family"), F.sort_array(F.collect_list(F.struct("home", F.col("home").alias("shard"), "n", "size"))).alias("pieces"))
    units = cut_lineage(units.withColumn("h", F.xxhash64("unit")))
    settled = cut_lineage(propagate(units.filter("n > 1").drop("n"), shards, share, max_rounds))
    placed = settled.select("unit", F.explode("pieces").alias("p")).select("unit", "p.home", "p.shard", "p.size")
    size = _per_shard(placed, "size", shards)
    loose = units.filter("n = 1").select("unit", "h", "size", "pieces")
    # Shards above their share give back small groups that lie whole in them.
    over = np.maximum(size - share, 0).astype(np.int64)
    if over.any():
        excess = F.element_at(F.array(*[F.lit(int(x)) for x in over]), F.col("shard") + 1)
        small = settled.filter((F.size(_places()) == 1) & (F.col("size") <= share * PART_SHARE / 4))
        small = small.withColumn("shard", F.element_at("pieces", 1).shard).filter(excess > 0)
        given = cut_lineage(running(small, ["shard"], ["h", "unit"], "size", "ahead", n).filter(F.col("ahead") + F.col("size") <= excess))
        size -= _per_shard(given, "size", shards)
        placed = placed.join(given.select("unit").hint("merge"), "unit", "left_anti")
        loose = cut_lineage(loose.unionByName(given.select("unit", "h", "size", "pieces")))
    filled = fill(loose.drop("pieces"), size, share, n)
    filled = loose.select("unit", F.explode("pieces").alias("p")).select("unit", "p.home").join(filled.hint("merge"), "unit")
    # What is placed grows with the documents, so it is never broadcast.
    where = placed.select("unit", "home", "shard").unionByName(filled.select("unit", "home", "shard"))
    sharded = named.join(where.hint("merge"), ["unit", "home"]).withColumn("one", F.lit(1).cast("long"))
    slotted = running(sharded, ["shard"], ["h", "row"], "one", "slot", n)
    return slotted.select("doc_id", "size", "text_crc32", "shard", "slot", F.concat_ws(":", F.hex("g1"), F.hex("g2")).alias("group_id"))


def cut_links(sharded: DataFrame) -> tuple[int, int]:
    """(pairs of linked documents in different shards, all pairs of linked documents) of what ``shard_documents`` returns."""
    per = sharded.groupBy("group_id", "shard").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    per = per.groupBy("group_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("inside"))
    inside, all_ = per.agg(F.sum("inside"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    return int((all_ or 0) - (inside or 0)) // 2, int(all_ or 0) // 2


def op12_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_id")
