"""Fuzzy passages that repeat across documents, by collinear chaining of shared k-mers.

1. Seeds: hashes of ``SEED_WORDS``-word windows, of which one in ``ONE_IN`` is kept by its hash alone, so that changed words
   beside a window don't matter.  Windows of ``MIN_WORDS`` words are thinned to the smallest of every ``WIDE_THIN``
   neighbours: the document that a window leads to shares all of it, however the short seeds scatter
   over earlier documents, so of ``MIN_WORDS + WIDE_THIN - 1`` equal words one passage is always anchored.  Where a seed
   recurs within the thinning width (repeated words), one place in about each width is kept.
2. One exchange brings the places of each seed together.  The first place of a seed in a document is joined to the first document that has the seed, the k-th place to the k-th
   place of the first document that has it k times.  Later places are joined to the seed's first place as well, so a
   passage that stands once earlier is found wherever it recurs.  A passage of m documents gives at most two anchors a
   place, never m * m.
3. The anchors of a pair of documents are merged into runs along a diagonal; runs are chained in order in both documents
   by dynamic programming with a cost for gaps, the best predecessor coming from a Fenwick tree of prefix maxima.
4. The words under a chain, and some on either side, are fetched from both documents and aligned: equal places along the
   runs, a longest common subsequence in the gaps, and an extension at both ends that stops where matches no longer pay;
   where the words fetched end before that, the chain is fetched again with more.
   A passage stays if it has ``MIN_WORDS`` words and ``MIN_MATCH`` of them match; where a chain fails, its longest parts
   that match so well take its place.

Cases: null, empty and short texts have no passage; a null doc_id takes part in none; exact copies are passages over the
whole text, repeated lines too; a passage that recurs is reported at each of its places in the later document, against one
place of the earlier; rows that share a doc_id are one document, so they have no passage with each other; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm.arrays import as_long, bounded_batches, gram_hashes, mix, text_words
from codesift.session import cut_lineage

SEED_WORDS = 4
ONE_IN = 4
THIN = 16
MAX_GAP = 32
GAP_COST = 0.1
MIN_WORDS = 40
MIN_MATCH = 0.8
WIDE_THIN = 12
# An extension ends for good where its score has fallen this far below its best.
DROP = 16
# A chain's seeds may begin and end this many words inside its passage.
LEAST_SPAN = MIN_WORDS - 2 * THIN
# Seeds that one document in HOT_SHARE has, in a sample of HOT_DOCS documents (of HOT_LEAST at least), count as common.
HOT_DOCS = 4_000
HOT_SHARE = 100
HOT_LEAST = 20
HOT_SEEDS = 20_000
# The bit that marks the places of a common seed.
COMMON = 2
# A short seed, or sequence of seeds, that at most so many rows have joins all pairs of its documents.
PAIRED = 16

SEEDS = T.StructType([T.StructField("seed", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("pos", T.IntegerType())])
_SPANS = T.ArrayType(T.IntegerType())
CHAINS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hub", T.LongType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()),
                       T.StructField("xe", T.IntegerType()), T.StructField("ye", T.IntegerType()), T.StructField("later", T.BooleanType()), T.StructField("runs", _SPANS)])
PASSAGES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("partner_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("start_word", "end_word", "partner_start", "partner_end", "matched")]])
# Passages, and a row for each chain whose extension is cut short (open) with the chain's first places.
ALIGNED = T.StructType([*PASSAGES.fields, T.StructField("open", T.BooleanType())])


def thin(grams: np.ndarray, goffs: np.ndarray, width: int) -> np.ndarray:
    """Which windows are the smallest of some ``width`` neighbours of their text (of all of them, in a short one)."""
    chosen = np.zeros(len(grams), bool)
    size = np.diff(goffs)
    n = len(grams) - width + 1
    if n > 0 and (size >= width).any():
        low = grams[:n].copy()
        for s in range(1, width):
            np.minimum(low, grams[s: s + n], out=low)
        doc = np.repeat(np.arange(len(size)), size)
        inside = doc[:n] == doc[width - 1:]
        for s in range(width):
            chosen[s: s + n] |= inside & (grams[s: s + n] == low)
    for d in np.flatnonzero((size > 0) & (size < width)):
        part = grams[goffs[d]: goffs[d + 1]]
        chosen[goffs[d]: goffs[d + 1]] = part == part.min()
    return chosen


def _among(seed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which seeds are among the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, seed), len(keys) - 1)] == seed if len(keys) else np.zeros(len(seed), bool)


def seeds_of(docs: DataFrame, only: np.ndarray | None = None, marked: np.ndarray | None = None) -> DataFrame:
    """seed (odd for a window of ``MIN_WORDS`` words, even for one of ``SEED_WORDS``), doc_id, pos (word).

    The k-th place of a seed, k > 1, has two rows: one with a seed made of the seed and k, one with the seed itself and
    ``-1 - pos``.  ``only`` names the seeds wanted; the seeds named by ``marked`` get the bit ``COMMON``, which no other has.
    """
    wanted = None if only is None else np.sort(only)
    known = np.zeros(0, np.int64) if marked is None else np.sort(marked)
    rest = ~np.uint64(1 | COMMON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            words, woffs = text_words(b.column(1))
            for wide, size, width in ((0, SEED_WORDS, THIN), (1, MIN_WORDS, WIDE_THIN)):
                grams, goffs = gram_hashes(words, woffs, size)
                chosen = thin(grams, goffs, width) if wide else (grams >> np.uint64(8)) % np.uint64(ONE_IN) == 0
                at = np.flatnonzero(chosen & np.repeat(np.diff(woffs) >= size, np.diff(goffs)))
                seed, doc = grams[at] & rest | np.uint64(wide), np.searchsorted(goffs, at, "right") - 1
                order = np.lexsort((at, seed, doc))
                at, seed, doc = at[order], seed[order], doc[order]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
                # Places of one seed closer than the width form a stretch, which keeps the first of each width.
                stretch = fresh.copy()
                stretch[1:] |= at[1:] - at[:-1] >= width
                step = (at - at[np.maximum.accumulate(np.where(stretch, np.arange(len(at)), 0))]) // width
                keep = stretch.copy()
                keep[1:] |= step[1:] != step[:-1]
                at, seed, doc, fresh = at[keep], seed[keep], doc[keep], fresh[keep]
                k = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                more = k > 0
                kth = seed.copy()
                kth[more] = mix(seed[more] ^ k[more].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & rest | np.uint64(wide)
                pos = (at - goffs[doc]).astype(np.int32)
                seed, doc, pos = as_long(np.concatenate([kth, seed[more]])), np.concatenate([doc, doc[more]]), np.concatenate([pos, -1 - pos[more]])
                if wanted is not None:
                    mine = _among(seed, wanted)
                    seed, doc, pos = seed[mine], doc[mine], pos[mine]
                if len(known):
                    seed = np.where(_among(seed, known), seed | COMMON, seed)
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ids[doc]), pa.array(pos)], SEEDS.fieldNames())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(run, SEEDS)


def common_seeds(docs: DataFrame) -> dict[int, tuple[int, int]]:
    """seed -> (hub, its place) of seeds that more than one document in ``HOT_SHARE`` has, by a sample of ``HOT_DOCS``
    documents.  Documents have a bounded number of seeds on average, and so has what is common; ``HOT_SEEDS`` bounds it.

    No hub comes after the first sampled document that has the seed, so the documents behind the last of these are not read.
    """
    n = docs.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < (1_000_000 * HOT_DOCS) // max(n, 1)
    sample = docs.select("doc_id", "text").filter(drawn)
    least = max(HOT_LEAST, min(n, HOT_DOCS) // HOT_SHARE, PAIRED + 1)
    counts = seeds_of(sample).filter("pos >= 0").groupBy("seed").agg(F.count("*").alias("count"), F.min("doc_id").alias("first")).filter(F.col("count") >= least)
    hot = counts.orderBy(F.desc("count"), "seed").limit(HOT_SEEDS).collect()
    if not hot:
        return {}
    early = docs.filter(F.col("doc_id").cast("long") <= max(r["first"] for r in hot))
    found = seeds_of(early, only=np.array([r["seed"] for r in hot], np.int64)).filter("pos >= 0").groupBy("seed").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return {r[0]: (r[1][0], r[1][1]) for r in found.collect()}


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, tuple | None]]:
    """The columns of sorted rows, the first row of each row's group (equal first column) and, where the first group began
    in rows given before, the first row of that group.  Only groups of more than ``most`` rows come in parts, each part
    but the last of more than ``most`` rows."""
    held: list[np.ndarray] | None = None
    opened: tuple | None = None

    def given(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, tuple | None]:
        nonlocal opened
        new = np.ones(len(cols[0]), bool)
        new[1:] = cols[0][1:] != cols[0][:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        before = opened if opened is not None and opened[0] == cols[0][0] else None
        if before is None or start[-1]:
            opened = tuple(int(c[start[-1]]) for c in cols)
        return cols, start, before

    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        cut = cut if len(cols[0]) - cut <= most else len(cols[0])
        held = [c[cut:] for c in cols]
        if cut:
            yield given([c[:cut] for c in cols])
    if held is not None and len(held[0]):
        yield given(held)


def _pairs_within(start: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (later, earlier) of all pairs of documents of one group; groups have at most ``PAIRED`` rows."""
    for lag in range(1, PAIRED):
        i = np.flatnonzero((start[lag:] == start[:-lag]) & (doc[lag:] != doc[:-lag])) + lag
        if len(i):
            yield i, i - lag


def _rows(parts: list[tuple], schema: str) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else []
    kinds = [(n, pa.int64() if k == "long" else pa.int32()) for n, k in (c.split() for c in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(cols[i] if parts else [], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


ANCHORS = "doc_id long, hub long, pos int, hub_pos int, size int, via long, via_pos int"


def seed_anchors(docs: DataFrame) -> DataFrame:
    """The anchors of single seeds, and a row of size 0 for each place of a short seed that more than ``PAIRED`` rows have.

    One exchange brings the places of a seed together, sorted by document, and a task reads them as a stream: the first
    row of a seed is its hub, the others give anchors.  Places of common seeds, whose hubs are known, are dealt by their
    documents instead.
    """
    hubs = common_seeds(docs)
    keys = np.array(sorted(hubs), np.int64)
    first = np.array([hubs[k] for k in keys.tolist()], np.int64).reshape(-1, 2)

    def to_hub(s: np.ndarray, d: np.ndarray, p: np.ndarray, h: np.ndarray, q: np.ndarray) -> tuple:
        keep = np.flatnonzero(d != h)
        size = np.where(s[keep] & 1 == 1, MIN_WORDS, SEED_WORDS)
        later = p[keep] < 0
        return d[keep], h[keep], np.where(later, -1 - p[keep], p[keep]), q[keep], np.where(later, -size, size), h[keep], q[keep]

    def unsettled(rows: np.ndarray, d: np.ndarray, p: np.ndarray, h: np.ndarray, q: np.ndarray) -> tuple:
        return d[rows], d[rows], p[rows], p[rows], np.zeros(len(rows), np.int32), h[rows], q[rows]

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []

        def unknown() -> Iterator[pa.RecordBatch]:
            for b in batches:
                seed = b.column(0).to_numpy()
                given = seed & COMMON != 0
                if not given.any():
                    yield b
                    continue
                s, d, p = (c.to_numpy()[given] for c in b.columns)
                h, q = first[np.searchsorted(keys, s & ~COMMON)].T
                known.extend([to_hub(s, d, p, h, q), unsettled(np.flatnonzero((s & 1 == 0) & (p >= 0)), d, p, h, q)])
                yield b.filter(pa.array(~given))

        for (s, d, p), start, before in _whole_groups(unknown(), PAIRED):
            h, q, n = d[start], p[start], np.bincount(start, minlength=len(s))[start]
            if before is not None:
                h, q, n = np.where(start == 0, before[1], h), np.where(start == 0, before[2], q), np.where(start == 0, PAIRED + 1, n)
            parts, plain = [to_hub(s, d, p, h, q)], (s & 1 == 0) & (p >= 0)
            rare = np.flatnonzero(plain & (n > 2) & (n <= PAIRED))
            for i, j in _pairs_within(start[rare], d[rare]):
                i, j = rare[i], rare[j]
                i, j = i[d[j] != h[j]], j[d[j] != h[j]]
                parts.append((d[i], d[j], p[i], p[j], np.full(len(i), SEED_WORDS), h[i], q[i]))
            parts.append(unsettled(np.flatnonzero(plain & (n > PAIRED)), d, p, h, q))
            yield _rows(parts + known, ANCHORS)
            known.clear()
        yield _rows(known, ANCHORS)

    # First places before later ones, so that the first row of a seed is the first place in its first document.
    order = ["seed", "doc_id", F.col("pos") < 0, "pos"]
    dealt = F.when(F.col("seed").bitwiseAND(COMMON) == 0, F.col("seed")).otherwise(F.xxhash64("seed", "doc_id"))
    return seeds_of(docs, marked=keys).repartition(dealt).sortWithinPartitions(*order).mapInArrow(anchor, ANCHORS)


# A sequence of seeds of a document: its first and last seed, each with the hub and place that identify it.
SEQUENCES = "seed long, doc_id long, pos int, last int, via long, via_pos int, via_last long, via_last_pos int"


def sequence_anchors(sequences: DataFrame) -> DataFrame:
    """The anchors of sequences of seeds, on their first and last seeds, and the rows of sequences that more than ``PAIRED``
    rows have (size 0, by first and last seed).  Of these, sequences of ``MIN_WORDS`` words are joined to the first document."""
    schema = f"{ANCHORS}, seed long, last int, via_last long, via_last_pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, d, p, l, v, vp, w, wp), start, before in _whole_groups(batches, PAIRED):
            parts = []
            nil = lambda n: (np.zeros(n, np.int64),) * 4

            def put(i: np.ndarray, e: np.ndarray, ep: np.ndarray, el: np.ndarray, ends: tuple) -> None:
                for x, y, a, b in ((p, ep, v, vp), (l, el, w, wp)):
                    # Where the partner is the seed's hub, the anchor is known.
                    k = (e != a[i]) & (e != d[i])
                    via, via_pos = (a[i], b[i]) if ends is None else ends
                    parts.append((d[i][k], e[k], x[i][k], y[k], np.full(int(k.sum()), SEED_WORDS), via[k], via_pos[k], *nil(int(k.sum()))))

            n = np.bincount(start, minlength=len(s))[start]
            if before is not None:
                n = np.where(start == 0, PAIRED + 1, n)
            rare = np.flatnonzero((n > 1) & (n <= PAIRED))
            for i, j in _pairs_within(start[rare], d[rare]):
                i, j = rare[i], rare[j]
                put(i, d[j], p[j], l[j], None)
            long = l + SEED_WORDS - p >= MIN_WORDS
            i = np.flatnonzero((n > PAIRED) & long)
            e, ep, el = d[start[i]], p[start[i]], l[start[i]]
            if before is not None:
                e, ep, el = (np.where(start[i] == 0, before[k], c) for k, c in ((1, e), (2, ep), (3, el)))
            # The first document stands for all of these, so such anchors are those of a hub.
            for x, y in ((p, ep), (l, el)):
                k = e != d[i]
                parts.append((d[i][k], e[k], x[i][k], y[k], np.full(int(k.sum()), SEED_WORDS), e[k], y[k], *nil(int(k.sum()))))
            i = np.flatnonzero((n > PAIRED) & ~long)
            parts.append((d[i], d[i], p[i], p[i], np.zeros(len(i), np.int32), v[i], vp[i], s[i], l[i], w[i], wp[i]))
            yield _rows(parts, schema)

    return sequences.repartition("seed").sortWithinPartitions("seed", "doc_id", "pos").mapInArrow(run, schema)


def anchors_of(docs: DataFrame) -> DataFrame:
    """doc_id, hub, pos, hub_pos, size (words, negative for a later place joined to the first), via, via_pos: each repeated
    seed of a document, its place in the first document that has it (via is that document), and its places in the other
    earlier documents (via and via_pos are the seed's place in the first).

    A short seed that at most ``PAIRED`` rows have joins all pairs of its documents.  The places of the others are joined
    to sequences with the places that follow them, and these to longer ones, until at most ``PAIRED`` rows have a sequence
    or it spans ``MIN_WORDS`` words; so documents meet on what tells them apart from the other documents of a phrase.
    """
    met = cut_lineage(seed_anchors(docs))
    out = met.filter("size != 0")
    seed = F.xxhash64("via", "via_pos")
    todo = met.filter("size = 0").select(seed.alias("seed"), "doc_id", "pos", F.col("pos").alias("last"), "via", "via_pos", F.col("via").alias("via_last"), F.col("via_pos").alias("via_last_pos"))
    row = F.struct("seed", "pos", "last", "via_last", "via_last_pos")
    in_order = Window.partitionBy("doc_id").orderBy("pos", "last", "seed")
    follows = lambda c: (c["last"] > F.col("last")) & (c["pos"] - F.col("last") <= MAX_GAP)
    level = 0
    while True:
        # The next two of single seeds, so that one of them may be changed; then the next; then the furthest within reach.
        leads = ([1, 2], [1], [16, 8, 4, 2, 1])[min(level, 2)]
        ahead = todo.select("*", *[F.lead(row, n).over(in_order).alias(f"n{n}") for n in leads])
        found = [F.when(follows(F.col(f"n{n}")), F.col(f"n{n}")) for n in leads]
        longer = ahead.withColumn("n", F.explode(F.array(*found) if level == 0 else F.array(F.coalesce(*found)))).filter(F.col("n").isNotNull()).select(
            F.xxhash64("seed", "n.seed").alias("seed"), "doc_id", "pos", "n.last", "via", "via_pos", "n.via_last", "n.via_last_pos")
        met = cut_lineage(sequence_anchors(longer))
        out = out.unionByName(met.filter("size != 0").select(*out.columns))
        todo = met.filter("size = 0").select(*longer.columns)
        if todo.isEmpty():
            return out
        level += 1


class Fenwick:
    """Prefix maxima of (value, who)."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def most(self, i: int) -> tuple[float, int]:
        """The largest value at 0..i."""
        out, i = (-np.inf, -1), i + 1
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chain(x1: list[int], x2: list[int], y1: list[int], y2: list[int]) -> list[list[int]]:
    """Disjoint chains (lists of run numbers in order) of runs [x1, x2) x [y1, y2), best first.

    The score of a chain is the words of its runs less ``GAP_COST`` for every word between them in either document.  Runs
    may overlap by less than a seed.
    """
    n = len(x1)
    if n == 1:
        return [[0]]
    ends = sorted({y - SEED_WORDS for y in y2})
    rank = {y: i for i, y in enumerate(ends)}
    tree = Fenwick(len(ends))
    score, before = [0.0] * n, [-1] * n
    # A run opens at x1 and may be followed from x2 - SEED_WORDS on; at one place, runs that began earlier close first.
    events = sorted([(x1[i], 1, i) for i in range(n)] + [(x2[i] - SEED_WORDS, 0 if x2[i] - SEED_WORDS > x1[i] else 2, i) for i in range(n)])
    places = np.array(ends)
    for _, kind, i in events:
        if kind != 1:
            tree.put(rank[y2[i] - SEED_WORDS], score[i] + GAP_COST * (x2[i] + y2[i]), i)
            continue
        score[i] = x2[i] - x1[i]
        value, j = tree.most(int(np.searchsorted(places, y1[i], "right")) - 1)
        gain = value - GAP_COST * (x1[i] + y1[i])
        if j >= 0 and gain > 0:
            score[i] += gain
            before[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(path[::-1])
    return out


def near(path: list[int], x1: list[int], x2: list[int], y1: list[int], y2: list[int]) -> list[list[int]]:
    """A chain cut where more than ``MAX_GAP`` words of a document lie between two runs."""
    out = [[path[0]]]
    for a, b in zip(path, path[1:]):
        if max(x1[b] - x2[a], y1[b] - y2[a]) > MAX_GAP:
            out.append([])
        out[-1].append(b)
    return out


def _paths(pair: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int, int, list[int]]]:
    """(pair, x, y, end of x, end of y, runs) of the chains of anchors sorted by pair, diagonal and place."""
    start = np.ones(len(pair), bool)
    start[1:] = (pair[1:] != pair[:-1]) | (x[1:] - y[1:] != x[:-1] - y[:-1])
    # The end of what the anchors of a diagonal cover so far.
    line = np.cumsum(start) << 32
    end = np.maximum.accumulate(line + x + size) - line
    start[1:] |= x[1:] - end[:-1] > MAX_GAP - SEED_WORDS
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(pair)) - 1
    x1, x2, y1, y2 = x[first], end[last], y[first], end[last] - x[first] + y[first]
    heads = np.flatnonzero(np.diff(pair[first], prepend=-1))
    # Most pairs share a few words only; none of their chains can be long enough.
    wide = [np.maximum.reduceat(hi, heads) - np.minimum.reduceat(lo, heads) >= LEAST_SPAN for lo, hi in ((x1, x2), (y1, y2))]
    spans = np.flatnonzero(wide[0] & wide[1])
    for a, b in zip(heads[spans].tolist(), np.append(heads[1:], len(first))[spans].tolist()):
        order = np.argsort(x1[a:b], kind="stable") + a
        cols = [c[order].tolist() for c in (x1, x2, y1, y2)]
        for path in (p for whole in chain(*cols) for p in near(whole, *cols)):
            xs, xe, ys, ye = cols[0][path[0]], cols[1][path[-1]], cols[2][path[0]], cols[3][path[-1]]
            if xe - xs >= LEAST_SPAN and ye - ys >= LEAST_SPAN and (len(path) > 1 or xe - xs > SEED_WORDS):
                yield int(pair[first[a]]), xs, ys, xe, ye, [c[i] for i in path for c in cols]


def _implied(hub: int, x: np.ndarray, y: np.ndarray, via: np.ndarray, via_pos: np.ndarray, runs: list[int]) -> bool:
    """Whether all anchors of a chain stand in one other document, in order, which both documents are joined to."""
    inside = np.zeros(len(x), bool)
    for x1, x2, y1, _ in (runs[i: i + 4] for i in range(0, len(runs), 4)):
        inside |= (x >= x1) & (x < x2) & (x - y == x1 - y1)
    at, v, vp = x[inside], via[inside], via_pos[inside]
    if v[0] == hub or (v != v[0]).any():
        return False
    order = np.argsort(at, kind="stable")
    dx, dv = np.diff(at[order]), np.diff(vp[order])
    return bool(((dv >= 0) & (np.abs(dv - dx) <= MAX_GAP)).all())


def _chains_of(doc: np.ndarray, hub: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, via: np.ndarray, via_pos: np.ndarray) -> list[tuple]:
    """Chains of sorted anchors (by doc, hub, diagonal, place); whole pairs only.

    A chain whose seeds all lead to one other document is left to that one.  Later places chain on their own, and only
    count where no chain of the pair spans the same words of the document.
    """
    if not len(doc):
        return []
    pair = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hub[1:] != hub[:-1])]))
    out, spans = [], {}
    for later in (False, True):
        own = np.flatnonzero((size < 0) == later)
        if not len(own):
            continue
        for p, xs, ys, xe, ye, runs in _paths(pair[own], x[own], y[own], np.abs(size[own])):
            if not later:
                mine = own[slice(*np.searchsorted(pair[own], [p, p + 1]))]
                if (via[mine] != hub[mine]).any() and _implied(int(hub[mine[0]]), x[mine], y[mine], via[mine], via_pos[mine], runs):
                    continue
                spans.setdefault(p, []).append((xs, xe))
            elif any(a <= xs and xe <= b for a, b in spans.get(p, ())):
                continue
            at = int(np.searchsorted(pair, p))
            out.append((int(doc[at]), int(hub[at]), xs, ys, xe, ye, later, runs))
    return out


def chains_of(anchors: DataFrame) -> DataFrame:
    """Chains: doc_id, hub, the span in both, whether of later places, and the runs (x1, x2, y1, y2 one after another)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 7

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(map(list, zip(*rows))) if rows else [[]] * len(CHAINS)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], CHAINS.fieldNames())

        for b in batches:
            held = [np.concatenate([h, b.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)]
            # The last pair may go on in the next batch.
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(new):
                cut = int(new[-1]) + 1
                yield out(_chains_of(*(h[:cut] for h in held)))
                held = [h[cut:] for h in held]
        yield out(_chains_of(*held))

    # The anchors of a document are at most ``PAIRED`` times its seeds, so no key is hot.
    sorted_ = anchors.repartition("doc_id").sortWithinPartitions("doc_id", "hub", F.col("pos") - F.col("hub_pos"), "pos")
    return sorted_.mapInArrow(run, CHAINS)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by whole-number bit vectors."""
    if not len(a) or not len(b):
        return 0
    places: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a.tolist():
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, bool]:
    """(words, matches) of the best extension along the diagonal, and whether it might go on past the shorter side."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, True
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    best = int(np.argmax(score))
    top = max(int(score[best]), 0)
    return *((best + 1, int(same[: best + 1].sum())) if top else (0, 0)), bool(score[-1] > top - DROP)


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """The number of equal words that both begin with."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    return n if same.all() else int(np.argmin(same))


def _columns(u: np.ndarray, v: np.ndarray, u0: int, v0: int, runs: list[int], peel: Callable[[np.ndarray, np.ndarray], int]) -> tuple[np.ndarray, bool, bool]:
    """The alignment of a chain as rows (words, partner's words, matches) after a row with its start, and whether either end
    might go on past the words given.  Places on a diagonal are one by one, also what ``peel`` takes from the ends of a gap;
    the rest of a gap is one row."""
    quads = [runs[i: i + 4] for i in range(0, len(runs), 4)]
    # Rows that share a doc_id may have texts shorter than the chain; what is missing matches nothing.
    u = np.concatenate([u, np.zeros(max(quads[-1][1] - u0 - len(u), 0), u.dtype)])
    v = np.concatenate([v, np.ones(max(quads[-1][3] - v0 - len(v), 0), v.dtype)])
    x, y = quads[0][0], quads[0][2]
    n, _, left = _extend(u[: x - u0][::-1], v[: y - v0][::-1])
    out = [np.array([[x - n, y - n, 0]])]

    def places(x: int, y: int, n: int) -> None:
        out.append(np.column_stack([np.ones((n, 2), int), u[x - u0: x - u0 + n] == v[y - v0: y - v0 + n]]))

    places(x - n, y - n, n)
    for x1, x2, y1, y2 in quads:
        if x < x1 and y < y1:
            a, b = u[x - u0: x1 - u0], v[y - v0: y1 - v0]
            head = peel(a, b)
            tail = peel(a[head:][::-1], b[head:][::-1])
            places(x, y, head)
            a, b = a[head: len(a) - tail], b[head: len(b) - tail]
            out.append(np.array([[len(a), len(b), common(a, b)]]))
            places(x1 - tail, y1 - tail, tail)
        else:
            out.append(np.array([[max(x1 - x, 0), max(y1 - y, 0), 0]]))
        skip = max(x - x1, y - y1, 0)
        out.append(np.array([[max(x1 + skip - max(x, x1), 0), max(y1 + skip - max(y, y1), 0), 0]]))
        places(x1 + skip, y1 + skip, max(min(x2 - x1, y2 - y1) - skip, 0))
        x, y = max(x, x2), max(y, y2)
    n, _, right = _extend(u[x - u0:], v[y - v0:])
    places(x, y, n)
    return np.concatenate(out).astype(np.int64), left, right


def _longest(at: np.ndarray, score: np.ndarray) -> tuple[int, int]:
    """The rows i..j of a table of places (x, y) and running scores that enclose most words and lose no score."""
    high = np.maximum.accumulate(score[::-1])[::-1]
    j = len(score) - np.searchsorted(high[::-1], score - 1e-9)
    j = np.maximum(j - 1, np.arange(len(score)))
    i = int(np.argmax((at[j] - at).min(1)))
    return i, int(j[i])


def align(u: np.ndarray, v: np.ndarray, u0: int, v0: int, runs: list[int]) -> tuple[list[tuple[int, int, int, int, int]], tuple[bool, bool]]:
    """Passages (start, end, partner start, partner end, matched words), and whether either end might go on past the words given.

    ``u`` and ``v`` are word hashes from words u0 and v0 on.
    """
    rows, left, right = _columns(u, v, u0, v0, runs, _equal)
    total = np.cumsum(rows, 0)
    fits = lambda w: min(w[0], w[1]) >= MIN_WORDS and w[2] >= MIN_MATCH * max(w[0], w[1])
    if fits(total[-1] - total[0]):
        cuts = [(0, len(total) - 1)]
    else:
        rows = _columns(u, v, u0, v0, runs, lambda a, b: _extend(a, b)[0])[0]
        total, worst = np.cumsum(rows, 0), rows[:, :2].max(1)
        gain = rows[:, 2] - 2 * (worst - rows[:, 2])
        score = np.concatenate([[0.0], np.cumsum(rows[1:, 2] - MIN_MATCH * worst[1:])])
        cuts, todo = [], [(0, len(total))]
        while todo:
            a, b = todo.pop()
            i, j = (a + k for k in _longest(total[a:b, :2], score[a:b]))
            if (total[j] - total[i])[:2].min() < LEAST_SPAN:
                continue
            todo += [(a, i + 1), (j, b)]
            # Ends that do not pay go, as in an extension.
            low, up = i + int(np.argmax(np.cumsum(gain[i + 1: j + 1][::-1])[::-1])), i + 1 + int(np.argmax(np.cumsum(gain[i + 1: j + 1])))
            if low < up and fits(total[up] - total[low]):
                cuts.append((low, up))
    return sorted((int(total[i, 0]), int(total[j, 0]), int(total[i, 1]), int(total[j, 1]), int(total[j, 2] - total[i, 2])) for i, j in cuts), (left, right)


def slices_of(docs: DataFrame, chains: DataFrame, reach: int = MAX_GAP) -> DataFrame:
    """Each chain with the word hashes under it, and ``reach`` words on either side, in both documents."""
    key = ["doc_id", "hub", "x", "y"]
    own = chains.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.col("doc_id").alias("at"), F.lit(0).alias("side"), F.col("x").alias("a"), F.col("xe").alias("b"), "later", "runs")
    other = chains.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.col("hub").alias("at"), F.lit(1).alias("side"), F.col("y").alias("a"), F.col("ye").alias("b"), "later", F.lit(None).cast(_SPANS).alias("runs"))
    want = own.unionByName(other)
    parts = T.StructType([T.StructField("k0", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType()), T.StructField("k3", T.IntegerType()),
                          T.StructField("side", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("ends", T.BooleanType()), T.StructField("later", T.BooleanType()), T.StructField("runs", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Rows of one document stand together mostly; each distinct text of the batch is hashed once.
            coded = b.column(9).dictionary_encode()
            words, woffs = text_words(coded.dictionary)
            which = coded.indices.to_numpy()
            start, end = b.column(5).to_numpy(), b.column(6).to_numpy()
            first = np.maximum(start - reach, 0).astype(np.int32)
            ends = np.diff(woffs)[which] <= end.astype(np.int64) + reach
            cut = [words[woffs[d]: woffs[d + 1]][s: e + reach].astype(np.uint32).tobytes() for d, s, e in zip(which.tolist(), first.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first), pa.array(cut, pa.binary()), pa.array(ends), *b.columns[7:9]], parts.fieldNames())

    texts = docs.select(F.col("doc_id").cast("long").alias("at"), "text")
    found = texts.join(want, "at").select("k0", "k1", "k2", "k3", "side", "a", "b", "later", "runs", "text").mapInArrow(run, parts)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return found.groupBy("k0", "k1", "k2", "k3", "later").agg(
        F.max("runs").alias("runs"), side(0, "first").alias("u0"), side(0, "words").alias("u"), side(1, "first").alias("v0"), side(1, "words").alias("v"), F.max("ends").alias("ends"))


def passages_of(sliced: DataFrame) -> DataFrame:
    """The passages of aligned chains; a chain that needs more words gives an open row with its doc_id, hub, x and y instead.

    Chains of later places are never open: the next one takes over where the words of one end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, h, x, y, later, runs, u0, u, v0, v, ends in zip(*(c.to_pylist() for c in b.columns)):
                if u is None or v is None or runs is None:
                    continue
                found, (left, right) = align(np.frombuffer(u, np.uint32), np.frombuffer(v, np.uint32), u0, v0, runs)
                if not later and (left and u0 > 0 and v0 > 0 or right and not ends):
                    rows.append((d, h, x, None, y, None, None, True))
                else:
                    rows += [(d, h, *p, False) for p in found]
            cols = list(map(list, zip(*rows))) if rows else [[]] * len(ALIGNED)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.bool_())], ALIGNED.fieldNames())

    return sliced.mapInArrow(run, ALIGNED)


def find_passages(docs: DataFrame) -> DataFrame:
    """doc_id, partner_id (an earlier document), the passage in words in both, and how many words match."""
    bounded_batches(docs.sparkSession)
    chains, reach, out = cut_lineage(chains_of(anchors_of(docs))), MAX_GAP, None
    while True:
        found = cut_lineage(passages_of(slices_of(docs, chains, reach)))
        done = found.filter("not open").drop("open")
        out = done if out is None else out.unionByName(done)
        more = found.filter("open").select("doc_id", F.col("partner_id").alias("hub"), F.col("start_word").cast("int").alias("x"), F.col("partner_start").cast("int").alias("y"))
        if more.isEmpty():
            return out
        chains, reach = cut_lineage(chains.filter("not later").join(more, ["doc_id", "hub", "x", "y"], "left_semi")), reach * 16


def op10_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
