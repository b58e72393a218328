"""Centroid clustering, sharding and fill-in-the-middle against brute force and on edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.llm import centroid_clusters, fill_middle, sharding
from codesift.llm.queries import QUERIES, SQL
from codesift.workloads.check import compare, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
CLASHING = ["row", "h", "g1", "unit", "home", "shard", "size", "slot", "n", "form", "output", "v", "ints", "lead", "cluster", "parts", "family"]
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b  c\n"), (5, "x" * 200_000), (6, LONG), (7, "日本 語 – ünï"), (8, "has <P> inside"), (9, "<S>"),
        (10, "lead  trail \n"), (11, "< P> <M"), (12, "é é x"), (-3, "minus one"), (13, LONG + " "), (14, LONG)] + [(100 + i, f"word{i} and <{i}> more\n text") for i in range(40)]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame([(a, b, "s") for a, b in EDGE], DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op11_pca_clusters", "op13_fill_middle"])
def test_sql(spark, name):
    ok, note = compare(spark, SF, name, QUERIES[name], SQL[name], duck(SF))
    assert ok, note


# ---- 11 centroid clustering

def brute_clusters(rows, k, rounds, width, scale):
    """Plain integers; (vec_id, cluster, distance) and centroids."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [centroid_clusters.whole(x, scale) for x in v]))
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for i in range(len(cents)):
            mine = [x for (_, x), c in zip(kept, at) if c == i]
            if mine:
                cents[i] = [sum(col) // len(mine) for col in zip(*mine)]
    return collections.Counter((i, near(x)[1], str(near(x)[0])) for i, x in kept), cents


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3)


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "few"])
def test_clusters_equal_brute_force(spark, kind):
    r = np.random.default_rng(5)
    n, width = (3 if kind == "few" else 150), 6
    x = r.normal(size=(n, width)) * [10, 5, 1, 1, 0.1, 0.1]
    if kind == "ties":
        x = np.repeat(np.round(x[:30]), 5, axis=0)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(None, x[0].tolist()), (3, x[1].tolist()), (3, x[2].tolist()), (9, None), (10, []), (11, [1.0] * 5), (12, [None] + [1.0] * 5), (13, [float("nan")] + [1.0] * 5), (14, [float("inf")] * 6)]
    if kind == "wide":
        rows += [(500 + i, [1e300 * (i + 1), -3e12, 0.5, 0.0, -0.3, 1.0]) for i in range(4)] + [(600, [2e6, 0.0, 0.0, 0.0, 0.0, 0.0])]
    found, cents = centroid_clusters.cluster_vectors(vectors(spark, rows), 4, 5, width, 1024, 2)
    want, want_cents = brute_clusters(rows, 4, 5, width, 1024)
    assert cents == want_cents
    assert collections.Counter((a.vec_id, a.cluster, a.exact) for a in found.collect()) == want


def test_bound_rules_out_centroids():
    r = np.random.default_rng(2)
    c = r.integers(-1000, 1000, (8, 64))
    x = c[r.integers(0, 8, 2000)] + r.integers(-150, 150, (2000, 64))
    mean, axes = centroid_clusters.principal_axes(x.astype(float), 16)
    assert np.abs(axes.T @ axes - np.eye(16)).max() < 1e-9
    at, dist, measured = centroid_clusters.nearest(x, centroid_clusters.rotate(x.astype(float), mean, axes), c, centroid_clusters.rotate(c.astype(float), mean, axes))
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    assert measured < 1.2 * len(x)  # of 8 a row


def test_clusters_of_nothing(spark):
    found, cents = centroid_clusters.cluster_vectors(vectors(spark, [(1, None)]).limit(0))
    assert found.count() == 0 and cents == []
    found, cents = centroid_clusters.cluster_vectors(vectors(spark, [(1, None), (2, [0.5])]))
    assert found.count() == 0 and cents == []


# ---- 12 sharding

def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    r = np.random.default_rng(0)
    rows = [(int(k), int(h), int(i), int(v)) for i, (k, h, v) in enumerate(zip(r.integers(0, 3, 500), r.integers(-2**63, 2**63, 500), r.integers(0, 9, 500)))]
    rows += [(0, 5, 1000 + i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, h long, i long, v long")
    for keys in ([], ["k"]):
        got = {x.i: x.s for x in sharding.running(df, keys, ["h", "i"], "v", "s", 530).collect()}
        line = sorted(rows, key=lambda x: ((x[1] % 2**64) >> 1 >> 50, x[1], x[2]))
        order = sorted(rows, key=lambda x: (x[0] if keys else 0, got[x[2]], x[3], x[1]))
        seen = collections.Counter()
        for k, _, i, v in order:
            assert got[i] == seen[k if keys else 0]
            seen[k if keys else 0] += v
        assert len(line) == len(got)


def test_levels_and_quotas():
    size = np.array([5.0, 0.0, 9.0, 2.0])
    assert sharding.level(size, 7).tolist() == pytest.approx([0, 4.5, 0, 2.5])
    assert sharding.level(size, 0).tolist() == [0, 0, 0, 0]
    assert (size + sharding.level(size, 40)).tolist() == pytest.approx([14.0] * 4)
    r = np.random.default_rng(1)
    for _ in range(30):
        s, w = r.uniform(50, 150, 6), r.uniform(0, 30, (6, 6)) * (1 - np.eye(6))
        q = sharding.quotas(s, w, 100.0)
        out = w @ np.divide(q, w.sum(axis=0))
        assert (q <= w.sum(axis=0)).all() and (s + q - out <= np.maximum(s, 100.0) + 6).all()


def shards_of(df, shards=40):
    got = sharding.shard_documents(df, shards).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert 0 <= r.shard < shards
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return got, np.array([sum(r["size"] for r in by[i]) for i in range(shards)])


def check_rows(got, rows):
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_shards_of_edge_cases(edge, empty):
    got, sizes = shards_of(edge, 5)
    check_rows(got, EDGE)
    top = max(len((t or "").encode()) + 16 for _, t in EDGE)
    assert sizes.max() <= max(top, sizes.mean() * 1.05)
    assert sharding.shard_documents(empty).count() == 0
    one, sizes = shards_of(edge.limit(1), 5)
    assert len(one) == 1 and (sizes > 0).sum() == 1


@pytest.mark.parametrize("kind", ["pairs", "hot", "same", "thousands"])
def test_groups_stay_together_and_sizes_even(spark, kind):
    r = np.random.default_rng(8)
    text = lambda i: f"text {i} " + "ab " * int(r.integers(1, 60))
    texts = [text(i) for i in range(2000)]
    if kind == "pairs":
        texts = texts[:1000] * 2
    if kind == "hot":
        texts += ["the same words in a third of all rows, again and again"] * 1500
    if kind == "same":
        texts = ["one text"] * 2000
    if kind == "thousands":
        texts += [f"copied {i % 10} many times" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, sizes = shards_of(df, 8)
    check_rows(got, list(enumerate(texts)))
    assert sizes.max() <= sizes.mean() * 1.03 and sizes.min() >= sizes.mean() * 0.97
    groups = collections.defaultdict(collections.Counter)
    for x in got:
        groups[texts[x.doc_id]][x.shard] += 1
    split = [c for c in groups.values() if len(c) > 1]
    assert len(split) <= (0.01 * 1000 if kind == "pairs" else kind in ("hot", "same"))
    if kind == "hot":  # most of the hot group lies in few shards
        assert sum(n for _, n in split[0].most_common(4)) > 0.75 * 1500
    cut, links = sharding.cut_links(sharding.shard_documents(df, 8))
    assert 0 <= cut <= links and (kind in ("hot", "same") or cut <= 0.05 * links)


# ---- 13 fill in the middle

def brute_middle(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}")
    return (doc_id, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")


def test_middles_equal_brute_force(edge, empty):
    made = fill_middle.fill_middle(edge)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute_middle(*r) for r in EDGE), key=key)
    assert collections.Counter((r.doc_id, r.back) for r in got) == collections.Counter((i, t or "") for i, t in EDGE)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(empty).count() == 0


def test_rank_index_is_exact_and_small():
    r = np.random.default_rng(4)
    for offsets in (np.zeros(0, np.int64), np.array([7]), np.cumsum(r.integers(1, 12, 50_000)), np.cumsum(r.choice([1, 2, 100_000], 5000)), np.zeros(300, np.int64),
                    np.arange(1000) * 3, np.cumsum(r.integers(0, 2, 999)) + (1 << 45)):
        index = fill_middle.RankIndex.fit(offsets)
        for i in (index, fill_middle.RankIndex.from_bytes(index.to_bytes())):
            assert i.offsets(np.arange(len(offsets))).tolist() == offsets.tolist()
            some = r.integers(0, max(len(offsets), 1), 20) if len(offsets) else np.zeros(0, np.int64)
            assert i.offsets(some).tolist() == offsets[some].tolist()
    words = np.cumsum(r.integers(2, 12, 100_000))
    index = fill_middle.RankIndex.fit(words)
    assert len(index.to_bytes()) < 1.2 * len(words) and np.abs(index.offsets(np.arange(len(words))) - index.predict(np.arange(len(words)))).max() <= fill_middle.ERROR + 1
    with pytest.raises(ValueError):
        fill_middle.RankIndex.fit(np.cumsum(r.integers(1, 5000, 10_000)), 5000)


def test_tokens_equal_pattern():
    import pyarrow as pa

    from codesift.llm.arrays import flat

    texts = [t for _, t in EDGE] + ["a", " a", "a ", "  ", "a\x0bb\x1cc"]
    data, offs = flat(pa.array(texts, pa.string()))
    ends, before = fill_middle.token_ends(data, offs)
    for i, t in enumerate(texts):
        want = np.cumsum([len(w.encode()) for w in TOKEN.findall(t or "")]) + offs[i]
        assert ends[before[i]: before[i + 1]].tolist() == want.tolist()


# ---- 10 common seeds take another way to the same anchors

def test_common_seeds_give_the_same_passages(spark, monkeypatch):
    from codesift.llm import substring_dedup

    r = np.random.default_rng(3)
    word = lambda n: [f"w{i}" for i in r.integers(0, 5000, n)]
    notice, other = word(60), word(80)
    rows = [(i, " ".join(word(30) + (notice if i % 2 else []) + word(20) + (other if i % 5 == 0 else []) + word(10) + (notice if i % 7 == 0 else []))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = []
    for least in (10**9, 3):
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", least)
        hot = substring_dedup.common_seeds(df)
        assert bool(hot) == (least == 3)
        found.append(sorted(tuple(x) for x in substring_dedup.anchors_of(df).collect()))
    assert found[0] == found[1] and len(found[0]) > 500


# ---- 10 hubs of common seeds, one pass over the texts, pairs too short to chain

def notices(spark, n=400):
    r = np.random.default_rng(51)
    word = lambda n: [f"w{i}" for i in r.integers(0, 1 << 40, n)]
    first, second = word(60), word(60)
    rows = [(i, " ".join(word(12) + (first if i > 4 else []) + word(9) + (second if i > 30 and i % 2 else []))) for i in range(n)]
    # An early document given twice, and one without an id.
    rows += [(6, " ".join(word(3) + first)), (None, " ".join(first + second))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_hubs_of_common_seeds_without_reading_all_documents(spark, monkeypatch):
    from codesift.llm import substring_dedup

    df, read, seeds_of = notices(spark), [], substring_dedup.seeds_of
    seeds = [tuple(x) for x in seeds_of(df).filter("pos >= 0").collect()]

    def seen(docs, only=None, **more):
        if only is not None:
            read.append(docs.count())
        return seeds_of(docs, only, **more)

    monkeypatch.setattr(substring_dedup, "seeds_of", seen)
    # All documents, then about one in four, where the first document of a seed may not be drawn.
    for drawn in (4_000, 100):
        monkeypatch.setattr(substring_dedup, "HOT_DOCS", drawn)
        hubs = substring_dedup.common_seeds(df)
        assert len(hubs) > 10
        assert hubs == {s: min((d, p) for t, d, p in seeds if t == s) for s in hubs}
    assert len(read) == 2 and max(read) < 200


def test_seeds_are_made_and_marked_in_one_step(spark):
    from codesift.llm import substring_dedup

    df = notices(spark, 60)
    plain = sorted(tuple(x) for x in substring_dedup.seeds_of(df).collect())
    assert not any(s & substring_dedup.COMMON for s, _, _ in plain)
    keys = np.array(sorted({s for s, _, _ in plain})[::5], np.int64)
    marked = substring_dedup.seeds_of(df, marked=keys).collect()
    assert {s - 2 for s, _, _ in marked if s & 2} == set(keys.tolist())
    assert sorted((s & ~2, d, p) for s, d, p in marked) == plain
    # One Python step before the exchange and one behind it.
    assert substring_dedup.seed_anchors(df)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_pairs_too_short_for_a_passage_are_not_chained(monkeypatch):
    from codesift.llm import substring_dedup

    calls, chain = [], substring_dedup.chain
    monkeypatch.setattr(substring_dedup, "chain", lambda *c: calls.append(c[0]) or chain(*c))
    # Pair 1: two places on neighbouring diagonals, pair 2: far apart in one text only, pair 3: a chain of two runs.
    pair, x, y = np.array([1, 1, 2, 2, 3, 3, 3]), np.array([10, 13, 50, 10, 20, 24, 31]), np.array([10, 12, 10, 10, 40, 44, 50])
    order = np.lexsort((x, x - y, pair))
    got = list(substring_dedup._paths(pair[order], x[order], y[order], np.full(7, 4)))
    assert [g[:5] for g in got] == [(3, 20, 40, 35, 54)]
    assert calls == [[20, 31]]
