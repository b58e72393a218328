"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codesift.llm import (embedding_dedup, mixing, ngram_join, packing, pii, quality_net, quality_rules, substring_dedup,
                          token_counts, token_files, tokens)
from codesift.llm.arrays import gram_hashes, text_words
from codesift.llm.queries import QUERIES, SQL
from codesift.session import work_dir
from codesift.workloads.check import compare, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with names that the operators use inside.
CLASHING = ["_gone", "_key", "_k", "_n", "_t", "_i", "_r", "_takes", "_run", "_before", "node", "root", "size", "key", "takes", "copies", "seed", "label", "v", "score", "bucket"]

PARA = " ".join(f"w{i}x{i * i % 97}" for i in range(300))
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "  \n\t ", "en", "a", 5), (4, "one", None, "b", 3), (5, "one", "en", "b", 3),
    (6, PARA, "en", "b", None), (6, PARA, "en", "b", None), (7, PARA + " tail", "en", "a", 9), (None, PARA, "en", "c", 9), (8, "x" * 50_000, "en", "c", 50_000),
    (9, "mail bob@example.com or 10.0.0.1 now, +1 (543) 555-9258 and 4111 1111 1111 1111", "en", "c", 80), (10, "日本語 – ünïcode <|endoftext|> it's", "ja", "c", 1),
    (11, ("word " * 20_000).strip(), "en", "a", 1), (12, "other " + PARA[900:], "en", "a", 1),
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    ok, note = compare(spark, SF, name, QUERIES[name], SQL[name], con)
    assert ok, note


def ids_of(text, end):
    t = tokens.library(tokens.vocabulary_path(), True)
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- arrays and tokens

def test_words_and_grams():
    texts = ["a b  c\nd", None, "", "a", " b\x0bc ", "a b c d", "a b"]
    words, offs = text_words(pa.array(texts))
    assert np.diff(offs).tolist() == [4, 0, 0, 1, 2, 4, 1]
    grams, goffs = gram_hashes(words, offs, 3)
    assert np.diff(goffs).tolist() == [2, 0, 0, 1, 1, 2, 1]
    assert grams[:2].tolist() == grams[goffs[5]: goffs[6]].tolist()
    assert len(set(grams.tolist())) == 5


def test_encoder_equals_library():
    odd = ["", None, " ", "  a", "a  b\n\n c", "it's we'll 'x", "x\ty", "日本語", "a b", "<|endoftext|> a<|b", "é×ß÷", "\n", "a\n", " \n \n", "1a2 b3", "...a ..b", "a   ",
           "œuvre", "A\r\nB", "\x00", "😀 x", "Ãƒ", PARA, "x" * 5000]
    e = tokens.Encoder(tokens.vocabulary_path(), True)
    for rows in (odd, odd[::-1], odd * 2):
        assert [x.tolist() for x in e.encode(pa.array(rows, pa.string()))] == [ids_of(t, 0)[:-1] for t in rows]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 5)
    e = tokens.Encoder(tokens.vocabulary_path(), True)
    for t in ("a bb ccc dddd", "e ff ggg hhhh iii", "a bb e ff", PARA):
        assert e.encode(pa.array([t]))[0].tolist() == ids_of(t, 0)[:-1]


# ---- 1 n-gram join

def brute_links(rows):
    """(links, group) by row number."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    good = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    near = {i: [j for j in good if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in good}
    group = {i: rows[i][0] for i in good}
    for _ in rows:
        group = {i: min([group[i], *(group[j] for j in near[i])]) for i in good}
    return {i: len(near[i]) for i in good}, group


def test_ngram_join(edge, empty):
    got = ngram_join.join_ngrams(edge).collect()
    links, group = brute_links(EDGE)
    want = collections.Counter((r[0], group.get(i, r[0]), links.get(i, 0)) for i, r in enumerate(EDGE))
    assert collections.Counter((r.doc_id, r.group_id, r.n_links) for r in got) == want
    kept = ngram_join.drop_near_copies(edge)
    assert kept.columns == edge.columns and 7 not in [r.doc_id for r in kept.collect()]
    assert ngram_join.join_ngrams(empty).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark):
    clean, copy = "a clean text of its own with many other words in it", PARA
    rows = [(1, copy), (2, copy + " end"), (2, clean), (3, clean + " and more of it"), (3, clean + " and more of it"), (None, copy), (None, "a lone text"), (4, None), (4, None)]
    got = [r.text for r in ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sum(1 for t in got if t and t.startswith(PARA[:50])) == 1 and clean in got and got.count("a lone text") == 1
    assert got.count(clean + " and more of it") == 1 and got.count(None) == 2


def test_ngram_join_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    r = np.random.default_rng(1)
    base = PARA.split()
    rows = []
    for i in range(90):
        w = list(base)
        for j in r.integers(0, 300, int(r.integers(0, 7))):
            w[j] = f"z{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links, group = brute_links(rows)
    assert {r.doc_id: (r.group_id, r.n_links) for r in got} == {i: (group[i], links[i]) for i in range(90)}


# ---- 2 token files

def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (500, 3), (5000, 10**9), (64, 64)):
        v = np.sort(r.integers(0, top + 1, n)).astype(np.uint64)
        e, _ = token_files.EliasFano.from_bytes(token_files.EliasFano.of(v).to_bytes(), 0)
        assert e.values().tolist() == v.tolist()
        assert [e.select(i) for i in range(0, n, 37)] == v[::37].tolist()
        blocks = [b.tolist() for b in e.blocks()]
        assert sum(blocks, []) == v.tolist() and all(len(b) <= token_files.SELECT_STEP for b in blocks)
        if n == 5000:
            assert len(e.to_bytes()) < 2.6 * n
    with pytest.raises(IndexError):
        e.select(64)


def test_token_files_round_trip(spark, edge, empty):
    for name, df in (("edge", edge), ("empty", empty)):
        folder = f"{work_dir(spark)}/{name}"
        files = token_files.write_token_files(df, folder, 2, file_ids=200)
        got = sorted((tuple(r) for r in token_files.read_token_files(files, folder).collect()), key=lambda r: r[1])
        rows = sorted((r for r in EDGE if name == "edge"), key=lambda r: (r[0] is not None, r[0] or 0))
        want, at = [], 0
        for r in rows:
            ids = ids_of(r[1], 2)
            want.append((r[0], at, len(ids), crc(ids)))
            at += len(ids)
        assert got == want


def test_offsets_come_from_select_marks(spark):
    rows = [(i, "a b c " * (i % 5)) for i in range(300)]
    folder = f"{work_dir(spark)}/marks"
    files = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder, 2)
    raw = token_files.dump([r[0] for r in rows], [np.array(ids_of(t, 2), "<u2") for _, t in rows], 2)
    whole = token_files.TokenFile(raw)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(files, folder).collect())
    assert got == [(whole.start(i), i, len(whole.ids(i))) for i in range(300)]


def test_token_file_access():
    raw = token_files.dump([None, -5, -5, 9], [np.array(x, "<u2") for x in ([1, 2], [2], [3, 4, 2], [2])], 2)
    f = token_files.TokenFile(raw)
    assert f.doc_ids() == [None, -5, -5, 9]
    assert [f.ids(i).tolist() for i in range(4)] == [[1, 2], [2], [3, 4, 2], [2]] and f.start(3) == 6


# ---- 3 personal data

def test_base_spans():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("x@a.com@b.org q@w", "a@@b.c", "@a.b", "a.b@c.d.", "a@b.c.d-e@f.g", "é.b@c.de", "a@b c@d.e"):
        assert pii.base_spans(t)["email"] == [m.span() for m in plain.finditer(t)]
    s = pii.base_spans("1.2.3.4.5.6.7.8 256.1.1.1 x 4111-1111 1111 1111 x 4111111111111112 x +1 (543) 555-9258) +12")
    assert s["ip"] == [(0, 7), (8, 15)] and s["card"] == [(28, 47)] and len(s["phone"]) == 1
    assert pii.base_spans("4111111111111111 5")["card"] == [] and pii.base_spans("9" * 200_000) == {k: [] for k in pii.KINDS}


def test_windows_cover_texts():
    for n in (1, 511, 512, 513, 960, 961, 5000):
        w = pii.windows(n)
        assert w[0][2] == 0 and w[-1][3] == n and all(a[3] == b[2] for a, b in zip(w, w[1:]))
        assert all(a <= s and e <= b and b - a <= pii.WINDOW for a, b, s, e in w)


@pytest.fixture(scope="module")
def net(spark):
    ids, tags = pii.training_windows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    return pii.fit(ids, tags)


def test_tagger_on_held_out_items(net):
    r = np.random.default_rng(99)
    rows = []
    for i in range(300):
        item = pii.written_anew(pii.KINDS[i % 4], r)
        rows.append(pii._example(f"the ande thon in {item} of ther and", [(17, 17 + len(item), 1 + i % 4)], 17, r))
    gold = np.stack([x[1] for x in rows])
    got = net.tag(np.stack([x[0] for x in rows]).T).T
    assert ((got == gold) & (gold > 0)).sum() > 0.9 * (gold > 0).sum()
    assert ((got > 0) & (gold == 0)).sum() < 0.05 * (gold > 0).sum()


def test_spans_are_found_in_whole_texts(net, small):
    """Own ways of writing, and ways held out from the generator, between words of real documents."""
    texts = [x.text for x in small.collect() if len(x.text or "") > 500]
    r = np.random.default_rng(123)
    card = lambda sep: sep.join(d[i: i + 4] for d in [pii.card_digits(r)] for i in range(0, 16, 4))
    ways = {**{k: (lambda k=k: pii.written_anew(k, r), k, 0.8) for k in pii.KINDS},
            "ip (.)": (lambda: "(.)".join(map(str, r.integers(1, 256, 4))), "ip", 0.8), "ip [.]": (lambda: " [.] ".join(map(str, r.integers(1, 256, 4))), "ip", 0.8),
            "card 2": (lambda: card(".").replace(".", "", 1), "card", 0.5),
            "phone 1": (lambda: f"1 ({pii._num(r, 3)}) {pii._num(r, 3)}-{pii._num(r, 4)}", "phone", 0.8)}
    for name, (make, kind, least) in ways.items():
        found = 0
        for _ in range(60):
            t = texts[int(r.integers(len(texts)))]
            cut = t.find(" ", int(r.integers(0, len(t) - 400))) + 1
            before, item = t[max(0, cut - 200): cut], make()
            (_, spans), = pii.spans_of(net, [before + item + t[cut - 1: cut + 200]])
            found += (len(before), len(before) + len(item)) in spans[kind]
        assert found >= least * 60, (name, found)
    for t, kind in (("call 543-555-9258 before noon", "phone"), ("write to bob.smith (at) example.com today", "email")):
        assert next(pii.spans_of(net, [t]))[1][kind], t


def test_plausible_numbers():
    good = [("ip", "1[.]2[.]3[.]255"), ("card", "4111.1111.1111.1111"), ("phone", "543-555-9258"), ("email", "bob at mail dot com"), ("email", "BOB @ mail . com")]
    bad = [("ip", "1[.]2[.]3[.]256"), ("ip", "1.2.3"), ("card", "4111.1111.1111.1112"), ("card", "4111"), ("phone", "2024-01-15"), ("phone", "1" * 16),
           ("email", "by by by by"), ("email", "thly. thly."), ("email", "a@b@c.d"), ("email", "@ . "), ("email", "a at b")]
    assert all(pii.plausible(*x) for x in good) and not any(pii.plausible(*x) for x in bad)


def test_base_spans_equal_plain_patterns():
    """Each kind against its pattern, on made-up strings of the characters that matter."""
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
               "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def sum_of(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))

    def passes(kind, m):
        d = "".join(c for c in m if c in "0123456789")
        return (kind == "email" or kind == "ip" and max(map(int, m.split("."))) <= 255 or kind == "card" and 16 <= len(d) <= 19 and sum_of(d) % 10 == 0
                or kind == "phone" and 8 <= len(d) <= 15)

    r = np.random.default_rng(11)
    seen = collections.Counter()
    for i in range(6000):
        chars = ("0123456789" * 4 + " -.+()x", "01 .", "ab1@.-é ", "0123456789 -")[i % 4]
        t = "".join(r.choice(list(chars), int(r.integers(0, 60))))
        if i % 5 == 0:
            t += " " + pii.written_anew(pii.KINDS[int(r.integers(4))], r) + t[::-1]
        got = pii.base_spans(t)
        want = {k: [m.span() for m in re.finditer(p, t) if passes(k, m[0])] for k, p in pattern.items()}
        assert got == want, t
        seen.update(k for k in want for _ in want[k])
        text = ",".join(f"{k}:{s}:{e}" for k in ("email", "ip", "card", "phone") for s, e in want[k])
        assert pii.written(got) == text
    assert all(seen[k] > 50 for k in pattern), seen


def test_viterbi_is_the_best_path(net):
    r = np.random.default_rng(4)
    ids = r.integers(1, 128, (5, 6)).astype(np.uint8)
    em, trans = net.emissions(ids), np.where(pii.ALLOWED, net.trans, -1e9)
    got = net.tag(ids)
    for col in range(6):
        paths = np.stack(np.meshgrid(*[range(pii.LABELS)] * 5, indexing="ij"), -1).reshape(-1, 5)
        score = sum(em[t, paths[:, t], col] for t in range(5)) + sum(trans[paths[:, t], paths[:, t + 1]] for t in range(4))
        assert got[:, col].tolist() == paths[np.argmax(score)].tolist()


def test_find_and_mask(net, edge, empty):
    got = {(r.doc_id, r.base_sha256): r for r in pii.find_pii(edge, net).collect()}
    for d, text, *_ in EDGE:
        base = pii.base_spans(text or "")
        digest = hashlib.sha256(pii.written(base).encode()).hexdigest()
        row = got[d, digest]
        assert set(filter(None, pii.written(base).split(","))) <= set(row.spans.split(","))
        assert row.n_email + row.n_ip + row.n_card + row.n_phone == len(list(filter(None, row.spans.split(","))))
    clean = pii.mask_pii(edge, net)
    assert clean.columns == edge.columns and clean.count() == len(EDGE)
    assert clean.filter("doc_id = 9").first().text == "mail <email> or <ip> now, <phone> and <card>"
    assert clean.filter("doc_id = 1").first().text is None
    assert pii.find_pii(empty, net).count() == pii.mask_pii(empty, net).count() == 0


# ---- 4 packing

def test_packing(edge, empty, small):
    for df, rows in ((edge, EDGE), (small, [tuple(r)[:2] for r in small.select("doc_id", "text").collect()])):
        got = packing.pack_documents(df).collect()
        seq, docs = collections.defaultdict(list), collections.defaultdict(list)
        for p in got:
            seq[p.sequence_id].append(p)
            docs[p.doc_id].append(p)
        for ps in seq.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at and p.length > 0
                at += p.length
            assert at <= 1024
        want = collections.defaultdict(list)
        for d, text, *_ in rows:
            want[d].append(ids_of(text, 0))
        for d, texts in want.items():
            assert sum(p.length for p in docs[d]) == sum(map(len, texts))
            if len(texts) == 1:
                at = 0
                for p in sorted(docs[d], key=lambda p: p.start):
                    assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(texts[0]), crc(texts[0][at: at + p.length]))
                    at += p.length
        pad = sum(1024 - sum(p.length for p in ps) for ps in seq.values())
        assert pad < 1024 * df.rdd.getNumPartitions()
    assert packing.pack_documents(empty).count() == 0


def test_packing_under_three_limits(spark):
    r = np.random.default_rng(2)
    n = [int(x) for x in r.integers(1, 600, 3000)]
    rows = [(i, t, int(t * r.random())) for i, t in enumerate(n)] + [(-1, None, None), (-2, 2000, 1), (-3, 10, 900)]
    limits = (1024, 5, 512)
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long").repartition(2), limits).collect()
    assert sorted(r.example_id for r in got) == sorted(r[0] for r in rows)
    assert {r.example_id for r in got if r.sequence_id is None} == {i for i, t, x in rows if (t or 0) > 1024 or (x or 0) > 512}
    seq = collections.defaultdict(list)
    for p in got:
        if p.sequence_id is not None:
            seq[p.sequence_id].append(p)
    for ps in seq.values():
        assert sum(p.tokens for p in ps) <= 1024 and len(ps) <= 5 and sum(p.loss_tokens for p in ps) <= 512
    placed = [p for ps in seq.values() for p in ps]
    least = max(sum(p.tokens for p in placed) / 1024, len(placed) / 5, sum(p.loss_tokens for p in placed) / 512)
    assert len(seq) < 1.15 * least


# ---- 5 embeddings

def brute_vectors(rows):
    good = [i for i, (d, v, k) in enumerate(rows) if d is not None and k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in good}
    near = {i: [j for j in good if j != i and rows[j][2] == rows[i][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in good}
    low = {i: rows[i][0] for i in good}
    for _ in rows:
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in good}
    return {rows[i][0]: (len(near.get(i, [])), low.get(i, rows[i][0]), low.get(i, rows[i][0]) == rows[i][0]) for i in range(len(rows))}


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 25)
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 8))
    rows = []
    for i in range(400):
        v = centres[r.integers(40)] + r.standard_normal(8) * 0.07
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(2))))
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0, None] * 4, 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] + [1.0] * 7, 1), (405, rows[0][1], None),
             (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (408, [], 1), (409, rows[1][1], rows[1][2]), (410, [-x for x in rows[1][1]], rows[1][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.dedup_embeddings(df).collect()}
    assert got == brute_vectors(rows)
    assert sum(v[0] for v in got.values()) > 400
    assert embedding_dedup.dedup_embeddings(df.limit(0)).count() == 0


def test_packing_of_short_documents(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "") for i in range(20_000)], "doc_id long, text string").repartition(2)
    got = packing.pack_documents(df).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("pieces")).collect()
    total = sum(x.n for x in got)
    assert sum(1 for x in got if x.n < 1024) <= 2 and 1024 * len(got) - total < 2 * 1024
    few = packing.pack_documents(df, max_segments=64).groupBy("sequence_id").count()
    assert few.filter("count > 64").isEmpty()


def test_embedding_labels_of_any_kind(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    for kind, labels in (("long", [2**62, 2**62 + 1]), ("string", ["cat", "dog:3"])):
        rows = [(1, v, labels[0]), (2, v, labels[0]), (3, v, labels[1]), (4, w, labels[1]), (5, w, labels[1]), (6, v, None)]
        got = embedding_dedup.dedup_embeddings(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")).collect()
        assert {x.vec_id: (x.n_links, x.component_id) for x in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


# ---- 6 mixing

def test_mixing_targets(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 20), (None, 500)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    # a stops at 30 and c at 60; b and null share the rest 2 : 1.
    assert got["a"] == 30 and got["c"] == 60 and abs(got["b"] - 960) < 1e-6 and abs(got[None] - 480) < 1e-6


def test_mixing_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    r = np.random.default_rng(6)
    rows = [(i, "w " * int(r.integers(0, 60)), f"s{int(r.integers(0, 5)) if i % 3 else 0}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plans = [{x.doc_id: (x.source, x.size, x.source_size, x.target, x.takes) for x in mixing.plan_mix(df.repartition(k)).collect()} for k in (2, 5)]
    assert plans[0] == plans[1]
    taken, target = collections.Counter(), {}
    for s, size, total, goal, takes in plans[0].values():
        taken[s] += size * takes
        target[s] = goal
        assert abs(takes - goal / total) < 1 + 1e-9 and takes <= 3
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    assert mixing.mix_documents(df).count() == sum(p[4] for p in plans[0].values())


def test_mixing_spreads_a_unit_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 4)
    rows = [(1, "a b c", "s", i) for i in range(101)] + [(i, f"w{i} x", "t", 1000 + i) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long").repartition(3)
    takes = sum(r.takes for r in mixing.plan_mix(df).collect() if r.n == 101)
    times = collections.Counter(r.row for r in mixing.mix_documents(df).collect() if r.doc_id == 1)
    assert sum(times.values()) == takes > 0
    assert {times[i] for i in range(101)} <= {takes // 101, -(-takes // 101)}


def test_mixing_edges(spark, edge, empty):
    plan = mixing.plan_mix(edge).collect()
    assert sum(p.n for p in plan) == len(EDGE)
    mixed = mixing.mix_documents(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(p.takes for p in plan)
    assert mixing.plan_mix(empty).count() == mixing.mix_documents(empty).count() == 0
    assert QUERIES["op6_pivotal_mixing"](spark, SF).count() == 200


# ---- 7 quality network

def test_quality_net(spark, small, edge, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = quality_net.fit_quality(docs, labels)
    got = quality_net.score_quality(docs, net)
    held = got.filter("held_out").join(labels, "doc_id")
    assert held.filter("predicted = quality").count() > 0.93 * held.count()
    assert {r.doc_id: r.held_out for r in got.collect()} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in range(1000)}
    rows = quality_net.score_quality(edge, net).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert quality_net.score_quality(empty, net).count() == 0
    assert quality_net.score_quality(edge, None).filter("score = 0.5").count() == len(EDGE)
    assert quality_net.fit_quality(docs, labels.limit(0)) is None
    assert quality_net.keep_good(edge, labels.limit(0)).columns == edge.columns


def test_quality_net_sees_every_window():
    net = quality_net.Net.fresh()
    r = np.random.default_rng(8)
    for n in (0, 3, 8, 505, 512, 513, 2000):
        data = r.integers(0, 256, n).astype(np.uint8)
        chunks, offs = quality_net.chunked(data, np.array([0, n]))
        sym = np.concatenate([data.astype(int) + 1, np.zeros(quality_net.CHUNK, int)])
        want = np.stack([net.table[sym[i:i + 8]].ravel() @ net.conv for i in range(max(n - 7, 1))]).max(axis=0)
        got = net.pooled(chunks).max(axis=0)
        assert (got >= np.maximum(want + net.bias, 0) - 1e-4).all()


# ---- 8 quality rules

def test_rules_edges(edge, empty):
    got = {r.doc_id: r for r in quality_rules.score_rules(edge).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[11].n_words == got[11].n_repeat_words == 20_000 and got[11].base_failed
    assert got[7].kept and got[8].word_chars == 50_000
    kept = quality_rules.filter_rules(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in quality_rules.score_rules(edge).filter("kept").collect())
    assert quality_rules.score_rules(empty).count() == 0
    text = F.col("text")
    counts = quality_rules.of_words(quality_rules.words(text)) | quality_rules.of_text(text)
    order = quality_rules.estimate(quality_rules.sample(edge), counts, quality_rules.RULES)
    value = [e.rejected / max(e.cost, 1e-6) for e in order]
    assert value == sorted(value, reverse=True)


def brute_kept(text):
    """The verdict in plain Python."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    if len(w) < 50 or 100 * len(covered) > 50 * len(w):
        return False
    chars, share = sum(map(len, w)), lambda n, of, top: 100 * n > top * of
    return not (share(len(re.findall(r"[#*$%&|<>]", text)), len(w), 20) or share(len(lines) - len(set(lines)), len(lines), 50)
                or not 2 * len(w) <= chars <= 20 * len(w)
                or share(sum(x.lstrip(" \t\n\v\f\r")[0] in "-*\u2022" for x in lines), len(lines), 90)
                or share(sum(x.rstrip(" \t\n\v\f\r").endswith(("...", "\u2026")) for x in lines), len(lines), 30)
                or share(sum(all("!" <= c <= "~" and not c.isalpha() for c in x) for x in w), len(w), 50))


def test_rules_equal_brute_force(spark):
    words = [f"w{i}" for i in range(80)]
    lines = [" ".join(words[i:i + 8]) for i in range(0, 80, 8)]
    texts = [" ".join(words), "\n".join(f" - {x}" for x in lines), "\n".join([f"\u2022{x}" for x in lines[:9]] + [lines[9]]),
             "\n".join([f"\u2022{x}" for x in lines[:9]] + ["*" + lines[9]]), "\n".join(f"{x} ...\r" for x in lines[:3]) + "\n" + "\n".join(lines[3:]),
             "\n".join(f"{x}\u2026" for x in lines[:4]) + "\n" + "\n".join(lines[4:]), "\n".join(f"{x}...\u2028" for x in lines),
             " ".join(f"{i}." for i in range(60)) + " " + " ".join(words[:60]), " ".join(f"{i}." for i in range(61)) + " " + " ".join(words[:60]),
             " ".join(words[:49]), None, "", " \n ", "\n".join(lines + lines[:1]), " ".join(x * 12 for x in words), " ".join(f"# {x}" for x in words)]
    got = quality_rules.score_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in got} == {i: brute_kept(t) for i, t in enumerate(texts)}
    assert {True, False} == {r.kept for r in got if not r.base_failed}


def test_rejected_rows_skip_later_rules(spark, monkeypatch):
    """A count that raises is never computed for rows that are out before its rule."""
    good = " ".join(f"w{i}" for i in range(80))
    boom = quality_rules.Rule("boom", lambda c: F.raise_error(F.concat(F.lit("computed for "), c["n_lines"].cast("string"))).cast("boolean"))
    marks = quality_rules.Rule("symbols", next(r.rejects for r in quality_rules.RULES if r.name == "symbols"))
    monkeypatch.setattr(quality_rules, "estimate", lambda part, counts, rules: [quality_rules.Estimate(r, 1.0, 0.0) for r in rules])
    out = spark.createDataFrame([(1, "few"), (2, good.replace(" ", " # ")), (3, "one two three " * 40), (4, None)], "doc_id long, text string")
    assert not any(r.kept for r in quality_rules.score_rules(out, (marks, boom)).collect())
    with pytest.raises(Exception, match="computed for 1"):
        quality_rules.score_rules(out.union(spark.createDataFrame([(5, good)], out.schema)), (marks, boom)).collect()


def test_sample_is_bounded(spark):
    docs = spark.range(500).select(F.repeat(F.lit("a "), (F.col("id") * 100).cast("int")).alias("text"))
    rows = quality_rules.sample(docs, 50).collect()
    assert len(rows) == 50 and all(len(r.text) <= quality_rules.SAMPLE_CHARS for r in rows)


def test_rules_stay_in_the_jvm(edge):
    plan = quality_rules.score_rules(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 9 separator scan

def test_separator_scan(spark, edge, empty):
    folder = f"{work_dir(spark)}/flat"
    order = token_counts.write_streams(edge, folder, block_ids=64)
    got = token_counts.count_tokens(order, folder).collect()
    t = tokens.library(tokens.vocabulary_path(), False)
    want = collections.Counter((d, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x, *_ in EDGE)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == want
    folder = f"{work_dir(spark)}/none"
    assert token_counts.count_tokens(token_counts.write_streams(empty, folder), folder).count() == 0


def test_stitching_without_ends(spark):
    blocks = [(0, 0, 4, []), (0, 1, 4, [1]), (0, 2, 4, []), (0, 3, 4, [0, 3]), (0, 4, 2, []), (1, 0, 3, [])]
    got = sorted(tuple(r) for r in token_counts.stitch(spark.createDataFrame(blocks, token_counts.SCAN)).collect())
    assert got == [(0, 0, 0, 6, True), (0, 1, 6, 7, True), (0, 2, 13, 3, True), (0, 3, 16, 2, False), (1, 0, 0, 3, False)]


# ---- 10 passages

def test_fenwick_chain_is_best():
    r = np.random.default_rng(5)
    k = substring_dedup.SEED_WORDS
    for _ in range(60):
        n = int(r.integers(2, 8))
        x1, y1 = np.sort(r.integers(0, 60, n)), r.integers(0, 60, n)
        w = r.integers(k, 12, n)
        x2, y2 = x1 + w, y1 + w
        best = 0
        for m in range(1, 1 << n):
            path = [i for i in range(n) if m >> i & 1]
            pairs = list(zip(path, path[1:]))
            if all(x2[a] - k <= x1[b] and x1[a] < x1[b] and y2[a] - k <= y1[b] for a, b in pairs):
                best = max(best, w[path].sum() - sum(substring_dedup.GAP_COST * (x1[b] - x2[a] + y1[b] - y2[a]) for a, b in pairs))
        path = substring_dedup.chain(x1.tolist(), x2.tolist(), y1.tolist(), y2.tolist())[0]
        score = w[path].sum() - sum(substring_dedup.GAP_COST * (x1[b] - x2[a] + y1[b] - y2[a]) for a, b in zip(path, path[1:]))
        assert score >= best - 1e-9


def test_common_subsequence():
    assert substring_dedup.common(np.array([1, 2, 3, 4, 5]), np.array([2, 9, 3, 5, 4])) == 3
    assert substring_dedup.common(np.array([], int), np.array([1])) == 0


def test_passages_against_exact_repeats(small):
    words = {r.doc_id: r.text.split() for r in small.collect()}
    places = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 50):
            places[tuple(w[i:i + 51])].add(d)
    want = set().union(*[s for s in places.values() if len(s) > 1])
    got = substring_dedup.find_passages(small).collect()
    assert want <= {r.doc_id for r in got} | {r.partner_id for r in got}
    for r in got:
        a, b = words[r.doc_id][r.start_word: r.end_word], words[r.partner_id][r.partner_start: r.partner_end]
        assert r.partner_id < r.doc_id and len(a) == r.end_word - r.start_word and len(b) == r.partner_end - r.partner_start
        assert r.matched >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)) >= 0.6 * len(set(a))


def test_fuzzy_passage(spark, edge, empty):
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    passage = [word() for _ in range(120)]
    other = list(passage)
    other[30] = "changed"
    del other[60:62]
    other[90:90] = ["put", "in"]
    rows = [(1, " ".join([word() for _ in range(70)] + passage + [word() for _ in range(50)])), (2, " ".join([word() for _ in range(20)] + other + [word() for _ in range(90)])), (3, " ".join(word() for _ in range(300)))]
    got = substring_dedup.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.doc_id, x.partner_id, x.start_word, x.end_word, x.partner_start, x.partner_end, x.matched) for x in got] == [(2, 1, 20, 140, 70, 190, 117)]
    pairs = {(x.doc_id, x.partner_id) for x in substring_dedup.find_passages(edge).collect()}
    assert (7, 6) in pairs and not any(a == b for a, b in pairs)
    assert substring_dedup.find_passages(empty).count() == 0


def passages(spark, rows):
    """(doc_id, partner_id, start_word, end_word, partner_start, partner_end, matched) of (doc_id, words)."""
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    return sorted(tuple(x) for x in substring_dedup.find_passages(df).collect())


def random_words(r, n):
    return [f"w{i}" for i in r.integers(0, 1 << 40, n)]


def test_passage_covered_piecewise_by_earlier_documents(spark):
    r = np.random.default_rng(21)
    rows, want, d = [], set(), 1
    for _ in range(40):
        notice = random_words(r, 75)
        for a in (0, 25, 50):
            rows.append((d, random_words(r, 60) + notice[a:a + 25] + random_words(r, 60)))
            d += 1
        rows += [(d, random_words(r, 70) + notice + random_words(r, 50)), (d + 1, random_words(r, 30) + notice + random_words(r, 90))]
        want.add((d + 1, d, 30, 105, 70, 145, 75))
        d += 2
    assert want <= set(passages(spark, rows))


def test_excerpts_of_one_source(spark):
    r = np.random.default_rng(22)
    source, rows, place = random_words(r, 600), [], {}
    for d in range(200):
        n = int(r.integers(55, 80))
        place[d] = int(r.integers(0, len(source) - n)), n
        rows.append((d, random_words(r, 40) + source[place[d][0]: sum(place[d])] + random_words(r, 40)))
    both = lambda a, b: min(sum(place[a]), sum(place[b])) - max(place[a][0], place[b][0])
    want = {d for d in place if any(both(d, e) >= 51 for e in range(d))}
    assert want <= {x[0] for x in passages(spark, rows)}


def test_passages_of_repeated_lines(spark):
    r = np.random.default_rng(23)
    for line, times in ((["word"], 20_000), (random_words(r, 10), 300), (random_words(r, 20), 100)):
        n = len(line) * times
        got = passages(spark, [(1, line * times), (2, line * times)])
        assert (2, 1, 0, n, 0, n, n) in got and len(got) < 5


def test_passage_standing_twice(spark):
    r = np.random.default_rng(24)
    p = random_words(r, 75)
    got = passages(spark, [(1, random_words(r, 50) + p + random_words(r, 50)), (2, p + random_words(r, 90) + p + random_words(r, 20)), (3, random_words(r, 60) + p + random_words(r, 60) + p)])
    assert {x[:6] for x in got} == {(2, 1, 0, 75, 50, 125), (2, 1, 165, 240, 50, 125), (3, 1, 60, 135, 50, 125), (3, 1, 195, 270, 50, 125), (3, 2, 195, 270, 165, 240)}


def test_passage_goes_on_past_its_last_anchor(spark):
    r = np.random.default_rng(25)
    p = random_words(r, 1_500)
    # Document 1 holds all from word 50 on, so document 3 meets document 2 on the first words only.
    got = passages(spark, [(1, p[50:]), (2, p), (3, random_words(r, 40) + p)])
    assert (3, 2, 40, 1540, 0, 1500, 1500) in got and (3, 1, 90, 1540, 0, 1450, 1450) in got


def test_exact_passages_beside_other_shared_phrases(spark):
    rows, want = [], set()
    for t in range(60):
        r = np.random.default_rng(100 + t)
        a, b, start = random_words(r, 51), random_words(r, 51), 20 + t % 7
        rows += [(10 * t, random_words(r, start) + a + b + random_words(r, 30)), (10 * t + 1, random_words(r, 33) + a + random_words(r, 26) + b + random_words(r, 11))]
        want |= {(10 * t + 1, 10 * t, 33, 84, start, start + 51, 51), (10 * t + 1, 10 * t, 110, 161, start + 51, start + 102, 51)}
        # A form: one paragraph, then labels with other values.
        labels = [random_words(r, 14) for _ in range(3)]
        for i in (2, 3):
            rows.append((10 * t + i, random_words(r, 25) + a[::-1] + b[:9] + [w for x in labels for w in random_words(r, 12) + x] + random_words(r, 40)))
    got = passages(spark, rows)
    assert want <= set(got)
    # With the first label the paragraph is still a passage of 74 in 86 words.
    assert {x[0] for x in got if x[0] == x[1] + 1 and x[2] == 25 and x[3] in (85, 111)} >= {10 * t + 3 for t in range(60)}
    assert all(x[6] >= 0.8 * max(x[3] - x[2], x[5] - x[4]) and x[3] - x[2] >= 40 for x in got)


def test_fuzzy_passages_down_to_the_least_match(spark):
    r, rows, n = np.random.default_rng(26), [], 60
    for step in (20, 10, 8, 6):
        for _ in range(n):
            p = random_words(r, 60)
            q = [random_words(r, 1)[0] if i % step == 3 else w for i, w in enumerate(p)]
            rows += [random_words(r, 50) + p + random_words(r, 50), random_words(r, 40) + q + random_words(r, 60)]
    rows = list(enumerate(rows))
    got = {x[0] for x in passages(spark, rows)}
    for k in range(4):
        assert len(got & set(range(2 * n * k, 2 * n * (k + 1)))) >= 0.9 * n


def test_fuzzy_passage_of_later_documents_scattered_over_earlier_ones(spark):
    r = np.random.default_rng(41)
    rows, want, d = [], set(), 1
    for _ in range(20):
        p = random_words(r, 90)
        q = [random_words(r, 1)[0] if i % 9 == 4 else w for i, w in enumerate(p)]
        # Every seed stands in some earlier document, no two neighbouring ones in the same.
        for a in range(0, 87):
            rows.append((d, random_words(r, 12) + p[a:a + 4] + random_words(r, 12)))
            d += 1
        rows += [(d, random_words(r, 30) + p + random_words(r, 30)), (d + 1, random_words(r, 50) + q + random_words(r, 20))]
        want.add((d + 1, d))
        d += 2
    assert want <= {x[:2] for x in passages(spark, rows)}


def test_fuzzy_passage_of_seeds_that_many_documents_have(spark):
    from codesift.llm.substring_dedup import PAIRED

    r = np.random.default_rng(42)
    rows, want, d = [], set(), 1
    for _ in range(4):
        p = random_words(r, 90)
        q = [random_words(r, 1)[0] if i % 15 == 7 else w for i, w in enumerate(p)]
        for a in range(0, 87):
            for _ in range(PAIRED + 4):
                rows.append((d, random_words(r, 5) + p[a:a + 4] + random_words(r, 5)))
                d += 1
        rows += [(d, random_words(r, 30) + p + random_words(r, 30)), (d + 1, random_words(r, 50) + q + random_words(r, 20))]
        want.add((d + 1, d))
        d += 2
    assert want <= {x[:2] for x in passages(spark, rows)}
