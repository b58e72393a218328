"""Operators against brute force on small fixtures, and edge cases."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.functions import features as fx
from codesift.functions import reports as rx
from codesift.operators import aggregates, clusters, features, merge, nearest, packing, paths, reports, responses, retrieval
from codesift.operators.components import connected_components
from codesift.plans import render
from codesift.plans.passes import plan_passes
from codesift.plans.render import map_in_order, map_rows, map_section, prompt_rows, report_in_order, report_rows, summarize_files
from codesift.workloads import catalog, corpus, storage

HEADERS = {
    "## [H-01] Title": ("H-01", "High"), "## [H-01]: Title": ("H-01", "High"), "## H-01: Title": ("H-01", "High"),
    "## **[H-01]** Title": ("H-01", "High"), "### [MEDIUM] Title": ("MEDIUM", "Medium"), "## [M–02] En dash": ("M–02", "Medium"),
    "## V2 migration": ("V2", "Info"), "## High risk findings": ("High", "High"), "## [CRITICAL] x": ("CRITICAL", "Critical"),
    "## [INFORMATIONAL] x": ("INFORMATIONAL", "Info"), "## S-01 x": ("S-01", "Info"),
    "## Issue 1: Title": None, "## Finding 1 (High): Title": None, "## [H-01]": None, "##### [H-01] x": None, "# LOW": None, "## 5.1 Overview": None,
}


def test_report_headers(spark):
    rows = [("f", "a.md", f"f/{i}.md", f"{h}\nbody text") for i, h in enumerate(HEADERS)]
    df = spark.createDataFrame(rows, "firm string, filename string, rel_path string, content string")
    got = {r["rel_path"]: (r["finding_id"].split("__")[-1], r["severity"]) for r in reports.parse_reports(df).collect()}
    assert got == {f"f/{i}.md": want for i, want in enumerate(HEADERS.values()) if want}


def test_gas_text_stays_or_goes(spark):
    text = "## [H-01] First bug\nreentrancy here\n## [G-01] Save gas\ngas text\n## [L-02] x\n\n## QA-1 y\n## [M-03]:\n**Bold title** line\n| a"
    df = spark.createDataFrame([("f", "2024-01-01.md", "f/a.md", text)], "firm string, filename string, rel_path string, content string")
    got = [tuple(r) for r in reports.parse_reports(df).orderBy("section_no").select("title", "description", "category", "protocol").collect()]
    assert got[0] == ("First bug", "reentrancy here\n## [G-01] Save gas\ngas text", "reentrancy", "2024-01-01.md")
    assert [g[:2] for g in got[1:]] == [("x", "## QA-1 y"), ("Bold title line", "**Bold title** line\n| a")]
    strict = reports.parse_reports(df, faithful=False).select("description").collect()
    assert sorted(r[0] for r in strict) == ["**Bold title** line\n| a", "reentrancy here"]


def test_protocol_names(spark):
    names = {"2023-07-26-Buffer-v2.5.md": "Buffer-v2.5", "2024-09-22-stUSDCxBloom.md": "stUSDCxBloom", "Ubet-Parlay-Security-Audit.md": "Ubet-Parlay",
             "2024-01-01-Foo-audit-v1.2.md": "Foo", "audit.md": "audit", "2024-01-01.md": "2024-01-01.md"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", rx.extract_protocol(F.col("n"))).collect()} == names


def test_split_text():
    text = "para one " * 30 + "\n\n" + "line\n" * 100 + "x" * 1000
    chunks = reports.split_text(text, 200, 50)
    assert all(len(c) <= 200 for c in chunks) and all(c == c.strip() and c for c in chunks)
    assert set("".join(chunks)) >= set(text.replace(" ", "").replace("\n", ""))
    assert reports.split_text("short", 800, 200) == ["short"]
    assert reports.split_text("aa bb cc dd", 6, 2) == ["aa bb", "cc dd"]


def test_chunk_modes(spark):
    df = spark.createDataFrame([("d", "word " * 500)], "finding_id string, page_content string")
    stride = reports.chunk_documents(df).orderBy("chunk_index").collect()
    assert [len(r["page_content"]) for r in stride] == [800, 800, 800, 700] and stride[1]["page_content"] == ("word " * 500)[600:1400]
    soft = reports.chunk_documents(df, mode="separators").collect()
    assert all(len(r["page_content"]) <= 800 for r in soft) and soft[0]["chunk_index"] == 0


@pytest.mark.parametrize("path,kept", [
    ("src/Vault.sol", True), ("contracts/a/B.rs", True), ("lib/x.sol", False), ("a/test/B.sol", False), ("B.t.sol", False), ("B.s.sol", False),
    ("node_modules/x.js", False), ("README.md", False), ("data/x.sol", False), ("x.json/B.sol", False), ("a\\test\\B.sol", False), ("Library.sol", True)])
def test_skip(spark, path, kept):
    df = spark.createDataFrame([("p", path)], "project_id string, path string")
    assert (features.path_skip_filter(df).count() == 1) == kept


def test_scores_and_imports(spark):
    rows = [("a.sol", 'import {A} from "./A.sol";\nimport "./B.sol";\ninterface X\n'), ("b.rs", "mod vault;\nuse crate::state::Pool;"), ("c.vy", "deposit(); x.call(1)")]
    df = features.featurize_files(spark.createDataFrame([("p", *r) for r in rows], "project_id string, path string, content string"))
    got = {r["path"]: (r["language"], round(r["attack_score"], 2), r["imports"]) for r in df.collect()}
    assert got["a.sol"] == ("solidity", 0.0, ["./A.sol", "./B.sol"])
    assert got["b.rs"][2] == ["vault", "Pool"] and got["c.vy"][:2] == ("other", 0.55)


def test_project_name_forms(spark):
    df = spark.createDataFrame([("src/A.sol",), ("A.sol",), ("./b/A.sol",)], "p string")
    assert [r[0] for r in df.select(fx.project_name(F.col("p"))).collect()] == ["src", "Protocol", "b"]


def test_budgets():
    want = {(32_768, False): 84_288, (32_768, True): 60_288, (65_536, False): 215_360, (65_536, True): 191_360, (100, False): 0}
    assert {k: aggregates.code_budget(*k) for k in want} == want


def _pack_slow(files, budget, max_files, max_batches):
    left = sorted(files, key=lambda f: (-f[2], f[0]))
    out = []
    for batch in range(1, max_batches + 1):
        room, taken, rest = budget, [], []
        for f in left:
            if len(taken) < max_files and f[1] <= room:
                taken.append(f)
                room -= f[1]
            else:
                rest.append(f)
        out += [(batch, i + 1, f[0]) for i, f in enumerate(taken)]
        left = rest
        if not taken or not left:
            break
    return out


@pytest.mark.parametrize("seed,max_files,max_batches", [(1, 3, 4), (2, 5, 2), (3, 2, 50), (4, 10, 1)])
def test_packing_matches_slow_fill(spark, seed, max_files, max_batches):
    rng = random.Random(seed)
    files = [(f"f{i:04d}", rng.choice([0, 1, 5, 90, 400, 999, 1000, 1001, rng.randint(1, 1200)]), rng.randint(0, 19) / 20) for i in range(600)]
    df = spark.createDataFrame([("p", *f) for f in files], "project_id string, path string, size long, attack_score double")
    got = packing.greedy_pack(df, 1000, max_files, max_batches)
    assert sorted((r["batch_no"], r["place"], r["path"]) for r in got.collect()) == sorted(_pack_slow(files, 1000, max_files, max_batches))
    near = packing.candidates(df, 1000, max_files * max_batches, [-F.col("attack_score"), F.col("path")])
    assert near.count() <= len(files)


def test_packing_prunes_hot_project(spark):
    df = spark.range(20_000).selectExpr("'p' as project_id", "concat('f', id) as path", "pmod(xxhash64(id), 900) + 1 as size",
                                        "pmod(xxhash64(id, 7), 1000) / 1000.0 as attack_score")
    assert packing.candidates(df, 1000, 20, [-F.col("attack_score"), F.col("path")]).count() < 5_000


def test_oversize_files(spark):
    df = spark.createDataFrame([("p", "a", 5000, 0.5), ("q", "b", 10, 0.5)], "project_id string, path string, size long, attack_score double")
    packed = packing.pack_initial(df, 1000)
    assert [r["project_id"] for r in packed.collect()] == ["q"]
    assert [r["project_id"] for r in packing.empty_batches(df, packed, 1000).collect()] == ["p"]


def test_substring_join(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    n = spark.createDataFrame([(f"p{i % 2}", w) for i, w in enumerate(words[:60])], "project_id string, needle string")
    h = spark.createDataFrame([(f"p{i % 2}", w) for i, w in enumerate(words[60:])], "project_id string, hay string")
    want = {(p, a, b) for (p, a), (q, b) in itertools.product([(f"p{i % 2}", w) for i, w in enumerate(words[:60])],
                                                             [(f"p{i % 2}", w) for i, w in enumerate(words[60:])]) if p == q and a in b}
    assert {tuple(r) for r in paths.substring_join(n, h).collect()} == want


def test_fuzzy_paths(spark):
    notes = spark.createDataFrame([("p", "Vault.sol"), ("p", "repo/src/Vault.sol"), ("p", "core/Pool.s"), ("q", "Vault.sol")],
                                  "project_id string, target_file string")
    files = spark.createDataFrame([("p", "src/Vault.sol"), ("p", "core/Pool.sol"), ("p", "x/Vault.sol")], "project_id string, path string")
    got = {(r["target_file"], r["path"]) for r in paths.fuzzy_path_join(notes, files).collect()}
    assert got == {("Vault.sol", "src/Vault.sol"), ("Vault.sol", "x/Vault.sol"), ("repo/src/Vault.sol", "src/Vault.sol"),
                   ("repo/src/Vault.sol", "x/Vault.sol"), ("core/Pool.s", "core/Pool.sol")}


def test_import_neighbours(spark):
    files = spark.createDataFrame([("p", "a/A.sol", ["./B.sol"]), ("p", "a/B.sol", []), ("p", "a/C.sol", ["../a/A.sol"]), ("p", "a/D.sol", ["./E.sol"])],
                                  "project_id string, path string, imports array<string>")
    got = paths.import_neighbours(files, files.filter("path = 'a/A.sol'"))
    assert sorted(r["path"] for r in got.collect()) == ["a/B.sol", "a/C.sol"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 150):03d}", f"n{rng.randint(0, 150):03d}") for _ in range(110)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


FINDING = "finding_id string, project_id string, file string, line int, category string, title string, auditor_id string, severity string"


def test_merge(spark):
    rows = [("1", "p", "a", 10, "dos", "Loop over users", "x", "Low"), ("2", "p", "a", 14, "dos", "Different words here", "y", "High"),
            ("3", "p", "a", 19, "dos", "Third one entirely", "z", "Info"), ("4", "p", "a", 90, "math", "Loop over all users", "w", "Low"),
            ("5", "p", "b", 10, "dos", "Loop over users", "x", "Low"), ("6", "q", "a", 10, "dos", "Loop over users", "x", "Low")]
    got = {r["merge_key"]: (r["n_findings"], r["severity"], round(r["confidence"], 6), r["auditors"], r["project_id"])
           for r in merge.merge_findings(spark.createDataFrame(rows, FINDING)).collect()}
    assert got == {"1": (4, "High", 1.0, ["w", "x", "y", "z"], "p"), "5": (1, "Low", 0.6, ["x"], "p"), "6": (1, "Low", 0.6, ["x"], "q")}


@pytest.mark.parametrize("n,want", [(1, 0.6), (2, 0.8), (3, 1.0), (4, 1.0)])
def test_confidence(spark, n, want):
    rows = [(str(i), "p", "a", 1, "dos", "Same title", f"a{i}", "Low") for i in range(n)]
    assert merge.merge_findings(spark.createDataFrame(rows, FINDING)).first()["confidence"] == pytest.approx(want)


RESPONSES = {
    "bare": '[{F}]', "fenced": 'text\n```json\n{"findings": [{F}]}\n```\nmore', "prose": "see below: [{F}]", "object": 'so: {F}',
    "think": "<think>a[0] {b}</think>[{F}]", "truncated": '[{F}', "empty": "", "scalar": "3", "cut": '[{"severity": "High"',
}
F_JSON = ('{"severity": "High", "title": "Title", "file": "a.sol", "line": 3, "description": "a long enough description", '
          '"exploit": "exploit text", "recommendation": "fix it please"}')


def test_responses(spark):
    rows = [(i, "x", 1, t.replace("{F}", F_JSON)) for i, t in enumerate(RESPONSES.values())]
    found, _, rejects = responses.parse_responses(spark.createDataFrame(rows, "resp_id long, auditor_id string, pass_no int, raw string"))
    names = list(RESPONSES)
    assert {names[r["resp_id"]] for r in found.collect()} == {"bare", "fenced", "prose", "think"}
    # The truncated one still ends in a whole object, which holds no findings.
    assert {names[r["resp_id"]] for r in rejects.collect()} == {"cut"}


@pytest.mark.parametrize("change", ['"line": -1', '"line": 1.5', '"line": "3"', '"title": "T"', '"title": 12345', '"severity": "high"', '"file": null'])
def test_invalid_findings(spark, change):
    field = change.split(":")[0]
    parts = [p for p in F_JSON[1:-1].split(", ") if not p.startswith(field)] + [change]
    rows = [(1, "x", 1, "[{" + ", ".join(parts) + "}]")]
    found, _, rejects = responses.parse_responses(spark.createDataFrame(rows, "resp_id long, auditor_id string, pass_no int, raw string"))
    assert found.count() == 0 and [r["reason"] for r in rejects.collect()] == ["finding not valid"]


def test_notes(spark):
    raw = ('{"findings": [], "suspicions": [{"targetFile": "a", "reason": "long enough", "confidence": 1}]}\nSUSPICIONS: here '
           '[{"targetFile": "b", "targetFunction": "f()", "reason": "long enough", "confidence": 0.5}, {"targetFile": "c", "reason": "short", "confidence": 0.5}, '
           '{"targetFile": "d", "targetFunction": null, "reason": "long enough", "confidence": 0.5}]')
    _, notes, rejects = responses.parse_responses(spark.createDataFrame([(1, "x", 1, raw)], "resp_id long, auditor_id string, pass_no int, raw string"))
    assert sorted((r["target_file"], r["target_function"]) for r in notes.collect()) == [("a", None), ("b", "f()")]
    assert rejects.count() == 2


def _vectors(spark, n, groups, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(groups)), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, grp int, vec array<double>")


def _topk_slow(left, right, k, metric):
    out = []
    for i, g, v in left:
        def score(w):
            v_, w_ = np.array(v), np.array(w)
            if metric == "l2":
                return -float(((v_ - w_) ** 2).sum())
            n = np.sqrt((v_ ** 2).sum()) * np.sqrt((w_ ** 2).sum())
            return round(float(v_ @ w_ / n), 6) if n else 0.0
        out += [(i, g, j) for _, j in sorted((-score(w), j) for j, h, w in right if h == g)[:k]]
    return sorted(out)


@pytest.mark.parametrize("metric,k", [("cosine", 3), ("l2", 1), ("cosine", 40)])
def test_nearest_all_paths(spark, metric, k, monkeypatch):
    left, ldf = _vectors(spark, 25, 3, 1)
    right, rdf = _vectors(spark, 60, 3, 2)
    want = _topk_slow(left, right, k, metric)

    def pairs(df):
        return sorted((r["left_id"], r["grp"], r["right_id"]) for r in df.collect())

    assert pairs(nearest.topk_in_group(ldf, rdf, k, metric)) == want
    monkeypatch.setattr(nearest, "collect_bounded", lambda df, b: df.toPandas() if df.count() > 30 else None)
    assert pairs(nearest.topk_in_group(ldf, rdf, k, metric)) == want
    monkeypatch.setattr(nearest, "collect_bounded", lambda df, b: None)
    monkeypatch.setattr(nearest, "LEFT_BLOCK", 4)
    assert pairs(nearest.topk_in_group(ldf, rdf, k, metric)) == want
    blocked = nearest._blocked(ldf, rdf, 1000, metric, left_block=4, right_block=5)
    assert blocked.count() == sum(1 for a in left for b in right if a[1] == b[1])


def test_retrieval_falls_back(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    docs = spark.createDataFrame([(7, [1.0, 0.0], 0), (8, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, cluster_id int")
    none = spark.createDataFrame([], "cluster_id int, label string, vector array<double>, size long")
    assert [(r["rank"], r["vec_id"]) for r in retrieval.retrieve_diverse(q, docs, none).orderBy("rank").collect()] == [(1, 7), (2, 8)]
    far = spark.createDataFrame([(5, "x", [1.0, 0.0], 1)], "cluster_id int, label string, vector array<double>, size long")
    assert retrieval.retrieve_diverse(q, docs, far).count() == 2
    empty = spark.createDataFrame([], "query_id long, rank int, label string, severity string, protocol string, page_content string")
    assert retrieval.retrieve_format(q, empty).first()["context"] == retrieval.NOTHING


def test_clusters(spark):
    rows = [(i, [float(i % 3) * 10, 0.1 * (i % 5)], ["a", "b", "a-x_1"][i % 3], f"text with oracle {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, category string, page_content string")
    docs, cents = clusters.build_store(df, 3)
    got = cents.collect()
    assert sorted(r["size"] for r in got) == [30, 30, 30] and len({r["label"] for r in got}) == 3 and not any("-" in r["label"] for r in got)
    step = clusters.kmeans_step(df, cents).collect()
    assert sorted(round(r["vector"][0], 6) for r in step) == [0.0, 10.0, 20.0]
    with pytest.raises(ValueError):
        clusters.fit_clusters(df.limit(2), 3)


def test_labels_are_unique(spark):
    rows = [(i, i % 3, "same", "vault pool text") for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, cluster_id int, category string, page_content string")
    assert sorted(r["label"] for r in clusters.label_clusters(df).collect()) == ["same", "same_vault", "same_vault_2"]


def _project(spark):
    rows = [("p", f"src/F{i}.sol", "solidity", 100 + i, 0.9 - i * 0.04, ["./F3.sol"] if i == 0 else []) for i in range(20)]
    return spark.createDataFrame(rows, "project_id string, path string, language string, size long, attack_score double, imports array<string>")


def test_passes(spark):
    files = _project(spark)
    notes = spark.createDataFrame([("p", 1, "F0.sol", "f()", "look here again", 0.9)],
                                  "project_id string, pass_no int, target_file string, target_function string, reason string, confidence double")
    plan = plan_passes(files, notes, 3, budget=100_000, max_files=5).collect()
    first = [r for r in plan if r["pass_no"] == 1]
    assert sorted(r["path"] for r in first) == sorted(r["path"] for r in files.collect())
    again = sorted((r["place"], r["path"]) for r in plan if r["pass_no"] == 2 and r["is_reaudit"])
    assert again == [(1, "src/F0.sol"), (2, "src/F3.sol")]
    assert not [r for r in plan if r["pass_no"] == 3]
    assert not [r for r in plan_passes(files, notes.filter("confidence > 1"), 3, budget=100_000).collect() if r["pass_no"] > 1]


def test_map_text(spark):
    files = _project(spark).filter("attack_score > 0.8")
    notes = spark.createDataFrame([("p", "src/F0.sol", 1, "f(): odd [confidence: 0.9]")], "project_id string, path string, pass_no int, note string")
    text = "\n".join(r["text"] for r in map_in_order(map_rows(summarize_files(files), notes)).collect())
    assert text.startswith("PROTOCOL MAP — src (3 files · solidity)\n" + "═" * 52 + "\n\n[src/F0.sol] score:0.90\n  What it does: Small solidity file")
    assert "  Calls into: ./F3.sol\n  ⚠ Suspicion [Pass 1]: f(): odd [confidence: 0.9]\n\n[src/F1.sol] score:0.86" in text
    assert text.endswith("\n\n" + "═" * 52)


def _jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_title_links_and_matches(spark):
    rng = random.Random(11)
    sets = [(f"s{i:03d}", "p", f"f{i % 2}", sorted(rng.sample("abcdefghijklmn", rng.choice([1, 2, 3, 4, 4, 5, 7, 8, 9, 11]))), f"m{i % 3}") for i in range(120)]
    df = spark.createDataFrame(sets, "id string, project_id string, file string, tokens array<string>, model string")
    want = {(a[0], b[0]) for a in sets for b in sets if a[2] == b[2] and a[0] < b[0] and _jaccard(a[3], b[3]) >= 0.5}
    links = {tuple(sorted((r["a"], r["b"]))) for r in merge.title_links(df).collect()}
    assert links <= want

    def roots(edges):
        root = {s[0]: s[0] for s in sets}
        for _ in range(len(sets)):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(links) == roots(want)
    got = {(r["id"], r["model"]) for r in merge.title_matches(df.filter("model = 'm0'"), df.filter("model <> 'm0'")).collect()}
    assert got == {(a[0], b[4]) for a in sets for b in sets if a[4] == "m0" and b[4] != "m0" and a[2] == b[2] and _jaccard(a[3], b[3]) >= 0.5}


def test_title_links_stay_linear_in_a_hot_file(spark):
    rows = spark.range(3000).selectExpr("concat('s', id) as id", "'p' as project_id", "'f' as file",
                                        "array_sort(array('check', 'missing', 'in', concat('fn', id))) as tokens")
    assert merge.title_links(rows).count() < 3 * 3000


def test_long_titles_stay_linear_in_a_hot_file(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("concat('s', id) as id", "'p' as project_id", "'f' as file", "concat('m', id % 2) as model",
                                        "array_sort(array('a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', concat('fn', id))) as tokens")
    links = merge.title_links(rows)
    assert links.select("a").distinct().count() >= 1999 and links.count() < 12 * 2000
    found = merge.title_matches(rows.filter("id < 's2'"), rows.filter("id >= 's2'"))
    assert found.count() == 2 * rows.filter("id < 's2'").count()


def test_packing_places_every_file(spark):
    files = [(f"f{i:03d}", 100, (i * 37 % 100) / 100) for i in range(700)] + [("big", 90_000, 1.0)]
    df = spark.createDataFrame([("p", *f) for f in files], "project_id string, path string, size long, attack_score double")
    packed = packing.pack_initial(df, 84_288)
    got = sorted((r["batch_no"], r["place"], r["path"]) for r in packed.collect())
    assert got == sorted(_pack_slow(files, 84_288, packing.MAX_FILES, 1000)) and len(got) == 700
    left = [tuple(r) for r in packing.unplaced(df, packed, 84_288).collect()]
    assert left == [("p", "big", 90_000, "over budget")]
    assert [tuple(r) for r in packing.empty_batches(df, packed, 84_288).collect()] == [("p", 71)]


def test_repeated_finding_ids_do_not_fan_out(spark):
    row = ("x", "p", "f", "auditor-1", 0, "High", "Unsafe transfer in a", 5, "dos")
    df = spark.createDataFrame([row, row, ("y", *row[1:])], "finding_id string, project_id string, file string, auditor_id string, pass_no int, "
                               "severity string, title string, line int, category string")
    assert [r["n_findings"] for r in merge.merge_findings(df).collect()] == [3]


def _merged_plainly(findings):
    """By rows: the key of an id, then the best finding of every key."""
    merged = merge.with_merge_key(findings).groupBy("project_id", "file", "merge_key").agg(
        F.min_by(F.struct("severity", "title", "line", "category"), F.struct(merge.severity_rank(F.col("severity")), "finding_id")).alias("lead"),
        F.array_sort(F.collect_set("auditor_id")).alias("auditors"), F.count(F.lit(1)).alias("n_findings"))
    return merged.select("project_id", "file", "merge_key", "lead.*", "auditors", "n_findings")


def test_merging_in_tasks_moves_a_finding_once(spark, monkeypatch):
    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    rows = [(pick(None, *[f"{i}{j}" for j in "abcd"]), pick("p", "q"), pick("f", "g", "h"), pick("a1", "a2", "a3", None), pick(*merge.SEVERITIES, "Odd", None),
             " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], k=3)) if i % 9 else None, pick(None, *range(0, 400, 3)), pick("dos", "oracle", None))
            for i in range(300)]
    schema = "finding_id string, project_id string, file string, auditor_id string, severity string, title string, line int, category string"
    mixed = spark.createDataFrame(rows, schema)
    # An id stands in one file only; a repeated one has the same severity in all its rows no matter which is taken.
    own = mixed.withColumn("finding_id", F.concat("finding_id", "project_id", "file")).dropDuplicates(["finding_id", "severity"])
    other = mixed.dropDuplicates(["finding_id", "severity"]).withColumn("file", F.when(F.rand(1) < 0.9, F.col("file")))
    other = spark.createDataFrame(other.collect(), schema)
    own = spark.createDataFrame(own.collect(), schema)
    for df in (own, other, own.limit(0)):
        want = sorted(str(tuple(r)) for r in _merged_plainly(df).collect())
        for group in (20_000, 20):
            monkeypatch.setattr(merge, "GROUP_FINDINGS", group)
            got = merge.merge_findings(df).drop("confidence")
            assert sorted(str(tuple(r)) for r in got.collect()) == want
    plan = merge.merge_findings(own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_findings_without_a_part_merge_by_the_words_they_show(spark, tmp_path):
    rows = [(500 * (i // 20) + i % 20, None if i % 3 == 1 else i * 7, None if i % 5 == 2 else i % 4, i % 6) for i in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = corpus.findings(spark, str(tmp_path)).select("finding_id", "title", merge.title_tokens(F.col("title")).alias("words"))
    for r in df.collect():
        assert sorted(set(r["title"].lower().replace("()", "").split(" "))) == r["words"]
    # A word without its number is left out; it is not that of the row before.
    bare = corpus.findings(spark, str(tmp_path)).filter("line is null").select("title").collect()
    assert bare and all(sum(w in corpus.WORD_A for w in r["title"].split(" ")) + sum(w in corpus.WORD_B for w in r["title"].split(" ")) < 2 for r in bare)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _thirty_findings(spark):
    rows = [(f"{i}", "P1", f"f{i % 3}", "a", "High", f"Unsafe call {i % 7}", i, "dos", "d", "e", "r") for i in range(30)]
    return spark.createDataFrame(rows, "finding_id string, project_id string, file string, auditor_id string, severity string, title string, line int, "
                                       "category string, description string, exploit string, recommendation string")


def test_sorting_moves_merged_findings_only(spark):
    assert _plan(merge.sort_report(merge.merge_findings(_thirty_findings(spark)))).count("Exchange ") == 2


def _small_report(spark, monkeypatch):
    project_map = spark.createDataFrame([("P1", 0, 0.0, "", 0, 0, "HEAD")], "project_id string, part int, score double, path string, sub int, pass_no int, text string")
    monkeypatch.setattr(catalog, "_f", lambda s, d: _thirty_findings(s))
    monkeypatch.setattr(catalog, "_map", lambda s, d: project_map)


def test_report_reads_merged_findings_from_files(spark, monkeypatch):
    _small_report(spark, monkeypatch)
    assert "FlatMapGroups" not in _plan(catalog._report(spark, ""))


def test_sink_report_sorts_the_report_without_another_copy(spark, monkeypatch):
    _small_report(spark, monkeypatch)
    seen, write = [], storage.stores.write_text
    monkeypatch.setattr(storage.stores, "write_text", lambda rows, *a, **k: (seen.append(_plan(rows)), write(rows, *a, **k)))
    lines = "\n".join(r["text"] for r in report_in_order(catalog._report(spark, "")).collect()).split("\n")
    assert [(r["project_id"], r["n_lines"], r["n_chars"]) for r in storage.report(spark, "").collect()] == [("P1", len(lines), sum(map(len, lines)))]
    assert "Union" in seen[0]


def test_report_ends_with_the_map(spark):
    project_map = spark.createDataFrame([("p", 0, 0.0, "", 0, 0, "HEAD"), ("p", 1, 0.5, "a.sol", 0, 0, "[a.sol]"), ("p", 1, 0.9, "b.sol", 0, 0, "[b.sol]"),
                                         ("p", 1, 0.5, "a.sol", 1, 2, "note"), ("p", 2, 0.0, "", 0, 0, "FOOT")],
                                        "project_id string, part int, score double, path string, sub int, pass_no int, text string")
    findings = spark.createDataFrame([], "project_id string, severity string, title string, file string, line int, confidence double, "
                                         "auditors array<string>, description string, exploit string, recommendation string, merge_key string")
    audited = spark.createDataFrame([("p", 2)], "project_id string, n_files int")
    rows = report_in_order(report_rows(findings, audited, "t", 1.0, ["m"], project_map=project_map)).collect()
    assert "*No vulnerabilities found.*" in rows[0]["text"]
    assert [r["text"] for r in rows[1:]] == ["## Protocol Map\n\n```", "HEAD", "[b.sol]", "[a.sol]", "note", "FOOT", "```"]
    assert map_section(project_map.limit(0)).isEmpty()


def test_focus_lists_only_notes_that_hit_a_file(spark):
    batches = spark.createDataFrame([("p", 2, 0, 1, "src/A.sol", True)], "project_id string, pass_no int, batch_no int, place int, path string, is_reaudit boolean")
    files = spark.createDataFrame([("p", "src/A.sol", "solidity", "x")], "project_id string, path string, language string, content string")
    notes = spark.createDataFrame([("p", "A.sol", None, "why", 0.9), ("p", "Gone.sol", None, "why", 0.9)],
                                  "project_id string, target_file string, target_function string, reason string, confidence double")
    blocks = spark.createDataFrame([("p", "c", "b")], "project_id string, context string, block string")
    rows = prompt_rows(batches, files, blocks.drop("block"), blocks.drop("context"), notes).filter("section = 4 and place = 1").collect()
    assert [r["path"] for r in rows] == ["A.sol"]


def test_every_prompt_holds_the_whole_map(spark, monkeypatch):
    monkeypatch.setattr(render, "MAP_PAGE", 4)
    batches = spark.createDataFrame([(p, 2, b, 1, "a.sol", False) for p, b in (("p", 0), ("p", 1), ("q", 0))],
                                    "project_id string, pass_no int, batch_no int, place int, path string, is_reaudit boolean")
    files = spark.createDataFrame([("p", "a.sol", "solidity", "x"), ("q", "a.sol", "solidity", "x")], "project_id string, path string, language string, content string")
    blocks = spark.createDataFrame([("p", "c", "b"), ("q", "c", "b")], "project_id string, context string, block string")
    project_map = spark.createDataFrame(
        [("p", 0, 0.0, "", 0, 0, "HEAD"), ("p", 2, 0.0, "", 0, 0, "FOOT")] + [("p", 1, i / 100, f"{i}.sol", k, 0, t) for i in range(40) for k, t in ((0, f"[{i}.sol]"), (2, ""))]
        + [("q", 0, 0.0, "", 0, 0, "Q"), ("r", 0, 0.0, "", 0, 0, "R")],
        "project_id string, part int, score double, path string, sub int, pass_no int, text string").repartition(7)
    rows = prompt_rows(batches, files, blocks.drop("block"), blocks.drop("context"), project_map=project_map)
    texts = {}
    for r in sorted(rows.filter("section = 1").collect(), key=lambda r: r["place"]):
        texts.setdefault((r["project_id"], r["batch_no"]), []).append(r["text"])
    want = "\n".join(["=== PROTOCOL MAP ===", "HEAD", *[f"[{i}.sol]\n" for i in range(39, -1, -1)], "FOOT"])
    assert {k: "\n".join(v) for k, v in texts.items()} == {("p", 0): want, ("p", 1): want, ("q", 0): "=== PROTOCOL MAP ===\nQ"}
    assert len(texts["p", 0]) == 22


def test_fallback_is_for_projects_without_merged_findings(spark):
    raw = spark.range(50).selectExpr("concat('f', lpad(id, 2, '0')) as finding_id", "concat('p', id % 2) as project_id", "'m' as auditor_id")
    merged = spark.createDataFrame([("p0",)], "project_id string")
    assert {r["project_id"] for r in merge.fallback_findings(raw, merged).collect()} == {"p1"}
    assert merge.fallback_findings(raw, merged).count() == 25 and merge.fallback_findings(raw).count() == 50
    assert [r["finding_id"] for r in merge.fallback_findings(raw, merged, 2).orderBy("finding_id").collect()] == ["f01", "f03"]


def _suffix_json(text):
    """By trial: the shortest suffix that starts with a bracket and is JSON; lists before objects."""
    def no_constant(name):
        raise ValueError(name)

    for mark in "[{":
        at = text.rfind(mark)
        while at >= 0:
            try:
                json.loads(text[at:], parse_constant=no_constant)
                return text[at:]
            except ValueError:
                at = text.rfind(mark, 0, at)
    return None


def test_json_at_the_end_of_a_text(spark):
    tails = ['[1, 2]', '{"a": [1, {"b": "}"}]}', '[{"x": "a ] b [ \\" c"}]', '["\\\\"]', '["\\\\\\" ]"]', '[]', '{}', '[{"t": "its"}]', '[[1], [2, [3]]]', '{"k": "é 日"}',
             '["a", ]', '[1, 2', '{"a" 1}', '[NaN]', ']', '}', '[}', '{"a": "b]', '["open]', '[1] x', '"[1]"', '[1]]', '["' + 'y\\"' * 3000 + '"]', '[' * 400 + ']' * 400]
    heads = ["", "text ", 'He said "so ', 'a "quoted" word ', "see \\[", 'odd " and [ and { ', "[1] and ", "x\\\\ ", "[[", '{"a": ']
    texts = [h + t for h in heads for t in tails] + ['12 apples', '1, "b": 2', '1] [2', 'null', '12', '"x"', '1} {', 'true story', '', ' ', '{"a": 1} {"b": 2}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = responses.with_json(df, "text", "found")
    got = {r["i"]: r["found"] for r in found.select("i", "found").collect()}

    def whole(t):
        try:
            json.loads(t, parse_constant=lambda x: 1 / 0)
            return t.strip()
        except (ValueError, ZeroDivisionError):
            return _suffix_json(t)

    assert got == {i: whole(t.strip()) for i, t in enumerate(texts)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rejects_search_a_response_once(spark):
    rows = [(1, "a", 1, 'text [{"severity": "High"}]'), (2, "a", 1, "no list ]"), (3, "a", 1, 'x {"findings": []}\nSUSPICIONS:\n[{"reason": "short"}]')]
    df = spark.createDataFrame(rows, "resp_id long, auditor_id string, pass_no int, raw string")
    rejects = responses.parse_responses(df)[2].select("resp_id", "reason")
    plan = rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__, 1)") <= 4  # quotes are masked once a branch and part
    assert sorted(map(tuple, rejects.collect())) == [(1, "finding not valid"), (2, "no JSON"), (3, "note not valid")]


@pytest.mark.parametrize("max_batches", [None, 90])
def test_packing_in_segments_matches_slow_fill(spark, monkeypatch, max_batches):
    monkeypatch.setattr(packing, "SEGMENT_FILES", 120)
    rng, files = random.Random(5), {}
    for p, n in (("p", 900), ("q", 200), ("r", 3)):
        files[p] = [(f"f{i:04d}", rng.choice([0, 1, 5, 90, 400, 999, 1000, 1001, rng.randint(1, 1200)]), rng.randint(0, 19) / 20) for i in range(n)]
    df = spark.createDataFrame([(p, *f) for p in files for f in files[p]], "project_id string, path string, size long, attack_score double")
    assert packing._segments(df.withColumn("sort_key", F.struct(-F.col("attack_score"), "path")))[1] > 3
    got = packing.greedy_pack(df, 1000, 4, max_batches)
    want = [(p, *w) for p in files for w in _pack_slow(files[p], 1000, 4, max_batches or 10_000)]
    assert sorted((r["project_id"], r["batch_no"], r["place"], r["path"]) for r in got.collect()) == sorted(want)


def test_path_joins_send_nothing_that_grows_through_the_driver(spark):
    files = spark.createDataFrame([("p", f"src/C{i}.sol", 10, 0.5, [f"./C{i + 1}.sol"]) for i in range(20)],
                                  "project_id string, path string, size long, attack_score double, imports array<string>")
    notes = spark.createDataFrame([("p", "src/C3.sol", 0.9)], "project_id string, target_file string, confidence double")
    targets = paths.suspicion_targets(notes, files)
    assert [r["path"] for r in targets.collect()] == ["src/C3.sol"]
    near = paths.import_neighbours(files, targets)
    assert sorted(r["path"] for r in near.collect()) == ["src/C2.sol", "src/C4.sol"]
    for df in (targets, near):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") <= plan.count("collect_set")  # only the needle lengths of each project


def test_near_duplicates_in_tasks_and_by_joins_agree(spark, monkeypatch):
    rng, words = random.Random(3), "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rows = [(f"i{rng.randint(0, 500)}" if k < 40 else f"k{k}", rng.choice(["p", "q", None] if k % 9 == 0 else ["p", "q"]), f"f{k % 7}", rng.choice([None, *range(0, 900, 3)]),
             rng.choice(["dos", "proxy", None, "token"]), rng.choice(["", "!!", None] if k % 11 == 0 else [" ".join(rng.sample(words, rng.randint(1, 10)))])) for k in range(400)]
    rows += [(None, "p", "f9", 5, "dos", "alpha"), (None, "p", "f9", 50, "dos", "beta"), ("z", "p", "f9", 52, "dos", "alpha beta")]
    df = spark.createDataFrame(rows, "finding_id string, project_id string, file string, line int, category string, title string")
    linked = merge._linked_by_joins
    want = sorted(map(str, linked(df.withColumn("words", F.array_join(merge.title_tokens(F.col("title")), " ")).filter("project_id is not null")).collect()))
    assert sorted(map(str, merge.near_duplicates(df).collect())) == want  # some files share ids
    own = df.withColumn("finding_id", F.concat("finding_id", F.lit("-"), "project_id", F.lit("-"), "file"))
    want = sorted(map(str, linked(own.withColumn("words", F.array_join(merge.title_tokens(F.col("title")), " ")).filter("project_id is not null")).collect()))
    monkeypatch.setattr(merge, "_linked_by_joins", None)
    for group in (20_000, 50):
        monkeypatch.setattr(merge, "GROUP_FINDINGS", group)
        assert sorted(map(str, merge.near_duplicates(own).collect())) == want


def test_path_joins_compute_the_features_they_read(spark, monkeypatch):
    from codesift.workloads import catalog, corpus, storage

    written = []
    monkeypatch.setattr(catalog, "cut_lineage", lambda df: written.append(df.columns) or df)
    monkeypatch.setattr(catalog.paths, "suspicion_targets", lambda notes, files: files)
    monkeypatch.setattr(catalog.paths, "import_neighbours", lambda files, targets: files)
    for name in ("join_suspicion_targets", "join_import_neighbours"):
        assert catalog.JOINS[name](spark, "/root/testdata/sf0.001").columns == ["project_id", "path"]
    assert written == [["project_id", "path"], ["project_id", "path", "imports"]]


def test_features_with_and_without_the_word(spark):
    from codesift.functions import features as fx

    from pyspark.sql import functions as F

    texts = ['import "a.sol";\nuse x::y::z', "mod net ;", "modern", None, "", "interface I {", "a library", "library L {\nmapping", "pub trait T {", "// SPDX interface"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t")
    plain = F.array_distinct(F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in fx.IMPORTS]))
    got = rows.select("i", fx.extract_imports(F.col("t")).alias("a"), plain.alias("b"), fx.attack_score(F.col("t")).alias("s")).orderBy("i").collect()
    assert all(r.a == r.b for r in got) and got[0].a == ["a.sol", "z"] and got[1].a == ["net"] and got[3].a is None
    # Every pattern stands behind its words.
    assert len(fx.IMPORTS) == len(fx.IMPORT_WORDS)


def test_coverage_in_tasks_as_by_joins(spark, monkeypatch):
    rows = [(f"f{i:03d}", None if i % 41 == 0 else f"P{i % 3}", f"F{i % 2}", None if i % 29 == 0 else i * 7 % 60, f"auditor-{i % 3 + 1}",
             None if i % 31 == 0 else " ".join(f"w{(i * k) % 37}" for k in range(1, 2 + i % 5))) for i in range(300)]
    rows += [("same", "P0", "F0", 3, "auditor-1", "w1 w2"), ("same", "P1", "F1", 9, "auditor-1", "w3 w4"), (None, "P0", "F1", 4, "auditor-1", "w1"), ("f003", "P0", "F1", 1, "auditor-1", ""),
             ("t1", "Q", "G", 10, "auditor-1", "a b c d"), ("t2", "Q", "G", 99, "auditor-1", "k l"), ("g1", "Q", "G", 50, "auditor-2", "a b c"), ("g2", "Q", "G", 14, "auditor-3", "x y z")]
    f = spark.createDataFrame(rows, "finding_id string, project_id string, file string, line int, auditor_id string, title string")
    truth = f.filter("auditor_id = 'auditor-1'").withColumnRenamed("finding_id", "truth_id").drop("auditor_id")
    models = ["auditor-2", "auditor-3"]
    got = []
    for bound in (0, 10**6):
        monkeypatch.setattr(merge, "FILE_FINDINGS", bound)
        got.append(sorted((tuple(x) for x in merge.eval_coverage(truth, f, models).collect()), key=str))
    assert got[0] == got[1] and {("t1", "found", "partial"), ("t2", "missed", "missed")} <= set(got[0])
    plan = merge._covered_in_tasks(truth.withColumn("words", F.lit("w")).drop("title"), f.select("project_id", "file", "line", F.lit("w").alias("words"), F.col("auditor_id").alias("model")).filter("model <> 'auditor-1'"), models)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
