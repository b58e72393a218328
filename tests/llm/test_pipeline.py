"""The pipeline stage by stage against plain versions, and as one run."""

import collections

import pytest

import corpus_pipeline as cp
from codesift.llm import pii, quality_net
from tests.llm.test_operators import brute_links, ids_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append((name, docs))
    return dict(out)


def test_names_and_columns(stages):
    assert list(stages)[1:] == [n for n, _ in cp.STAGES] == ["quality", "near_copies", "pii", "mixing", "packing"]
    for name in list(stages)[1:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality_stage(spark, stages):
    docs, labels = stages["documents"], spark.read.parquet(f"{SF}/labels.parquet")
    good = quality_net.score_quality(docs, quality_net.fit_quality(docs, labels)).filter("predicted = 1")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in stages["quality"].collect())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in stages["quality"].collect()}
    clean = [d for d, q in truth.items() if q == 1]
    assert len(kept & set(clean)) > 0.95 * len(clean) and len(kept) < docs.count()


def test_near_copies_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages["quality"].collect()]
    _, group = brute_links(rows)
    want = {rows[i][0] for i in range(len(rows)) if group.get(i, rows[i][0]) == rows[i][0]}
    assert {r.doc_id for r in stages["near_copies"].collect()} == want and len(want) < len(rows)


def test_pii_stage(stages):
    before = {r.doc_id: r for r in stages["near_copies"].collect()}
    changed = 0
    for r in stages["pii"].collect():
        base = pii.base_spans(before[r.doc_id].text)
        assert not any(pii.base_spans(r.text).values())
        assert sum(r.text.count(f"<{k}>") for k in pii.KINDS) >= (1 if any(base.values()) else 0)
        assert r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars)
        changed += r.text != before[r.doc_id].text
    assert changed and len(before) == stages["pii"].count()


def test_mixing_stage(stages):
    before = {r.doc_id: r for r in stages["pii"].collect()}
    times = collections.Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(times) <= set(before) and max(times.values()) <= 3 and len(times) < len(before)


def test_packing_stage(stages):
    times, text = collections.Counter(), {}
    for r in stages["mixing"].collect():
        times[r.doc_id] += 1
        text[r.doc_id] = r.text
    packed = collections.Counter()
    for r in stages["packing"].collect():
        packed[r.doc_id] += r.length
    assert packed == collections.Counter({d: n * len(ids_of(text[d], 0)) for d, n in times.items()})


def test_run(spark, stages):
    # How documents are cut follows the partitions; which ones are packed, and how often, does not.
    total = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id").sum("length").collect())
    assert total(cp.run(spark, SF)) == total(stages["packing"])
