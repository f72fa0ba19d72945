"""The pipeline's stages, each against its operator's own brute force, and the whole run."""

import pytest
from test_decontam import distance
from test_simhash import brute

import corpus_pipeline as P
from mnemospark.llm import decontam, line_dedup, mixing
from mnemospark.storage import materialise


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), name))
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "mixture"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_clean_documents_stay(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0")
    clean = {r.doc_id for r in labels.collect()}
    assert len(clean - {r.doc_id for r in steps[1].collect()}) <= 0.02 * len(clean)
    junk = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
    assert junk - {r.doc_id for r in steps[1].collect()}


def test_no_repeated_line_is_left(steps):
    gone = line_dedup.duplicate_lines(steps[1]).count()
    before, after = (sum(len((r.text or "").split("\n")) for r in s.collect()) for s in steps[1:3])
    empty = {r.doc_id for r in steps[1].collect()} - {r.doc_id for r in steps[2].collect()}
    blank = sum(1 for r in steps[1].collect() if r.doc_id in empty for x in r.text.split("\n") if not x.strip())
    assert gone and before - after == gone + blank


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert {r.doc_id for r in steps[3].collect()} == {int(c) for _, _, c in brute(rows)}


def test_no_benchmark_item_is_left(spark, sf_dir, steps):
    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id for r in steps[4].collect()}
    for r in steps[3].collect():
        t = decontam.normalise(r.text)
        leaks = any(i in t for i in items)
        assert not (leaks and r.doc_id in left)
        if r.doc_id not in left and not leaks:
            assert min(distance(i, t) / len(i) for i in items) <= decontam.RATE


def test_mixture(spark, sf_dir, steps):
    last = {r.doc_id: r for r in steps[5].collect()}
    assert set(last) == {r.doc_id for r in steps[4].collect()}
    assert {r.doc_id: r.taken for r in mixing.mix(steps[4]).collect()} == {d: r.taken for d, r in last.items()}
    assert {r.doc_id: r.taken for r in P.run(spark, sf_dir).collect()} == {d: r.taken for d, r in last.items()}
