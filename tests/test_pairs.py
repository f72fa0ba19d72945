"""Candidate pairs of groups of any size against brute force, and the dedup queries' whole groups."""

import numpy as np

from mnemospark.operators import reconcile as R
from mnemospark.queries import reconcile as Q


def test_groups_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = np.random.default_rng(3)
    vectors = [[0.0] * 6 if i == 7 else rng.normal(size=6).tolist() for i in range(130)]
    rows = [(f"r{i}", "n", "s" if i < 100 else "t", i % 3 == 0, v) for i, v in enumerate(vectors)]
    records = spark.createDataFrame(rows, "id string, namespace string, subject string, new boolean, vector array<double>")
    u = [np.array(v) / (np.linalg.norm(v) or 1) for v in vectors]
    want = {tuple(sorted((a[0], b[0]))): float(u[i] @ u[j]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a[2] == b[2] and u[i] @ u[j] >= 0.3}
    got = {(r.id_a, r.id_b): r.similarity for r in R.candidate_pairs(records, 0.3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 500
    new = {r[0] for r in rows if r[3]}
    assert {(r.id_a, r.id_b) for r in R.candidate_pairs(records, 0.3, only="new").collect()} == {k for k in want if new & set(k)}


def test_no_group_is_left_out(spark, tmp_path):
    """A hundred records of one label, more than the default cap."""
    docs = [(i, f"text number {i} of {i % 4}", "s", "en") for i in range(100)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, i * 1e-3], 1) for i in range(100)], "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    live = sum(i % 11 != 0 or i % 13 == 0 for i in range(100))
    report = {r.what: r.n for r in Q.dedup_report(spark, str(tmp_path)).collect()}
    assert live > R.MAX_GROUP and report["records"] == live and report["judged"] + report["quarantined"] == live * (live - 1) // 2
