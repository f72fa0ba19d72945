"""Exact search through lists against a full scan."""

import numpy as np
import pytest

from mnemospark.operators.vector_index import VectorIndex

RNG = np.random.default_rng(7)


def scan(store, queries, k):
    out = {}
    for q, space, v in queries:
        v, hits = np.array(v, float), []
        for i, s, w in store:
            if s == space and w is not None and len(w) == len(v):
                w = np.array(w, float)
                norm = np.linalg.norm(v) * np.linalg.norm(w)
                hits.append((-round(float(v @ w / norm), 9) if norm else 0.0, i))
        out[q, space] = [(i, round(-s, 6)) for s, i in sorted(hits)[:k]]
    return {x: v for x, v in out.items() if v}


def found(rows):
    out = {}
    for r in rows.orderBy("query_id", "namespace", "rank").collect():
        out.setdefault((r.query_id, r.namespace), []).append((r.id, round(r.score, 6) + 0.0))
    return out


@pytest.fixture(scope="module")
def store():
    """Clusters in one namespace, copies, another length, vectors of length zero, none at all."""
    centres = RNG.normal(size=(30, 24))
    rows = [(f"v{i:04}", "a", (centres[i % 30] + 0.15 * RNG.normal(size=24)).tolist()) for i in range(3000)]
    rows += [(f"w{i}", "b", RNG.normal(size=24).tolist()) for i in range(40)]
    rows += [(f"c{i}", "b", [1.0] * 24) for i in range(12)] + [("z1", "a", [0.0] * 24), ("z2", "b", [0.0] * 24), ("x", "a", [1.0, 2.0]), ("y", None, [1.0] * 24), ("n", "a", None), ("e", "a", [])]
    return rows


@pytest.fixture(scope="module")
def index(spark, store, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("vectors") / "index")).build(spark.createDataFrame(store, "id string, namespace string, vector array<double>"))


def ask(spark, queries):
    return spark.createDataFrame([(q, s, None if v is None else list(map(float, v))) for q, s, v in queries], "query_id long, namespace string, vector array<double>")


def test_search_equals_a_scan(spark, store, index):
    queries = [(i, s, v) for i, (_, s, v) in enumerate(store[::211]) if v]
    queries += [(100, "b", [1.0] * 24), (101, "a", [0.0] * 24), (102, "a", [3.0, 1.0]), (103, "nowhere", [1.0] * 24), (0, "b", store[0][2])]
    for k in (1, 7, 60):
        got = found(index.search(ask(spark, queries), k))
        assert {x: [(i, s + 0.0) for i, s in v] for x, v in scan(store, queries, k).items()} == got
    assert index.search(ask(spark, [(1, "a", None), (2, "a", [])]), 3).count() == 0


def test_most_lists_are_not_read(spark, store, index):
    queries = [(i, "a", store[i][2]) for i in range(20)]
    plan = index.plan(ask(spark, queries), 5)
    read = plan["seeds"].count() + plan["asked"].count()
    assert read < 0.25 * len(queries) * index.blocks().filter("namespace = 'a' and dims = 24").count()


def test_queries_stay_off_the_driver(spark, index):
    """Nothing of the plan is collected: queries meet the lists in joins."""
    plan = index.search(ask(spark, [(1, "a", [1.0] * 24)]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" in plan
    import inspect

    import mnemospark.operators.vector_index as V

    assert ".collect()" not in inspect.getsource(V) and "toPandas" not in inspect.getsource(V)


def test_an_empty_store(spark, tmp_path):
    empty = VectorIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame([], "id string, namespace string, vector array<double>"))
    assert empty.search(ask(spark, [(1, "a", [1.0, 2.0])]), 3).count() == 0
