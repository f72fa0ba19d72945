"""Hand-sized cases for the composite operators."""

import random

from pyspark.sql import functions as F

from mnemospark.operators import evaluation, monitoring, reconcile, retrieval, writing
from mnemospark.operators.components import connected_components
from mnemospark.plans import mining, nightly

FUSE_S = "query_id long, rank int, id string, score double"
FUSE_K = "query_id long, rank int, id string, keyword_score double, query string, content string"


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_classic_fusion(spark):
    sem = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8)], FUSE_S)
    kw = spark.createDataFrame([(1, 0, "B", -3.0, "q", "b"), (1, 1, "C", -2.0, "q", "c")], FUSE_K)
    got = retrieval.fuse(sem, kw, 5).orderBy("rank").collect()
    assert [(r.id, r.rrf_score) for r in got] == [("B", 0.032522), ("A", 0.016393), ("C", 0.016129)]
    assert got[2].score == got[2].rrf_score and got[1].score == 0.9


def test_per_hit_fusion_rescues_an_exact_hit(spark):
    sem = spark.createDataFrame([(1, i, f"s{i}", 0.9 - i / 10) for i in range(5)], FUSE_S)
    kw = spark.createDataFrame([(1, 0, "noise", -9.0, "where is CT314", "prose"), (1, 1, "hit", -1.0, "where is CT314", "at CT-314 now")], FUSE_K)
    ids = [r.id for r in retrieval.fuse(sem, kw, 5, "per_hit").orderBy("rank").collect()]
    assert "hit" in ids and "noise" not in ids


def test_gated_fusion_on_prose_keeps_semantic_order(spark):
    sem = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8)], FUSE_S)
    kw = spark.createDataFrame([(1, 0, "C", -3.0, "plain words", "other")], FUSE_K)
    assert [r.id for r in retrieval.fuse(sem, kw, 5, "gated").orderBy("rank").collect()] == ["A", "B"]


def test_unknown_strategy_is_classic(spark):
    sem = spark.createDataFrame([(1, 0, "A", 0.9)], FUSE_S)
    kw = spark.createDataFrame([(1, 0, "C", -3.0, "q", "c")], FUSE_K)
    assert retrieval.fuse(sem, kw, 5, "other").count() == 2


def test_bm25_scores(spark):
    docs = spark.createDataFrame([(str(i), t, "n") for i, t in enumerate(["deploy failed", "deploy now please", "other text", "café au lait", "x"])], "id string, content string, namespace string")
    q = spark.createDataFrame([(1, "deploy"), (2, "zzz")], "query_id long, query string")
    got = retrieval.keyword_search(retrieval.index(docs), q, q.selectExpr("query_id", "'n' as namespace"), 5).collect()
    assert {r.id for r in got} == {"0", "1"} and all(r.keyword_score < 0 for r in got)


def test_resolution(spark):
    rec = spark.createDataFrame([("old", False, "h"), ("h", True, None), ("r", False, None), ("a", False, "b"), ("b", False, "gone"), ("loop", False, "loop")], "id string, current boolean, superseded_by string")
    hits = spark.createDataFrame([(1, 0, "old", 0.5), (1, 1, "h", 0.4), (1, 2, "r", 0.3), (1, 3, "a", 0.2), (1, 4, "loop", 0.1)], "query_id long, rank int, id string, score double")
    got = retrieval.resolve(hits, rec).orderBy("rank").collect()
    assert [(r.id, r.score, r.superseded_from) for r in got] == [("h", 0.5, "old"), ("r", 0.3, None), ("b", 0.2, "a"), ("loop", 0.1, None)]


def test_long_chain_stops_after_ten_hops(spark):
    rec = spark.createDataFrame([(str(i), str(i + 1)) for i in range(15)] + [("15", None)], "id string, superseded_by string")
    heads = {r.id: r.head for r in retrieval.heads(rec).collect()}
    assert heads["0"] == "10" and heads["9"] == "15"


def test_pairs_and_head(spark):
    cols = "id string, content string, namespace string, created_at string, subject string, current boolean, why string, claim_type string, supersedes array<string>, vector array<double>"
    rows = [("1", "a 1", "n", "2024", "s", None, None, None, None, [1.0, 0.0]), ("2", "a 1", "n", "2024", "s", None, "w", None, ["z"], [1.0, 0.0]), ("3", "b", "n", "2024", "s", None, None, None, None, [0.0, 1.0]), ("4", "a 2", "n", "2024", "s", None, None, None, None, [0.99, 0.01])]
    out = reconcile.dedup(spark.createDataFrame(rows, cols))
    pairs = {(r.id_a, r.id_b) for r in out["judged"].unionByName(out["quarantined"], allowMissingColumns=True).collect()}
    assert pairs == {("1", "2"), ("1", "4"), ("2", "4")}
    assert {(r.id_a, r.id_b) for r in out["quarantined"].collect()} == {("1", "4"), ("2", "4")}
    assert [(r.id, r.head) for r in out["losers"].collect()] == [("1", "2")]
    assert out["heads"].first().supersedes == ["z", "1"]
    assert reconcile.dedup(spark.createDataFrame(rows, cols), max_group=3)["judged"].count() == 0


def test_lineage(spark):
    rec = spark.createDataFrame([(0, "x", "s", "2026-01"), (1, "y", "s", "2026-03"), (2, "z", "s", "")], "ordinal long, id string, subject string, created_at string")
    th = spark.createDataFrame([("x", "t"), ("y", "t"), ("z", "t")], "id string, thread string")
    got = {r.id: r for r in reconcile.lineage(rec, th).collect()}
    assert got["y"].current and got["y"].supersedes == ["z", "x"]
    assert got["x"].superseded_by == got["z"].superseded_by == "y"


def candidate(**k):
    base = {"content": "The server runs X", "subject": None, "project": None, "agent": "a", "claim_type": None, "why": None, "self_checked": False, "expires_on": None, "verify_hint": None, "status": None, "gate_verdict": None}
    return base | k


def test_write_contract(spark):
    cases = [
        (candidate(why="password = Tr0ub4dor99 ", self_checked=True), "MEMORY_CONTAINS_SECRET"), (candidate(claim_type="decision", why=" ", self_checked=True), "MEMORY_NEEDS_WHY"), (candidate(content="It runs"), "MEMORY_NEEDS_SELF_CHECK"),
        (candidate(subject="Me", content="me too"), "MEMORY_VAGUE_SUBJECT"), (candidate(claim_type="rumour"), "MEMORY_INVALID_TYPE"), (candidate(claim_type="prediction", expires_on="2024-1-2", verify_hint="x"), "MEMORY_PREDICTION_NEEDS_FIELDS"),
        (candidate(gate_verdict="reject"), "MEMORY_FAILS_WRITE_CONTRACT"), (candidate(claim_type="Prediction", expires_on="2024-01-02", verify_hint="x"), None), (candidate(gate_verdict="reject", self_checked=True), None),
    ]
    kinds = ", ".join(f"{k} {'boolean' if k == 'self_checked' else 'string'}" for k in candidate())
    df = spark.createDataFrame([tuple(c.values()) + (i,) for i, (c, _) in enumerate(cases)], kinds + ", n int")
    got = writing.write_decisions(df, spark.createDataFrame([], "alias string, canonical string")).orderBy("n").collect()
    assert [r.error for r in got] == [e for _, e in cases]
    assert got[7].stored_status == "open" and got[8].gate == "bypassed"


def test_flood_threshold(spark):
    rows = [("a", "2024-06-20T10:00:00Z")] * 30 + [("b", "2024-06-20T10:00:00Z")] * 31 + [("c", None)] * 40
    got = monitoring.floods(spark.createDataFrame(rows, "source string, created_at string"), F.lit("2024-06-20T12:00:00Z").cast("timestamp"))
    assert [(r.source, r.n) for r in got.collect()] == [("b", 31)]


def test_gate_mix_without_gates(spark):
    got = monitoring.gate_mix(spark.createDataFrame([("2024-06-20T10:00:00Z", None)], "created_at string, gate string"), F.lit("2024-06-20T12:00:00Z").cast("timestamp"))
    assert [r.gate for r in got.collect()] == ["no data"]


def test_prediction_dates(spark):
    rows = [("prediction", None, d) for d in ("2024-01-01", "2024-01-02", "soon")]
    got = monitoring.prediction_status(spark.createDataFrame(rows, "claim_type string, status string, expires_on string"), F.lit("2024-01-02").cast("date"))
    assert {r.status: r.n for r in got.collect()} == {"expired_open": 1, "open": 2, "hit": 0, "miss": 0}


def test_render_list(spark):
    df = spark.createDataFrame([(["a\nb", None],), ([],)], "t array<string>")
    assert [r.x for r in df.select(evaluation.render_list(F.col("t")).alias("x")).collect()] == ["1. a b\n2. ", "(no results)"]


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    found = retrieval.best(df, ["g"], [F.col("v").desc()], 2)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.g, r.rank, r.v) for r in found.collect()) == [(0, 0, 999), (0, 1, 996), (1, 0, 997), (1, 1, 994), (2, 0, 998), (2, 1, 995)]


def test_chunks(spark):
    text = "a" * 8 + "\n" + "b" * 20
    rows = [("  short ", ["  short "]), (" \n", []), (None, []), ("", []), (text, ["a" * 8, "b" * 9, "b" * 10, "b"]), ("\n" * 30, []), ("\U0001f600" * 12, ["\U0001f600" * 10, "\U0001f600" * 2]), ("ab\ncd\nef\ngh", ["ab\ncd\nef", "gh"]), ("x" * 10 + "\n" + "y" * 4, ["x" * 10, "yyyy"])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", mining.cut(F.col("t"), 10).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: c for i, (_, c) in enumerate(rows)}


def test_mining_retries_and_leaves_failed_files(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(chunk):
        calls.add(1)
        return None if "bad" in chunk else '[{"category": "Lesson", "content": "something worth keeping"}]'

    files = spark.createDataFrame([(p, p, t, "git", "pr") for p, t in (("good", "g" * 300), ("poor", "bad " * 60), ("short", "s"), ("known", "k" * 300))], "path string, file_hash string, text string, source string, project string")
    found, done = mining.mine(files, files.filter("path = 'known'"), model)
    assert [r.path for r in found.collect()] == ["good"] and found.count() == 1
    assert {r.path: (r.facts_written, r.skipped) for r in done.collect()} == {"good": (1, False), "short": (0, True)}
    assert calls.value == 1 + mining.TRIES


def test_nightly_runs(spark):
    cols = "id string, content string, namespace string, created_at string, subject string, raw_subject string, current boolean, superseded_by string, supersedes array<string>, valid_from string, dedup_collapsed boolean, why string, claim_type string, vector array<double>"
    rows = [("1", "Alpha is up", "fleet:My_App", "2024-01", "alpha", None, True, None, None, None, None, None, None, [1.0, 0.0]), ("2", "alpha  is up", "fleet:my-app", "2024-02", "alpha", None, True, None, None, None, None, None, None, [1.0, 0.0]), ("3", "Beta", "fleet", "2024-03", None, None, True, None, None, None, None, None, None, [0.0, 1.0])]
    store = spark.createDataFrame(rows, cols)
    out = nightly.nightly(store, spark.createDataFrame([("Beta", "b")], "alias string, canonical string"), lambda c: F.split(c, " ")[0])
    got = {r.id: r for r in out.collect()}
    assert got["1"].namespace == "fleet:my-app" and got["3"].subject == "b" and got["3"].raw_subject == "Beta"
    assert got["1"].superseded_by == "2" and got["2"].supersedes == ["1"]
