"""State from run to run: near-duplicate groups, the mirror, segments."""

import random

from pyspark.sql import functions as F

from mnemospark.operators import reconcile as R
from mnemospark.plans.increments import DuplicateGroups
from mnemospark.streaming.increments import Mirror, RunCounts, counted, mirror, mirrored, read_stream, run_available

SCHEMA = "id string, content string, namespace string, created_at string, subject string, current boolean, why string, claim_type string, supersedes array<string>, vector array<double>"


def records(n, rng):
    """Vectors on a few rays, so that groups fall into chains of near-duplicates."""
    out = []
    for i in range(n):
        angle = rng.choice([0.0, 0.3, 0.6, 0.9, 2.0]) + rng.random() * 0.05
        import math

        out.append((f"r{i:04}", f"text {i % 7}", f"n{i % 2}", f"2024-01-{1 + i % 28:02}", f"Subject {i % 9}", i % 11 != 0, "because" if i % 4 == 0 else None, None, None, [math.cos(angle), math.sin(angle)]))
    return out


def full(spark, rows, cap):
    return {(r.id, r.head) for r in R.dedup(spark.createDataFrame(rows, SCHEMA), 0.95, cap, judge=R.always_duplicate)["losers"].collect()}


def losers(state):
    return {(r.id, r.head) for r in state.losers().collect()}


def test_runs_in_any_order_equal_one(spark, tmp_path):
    """Three batches, the second of which holds the records that claim to be the oldest."""
    rng = random.Random(3)
    rows = records(240, rng)
    early = [r for r in rows if r[3] < "2024-01-08"]
    rest = [r for r in rows if r not in early]
    state = DuplicateGroups(spark, str(tmp_path / "state"), 0.95, 80, R.always_duplicate)
    batches = [rest[::2], early, rest[1::2]]
    told = {}
    for k, batch in enumerate(batches):
        changed = state.add(spark.createDataFrame(batch, SCHEMA), k)
        told |= {r.id: r.head for r in changed.collect()}
        assert losers(state) == full(spark, [r for b in batches[: k + 1] for r in b], 80)
    assert state.add(spark.createDataFrame(rows, SCHEMA), 1) is None  # a batch that was seen
    assert all(told[i] == h for i, h in losers(state))
    want = losers(state)
    state.compact()
    assert len(state.segments()) == 1 and losers(state) == want
    assert state.add(spark.createDataFrame(rows, SCHEMA), 2) is None
    assert state.add(spark.createDataFrame(rows[:50], SCHEMA)).count() == 0  # known ids stay as they were


def test_a_group_that_outgrows_the_bound(spark, tmp_path):
    rows = records(120, random.Random(4))
    state = DuplicateGroups(spark, str(tmp_path / "state"), 0.95, 8, R.always_duplicate)
    for k, batch in enumerate((rows[:60], rows[60:])):
        state.add(spark.createDataFrame(batch, SCHEMA), k)
    assert losers(state) == full(spark, rows, 8)


def test_only_dirty_groups_are_compared(spark, tmp_path):
    rows = records(200, random.Random(5))
    state = DuplicateGroups(spark, str(tmp_path / "state"), 0.95, 80, R.always_duplicate)
    state.add(spark.createDataFrame(rows, SCHEMA), 0)
    seen = []
    plain = state._links
    state._links = lambda inside: seen.append(inside.select("subject", "namespace").distinct().count()) or plain(inside)
    one = [("late", rows[2][1], "n0", "1999-01-01", "Subject 2", True, None, None, None, rows[2][9])]
    assert state.add(spark.createDataFrame(one, SCHEMA), 1).count() > 0 and seen == [1]


def test_nothing_to_add(spark, tmp_path):
    """An empty batch, records without subject, vectors that are missing, rows that repeat an id."""
    state = DuplicateGroups(spark, str(tmp_path / "state"), 0.95)
    assert state.add(spark.createDataFrame([], SCHEMA), 0).count() == 0
    odd = [("a", "t", "n", None, None, True, None, None, None, [1.0]), ("b", "t", None, None, "s", None, None, None, None, None), ("c", None, "n", None, "s", True, None, None, None, [1.0]), ("c", None, "n", None, "s", True, None, None, None, [1.0])]
    assert state.add(spark.createDataFrame(odd, SCHEMA), 1).count() == 0


def writes(spark, rows):
    return spark.createDataFrame(rows, "seq long, id string, namespace string, text string, deleted boolean")


def test_the_mirror_stays_small(spark, tmp_path):
    mirror = Mirror(spark, str(tmp_path / "mirror"))
    want = {}
    for k in range(20):
        rows = [(10 * k + j, f"i{(k * 3 + j) % 13}", "n", f"text {k}-{j}", False) for j in range(4)] + [(10 * k + 5, f"i{k % 5}", None, None, True), (10 * k + 6, "", "n", "x", False), (10 * k + 7, "blank", "n", "", False)]
        mirror.batch(writes(spark, rows), k)
        for _, i, _, t, gone in rows:
            if i and gone:
                want.pop(i, None)
            elif i and t:
                want[i] = t
        assert len(mirror.segments()) <= Mirror.DELTAS
        if k in (7, 13):
            mirror.batch(writes(spark, [(999, "i0", "n", "again", False)]), k)  # repeated: nothing
            mirror.batch(writes(spark, [(999, "i0", "n", "again", False)]), 2)
    assert {r.id: r.text for r in mirror.rows().collect()} == want
    files = mirror.read("writes").select(F.input_file_name()).distinct().count()
    assert files <= (Mirror.DELTAS + 1) * Mirror.BUCKETS


def test_counts_of_a_stream(spark, tmp_path):
    """Two runs over four files; the listener has the sums without a job of its own."""
    src, index, counts = str(tmp_path / "src"), str(tmp_path / "index"), RunCounts()
    spark.streams.addListener(counts)
    try:
        for run in range(2):
            for k in range(2):
                rows = [(10 * run + 2 * k + j, f"i{j}", "n", "" if j else f"t{run}{k}") for j in range(3)]
                spark.createDataFrame(rows, "seq long, id string, namespace string, text string").coalesce(1).write.mode("append").parquet(src)
            stream = counted(read_stream(spark, src, "seq long, id string, namespace string, text string", max_files=1))
            run_available(stream, mirror(index), str(tmp_path / "checkpoint")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(100):  # progress events take a way of their own
            if counts.total("mirror").get("writes") == 12:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    assert counts.total("mirror") == {"writes": 12, "blank": 8} and counts.total("other") == {}
    assert {r.id: r.text for r in mirrored(spark, index).collect()} == {"i0": "t11"}
