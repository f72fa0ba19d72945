"""Backend routing and counts that come with a run."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from mnemospark.operators import reconcile as R
from mnemospark.operators import routing

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def parse(raw):
    return raw if raw in ("store", "reject") else None


def down(_):
    raise TimeoutError("down")


def told(spark, policy, primary, models, fallback=None, prompts=("a",)):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "n int, prompt string").coalesce(1)
    return [(r.verdict, r.backend) for r in routing.ask(rows, policy, parse, primary, models, "m", fallback).orderBy("n").collect()]


def test_the_live_calls_follow_the_table(spark):
    calls = {"verdict": lambda t: "store", "unclear": lambda t: "hm", "failed": down}
    loaded = {"ours": lambda: ["m", "x"], "others": lambda: ["x"], "nothing": lambda: []}
    for policy, where, answer, other in (("gate", "ours", "verdict", "verdict"), ("gate", "others", "verdict", "verdict"), ("gate", "nothing", "verdict", "failed"), ("judge", "nothing", "verdict", "absent"), ("judge", "others", "verdict", "verdict"), ("gate", "ours", "unclear", "verdict"), ("judge", "ours", "failed", "verdict"), ("judge", "ours", "failed", "unclear"), ("gate", "ours", "failed", "absent")):
        got = told(spark, policy, calls[answer], loaded[where], calls.get(other))
        want = routing.decided(policy, True, where, answer, other)
        assert got == [("store" if want != "skipped" else None, want)], (policy, where, answer, other)


def test_fail_open(spark):
    """No primary, no answer about what is loaded, nothing reachable, no prompt."""
    assert told(spark, "gate", None, lambda: []) == [(None, "skipped")]
    assert told(spark, "gate", lambda t: "store", lambda: down(0), lambda t: "reject") == [("reject", "fallback")]
    assert told(spark, "judge", down, lambda: ["m"], down, ("a", "b", None)) == [(None, "skipped")] * 3


def test_a_dead_backend_isnt_called_for_every_row(spark, tmp_path):
    def counted(_):
        with open(tmp_path / "calls", "a") as f:
            f.write("x")
        raise OSError("down")

    got = told(spark, "judge", counted, lambda: ["m"], lambda t: "store", [str(i) for i in range(50)])
    assert got == [("store", "fallback")] * 50
    assert len((tmp_path / "calls").read_text()) == routing.BREAK_AFTER


def test_the_table_is_whole(spark):
    table = routing.decisions(spark)
    assert table.count() == 144 == table.dropDuplicates(routing._KEY).count()
    assert {r.backend for r in table.filter("not configured").select("backend").distinct().collect()} == {"skipped"}


def test_counts_come_with_the_run(spark):
    rows = [(f"r{i}", f"text {'a' if i % 3 else i}", "n", None, f"s{i % 4}", True, None, None, None, [1.0, i % 2 * 0.01]) for i in range(40)]
    records = spark.createDataFrame(rows, "id string, content string, namespace string, created_at string, subject string, current boolean, why string, claim_type string, supersedes array<string>, vector array<double>")
    out = R.dedup(records)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("report", "report")
    got = {r.what: r.n for r in out["report"].collect()}
    assert len(tracker.getJobIdsForGroup("report")) <= 1  # the rows are at hand; nothing is counted again
    sc.setJobGroup("", "")
    assert got == {"groups": out["groups"].select("subject").distinct().count(), "records": out["groups"].count(), "judged": out["judged"].count(), "quarantined": out["quarantined"].count(), "collapsed": out["losers"].count(), "heads": out["heads"].count()}
    assert got["collapsed"] > 0 and got["quarantined"] > 0
    empty = {r.what: r.n for r in R.dedup(records.filter(F.lit(False)))["report"].collect()}
    assert set(empty.values()) == {0}
