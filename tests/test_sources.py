"""Sources and sinks on files."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from mnemospark.sources import files, forge, sinks, transcripts
from mnemospark.streaming import increments


def test_claude_transcript(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": " hello "}}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "x" * 600}, {"type": "tool", "text": "no"}]}},
        {"type": "user", "message": {"role": "user", "content": ""}}, {"type": "user", "message": {"role": "assistant", "content": "no"}}, {"type": "user", "message": {"role": "user", "content": "[not a list"}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{bad\n\n")
    got = transcripts.parse(transcripts.read_files(spark, str(tmp_path)), "claude").first()
    assert got.text == "USER: hello\nCLAUDE: " + "x" * 500 + "\nUSER: [not a list"


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        transcripts.parse(spark.range(1), "other")


def test_discovery(spark):
    df = spark.createDataFrame([("/r/app/CLAUDE.md",), ("/r/app/docs/a.md",), ("/r/app/docs/README.md",), ("/r/app/src/b.md",), ("/r/.x/docs/a.md",), ("/r/dist/docs/a.md",)], "path string")
    assert [r.path for r in files.markdown_files(df, "/r").collect()] == ["/r/app/CLAUDE.md", "/r/app/docs/a.md"]
    t = spark.createDataFrame([("/s/a.jsonl",), ("/s/a.trajectory.jsonl",)], "path string")
    assert transcripts.discover(t, "openclaw").count() == 1


def test_commit_log_source(spark, tmp_path):
    env = ["-c", "user.name=n", "-c", "user.email=e"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for m in ("Add a thing\n\nbody\nCo-authored-by: x", "wip stuff"):
        subprocess.run(["git", *env, "commit", "-q", "--allow-empty", "-m", m], cwd=tmp_path, check=True)
    got = files.commit_logs(spark, [str(tmp_path)]).first()
    assert "COMMIT: Add a thing" in got.text and "wip" not in got.text and "o-authored" not in got.text and len(got.head) == 40


@pytest.mark.parametrize("kind", sorted(forge.FORGES))
def test_forges(spark, tmp_path, kind):
    f = forge.FORGES[kind]
    fill = lambda p, n="": p.format(o="o", r="r", n=n, id="o%2Fr")

    def put(path, state, items):
        (tmp_path / path.lstrip("/")).mkdir(parents=True, exist_ok=True)
        (tmp_path / path.lstrip("/") / f"{state}page-1.json").write_text(json.dumps(items))

    put(fill(f["repo"]), "", {"updated_at": "2024-01-02T03:04:05Z", "last_activity_at": "2024-01-02T03:04:05Z"})
    for path, query, _ in f["issues"]:
        state = query["state"]
        number = {"opened": 1, "open": 1, "all": 1}.get(state, 2)
        issues = [{f["number"]: number, "state": state, "title": f"t{number}", "body": " b ", "description": " b ", "labels": ["l"] if kind == "gitlab" else [{"name": "l"}], f["count"]: 1}]
        issues += [{f["number"]: 9, "state": "all", "title": "pr", "pull_request": {}}] if kind == "github" else []
        put(fill(path), "" if state == "all" else f"{state}-", issues)
        put(fill(f["notes"], number), "", [{"body": "said"}, {"body": "auto", "system": True}])
    who = {"author_name": "n", "authored_date": "2024-05-06T"} if kind == "gitlab" else {}
    commits = [{"sha": "a" * 40, "id": "a" * 40, "message": m, "commit": {"message": m, "author": {"name": "n", "date": "2024-05-06T"}}, **who} for m in ("A real message", "short", "Merge branch 'x' into y")]
    put(fill(f["commits"]), "", commits)
    objects = forge.read_forge(spark, kind, str(tmp_path), ["o/r"]).cache()
    assert forge.fingerprints(objects).first().file_hash == "2024-01-02T03:04"
    text = forge.issues_text(objects).first().text
    assert "[labels: l]\nBody: b\n  COMMENT: said" in text and "pr" not in text and "auto" not in text
    assert forge.commits_text(objects).first().text == "COMMIT aaaaaaaa by n on 2024-05-06:\nA real message"
    objects.unpersist()


def test_small_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"ts": "1", "query": "q", "namespaces": ["n"], "top5_ids": ["a"]}\n{bad\n')
    rows = files.read_captures(spark, str(tmp_path / "c.jsonl")).cache()
    assert rows.filter("_corrupt_record is not null").count() == 1 and rows.count() == 2
    (tmp_path / "p.json").write_text('[{"id": 1, "question": "q", "expect_any": ["a"], "subject": "s"}, {"id": 2, "question": "", "expect_any": ["a"]}]')
    with pytest.raises(Exception, match="bad probe 2"):
        files.read_probes(spark, str(tmp_path / "p.json")).collect()
    (tmp_path / "a.json").write_text('{"Old Name": " new "}')
    assert files.read_aliases(spark, str(tmp_path / "a.json")).first().canonical == "new"
    assert files.read_aliases(spark, str(tmp_path / "none.json")).count() == 0
    lines = spark.createDataFrame([("# c",), ("a  /b",), ("",)], "value string")
    assert [tuple(r) for r in files.read_manifest(lines).collect()] == [("a", "/b")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("hi")
    assert files.file_digests(spark, str(tmp_path / "d")).first().sha256.startswith("8f434346")


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("1", "a", "n"), ("2", "b", "m")], "id string, content string, namespace string")
    sinks.append_points(p, str(tmp_path / "points"))
    sinks.append_points(p, str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points")).count() == 4
    assert sinks.rebuild(p, str(tmp_path / "t")) == 2 and sinks.rebuild(p.limit(1), str(tmp_path / "t")) == 1
    assert sinks.current(spark, str(tmp_path / "t")).count() == 1
    log = spark.createDataFrame([("t", "passed", "primary", None, "x" * 100, None), ("t", "passed", "primary", None, "k", "MEMORY_CONTAINS_SECRET")], "ts string, outcome string, backend string, subject string, content string, error string")
    sinks.append_gate_log(log, str(tmp_path / "log"))
    got = spark.read.text(str(tmp_path / "log")).collect()
    assert len(got) == 1 and len(json.loads(got[0].value)["content_first80chars"]) == 80
    sinks.append_captures(spark.createDataFrame([("t", "q", ["n"], ["a"])], "ts string, query string, namespaces array<string>, top5_ids array<string>"), str(tmp_path / "cap"))
    sinks.dump_markdown(spark.createDataFrame([(2, "b"), (1, "a")], "ordinal int, paragraph string"), str(tmp_path / "md"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "md").glob("part-*")))
    assert text == "a\n\nb\n\n"
    sinks.write_report(p.groupBy().count(), str(tmp_path / "rep"))
    sinks.write_metrics(spark.createDataFrame([("m 1",)], "line string"), str(tmp_path / "met"))
    assert spark.read.json(str(tmp_path / "rep")).first()["count"] == 2


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, index = str(tmp_path / "src"), str(tmp_path / "index")
    schema = "seq long, id string, namespace string, text string"
    for rows in ([(1, "a", "n", "one"), (2, "b", "n", "x")], [(3, "a", "n", "two"), (4, "c", "n", "")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        increments.run_available(increments.read_stream(spark, src, schema), increments.mirror(index), str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.text for r in increments.mirrored(spark, index).collect()} == {"a": "two", "b": "x"}


def test_index_feed_and_pending(spark):
    p = spark.createDataFrame([("1", {"data": "", "memory": "m", "hash": "h", "k": "v"}), ("2", {"k": "v"})], "id string, payload map<string,string>")
    r = files.index_feed(p).collect()
    assert len(r) == 1 and r[0].text == "m" and r[0].metadata == {"k": "v"}
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, file_hash string")
    assert [x.path for x in files.pending(f, f.filter(F.col("path") == "a")).collect()] == ["b"]
