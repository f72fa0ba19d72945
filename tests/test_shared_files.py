"""Reports moved into place, leases, and projects of files."""

import json
import subprocess
import threading
import time

from mnemospark.plans.locks import Lease, only_run
from mnemospark.sources import projects, sinks
from mnemospark.storage import rename, write_text


def test_a_reader_always_finds_a_report(spark, tmp_path):
    path, missing, seen, done = tmp_path / "report.json", [], set(), threading.Event()
    sinks.write_report(spark.sql("select 0 as n"), str(path))

    def read():
        while not done.is_set():
            try:
                seen.add(json.loads(path.read_text())["n"])
            except (OSError, ValueError) as e:
                missing.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 9):
        sinks.write_report(spark.sql(f"select {n} as n"), str(path))
    done.set()
    reader.join()
    assert not missing and max(seen) == 8 and len(seen) > 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["report.json"]
    sinks.write_report(spark.sql("select 1 as n where false"), str(path))
    assert path.read_text() == ""


def test_one_holder(spark, tmp_path):
    path = str(tmp_path / "lease")
    other = spark.newSession()
    with only_run(spark, path) as first, only_run(other, path) as second:
        assert first and not second
    with only_run(other, path) as again:
        assert again


def test_a_dead_holder(spark, tmp_path):
    path = str(tmp_path / "lease")
    dead, heir, late = Lease(spark, path, 0.3), Lease(spark, path, 60), Lease(spark, path, 60)
    assert dead.take() and not heir.take() and dead.renew()
    time.sleep(0.4)
    assert heir.take() and not late.take()
    assert not dead.renew()
    dead.release()
    assert not late.take()  # what the dead one gives back isn't its own any more
    heir.release()
    assert late.take()


def test_many_at_once(spark, tmp_path):
    path, won = str(tmp_path / "lease"), []
    threads = [threading.Thread(target=lambda: won.append(Lease(spark, path, 60).take())) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won.count(True) == 1


def test_rename(spark, tmp_path):
    for name in "ab":
        write_text(spark, str(tmp_path / name), name)
    assert not rename(spark, str(tmp_path / "a"), str(tmp_path / "b")) and (tmp_path / "b").read_text() == "b"
    assert rename(spark, str(tmp_path / "a"), str(tmp_path / "b"), over=True) and (tmp_path / "b").read_text() == "a"
    assert not rename(spark, str(tmp_path / "none"), str(tmp_path / "c"))


def test_projects_of_real_repositories(spark, tmp_path):
    for name in ("outer", "outer/inner", "plain"):
        (tmp_path / name / "docs").mkdir(parents=True)
        subprocess.run(["git", "init", "-q"], cwd=tmp_path / name, check=True)
    subprocess.run(["git", "remote", "add", "origin", "https://host/o/Some.Repo.git"], cwd=tmp_path / "outer", check=True)
    (tmp_path / "outer/inner" / projects.CONFIG).write_text('{"project": "The Inner"}')
    (tmp_path / "plain" / projects.CONFIG).write_text("{broken")
    roots = projects.described(spark.createDataFrame([(str(tmp_path / n),) for n in ("outer", "outer/inner", "plain")], "root string"))
    paths = ["outer/docs/a.md", "outer/inner/docs/b.md", "plain/c.md", "else/Where/d.md"]
    files = spark.createDataFrame([(str(tmp_path / p), i) for i, p in enumerate(paths)] + [(None, 9)], "path string, n int")
    got = {r.n: r.project for r in projects.projects(files, roots).collect()}
    assert got == {0: "some-repo", 1: "the-inner", 2: "plain", 3: "where", 9: None}


def test_names_alike_are_not_ancestors(spark):
    roots = spark.createDataFrame([("/w/app", None, None), ("/w/app", '{"project": "x"}', None), ("/w/ap/", None, None)], "root string, config string, remote string")
    files = spark.createDataFrame([("/w/apple/a",), ("/w/app/b",), ("/w/ap/c",)], "path string")
    assert {r.path: (r.root, r.project) for r in projects.projects(files, roots).collect()} == {"/w/apple/a": (None, "apple"), "/w/app/b": ("/w/app", "app"), "/w/ap/c": ("/w/ap", "ap")}
