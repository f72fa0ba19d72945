"""Forges without a network: listings, streams, failures, comments beyond a page."""

import json

import pytest

from mnemospark.sources import forge
from mnemospark.streaming.increments import kept, run_available

NAMES = {"github": lambda o, r, t: {"owner": {"login": o}, "name": r, "updated_at": t}, "gitlab": lambda o, r, t: {"namespace": {"full_path": o}, "path": r, "last_activity_at": t}, "gitea": lambda o, r, t: {"owner": {"login": o}, "name": r, "updated_at": t}}


class Fixture:
    def __init__(self, root, kind):
        self.root, self.kind, self.forge, self.times = root, kind, forge.FORGES[kind], {}

    def put(self, path, page, items, raw=None):
        folder = self.root / path.strip("/")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{page}.json").write_text(raw if raw is not None else json.dumps(items))

    def fill(self, path, repo, n=""):
        return path.format(o="acme", r=repo, n=n, id=f"acme%2F{repo}")

    def repo(self, name, time, notes=0, broken=False):
        """A repository with one issue that has so many notes."""
        f = self.forge
        self.times[name] = time
        self.put(self.fill(f["repo"], name), "page-1", NAMES[self.kind]("acme", name, time))
        issue = {f["number"]: 1, "state": "open", "title": f"t-{name}", "body": "b", f["count"]: notes}
        self.put(self.fill(f["issues"][0][0], name), {"github": "page-1", "gitlab": "opened-page-1", "gitea": "open-page-1"}[self.kind], [issue])
        for k in range(0, notes, f["page"]):
            self.put(self.fill(f["notes"], name, "1"), f"page-{k // f['page'] + 1}", [{"body": f"note {i}"} for i in range(k, min(notes, k + f["page"]))])
        self.put(self.fill(f["commits"], name), "page-1", [], "{not json" if broken else None)
        self.list()

    def list(self):
        every = [NAMES[self.kind]("acme", n, t) for n, t in sorted(self.times.items())]
        size = self.forge["page"]
        for k in range(0, len(every) + 1, size):
            self.put(self.forge["listed"][0].format(o="acme"), f"page-{k // size + 1}", every[k : k + size])
        own = every if self.kind != "gitea" else {"data": every}
        self.put(self.forge["own"][0], "page-1", own)


@pytest.fixture(params=sorted(forge.FORGES))
def fixture(request, tmp_path):
    return Fixture(tmp_path / "api", request.param)


def test_listing_status_and_all_comments(spark, fixture):
    fixture.repo("one", "2024-01-01T00:00:00Z", notes=2 * fixture.forge["page"] + 3)
    fixture.repo("two", "2024-01-02T00:00:00Z", broken=True)
    fixture.repo("three", "2024-01-03T00:00:00Z")
    for owners in (["acme"], []):
        objects = forge.read_forge(spark, fixture.kind, str(fixture.root), owners=owners, skip=["acme/three"]).cache()
        assert {(r.repo, r.ok) for r in forge.statuses(objects).collect()} == {("one", True), ("two", False)}
        assert objects.filter("resource = 'note'").count() == 2 * fixture.forge["page"] + 3
        assert {r.repo for r in forge.fingerprints(objects).collect()} == {"one"}
        assert {r.repo for r in forge.issues_text(forge.complete(objects)).collect()} == {"one"}
        objects.unpersist()


def test_long_listings_are_paged(fixture):
    for k in range(fixture.forge["page"] + 5):
        fixture.times[f"r{k:03}"] = "2024-01-01T00:00"
    fixture.list()
    api = forge._Api({"forge": fixture.kind, "base": str(fixture.root), "owners": "acme"})
    assert len(api.repositories()) == fixture.forge["page"] + 5


def test_stream_reads_what_has_changed(spark, fixture, tmp_path):
    out, failures = str(tmp_path / "out"), str(tmp_path / "failures")

    def run(number):
        stream = forge.stream_forge(spark, fixture.kind, str(fixture.root), ["acme"], failures)
        run_available(stream, kept(f"{out}/{number}"), str(tmp_path / "checkpoint")).awaitTermination()
        try:
            rows = forge.statuses(spark.read.parquet(f"{out}/{number}")).collect()
        except Exception:
            rows = []
        return {(r.repo, r.ok) for r in rows}

    fixture.repo("one", "2024-01-01T00:00:00Z")
    fixture.repo("two", "2024-01-02T00:00:00Z", broken=True)
    fixture.repo("three", "2024-01-03T00:00:00Z")
    assert run(1) == {("one", True), ("two", False), ("three", True)}
    fixture.repo("three", "2024-02-03T00:00:00Z")
    assert run(2) == {("two", False), ("three", True)}  # what failed is tried again
    fixture.repo("two", "2024-01-02T00:00:00Z")
    assert run(3) == {("two", True)}
    assert run(4) == set()
