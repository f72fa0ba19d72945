"""Issues and commits of code forges: a Python data source that pages through the API, and rendering with DataFrame functions.

The source gives raw objects, ``(owner, repo, resource, parent, seq, payload)``, a partition for each repository.  The
last of a repository is its ``status``: whether all of it came.  The base is a URL, or a folder with the same paths as
files (``.../issues/page-1.json``) for work without a network.

Repositories are named, or listed from their owners.  As a stream the source has the map from repository to fingerprint
as its offset, so that a run reads the repositories that have changed; one that failed leaves a mark in the folder
``failures``, which alters its fingerprint, so that the next run reads it again.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mnemospark.functions.text import strip
from mnemospark.sources.files import is_noise

#: Commits looked at, and characters kept of issue bodies, comments and commit messages; shortest message.
MAX_COMMITS, BODY_CUT, COMMENT_CUT, MESSAGE_CUT, SHORT_MESSAGE = 200, 1500, 800, 600, 10

#: Calls made for a page.
TRIES = 3
#: What differs between the forges.  Paths are filled with owner and repository.
FORGES = {
    "github": {"page": 100, "size": "per_page", "listed": ("/orgs/{o}/repos", {"type": "all"}), "own": ("/user/repos", {"affiliation": "owner"}), "repo": "/repos/{o}/{r}", "issues": [("/repos/{o}/{r}/issues", {"state": "all"}, None)], "notes": "/repos/{o}/{r}/issues/{n}/comments", "commits": "/repos/{o}/{r}/commits", "number": "number", "count": "comments"},
    "gitlab": {
        "listed": ("/api/v4/groups/{o}/projects", {"include_subgroups": "true", "simple": "true"}), "own": ("/api/v4/projects", {"owned": "true", "simple": "true"}), "page": 100, "size": "per_page", "repo": "/api/v4/projects/{id}", "issues": [("/api/v4/projects/{id}/issues", {"state": s}, s) for s in ("opened", "closed")], "notes": "/api/v4/projects/{id}/issues/{n}/notes",
        "commits": "/api/v4/projects/{id}/repository/commits", "number": "iid", "count": "user_notes_count",
    },
    "gitea": {
        "listed": ("/api/v1/orgs/{o}/repos", {}), "own": ("/api/v1/repos/search", {}), "page": 50, "size": "limit", "repo": "/api/v1/repos/{o}/{r}", "issues": [("/api/v1/repos/{o}/{r}/issues", {"type": "issues", "state": s}, s) for s in ("closed", "open")], "notes": "/api/v1/repos/{o}/{r}/issues/{n}/comments",
        "commits": "/api/v1/repos/{o}/{r}/commits", "number": "number", "count": "comments",
    },
}


class _Repo(InputPartition):
    def __init__(self, owner: str, repo: str):
        self.owner, self.repo = owner, repo


class _Api:
    """Calls of one forge."""

    def __init__(self, options: dict):
        self.forge, self.base, self.token = FORGES[options["forge"]], options["base"].rstrip("/"), options.get("token", "")
        self.named = [tuple(x.rsplit("/", 1)) for x in options.get("repos", "").split(",") if x]
        self.owners = [x for x in options.get("owners", "").split(",") if x]
        self.skipped = {x for x in options.get("skip", "").split(",") if x}
        self.failures = options.get("failures", "")

    def get(self, path: str, query: dict, page: int):
        """The parsed answer, or None if there is no such page; an error that lasts is raised."""
        if "://" in self.base:
            url = f"{self.base}{path}?{urllib.parse.urlencode(query | {self.forge['size']: self.forge['page'], 'page': page})}"
            headers = {"Authorization": f"Bearer {self.token}", "PRIVATE-TOKEN": self.token} if self.token else {}
            for turn in range(TRIES):
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as answer:
                        return json.load(answer)
                except urllib.error.HTTPError as e:
                    if e.code == 404:
                        return None
                    failure: OSError = e
                except OSError as e:
                    failure = e
                time.sleep(2**turn)
            # Half a listing must not pass for a whole one, whose fingerprint would then be checked off.
            raise RuntimeError(f"{path}, page {page}: {failure}")
        state = query.get("state", "all")
        file = f"{self.base}{path}/{'' if state == 'all' else state + '-'}page-{page}.json"
        return json.load(open(file, encoding="utf-8")) if os.path.exists(file) else None

    def pages(self, path: str, query: dict) -> Iterator[dict]:
        page = 1
        while items := self.get(path, query, page):
            items = items.get("data", []) if isinstance(items, dict) else items
            yield from items
            if len(items) < self.forge["page"]:
                return
            page += 1

    def repositories(self) -> dict[str, str]:
        """Fingerprints by ``owner/name``: of those that are named, or else of all that the owners, or else the account, have."""
        found: dict[str, str] = {}
        if self.named:
            for o, r in self.named:
                found[f"{o}/{r}"] = _changed(self._described(o, r))
        else:
            path, query = self.forge["listed" if self.owners else "own"]
            for owner in self.owners or [""]:
                for r in self.pages(path.format(o=urllib.parse.quote(owner, safe="")), query):
                    o = r.get("namespace", {}).get("full_path") or r.get("owner", {}).get("login") or owner
                    found[f"{o}/{r.get('path') or r['name']}"] = _changed(r)
        return {k: v for k, v in sorted(found.items()) if k not in self.skipped}

    def _described(self, o: str, r: str) -> dict:
        try:
            return self.get(self.filled(self.forge["repo"], o, r), {}, 1) or {}
        except (OSError, ValueError, RuntimeError):
            return {}

    def filled(self, path: str, o: str, r: str, n: str = "") -> str:
        return path.format(o=o, r=r, n=n, id=urllib.parse.quote(f"{o}/{r}", safe=""))

    def marks(self) -> dict[str, str]:
        """What the marks of failed repositories say."""
        if not self.failures:
            return {}
        fs, folder = pyarrow.fs.FileSystem.from_uri(self.failures)
        files = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        return {urllib.parse.unquote(f.base_name): fs.open_input_stream(f.path).read().decode() for f in files}

    def mark(self, name: str) -> None:
        """A new mark for a repository that failed; it stays, so that a later success isn't taken for another change."""
        if self.failures:
            fs, folder = pyarrow.fs.FileSystem.from_uri(self.failures)
            fs.create_dir(folder)
            with fs.open_output_stream(f"{folder}/{urllib.parse.quote(name, safe='')}") as out:
                out.write(uuid.uuid4().hex.encode())

    def rows(self, o: str, r: str) -> Iterator[tuple]:
        """All objects of a repository, then its status; an error ends the repository, not the scan."""
        seq, error = 0, None
        try:
            for seq, row in enumerate(self._objects(o, r)):
                resource, parent, payload = row
                yield o, r, resource, parent, seq, json.dumps(payload)
        except (OSError, ValueError, RuntimeError, KeyError, AttributeError) as e:
            error = f"{type(e).__name__}: {e}"
            self.mark(f"{o}/{r}")
        yield o, r, "status", None, seq + 1, json.dumps({"ok": error is None, "error": error})

    def _objects(self, o: str, r: str) -> Iterator[tuple]:
        repo = self.get(self.filled(self.forge["repo"], o, r), {}, 1)
        if repo:
            yield "repo", None, repo
        for path, query, state in self.forge["issues"]:
            for issue in self.pages(self.filled(path, o, r), query):
                number = str(issue[self.forge["number"]])
                yield "issue", number, issue | ({"state": state} if state else {})
                if issue.get(self.forge["count"], 0) and "pull_request" not in issue:
                    for note in self.pages(self.filled(self.forge["notes"], o, r, number), {}):
                        yield "note", number, note
        for seen, commit in enumerate(self.pages(self.filled(self.forge["commits"], o, r), {}), 1):
            yield "commit", None, commit
            if seen >= MAX_COMMITS and seen % self.forge["page"] == 0:
                return


def _changed(repo: dict) -> str:
    """When a repository last changed, to the minute."""
    return (repo.get("updated_at") or repo.get("last_activity_at") or "")[:16]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.api = _Api(options)

    def partitions(self) -> list[InputPartition]:
        return [_Repo(*x) for x in self.api.named or (tuple(k.rsplit("/", 1)) for k in self.api.repositories())]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        return self.api.rows(partition.owner, partition.repo)


class _StreamReader(DataSourceStreamReader):
    """The offset is the fingerprints of all repositories, so a range of offsets is what has changed in between."""

    def __init__(self, options: dict):
        self.api = _Api(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        marks = self.api.marks()
        return {k: f"{v} {marks[k]}" if k in marks else v for k, v in self.api.repositories().items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Repo(*k.rsplit("/", 1)) for k, v in end.items() if start.get(k) != v]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        return self.api.rows(partition.owner, partition.repo)


class ForgeSource(DataSource):
    """``spark.read.format("forge")`` or ``readStream`` with options forge, base, token, repos (``owner/name,...``) or owners, skip and failures."""

    @classmethod
    def name(cls) -> str:
        return "forge"

    def schema(self) -> str:
        return "owner string, repo string, resource string, parent string, seq long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_forge(spark: SparkSession, forge: str, base: str, repos: list[str] | None = None, token: str = "", owners: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """All objects of the named repositories, or of all that the owners have, or else the account that the token belongs to."""
    spark.dataSource.register(ForgeSource)
    return spark.read.format("forge").options(forge=forge, base=base, repos=",".join(repos or []), token=token, owners=",".join(owners or []), skip=",".join(skip or [])).load()


def stream_forge(spark: SparkSession, forge: str, base: str, owners: list[str], failures: str, token: str = "", skip: list[str] | None = None) -> DataFrame:
    """The repositories that have changed since the stream's last run; ``failures`` is a folder that all machines share."""
    spark.dataSource.register(ForgeSource)
    return spark.readStream.format("forge").options(forge=forge, base=base, owners=",".join(owners), failures=failures, token=token, skip=",".join(skip or [])).load()


def statuses(objects: DataFrame) -> DataFrame:
    """``(owner, repo, ok, error)``."""
    return objects.filter("resource = 'status'").select("owner", "repo", F.coalesce(_field("ok") == "true", F.lit(False)).alias("ok"), _field("error").alias("error"))


def complete(objects: DataFrame) -> DataFrame:
    """Objects of the repositories that came whole: half a listing must not pass for a whole one."""
    return objects.join(statuses(objects).filter("not ok").select("owner", "repo"), ["owner", "repo"], "left_anti")


def _field(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def fingerprints(objects: DataFrame) -> DataFrame:
    """``(owner, repo, file_hash)``: when the repository last changed, to the minute; none for one that didn't come whole."""
    return complete(objects).filter("resource = 'repo'").select("owner", "repo", F.substring(F.coalesce(_field("updated_at"), _field("last_activity_at"), F.lit("")), 1, 16).alias("file_hash"))


def issues_text(objects: DataFrame) -> DataFrame:
    """``(owner, repo, text)``: issues with labels, bodies and comments; pull requests and system notes are left out."""
    labels = F.coalesce(
        F.nullif(F.array_join(F.transform(F.from_json(_field("labels"), "array<struct<name:string>>"), lambda x: x["name"]), ", "), F.lit("")), F.array_join(F.from_json(_field("labels"), "array<string>"), ", "), F.lit("")
    )
    head = F.concat(F.lit("ISSUE #"), "parent", F.lit(" ["), _field("state"), F.lit("]: "), _field("title"), F.when(labels != "", F.concat(F.lit("  [labels: "), labels, F.lit("]"))).otherwise(""))
    body = F.substring(strip(F.coalesce(_field("body"), _field("description"), F.lit(""))), 1, BODY_CUT)
    note = F.substring(strip(F.coalesce(_field("body"), F.lit(""))), 1, COMMENT_CUT)
    own = objects.filter(F.col("resource").isin("issue", "note") & _field("pull_request").isNull() & (F.coalesce(_field("system"), F.lit("false")) != "true"))
    rows = own.select(
        "owner", "repo", "parent", "seq", (F.col("resource") == "issue").alias("is_issue"),
        F.when(F.col("resource") == "issue", F.concat(head, F.when(body != "", F.concat(F.lit("\nBody: "), body)).otherwise(""))).otherwise(F.when(note != "", F.concat(F.lit("  COMMENT: "), note))).alias("line"),
    ).filter("line is not null")
    issue = rows.groupBy("owner", "repo", "parent").agg(F.min(F.when(F.col("is_issue"), F.col("seq"))).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("block"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda x: x["block"]), "\n\n")
    return issue.filter("at is not null").groupBy("owner", "repo").agg(strip(text).alias("text"))


def commits_text(objects: DataFrame) -> DataFrame:
    """``(owner, repo, text)``: commits that say something, newest as the forge has them."""
    message = strip(F.coalesce(_field("commit.message"), _field("message"), F.lit("")))
    sha = F.substring(F.coalesce(_field("sha"), _field("id"), F.lit("")), 1, 8)
    author = F.coalesce(_field("commit.author.name"), _field("author_name"), F.lit(""))
    date = F.substring(F.coalesce(_field("commit.author.date"), _field("authored_date"), F.lit("")), 1, 10)
    own = objects.filter("resource = 'commit'").withColumn("message", message).filter((F.length("message") >= SHORT_MESSAGE) & ~is_noise(F.split("message", "\n")[0]))
    line = F.concat(F.lit("COMMIT "), sha, F.lit(" by "), author, F.lit(" on "), date, F.lit(":\n"), F.substring("message", 1, MESSAGE_CUT))
    return own.select("owner", "repo", "seq", line.alias("line")).groupBy("owner", "repo").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n\n")).alias("text"))
