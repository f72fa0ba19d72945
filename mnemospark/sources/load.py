"""The load sink: facts sent to a memory service, with retries, few calls at once, and an account of what became of them.

``spark.write.format("memory_load")`` sends each row of ``(content, category, project, subject)`` as one tool call.  The
tasks tell their counts in commit messages, and the driver writes their sum as one report when all have ended; a job that
fails leaves no report.  A service may get a fact again if a task is repeated, as the service's own near-duplicate stage
expects.  The service is a URL, or a folder for work without a network: there each task leaves a file of what it sent,
moved into place at the end, so that a repeated task leaves one.
"""

from __future__ import annotations

import json
import time
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Calls made for a fact, seconds waited after the first failure (twice that after the second), the name of the writing agent.
TRIES, WAIT, AGENT = 3, 8, "transcript-miner"
#: Calls under way at once.
AT_ONCE = 2
#: The code with which the service lets a fact go.
NEEDS_CHECK = "MEMORY_NEEDS_SELF_CHECK"


@dataclass
class Counts(WriterCommitMessage):
    """Facts that the service took, those that it refused, and those given up after all tries."""

    written: int = 0
    refused: int = 0
    failed: int = 0


def request(fact: dict) -> dict:
    """The tool call for a fact; project and subject are left out where they are missing."""
    own = {k: fact[k] for k in ("project", "subject") if fact.get(k)}
    return {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "add_memory", "arguments": {"content": fact["content"], "agent": AGENT, "metadata": {"category": fact["category"]}} | own}}


def taken(answer: dict) -> bool:
    """Whether the service has stored the fact: no error, and not let go by its own check."""
    result = answer.get("result") or {}
    if result.get("isError"):
        return False
    try:
        said = json.loads(result["content"][0]["text"])
    except (ValueError, TypeError, LookupError):
        return True
    return not (isinstance(said, dict) and (said.get("stored") is False or said.get("error") == NEEDS_CHECK))


class _Service:
    def __init__(self, url: str):
        self.url = url

    def call(self, payload: dict) -> dict:
        post = urllib.request.Request(self.url, json.dumps(payload).encode(), {"Content-Type": "application/json", "Accept": "application/json"})
        with urllib.request.urlopen(post, timeout=180) as answer:
            return json.load(answer)

    def close(self) -> None:
        pass


class _Folder:
    """Answers like a service that lets short facts go and can't be reached for a fact without content."""

    def __init__(self, uri: str, least: int):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(uri)
        self.least, self.lines = least, f"{self.folder}/.{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder)
        self.out = self.fs.open_output_stream(self.lines)

    def call(self, payload: dict) -> dict:
        content = payload["params"]["arguments"]["content"]
        if content is None:
            raise OSError("no content")
        if len(content) < self.least:
            return {"result": {"content": [{"text": json.dumps({"stored": False, "error": NEEDS_CHECK})}]}}
        self.out.write((json.dumps(payload["params"]["arguments"]) + "\n").encode())
        return {"result": {}}

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.lines, f"{self.folder}/part-{TaskContext.get().partitionId():05}.jsonl")


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, rows: Iterator) -> Counts:
        o, counts = self.options, Counts()
        service = _Service(o["url"]) if o["url"].startswith("http") else _Folder(o["url"], int(o.get("least", 0)))
        for row in rows:
            outcome = self._sent(service, request(row.asDict()), float(o.get("wait", WAIT)))
            setattr(counts, outcome, getattr(counts, outcome) + 1)
        service.close()
        return counts

    def _sent(self, service, payload: dict, wait: float) -> str:
        for turn in range(TRIES):
            try:
                return "written" if taken(service.call(payload)) else "refused"
            except (OSError, ValueError):
                if turn < TRIES - 1:
                    time.sleep(wait * (turn + 1))
        return "failed"

    def commit(self, messages: list[Counts | None]) -> None:
        total = {k: sum(getattr(m, k) for m in messages if m) for k in ("written", "refused", "failed")}
        fs, path = pyarrow.fs.FileSystem.from_uri(self.options["report"])
        fs.create_dir(path.rsplit("/", 1)[0])
        draft = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(total).encode())
        fs.move(draft, path)

    def abort(self, messages: list[Counts | None]) -> None:
        """Nothing to undo: what the service has, it has; there is no report."""


class MemoryLoad(DataSource):
    """Options: url, report, and perhaps wait and, for a folder, least (characters of a fact that it takes)."""

    @classmethod
    def name(cls) -> str:
        return "memory_load"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def load(facts: DataFrame, url: str, report: str, at_once: int = AT_ONCE, **options: str) -> DataFrame:
    """Send facts ``(content, category, project, subject)``; ``(written, refused, failed)`` of the run, from its report.

    No more than ``at_once`` calls are under way: the facts are dealt to so many tasks, which is the service's bound and
    not Spark's.
    """
    spark = facts.sparkSession
    spark.dataSource.register(MemoryLoad)
    dealt = facts.select("content", "category", "project", "subject").repartition(at_once)
    dealt.write.format("memory_load").mode("append").options(url=url, report=report, **options).save()
    return spark.read.schema("written long, refused long, failed long").json(report).select("written", "refused", "failed", F.lit(at_once).alias("tasks"))
