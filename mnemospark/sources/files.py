"""Other inputs: documents, commit logs, logs, captures, probes, aliases, manifests, checkpoints."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mnemospark.functions.text import strip

#: Documents taken from a repository's root, names never taken, folders never searched.
ROOT_FILES = ("CLAUDE.md", "AGENTS.md", "METHODOLOGY.md", "IDENTITY.md")
SKIP_NAMES = ("README.md", "readme.md")
SKIP_DIRS = ("node_modules", ".git", "__pycache__", "dist", "build", ".venv", "venv")
#: Beginnings of commit subjects that say nothing.
NOISE = ("merge branch", "merge pull request", "initial commit", "wip", "update readme")


def markdown_files(files: DataFrame, root: str) -> DataFrame:
    """Of files below ``root/<repository>/``: the named root documents and ``docs/*.md``, without skipped names and folders."""
    below = F.split(F.regexp_replace("path", "^file:", ""), "/")
    depth = len(root.rstrip("/").split("/"))
    repo, rest = F.get(below, F.lit(depth)), F.slice(below, F.lit(depth + 2), F.size(below))
    name = F.element_at(below, -1)
    top = (F.size(rest) == 1) & name.isin(*ROOT_FILES)
    docs = (F.size(rest) == 2) & (F.get(rest, F.lit(0)) == "docs") & name.endswith(".md") & ~name.isin(*SKIP_NAMES)
    return files.filter(~repo.startswith(".") & ~repo.isin(*SKIP_DIRS) & (top | docs)).withColumn("source", F.lit("markdown"))


def is_noise(subject: Column) -> Column:
    low = F.lower(subject)
    return F.coalesce(*[F.when(low.startswith(p), True) for p in NOISE], F.lit(False))


def clean_commit_log(text: Column) -> Column:
    """A log of ``COMMIT: subject`` and body lines without co-author lines and noisy subjects."""
    def kept(line: Column) -> Column:
        bare = strip(line)
        return ~F.lower(bare).startswith("co-authored-by") & ~(bare.startswith("COMMIT: ") & is_noise(F.substring(bare, 9, 1 << 20)))

    return strip(F.array_join(F.filter(F.split(text, "\r?\n"), kept), "\n"))


class _Repo(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _CommitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Repo(p) for p in self.paths]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        def git(*args: str) -> str | None:
            try:
                done = subprocess.run(["git", *args], cwd=partition.path, capture_output=True, text=True, errors="replace", timeout=60, check=False)
            except (OSError, subprocess.TimeoutExpired):
                return None
            return done.stdout if done.returncode == 0 else None

        head = git("rev-parse", "HEAD")
        log = git("log", "--no-merges", "--format=COMMIT: %s%n%b", "--all") if head else None
        yield partition.path, None if log is None else head.strip(), log


class CommitLogSource(DataSource):
    """``spark.read.format("commit_log").option("paths", "a,b")``: ``(path, head, content)`` of each repository, a partition each; head and content are null where git fails."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return "path string, head string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _CommitReader(self.options)


def commit_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, head, text)``, cleaned; repositories that can't be read have neither head nor text and so are never checked off."""
    spark.dataSource.register(CommitLogSource)
    raw = spark.read.format("commit_log").option("paths", ",".join(paths)).load()
    return raw.select("path", "head", clean_commit_log(F.col("content")).alias("text"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """``(ts, query, namespaces, top5_ids, _corrupt_record)`` of a JSON Lines capture; bad lines keep their text in the last."""
    return spark.read.schema("ts string, query string, namespaces array<string>, top5_ids array<string>, _corrupt_record string").json(path)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Probes of a JSON list; a probe without question or expectations is an error."""
    p = spark.read.schema("id long, question string, expect_any array<string>, subject string, project string").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    ok = (F.coalesce("question", F.lit("")) != "") & (F.coalesce(F.size("expect_any"), F.lit(0)) > 0)
    return p.withColumn("question", F.when(ok, F.col("question")).otherwise(F.raise_error(F.concat(F.lit("bad probe "), F.coalesce(F.col("id").cast("string"), F.lit("?"))))))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``(alias, canonical)`` of a JSON object; empty if there is none or it can't be read."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001 - no table is no alias
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "alias string, canonical string")
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "canonical")).select("alias", F.trim("canonical").alias("canonical"))


def read_manifest(lines: DataFrame) -> DataFrame:
    """``(repo_path, target_path)`` of lines ``value``; comments and blank lines drop out."""
    line = F.trim("value")
    return lines.filter((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+").alias("x")).select(F.get("x", F.lit(0)).alias("repo_path"), F.get("x", F.lit(1)).alias("target_path"))


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, sha256)``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.regexp_replace("path", "^file:", "").alias("path"), F.sha2("content", 256).alias("sha256"))


def index_feed(points: DataFrame) -> DataFrame:
    """``(id, namespace, text, metadata)`` for the keyword index from ``(id, payload map)``; points without a text drop out."""
    full = lambda k: F.nullif(F.col("payload")[k], F.lit(""))
    out = points.select("id", F.coalesce(F.col("payload")["user_id"], F.lit("")).alias("namespace"), F.coalesce(full("data"), full("memory")).alias("text"), F.map_filter("payload", lambda k, v: ~k.isin("data", "memory", "hash")).alias("metadata"))
    return out.filter("text is not null")


def pending(files: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Files ``(path, file_hash)`` that the checkpoint doesn't have as they are."""
    return files.join(checkpoint.select("path", "file_hash").distinct(), ["path", "file_hash"], "left_anti")
