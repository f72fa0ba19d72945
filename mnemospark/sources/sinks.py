"""Sinks: appends, whole rebuilds, reports, log lines, dumps and metrics."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.storage import discard, materialise, remove, rename, write_text


def append_points(points: DataFrame, path: str) -> None:
    """Append to the point table, by namespace, so that a search of one namespace reads one folder."""
    points.write.mode("append").partitionBy("namespace").parquet(path)


def rebuild(table: DataFrame, path: str) -> int:
    """Replace a table as a whole: a new version is written beside the old, then a pointer row names it.  Returns its rows.

    Pointer rows are only ever added, so a reader finds the old version or the new one, never none.
    """
    version = uuid.uuid4().hex
    table.write.parquet(f"{path}/version={version}")
    spark = table.sparkSession
    spark.createDataFrame([(time.time_ns(), version)], "written long, version string").coalesce(1).write.mode("append").parquet(f"{path}-current")
    return spark.read.parquet(f"{path}/version={version}").count()


def current(spark, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}-current").agg(F.max_by("version", "written").alias("version")).first().version
    return spark.read.parquet(f"{path}/version={version}")


def _publish(rows: DataFrame, path: str, kind: str) -> None:
    """Rows of a small frame as one file at ``path``, moved there in one step: a reader finds the old file or the new one."""
    spark, draft = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    rows.coalesce(1).write.format(kind).save(draft)
    part = spark.read.format(kind).load(draft).inputFiles()
    if part:
        rename(spark, part[0], path, over=True)
    else:
        write_text(spark, f"{draft}/none", "")
        rename(spark, f"{draft}/none", path, over=True)
    remove(spark, draft)


def write_report(report: DataFrame, path: str) -> None:
    """A report as one JSON object a row, in one file; there is no moment without a report."""
    _publish(report, path, "json")


def append_gate_log(writes: DataFrame, path: str) -> None:
    """JSON lines ``ts, outcome, backend, subject, content_first80chars``; candidates that hold a secret are never logged."""
    line = ["ts", "outcome", "backend", "subject", "content_first80chars"]
    # A filter would be pushed below the projections, where the error would be found a second time: lines are written first.
    first = F.substring(F.coalesce("content", F.lit("")), 1, 80)
    logged = F.coalesce(F.col("error") != "MEMORY_CONTAINS_SECRET", F.lit(True))
    rows = writes.select("ts", "outcome", "backend", "subject", first.alias("content_first80chars"), logged.alias("logged"))
    rows = materialise(rows, "gate-log-lines")
    rows.filter("logged").select(*line).write.mode("append").json(path, ignoreNullFields=False)
    discard(rows)


def append_captures(captures: DataFrame, path: str) -> None:
    captures.select("ts", "query", "namespaces", "top5_ids").write.mode("append").json(path)


def dump_markdown(paragraphs: DataFrame, path: str) -> None:
    """Paragraphs in order with a blank line between, as text files whose names keep the order."""
    paragraphs.orderBy("ordinal").select("paragraph").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_metrics(lines: DataFrame, path: str) -> None:
    """Lines of exposition text."""
    _publish(lines.select("line"), path, "text")
