"""Reports on the health of a store: writes, gates, predictions, logs.  ``as_of`` is a parameter, so a report can be rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.parsing import iso_date, iso_time
from mnemospark.functions.text import filled

#: Writes of one source in a day above which it is a flood, and gate values that a report always has.
FLOOD, GATE_VALUES = 30, ("skipped", "bypassed")
#: Prediction states that a report always has.
PREDICTIONS = ("open", "expired_open", "hit", "miss")


def in_day(at: Column, as_of: Column, keep_missing: bool = False) -> Column:
    """Within the 24 hours before ``as_of``; times that are missing drop out, or stay."""
    return F.coalesce(at >= as_of - F.expr("interval 24 hours"), F.lit(keep_missing))


def _with_zeros(counts: DataFrame, names: tuple[str, ...], key: str) -> DataFrame:
    zeros = counts.sparkSession.createDataFrame([(n, 0) for n in names], f"{key} string, n long")
    return counts.unionByName(zeros).groupBy(key).agg(F.sum("n").alias("n"))


def writes_by_source(points: DataFrame, as_of: Column) -> DataFrame:
    recent = points.filter(in_day(iso_time(F.col("created_at")), as_of))
    return recent.groupBy(F.coalesce(filled(F.col("source")), F.lit("(unknown)")).alias("source")).agg(F.count("*").alias("n"))


def floods(points: DataFrame, as_of: Column, threshold: int = FLOOD) -> DataFrame:
    return writes_by_source(points, as_of).filter(F.col("n") > threshold)


def gate_mix(points: DataFrame, as_of: Column) -> DataFrame:
    """``(gate, n)`` of the last day with zeros filled in; one row ``no data`` if no point has a gate."""
    seen = points.filter(in_day(iso_time(F.col("created_at")), as_of) & filled(F.col("gate")).isNotNull()).groupBy("gate").agg(F.count("*").alias("n"))
    none = seen.agg(F.count("*").alias("k")).filter("k = 0").select(F.lit("no data").alias("gate"), F.lit(0).cast("long").alias("n"))
    some = seen.agg(F.count("*").alias("k")).filter("k > 0").select("k")
    return _with_zeros(seen, GATE_VALUES, "gate").join(F.broadcast(some), how="cross").select("gate", "n").unionByName(none)


def prediction_status(points: DataFrame, today: Column) -> DataFrame:
    """``(status, n)``; an open prediction has expired if its date is before today; a date that can't be read hasn't."""
    p = points.filter("claim_type = 'prediction'")
    status = F.coalesce(filled(F.col("status")), F.lit("open"))
    expired = F.coalesce(iso_date(F.col("expires_on")) < today, F.lit(False))
    return _with_zeros(p.groupBy(F.when((status == "open") & expired, "expired_open").otherwise(status).alias("status")).agg(F.count("*").alias("n")), PREDICTIONS, "status")


def parse_gate_log(lines: DataFrame) -> DataFrame:
    """``(at, outcome, backend, bad)`` from log lines ``value``: JSON objects, else two words; blank lines drop out."""
    line = F.trim("value")
    field = lambda *names: F.coalesce(*[filled(F.get_json_object(line, f"$.{n}")) for n in names])
    words = F.regexp_extract(line, r"^(\S+)\s+(\S+)", 2)
    first = F.regexp_extract(line, r"^(\S+)\s+(\S+)", 1)
    told = field("outcome", "result", "gate", "status")
    out = lines.filter(line != "").select(
        F.coalesce(iso_time(field("timestamp", "ts", "created_at")), F.when(told.isNull(), iso_time(filled(first)))).alias("at"), F.coalesce(told, filled(words)).alias("outcome"), field("backend").alias("backend")
    )
    return out.withColumn("bad", F.col("outcome").isNull())


def gate_log_stats(parsed: DataFrame, as_of: Column) -> DataFrame:
    """``(what, name, n)``: lines seen, in the window, unreadable; outcomes and backends of the window.  Lines without a time are in it."""
    inside = ~F.col("bad") & in_day(F.col("at"), as_of, keep_missing=True)
    row = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    rows = F.array(
        row("lines", F.lit("seen")), F.when(inside, row("lines", F.lit("in_window"))), F.when(F.col("bad"), row("lines", F.lit("unreadable"))),
        F.when(inside, row("outcome", F.col("outcome"))), F.when(inside & F.col("backend").isNotNull(), row("backend", F.col("backend"))),
    )
    return parsed.select(F.explode(F.array_compact(rows)).alias("x")).groupBy("x.what", "x.name").agg(F.count("*").alias("n"))


def metrics(job: str, counts: DataFrame, name: str, label: str, value: str = "n", kind: str = "gauge") -> DataFrame:
    """``(job, name, type, label, value)`` and its line of exposition text."""
    line = F.concat(F.lit(f'{name}{{{label}="'), F.regexp_replace(F.col(label), '(["\\\\])', "\\\\$1"), F.lit('"} '), F.col(value).cast("string"))
    return counts.select(F.lit(job).alias("job"), F.lit(name).alias("name"), F.lit(kind).alias("type"), F.col(label).alias("label"), F.col(value).cast("double").alias("value"), line.alias("line"))


def manifest_drift(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``(repo_path, target_path, state)`` of manifest rows whose target is ``missing`` or ``differs``; ``files`` is ``(path, sha256)``."""
    a, b = files.select(F.col("path").alias("repo_path"), F.col("sha256").alias("have")), files.select(F.col("path").alias("target_path"), F.col("sha256").alias("got"))
    both = manifest.join(a, "repo_path", "left").join(b, "target_path", "left")
    state = F.when(F.col("got").isNull(), "missing").when(~F.col("have").eqNullSafe(F.col("got")), "differs")
    return both.select("repo_path", "target_path", state.alias("state")).filter("state is not null")
