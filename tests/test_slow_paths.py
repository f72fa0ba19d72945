"""Work that must not be done twice, or once for each place in a run."""

import time

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.sources import sinks


def test_long_runs_of_dashes(spark):
    df = spark.range(1).select(F.concat(F.lit("-a"), F.repeat(F.lit(" "), 200_000), F.lit("b- ")).alias("x"))
    began = time.time()
    r = df.select(T.path_slug(F.col("x")).alias("p"), T.slugify(F.col("x")).alias("s")).first()
    assert r.s == "a-b" and len(r.p) == 200_002 and time.time() - began < 8
    assert spark.range(1).select(T.path_slug(F.lit(" -- ")).alias("p")).first().p is None


def test_errors_are_found_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def found(x):
        with open(calls, "a") as f:
            f.write("x")
        return "MEMORY_CONTAINS_SECRET" if x == 1 else None if x == 2 else "OTHER"

    writes = spark.range(5).select(F.udf(found)("id").alias("error"), *[F.lit("l").alias(c) for c in ("ts", "outcome", "backend")], F.col("id").cast("string").alias("subject"), F.lit("c").alias("content"))
    sinks.append_gate_log(writes.select("error", F.coalesce("error", "outcome").alias("outcome"), "ts", "backend", "subject", "content"), f"{tmp_path}/log")
    assert {r.subject for r in spark.read.json(f"{tmp_path}/log").collect()} == {"0", "2", "3", "4"}
    assert len(open(calls).read()) == 5
