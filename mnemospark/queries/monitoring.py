"""Queries of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import monitoring as M
from mnemospark.operators import routing
from mnemospark.queries.base import MEMORIES, memories, read



def as_of() -> Column:
    return F.lit("2024-06-20T12:00:00Z").cast("timestamp")


_NOW, _DAY = "timestamp '2024-06-20 12:00:00'", "interval 24 hours"
_AT = "try_cast(replace(replace(created_at, 'T', ' '), 'Z', '') as timestamp)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories written over few days, so that a day has many."""
    n = F.col("id").cast("long")
    at = F.when(n % 50 != 13, F.concat(F.lit("2024-06-"), F.lpad((n % 3 + 18).cast("string"), 2, "0"), F.lit("T"), F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":00:00Z")))
    return memories(spark, sf_dir).withColumn("created_at", at).withColumn("source", F.when(n % 19 > 0, F.concat(F.lit("s"), (n % 7 % 4).cast("string"))))


POINTS = "points as (select * exclude (created_at, source), case when id::BIGINT % 50 <> 13 then '2024-06-' || (id::BIGINT % 3 + 18) || 'T' || lpad(cast(id::BIGINT % 24 as varchar), 2, '0') || ':00:00Z' end as created_at, case when id::BIGINT % 19 > 0 then 's' || (id::BIGINT % 7 % 4) end as source from memories)"


def writes_by_source_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.writes_by_source(_points(spark, sf_dir), as_of())


WRITES = f"with {MEMORIES}, {POINTS} select coalesce(source, '(unknown)') as source, count(*) as n from points where {_AT} >= {_NOW} - {_DAY} group by 1"


def flood_tripwire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.floods(_points(spark, sf_dir), as_of())


def gate_mix_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gate_mix(_points(spark, sf_dir), as_of())


GATE_MIX = f"with {MEMORIES}, {POINTS}, g as (select gate, count(*) as n from points where {_AT} >= {_NOW} - {_DAY} and gate is not null group by gate) select gate, sum(n)::BIGINT as n from (select * from g union all select unnest(['skipped', 'bypassed']), 0) group by gate"


def prediction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prediction_status(memories(spark, sf_dir), F.lit("2024-05-20").cast("date"))


PREDICTION_STATUS = f"with {MEMORIES}, p as (select case when coalesce(status, 'open') = 'open' then case when regexp_matches(coalesce(expires_on, ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') and try_cast(expires_on as date) < date '2024-05-20' then 'expired_open' else 'open' end else status end as status, 1 as n from memories where claim_type = 'prediction') select status, sum(n)::BIGINT as n from (select * from p union all select unnest(['open', 'expired_open', 'hit', 'miss']), 0) group by status"


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "concat(date_format(ts, 'yyyy-MM-dd'), 'T', date_format(ts, 'HH:mm:ss'), 'Z')"
    json = f"concat('{{\"ts\": \"', {at}, '\", \"outcome\": \"', event_type, '\", \"backend\": \"', case when user_id % 3 = 0 then '' else concat('b', user_id % 4) end, '\"}}')"
    return read(spark, sf_dir, "events").selectExpr(f"case event_id % 5 when 0 then concat({at}, ' ', event_type, ' x') when 1 then '' when 2 then concat('{{', event_id) when 3 then concat('{{\"outcome\": \"', event_type, '\"}}') else {json} end as value".replace("{{", "{").replace("}}", "}"))


def gate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gate_log_stats(M.parse_gate_log(_log_lines(spark, sf_dir)), F.lit("2024-01-20T00:00:00Z").cast("timestamp"))


GATE_LOG = """with l as (select event_id % 5 as k, case when event_id % 5 in (0, 4) then date_trunc('second', ts) end as at_, case when event_id % 5 in (0, 3, 4) then event_type end as outcome, case when event_id % 5 = 4 and user_id % 3 <> 0 then 'b' || (user_id % 4) end as backend from events where event_id % 5 <> 1),
w as (select *, outcome is not null and coalesce(at_ >= timestamp '2024-01-20 00:00:00' - interval 24 hours, true) as inside from l)
select what, name, count(*) as n from (select 'lines' as what, 'seen' as name from w union all select 'lines', 'in_window' from w where inside union all select 'lines', 'unreadable' from w where outcome is null union all select 'outcome', outcome from w where inside union all select 'backend', backend from w where inside and backend is not null) group by what, name"""


def backend_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of exposition text for each backend of the log."""
    counts = M.parse_gate_log(_log_lines(spark, sf_dir)).filter("backend is not null").groupBy("backend").agg(F.count("*").alias("n"))
    return M.metrics("gate", counts, "gate_calls_total", "backend", kind="counter")


BACKEND_COUNTERS = "with b as (select 'b' || (user_id % 4) as backend, count(*) as n from events where event_id % 5 = 4 and user_id % 3 <> 0 group by 1) select 'gate' as job, 'gate_calls_total' as name, 'counter' as type, backend as label, n::DOUBLE as value, 'gate_calls_total{backend=\"' || backend || '\"} ' || n as line from b"


def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; each should equal the next but one."""
    d = read(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    manifest = d.select(F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("repo_path"), F.concat(F.lit("f/"), (F.col("doc_id") + F.col("doc_id") % 3).cast("string")).alias("target_path"))
    return M.manifest_drift(manifest, files)


MANIFEST_DRIFT = "with f as (select 'f/' || doc_id as path, sha256(text) as h from documents) select r as repo_path, t as target_path, case when b.h is null then 'missing' else 'differs' end as state from (select 'f/' || doc_id as r, 'f/' || (doc_id + doc_id % 3) as t from documents) left join f a on a.path = r left join f b on b.path = t where b.h is null or a.h is distinct from b.h"


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, distinct namespaces, and the tokens they hold."""
    from mnemospark.functions.text import estimated_tokens

    return memories(spark, sf_dir).agg(F.count("*").alias("points"), F.count_distinct("namespace").alias("namespaces"), F.sum(estimated_tokens(F.col("content"))).alias("tokens"))


STORE_COUNTS = f"with {MEMORIES} select count(*) as points, count(distinct namespace) as namespaces, sum(greatest(1, length(content) // 4))::BIGINT as tokens from memories"


def subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy(F.coalesce("raw_subject", F.lit("(none)")).alias("subject")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "subject")


SUBJECT_COUNTS = f"with {MEMORIES} select coalesce(raw_subject, '(none)') as subject, count(*) as n from memories group by 1 order by n desc, subject"

def backend_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: what was loaded and what has answered, and the backend that this leads to, under both policies."""
    e = read(spark, sf_dir, "events").selectExpr(
        "element_at(array('gate', 'judge'), cast(event_id % 2 as int) + 1) as policy", "event_id % 11 <> 0 as configured", "element_at(array(array('m', 'x'), array('x'), array(), null), cast(user_id % 4 as int) + 1) as models",
        "element_at(array('verdict', 'unclear', 'failed'), cast(event_id % 3 as int) + 1) as primary", "element_at(array('absent', 'verdict', 'unclear', 'failed'), cast(event_id % 5 % 4 as int) + 1) as fallback",
    )
    tried = e.withColumn("loaded", routing.loaded_state(F.col("models").cast("array<string>"), F.lit("m"))).drop("models")
    return routing.routed(tried).groupBy("policy", "configured", "loaded", "primary", "fallback", "backend").agg(F.count("*").alias("n"))


BACKEND_ROUTING = """with a as (select case when event_id % 2 = 0 then 'gate' else 'judge' end as policy, event_id % 11 <> 0 as configured, case user_id % 4 when 0 then 'ours' when 1 then 'others' else 'nothing' end as loaded,
  ['verdict', 'unclear', 'failed'][event_id % 3 + 1] as "primary", ['absent', 'verdict', 'unclear', 'failed'][event_id % 5 % 4 + 1] as fallback from events),
b as (select *, loaded = 'ours' or (policy = 'judge' and loaded = 'nothing') as called from a)
select policy, configured, loaded, "primary", fallback, case when not configured then 'skipped' when called and "primary" = 'verdict' then 'primary' when called and "primary" = 'unclear' then 'skipped' when fallback = 'verdict' then 'fallback' else 'skipped' end as backend, count(*) as n from b group by all"""

QUERIES = {f.__name__: f for f in (writes_by_source_24h, flood_tripwire, gate_mix_24h, prediction_status, gate_log, backend_counters, manifest_drift, store_counts, subject_counts, backend_routing)}
SQL = {"writes_by_source_24h": WRITES, "flood_tripwire": f"select * from ({WRITES}) where n > {M.FLOOD}", "gate_mix_24h": GATE_MIX, "prediction_status": PREDICTION_STATUS, "gate_log": GATE_LOG, "backend_counters": BACKEND_COUNTERS, "manifest_drift": MANIFEST_DRIFT, "store_counts": STORE_COUNTS, "subject_counts": SUBJECT_COUNTS, "backend_routing": BACKEND_ROUTING}
