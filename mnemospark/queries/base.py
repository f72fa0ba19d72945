"""The tables the operators run on, derived from the driver's tables by fixed rules, in Spark and in SQL.

``documents`` stand in for stored memories, ``embeddings`` for their vectors, ``events`` for the logs, ``benchmark`` for
queries and probes, ``conversations`` for transcripts.  What the tables lack (subjects, times, lineage) follows from the
document's number, so that both sides derive the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.vectors import doubles
from mnemospark.storage import spread


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents")).selectExpr(
        "cast(doc_id as string) as id",
        "text as content",
        "case when doc_id % 5 = 0 then 'fleet' else concat('fleet:', lang) end as namespace",
        "case when doc_id % 50 <> 13 then concat(date_format(date_add(date'2024-01-01', cast((doc_id * 37) % 200 as int)), 'yyyy-MM-dd'), 'T', lpad(cast((doc_id * 5) % 24 as string), 2, '0'), ':00:00Z') end as created_at",
        "source",
        "case when doc_id % 17 = 3 then 'User' when doc_id % 9 = 4 then null else concat('Topic ', doc_id % 40) end as raw_subject",
        "case when doc_id % 3 = 0 then concat('measured in run ', doc_id) when doc_id % 3 = 1 then '  ' end as why",
        "case when doc_id % 30 = 5 then 'opinion' else element_at(array('decision', 'lesson', 'Fact', 'preference', 'prediction', null), cast(doc_id % 6 as int) + 1) end as claim_type",
        "case when doc_id % 10 = 4 then 'hit' when doc_id % 10 = 8 then 'miss' end as status",
        "case when doc_id % 6 = 4 then case when doc_id % 12 = 4 then concat('2024-0', doc_id % 9 + 1, '-15') else '2024-1-2' end end as expires_on",
        "case when doc_id % 8 = 4 then 'look at the dashboard' end as verify_hint",
        "element_at(array('passed', 'bypassed', 'skipped', null), cast(doc_id % 4 as int) + 1) as gate",
        "case when doc_id % 13 = 0 then null else doc_id % 11 <> 0 end as current",
        "case when doc_id % 11 = 0 then cast(case when doc_id % 22 = 0 then doc_id + 11 else doc_id + 1 end as string) end as superseded_by",
    )


MEMORIES = """
memories as (select cast(doc_id as varchar) as id, text as content,
  case when doc_id % 5 = 0 then 'fleet' else 'fleet:' || lang end as namespace,
  case when doc_id % 50 <> 13 then strftime(date '2024-01-01' + cast((doc_id * 37) % 200 as int), '%Y-%m-%d') || 'T' || lpad(cast((doc_id * 5) % 24 as varchar), 2, '0') || ':00:00Z' end as created_at,
  source, case when doc_id % 17 = 3 then 'User' when doc_id % 9 = 4 then null else 'Topic ' || (doc_id % 40) end as raw_subject,
  case when doc_id % 3 = 0 then 'measured in run ' || doc_id when doc_id % 3 = 1 then '  ' end as why,
  case when doc_id % 30 = 5 then 'opinion' else (['decision', 'lesson', 'Fact', 'preference', 'prediction', null])[doc_id % 6 + 1] end as claim_type,
  case when doc_id % 10 = 4 then 'hit' when doc_id % 10 = 8 then 'miss' end as status,
  case when doc_id % 6 = 4 then case when doc_id % 12 = 4 then '2024-0' || (doc_id % 9 + 1) || '-15' else '2024-1-2' end end as expires_on,
  case when doc_id % 8 = 4 then 'look at the dashboard' end as verify_hint,
  (['passed', 'bypassed', 'skipped', null])[doc_id % 4 + 1] as gate,
  case when doc_id % 13 = 0 then null else doc_id % 11 <> 0 end as current,
  case when doc_id % 11 = 0 then cast(case when doc_id % 22 = 0 then doc_id + 11 else doc_id + 1 end as varchar) end as superseded_by
  from documents)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vector, label)``."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), doubles(F.col("embedding")).alias("vector"), F.col("label").cast("string").alias("label"))


VECTORS = "vectors as (select cast(vec_id as varchar) as id, cast(embedding as double[]) as vector, cast(label as varchar) as label from embeddings)"


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(alias, canonical)``: a small lookup made of the nations."""
    return read(spark, sf_dir, "nation").selectExpr("concat('Topic ', n_nationkey) as alias", "concat('theme-', n_regionkey) as canonical")


ALIASES = "aliases as (select 'Topic ' || n_nationkey as alias, 'theme-' || n_regionkey as canonical from nation)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, query, project)``."""
    return read(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "concat(text, case when item_id % 3 = 0 then concat(' CT-', item_id, ' v', item_id % 7, '.2') else '' end) as query", "element_at(array('en', 'fr', 'de', 'es', null), cast(item_id % 5 as int) + 1) as project")


QUESTIONS = "questions as (select item_id as query_id, text || case when item_id % 3 = 0 then ' CT-' || item_id || ' v' || (item_id % 7) || '.2' else '' end as query, (['en', 'fr', 'de', 'es', null])[item_id % 5 + 1] as project from benchmark)"


def slug_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def skeleton_sql(c: str) -> str:
    return strip_sql(f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\\d+', '#', 'g'), '\\s+', ' ', 'g')")
