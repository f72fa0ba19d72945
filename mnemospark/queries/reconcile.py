"""Queries of the write path and of reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import reconcile as R
from mnemospark.operators import writing as W
from mnemospark.operators.components import connected_components
from mnemospark.plans.increments import DuplicateGroups
from mnemospark.queries.base import ALIASES, MEMORIES, VECTORS, aliases, memories, read, skeleton_sql, slug_sql, strip_sql, vectors
from mnemospark.queries.scalars import SECRET_FLAGS, VAGUENESS
from mnemospark.storage import shared_dir

#: The tables' vectors have no pair at the default similarity and larger groups than the default cap: groups of any size are compared.
SIMILARITY, GROUP = 0.30, None
KINDS = "(" + ", ".join(f"'{k}'" for k in W.CLAIM_TYPES) + ")"


def alias_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.canonicalize(memories(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.upper("raw_subject")).otherwise(F.replace("raw_subject", F.lit(" "), F.lit("_"))).alias("subject")), aliases(spark, sf_dir))


_KEYS = f"keys as (select k, arg_min(canonical, turn) as dest from (select lower(alias) as k, canonical, 0 as turn from aliases union all select {slug_sql('alias')}, canonical, 1 from aliases) group by k)"


def canonical_sql(source: str, subject: str, name: str) -> str:
    """CTE ``name``: the source with canonical and raw."""
    return f"""{name} as (select s.*, case when coalesce(a.dest, b.dest) <> lower({strip_sql(subject)}) then coalesce(a.dest, b.dest) else {subject} end as canonical, case when coalesce(a.dest, b.dest) <> lower({strip_sql(subject)}) then {subject} end as raw
  from {source} s left join keys a on a.k = lower({strip_sql(subject)}) left join keys b on b.k = {slug_sql(subject)})"""


ALIAS_CANONICALIZE = f"with {MEMORIES}, {ALIASES}, {_KEYS}, s as (select id, case when id::BIGINT % 2 = 0 then upper(raw_subject) else replace(raw_subject, ' ', '_') end as subject from memories), {canonical_sql('s', 'subject', 'c')} select * from c"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id").cast("long")
    return memories(spark, sf_dir).select(
        "id", "content", F.when(n % 4 > 0, F.col("raw_subject")).alias("subject"), F.element_at(F.array(F.lit("My Project"), F.lit(""), F.lit(None)), (n % 3 + 1).cast("int")).alias("project"), F.col("source").alias("agent"),
        "claim_type", "why", (n % 5 > 0).alias("self_checked"), "expires_on", "verify_hint", "status", F.element_at(F.array(F.lit("store"), F.lit("reject"), F.lit(None)), (n % 7 % 3 + 1).cast("int")).alias("gate_verdict"),
    )


def write_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a candidate."""
    out = W.write_decisions(_candidates(spark, sf_dir), aliases(spark, sf_dir))
    return out.select("id", "error", F.array_join("flags", "; ").alias("flags"), "namespace", "gate", F.md5("stored_content").alias("content_md5"), "stored_type", "stored_why", "stored_status", "stored_subject", "stored_raw_subject")


_CAND = "cand as (select *, id::BIGINT as n, case when id::BIGINT % 4 > 0 then raw_subject end as subject, (['My Project', '', null])[id::BIGINT % 3 + 1] as project, id::BIGINT % 5 > 0 as self_checked, (['store', 'reject', null])[id::BIGINT % 7 % 3 + 1] as gate_verdict from memories)"
_VAGUE = VAGUENESS.replace("select id, content, raw_subject from memories", "select id, content, case when id::BIGINT % 4 > 0 then raw_subject end as raw_subject from memories")
_TRIMMED = "regexp_replace(content, '\\s+$', '')"
WRITE_CONTRACT = f"""with {MEMORIES}, {ALIASES}, {_KEYS}, {_CAND}, {canonical_sql('cand', 'subject', 'cc')}, sec as ({SECRET_FLAGS}), vag as ({_VAGUE}),
k as (select cc.*, sec.flags as secret, vag.flags as vague, lower({strip_sql("coalesce(claim_type, 'fact')")}) as kind, {strip_sql("coalesce(why, '')")} as reason from cc join sec using (id) join vag using (id)),
e as (select *, case when secret <> '' then 'MEMORY_CONTAINS_SECRET' when vague <> '' and not self_checked then 'MEMORY_NEEDS_SELF_CHECK' when lower(coalesce(canonical, '')) in ({", ".join(f"'{s}'" for s in W.VAGUE_SUBJECTS)}) then 'MEMORY_VAGUE_SUBJECT'
  when kind not in {KINDS} then 'MEMORY_INVALID_TYPE' when kind in ('decision', 'lesson') and reason = '' then 'MEMORY_NEEDS_WHY'
  when kind = 'prediction' and (case when regexp_matches(coalesce(expires_on, ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_cast(expires_on as date) end is null or coalesce(verify_hint, '') = '') then 'MEMORY_PREDICTION_NEEDS_FIELDS'
  when gate_verdict = 'reject' and not self_checked then 'MEMORY_FAILS_WRITE_CONTRACT' end as error from k)
select id, error, case when error = 'MEMORY_CONTAINS_SECRET' then secret when error = 'MEMORY_NEEDS_SELF_CHECK' then vague end as flags,
  case when error is null then case when coalesce(project, '') <> '' then 'fleet:' || {slug_sql("project")} else 'fleet' end end as namespace,
  case when error is null then case when gate_verdict = 'reject' then 'bypassed' when gate_verdict = 'store' then 'passed' else 'skipped' end end as gate,
  case when error is null then md5(case when reason <> '' and not contains(lower(content), 'why:') then {_TRIMMED} || chr(10) || chr(10) || 'Why: ' || reason else content end) end as content_md5,
  case when error is null then kind end as stored_type, case when error is null then nullif(reason, '') end as stored_why,
  case when error is null then case when kind = 'prediction' then coalesce(status, 'open') else status end end as stored_status,
  case when error is null then canonical end as stored_subject, case when error is null then raw end as stored_raw_subject from e"""


def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller's metadata under the server's fields, and the metadata of a hit."""
    m = memories(spark, sf_dir)
    caller = F.map_filter(F.create_map(F.lit("source"), F.lit("caller"), F.lit("status"), F.col("status"), F.lit("hash"), F.lit("h")), lambda k, v: v.isNotNull())
    both = W.metadata(caller, F.create_map(F.lit("source"), F.col("source"), F.lit("gate"), F.coalesce("gate", F.lit("skipped"))), F.create_map(F.lit("status"), F.lit("open")))
    return m.select("id", W.hit_metadata(both).alias("m")).select("id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("metadata"))


METADATA_OVERLAY = f"with {MEMORIES} select id, 'gate=' || coalesce(gate, 'skipped') || ',source=' || source || ',status=' || coalesce(status, 'open') as metadata from memories"


def payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with flat and with legacy payloads."""
    n = F.col("id").cast("long")
    flat = F.create_map(F.when(n % 3 == 0, "data").when(n % 3 == 1, "memory").otherwise("text"), F.col("content"), F.lit("user_id"), F.col("namespace"), F.lit("subject"), F.when(n % 2 == 0, F.col("raw_subject")).otherwise(""), F.lit("current"), F.col("current").cast("string"))
    inner = F.create_map(F.lit("subject"), F.col("raw_subject"), F.lit("why"), F.col("why"))
    points = memories(spark, sf_dir).select("id", flat.alias("payload"), inner.alias("metadata"))
    return R.flatten_payload(points).select("id", F.md5("content").alias("content_md5"), "namespace", "created_at", "subject", "current", "why", "claim_type")


PAYLOAD_FLATTEN = f"with {MEMORIES} select id, md5(content) as content_md5, namespace, '' as created_at, raw_subject as subject, coalesce(current, true) as current, why, null::VARCHAR as claim_type from memories"


def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of some fields of some memories, nulls among the new values."""
    m = memories(spark, sf_dir)
    n, v = F.col("id").cast("long"), lambda c: F.struct(c.alias("value"))
    u = m.filter(n % 4 < 2).select("id", F.when(n % 4 == 0, v(F.lit(None).cast("string"))).otherwise(v(F.concat(F.lit("x"), F.col("id")))).alias("superseded_by"), F.when(n % 8 == 1, v(F.lit(False))).alias("current"))
    return W.merge_update(m.select("id", "superseded_by", "current", "source"), u)


MERGE_UPDATE = f"with {MEMORIES} select id, case id::BIGINT % 4 when 0 then null when 1 then 'x' || id else superseded_by end as superseded_by, case when id::BIGINT % 8 = 1 then false else current end as current, source from memories"


def mirror_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after events have rewritten rows of it."""
    index = memories(spark, sf_dir).select("id", "namespace", F.col("content").alias("text"))
    log = read(spark, sf_dir, "events").selectExpr("event_id as seq", "cast(user_id as string) as id", "concat('fleet:', event_type) as namespace", "case when event_id % 9 = 0 then '' else props end as text")
    return W.mirror_upsert(index, log).select("id", "namespace", F.md5("text").alias("text_md5"))


MIRROR_UPSERT = f"with {MEMORIES}, b as (select -1 as seq, id, namespace, content as text from memories union all select event_id, cast(user_id as varchar), 'fleet:' || event_type, props from events where event_id % 9 <> 0) select id, namespace, md5(text) as text_md5 from b qualify row_number() over (partition by id order by seq desc) = 1"


def namespace_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = memories(spark, sf_dir).select(F.when(F.col("id") % 3 == 0, F.concat("namespace", F.lit("_"), F.upper("source"))).otherwise(F.col("namespace")).alias("namespace"))
    return R.namespace_moves(messy)


NAMESPACE_HEAL = f"with {MEMORIES}, m as (select case when id::BIGINT % 3 = 0 then namespace || '_' || upper(source) else namespace end as src from memories), d as (select src, case when starts_with(src, 'fleet:') then 'fleet:' || {slug_sql('substr(src, 7)')} else src end as dst from m) select src, dst, count(*) as n from d where src <> dst group by src, dst"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that have a vector; their subject is the vector's label."""
    m = memories(spark, sf_dir).select("id", "content", "created_at", "current", "why", "claim_type").withColumn("supersedes", F.when(F.col("id") % 7 == 0, F.array(F.lit("old"))))
    return m.join(vectors(spark, sf_dir).withColumnRenamed("label", "subject"), "id").withColumn("namespace", F.lit("fleet"))


RECORDS = "records as (select m.id, content, created_at, current, why, claim_type, case when m.id::BIGINT % 7 = 0 then ['old'] end as supersedes, vector, label as subject from memories m join vectors using (id) where coalesce(current, true))"
PAIRS = f"pairs as (select a.id as id_a, b.id as id_b, list_cosine_similarity(a.vector, b.vector) as similarity, a.content as ca, b.content as cb from records a join records b on a.subject = b.subject and a.id < b.id where round(list_cosine_similarity(a.vector, b.vector), 9) >= {SIMILARITY})"


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.dedup(_records(spark, sf_dir), SIMILARITY, GROUP)
    return out["judged"].select("id_a", "id_b", F.round("similarity", 6).alias("similarity"), "verdict")


_SAME = f"({skeleton_sql('ca')} = {skeleton_sql('cb')})"
COSINE_PAIRS = f"with {MEMORIES}, {VECTORS}, {RECORDS}, {PAIRS} select id_a, id_b, round(similarity, 6) as similarity, case when {_SAME} then 'duplicate' else 'distinct' end as verdict from pairs where not ({_SAME} and regexp_extract_all(ca, '\\d+') <> regexp_extract_all(cb, '\\d+'))"

COMPONENTS = """walk(id, node) as (select id, id from nodes union select w.id, e.v from walk w join both_ways e on e.u = w.node),
comp as (select id, min(node) as cluster from walk group by id)"""


def dedup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs taken as duplicates: who goes, and to which head."""
    return R.dedup(_records(spark, sf_dir), SIMILARITY, GROUP, judge=R.always_duplicate)["losers"]


_CLUSTERS = f"""same as (select id_a, id_b from pairs where not ({_SAME} and regexp_extract_all(ca, '\\d+') <> regexp_extract_all(cb, '\\d+'))), both_ways as (select id_a as u, id_b as v from same union all select id_b, id_a from same), nodes as (select distinct u as id from both_ways),
{COMPONENTS}, ranked as (select id, cluster, supersedes, first_value(id) over (partition by cluster order by (case when trim(coalesce(why, '')) <> '' then 2 else 0 end + case when coalesce(claim_type, '') <> '' then 1 else 0 end) desc, length(content) desc, id desc) as head from comp join records using (id))"""
DEDUP_COLLAPSE = f"with recursive {MEMORIES}, {VECTORS}, {RECORDS}, {PAIRS}, {_CLUSTERS} select id, head from ranked where id <> head"


def dedup_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads with what they supersede, after the stage's writes."""
    records = _records(spark, sf_dir)
    out = R.dedup(records, SIMILARITY, GROUP, judge=R.always_duplicate)
    merged = W.merge_update(records.select("id", "current", "supersedes", F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("boolean").alias("dedup_collapsed")), R.dedup_updates(out))
    return merged.filter("supersedes is not null or superseded_by is not null").select("id", "current", F.array_join("supersedes", ",").alias("supersedes"), "superseded_by", "dedup_collapsed")


DEDUP_HEADS = f"""with recursive {MEMORIES}, {VECTORS}, {RECORDS}, {PAIRS}, {_CLUSTERS}, gone as (select head, list(id order by id) as gone from ranked where id <> head group by head),
all_records as (select m.id, current, case when m.id::BIGINT % 7 = 0 then ['old'] end as supersedes from memories m join vectors using (id)),
m as (select r.id, case when k.id <> k.head then false else r.current end as current, case when g.gone is not null then list_concat(list_filter(coalesce(r.supersedes, []), lambda x: true), list_filter(g.gone, lambda x: not list_contains(coalesce(r.supersedes, []), x))) else r.supersedes end as supersedes, case when k.id <> k.head then k.head end as superseded_by, case when k.id <> k.head then true end as dedup_collapsed
  from all_records r left join ranked k using (id) left join gone g on g.head = r.id)
select id, current, array_to_string(supersedes, ',') as supersedes, superseded_by, dedup_collapsed from m where supersedes is not null or superseded_by is not null"""


def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run."""
    return R.dedup(_records(spark, sf_dir), SIMILARITY, GROUP)["report"]


DEDUP_REPORT = f"""with recursive {MEMORIES}, {VECTORS}, {RECORDS}, {PAIRS}, g as (select subject, count(*) as n from records group by subject having count(*) >= 2), j as (select * from pairs where not ({_SAME} and regexp_extract_all(ca, '\\d+') <> regexp_extract_all(cb, '\\d+'))),
same as (select id_a, id_b from j where {_SAME}), both_ways as (select id_a as u, id_b as v from same union all select id_b, id_a from same), nodes as (select distinct u as id from both_ways), {COMPONENTS}
select 'groups' as what, count(*) as n from g union all select 'records', sum(n)::BIGINT from g union all select 'judged', count(*) from j union all select 'quarantined', (select count(*) from pairs) - (select count(*) from j) union all select 'collapsed', count(*) - count(distinct cluster) from comp union all select 'heads', count(distinct cluster) from comp"""


def incremental_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three runs over a third of the records each leave: the same as one run over all."""
    import uuid

    state = DuplicateGroups(spark, f"{shared_dir(spark)}/groups-{uuid.uuid4().hex}", SIMILARITY, GROUP, R.always_duplicate)
    for part in range(3):
        state.add(_records(spark, sf_dir).filter(F.col("id").cast("long") % 3 == part), part)
    return state.losers()


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph in which an order links its customer to one three times as far from the ten before."""
    edges = read(spark, sf_dir, "orders").selectExpr("o_custkey as u", "o_custkey - o_custkey % 10 + o_custkey * 3 % 10 as v")
    return connected_components(edges)


GRAPH_COMPONENTS = """with recursive same as (select distinct o_custkey as id_a, o_custkey - o_custkey % 10 + o_custkey * 3 % 10 as id_b from orders), both_ways as (select id_a as u, id_b as v from same union all select id_b, id_a from same), nodes as (select distinct u as id from both_ways where u <> v),
walk(id, node) as (select id, id from nodes union select w.id, e.v from walk w join both_ways e on e.u = w.node) select id as node, min(node) as component from walk group by id"""


def _lineage(spark: SparkSession, sf_dir: str, since: str | None) -> DataFrame:
    # A topic of each thousand records is a subject, so that groups stay under the cap however large the table is.
    m = memories(spark, sf_dir).withColumn("raw_subject", F.concat("raw_subject", F.lit(" "), F.floor(F.col("id").cast("long") / 1000).cast("string")))
    # Thread judge: every third fact of a subject continues the same claim.
    judge = lambda g: g.select("subject", "id", (F.col("ordinal") % 3).cast("string").alias("thread"))
    return R.supersede(m.select("id", F.col("id").cast("long").alias("ordinal"), F.col("raw_subject").alias("subject"), "created_at"), 2, R.MAX_GROUP, since, judge)


def supersede_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineage(spark, sf_dir, None).select("id", "current", "superseded_by", F.array_join("supersedes", ",").alias("supersedes"), "created_at")


def incremental_dirty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, for subjects with a newer fact only."""
    return _lineage(spark, sf_dir, "2024-07-15T00:00:00Z").select("id", "current", "superseded_by", F.array_join("supersedes", ",").alias("supersedes"), "created_at")


def _lineage_sql(since: str | None) -> str:
    dirty = f"semi join (select distinct {slug_sql('raw_subject')} as subject from parted where created_at > '{since}') using (subject)" if since else ""
    return f"""with {MEMORIES}, parted as (select * replace (raw_subject || ' ' || (id::BIGINT // 1000) as raw_subject) from memories), s as (select * from (select id, id::BIGINT as ordinal, {slug_sql("raw_subject")} as subject, created_at from parted where raw_subject <> '') {dirty}),
j as (select *, count(*) over (partition by subject) as n from s), t as (select *, case when n between 2 and {R.MAX_GROUP} then cast(ordinal % 3 as varchar) else 'id:' || id end as thread from j),
h as (select *, last_value(id) over w as head, row_number() over (partition by subject, thread order by coalesce(created_at, ''), ordinal) as place from t window w as (partition by subject, thread order by coalesce(created_at, ''), ordinal rows between unbounded preceding and unbounded following)),
o as (select head as id, string_agg(id, ',' order by place) as older from h where id <> head group by head)
select h.id, h.id = head as current, case when h.id <> head then head end as superseded_by, coalesce(case when h.id = head then older end, '') as supersedes, created_at from h left join o using (id)"""


def lineage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.history(_lineage(spark, sf_dir, None)).select("head", F.col("place").cast("long").alias("place"), "id")


LINEAGE_HISTORY = f"with l as ({_lineage_sql(None)}) select id as head, unnest(range(len(string_split(supersedes, ',')))) as place, unnest(string_split(supersedes, ',')) as id from l where supersedes <> ''"


def subject_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractor takes the first two words."""
    extract = lambda c: F.array_join(F.slice(F.split(F.lower(F.regexp_replace(c, "[^A-Za-z ]", "")), " "), 1, 2), " ")
    return R.subject_backfill(memories(spark, sf_dir).withColumn("subject", F.col("raw_subject")), aliases(spark, sf_dir), extract)


SUBJECT_BACKFILL = f"with {MEMORIES}, {ALIASES}, {_KEYS}, f as (select id, array_to_string(string_split(lower(regexp_replace(content, '[^A-Za-z ]', '', 'g')), ' ')[1:2], ' ') as found from memories where coalesce(raw_subject, '') = '' and content <> ''), s as (select id, found, {slug_sql('found')} as slug from f where found <> ''), {canonical_sql('s', 'slug', 'c')} select id, canonical as subject, found as raw_subject from c"


def _rebucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).withColumn("subject", F.col("raw_subject"))
    n = F.length("content")
    known = m.select("subject").filter("subject is not null").select(F.regexp_replace(F.lower("subject"), " ", "-").alias("subject")).unionByName(aliases(spark, sf_dir).select(F.col("canonical").alias("subject")))
    classify = lambda c: F.struct(F.element_at(F.array(F.lit("resubject"), F.lit("preference"), F.lit("retire"), F.lit("other")), (n % 4 + 1).cast("int")).alias("action"), F.concat(F.lit("Topic "), (n % 60).cast("string")).alias("subject"))
    return R.rebucket(m, known, classify)


def known_entity_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebucketed(spark, sf_dir)


REBUCKET = f"""with {MEMORIES}, {ALIASES}, known as (select distinct replace(lower(raw_subject), ' ', '-') as entity from memories where raw_subject is not null union select canonical from aliases),
b as (select id, ['resubject', 'preference', 'retire', 'other'][length(content) % 4 + 1] as action, 'topic-' || (length(content) % 60) as subject from memories where lower(raw_subject) = 'user')
select id, case action when 'resubject' then case when entity is not null then 'resubject' else 'retire' end when 'other' then 'error' else action end as action, case when action = 'resubject' and entity is not null then subject end as subject from b left join known on subject = entity"""


def rebucket_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebucketed(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    alias_canonicalize, write_contract, metadata_overlay, payload_flatten, merge_update, mirror_upsert, namespace_heal, cosine_pairs, dedup_collapse, dedup_heads, dedup_report, incremental_groups, graph_components,
    supersede_lineage, incremental_dirty_groups, lineage_history, subject_backfill, known_entity_semi_join, rebucket_actions,
)}
SQL = {
    "alias_canonicalize": ALIAS_CANONICALIZE, "write_contract": WRITE_CONTRACT, "metadata_overlay": METADATA_OVERLAY, "payload_flatten": PAYLOAD_FLATTEN, "merge_update": MERGE_UPDATE, "mirror_upsert": MIRROR_UPSERT,
    "namespace_heal": NAMESPACE_HEAL, "cosine_pairs": COSINE_PAIRS, "dedup_collapse": DEDUP_COLLAPSE, "dedup_heads": DEDUP_HEADS, "dedup_report": DEDUP_REPORT, "incremental_groups": DEDUP_COLLAPSE, "graph_components": GRAPH_COMPONENTS,
    "supersede_lineage": _lineage_sql(None), "incremental_dirty_groups": _lineage_sql("2024-07-15T00:00:00Z"), "lineage_history": LINEAGE_HISTORY, "subject_backfill": SUBJECT_BACKFILL, "known_entity_semi_join": REBUCKET,
    "rebucket_actions": f"select action, count(*) as n from ({REBUCKET}) group by action",
}
