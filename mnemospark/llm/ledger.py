"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text.  The ledger holds the (blob, rule version)
pairs that were scanned and what was found.  A run hashes all versions, takes the pairs that the ledger lacks, scans one
copy of each such blob, appends to the ledger, and joins the findings back to all paths.

Spans come from splitting the text at the matches: the lengths of the pieces and of the matches, summed, are the
positions.  Only kinds whose pattern occurs at all are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.storage import materialise

#: The base kinds in their listed order, each with its pattern and what a match needs to count.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
#: The same two with the length inside: what is too short can't hide a longer match, so the result is equal and faster.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
BASE = (("assign", ASSIGN, 8), ("access", ACCESS_LONG, 0), ("hex", HEX_LONG, 0))
#: Kinds that the method adds: key blocks, and tokens of code hosts, chat services and signed claims.
ADDED = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("claims", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
)
#: Goes into the ledger's key; changes with any rule.
RULES_VERSION = 1

_SPAN = "array<struct<start:bigint,kind:int,stop:bigint,name:string>>"


def spans_of(text: Column, kind: int, name: str, pattern: str, least: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches whose group 1, if any, has ``least`` characters."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else found
    each = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), tokens.alias("token"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), F.lit(name).alias("name"))
        return F.struct(stop.cast("long").alias("at"), F.when(F.length(x["token"]) >= least, F.concat(acc["out"], F.array(span).cast(_SPAN))).otherwise(acc["out"]).alias("out"))

    walk = F.aggregate(each, empty, step)["out"]
    return F.when(F.regexp(text, F.lit(pattern)), walk).otherwise(F.array().cast(_SPAN))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then by kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def versions(docs: DataFrame) -> DataFrame:
    """Every row as a version: ``(doc_id, text, blob)``; a null text is the empty one."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return t.withColumn("blob", F.sha2("text", 256))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """``(blob, rule_version, spans)`` for ``(blob, text)``."""
    rules = [*BASE, *ADDED]
    parts = [spans_of(F.col("text"), i, *rule) for i, rule in enumerate(rules)]
    return blobs.select("blob", F.lit(RULES_VERSION).alias("rule_version"), F.concat(*parts).alias("spans"))


def empty_ledger(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], f"blob string, rule_version int, spans {_SPAN}")


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every version, and the grown ledger.

    The first frame is ``(doc_id, blob, spans)`` with a row for every row of ``docs``, whether its blob was scanned now
    or earlier.  Null texts are empty texts; repeated rows are repeated; a null doc_id is carried through; an empty
    table gives no rows; further columns are ignored.
    """
    known = empty_ledger(docs) if ledger is None else ledger.filter(F.col("rule_version") == RULES_VERSION)
    all_versions = versions(docs)
    paths = materialise(all_versions.select("doc_id", "blob"), "paths")
    fresh = paths.groupBy("blob").agg(F.min("doc_id").alias("chosen")).join(known.select("blob"), "blob", "left_anti")
    # One path is scanned for each unseen blob.  The texts move once, unsorted, to meet the small side.
    one = fresh.withColumnsRenamed({"blob": "b"}).hint("shuffle_hash")
    texts = all_versions.join(one, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("chosen")), "inner").select("blob", "text")
    found = materialise(scan_blobs(texts), "findings").dropDuplicates(["blob"])
    grown = known.unionByName(found)
    hits = grown.filter(F.size("spans") > 0).select("blob", "spans")
    back = paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))
    return back, grown


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``(doc_id, blob, spans)``."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, (name, _, _) in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "blob",
    )


def _sql_kind(kind: int, name: str, pattern: str, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  select r, ({kind})::INT as kind, '{name}' as name, start, start + len(hits[i]) as stop from (
    select r, hits, tokens, i, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) as start
    from (select *, unnest(range(1, len(hits) + 1)) as i from (
      select r, regexp_extract_all(text, '{p}') as hits, regexp_extract_all(text, '{p}', {1 if least else 0}) as tokens,
        string_split_regex(text, '{p}') as gaps from d where regexp_matches(text, '{p}'))))
  where len(tokens[i]) >= {least}"""


_AT = "name || ':' || start::BIGINT || ':' || stop::BIGINT"
SECRETS_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
spans as ({" union all ".join(_sql_kind(i, *rule) for i, rule in enumerate([*BASE, *ADDED]))}),
by_row as (select r, {", ".join(f"count(*) filter (where kind = {i}) as n_{name}" for i, (name, _, _) in enumerate(BASE))},
  string_agg({_AT}, ',' order by start, kind) filter (where kind < {len(BASE)}) as base, string_agg({_AT}, ',' order by start, kind) as spans from spans group by r)
select doc_id, {", ".join(f"coalesce(n_{name}, 0)::BIGINT as n_{name}" for name, _, _ in BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(text) as blob
from d left join by_row using (r)
"""
