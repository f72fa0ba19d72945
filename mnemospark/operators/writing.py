"""The write path: what becomes of a candidate memory, as one projection, and the sinks that store it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.parsing import iso_date
from mnemospark.functions.secrets import secret_flags
from mnemospark.functions.text import filled, slugify, strip
from mnemospark.functions.vagueness import vagueness_flags
from mnemospark.storage import broadcast_within

#: Claim types, those that need a reason, and subjects that name nothing.
CLAIM_TYPES = ("decision", "lesson", "fact", "preference", "prediction")
NEEDS_WHY = ("decision", "lesson")
VAGUE_SUBJECTS = ("user", "system", "me", "myself", "assistant", "session", "unknown", "none")
#: The namespace of everything that belongs to no project.
GLOBAL = "fleet"
#: Aliases that may be broadcast.
MAX_ALIASES = 100_000


def namespace_of(project: Column) -> Column:
    return F.when(F.coalesce(project, F.lit("")) != "", F.concat(F.lit(f"{GLOBAL}:"), slugify(project))).otherwise(GLOBAL)


def canonicalize(df: DataFrame, aliases: DataFrame, subject: str = "subject") -> DataFrame:
    """``df`` with ``canonical`` and ``raw``: by the subject in lower case, else by its slug.

    ``aliases`` is ``(alias, canonical)``; the slug of an alias leads to the same, unless it is an alias itself.  The raw
    subject is kept only where the canonical one differs from it in lower case; otherwise the subject stays as it is.
    """
    keys = aliases.select(F.lower(strip(F.col("alias"))).alias("k"), "canonical", F.lit(0).alias("turn"))
    keys = keys.unionByName(aliases.select(slugify(F.col("alias")).alias("k"), "canonical", F.lit(1).alias("turn")))
    keys = keys.groupBy("k").agg(F.min_by("canonical", F.struct("turn", "canonical")).alias("to"))
    by_name, by_slug = (broadcast_within(keys.select(F.col("k").alias(f"{x}_k"), F.col("to").alias(f"{x}_to")), MAX_ALIASES) for x in ("name", "slug"))
    lower = F.lower(strip(F.col(subject)))
    out = df.join(by_name, lower == F.col("name_k"), "left").join(by_slug, slugify(F.col(subject)) == F.col("slug_k"), "left")
    found = F.coalesce("name_to", "slug_to")
    changed = found.isNotNull() & (found != lower)
    return out.select(*df.columns, F.when(changed, found).otherwise(F.col(subject)).alias("canonical"), F.when(changed, F.col(subject)).alias("raw"))


def no_authority(content: Column) -> Column:
    """The default authority check: it is not available and raises no flag."""
    return F.array().cast("array<string>")


def write_decisions(candidates: DataFrame, aliases: DataFrame, authority: Callable[[Column], Column] = no_authority) -> DataFrame:
    """``candidates`` with ``error`` (null: stored), ``flags``, ``gate``, ``stored_content`` and the stored metadata.

    Needed columns: content, subject, project, agent, claim_type, why, self_checked, expires_on, verify_hint, status,
    gate_verdict (``store``, ``reject`` or null).  The first gate that fails decides: secrets in content or why, vague
    wording unless checked, vague subject, unknown type, missing why, incomplete prediction, a conflict that the authority
    check flags, the quality gate unless checked.
    """
    c = canonicalize(candidates, aliases)
    blank = F.lit("")
    why = strip(F.coalesce("why", blank))
    kind = F.lower(strip(F.coalesce(filled(F.col("claim_type")), F.lit("fact"))))
    c = c.withColumn("secret", F.array_distinct(F.concat(secret_flags(F.col("content")), secret_flags(F.col("why")))))
    c = c.withColumn("vague", vagueness_flags(F.col("content"), F.col("subject"))).withColumn("kind", kind).withColumn("reason", why)
    c = c.withColumn("conflicts", authority(F.col("content")))
    checked = F.coalesce("self_checked", F.lit(False))
    name = F.lower(strip(F.coalesce(filled(F.col("canonical")), F.col("subject"), blank)))
    incomplete = (F.col("kind") == "prediction") & (iso_date(strip(F.col("expires_on"))).isNull() | (strip(F.coalesce("verify_hint", blank)) == ""))
    error = (
        F.when(F.size("secret") > 0, "MEMORY_CONTAINS_SECRET")
        .when((F.size("vague") > 0) & ~checked, "MEMORY_NEEDS_SELF_CHECK")
        .when(name.isin(*VAGUE_SUBJECTS), "MEMORY_VAGUE_SUBJECT")
        .when(~F.col("kind").isin(*CLAIM_TYPES), "MEMORY_INVALID_TYPE")
        .when(F.col("kind").isin(*NEEDS_WHY) & (F.col("reason") == ""), "MEMORY_NEEDS_WHY")
        .when(incomplete, "MEMORY_PREDICTION_NEEDS_FIELDS")
        .when(F.size("conflicts") > 0, "MEMORY_AUTHORITY_CONFLICT")
        .when((F.coalesce("gate_verdict", blank) == "reject") & ~checked, "MEMORY_FAILS_WRITE_CONTRACT")
    )
    gate = F.when(F.col("gate_verdict") == "reject", "bypassed").when(F.col("gate_verdict") == "store", "passed").otherwise("skipped")
    content = F.coalesce("content", blank)
    composed = F.when((F.col("reason") != "") & ~F.contains(F.lower(content), F.lit("why:")), F.concat(F.regexp_replace(content, r"(?U)\s+$", ""), F.lit("\n\nWhy: "), F.col("reason"))).otherwise(content)
    stored = F.col("error").isNull()
    out = c.withColumn("error", error)
    return out.select(
        *candidates.columns, "error", F.when(F.col("error") == "MEMORY_CONTAINS_SECRET", F.col("secret")).when(F.col("error") == "MEMORY_NEEDS_SELF_CHECK", F.col("vague")).when(F.col("error") == "MEMORY_AUTHORITY_CONFLICT", F.col("conflicts")).alias("flags"),
        F.when(stored, namespace_of(F.col("project"))).alias("namespace"), F.when(stored, gate).alias("gate"), F.when(stored, composed).alias("stored_content"), F.when(stored, F.col("kind")).alias("stored_type"),
        F.when(stored, filled(F.col("reason"))).alias("stored_why"), F.when(stored & (F.col("kind") == "prediction"), F.coalesce("status", F.lit("open"))).otherwise(F.when(stored, F.col("status"))).alias("stored_status"),
        F.when(stored, F.col("canonical")).alias("stored_subject"), F.when(stored, F.col("raw")).alias("stored_raw_subject"),
    )


def metadata(caller: Column, own: Column, defaults: Column) -> Column:
    """Maps overlaid: own fields win over the caller's, the caller's over defaults."""
    free = lambda m, taken: F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(taken), k))
    caller = F.coalesce(caller, F.create_map().cast("map<string,string>"))
    rest = free(caller, own)
    return F.map_concat(free(free(defaults, own), rest), rest, own)


#: Payload fields that aren't metadata of a hit.
RESERVED = ("data", "memory", "hash", "user_id", "created_at", "updated_at", "text_lemmatized")


def hit_metadata(payload: Column) -> Column:
    return F.map_filter(payload, lambda k, v: ~k.isin(*RESERVED))


def merge_update(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the updates' fields put in, row by row; other fields and rows stay.

    ``updates`` has the key and, for each field, a struct ``{value}`` that is null where the field isn't updated: a null
    value inside is a legal new value.
    """
    # One column a side, so that no name of one side meets a name of the other.
    old, new = table.select(F.struct(*table.columns).alias("old")), updates.select(F.struct(*updates.columns).alias("new"))
    out = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "left")
    value = lambda c: F.when(F.col(f"new.{c}").isNotNull(), F.col(f"new.{c}.value")).otherwise(F.col(f"old.{c}"))
    return out.select(*[(value(c) if c != key and c in updates.columns else F.col(f"old.{c}")).alias(c) for c in table.columns])


def mirror_upsert(index: DataFrame, log: DataFrame) -> DataFrame:
    """The keyword index after a log of writes ``(seq, id, namespace, text)``: the last write of an id wins; writes without id or text do nothing."""
    ok = log.filter("id is not null and id <> '' and text is not null and text <> ''")
    both = index.withColumn("seq", F.lit(-1).cast("long")).unionByName(ok.select("seq", *index.columns))
    w = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return both.withColumn("turn", F.row_number().over(w)).filter("turn = 1").select(*index.columns)
