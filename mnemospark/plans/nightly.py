"""The nightly plan: namespaces, subjects, lineage, near-duplicates, in this order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import reconcile as R
from mnemospark.operators.writing import merge_update
from mnemospark.storage import materialise


def _values(df: DataFrame) -> DataFrame:
    return df.select("id", *[F.struct(F.col(c).alias("value")).alias(c) for c in df.columns if c != "id"])


def nightly(records: DataFrame, aliases: DataFrame, extract: Callable[[Column], Column], since: str | None = None, threshold: float = R.THRESHOLD, max_group: int = R.MAX_GROUP, protect_dedup: bool = False) -> DataFrame:
    """The store after a night.  ``records`` has the columns of the memories table, vectors included.

    Lineage is always recomputed in full and may revive what an earlier night collapsed; ``protect_dedup`` keeps
    collapsed records out of it.  Near-duplicates are looked for in groups with a record newer than ``since``.
    """
    now = materialise(records.withColumn("namespace", R.normal_namespace(F.col("namespace"))), "healed")
    now = materialise(merge_update(now, _values(R.subject_backfill(now, aliases, extract))), "subjects")
    own = now.filter(~F.coalesce("dedup_collapsed", F.lit(False))) if protect_dedup else now
    lines = R.supersede(own.withColumn("ordinal", F.xxhash64("id"))).drop("created_at")
    now = materialise(merge_update(now, _values(lines)), "lineage")
    found = R.dedup(now, threshold, max_group, since)
    return merge_update(now, R.dedup_updates(found))
