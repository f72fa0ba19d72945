"""Batch reconciliation: near-duplicate collapse, supersession lineage, subjects, namespaces.

Judges, extractors and classifiers are hooks: functions from Column expressions to a Column, with deterministic
defaults, so a model can be put in as a pandas UDF without a change of plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import digit_runs, filled, skeleton, slugify, strip
from mnemospark.functions.vectors import unit
from mnemospark.operators.components import connected_components
from mnemospark.operators.writing import GLOBAL, MAX_ALIASES, canonicalize
from mnemospark.storage import broadcast_within, materialise

#: Least similarity of a candidate pair and largest group that is compared.
THRESHOLD, MAX_GROUP = 0.90, 80
#: Records of a block of a group.
BLOCK = 1024
#: Subjects that re-bucketing never gives.
VAGUE_BUCKETS = ("user", "me", "system", "assistant", "unknown", "none")

Judge = Callable[[Column, Column], Column]


def same_skeleton(a: Column, b: Column) -> Column:
    """The default pair judge: equal but for case, white space and numbers."""
    return F.when(skeleton(a) == skeleton(b), "duplicate").otherwise("distinct")


def always_duplicate(a: Column, b: Column) -> Column:
    return F.lit("duplicate")


# --- records and groups


def flatten_payload(points: DataFrame) -> DataFrame:
    """Records from points ``(id, payload map, metadata map, vector)``: flat fields first, then those of a legacy inner map."""
    flat = lambda k: F.coalesce(filled(F.col("payload")[k]), filled(F.col("metadata")[k]))
    content = F.coalesce(filled(F.col("payload")["data"]), filled(F.col("payload")["memory"]), F.col("payload")["text"], F.lit(""))
    return points.select(
        "id", content.alias("content"), F.coalesce(F.col("payload")["user_id"], F.lit("")).alias("namespace"), F.coalesce(F.col("payload")["created_at"], F.lit("")).alias("created_at"),
        flat("subject").alias("subject"), F.coalesce(flat("current").try_cast("boolean"), F.lit(True)).alias("current"), flat("why").alias("why"), flat("claim_type").alias("claim_type"),
    )


def dirty_groups(records: DataFrame, keys: list[str], since: str | None) -> DataFrame:
    """Records of the groups that have a member created after ``since`` (as strings; a missing time is never recent); whole groups stay."""
    if since is None:
        return records
    dirty = records.filter(F.coalesce("created_at", F.lit("")) > since).select(*keys).distinct()
    return records.join(dirty, keys, "left_semi")


def _within(n: Column, low: int, high: int | None) -> Column:
    return n >= low if high is None else n.between(low, high)


def in_bounds(records: DataFrame, keys: list[str], low: int = 2, high: int | None = MAX_GROUP) -> DataFrame:
    """Records of groups whose size is within the bounds: a grouped count and a join, no group is held together."""
    sizes = records.groupBy(*keys).agg(F.count("*").alias("n")).filter(_within(F.col("n"), low, high)).select(*keys)
    return records.join(sizes, keys, "left_semi")


# --- near-duplicates


def in_question(records: DataFrame) -> DataFrame:
    """Current records with a subject, which is made a slug."""
    return records.filter(F.coalesce("current", F.lit(True)) & (F.coalesce("subject", F.lit("")) != "")).withColumn("subject", slugify(F.col("subject")))


def _near(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of blocks ``(p, q, a, b)`` of one group: the pairs of records near the threshold or above, of which one has the flag."""

    def parts(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        units = block.field("u").flatten().to_numpy(zero_copy_only=False)
        return np.array(block.field("id").to_pylist(), object), block.field("flag").to_numpy(zero_copy_only=False), units.reshape(len(block), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                p, q = (batch.column(c)[k].as_py() for c in (0, 1))
                (ids_a, flags_a, a), (ids_b, flags_b, b) = (parts(batch.column(c)[k].values) for c in (2, 3))
                cosines = a @ b.T
                close = (cosines >= threshold - 1e-6) & (flags_a[:, None] | flags_b[None, :])
                i, j = np.nonzero(np.triu(close, 1) if p == q else close)
                x, y, cosines = ids_a[i], ids_b[j], cosines[i, j]
                first = (x < y).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(first, x, y), pa.string()), pa.array(np.where(first, y, x), pa.string()), pa.array(cosines)], names=["id_a", "id_b", "similarity"])

    return run


def candidate_pairs(records: DataFrame, threshold: float = THRESHOLD, keys: tuple[str, ...] = ("namespace", "subject"), only: str | None = None) -> DataFrame:
    """``(id_a, id_b, similarity)`` with id_a < id_b in the same group; vectors are scaled once, before the join.

    A group is cut into blocks, and each two of its blocks meet in a row of their own, so that groups of any size are
    compared as a whole and by many tasks.  With ``only``, the name of a flag, records are compared with those that have
    the flag.
    """
    flag = F.lit(True) if only is None else F.coalesce(F.col(only), F.lit(False))
    dims, group = F.size("vector"), [*keys, "dims"]
    u = F.coalesce(unit(F.col("vector")), F.array_repeat(F.lit(0.0), dims))
    own = records.filter(dims > 0).select(*keys, "id", dims.alias("dims"), u.alias("u"), flag.alias("flag"))
    parts = own.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cut = own.join(parts, group).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    blocks = materialise(cut.groupBy(*group, "parts", "part").agg(F.collect_list(F.struct("id", "flag", "u")).alias("rows")), "pair-blocks")
    # Block p meets the blocks from p on; block q those up to q.
    a = blocks.select(*group, F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"), F.col("rows").alias("a"))
    b = blocks.select(*group, F.explode(F.sequence(F.lit(0), "part")).alias("p"), F.col("part").alias("q"), F.col("rows").alias("b"))
    met = a.join(b.hint("merge"), [*group, "p", "q"]).select("p", "q", "a", "b")
    pairs = met.mapInArrow(_near(threshold), "id_a string, id_b string, similarity double")
    return pairs.filter("id_a < id_b").filter(F.round("similarity", 9) >= threshold)


def completeness(why: Column, claim_type: Column) -> Column:
    full = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    return F.when(full(why), 2).otherwise(0) + F.when(full(claim_type), 1).otherwise(0)


def clusters(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, cluster)`` for all ids, singletons included; a cluster is named by its smallest id."""
    comp = connected_components(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    return ids.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def choose_heads(members: DataFrame) -> DataFrame:
    """``(cluster, head)``: the most complete, then the longest, then the largest id."""
    rank = F.struct(completeness(F.col("why"), F.col("claim_type")), F.length("content"), F.col("id"))
    return members.groupBy("cluster").agg(F.max_by("id", rank).alias("head"))


def guarded(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with ``alike``, whether their texts are equal but for numbers and case, and ``guarded``, whether they then differ in numbers.

    Pairs meet digests, not texts, so that a record's text doesn't move once for each of its pairs.
    """
    digests = materialise(records.select("id", F.sha1(skeleton(F.col("content"))).alias("form"), F.sha1(F.array_join(digit_runs(F.col("content")), ",")).alias("numbers")), "digests")
    both = pairs
    for x in "ab":
        both = both.join(digests.withColumnsRenamed({"id": f"id_{x}", "form": f"form_{x}", "numbers": f"numbers_{x}"}), f"id_{x}")
    alike = F.col("form_a") == F.col("form_b")
    return both.select(*pairs.columns, alike.alias("alike"), (alike & (F.col("numbers_a") != F.col("numbers_b"))).alias("guarded"))


def judged(both: DataFrame, records: DataFrame, judge: Judge) -> DataFrame:
    """The pairs that aren't guarded, with their verdict; texts meet them only if the judge looks at texts."""
    free = both.filter("not guarded")
    if judge is same_skeleton:
        return free.withColumn("verdict", F.when(F.col("alike"), "duplicate").otherwise("distinct"))
    if judge is always_duplicate:
        return free.withColumn("verdict", judge(F.lit(None), F.lit(None)))
    texts = records.select("id", "content")
    for x in "ab":
        free = free.join(texts.withColumnsRenamed({"id": f"id_{x}", "content": x}), f"id_{x}")
    return free.withColumn("verdict", judge(F.col("a"), F.col("b")))


def dedup(records: DataFrame, threshold: float = THRESHOLD, max_group: int | None = MAX_GROUP, since: str | None = None, judge: Judge = same_skeleton) -> dict[str, DataFrame]:
    """The near-duplicate stage; its outcomes by name.

    ``records``: id, content, namespace, created_at, subject, current, why, claim_type, supersedes, vector.
    ``quarantined``: pairs that differ in numbers only.  ``judged``: the other pairs with their verdict.  ``losers``:
    ``(id, head)``.  ``heads``: ``(id, supersedes)``, what was there before first, then the losers by id.  ``report``:
    ``(what, n)``, totals that were observed while these tables were written, so that nothing runs for them.  Without a
    ``max_group`` groups of any size are compared.
    """
    seen = {what: Observation() for what in ("groups", "pairs", "losers", "heads")}
    rows = F.count("*").alias("n")
    live, keys = in_question(records), ["namespace", "subject"]
    dirty = dirty_groups(live, keys, since)
    sizes = dirty.groupBy(*keys).agg(F.count("*").alias("n")).filter(_within(F.col("n"), 2, max_group))
    sizes = materialise(sizes.observe(seen["groups"], rows, F.coalesce(F.sum("n"), F.lit(0)).alias("records")), "group-sizes")
    grouped = materialise(dirty.join(sizes.select(*keys), keys, "left_semi"), "groups")
    pairs = candidate_pairs(grouped, threshold)
    both = materialise(guarded(pairs, grouped).observe(seen["pairs"], rows, F.count_if("guarded").alias("guarded")), "pairs")
    verdicts = materialise(judged(both, grouped, judge).select("id_a", "id_b", "similarity", "verdict"), "judged")
    same = verdicts.filter("verdict = 'duplicate'").select("id_a", "id_b")
    linked = same.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    members = clusters(linked, same).join(grouped.select("id", "content", "why", "claim_type", "supersedes"), "id")
    members = members.join(choose_heads(members), "cluster")
    members = materialise(members.drop("content"), "members")
    losers = materialise(members.filter("id <> head").select("id", "head").observe(seen["losers"], rows), "losers")
    gone = losers.groupBy("head").agg(F.array_sort(F.collect_list("id")).alias("gone"))
    none = F.array().cast("array<string>")
    heads = members.filter("id = head").join(gone, "head").select("id", F.array_distinct(F.concat(F.coalesce("supersedes", none), "gone")).alias("supersedes"))
    heads = materialise(heads.observe(seen["heads"], rows), "heads")
    groups, pairs_seen = seen["groups"].get, seen["pairs"].get
    totals = {"groups": groups["n"], "records": groups["records"], "judged": pairs_seen["n"] - pairs_seen["guarded"], "quarantined": pairs_seen["guarded"], "collapsed": seen["losers"].get["n"], "heads": seen["heads"].get["n"]}
    report = records.sparkSession.createDataFrame(list(totals.items()), "what string, n long")
    return {"groups": grouped, "quarantined": both.filter("guarded").select("id_a", "id_b", "similarity"), "judged": verdicts, "losers": losers, "heads": heads, "report": report}


def dedup_updates(outcome: dict[str, DataFrame]) -> DataFrame:
    """The stage's writes for ``merge_update``."""
    value = lambda c: F.struct(c.alias("value"))
    off = outcome["losers"].select("id", value(F.lit(False)).alias("current"), value(F.col("head")).alias("superseded_by"), value(F.lit(True)).alias("dedup_collapsed"))
    on = outcome["heads"].select("id", value(F.col("supersedes")).alias("supersedes"))
    return off.unionByName(on, allowMissingColumns=True)


# --- supersession


def skeleton_threads(records: DataFrame) -> DataFrame:
    """The default thread judge: facts of a subject with equal skeletons are one thread.  ``(subject, id, thread)``."""
    return records.select("subject", "id", F.sha1(skeleton(F.col("content"))).alias("thread"))


def lineage(records: DataFrame, threads: DataFrame) -> DataFrame:
    """``(id, current, superseded_by, supersedes, valid_from)`` of every record.

    ``records``: ordinal, id, subject, created_at.  In a thread, by creation time as a string (missing first) and then by
    ordinal, the last is the head; the others point to it.  A record in no thread, or in threads of one, is current.
    """
    own = records.join(threads.select("id", "thread"), "id", "left").withColumn("thread", F.coalesce("thread", F.concat(F.lit("id:"), F.col("id"))))
    order = [F.coalesce("created_at", F.lit("")), F.col("ordinal")]
    part = Window.partitionBy("subject", "thread")
    whole = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = own.withColumn("head", F.last("id").over(whole)).withColumn("place", F.row_number().over(part.orderBy(*order)))
    older = placed.filter("id <> head").groupBy(F.col("head").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("older"))
    out = placed.join(older, "id", "left")
    leads = F.col("id") == F.col("head")
    return out.select("id", leads.alias("current"), F.when(~leads, F.col("head")).alias("superseded_by"), F.coalesce(F.when(leads, F.col("older")), F.array().cast("array<string>")).alias("supersedes"), "created_at")


def supersede(records: DataFrame, min_group: int = 2, max_group: int = MAX_GROUP, since: str | None = None, judge: Callable[[DataFrame], DataFrame] = skeleton_threads) -> DataFrame:
    """The lineage of all records with a subject, grouped by subject across namespaces.

    Groups under ``min_group`` or over ``max_group`` aren't judged: each record is current.  With ``since`` only groups
    with a newer record are written.
    """
    named = records.filter(F.coalesce("subject", F.lit("")) != "").withColumn("subject", slugify(F.col("subject")))
    named = dirty_groups(named, ["subject"], since)
    return lineage(named, judge(in_bounds(named, ["subject"], min_group, max_group)))


def history(records: DataFrame) -> DataFrame:
    """``(head, place, id)``: the superseded records of each head in order."""
    return records.filter(F.size("supersedes") > 0).select(F.col("id").alias("head"), F.posexplode("supersedes").alias("place", "id"))


# --- subjects and namespaces


def subject_backfill(records: DataFrame, aliases: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """``(id, subject, raw_subject)`` for records without a subject and with a text, where the extractor finds one."""
    todo = records.filter((F.coalesce("subject", F.lit("")) == "") & (F.coalesce("content", F.lit("")) != "")).select("id", extract(F.col("content")).alias("found"))
    todo = todo.filter(F.coalesce("found", F.lit("")) != "").withColumn("slug", slugify(F.col("found")))
    return canonicalize(todo, aliases, "slug").select("id", F.col("canonical").alias("subject"), F.col("found").alias("raw_subject"))


def rebucket(records: DataFrame, known: DataFrame, classify: Callable[[Column], Column]) -> DataFrame:
    """``(id, action, subject)`` for the records of the catch-all subject ``user``.

    The classifier gives a struct ``(action, subject)``.  A new subject must be a known entity and not vague, or the
    record is retired; an unknown action is an error.
    """
    bucket = records.filter(F.lower("subject") == "user").select("id", classify(F.col("content")).alias("c"))
    bucket = bucket.select("id", F.col("c.action").alias("action"), slugify(F.col("c.subject")).alias("subject"))
    entity = broadcast_within(known.select(F.col("subject").alias("entity")).distinct(), MAX_ALIASES)
    met = bucket.join(entity, F.col("subject") == F.col("entity"), "left")
    fits = F.col("entity").isNotNull() & ~F.col("subject").isin(*VAGUE_BUCKETS)
    action = F.when(F.col("action") == "resubject", F.when(fits, "resubject").otherwise("retire")).when(F.col("action").isin("preference", "retire"), F.col("action")).otherwise("error")
    return met.select("id", action.alias("action"), F.when((F.col("action") == "resubject") & fits, F.col("subject")).alias("subject"))


def normal_namespace(c: Column) -> Column:
    """Project namespaces with a proper slug; others as they are."""
    project = F.substring(c, len(GLOBAL) + 2, 1 << 20)
    return F.when(c.startswith(f"{GLOBAL}:"), F.concat(F.lit(f"{GLOBAL}:"), slugify(project))).otherwise(c)


def namespace_moves(records: DataFrame) -> DataFrame:
    """``(src, dst, n)`` of what ``normal_namespace`` changes."""
    m = records.select(F.col("namespace").alias("src"), normal_namespace(F.col("namespace")).alias("dst"))
    return m.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


