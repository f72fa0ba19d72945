"""Evaluation of retrieval: recall on probes, paired strategies, judged pairs, what each arm is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import has_identifier, squeezed_prefix
from mnemospark.storage import materialise

#: Results looked at, least semantic score (exclusive) of a row that is used, and the score buckets.
TOP, USED, BUCKETS, MARGINAL = 5, 0.55, (0.55, 0.58, 0.60, 0.65, 0.70, 1.01), 0.60


def is_hit(text: Column, expect_any: Column) -> Column:
    """Whether the text contains any of the expected strings, whatever the case."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(F.exists(expect_any, lambda e: F.contains(hay, F.lower(e))), F.lit(False))


def recall(results: DataFrame, probes: DataFrame) -> DataFrame:
    """``(arm, total, hits, hit_rate, misses)`` for results ``(arm, query_id, rank, text)``; probes without results miss."""
    joined = results.groupBy("arm", "query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("text"))
    arms = results.select("arm").distinct().crossJoin(probes)
    each = arms.join(joined, ["arm", "query_id"], "left").withColumn("hit", is_hit(F.col("text"), F.col("expect_any")))
    return each.groupBy("arm").agg(
        F.count("*").alias("total"), F.sum(F.col("hit").cast("long")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"),
        F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("query_id")))).alias("misses"),
    )


def shadow_rows(keyword: DataFrame, admitted: DataFrame, semantic: DataFrame, classic: DataFrame, per_hit: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each query: sizes of the lists, both top fives, what moved up and down."""
    ids = lambda df, name, top=None: (df if top is None else df.filter(F.col("rank") < top)).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(name))
    out = queries.select("query_id", "query", "captured")
    for df, name, top in ((keyword, "kw", None), (admitted, "adm", None), (semantic, "sem", None), (classic, "top_classic", TOP), (per_hit, "top_per_hit", TOP)):
        out = out.join(ids(df, name, top), "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    out = out.withColumn("promoted", F.array_except("top_per_hit", "top_classic")).withColumn("demoted", F.array_except("top_classic", "top_per_hit"))
    return out.withColumn("diverged", (F.size("promoted") > 0) | (F.size("demoted") > 0))


def shadow_summary(rows: DataFrame) -> DataFrame:
    """``(what, n)``: how far the strategies differ, and which kind of row moved."""
    inside = lambda name: lambda x: F.array_contains(name, x)
    n_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n_of = lambda c: F.sum(F.size(c))
    kw, adm, sem = F.col("kw"), F.col("adm"), F.col("sem")
    keyword_only = F.filter("demoted", lambda x: inside(kw)(x) & ~inside(sem)(x))
    some = (F.size(kw) > 0)
    counts = {
        "total": F.count("*"), "diverged": n_if(F.col("diverged")), "kw_zero": n_if(~some), "admit_all": n_if(some & (F.size(adm) == F.size(kw))), "admit_none": n_if(some & (F.size(adm) == 0)),
        "promoted_semantic_backed": n_of(F.filter("promoted", inside(sem))), "promoted_keyword_only": n_of(F.filter("promoted", lambda x: ~inside(sem)(x))),
        "demoted_keyword_only_dropped": n_of(F.filter(keyword_only, lambda x: ~inside(adm)(x))), "demoted_keyword_only_admitted": n_of(F.filter(keyword_only, inside(adm))),
        "demoted_semantic_backed": n_of(F.col("demoted")) - n_of(keyword_only), "drift_checked": n_if(F.size("captured") > 0),
        "drift_same": n_if((F.size("captured") > 0) & (F.slice("captured", F.lit(1), F.lit(TOP)) == F.col("top_classic"))),
    }
    wide = rows.agg(*[F.coalesce(v, F.lit(0)).cast("double").alias(k) for k, v in counts.items()], F.coalesce(F.round(F.avg(F.when(some, F.size(adm) / F.size(kw))), 6), F.lit(0.0)).alias("mean_admit"))
    names = [*counts, "mean_admit"]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(k).alias("n")) for k in names])).alias("x")).select("x.what", "x.n")


def class_split(rows: DataFrame) -> DataFrame:
    """Shadow rows by whether the query names something."""
    ratio = F.when(F.size("kw") > 0, F.size("adm") / F.size("kw"))
    return rows.groupBy(F.when(has_identifier(F.col("query")), "identifier").otherwise("prose").alias("class")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.length("query")), 6).alias("mean_len"), F.round(F.coalesce(F.avg(ratio), F.lit(0.0)), 6).alias("mean_admit"), F.sum(F.col("diverged").cast("long")).alias("diverged")
    )


def arm_of(verdict: Column, a_is_per_hit: Column) -> Column:
    return F.when(verdict == "TIE", "tie").when(verdict == "A", F.when(a_is_per_hit, "per_hit").otherwise("classic")).when(verdict == "B", F.when(a_is_per_hit, "classic").otherwise("per_hit")).otherwise("?")


def judged(pairs: DataFrame) -> DataFrame:
    """``final`` for pairs ``(query_id, v1, v2, a_is_per_hit)`` judged in both orders: the arm if both agree, else ``inconsistent``."""
    w1, w2 = arm_of(F.col("v1"), F.col("a_is_per_hit")), arm_of(F.col("v2"), ~F.col("a_is_per_hit"))
    both = pairs.withColumn("w1", w1).withColumn("w2", w2)
    return both.withColumn("final", F.when(F.col("w1") != F.col("w2"), "inconsistent").when(F.col("w1") == "?", "error").otherwise(F.col("w1")))


def tally(finals: DataFrame) -> DataFrame:
    """``(final, n, decisive_rate)``: the rate among pairs that one arm won."""
    counts = finals.groupBy("final").agg(F.count("*").alias("n"))
    wins = F.sum(F.when(F.col("final").isin("per_hit", "classic"), F.col("n"))).over(Window.partitionBy())
    return counts.select("final", "n", F.when(F.col("final").isin("per_hit", "classic"), F.round(F.col("n") / wins, 6)).alias("decisive_rate"))


def sample_pairs(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows by a seeded hash of the query's number: the same in every run."""
    return rows.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")))).orderBy("draw", "query_id").limit(n)


def blinded(pairs: DataFrame, seed: int) -> DataFrame:
    """Pairs for grading: arms in an order drawn by hash, the key in ``_a_arm``; inconsistent ones come first in ``place``."""
    first = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("query_id").cast("string"))), 1, 1), 16, 10).cast("int") < 8
    out = pairs.select(
        "query_id", "query", F.coalesce("final", F.lit("?")).alias("final"), F.when(first, "per_hit").otherwise("classic").alias("_a_arm"),
        F.when(first, F.col("top_per_hit")).otherwise(F.col("top_classic")).alias("a"), F.when(first, F.col("top_classic")).otherwise(F.col("top_per_hit")).alias("b"),
    )
    return out.withColumn("place", F.row_number().over(Window.orderBy((F.col("final") != "inconsistent").cast("int"), "query_id")) - 1)


def render_list(texts: Column) -> Column:
    """Numbered lines of at most 200 characters, or ``(no results)``."""
    lines = F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(F.trim(F.replace(F.coalesce(t, F.lit("")), F.lit("\n"), F.lit(" "))), 1, 200)))
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("(no results)")


def slots(classic: DataFrame, semantic_only: DataFrame, semantic: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query: slots filled, slots of keyword-only rows, used rows with and without the keyword arm, rows lost and gained."""
    scores = semantic.select("query_id", "id", F.col("score").alias("sem"))
    t = classic.filter(F.col("rank") < TOP).select("query_id", "id", F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(semantic_only.filter(F.col("rank") < TOP).select("query_id", "id", F.lit(0).alias("c"), F.lit(1).alias("s")))
    t = t.groupBy("query_id", "id").agg(F.max("c").alias("c"), F.max("s").alias("s")).join(scores, ["query_id", "id"], "left")
    used = F.coalesce(F.col("sem") > USED, F.lit(False)).cast("int")
    per = t.groupBy("query_id").agg(
        F.sum("c").alias("slots"), F.sum(F.when(F.col("sem").isNull(), F.col("c")).otherwise(0)).alias("keyword_only"), F.sum(F.col("c") * used).alias("used_classic"), F.sum(F.col("s") * used).alias("used_semantic"),
        F.sum(F.when(F.col("c") == 0, used).otherwise(0)).alias("lost"), F.sum(F.when(F.col("s") == 0, used).otherwise(0)).alias("gained"),
        F.array_sort(F.collect_list(F.when((F.col("c") == 0) & (used == 1), F.round("sem", 6)))).alias("lost_scores"),
    )
    return queries.select("query_id", "query").join(per, "query_id", "left").fillna(0)


def slot_summary(rows: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c).cast("long")
    return rows.agg(
        F.count("*").alias("queries"), n("slots").alias("slots"), n("keyword_only").alias("keyword_only"), n("used_classic").alias("used_classic"), n("used_semantic").alias("used_semantic"),
        n((F.col("used_classic") > 0).cast("int")).alias("queries_classic"), n((F.col("used_semantic") > 0).cast("int")).alias("queries_semantic"), n("lost").alias("lost"), n((F.col("lost") > 0).cast("int")).alias("queries_lost"), n("gained").alias("gained"),
    )


def by_kind(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """Slot rows with ``kind``: ``hook`` if the query's squeezed prefix is one of ``prompts``, else ``agent``."""
    known = prompts.select(squeezed_prefix(F.col("prompt")).alias("prefix")).distinct().withColumn("known", F.lit(True))
    return rows.withColumn("prefix", squeezed_prefix(F.col("query"))).join(known, "prefix", "left").withColumn("kind", F.when(F.col("known"), "hook").otherwise("agent")).drop("prefix", "known")


def score_histogram(scores: DataFrame) -> DataFrame:
    """``(bucket, n, share)`` of the column ``score``, all buckets present."""
    labels = [f"{lo:.2f}-{hi:.2f}" for lo, hi in zip(BUCKETS, BUCKETS[1:], strict=False)]
    at = F.coalesce(*[F.when((F.col("score") >= lo) & (F.col("score") < hi), label) for label, lo, hi in zip(labels, BUCKETS, BUCKETS[1:], strict=False)])
    counts = scores.select(at.alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    empty = scores.sparkSession.createDataFrame([(x, 0) for x in labels], "bucket string, n long")
    whole = counts.unionByName(empty).groupBy("bucket").agg(F.sum("n").alias("n"))
    return whole.select("bucket", "n", F.round(F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)), 6).alias("share"))


def score_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.round(F.median("score"), 6).alias("median"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("highest"), F.sum((F.col("score") < MARGINAL).cast("long")).alias("marginal"))


def judge_benchmark(results: DataFrame) -> DataFrame:
    """``results`` ``(cat, label, verdict, sec)`` by category and overall: accuracy, false positives and negatives, latency."""
    bad = lambda label, verdict: F.sum(((F.col("label") == label) & (F.col("verdict") == verdict)).cast("long"))
    return results.rollup("cat").agg(
        F.count("*").alias("n"), F.sum(F.col("label").eqNullSafe(F.col("verdict")).cast("long")).alias("correct"), bad("distinct", "duplicate").alias("false_positives"), bad("duplicate", "distinct").alias("false_negatives"),
        F.round(F.avg("sec"), 6).alias("avg_sec"), F.round(F.max("sec"), 6).alias("max_sec"),
    ).select(F.coalesce("cat", F.lit("(all)")).alias("cat"), "n", "correct", "false_positives", "false_negatives", "avg_sec", "max_sec")


def latest_captures(captures: DataFrame) -> DataFrame:
    """Of captures ``(line_no, query, namespaces, top5_ids)`` the last of each (query, namespaces), in the order they first came up."""
    one = captures.groupBy("query", "namespaces").agg(F.max_by("top5_ids", "line_no").alias("top5_ids"), F.min("line_no").alias("first_line"))
    return placed(one, "first_line", "place")


def placed(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their place by ``order``, from 0: ranges of rows are counted, and no task sees them all."""
    cut = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.struct(F.monotonically_increasing_id().alias("id")))
    cut = materialise(cut, "ordered")
    part = F.shiftright("_at.id", 33)
    sizes = cut.groupBy(part.alias("p")).agg(F.min("_at.id").alias("start"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    shifts = sizes.select("p", (before - F.col("start")).alias("shift"))
    return cut.join(F.broadcast(shifts), part == F.col("p")).withColumn(name, F.col("_at.id") + F.col("shift")).drop("_at", "p", "shift")
