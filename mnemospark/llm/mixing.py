"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is ``-ln(u) / w``: u is a uniform number from a hash of its doc_id, w its quality weight.  Within a
source the smallest keys come first, which is weighted sampling without replacement.  A source's budget is taken as
whole epochs first; what is left is filled along the keys by a prefix sum over sizes, and the document at the edge
gives the words that are still missing, so that a source's total meets its target to a word.

A source may hold any share of the rows, so the prefix sum has two levels: the logarithm of the key is cut into cells
of width 1 / ``CELLS``, the cells' totals are summed along each source, and only rows of one cell are ordered together.
A weight only shifts that logarithm, so the fullest cell has a share of 1 / (e ``CELLS``) of a source, whatever its
documents' weights.  Rows without an id draw by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.storage import materialise

#: Weights by rank of the source, repeating; share of all sizes that the targets sum to; most epochs of a source.
WEIGHTS, SHARE, MAX_EPOCHS = (5, 2, 1), 1.5, 2
#: Cells of a source in a unit of the key's logarithm.
CELLS = 1024
#: Characters that running prose has few of; fixed for the quality weight.
SYMBOLS = "#%&*$|<>{}[]~^_=+@0123456789"


def size_of(text: Column) -> Column:
    """Words of the text: runs of other characters than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: falls with the share of symbols and digits; 1 for an empty text."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), 1.0 - 4.0 * symbols / n)), F.lit(1.0))


def uniform(doc_id: Column, text: Column | None = None) -> Column:
    """A number in (0, 1) from the MD5 of the id (null: of the text), the same in every run."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("") if text is None else text, F.lit(""))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)`` in, with ``target`` out: shares by weight, cut at MAX_EPOCHS sizes, the excess dealt anew.

    A source is cut when ``level * weight > 2 * size``.  In order of ``2 * size / weight`` the cut ones come first, so
    the level is found with running sums instead of rounds.  Sources with size 0 get 0.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    t = ranked.withColumn("weight", weight).withColumn("cap", float(MAX_EPOCHS) * F.col("source_size")).withColumn("turn", F.col("cap") / F.col("weight"))
    before = everything.orderBy("turn", "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left", SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.col("open"))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "rank", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    Null texts have size 0; null sources are one source, ranked last; rows that repeat are documents of their own
    (which of them gives the last words of a budget doesn't show in the result); an empty table gives no rows; further
    columns are ignored.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), quality_weight(text).alias("w"), uniform(F.col("doc_id"), text).alias("u"))
    base = base.withColumn("key", -F.log("u") / F.col("w"))
    rows = materialise(base.select("doc_id", "source", "size", "key", F.floor(F.log("key") * CELLS).cast("int").alias("cell")), "sizes")
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("in_cell"))
    by_source = targets(cells.groupBy("source").agg(F.sum("in_cell").alias("source_size")))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = cells.withColumn("before", F.coalesce(F.sum("in_cell").over(before), F.lit(0))).join(by_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "in_cell")
    plan = plan.withColumnsRenamed({"source": "s", "cell": "c"})
    inside = Window.partitionBy("source", "cell").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    t = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") + 1e-6) - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before") - F.col("own")))
    return t.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


_SIZE = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT"
MIX_SQL = f"""
with base as (
  select doc_id, source, {_SIZE} as size,
    case when length(text) > 0 then greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(regexp_replace(text, '[#%&*$|<>{{}}\\[\\]~^_=+@0-9]', '', 'g'))) / length(text)) else 1.0::DOUBLE end as w,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE as u
  from documents),
s as (select source, sum(size)::BIGINT as source_size, row_number() over (order by source nulls last) - 1 as rank from base group by source),
t as (select *, case rank % 3 when 0 then 5.0::DOUBLE when 1 then 2.0::DOUBLE else 1.0::DOUBLE end as weight, 2.0::DOUBLE * source_size as cap from s),
l as (select *, (1.5::DOUBLE * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0.0::DOUBLE))
      / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0.0::DOUBLE)) as level from t),
v as (select arg_min(level, cap / weight) as level from l where level <= cap / weight),
g as (select source, source_size, case when v.level is null then cap else least(cap, v.level * weight) end as target from l, v),
k as (select b.doc_id, b.size, g.source_size, g.target, coalesce(sum(b.size) over (partition by b.source order by -ln(b.u) / b.w, b.doc_id, b.size rows between unbounded preceding and 1 preceding), 0) as before,
      case when g.source_size > 0 then floor(g.target / g.source_size)::BIGINT else 0 end as epochs
      from base b join g on b.source is not distinct from g.source)
select doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, floor(target + 1e-6)::BIGINT - epochs * source_size - before)))::BIGINT as taken from k
"""
