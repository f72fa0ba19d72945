import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from mnemospark.llm import mixing as M
from mnemospark.llm.queries import QUERIES, SQL


def waterfill(sizes):
    """Targets by rounds, as the contract words it."""
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * len(sizes), strict=False))
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 5, None: 7}, {"a": 0, "b": 5}, {"a": 0}])
def test_targets(spark, sizes):
    got = M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: r.target for r in got.collect()} == pytest.approx(waterfill(sizes))


def test_edge_cases(docs, no_docs):
    got = M.mix(docs).collect()
    assert len(got) == docs.count() and M.mix(no_docs).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(v) == int(t + 1e-6) for (_, t), v in by.items())


def test_reruns_and_partitions_agree(docs):
    once, again = (sorted(map(str, d.collect())) for d in (M.mix(docs), M.mix(docs.repartition(7))))
    assert once == again


def test_heavier_documents_come_first(spark):
    """Sources b and c are cut at two epochs or less; of a's fraction clean documents get far more than junk."""
    clean, junk = "word " * 50, "# $ % ww " * 13
    rows_ = [(i, clean if i % 2 else junk, "a") for i in range(600)] + [(1000 + i, clean, "b") for i in range(60)] + [(2000 + i, clean, "c") for i in range(900)]
    got = M.mix(spark.createDataFrame(rows_, "doc_id long, text string, source string")).filter("doc_id between 2000 and 2999 or doc_id < 1000").withColumn("extra", F.col("taken") / F.col("size") % 1)
    a = got.filter("doc_id < 1000").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg(F.col("taken") / F.col("size")).alias("epochs")).collect()
    by = {r.odd: r.epochs for r in a}
    assert by[1] >= by[0]
    keys = spark.range(4000).select(F.col("id"), (-F.log(M.uniform(F.col("id"))) / F.when(F.col("id") % 2 == 0, 0.2).otherwise(1.0)).alias("key"))
    first = keys.orderBy("key").limit(1000).filter("id % 2 = 1").count()
    assert 750 < first < 950


def test_table_against_sql(spark, sf_dir):
    name = "op4_source_mixing"
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(connect(sf_dir).execute(SQL[name]).df())


@pytest.mark.parametrize("weight", [1.0, 0.3, 0.05])
def test_no_cell_holds_much_of_a_source(spark, weight):
    key = -F.log(M.uniform(F.col("id"))) / weight
    cells = spark.range(20_000).select(F.floor(F.log(key) * M.CELLS).alias("cell")).groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] < 40
