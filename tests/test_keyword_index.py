"""The stored index against a full scan: scores, statistics after writes, skipped blocks."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import keyword_index as K
from mnemospark.operators.retrieval import keyword_search, query_phrases

RNG = random.Random(5)
WORDS = [f"word{i}" for i in range(60)]


def sentence(n):
    """Words of uneven frequency."""
    return " ".join(WORDS[min(int(RNG.expovariate(0.12)), 59)] for _ in range(n))


def scan(docs, queries, spaces, limit):
    """``docs`` is id to (namespace, content); every pair is scored."""
    tokens = {i: re.findall(r"[^\W_]+", t.lower()) for i, (_, t) in docs.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for q, text in queries.items():
        phrases = collections.Counter()
        for word in re.findall(r"[A-Za-z0-9_.:/@-]+", text):
            phrases[tuple(re.findall(r"[^\W_]+", word.lower()))] += 1
        total = collections.Counter()
        for phrase, times in phrases.items():
            m = len(phrase)
            tf = {i: n for i, ts in tokens.items() if (n := sum(tuple(ts[k : k + m]) == phrase for k in range(len(ts) - m + 1)))}
            raw = math.log((len(tokens) - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, n in tf.items():
                total[i] -= times * (raw if raw > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean))
        best = sorted(((round(s, 9), i) for i, s in total.items() if docs[i][0] in spaces[q]))[:limit]
        out[q] = [(i, round(s, 6)) for s, i in best]
    return {q: v for q, v in out.items() if v}


def frame(spark, docs):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in docs.items()], "id string, namespace string, content string")


def found(spark, index, queries, spaces, limit):
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    ns = spark.createDataFrame([(k, n) for k, v in spaces.items() for n in v], "query_id long, namespace string")
    out = collections.defaultdict(list)
    for r in keyword_search(index, q, ns, limit).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.id, round(r.keyword_score, 6)))
    return dict(out)


@pytest.fixture(scope="module")
def docs():
    out = {f"d{i}": (f"n{i % 3}", sentence(RNG.randrange(5, 60))) for i in range(900)}
    out["rare"] = ("n1", "the zebra-crossing of word3 and word59")
    return out


QUERIES = {1: "word0 word1 word58", 2: "zebra-crossing word0", 3: "word7", 4: "unknown", 5: " ".join(WORDS[:25]), 6: "word2.word3 word2 word2", 7: "word55 word56"}
SPACES = {1: ["n0", "n1", "n2"], 2: ["n0", "n1"], 3: ["n2"], 4: ["n0"], 5: ["n1", "n2"], 6: ["n0", "n1", "n2"], 7: ["n0"]}


def test_search_equals_a_scan_and_scores_fewer_pairs(spark, docs, tmp_path):
    index = K.KeywordIndex(spark, str(tmp_path / "index"))
    assert index.upsert(frame(spark, docs), 0)
    assert found(spark, index, QUERIES, SPACES, 5) == scan(docs, QUERIES, SPACES, 5)
    q = spark.createDataFrame(list(QUERIES.items()), "query_id long, query string")
    ns = spark.createDataFrame([(k, n) for k in QUERIES for n in SPACES[k]], "query_id long, namespace string")
    plan = index.candidates(query_phrases(q), ns, 5)
    scored = {r.query_id: r["count"] for r in plan["candidates"].groupBy("query_id").count().collect()}
    sharing = {k: sum(any(w in text.split() for w in QUERIES[k].split()) for n, text in docs.values() if n in SPACES[k]) for k in (1, 3, 5, 7)}
    assert all(scored[k] <= sharing[k] for k in sharing) and sum(scored[k] for k in sharing) < sum(sharing.values()) * 0.7
    assert scored[3] < sharing[3] / 4
    assert plan["passing"].count() < plan["bounded"].count() / 2


def test_writes_change_the_statistics_alone(spark, docs, tmp_path):
    index, now = K.KeywordIndex(spark, str(tmp_path / "index")), dict(docs)
    index.upsert(frame(spark, now), 0)
    new = {"d1": ("n0", "word58 word58 zebra"), "d2": ("n2", sentence(20)), "extra": ("n0", "word0 word1 word58"), "d3": ("n0", "")}
    index.upsert(frame(spark, new), 1)
    assert not index.upsert(frame(spark, {"d1": ("n0", "other")}), 1)  # a repeated batch does nothing
    index.delete(spark.createDataFrame([("d5",), ("d6",), ("nobody",)], "id string"), 2)
    now |= new
    now = {i: x for i, x in now.items() if i not in ("d3", "d5", "d6")}
    assert index.totals()[0] == len(now) and index.documents().count() == len(now)
    df = {r.token: r.df for r in index.frequencies(spark.createDataFrame([("word58",), ("zebra",)], "token string")).collect()}
    assert df == {w: sum(w in re.findall(r"\w+", t) for _, t in now.values()) for w in ("word58", "zebra")}
    want = scan(now, QUERIES, SPACES, 5)
    assert found(spark, index, QUERIES, SPACES, 5) == want
    index.compact()
    assert len(index.segments()) == 1 and index.totals()[0] == len(now)
    assert found(spark, index, QUERIES, SPACES, 5) == want
    assert not index.upsert(frame(spark, {"d1": ("n0", "other")}), 1)  # not even after a compaction
    index.upsert(frame(spark, {"d1": ("n1", "word58")}), 3)
    now["d1"] = ("n1", "word58")
    assert found(spark, index, QUERIES, SPACES, 5) == scan(now, QUERIES, SPACES, 5)


def test_a_write_reads_no_postings(spark, docs, tmp_path):
    """Only the stored documents and terms of the buckets at hand are read."""
    index = K.KeywordIndex(spark, str(tmp_path / "index"))
    index.upsert(frame(spark, docs), 0)
    read = []
    plain = index.read
    index.read = lambda table: read.append(table) or plain(table)
    index.delete(spark.createDataFrame([("d7",)], "id string"))
    assert set(read) == {"documents", "terms"}


def test_nothing_there(spark, tmp_path):
    """An index that isn't there, an empty one, rows without id or text, queries without words."""
    index = K.KeywordIndex(spark, str(tmp_path / "index"))
    assert found(spark, index, {1: "word"}, {1: ["n"]}, 5) == {} and index.totals() == (0, 0.0)
    index.upsert(spark.createDataFrame([(None, "n", "word"), ("", "n", "word"), ("a", "n", None), ("b", None, "word")], "id string, namespace string, content string"))
    assert index.totals()[0] == 1 and found(spark, index, {1: "word", 2: "", 3: "?"}, {1: ["n"], 2: ["n"], 3: ["n"]}, 5) == {}


def test_a_long_list_is_cut_into_blocks(spark, tmp_path):
    index = K.KeywordIndex(spark, str(tmp_path / "index"))
    index.upsert(spark.range(2000).select(F.concat(F.lit("d"), "id").alias("id"), F.lit("n").alias("namespace"), F.lit("same words here").alias("content")))
    sizes = [r.n for r in index.blocks(spark.createDataFrame([("same",)], "token string")).collect()]
    assert sum(sizes) == 2000 and len(sizes) > 10 and max(sizes) < 2 * K.BLOCK
