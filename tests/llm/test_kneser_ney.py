import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import kneser_ney as K


UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in K.UNSPACED)
WORD = re.compile(rf" ?[^\W{UNSPACED}]{{1,{K.PIECE}}}|[^\s]|\n")


def split(text):
    return WORD.findall(text)


def brute_model(texts):
    """Interpolated modified Kneser-Ney on pairs of words, straight from the definition."""
    marked = lambda t: ["<s>", *split(t), "</s>"]
    counts = {2: Counter(pair for t in texts for pair in itertools.pairwise(marked(t)))}
    left = defaultdict(set)
    for x, y in counts[2]:
        left[(y,)].add(x)
    counts[1] = Counter({g: len(s) for g, s in left.items()})
    d = {}
    for o, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else None
        d[o] = [i - (i + 1) * y * m[i + 1] / m[i] if m[1] and m[i] else 0 for i in (1, 2, 3)]
        d[o] = [x if 0 < x < i else K.DISCOUNTS[i - 1] for i, x in enumerate(d[o], 1)]
    by_context = {o: defaultdict(list) for o in counts}
    for o, c in counts.items():
        for g, k in c.items():
            by_context[o][g[:-1]].append(k)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        o = len(g)
        seen = by_context[o].get(g[:-1])
        low = p(g[1:])
        if not seen:
            return low
        k = counts[o].get(g, 0)
        own = max(0.0, k - d[o][min(k, 3) - 1]) if k else 0.0
        return (own + sum(d[o][min(x, 3) - 1] for x in seen) * low) / sum(seen)

    def ppl(text):
        gs = list(itertools.pairwise(marked(text)))
        return math.exp(-sum(math.log(p(g)) for g in gs) / len(gs))

    return ppl, p, counts


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, None), (8, 1, 0), (7, 1, 0), (2, 1, 1), (3, 0, 0), (99, 1, 0), (None, 1, 0), (50, 1, 0), (51, 1, 0), (52, 1, 0)], "doc_id long, quality int, toxic int")


def test_perplexities_against_brute_force(spark, docs, labels):
    rows = docs.select("doc_id", "lang", "text").collect()
    trusted = {r.doc_id for r in K.trusted_ids(labels).collect() if not r.held}
    assert trusted <= {1, 5, 8, 7, 99, 50, 51, 52}
    models = {lang: brute_model([r.text or "" for r in rows if r.doc_id in trusted and (r.lang or "") == lang])[0] for lang in ("en", "es") if any(r.doc_id in trusted and (r.lang or "") == lang for r in rows)}
    got = K.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for r in rows:
        for g in by[r.doc_id]:
            lang = r.lang or ""
            if lang in models:
                assert g.perplexity == pytest.approx(models[lang](r.text or ""), rel=1e-5)
            else:
                assert g.perplexity is None and g.threshold is None and g.accepted


def test_probabilities_sum_to_one():
    _, p, counts = brute_model(["a b r a c a d a b r a", "a b c a b d a b e"])
    words = [g[0] for g in counts[1]]
    for context in [("a",), ("b",), ()]:
        assert sum(p((*context, w)) for w in words) + p((*context, "unknown")) == pytest.approx(1)


@pytest.mark.parametrize(("parts", "small"), [(1, False), (5, True)])
def test_parts_buckets_and_chunks_give_the_same(spark, docs, labels, monkeypatch, parts, small):
    key = lambda df: sorted((str(r.doc_id), r.lang, round(math.log(r.perplexity or 1), 4)) for r in df.collect())
    whole = key(K.classify(docs, labels))
    if small:  # settings reach the workers with the functions only
        monkeypatch.setattr(K, "BUCKET", 500)
        monkeypatch.setattr(K, "RARE", 40)
    assert key(K.classify(docs, labels, parts=parts)) == whole


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "lang", "text"])


def test_chunks_cut_long_texts_without_a_seam(monkeypatch):
    rows = [(1, 2, 3, "the cat sat on the mat " * 40), (4, 5, 3, ""), (6, 7, -3, "the cat"), (8, 9, 3, "the end " * 15)]
    whole = list(K.chunks(iter([batch(rows)])))
    assert len(whole) == 1
    monkeypatch.setattr(K, "GATHER", 37)
    cut = list(K.chunks(iter([batch(rows[:2]), batch(rows[2:])])))
    assert len(cut) > 4
    for of in (lambda c: [(c.rows[d], int(x)) for d, x in zip(c.pair_doc, c.pairs, strict=True)], lambda c: [(c.rows[d], int(x)) for d, x in zip(c.doc[c.own], c.seq[c.own], strict=True)]):
        assert Counter(x for c in cut for x in of(c)) == Counter(of(whole[0]))


def test_words_are_cut_in_small_blocks_and_gathered(monkeypatch):
    """However much is gathered, no more than a block of text is cut into words at once."""
    rows = [(i, i + 1, 3, "the cat sat on the mat " * (40 + i)) for i in range(20)]
    of = lambda c, start: (c.doc[c.own] + start, c.seq[c.own])
    [whole] = K.gathered(iter([batch(rows)]), of)
    monkeypatch.setattr(K, "BLOCK", 500)
    assert max(c.size for c in K.chunks(iter([batch(rows)]))) < 1000
    [cut] = K.gathered(iter([batch(rows)]), of)
    assert Counter((cut[0][d], int(x)) for d, x in zip(*cut[1:], strict=True)) == Counter((whole[0][d], int(x)) for d, x in zip(*whole[1:], strict=True))
    monkeypatch.setattr(K, "MOST_DOCS", 7)
    assert max(len(g[0]) for g in K.gathered(iter([batch(rows)]), of)) <= 7


def test_packed_keys_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys, at = np.sort(rng.integers(0, 1 << 64, n, np.uint64)), rng.integers(0, 65_535, n)
        chunk, docs, k, a = K.unpack(K.pack(77, 5, keys, at))
        assert chunk == 77 and docs == 5 and (k == keys).all() and (a == at).all()


def test_words():
    assert split("Don't  stop|now 12a\n日本語ab ไทย é_x 😀 lengthening") == ["Don", "'", "t", " stop", "|", "now", " 12a", "\n", "日", "本", "語", "ab", "ไ", "ท", "ย", " é_x", "😀", " length", "ening"]
    assert split(" \t") == [] and split("") == []


def test_hashes_are_those_of_the_words():
    rng = random.Random(5)
    texts = ["", " ", "a", "  ab", "ab " * 9] + ["".join(rng.choice("ab_1 \n\té日ไ.\u00a0😀\x1c") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    by_word, by_hash = {}, {}
    for t in texts:
        _, h = K.words(np.frombuffer(t.encode("utf-32-le"), "<u4"))
        assert len(h) == len(split(t))
        for w, x in zip(split(t), h.tolist(), strict=True):
            assert by_word.setdefault(w, x) == x and by_hash.setdefault(x, w) == w


def test_what_is_gathered_grows_with_the_corpus(spark):
    """Twice the text has far more than half as many bigrams again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = [K.bigrams(K._texts(d), 0, 1).count() for d in (docs.filter("doc_id % 2 = 0"), docs)]
    assert n[1] > 1.6 * n[0]


def test_edge_cases(spark, docs, no_docs, labels):
    kept = K.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert K.accepted(no_docs, labels).count() == 0 and K.classify(no_docs, labels).count() == 0
    assert K.accepted(docs, labels.limit(0)).count() == docs.count()


def test_held_out_accuracy(spark):
    """Half of the labels train; the others tell: clean documents stay, most junk goes."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = K.classify(docs, train).join(held, "doc_id").toPandas()
    clean, junk = got[(got.quality == 1) & (got.toxic == 0)], got[got.quality == 0]
    assert clean.accepted.mean() > 0.99 and (~junk.accepted).mean() > 0.7
    stage = {r.doc_id for r in K.accepted(docs, train).select("doc_id").collect()}
    assert stage >= set(clean[clean.accepted].doc_id)


def test_thresholds_are_the_quantile_itself(spark):
    """No margin: a language with many held-out documents keeps the quantile of them; one with few takes that of all."""
    rows = [("en", math.exp(1 + i / 1000), 10**9) for i in range(1, 1001)] + [("fr", math.exp(2.0), 10**9)] * 9 + [("fr", math.exp(9.0), 10**9), ("de", None, 5)]
    got = {r.lang: r.limit for r in K.thresholds(spark.createDataFrame(rows, "lang string, ppl double, n long")).select("lang", K.threshold(F.lit(10**9)).alias("limit")).collect()}
    assert set(got) == {"en", "fr"}
    assert got["en"] == pytest.approx(math.exp(1.99), rel=1e-3)
    assert math.exp(2.0) < got["fr"] < math.exp(2.5)


def test_most_junk_goes(spark):
    """As test_held_out_accuracy, with the share of junk that the bare quantile reaches."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = K.classify(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (~got[got.quality == 0].accepted).mean() > 0.84


def test_workers_hold_small_batches_and_are_of_one_kind(spark, docs, labels, monkeypatch):
    """Packed rows come in batches of a few MB, and no rows of a Python list start workers beside those of the model."""
    sent, real = [], K.broadcast_within
    monkeypatch.setattr(K, "broadcast_within", lambda df, most: sent.append(df) or real(df, most))
    K.judged(docs, labels)
    frequent = [df._jdf.queryExecution().toString() for df in sent if df.columns == ["key"]]
    assert len(frequent) == 1 and "LogicalRDD" not in frequent[0] and "ExistingRDD" not in frequent[0]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
