import pytest
import random

from mnemospark.llm import decontam as D


def distance(p, t, anywhere=True):
    row = [0] * (len(t) + 1) if anywhere else list(range(len(t) + 1))
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if anywhere else row[-1]


def test_myers_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(500):
        p, t = ("".join(rng.choice("ab c") for _ in range(n)) for n in (rng.randint(1, 12), rng.randint(0, 30)))
        k, e = rng.randint(0, 12), distance(p, t)
        got, end = D.myers(len(p), D.pattern_bits(p), t, k)
        if e <= k and e < len(p):
            assert got == e and distance(p, t[:end]) == e
        else:
            assert end == -1 or got == e


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        at, what = rng.randrange(len(out)), rng.random()
        if what < 0.4:
            out[at] = rng.choice("abcdxyz")
        elif what < 0.7:
            del out[at]
        else:
            out.insert(at, rng.choice("abcdxyz"))
    return "".join(out)


def texts(rng, n):
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(40)) for _ in range(n)]


def test_planted_items_against_brute_force(spark):
    rng = random.Random(2)
    items = texts(rng, 8)
    docs = []
    for i in range(60):
        body = texts(rng, 2)
        item = items[i % 8]
        k = int(D.RATE * len(item))
        middle = edited(item, rng.choice([0, k // 2, k, 2 * k]), rng) if i % 3 else ""
        docs.append((i, f"{body[0]}, {middle.upper()}! {body[1]}"))
    got = {(r.doc_id, r.item_id): r for r in D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_chars=500).collect()}
    want = {(d, i): e for d, t in docs for i, x in enumerate(items) if (e := distance(D.normalise(x), D.normalise(t))) <= int(D.RATE * len(D.normalise(x)))}
    assert {k: r.edits for k, r in got.items()} == want and len(want) > 20
    for (d, i), r in got.items():
        assert distance(D.normalise(items[i]), D.normalise(docs[d][1])[r.start : r.stop], anywhere=False) == r.edits


def test_edge_cases(docs, no_docs, spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog, while the small cat sleeps"), (2, None), (3, ""), (4, "short one"), (1, "the quick BROWN fox jumps over the lazy dog while the small cat sleeps"), (None, "日本" * 30)], "item_id long, text string").withColumn("edits", D.F.lit(1))
    got = D.find(docs, items).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "2", "2", "None", "5", "8"] * 2)
    assert all(r.edits == 0 for r in got)
    clean = D.without_leaks(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 6, 7]
    assert D.find(no_docs, items).count() == 0 and D.find(docs, items.limit(0)).count() == 0 and D.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_pieces_and_branches():
    for n, k in ((40, 4), (41, 0), (100, 10), (7, 6)):
        cut = D.pieces("x" * n, k)
        assert len(cut) == k + 1 and sum(len(p) for _, p in cut) == n
        assert max(len(p) for _, p in cut) - min(len(p) for _, p in cut) <= 1
    assert D.branches(1) == [[]] and D.branches(4)[0] == [(0, 2)] and all(a <= j < b for j, own in enumerate(D.branches(11)) for a, b in own)


def test_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts_ = {r.doc_id: D.normalise(r.text) for r in docs.collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in D.find(docs, items).collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts_.items() if D.normalise(r.text) in t}
    assert exact and {k for k, e in got.items() if e == 0} == exact


@pytest.mark.parametrize(("item", "text", "hit"), [("What is the capital of France? Paris", "Q: what is the capital of France? Paris!", True), ("art", "a party", False), ("art", "Art, of course", True), ("art", "modern art", True), ("E=mc2", "so e mc2 it is", True), ("four words in all", "those four wordz in all", True), ("??", "??", False), ("日本", "x 日本 y", True)])
def test_short_items(item, text, hit):
    found = D.Matcher([(1, item)]).search(text)
    assert bool(found) == hit
    t, m = D.normalise(text), D.normalise(item)
    k = int(D.RATE * len(m))
    if m and k:
        assert hit == (distance(m, t) <= k)
    elif m:
        assert hit == (f" {m} " in f" {t} ")
