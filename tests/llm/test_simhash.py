import random

import numpy as np
import xxhash

from mnemospark.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return sorted((str(d), f"{fps[i]:016x}", str(min(groups.get(find(i), [None]), key=lambda x: (x is None, x)))) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.near_duplicates(df).collect())


def test_edge_cases_against_brute_force(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs) == brute(rows)
    assert result(no_docs) == []


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(500)]
        for _ in range(6):
            rows.append((len(rows) * 3 + 7, " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows) * 0.8


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_every_close_pair_meets_in_a_posting():
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        assert any(all(a >> 8 * p & 255 == b >> 8 * p & 255 for p in t) for t in S.TRIPLES)


def test_long_posting_lists_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST_ROWS", 16)
    rng = random.Random(2)
    base, values = rng.getrandbits(63), set()
    while len(values) < 120:
        x = base
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << bit
        values.add(x)
    signed = sorted(int(np.uint64(x).view(np.int64)) for x in values)
    links = S.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    from mnemospark.operators.components import connected_components

    comp = {r.node: r.component for r in connected_components(spark.createDataFrame([(r.u, r.v) for r in links], "u long, v long")).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & mask).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {x: comp.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_rows_that_share_an_id_are_judged_each(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "something else altogether here"), (2, "something else altogether here")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2]]


def test_keep_one(docs, no_docs):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and None in ids and 3 in ids and 4 not in ids and 6 not in ids and ids.count(5) == 1
    assert S.keep_one(no_docs).count() == 0
