import collections
import random
import re

import numpy as np
import pytest

from mnemospark.llm import superminhash as S
from mnemospark.llm.queries import QUERIES


def set_of(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """doc_id to (n_shingles, component_id, kept), from all pairs that share a shingle."""
    sets, parent, having = {i: set_of(t) for i, t in rows}, {i: i for i, _ in rows}, collections.defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = collections.Counter(j for g in sets[i] for j in having[g])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            having[g].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def results(df, pivots=S.PIVOTS):
    return {r.doc_id: tuple(r)[1:] for r in S.near_duplicates(df, pivots).collect()}


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def families():
    """A hub with copies that are alike only through it, chains, copies, a shared passage, texts at the very threshold."""
    rng, out = random.Random(1), []
    hub = words(rng, 200)
    for k in range(40):  # two words changed: alike to the hub, not to one another
        copy = list(hub)
        for at in (5 * k + 2, (5 * k + 100) % 200):
            copy[at] = f"x{k}-{at}"
        out.append(copy)
    out.append(hub)
    chain = words(rng, 300)
    for k in range(8):
        chain = chain[:]
        chain[20 * k : 20 * k + 6] = words(rng, 6)
        out.append(chain)
    out += [words(rng, 4), ["Only"], ["only"], [], words(rng, 5)] + [out[-1]] * 3
    passage = words(rng, 60)
    out += [words(rng, 30) + passage + words(rng, 30) for _ in range(10)]
    for cut in range(1, 12):
        out.append(hub[: 200 - 3 * cut])
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("pivots", [0, 1, 3])
def test_families_against_brute_force(spark, pivots):
    rows = list(enumerate(families(), 10))
    random.Random(2).shuffle(rows)
    want = brute(rows)
    assert results(spark.createDataFrame(rows, "doc_id long, text string"), pivots) == want
    assert collections.Counter(v[1] for v in want.values()).most_common(1)[0][1] > 40


def test_signatures_estimate_the_share():
    rng, errors, singles = np.random.default_rng(3), [], []
    for _ in range(80):
        u = rng.integers(0, 2**63, 60, dtype=np.uint64)
        s = S.signatures([u[:50], u[10:]])
        errors.append((s[0] == s[1]).mean() - 40 / 60)
        singles.append(S.signatures([u[:50]])[0])
        assert (s[0] == singles[-1]).all()  # the batch doesn't matter
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < np.sqrt(2 / 9 / S.SLOTS)  # less than plain min-wise hashing
    assert (S.signatures([np.array([7], np.uint64)]) != S._EMPTY).all()


def test_each_element_offers_a_permutation():
    one = S.signatures([np.array([123456789], np.uint64)])[0] >> np.uint64(40)
    assert sorted(one.tolist()) == list(range(S.SLOTS))


def test_forest_in_blocks():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    sets = [base, np.sort(base[3:]), np.sort(base[:-3]), np.unique(rng.integers(0, 2**63, 90, dtype=np.uint64))]
    assert len(S.forest(sets, [0, 1, 2, 3], [True] * 4)) == 2
    assert S.forest(sets, [0, 0, 0, 3], [True] * 4) == []
    assert {frozenset(e) for e in S.forest(sets, [0, 1, 2, 3], [True, True, False, False])} == {frozenset((0, 2)), frozenset((1, 2))}


def test_long_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 4)
    rows = list(enumerate(families()))
    assert results(spark.createDataFrame(rows, "doc_id long, text string"), 0) == brute(rows)


def test_edge_cases(docs, no_docs):
    """Nulls in every column, repeated rows, long and empty texts, further columns; an empty table."""
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count() and S.near_duplicates(no_docs).count() == 0
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[3].n_shingles == by_id[4].n_shingles == by_id[6].n_shingles == 0 and by_id[4].component_id == 4
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[5].kept
    nameless = [r for r in got if r.doc_id is None]
    assert nameless[0].component_id == 1 and nameless[0].n_shingles == len(set_of(docs.filter("doc_id is null").first().text))


def test_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_superminhash_near_dedup"](spark, sf_dir).collect()}
    assert got == brute(rows)
