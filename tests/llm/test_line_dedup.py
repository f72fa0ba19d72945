import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from mnemospark.llm import line_dedup as L


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    """Lines that go: an earlier line is equal, or within an edit if both are long enough."""
    places = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            w = tuple(x for x in re.split(r"[\t\x0b-\r ]+", line) if x)
            if w:
                places.setdefault(w, set()).add((d is not None, d or 0, key(t), i))
    first = {w: min(p) for w, p in places.items()}
    out = set()
    for w, p in places.items():
        near = len(w) >= L.MIN_WORDS and any(first[v] < first[w] and len(v) >= L.MIN_WORDS and abs(len(v) - len(w)) < 2 and edits(v, w) == 1 for v in places)
        out |= {x for x in p if near or x != first[w]}
    return {(d if known else None, h, i) for known, d, h, i in out}


def key(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def result(df):
    got = L.duplicate_lines(df).collect()
    pairs = [(r.doc_id, r.doc_hash, r.line_no) for r in got]
    assert len(set(pairs)) == len(set(got))
    assert all((r.kept_doc_id is not None, r.kept_doc_id or 0) <= (r.doc_id is not None, r.doc_id or 0) for r in got)
    return set(pairs)


def test_edge_cases_against_brute_force(docs, no_docs):
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(no_docs) == set()


def test_random_lines_against_brute_force(spark):
    rng = random.Random(4)
    words = list("aaaab")
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = [rng.choice(words) for _ in range(rng.choice([5, 7, 8, 8, 9]))]
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((d * 2 if d % 10 else None, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(df) == want and len(want) > 50 and len(want) < sum(len(t.split(chr(10))) for _, t in rows)


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_within_one_edit(spark):
    rng = random.Random(6)
    cases = [([rng.choice("ab") for _ in range(rng.randint(1, 6))], [rng.choice("ab") for _ in range(rng.randint(1, 6))]) for _ in range(400)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r.i: r.x for r in df.select("i", L.within_one_edit(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {i: edits(a, b) <= 1 for i, (a, b) in enumerate(cases)}


def test_texts_without_repeats(docs):
    out = L.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert 2 not in got and got[8].text == "short\n" and got[8].n_chars == 6
    assert got[3].text is None and got[4].text == "" and got[7].n_chars == 9


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(None, "a b\nc d"), (None, "e f\nc d"), (1, "g\nh"), (1, "i\nh")]
    out = L.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    lines = sorted(x for r in out.collect() for x in r.text.split("\n"))
    assert lines == ["a b", "c d", "e f", "g", "h", "i"]


def test_many_lines_share_a_key(spark):
    base = "one two three four five six seven eight nine ten".split()
    rows = [(i, " ".join([*base[:4], f"w{i}", *base[5:]])) for i in range(300)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == {(i, key(t), 0) for i, t in rows[1:]}


def test_bound_grows_with_the_line(spark):
    """Near copies of long lines go by the share of their words that differs; of short ones, with one edit."""
    rng = random.Random(9)
    rows, want = [], {}
    for d in range(40):
        line = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        k = d % 7  # up to 4 of 40 words may differ
        copy = [f"x{d}" if i in range(3, 3 + 5 * k, 5) else w for i, w in enumerate(line)]
        rows += [(d, " ".join(line)), (1000 + d, " ".join(copy))]
        want[1000 + d] = k
    rows += [(2000, "a b c d e"), (2001, "a b x d e"), (2002, "p q r s"), (2003, "p q r t")]
    got = {r.doc_id: r.edits for r in L.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), rate=0.1, min_words=5).collect()}
    assert got.pop(2001) == 1
    assert all(want[d] == e and e <= 4 for d, e in got.items())
    assert len(got) >= 0.9 * sum(k <= 4 for k in want.values())


def test_edit_distance(spark):
    rng = random.Random(7)
    cases = [([rng.choice("abc") for _ in range(rng.randint(1, 8))], [rng.choice("abc") for _ in range(rng.randint(1, 8))]) for _ in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r.i: r.x for r in df.select("i", L.edit_distance(F.col("a"), F.col("b"), F.lit(3)).alias("x")).collect()}
    assert got == {i: e if (e := edits(a, b)) <= 3 else -1 for i, (a, b) in enumerate(cases)}


def test_rate_against_brute_force(spark):
    """Each line with an earlier one within a tenth of the longer line's words goes, wherever the edits are."""
    rng = random.Random(12)
    lines = []
    for d in range(450):
        n = rng.choice([18, 19, 20, 21, 29, 30, 36, 40, 50, 90, 100, 120])
        line = [rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(n)]
        copy, k = list(line), rng.randint(1, n // 10 + 2)
        for j in range(k):  # evenly spread, which leaves the shortest runs
            i = min(len(copy) - 1, round((j + 1) * n / (k + 1)))
            how = rng.randrange(3)
            copy[i : i + (how != 1)] = [] if how == 2 else [f"x{d}"]
        lines += [line, copy]
    rng.shuffle(lines)
    want = set()
    for i, line in enumerate(lines):
        for other in lines[:i]:
            most = max(1, (longer := max(len(line), len(other))) // 10)
            shared = sum((Counter(line) & Counter(other)).values())
            if longer - shared <= most and edits(line, other) <= most:
                want.add(i)
                break
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = L.duplicate_lines(df, rate=0.1, min_words=5).collect()
    assert {r.doc_id for r in got} == want and len(want) > 250
    assert all(edits(lines[r.doc_id], lines[r.kept_doc_id]) == r.edits for r in got)


def test_open_lines_meet_all_earlier_lines_of_their_keys(spark):
    """Ten lines share a run, and each is near to one of the ten before it: that one is neither the first nor the second of the run."""
    rng = random.Random(13)
    shared = [f"s{i}" for i in range(9)]
    rest = [[f"r{d}-{i}" for i in range(31)] for d in range(10)]
    lines = [shared + r for r in rest] + [shared + [*r[:5], "x", *r[6:15], "y", *r[16:25], "z", *r[26:]] for r in rng.sample(rest, 10)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = L.duplicate_lines(df, rate=0.1, min_words=5).collect()
    assert {r.doc_id for r in got} == set(range(10, 20)) and {r.edits for r in got} == {3}


def test_runs_that_near_lines_share():
    """Two lines are in one range whose run is no longer than what their edits must leave."""
    for rate in (0.1, 0.15, 0.3):
        runs = L.shared_runs(rate)
        for longer in range(math.ceil(2 / rate), 400):
            k = int(longer * rate + 1e-9)
            for n in (longer - k, longer):
                assert any(low <= n and (high is None or longer <= high) and run <= -(-(longer - k) // (k + 1)) for low, high, run in runs)
    assert L.shared_runs(0.1)[0] == (18, 20, 6) and L.shared_runs(0.1)[-1][1:] == (None, 9)


def test_characters_are_drawn_once_for_a_line(spark, monkeypatch):
    """Pairs meet drawn characters first; words move only for what these leave."""
    made, real = {}, L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, label: made.setdefault(label, []).append(df.columns) or real(df, label))
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *words[1:15], "y", *words[16:]]))], "doc_id long, text string")
    assert [r.edits for r in L.duplicate_lines(docs, 0.1).collect()] == [2]
    assert ["first", "words", "drawn"] in made["texts"] and all(c == ["first", "by"] for c in made["rough"])


def test_words_are_looked_up_only_where_characters_are_shared(spark, monkeypatch):
    """Also for characters of two UTF-16 units, and where few characters are drawn."""
    rng = random.Random(8)
    cases = [([rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))], [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]) for _ in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    want = {i: e if (e := edits(a, b)) <= 3 else -1 for i, (a, b) in enumerate(cases)}

    def got():
        d = df.withColumn("x", L._drawn(F.col("a"))).withColumn("y", L._drawn(F.col("b")))
        return {r.i: r.e for r in d.select("i", L._exactly(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.lit(3)).alias("e")).collect()}

    assert got() == want
    monkeypatch.setattr(L, "_looked_up", lambda a, b, most: F.lit(-9))
    assert got() == want
    monkeypatch.undo()
    monkeypatch.setattr(L, "_drawn", lambda words: F.array_join(F.transform(words, lambda w: L._stand_in(F.pmod(F.xxhash64(w), F.lit(5)))), ""))
    assert got() == want


def test_run_keys(spark):
    """Each run's smallest hash, and no other, for any rate; a run is looked at twice at most."""
    rng = random.Random(5)
    lines = [[rng.choice("abcdef") for _ in range(n)] for n in [*range(1, 60), 150]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, w array<string>")
    for rate in (0.1, 0.15, 0.3):
        runs = L.shared_runs(rate)
        gram = min(L.GRAM, *[r for _, _, r in runs])
        keys = L._run_keys(F.col("w"), rate)
        assert "array_min" not in str(keys)
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - gram, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(gram)]))
        for r in df.select("w", grams.alias("h"), keys.alias("k")).collect():
            n = len(r.w)
            want = {min(r.h[i : i + run - gram + 1]) for low, high, run in runs if n >= max(low, run) and (high is None or n <= high) for i in range(n - run + 1)}
            assert len(r.k) == len(set(r.k)) and set(r.k) == want
