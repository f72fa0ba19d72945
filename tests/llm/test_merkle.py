import zlib
from hashlib import sha256

from oracle import connect, rows

from mnemospark.llm import merkle as M
from mnemospark.llm.queries import QUERIES, SQL

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node its siblings and places up to it."""
    proofs = [([], []) for _ in nodes]
    groups, level = [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        runs = [range(k, min(k + 16, len(level))) for k in range(0, len(level), 16)]
        for run in runs:
            for k in run:
                for leaf in groups[k]:
                    proofs[leaf][0].extend(level[j] for j in run if j != k)
                    proofs[leaf][1].append((k - run[0], len(run)))
        groups, level = [[x for k in run for x in groups[k]] for run in runs], [hashed(*(level[k] for k in run)) for run in runs]
    return level[0], proofs


def brute(rows_):
    by_source = {}
    for r in rows_:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    roots, found = [], []
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        leaves = [leaf_of(r, r["text"]) for r in own]
        root, proofs = tree(leaves)
        roots.append(root)
        found.append((own, leaves, root, proofs))
    top, above = tree(roots)
    out = []
    for (own, leaves, root, proofs), (more, upper) in zip(found, above, strict=True):
        for r, leaf, (beside, places) in zip(own, leaves, proofs, strict=True):
            now = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                now = leaf_of(r, None if r["text"] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            left = [*beside, *more]
            proof = hashed(*left)
            for at, size in [*places, *upper]:
                own_run, left = left[: size - 1], left[size - 1 :]
                now = hashed(*own_run[:at], now, *own_run[at:])
            out.append((r["doc_id"], leaf, root, top, proof, now, now == top))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in M.tampered_manifest(df).collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def frame(spark, rows_):
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows_], SCHEMA)


def test_trees_of_many_sizes(spark):
    """One leaf, a full run, a run and one, a full block, a block and one: also a source without a name and upper-case texts."""
    sizes = {"a": 1, "b": 16, "c": 17, "é": 257, "d": 4096, "e": 4097, None: 3}
    rows_, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows_.append({"doc_id": (i * 7919) % 100_003, "source": s, "lang": "en" if i % 3 else None, "n_chars": i, "text": [None, "", f"Text {i}", f"ÄB {i}"][i % 4]})
            i += 1
    assert got(frame(spark, rows_)) == brute(rows_)


def test_one_row_and_many_sources(spark):
    one = [{"doc_id": 5, "source": "x", "lang": None, "n_chars": None, "text": "A"}]
    assert got(frame(spark, one)) == brute(one)
    assert M.manifest(frame(spark, one)).first().proof == ""
    many = [{"doc_id": k, "source": f"s{k % 40}", "lang": "en", "n_chars": 1, "text": "Same"} for k in range(90)]
    assert got(frame(spark, many)) == brute(many)


def test_edge_cases(docs, no_docs):
    """Nulls in every column, repeated rows, ties of doc_id, long and empty texts, further columns; an empty table."""
    assert got(docs) == brute([r.asDict() for r in docs.select(*FIELDS).collect()])
    assert got(docs.filter("doc_id = 2").union(docs.filter("doc_id = 2").withColumn("text", docs.lang))) != []
    assert M.tampered_manifest(no_docs).count() == 0


def test_claims_are_told_apart(spark):
    docs = frame(spark, [{"doc_id": k, "source": "s", "lang": "en", "n_chars": 1, "text": f"t{k}"} for k in range(40)])
    claim = M.F.when(docs.doc_id == 7, M.F.sha2(M.F.lit("forged"), 256))
    checked = {r.doc_id: r.verified for r in M.verify(M.manifest(docs, claim)).collect()}
    assert [k for k, ok in checked.items() if not ok] == [7] and len(checked) == 40


def test_table_against_sql_and_brute_force(spark, sf_dir):
    name = "op12_merkle_manifest"
    out = QUERIES[name](spark, sf_dir).toPandas()
    assert rows(out) == rows(connect(sf_dir).execute(SQL[name]).df())
    table = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in out.itertuples(index=False)), key=str) == brute(table)
