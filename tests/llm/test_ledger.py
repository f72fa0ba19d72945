import hashlib
import re

from oracle import connect, rows

from mnemospark.llm import ledger as L
from mnemospark.llm.queries import QUERIES, SQL

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(spans)), spans


TEXTS = [
    "password = hunter2hunter2", "Token: secret: abcdefgh1234", "secret=token=abcdefgh", "API_KEY='abc' apikey=\"Zm9vYmFyYmF6\" token: short", "AKIA" + "B" * 12, "AKIAAKIA" + "C1" * 8 + " AKIAshort", "x" + "0a" * 16 + "g" + "f" * 31,
    "日本 password: ABCdef+/=_.- \U0001f600 token=12345678", "tokentoken:abcdefghi", None, "", "token:  \n abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "z1" * 20, "passwd\t=abcdefgh", "secret : : abcdefghij", "toKEN=" + "a" * 100_000,
]


def digests(spark, texts, ledger=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, grown = L.scan(df, ledger)
    return {r.doc_id: r for r in L.digest(found).collect()}, grown


def test_spans_against_brute_force(spark):
    got, _ = digests(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        base, spans = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (text, got[i])
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert got[12].spans == "pem:0:31" and got[13].spans == "host:0:44"


def test_only_unseen_blobs_are_scanned(spark):
    _, first = digests(spark, TEXTS[:5])
    first = spark.createDataFrame(first.collect(), first.schema)
    marked = first.withColumn("spans", L.F.when(L.F.size("spans") > 0, L.F.slice("spans", 1, 1)).otherwise(first.spans))
    got, grown = digests(spark, TEXTS[:6], marked)
    assert got[3].spans.count(",") == 0  # the ledger's word stands; nothing was scanned again
    assert got[5].spans and grown.count() == 6
    old = first.withColumn("rule_version", L.F.lit(0))
    assert digests(spark, TEXTS[:5], old)[1].count() == 5  # other rules: all anew


def test_edge_cases(docs, no_docs):
    found, grown = L.scan(docs)
    assert L.digest(found).count() == docs.count() and L.scan(no_docs)[0].count() == 0
    assert grown.count() == docs.selectExpr("coalesce(text, '') t").distinct().count()


def test_table_against_sql_and_brute_force(spark, sf_dir):
    name = "op6_secret_scan"
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(connect(sf_dir).execute(SQL[name]).df())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id])[0].encode()).hexdigest() for r in got.itertuples())
