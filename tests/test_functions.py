"""Hand-sized vectors for the functions."""

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import parsing as P
from mnemospark.functions import secrets as S
from mnemospark.functions import text as T
from mnemospark.functions import vagueness as V
from mnemospark.functions import vectors as X


def value(spark, column, **names):
    row = spark.createDataFrame([tuple(names.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in names.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "want"), [("VERSION_CODE   bumped to   42", "version_code bumped to #"), ("", ""), (None, ""), ("  7\t8 ", "# #")])
def test_skeleton(spark, a, want):
    assert value(spark, T.skeleton(F.col("a")), a=a) == want


@pytest.mark.parametrize(("a", "b", "want"), [("bumped to 42", "bumped to 43", True), ("bumped to 42", "bumped to 42", False), ("bumped to 42", "lowered to 43", False)])
def test_number_guard(spark, a, b, want):
    assert value(spark, T.number_guard(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(("q", "want"), [("CT314", ["CT314", "CT 314"]), ("CT-314", ["CT-314", "CT 314", "CT314"]), ("deploy failed", ["deploy", "failed"]), ("", []), (None, [])])
def test_match_terms(spark, q, want):
    assert value(spark, T.match_terms(F.col("q")), q=q) == want


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("port 8800 open", ["8800"]), ("top 5 issues, best 42", []), ("check /etc now.", ["/etc"]), ("MCP CLI URL DNS", []), ("fail.", []), (".env", [".env"]), ("long-term read/write", []), ("e-Racun a/b/c", ["e-Racun", "a/b/c"]),
        ("10.98.0.136 user@host", ["10.98.0.136", "user@host"]), (None, []),
    ],
)
def test_identifiers(spark, q, want):
    assert value(spark, T.identifiers(F.col("q")), q=q) == want


@pytest.mark.parametrize(("t", "want"), [("at CT-314 now", True), ("CT 314", True), ("CT3141 x", False), ("prose only", False), ("act314", False), ("", False)])
def test_holds_identifier(spark, t, want):
    assert value(spark, T.holds_identifier(T.spaced_subtokens(F.col("t")), F.lit("CT314")), t=t) is want


def test_cosine(spark):
    c = X.cosine(F.col("a"), F.col("b"))
    assert value(spark, c, a=[1.0, 0.0], b=[2.0, 0.0]) == pytest.approx(1)
    assert value(spark, c, a=[1.0, 0.0], b=[0.0, 0.0]) == 0 and value(spark, c, a=[1.0], b=[1.0, 2.0]) == 0


@pytest.mark.parametrize(
    ("t", "prefix"),
    [
        ("key AKIA" + "B7" * 8, "aws-key-id"), ("ghp_" + "a1" * 18, "github-token"), ("password = 'Tr0ub4dor&3'", "secret-assignment"), ("token: changeme", None), ("see secret/infra/gitea for it", None),
        ("sha " + "0123456789abcdef" * 2 + "01234567", None), ("x " + "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW", "high-entropy-token"), ("-----BEGIN RSA PRIVATE KEY-----", "private-key-block"), ("", None), (None, None),
    ],
)
def test_secret_flags(spark, t, prefix):
    flags = value(spark, S.secret_flags(F.col("t")), t=t)
    assert [f.split(":")[0] for f in flags] == ([prefix] if prefix else [])


def test_secret_values_are_cut(spark):
    assert value(spark, S.secret_flags(F.col("t")), t="api_key=abcd1234efgh ")[0] == "secret-assignment: key='api_key' value=abcd****"


@pytest.mark.parametrize(
    ("t", "s", "n"),
    [("This server runs X", None, 0), ("It runs X", None, 1), ("built but that should be rebuilt", None, 1), ("pronouns that have", None, 0), ("", None, 1), ("X runs", "server", 1), ("X runs", "It", 1), ("X runs", "x", 0)],
)
def test_vagueness(spark, t, s, n):
    assert len(value(spark, V.vagueness_flags(F.col("t"), F.col("s")), t=t, s=s)) == n


def test_parsing(spark):
    assert value(spark, P.gate_verdict(F.col("a")), a="<think>reject</think>\n store") == "store"
    assert value(spark, P.pair_verdict(F.col("a")), a="no json") is None
    assert value(spark, P.choice_verdict(F.col("a")), a="A is fine. FINAL: tie") == "TIE"
    assert [r.content for r in value(spark, P.salvaged_items(F.col("a")), a='so: [{"content": "x"}] ok')] == ["x"]
    assert value(spark, P.salvaged_items(F.col("a")), a="nothing") == []
    got = value(spark, P.threads(F.col("a"), F.array(F.lit("p"), F.lit("q"))), a='{"threads": [[1, "2", 9, "x"], [7]]}')
    assert got == [["p", "q"]]
    assert value(spark, P.iso_date(F.col("a")), a="2024-1-2") is None and value(spark, P.iso_time(F.col("a")), a="soon") is None
    assert value(spark, P.flattened(F.col("a")), a="raw") == "raw"
