"""Vectors in fixed places, as the SQL prints them."""

import time

import duckdb
import numpy as np
import pyarrow as pa

from mnemospark.functions import embedding as E
from mnemospark.functions.embedding import fixed


def test_fixed_places_of_ties(spark):
    vectors = [[n / 128 for n in range(129)], [n / 640 for n in range(641)], [0.0, 1.0, 1 / 3, 2e-7, 5e-7], [], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>")
    got = {r.i: r.x for r in df.select("i", fixed("v").alias("x")).collect()}
    want = [None if v is None else ",".join(duckdb.execute("select printf('%.6f', ?::DOUBLE)", [x]).fetchall()[0][0] for x in v) for v in vectors]
    assert got == dict(enumerate(want))


def test_known_tokens_are_not_walked_for_each_text():
    class Seen(dict):
        def keys(self):
            raise AssertionError("all known tokens are walked")

        __iter__ = keys

    texts = [["a", "b", "a"], [], ["c"], None, ["\ud7ff", "b"]]
    b = pa.RecordBatch.from_arrays([pa.array(list("01234")), pa.array(texts, pa.list_(pa.string()))], names=["id", "ts"])
    for part in (b, b.slice(2)):
        got = E._vectors(part, 8, Seen()).to_pydict()
        for i, v in zip(got["id"], got["vector"], strict=True):
            want = np.bincount([E.bucket(t, 8) for t in texts[int(i)] or ()], minlength=8).astype(float)
            assert v == list(want / (np.linalg.norm(want) or 1.0))


def test_vectors_of_long_batches(spark, monkeypatch):
    """Also where a batch goes out in parts."""
    monkeypatch.setattr(E, "CELLS", 20)
    rows = [(str(i), None if i == 4 else " ".join(f"w{j % 7}" for j in range(i))) for i in range(11)]
    got = {r.id: r.vector for r in E.embed(spark.createDataFrame(rows, "id string, content string").coalesce(1), 8).collect()}
    for i, text in rows:
        want = np.bincount([E.bucket(t, 8) for t in (text or "").split()], minlength=8).astype(float)
        assert got[i] == list(want / (np.linalg.norm(want) or 1.0))


def test_short_texts_after_many_tokens(spark):
    """What short texts cost doesn't grow with the tokens known so far."""
    def seconds(first):
        rows = [("a", " ".join(f"w{i}" for i in range(first)))] + [(str(i), "one two") for i in range(8_000)]
        df = spark.createDataFrame(rows, "id string, content string").coalesce(1)
        start = time.monotonic()
        assert E.embed(df, 8).count() == E.embed(df, 8).filter("size(vector) = 8").count() == 8_001
        return time.monotonic() - start

    seconds(1)
    assert seconds(150_000) < 4 * seconds(1) + 4
