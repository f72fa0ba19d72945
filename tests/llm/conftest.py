import pytest

#: A text of some length, and one of no use.
PROSE = "the quick brown fox jumps over the lazy dog while the small cat sleeps under the old warm stove in the kitchen"
LONG = " ".join(f"{PROSE} {i}" for i in range(4000))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, PROSE, "en", "s1", 1), (2, PROSE, "en", "s1", 1), (2, PROSE, "en", "s1", 1), (3, None, "en", "s1", None), (4, "", None, None, 0), (None, PROSE + " indeed", "en", None, 3), (5, LONG, "en", "s2", len(LONG)), (6, " \n\t \n", "de", "s2", 4),
        (7, "día ÄÖÜ 日本語 \U0001f600 naïve", "es", "s3", 9), (8, "\n".join([PROSE, PROSE, "short", "", PROSE + " today"]), "en", "s3", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("component_id", "fp", "size", "key", "blob", "words", "first", "lang_k", "start", "h1", "n", "_id", "_hash", "_n", "_nll", "_ppl", "_lang", "_gone", "_limit", "row", "id", "hash", "lines", "left", "k1", "k2", "text_hash", "accepted"):
        df = df.withColumn(name, df.n_chars)
    return df


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
