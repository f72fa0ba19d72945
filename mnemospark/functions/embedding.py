"""The default embedder: hashed token counts, scaled to length one.  A model takes its place as another Arrow map."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemospark.functions.text import index_tokens

#: Dimensions that embedders commonly have.
DIMENSIONS = (384, 768, 1024, 1536, 3072)
#: Numbers of an Arrow batch that goes out.
CELLS = 4_000_000


def bucket(token: str, dims: int) -> int:
    """Of the first 32 bits of the token's MD5."""
    return int(hashlib.md5(token.encode("utf-8", "replace")).hexdigest()[:8], 16) % dims


def _vectors(b: pa.RecordBatch, dims: int, seen: dict[str, int]) -> pa.RecordBatch:
    """The vectors of a batch of ids and tokens; each different token is looked up once in a batch, and ``seen`` is never walked."""
    n, lists = b.num_rows, b.column(1)
    tokens = lists.flatten().dictionary_encode()
    buckets = []
    for t in tokens.dictionary.to_pylist():
        if (k := seen.get(t)) is None:
            k = seen[t] = bucket(t, dims)
        buckets.append(k)
    rows = np.repeat(np.arange(n), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    cells = rows * dims + np.array(buckets, np.int64)[tokens.indices.to_numpy(zero_copy_only=False)]
    v = np.bincount(cells, minlength=n * dims).reshape(n, dims).astype(float)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v /= np.where(norm, norm, 1.0)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dims, pa.int32())
    return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), pa.float64()))], names=["id", "vector"])


def embed(texts: DataFrame, dims: int = DIMENSIONS[0]) -> DataFrame:
    """``(id, vector)`` for ``(id, content)``; a text without tokens has a vector of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, step):
                yield _vectors(b.slice(at, step), dims, seen)
                if len(seen) > 200_000:
                    seen.clear()

    step = max(1, CELLS // dims)
    return texts.select(F.col("id").cast("string").alias("id"), index_tokens(F.col("content")).alias("ts")).mapInArrow(run, "id string, vector array<double>")


@F.pandas_udf(StringType())
def fixed(vectors: pd.Series) -> pd.Series:
    """Numbers with six places, comma-joined; what is rounded is the number as it is stored, and ties go to the even digit.

    Java's formatter rounds the shortest decimal spelling instead, and ties go up: 33/128 differs.
    """
    return vectors.map(lambda v: ",".join(["%.6f" % x for x in v]), na_action="ignore")
