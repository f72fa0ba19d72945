"""Exact vector search over stored lists: what can't hold a result isn't read.

Vectors are scaled to length one and dealt to the nearest of some centres.  A list is cut into rings by the angle to its
centre, and a ring into blocks; a block knows its least and greatest angle.  On the unit sphere angles obey the triangle
inequality, so a query at angle a from the centre is nowhere nearer to the block than max(0, a - greatest, least - a).

Queries are packed into blocks, too, and meet the lists in joins; none comes to the driver.  Each query first searches
the blocks with the best bounds; its k-th best there is what any other block's bound must reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.storage import exists, materialise, scratch

#: Vectors that centres are chosen from for a namespace (by the hash of their ids), most centres, rounds of choosing.
SAMPLE, CENTRES, ROUNDS = 16_384, 256, 6
#: Rings of a list, vectors of a block, queries of a block, blocks whose bounds are looked at together.
RINGS, BLOCK, QUERIES, HEADERS = 8, 512, 256, 1 << 16
#: What rounding may add to a cosine.
SLACK = 1e-7

_PACK = "namespace string, dims int, ids array<string>, matrix binary"
_ROW = "namespace string, dims int, list int, angle double, id string, unit binary"
_BLOCK = "namespace string, dims int, block long, list int, near double, far double, n int, ids array<string>, units array<binary>"


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows one at a time: they are large, and as Python objects a whole batch would take several times its size."""
    return (tuple(c[i].as_py() for c in b.columns) for i in range(len(b)))


def _matrix(raw: bytes | list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(raw if isinstance(raw, bytes) else b"".join(raw), np.float64).reshape(-1, dims)


def _units(m: np.ndarray) -> np.ndarray:
    """Rows at length one; rows of length zero stay."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, namespace, vector): a row for each namespace and length in a batch, vectors scaled."""
    for b in batches:
        ids, spaces, vectors = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
        flat, starts = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes
        groups: dict[tuple, list[int]] = {}
        for i, (space, size) in enumerate(zip(spaces, sizes.tolist(), strict=True)):
            if size:
                groups.setdefault((space, size), []).append(i)
        keys = list(groups)
        rows = [(s, n, [ids[i] for i in groups[s, n]], _units(flat[starts[groups[s, n]][:, None] + np.arange(n)]).tobytes()) for s, n in keys]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.string()), pa.binary()))], names=["namespace", "dims", "ids", "matrix"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for space, dims, ids, matrix in _rows(b):
            m, k = _matrix(matrix, dims), len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([space] * k, pa.string()), pa.array([dims] * k, pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["query_id", "namespace", "dims", "unit"])


def pack(rows: DataFrame) -> DataFrame:
    """``(id, namespace, vector)`` as packed rows; missing and empty vectors are left out."""
    return rows.select(F.col("id").cast("string").alias("id"), "namespace", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_packed, _PACK)


def _chosen(frame: pd.DataFrame) -> pd.DataFrame:
    """Centres of a namespace's sample: spherical k-means from evenly spaced starts."""
    dims = int(frame["dims"].iloc[0])
    m = np.array(frame["vector"].tolist(), np.float64).reshape(-1, dims)
    m = _units(m)
    m = m[np.linalg.norm(m, axis=1) > 0]
    n = int(min(CENTRES, max(1, np.sqrt(frame["total"].iloc[0])), max(1, len(m))))
    centres = m[np.linspace(0, len(m) - 1, n).astype(int)] if len(m) else np.eye(1, dims)
    for _ in range(ROUNDS if len(m) else 0):
        own = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1.0)[:, None], centres)
    return pd.DataFrame({"namespace": [frame["namespace"].iloc[0]], "dims": [dims], "centres": [centres.tobytes()]})


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows with their centres: a row for each vector, with its list and angle."""
    for b in batches:
        for space, dims, ids, matrix, centres in _rows(b):
            m = _matrix(matrix, dims)
            cosines = m @ _matrix(centres, dims).T
            own = cosines.argmax(axis=1)
            angles = np.arccos(np.clip(cosines[np.arange(len(m)), own], -1, 1))
            zero = ~m.any(axis=1)
            own[zero], angles[zero] = -1, 0.0
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([space] * k, pa.string()), pa.array([dims] * k, pa.int32()), pa.array(own.astype(np.int32)), pa.array(angles), pa.array(ids, pa.string()), pa.array([r.tobytes() for r in m], pa.binary())], names=["namespace", "dims", "list", "angle", "id", "unit"]
            )


def _bounds(q: np.ndarray, centres: np.ndarray, lists: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The highest cosine that each block (columns) can have with each query (rows); 0 with list -1, vectors of length zero."""
    angles = np.arccos(np.clip(q @ centres.T, -1, 1))[:, np.maximum(lists, 0)]
    out = np.cos(np.maximum(0, np.maximum(angles - far, near - angles))) + SLACK
    out[:, lists < 0] = SLACK
    out[~q.any(axis=1)] = SLACK
    return out


def _asking(k: int, seeds: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed queries with centres, headers and floors: the blocks that each query has to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, dims, ids, matrix, floors, centres, blocks, lists, near, far, n in _rows(b):
                blocks, lists, near, far, n = (np.array(x) for x in (blocks, lists, near, far, n))
                bound = _bounds(_matrix(matrix, dims), _matrix(centres, dims), lists, near, far)
                found: tuple[list[str], list[int]] = ([], [])
                for i, query in enumerate(ids):
                    if seeds:
                        order = np.argsort(-bound[i], kind="stable")
                        hit = order[: 1 + int(np.searchsorted(np.cumsum(n[order]), k))]
                    else:
                        hit = np.flatnonzero(bound[i] >= (floors[i] if floors[i] is not None else -2.0))
                    found[0].extend([query] * len(hit))
                    found[1].extend(blocks[hit].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.int64())], names=["query_id", "block"])

    return run


def _nearest(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with some queries: the best k of the block for each, and all that tie with the last of them, cut by id."""
    types = [("query_id", pa.string()), ("namespace", pa.string()), ("id", pa.string()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for space, dims, ids, matrix, queries, vectors in _rows(b):
                scores = _matrix(vectors, dims) @ _matrix(matrix, dims).T
                rounded, names, m = np.round(scores, 9), np.array(ids, object), min(k, len(ids))
                edge = -np.partition(-rounded, m - 1, axis=1)[:, m - 1]
                rows, cols = np.nonzero(rounded >= edge[:, None])
                order = np.lexsort((names[cols].astype(str), -rounded[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < m
                rows, cols = rows[kept], cols[kept]
                out = [np.array(queries, object)[rows], [space] * len(rows), names[cols], scores[rows, cols]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, types, strict=True)], names=[x for x, _ in types])

    return run


class VectorIndex:
    """An index in the folder ``path``: ``blocks`` of vectors, ``headers`` and centres by namespace and length."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, store: DataFrame) -> VectorIndex:
        """Write the index of ``(id, namespace, vector)``.  Missing and empty vectors are left out; vectors of different lengths don't meet."""
        rows = store.filter("size(vector) > 0").select("id", "namespace", F.size("vector").alias("dims"), F.col("vector").cast("array<double>").alias("vector"))
        with scratch():
            totals = rows.groupBy("namespace", "dims").agg(F.count("*").alias("total"))
            few = rows.withColumn("r", F.row_number().over(Window.partitionBy("namespace", "dims").orderBy(F.xxhash64("id"), "id"))).filter(F.col("r") <= SAMPLE).drop("r", "id")
            sample = few.join(totals.withColumnsRenamed({"namespace": "ns", "dims": "d"}), F.col("namespace").eqNullSafe(F.col("ns")) & (F.col("dims") == F.col("d"))).drop("ns", "d")
            centres = materialise(sample.groupBy("namespace", "dims").applyInPandas(_chosen, "namespace string, dims int, centres binary"), "centres")
            c = centres.withColumnsRenamed({"namespace": "ns", "dims": "d"})
            packed = pack(rows)
            dealt = packed.join(c, packed.namespace.eqNullSafe(c.ns) & (packed.dims == c.d)).select("namespace", "dims", "ids", "matrix", "centres").mapInArrow(_dealt, _ROW)
            dealt = materialise(dealt.withColumn("space", F.coalesce(F.concat(F.lit("s"), "namespace"), F.lit("n"))), "dealt")
            key = ["space", "dims", "list"]
            cuts = dealt.groupBy(*key).agg(F.percentile_approx("angle", [x / RINGS for x in range(1, RINGS)], 1000).alias("cuts"), F.count("*").alias("total"))
            ring = F.when(F.col("total") > BLOCK, F.size(F.filter("cuts", lambda x: x < F.col("angle")))).otherwise(0)
            ringed = dealt.join(cuts, key).withColumn("ring", ring).drop("cuts", "total")
            sizes = ringed.groupBy(*key, "ring").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
            cut = ringed.join(sizes, [*key, "ring"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
            members = F.sort_array(F.collect_list(F.struct("id", "unit")))
            blocks = cut.groupBy(*key, "ring", "chunk").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count("*").cast("int").alias("n"), F.any_value("namespace").alias("namespace"), members.alias("m"))
            blocks = blocks.select("namespace", "dims", F.monotonically_increasing_id().alias("block"), "list", "near", "far", "n", F.col("m.id").alias("ids"), F.col("m.unit").alias("units"))
            blocks.write.mode("overwrite").parquet(f"{self.path}/blocks")
            centres.write.mode("overwrite").parquet(f"{self.path}/centres")
        return self

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/centres/_SUCCESS")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")

    def _headers(self) -> DataFrame:
        """For each namespace and length its centres, and where its blocks lie, ``HEADERS`` of them or so in a row."""
        centres = self.spark.read.schema("namespace string, dims int, centres binary").parquet(f"{self.path}/centres")
        own = self.blocks().select("namespace", "dims", "block", "list", "near", "far", "n")
        parts = own.groupBy(F.col("namespace").alias("ns"), F.col("dims").alias("d")).agg(F.ceil(F.count("*") / HEADERS).alias("parts"))
        own = own.join(parts, own.namespace.eqNullSafe(parts.ns) & (own.dims == parts.d)).withColumn("part", F.pmod(F.xxhash64("block"), "parts"))
        at = own.groupBy("ns", "d", "part").agg(F.collect_list(F.struct("block", "list", "near", "far", "n")).alias("b"))
        return centres.join(at, centres.namespace.eqNullSafe(at.ns) & (centres.dims == at.d)).select("ns", "d", "centres", *[F.col(f"b.{x}").alias(x) for x in ("block", "list", "near", "far", "n")])

    def _asked(self, queries: DataFrame, headers: DataFrame, k: int, seeds: bool) -> DataFrame:
        """``(query_id, block)``: ``queries`` are ``(query_id, namespace, dims, unit, floor)``."""
        dealt = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.ceil(F.count("*").over(Window.partitionBy("namespace", "dims")) / QUERIES)))
        packed = dealt.groupBy("namespace", "dims", "part").agg(F.collect_list(F.struct("query_id", "unit", "floor")).alias("q"))
        packed = packed.select("namespace", "dims", F.col("q.query_id").alias("ids"), F.col("q.unit").alias("units"), F.col("q.floor").alias("floors"))
        both = packed.join(headers, packed.namespace.eqNullSafe(headers.ns) & (packed.dims == headers.d)).drop("ns", "d")
        return both.mapInArrow(_asking(k, seeds), "query_id string, block long")

    def _searched(self, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, namespace, id, score)``: the best k of each block for the queries that ask for it."""
        own = asked.join(queries.select("query_id", "unit"), "query_id")
        sizes = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
        parts = own.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).groupBy("block", "part").agg(F.collect_list("query_id").alias("queries"), F.collect_list("unit").alias("vectors"))
        met = self.blocks().join(parts, "block").select("namespace", "dims", "ids", "units", "queries", "vectors")
        return met.mapInArrow(_nearest(k), "query_id string, namespace string, id string, score double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, namespace, rank, id, score)``: the k nearest by cosine in each namespace that a query names, exactly.

        ``queries`` is ``(query_id, namespace, vector)``.  Equal scores, to nine places, go by id.  Vectors and queries of
        length zero score 0; missing and empty query vectors find nothing.
        """
        return self.plan(queries, k)["found"]

    def plan(self, queries: DataFrame, k: int) -> dict[str, DataFrame]:
        """The search; ``seeds`` and ``asked`` say which blocks are read for which query."""
        key = F.to_json(F.struct(F.col("query_id").cast("long").alias("q"), F.col("namespace").alias("s")), {"ignoreNullFields": "false"})
        flat = pack(queries.select(key.alias("id"), "namespace", "vector"))
        rows = flat.mapInArrow(_unpacked, "query_id string, namespace string, dims int, unit binary")
        rows = materialise(rows.dropDuplicates(["query_id"]), "query-vectors")
        headers = materialise(self._headers(), "headers")
        seeds = materialise(self._asked(rows.withColumn("floor", F.lit(None).cast("double")), headers, k, True), "seeds")
        first = materialise(self._searched(seeds, rows, k), "first")
        place = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
        kth = first.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k).groupBy("query_id").agg(F.min(F.round("score", 9)).alias("least"), F.count("*").alias("m"))
        floors = rows.join(kth.select("query_id", F.when(F.col("m") >= k, F.col("least")).alias("floor")), "query_id", "left")
        asked = self._asked(floors, headers, k, False).join(seeds, ["query_id", "block"], "left_anti")
        both = first.union(self._searched(asked, rows, k))
        best = both.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
        found = best.select(F.get_json_object("query_id", "$.q").cast("long").alias("query_id"), "namespace", "rank", "id", "score")
        return {"found": found, "seeds": seeds, "asked": asked}
