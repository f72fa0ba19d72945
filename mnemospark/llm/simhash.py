"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits agree in at least five of their eight bytes.  The index is
keyed by byte positions.  Posting lists of a single position hold 1/256 of all fingerprints, which is quadratic; so a
posting is the value at three positions at once.  The eight triples inside {0,1,2,3} and inside {4,5,6,7} suffice: of
any five positions, three lie in one half (the Turan system T(8,5,3)).  Within a posting list the shared positional
bytes of each pair are tallied, pairs with fewer than five are let go, the rest are verified bit by bit.

A posting list emits no pairs: a breadth-first walk over its verified links emits a spanning forest, so the edges are
fewer than the members.  Lists longer than ``LIST_ROWS`` are cut into chunks, and each pair of chunks is a task of its
own.  Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches
from mnemospark.operators.components import connected_components
from mnemospark.storage import broadcast_within, materialise

#: Words of a shingle, XXH64 seed, bits that linked fingerprints may differ in, bytes they must then share.
WORDS, SEED, MAX_BITS, MIN_BYTES = 3, 42, 3, 5
#: Byte positions of a posting key.
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7))
#: Longest posting list that one task compares at once.
LIST_ROWS = 4096
#: Rows of a list of documents that may be broadcast.
MAX_DROPPED = 2_000_000


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text; 0 for a null text and one without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) < WORDS:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - WORDS + 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[WORDS - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for k in range(0, len(values), 65_536):
        ones += np.unpackbits(values[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row; fp is the fingerprint's bits as a signed long."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Tree edges (positions) of the links among distinct fingerprints, by breadth-first search."""
    todo, edges, bytes_of = np.arange(len(values)), [], values.view(np.uint8).reshape(-1, 8)
    while len(todo):
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            shared = (bytes_of[todo] == bytes_of[at]).sum(axis=1)
            near = np.flatnonzero(shared >= MIN_BYTES)
            near = near[np.bitwise_count(values[todo[near]] ^ values[at]) <= MAX_BITS]
            if len(near):
                found = todo[near].tolist()
                edges += [(at, x) for x in found]
                queue += found
                keep = np.ones(len(todo), bool)
                keep[near] = False
                todo = todo[keep]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, block, fp), sorted by (k, block): the forest of each group.  A group may span batches."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    rest: list[np.ndarray] = []

    def solve(k: np.ndarray, block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (block[1:] != block[:-1])) + 1
        bounds = np.concatenate(([0], cuts, [len(k)]))
        us, vs = [], []
        for i in np.flatnonzero(np.diff(bounds) > 1):
            group = fp[bounds[i] : bounds[i + 1]]
            for a, b in forest(np.ascontiguousarray(group).view(np.uint64)):
                us.append(int(group[a]))
                vs.append(int(group[b]))
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if rest:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0])
        rest = [x[last:] for x in now]
        if last:
            yield solve(*(x[:last] for x in now))
    if rest:
        yield solve(*rest)


def links(distinct: DataFrame) -> DataFrame:
    """``(u, v)`` links between the distinct fingerprints ``fp``: enough to reach whatever the full link set reaches."""
    def key(i: int, triple: tuple[int, int, int]):
        at = F.lit(i)
        for p in triple:
            at = at * 256 + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
        return at.cast("long")

    postings = distinct.select("fp", F.explode(F.array(*[key(i, t) for i, t in enumerate(TRIPLES)])).alias("k"))
    sizes = postings.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(postings.join(sizes, "k").select("k", "fp", "n"), "postings")
    chunks = F.ceil(F.col("n") / LIST_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    blocks = F.when(chunks == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.least(x, own) * chunks + F.greatest(x, own)))
    return shared.select("k", F.explode(blocks).alias("block"), "fp").repartition("k", "block").sortWithinPartitions("k", "block").mapInArrow(_links, "u long, v long")


def _classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp, component, component_id)`` of every row; the component is a fingerprint."""
    small_batches(docs.sparkSession)
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    comp = connected_components(links(distinct.select("fp")))
    nodes = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    return fps.join(nodes.join(smallest, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; rows that repeat are repeated; a null doc_id is
    carried through and never names a component unless its whole component is null; an empty table gives no rows;
    further columns are ignored.
    """
    return _classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each component: the smallest by doc_id, then by the hash of its text.

    Rows with a null doc_id stay.  Of rows that share doc_id and text one is kept.  Null and empty texts have fingerprint
    zero and are near-duplicates of one another; very long texts are read whole; an empty table gives no rows; further
    columns, of any name, are kept.
    """
    found = materialise(_classes(docs).filter("doc_id is not null").select("doc_id", "text_hash", "component"), "classes")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    rows = found.groupBy("doc_id", "text_hash", "component").agg(F.count("*").alias("copies"))
    judged = rows.join(first, "component").select("doc_id", "text_hash", (F.col("first") != F.struct("doc_id", "text_hash")).alias("drop"), (F.col("copies") > 1).alias("twice"))
    judged = materialise(judged.filter("drop or twice"), "judged")

    def same(of: DataFrame, listed: DataFrame) -> Column:
        return (of["doc_id"].cast("long") == listed["doc_id"]) & (F.xxhash64(of["text"].cast("string")) == listed["text_hash"])

    # Both lists are right sides of semi joins, whose columns never meet those of the documents, whatever their names.
    dropped = broadcast_within(judged.filter("drop").select("doc_id", "text_hash"), MAX_DROPPED)
    kept = docs.join(dropped, same(docs, dropped), "left_anti")
    twice = judged.filter("twice and not drop").select("doc_id", "text_hash")
    if twice.limit(1).count():
        twice = broadcast_within(twice, MAX_DROPPED)
        kept = kept.join(twice, same(docs, twice), "left_anti").unionByName(kept.join(twice, same(docs, twice), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept
