"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

A document's set is its distinct five-word shingles.  Each shingle draws a random permutation of the signature's slots,
one place a round, and offers the value round + uniform to the slot that is next; a slot keeps its least offer.  Offers of
later rounds are larger, so a document is done as soon as every slot has one: early stopping.  Rounds run over many
documents at once.

Equal sets are one class.  Classes that share a band of the signature are candidates: 40 bands of 6 slots miss a pair at
the threshold with probability 6e-9.  A bucket never emits its pairs.  In each of a few rounds it names one pivot, the
member with most links so far, and only pivots are held against members of other components; members of one component
need no comparison.  What a bucket still has in several components after that is compared in blocks, exactly, by a
breadth-first search over full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches
from mnemospark.operators.components import connected_components
from mnemospark.storage import broadcast_within, materialise, scratch

#: Words of a shingle; slots of a signature, bands and slots of a band; linked sets share this many hundredths.
WORDS, BANDS, ROWS, PERCENT = 5, 40, 6, 85
SLOTS = BANDS * ROWS
#: Rounds of pivots before the blocks.
PIVOTS = 3
#: Shingles whose permutations are held at once, and members of a chunk of a bucket.
HELD, CHUNK = 1 << 17, 2048
#: Rows of keys and of representatives that may be broadcast.
MAX_SENT = 1_000_000

_EMPTY, _UNIT = np.uint64(2**64 - 1), np.uint64(40)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh3_64_intdigest, b" ".join(words)
    if len(words) < WORDS:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - WORDS + 1
    hashes = (digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[WORDS - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, n))


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """64 random bits for each hash and round (the finaliser of SplitMix64)."""
    x = x + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash signatures (``len(sets)`` x ``slots``) of sets that aren't empty."""
    out = np.full((len(sets), slots), _EMPTY)
    flat, x, owner = out.reshape(-1), np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None  # what is left of each permutation, kept from the second round on
    for turn in range(slots):
        bits = _mixed(x, turn)
        pick = turn + ((bits >> _UNIT) * np.uint64(slots - turn) >> np.uint64(24)).astype(np.int64)
        slot = pick if order is None else order[rows, pick]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(turn) << _UNIT) | (bits & np.uint64((1 << 40) - 1)))
        open_ = (out == _EMPTY).any(axis=1)
        if not open_.any():
            break
        left = open_[owner]
        if order is None:
            x, owner, pick = x[left], owner[left], pick[left]
            order, rows = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1)), np.arange(len(x))
            order[rows, pick] = 0
        else:
            order[rows, pick] = order[rows, turn]
            if left.mean() < 0.7:
                x, owner, order = x[left], owner[left], order[left]
                rows = np.arange(len(x))
    return out


def _bands(signature: np.ndarray) -> list[int]:
    raw = signature.tobytes()
    return [xxhash.xxh3_64_intdigest(raw[k * ROWS * 8 : (k + 1) * ROWS * 8], seed=k) - 2**63 for k in range(BANDS)]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "size", "digest", "bands"]

    def rows(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        keys = iter([_bands(s) for s in signatures(full)] if full else [])
        columns = [ids, [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], [next(keys) if len(s) else None for s in sets]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=names)

    for b in batches:
        ids, sets, held = [], [], 0
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(doc_id)
            sets.append(shingles(text.as_py()))
            held += len(sets[-1])
            if held >= HELD:
                yield rows(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield rows(ids, sets)


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, digest, bands)`` of every row: the set's size, a 128-bit digest of it, its band keys."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketched, "doc_id long, size long, digest binary, bands array<long>")


def _members_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, digest, text): the set, where the text has the digest that is wanted."""
    for b in batches:
        nodes, found = [], []
        for node, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = shingles(text).tobytes()
            if xxhash.xxh3_128_digest(raw) == digest:
                nodes.append(node)
                found.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "hashes"])


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, hashes)`` of the ``wanted`` classes ``(node, digest, doc_id)``, cut from the text of one of their documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    few = broadcast_within(wanted.select("node", "digest", "doc_id"), MAX_SENT)
    return texts.join(few, texts["id"].eqNullSafe(few["doc_id"])).select("node", "digest", "text").mapInArrow(_members_sets, "node long, hashes binary").dropDuplicates(["node"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield b.select([0, 1]).filter(pa.array(same, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``(u, v)`` of ``pairs`` whose full sets are alike."""
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "of_u", "of_v").mapInArrow(_verified, "u long, v long")


def forest(sets: list[np.ndarray], parts: list[int], lefts: list[bool]) -> list[tuple[int, int]]:
    """Tree edges (positions) of the links among sets, where members of a part are joined already.

    With two chunks (``lefts`` differ) only pairs across them are compared: each chunk meets itself elsewhere.
    """
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    part, left, edges = np.unique(parts, return_inverse=True)[1], np.array(lefts), []
    across, todo = len(set(lefts)) > 1, np.ones(len(sets), bool)
    queue: list[int] = []
    while todo.any():
        now = queue.pop() if queue else int(np.flatnonzero(todo)[0])
        if not todo[now]:
            continue
        todo[now] = False
        other = todo & (part != part[now]) & (100 * np.minimum(sizes, sizes[now]) >= PERCENT * np.maximum(sizes, sizes[now]))
        if across:
            other &= left != left[now]
        other = np.flatnonzero(other)
        if not len(other):
            continue
        mark = np.zeros(len(ids), bool)
        mark[at[starts[now] : starts[now] + sizes[now]]] = True
        shared = np.array([np.count_nonzero(mark[at[starts[k] : starts[k] + sizes[k]]]) for k in other])
        hit = other[100 * shared >= PERCENT * (sizes[other] + sizes[now] - shared)].tolist()
        for k in hit:
            if part[k] != part[now]:
                edges.append((now, k))
                part[part == part[k]] = part[now]
        queue += hit
    return edges


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, left, node, comp, hashes) sorted by key and block: the links of each block."""
    held, rows = None, []

    def solved() -> pa.RecordBatch:
        found = forest([np.frombuffer(r[2], np.uint64) for r in rows], [r[1] for r in rows], [r[3] for r in rows]) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([rows[a][0] for a, _ in found], pa.int64()), pa.array([rows[b][0] for _, b in found], pa.int64())], names=["u", "v"])

    for b in batches:
        for key, block, left, node, comp, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (key, block) != held:
                if rows:
                    yield solved()
                held, rows = (key, block), []
            rows.append((node, comp, hashes, left))
    if rows:
        yield solved()


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v)`` links among ``members`` ``(key, node, comp)`` of a key: enough to reach whatever all links reach.

    A long list is cut into chunks; each pair of chunks is a block of its own.
    """
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct((F.least(x, own) * chunks + F.greatest(x, own)).alias("block"), (own <= x).alias("left")))
    placed = materialise(sized.select("key", F.explode(dealt).alias("at"), "node", "comp").select("key", "at.*", "node", "comp"), "blocks")
    rows = placed.join(sets, "node").select("key", "block", "left", "node", "comp", "hashes")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_block_links, "u long, v long")


def links(docs: DataFrame, classes: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Verified links ``(u, v)`` between ``classes`` ``(node, digest, doc_id, size, bands)``: enough to reach whatever all reach."""
    spark = docs.sparkSession
    banded = classes.select("node", "size", F.explode("bands").alias("key"))
    keys = broadcast_within(materialise(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys"), MAX_SENT)
    members = materialise(banded.join(keys, "key", "left_semi").select("key", "node", "size"), "members")
    wanted = classes.select("node", "digest", "doc_id").join(members.select("node").distinct(), "node", "left_semi")
    sets = materialise(full_sets(docs, materialise(wanted, "wanted")), "sets")
    found = tested = spark.createDataFrame([], "u long, v long")
    for turn in range(pivots + 1):
        comp = connected_components(found) if turn else spark.createDataFrame([], "node long, component long")
        degree = found.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        known = members.join(comp, "node", "left").join(degree, "node", "left")
        known = materialise(known.select("key", "node", "size", F.coalesce("component", "node").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree")), "known")
        heads = known.groupBy("key").agg(F.max(F.struct("degree", -F.col("node"), "size", "comp")).alias("head"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
        heads = heads.select("key", (-F.col("head.col2")).alias("pivot"), F.col("head.size").alias("p_size"), F.col("head.comp").alias("p_comp"))
        live = known.join(broadcast_within(materialise(heads, "heads"), MAX_SENT), "key")
        if turn == pivots:
            rest = materialise(live.select("key", "node", "comp"), "rest")
            break
        members = materialise(live.filter("node <> pivot").select("key", "node", "size"), "members")
        near = f"comp <> p_comp and 100 * least(size, p_size) >= {PERCENT} * greatest(size, p_size)"
        pairs = live.filter(near).select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
        pairs = materialise(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        found = materialise(found.union(verified(pairs, sets)), "links")
        tested = materialise(tested.union(pairs), "tested")
    return found.union(block_links(rest, sets)) if rest.limit(1).count() else found


def near_duplicates(docs: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents without words, null texts among them, have an empty set, link with nothing and are kept; under five words
    the whole sequence is the one shingle; very long texts count whole.  Rows that repeat are repeated.  A null doc_id is
    carried through; it names a component only where the whole component has none, and such rows are kept.  An empty
    table gives no rows; further columns are ignored.
    """
    with scratch() as keep:
        rows = materialise(sketches(docs), "sketches")
        grouped = rows.filter("size > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
        classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
        comp = connected_components(links(docs, classes, pivots))
        nodes = classes.select("digest", "node", F.col("doc_id").alias("first_doc")).join(comp, "node", "left").select("digest", "first_doc", F.coalesce("component", "node").alias("component"))
        smallest = nodes.groupBy("component").agg(F.min("first_doc").alias("component_id"))
        named = keep(materialise(nodes.join(smallest, "component").select("digest", "component_id"), "named"))
        keep(rows)
    one = rows.join(named, "digest", "left")
    out = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return one.select("doc_id", F.col("size").alias("n_shingles"), out.alias("component_id"), F.coalesce(F.col("doc_id") == out, F.lit(True)).alias("kept"))
