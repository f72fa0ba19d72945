"""A Merkle manifest of a data set: one hash tree for each source over its documents, one over the sources' roots.

Positions come from a range partitioning by tree and order: a row's index in its partition plus what earlier partitions
hold of the tree, so no tree is ever in one task.  ``FANOUT ** DEPTH`` neighbouring nodes are a block, held as one
contiguous matrix of 64-byte hex digests.  A block is reshaped by the fanout and hashed row by row, level by level; its
root is a node of the next, far smaller table, until each tree has one node.  Proofs come back down the same way: what a
block's own levels give, then what stands above the block.  A node's siblings are found by index arithmetic alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches
from mnemospark.storage import broadcast_within, materialise, scratch

FANOUT, DEPTH, HEX = 16, 3, 64
BLOCK = FANOUT**DEPTH
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of partition offsets (a row for each partition and tree that meet) that may be broadcast.
MAX_OFFSETS = 500_000

_NODE = "tree string, pos long, n long, digest string, payload string"


def height(n: int) -> int:
    """Levels of hashing from ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _hashed(rows: np.ndarray) -> bytes:
    return b"".join(sha256(r).hexdigest().encode() for r in rows)


def levels_of(digests: bytes, depth: int) -> list[np.ndarray]:
    """The matrices of a block's levels: the nodes given first, ``depth`` levels above them after."""
    out = [np.frombuffer(digests, np.uint8).reshape(-1, HEX)]
    for _ in range(depth):
        below = out[-1]
        whole = len(below) // FANOUT * FANOUT
        above = _hashed(below[:whole].reshape(-1, FANOUT * HEX)) + (_hashed(below[whole:].reshape(1, -1)) if whole < len(below) else b"")
        out.append(np.frombuffer(above, np.uint8).reshape(-1, HEX))
    return out


def siblings_of(level: np.ndarray) -> list[bytes]:
    """For every node of a level, the other nodes of its run, joined."""
    out: list[bytes] = []
    whole = len(level) // FANOUT * FANOUT
    for part, size in ((level[:whole], FANOUT), (level[whole:], len(level) - whole)):
        if len(part):
            at = np.arange(size - 1) + (np.arange(size - 1) >= np.arange(size)[:, None])
            out += [x.tobytes() for x in part.reshape(-1, size, HEX)[:, at].reshape(len(part), (size - 1) * HEX)]
    return out


def fold(leaf: str, proof: str, places: list[tuple[int, int]]) -> str:
    """The root that a leaf and its proof give; ``places`` are (position, nodes) in the leaf's tree, then in the tree of roots."""
    node, rest = leaf.encode(), memoryview(proof.encode())
    for pos, n in places:
        while n > 1:
            run = min(FANOUT, n - pos // FANOUT * FANOUT)
            own, others, rest = pos % FANOUT * HEX, rest[: (run - 1) * HEX], rest[(run - 1) * HEX :]
            node = sha256(b"".join((others[:own], node, others[own:]))).hexdigest().encode()
            pos, n = pos // FANOUT, -(-n // FANOUT)
    return node.decode()


def positions(nodes: DataFrame, *order: Column | str) -> DataFrame:
    """``nodes`` with ``pos``, the rank within ``tree`` by ``order``, and ``n``, the nodes of the tree."""
    cut = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    cut = materialise(cut.withColumn("part", F.shiftright("at", 33)), "ordered")
    pieces = cut.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(pieces.select("tree", "part", (earlier - F.col("start")).alias("shift"), F.sum("rows").over(tree).alias("n")), "offsets")
    return cut.join(broadcast_within(offsets, MAX_OFFSETS), ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by tree and position: a row for each block."""
    names = ["tree", "n", "block", "digests", "payloads", "root"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.string()]
    held: tuple | None = None
    digests, payloads = [], []

    def packed() -> pa.RecordBatch:
        joined = b"".join(digests)
        root = levels_of(joined, min(DEPTH, height(held[1])))[-1].tobytes().decode()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*held, joined, list(payloads), root], types, strict=True)], names=names)

    for b in batches:
        for tree, pos, n, digest, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
            now = (tree, n, pos // BLOCK)
            if now != held:
                if held:
                    yield packed()
                held, digests, payloads = now, [], []
            digests.append(digest.encode())
            payloads.append(payload)
    if held:
        yield packed()


def blocks(nodes: DataFrame) -> DataFrame:
    """``(tree, n, block, digests, payloads, root)`` from nodes with positions."""
    dealt = nodes.select("tree", "pos", "n", "digest", "payload", F.floor(F.col("pos") / BLOCK).alias("block")).repartition("tree", "block").sortWithinPartitions("tree", "pos")
    return materialise(dealt.drop("block").mapInArrow(_pack, "tree string, n long, block long, digests binary, payloads array<string>, root string"), "blocks")


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with what stands above each: a row for each node, with its whole proof."""
    names = ["tree", "pos", "n", "digest", "payload", "root", "proof"]
    for b in batches:
        for tree, n, block, digests, payloads, above, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
            levels = levels_of(digests, min(DEPTH, height(n)))
            beside, upper, size = [siblings_of(x) for x in levels[:-1]], above.encode(), len(payloads)
            for k in range(0, size, 1024):  # a batch of some MB
                rows = range(k, min(size, k + 1024))
                proofs = [b"".join([*(s[i // FANOUT**d] for d, s in enumerate(beside)), upper]).decode() for i in rows]
                own = [levels[0][i].tobytes().decode() for i in rows]
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * m), pa.array([block * BLOCK + i for i in rows], pa.int64()), pa.array([n] * m, pa.int64()), pa.array(own), pa.array(payloads[k : k + m], pa.string()), pa.array([root] * m), pa.array(proofs)], names=names
                )


def rooted(nodes: DataFrame) -> DataFrame:
    """The ``blocks`` of nodes with positions, with their tree's ``root`` and the ``proof`` that stands above each block."""
    packed = blocks(nodes)
    if not packed.filter("block > 0").limit(1).count():
        return packed.withColumn("proof", F.lit(""))
    parents = packed.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("payload"))
    upper = materialise(descended(rooted(parents)).select("tree", F.col("pos").alias("block"), "root", "proof"), "upper")
    return packed.drop("root").join(upper, ["tree", "block"])


def descended(held: DataFrame) -> DataFrame:
    """``(tree, pos, n, digest, payload, root, proof)``: each node's siblings up to its tree's root."""
    small_batches(held.sparkSession)
    return held.select("tree", "n", "block", "digests", "payloads", "proof", "root").mapInArrow(_descend, f"{_NODE}, root string, proof string")


def hashed_fields(*fields: Column) -> Column:
    """The leaf digest: each field as byte count, colon and value, or a dash for null."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]), 256)


def manifest(docs: DataFrame, given: Column | None = None) -> DataFrame:
    """``(doc_id, source, given, leaf, pos, n, subroot, rank, n_sources, root, proof)`` for every row of ``docs``.

    ``leaf`` is the digest of the row's ``FIELDS``, ``pos`` its place among the ``n`` rows of its source, ``rank`` the
    source's place among the ``n_sources``; ``proof`` holds the siblings' digests from the leaf to the root, joined.
    ``given`` (default null) is a leaf that somebody claims for the row, carried through.

    Nulls in any field count as nulls; rows without a source are a tree of their own, the first; rows without a doc_id
    come first in their tree; rows that share a doc_id follow each other by their leaves, and rows that repeat are leaves
    of their own; empty and very long texts are hashed whole, where they stand; an empty table gives no rows; further
    columns are ignored.
    """
    leaf = hashed_fields(*[docs[c] for c in FIELDS])
    base = docs.select(
        F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n")).alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("digest"),
        (F.lit(None) if given is None else given).cast("string").alias("given"),
    )
    payload = F.concat(F.coalesce("given", F.lit("")), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    with scratch() as keep:
        placed = positions(base, F.col("doc_id").asc_nulls_first(), "digest")
        held = keep(rooted(placed.select("tree", "pos", "n", "digest", payload.alias("payload"))))
        both = descended(held).join(keep(_subroots(held)), "tree")
    parts = F.split("payload", " ")
    filled = lambda c: F.when(c != "", c)
    return both.select(
        filled(parts[1]).cast("long").alias("doc_id"), F.when(F.col("tree") != "n", F.expr("substring(tree, 2)")).alias("source"), filled(parts[0]).alias("given"), F.col("digest").alias("leaf"), "pos", "n",
        F.col("root").alias("subroot"), "rank", "n_sources", "top", F.concat("proof", "over").alias("proof"),
    ).withColumnRenamed("top", "root")


def _subroots(held: DataFrame) -> DataFrame:
    """``(tree, rank, n_sources, top, over)``: the tree of the sources' roots."""
    roots = held.filter("block = 0").select(F.lit("r").alias("tree"), F.col("tree").alias("payload"), F.col("root").alias("digest"))
    top = descended(rooted(positions(roots, "payload").select("tree", "pos", "n", "digest", "payload")))
    return materialise(top.select(F.col("payload").alias("tree"), F.col("pos").alias("rank"), F.col("n").alias("n_sources"), F.col("root").alias("top"), F.col("proof").alias("over")), "subroots")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        leaf, proof, pos, n, rank, m = (b.column(c).to_pylist() for c in ("claimed", "proof", "pos", "n", "rank", "n_sources"))
        roots = [fold(a, p, [(i, k), (j, q)]) for a, p, i, k, j, q in zip(leaf, proof, pos, n, rank, m, strict=True)]
        keep = [c for c in b.schema.names if c != "claimed"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(roots, pa.string())], names=[*keep, "folded_root"])


def verify(rows: DataFrame) -> DataFrame:
    """``manifest`` rows with ``folded_root``, from ``given`` (or else ``leaf``) and the proof, and ``verified``."""
    claimed = rows.withColumn("claimed", F.coalesce("given", "leaf"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return claimed.mapInArrow(_folded, f"{fields}, folded_root string").withColumn("verified", F.col("folded_root") == F.col("root"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """Every row's proof, held against a leaf whose text was lower-cased where 5 divides the CRC-32 of the doc_id."""
    changed = [F.translate(docs[c].cast("string"), _UPPER, _LOWER) if c == "text" else docs[c] for c in FIELDS]
    given = F.when(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 5 == 0, hashed_fields(*changed))
    rows = verify(manifest(docs, given))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _sql_tree(name: str, nodes: str, top: int) -> str:
    """CTEs of a tree over ``nodes`` (tree, pos, n, h): ``{name}k`` are the nodes and ``{name}rk`` the runs of level k."""
    out = [f"{name}0 as (select tree, pos, n, h from {nodes})"]
    for k in range(top):
        out.append(f"{name}r{k} as (select tree, pos // 16 as run, any_value(n) as n, string_agg(h, '' order by pos) as hs from {name}{k} group by tree, pos // 16)")
        out.append(f"{name}{k + 1} as (select tree, run as pos, (n + 15) // 16 as n, case when n > 1 then sha256(hs) else hs end as h from {name}r{k})")
    return ",\n".join(out)


def _sql_fold(name: str, before: str, top: int, runs: str, pos: str, tree: str) -> str:
    """CTEs ``{name}k`` that add level k's siblings to ``proof`` and fold ``now``."""
    out = []
    for k in range(top):
        own = f"({pos} // {16**k}) % 16 * 64"
        left, right = f"case when r.n > 1 then substr(r.hs, 1, {own}) else '' end", f"case when r.n > 1 then substr(r.hs, {own} + 65) else '' end"
        out.append(
            f"{name}{k} as (select d.* replace (d.proof || {left} || {right} as proof, case when r.n > 1 then sha256({left} || d.now || {right}) else d.now end as now) "
            f"from {before if not k else f'{name}{k - 1}'} d join {runs}r{k} r on r.tree = {tree} and r.run = d.{pos} // {16 ** (k + 1)})"
        )
    return ",\n".join(out)


def _sql_leaf(text: str) -> str:
    fields = " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
    return f"sha256({fields})"


_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda c, b: "
    "xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: case when t & 1 = 1 then xor(t >> 1, 3988292384::BIGINT) else t >> 1 end))), 4294967295::BIGINT)"
)
#: Trees of up to 16 ** 6 leaves and 16 ** 4 sources.
MERKLE_SQL = f"""
with d as (select doc_id, coalesce('s' || source, 'n') as tree, {_sql_leaf("text")} as leaf,
    case when {_CRC} % 5 = 0 then {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as given from documents),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n, leaf as h from d),
{_sql_tree("t", "p", 6)},
s as (select 'r' as tree, row_number() over (order by tree) - 1 as pos, count(*) over () as n, h, tree as source from t6),
{_sql_tree("u", "s", 4)},
f as (select p.doc_id, p.leaf, p.tree, p.pos, s.pos as rank, s.h as subroot, coalesce(p.given, p.leaf) as now, '' as proof from p join s on s.source = p.tree),
{_sql_fold("a", "f", 6, "t", "pos", "d.tree")},
{_sql_fold("b", "a5", 4, "u", "rank", "'r'")}
select doc_id, leaf, subroot, u4.h as root, sha256(proof) as proof_sha256, now as folded_root, now = u4.h as verified from b3, u4
"""
