"""Aligning the tokens of two tokenizers by the bytes that they cover.

Every byte of a text gets a label: no token ends there, a token of A does, one of B does, or both.  A regular expression
scans the label string for the spans up to each both-label; the labels inside a span are counted, and so many tokens of A
and B make a group.  Between two neighbouring ends of any kind one token of A meets one of B: the labels that aren't
"none" are the links.  All of that is done for many texts at once, on joined byte strings.

Counts of id pairs over the corpus take three passes over written tables, and no text is encoded twice.  A document keeps
its distinct pairs with their number; partial sums in each task are added by pair.  The most frequent pairs, at most
``HEAD`` of them, are sent to all tasks; what is rarer is joined by pair, and since a rare pair has few rows, no key of
that join is hot.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemospark.llm.common import small_batches
from mnemospark.storage import materialise, scratch

#: Where the vocabularies are, on every machine.
VOCABULARIES = "/opt/tokenizers"
#: How the byte-level vocabulary cuts a text before merging; the mark that stands for a space in pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
#: Labels: none, an end in A, an end in B, both.
LABELS = np.frombuffer(b"nabx", np.uint8)
SPAN = re.compile(rb"[^x]*x")
#: Bytes of text that are labelled at once, pairs that a task sums at once, pairs that are sent to all tasks.
AT_ONCE, SUMMED, HEAD = 1 << 20, 4_000_000, 2_000_000
#: White space of this length overflows the fast encoder's pattern; such texts go to the other library.
_RUN = re.compile(r"\s{1000}")

_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary without its special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, letters = {t["id"] for t in spec["added_tokens"]}, _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.size = 1 + max(spec["model"]["vocab"].values())
        self.widths = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        self._fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._slow = Tokenizer.from_file(path)
        self._slow.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self._slow.encode(text, add_special_tokens=False).ids if _RUN.search(text) else self._fast.encode_ordinary(text)

    def joined(self, ids: list[int]) -> bytes:
        return self._fast.decode_bytes(ids)


class Pieces:
    """A SentencePiece vocabulary with byte pieces; it puts a space in front of a text."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        self._bytes = [self._bytes_of(i) for i in range(self.size)]
        self.widths = np.array([len(b) for b in self._bytes], np.int64)

    def _bytes_of(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabularies(folder: str) -> tuple[ByteLevel, Pieces]:
    """A and B; read once in each worker."""
    return ByteLevel(f"{folder}/byte_bpe_50k.json"), Pieces(f"{folder}/piece_bpe_32k.model")


@lru_cache(maxsize=4)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes for each separator (none, comma, bar, semicolon) and id: the decimal id, the separator, zeros; and their lengths."""
    text = np.array([[f"{i}{sep}" for i in range(size)] for sep in ("", ",", "|", ";")], "S8")
    return text.view("<u8"), np.char.str_len(text).astype(np.int64)


def labels(a_widths: np.ndarray, b_widths: np.ndarray) -> bytes:
    """The label string of joined texts whose tokens have these widths in bytes."""
    marks = np.zeros(int(a_widths.sum()), np.uint8)
    marks[np.cumsum(a_widths) - 1] = 1
    marks[np.cumsum(b_widths) - 1] += 2
    return LABELS[marks].tobytes()


def group_ends(label: bytes) -> np.ndarray:
    """Where the spans up to each both-label end."""
    return np.fromiter((m.end() for m in SPAN.finditer(label)), np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def aligned(a: list[list[int]], b: list[list[int]], vocab: tuple[ByteLevel, Pieces]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    """For each text (ids by A, ids by B, not empty, of the same bytes): groups, links, the groups' text, distinct pairs, their number."""
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    ids_a, ids_b = (np.fromiter((i for ids in x for i in ids), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
    wide_a = vocab[0].widths[ids_a]
    label = labels(wide_a, vocab[1].widths[ids_b])
    marks = np.frombuffer(label, np.uint8)
    text_ends = np.cumsum(wide_a)[np.cumsum(n_a) - 1]
    ends = group_ends(label)
    groups = np.searchsorted(ends, text_ends, side="right")  # groups up to each text's end
    at = np.flatnonzero(marks != LABELS[0])
    is_a, is_b = marks[at] != LABELS[2], marks[at] != LABELS[1]
    of_a, of_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b  # the tokens that meet before each end
    links = np.searchsorted(at, text_ends)  # ends up to each text's end

    last = np.searchsorted(at, ends - 1)  # the both-labels among the ends
    a_upto, b_upto = of_a[last] + 1, of_b[last] + 1  # tokens up to each group's end
    a_in, b_in = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
    place = np.concatenate((np.arange(len(ids_a)) + np.repeat(b_upto - b_in, a_in), np.arange(len(ids_b)) + np.repeat(a_upto, b_in)))
    sep = np.ones(len(place), np.int64)
    sep[a_upto - 1] = 2
    sep[len(ids_a) + b_upto - 1] = 3
    sep[len(ids_a) + np.cumsum(n_b) - 1] = 0
    text, length = _decimals(max(v.size for v in vocab))
    both = np.concatenate((ids_a, ids_b))
    words, lengths = np.empty(len(place), "<u8"), np.empty(len(place), np.int64)
    words[place], lengths[place] = text[sep, both], length[sep, both]
    letters = words.view(np.uint8)
    joined = letters[letters != 0].tobytes()
    cuts = _starts(lengths)[_starts(n_a + n_b)]

    owner = np.repeat(np.arange(len(a)), np.diff(links, prepend=0))
    pairs, times = np.unique(owner << 32 | (ids_a[of_a] * vocab[1].size + ids_b[of_b]), return_counts=True)
    parts = np.searchsorted(pairs, np.arange(len(a) + 1) << 32)
    for i, (g, k) in enumerate(zip(np.diff(groups, prepend=0).tolist(), np.diff(links, prepend=0).tolist(), strict=True)):
        yield g, k, joined[cuts[i] : cuts[i + 1]], pairs[parts[i] : parts[i + 1]] & 0xFFFFFFFF, times[parts[i] : parts[i + 1]]


def _encoded(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in _ROW.split(", ")]
    types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]

    def rows(ids: list, texts: list[str | None], vocab: tuple[ByteLevel, Pieces]) -> pa.RecordBatch:
        out: list[tuple] = [(i, 0, 0, 0, 0, "", b"", b"") for i in ids]
        full = [k for k, t in enumerate(texts) if t]
        a, b = [vocab[0].encode(" " + texts[k]) for k in full], vocab[1].encode_all([texts[k] for k in full])
        whole = [vocab[0].joined(x) == (want := f" {texts[k]}".encode()) and vocab[1].joined(y) == want for k, x, y in zip(full, a, b, strict=True)]
        full, a, b = ([x for x, ok in zip(xs, whole, strict=True) if ok] for xs in (full, a, b))
        if full:
            for k, x, y, (g, n, text, pairs, times) in zip(full, a, b, aligned(a, b, vocab), strict=True):
                out[k] = (ids[k], len(x), len(y), g, n, sha256(text).hexdigest(), pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(folder)
        for b in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held >= AT_ONCE:
                    yield rows(ids, texts, vocab)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows(ids, texts, vocab)

    return run


def encode(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """A row for each row of ``docs``: sizes, the digest of the groups, distinct pairs (A's id times B's vocabulary plus B's id) and their number, packed as 32-bit integers.

    Memory grows with the longest text, about 60 bytes for a byte of it.
    """
    small_batches(docs.sparkSession)
    a, b = vocabularies(folder)
    if a.size * b.size > 2**32:
        raise ValueError("pairs of these vocabularies don't fit 32 bits")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded(folder), _ROW)


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by pair over as many rows as a task may hold."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pairs, np.bincount(where, np.concatenate([t for _, t in parts]), len(pairs)).astype(np.int64)

    def batch(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(times)], names=["pair", "n"])

    total, parts, held = (np.empty(0, np.uint32), np.empty(0, np.int64)), [], 0
    for b in batches:
        parts.append((_flat(b.column(0)), _flat(b.column(1))))
        held += len(parts[-1][0])
        if held >= SUMMED:
            total, parts, held = merged([total, *parts]), [], 0
            if len(total[0]) >= SUMMED:
                yield batch(*total)
                total = (np.empty(0, np.uint32), np.empty(0, np.int64))
    pairs, times = merged([total, *parts])
    for k in range(0, len(pairs), 100_000):
        yield batch(pairs[k : k + 100_000], times[k : k + 100_000])


def pair_counts(encoded: DataFrame, b_size: int) -> DataFrame:
    """``(pair, n, best)``: links of each id pair in the whole corpus, and whether its B id has no pair with more."""
    counts = encoded.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "pair-counts")
    of_b = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    return materialise(counts.join(F.broadcast(of_b), F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _least_count(counts: DataFrame, head: int) -> int:
    """The smallest power of two such that at most ``head`` pairs have that count or more."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("m")).orderBy(F.desc("k")).collect()  # 63 rows at most
    least, held = 64, 0
    for r in sizes:
        held += r.m
        if held > head:
            break
        least = r.k
    return 2**least if least < 63 else 2**63 - 1


def score(encoded: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``encoded`` (with a unique ``row``) and its ``n_best`` and ``count_sum``."""
    spark = encoded.sparkSession
    least = _least_count(counts, head)
    top = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for b in batches:
            bests, sums, rare, rare_times = [], [], [], []
            for x, y in zip(b.column("pairs"), b.column("times"), strict=True):
                pairs, times = np.frombuffer(x.as_buffer(), "<u4").astype(np.int64), np.frombuffer(y.as_buffer(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
                hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
                at = at[hit]
                bests.append(int(times[hit][best[at]].sum()))
                sums.append(int((times[hit] * count[at]).sum()))
                rare.append(pairs[~hit])
                rare_times.append(times[~hit])
            keep = [c for c in b.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(rare_times, pa.list_(pa.int64()))],
                names=[*keep, "n_best", "count_sum", "rare", "rare_times"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name not in ("pairs", "times"))
    out = materialise(encoded.mapInArrow(scored, f"{fields}, n_best long, count_sum long, rare array<long>, rare_times array<long>"), "scored")
    left = out.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", "x.rare", "x.rare_times")
    more = left.join(counts.filter(F.col("n") < least), F.col("rare") == F.col("pair"))
    more = more.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("rare_times")).otherwise(0)).alias("more_best"), F.sum(F.col("rare_times") * F.col("n")).alias("more_sum"))
    if counts.filter(F.col("n") < least).limit(1).count():
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.drop("rare", "rare_times", "more_best", "more_sum")


def align(docs: DataFrame, folder: str = VOCABULARIES, head: int = HEAD) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have zeros and an empty
    digest.  Rows that repeat are repeated and count as often; a null doc_id is carried through; very long texts are
    encoded whole; of equal counts all are a B id's best; an empty table gives no rows; further columns are ignored.
    """
    b_size = vocabularies(folder)[1].size
    with scratch() as keep:
        rows = materialise(encode(docs, folder).withColumn("row", F.monotonically_increasing_id()), "encoded")
        out = keep(score(rows, pair_counts(rows, b_size), head))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
