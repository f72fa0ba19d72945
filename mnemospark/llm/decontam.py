"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case runs of letters and digits with one space between.  An item of m characters
may be met with k = floor(RATE * m) edits.  It is cut into k + 1 pieces: wherever the item stands with at most k edits,
one piece stands unchanged.  An Aho-Corasick automaton finds all pieces of a block of items in one pass over a text;
Myers' bit-parallel distance verifies each place.  An item too short for an edit is cut into one piece, itself, and is met where it stands as whole words.

Items come in blocks of a bounded size, one map over the documents for each block; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches, to_batch

#: Edits a character that an item may be met with, and fewest normalised characters of an item that counts.
RATE, MIN_CHARS = 0.1, 1
#: Characters of items that one automaton holds.
BLOCK_CHARS = 2_000_000

_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``(offset, piece)`` of k + 1 pieces whose lengths differ by one at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        bits[ch] = bits.get(ch, 0) | 1 << i
    return bits


def myers(m: int, bits: dict[str, int], text: str, k: int, anchored: bool = False) -> tuple[int, int]:
    """``(edits, end)`` of the pattern's best match in ``text``, the first such end; ``(k + 1, -1)`` if over k.

    Anchored, the match begins where the text begins; otherwise anywhere.
    """
    mask, top, get = (1 << m) - 1, 1 << (m - 1), bits.get
    pv, mv, score, best, end = mask, 0, m, k + 1, -1
    left = len(text)
    for j, ch in enumerate(text):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
            if not best:
                break
        left -= 1
        if score - left >= best:
            break
        ph = (ph << 1 | anchored) & mask
        pv = (mh << 1 & mask) | (~(xv | ph) & mask)
        mv = ph & xv
    return best, end


def branches(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the ranges of pieces above it, from the closest up, without the whole.

    Pieces are halved again and again.  If a range of c pieces stands with under c edits, so does one of its halves with
    fewer edits than pieces: the true place passes all checks above at least one of its unchanged pieces.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if 1 < b - a < n:
            for j in range(a, b):
                out[j].insert(0, (a, b))
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


class Matcher:
    """A block of items ``(item_id, text)``, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE, min_chars: int = MIN_CHARS):
        self.items = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if len(t) >= max(1, min_chars)]
        self.k = [int(rate * len(t)) for _, t in self.items]
        self.pieces = [pieces(t, k) for (_, t), k in zip(self.items, self.k, strict=True)]
        self.above = {n: branches(n) for n in {len(p) for p in self.pieces}}
        self.parts: dict[tuple[int, int, int], tuple[int, int, dict[str, int]]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for x, cut in enumerate(self.pieces):
            for j, (_, piece) in enumerate(cut):
                where.setdefault(piece, []).append((x, j))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.bits = [pattern_bits(t) for _, t in self.items]

    def part(self, x: int, a: int, b: int) -> tuple[int, int, dict[str, int]]:
        """Offset, length and pattern bits of pieces a to b of item x."""
        key = (x, a, b)
        if key not in self.parts:
            cut = self.pieces[x]
            text = "".join(piece for _, piece in cut[a:b])
            self.parts[key] = (cut[a][0], len(text), pattern_bits(text))
        return self.parts[key]

    def candidates(self, text: str) -> dict[int, list[int]]:
        """By item, where it would begin if a found piece stood in its place and all ranges above the piece allow it."""
        found: dict[int, set[int]] = {}
        if self.items:
            for end, (length, places) in self.automaton.iter(text):
                for x, j in places:
                    start = end + 1 - length - self.pieces[x][j][0]
                    for a, b in self.above[len(self.pieces[x])][j]:
                        offset, m, bits = self.part(x, a, b)
                        e = b - a - 1
                        low = max(0, start + offset - e)
                        if myers(m, bits, text[low : start + offset + m + e], e)[1] < 0:
                            break
                    else:
                        found.setdefault(x, set()).add(start)
        return {x: sorted(v) for x, v in found.items()}

    def verify(self, x: int, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        """``(edits, start, stop)`` of the item's best place near the starts."""
        item, k, best = self.items[x][1], self.k[x], None
        m, i = len(item), 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= k:
                j += 1
            low = max(0, starts[i] - k)
            window = text[low : starts[j] + m + k]
            i = j + 1
            at = window.find(item)
            if k == 0:
                for at in starts:  # with no edits to spare, "art" is not met in "party"
                    if (at == 0 or text[at - 1] == " ") and text[at + m : at + m + 1] in (" ", ""):
                        return 0, at, at + m
                return None
            if at >= 0:
                return 0, low + at, low + at + m
            edits, end = myers(m, self.bits[x], window, k if best is None else best[0] - 1)
            if end >= 0:
                back = window[max(0, end - m - k) : end][::-1]
                _, length = myers(m, pattern_bits(item[::-1]), back, edits, anchored=True)
                best = (edits, low + end - max(length, 0), low + end)
        return best

    def search(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """``(item_id, edits, start, stop)`` in the normalised text, the best place of each item that is met."""
        t = normalise(text)
        out = []
        for x, starts in sorted(self.candidates(t).items()):
            hit = self.verify(x, t, starts)
            if hit:
                out.append((self.items[x][0], *hit))
        return out

    def meets(self, text: str | None) -> bool:
        t = normalise(text)
        return any(self.verify(x, t, starts) for x, starts in self.candidates(t).items())


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in lists of about ``block_chars`` characters."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for i in range(n):
        yield [(r.item_id, r.text) for r in own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


_TYPES = {"doc_id": pa.int64(), "item_id": pa.int64(), "edits": pa.int64(), "start": pa.int64(), "stop": pa.int64()}


def find(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, edits, start, stop)``: a row for each document and item that it holds within the item's edits.

    The place is the one with the fewest edits, in the normalised text.  Null and empty texts hold nothing; very long ones are
    searched whole; null items and those without a letter or digit are no evidence; repeated documents and items give repeated rows; null ids are carried through; empty
    tables give no rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def over(block: list) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, min_chars)
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in matcher.search(t)]
                if rows:
                    yield to_batch(dict(zip(_TYPES, map(list, zip(*rows, strict=True)), strict=True)), _TYPES)

        return run

    schema = "doc_id long, item_id long, edits long, start long, stop long"
    out = docs.sparkSession.createDataFrame([], schema)
    for i, block in enumerate(blocks(items, block_chars)):
        found = own.mapInArrow(over(block), schema)
        out = found if not i else out.unionAll(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, all columns, without the documents that hold an item.  No row moves.

    Null and empty texts hold nothing and stay; very long ones are searched whole; repeated rows stay or go together; null
    items and those without a letter or digit are no evidence; an empty benchmark leaves all rows, an empty table gives
    none; further columns, of any name, are kept.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def over(block: list) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, min_chars)
            for b in batches:
                yield b.filter(pa.array([not matcher.meets(t) for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    for block in blocks(items, block_chars):
        docs = docs.mapInArrow(over(block), docs.schema)
    return docs
