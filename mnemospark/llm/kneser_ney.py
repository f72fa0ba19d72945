"""Quality classifier: an interpolated modified Kneser-Ney bigram model of words, trained on trusted text.

Words are runs of letters and digits; other marks, and the letters of scripts that leave no space between words, are
words of their own.  Each language has a model: a bigram's count is discounted by 1, 2 or 3+, what the discounts free
goes to the unigrams, which are counts of different left neighbours, discounted in the same way over an even
distribution.

The log-probability of a text is a sum over its words and bigrams, each times a weight of its own:

    log p(b | a) = [log p1(b) - log u] + log g(a) + [log(1 + kept(a, b) / (total(a) g(a) p1(b))) if ab was seen] + log u

with u for an unknown word and g(a) for the mass that context a hands down.  So a perplexity is one join of all words and
bigrams of a document with a table of weights, and a sum: the sharded count join.  Words and bigrams are 64-bit hashes,
seeded by the language.  The key range is cut into ``PASSES`` equal parts.  Each pass

1. counts the trusted bigrams of its part, joins what training knows of their two words, and has the part's weights;
2. sends the corpus' words and bigrams of its part to buckets of keys, where they meet the weights, and adds up.

A pass holds one part of the counts and of the corpus' bigrams on disk; the number of passes is fixed and that of
buckets follows the corpus.  What goes through a bucket is packed: a row has the sorted keys of some million words of
text with the places of their documents.  Keys that make up more than 1 / ``RARE`` of all are few by arithmetic; their
weights are sent to the workers, so that no bucket is hot.

A document's perplexity is exp of the mean negative log-probability of its words and its end.  A document is rejected if
that is over the ``QUANTILE`` quantile of its language: that of the trusted documents which were held out of training, as
the others look too good to their own model.  The mean over few words scatters more, so the quantile is taken of
excesses: log-perplexity over the language's median, divided by sqrt(1 + ``SHORT`` / words).  A language with fewer than
``FEW`` held-out documents, where the quantile would hang on one or two of them, takes the quantile of the excesses of all
languages above its own median.  Languages without a model or without held-out documents have no threshold; their
documents are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches
from mnemospark.storage import broadcast_within, discard, materialise

#: Discounts of counts 1, 2 and more where the counts of counts are too few to tell.
DISCOUNTS = (0.5, 0.75, 0.9)
#: One in so many trusted documents, by a hash of its id, sets the thresholds and trains nothing.
HELD_OUT = 5
#: Held-out quantile that is a language's threshold.
QUANTILE = 0.99
#: Words of a text whose scatter is twice (in variance) that of a long one, and held-out documents that a language's own quantile needs.
SHORT, FEW = 30, 1000
#: Most letters of a word; longer ones are cut.
PIECE = 6
#: Parts of the key range, words and bigrams of the corpus that one bucket gets about, and characters a word takes about.
PASSES, BUCKET, WORD_CHARS = 4, 2_000_000, 5
#: Characters that a worker cuts into words at once, which stay in its cache; those that it gathers before it sums or packs their words, and most documents among them.
BLOCK, GATHER, MOST_DOCS = 125_000, 4_000_000, 65_535
#: Tasks of a pass that add up, at least, words and bigrams that one of them may get, and sums that it holds at once.
TASKS, TASK_KEYS, HELD_SUMS = 12, 50_000_000, 4_000_000
#: Bytes of an Arrow batch: packed rows are large, and both sides of the pipe hold a batch while its buffers double.
PACKED_BYTES = 4 << 20
#: Keys with a share over one in so many are scored where the text is.
RARE = 4_000
#: Rows of the label table, and languages, that may be broadcast.
MAX_LABELS, MAX_LANGS = 2_000_000, 100_000

#: Scripts written without spaces (Thai to Tibetan, Myanmar, Khmer, Kana, Han), a word each letter.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_GAP = re.compile(r"\s")
#: Beyond all characters: a text's begin and end.
_BEGIN, _END = 0x110000, 0x110001
#: Odd numbers without a pattern, one for each place in a word, and what a space before a word adds.
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(PIECE)], np.uint64)
_SPACE_BEFORE = np.uint64(xxhash.xxh64_intdigest(b" ") | 1)
_MARK = {x: np.array([x], "<u4").tobytes() for x in (_BEGIN, _END)}


# --- words, bigrams and their keys


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """By code point: 0 for white space, 1 for what words are made of, 2 for a word of its own."""
    out = np.full(_END + 1, 2, np.uint8)
    for i in range(_BEGIN):
        c = chr(i)
        if c.isalnum() or c == "_":
            out[i] = 1
        elif c.isspace() and c != "\n":
            out[i] = 0
    for low, high in UNSPACED:
        out[low : high + 1] = 2
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The keys of bigrams."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def cell(keys: np.ndarray, cells: int) -> np.ndarray:
    """Which of ``cells`` equal parts of the key range."""
    return ((keys >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)


def pieces(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin, how long they are, and whether they begin a run of letters; runs are cut after ``PIECE`` letters."""
    letter = kind == 1
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    at = np.flatnonzero(first | (kind == 2))
    head = letter[at]
    long = np.ones(len(at), np.int64)
    long[head] = np.flatnonzero(last) - at[head] + 1
    n = (long + PIECE - 1) // PIECE
    run = np.repeat(np.arange(len(at)), n)
    place = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    return at[run] + PIECE * place, np.minimum(long[run] - PIECE * place, PIECE), head[run] & (place == 0)


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, in code points, and the words' hashes: code points times a factor by place, summed."""
    at, long, head = pieces(kinds().take(codes, mode="clip"))
    h = codes[at] * _FACTORS[0]
    for i in range(1, PIECE):
        some = np.flatnonzero(long > i)
        h[some] += codes[at[some] + i] * _FACTORS[i]
    h[head & (at > 0) & (codes[at - 1] == 32)] += _SPACE_BEFORE
    return at, h


class Chunk:
    """Words of some documents, one after the other: hashes with begin and end marks, the document of each, its row.

    A word carried over from the chunk before, whose document goes on here, is a context only.
    """

    def __init__(self, parts: list[bytes], rows: list[tuple], carried: np.ndarray):
        codes = np.frombuffer(b"".join(parts), "<u4")
        at, h = words(codes)
        self.rows, self.own, self.size = rows, slice(len(carried), None), len(codes)
        doc = np.cumsum(codes[at] == _BEGIN, dtype=np.int32) - np.int32(not len(carried))
        seeds = np.array([r[-1] for r in rows], np.int64).view(np.uint64)
        self.seq = np.concatenate((carried, mix(h, seeds[doc])))
        self.doc = np.concatenate((np.zeros(len(carried), np.int32), doc))
        inside = self.doc[1:] == self.doc[:-1]
        self.left, self.right, self.pair_doc = self.seq[:-1][inside], self.seq[1:][inside], self.doc[1:][inside]
        self.pairs = mix(self.left, self.right)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Rows (..., lang, text), with the language's hash, as chunks of about ``BLOCK`` characters.

    A longer text goes on in the next chunk; it is only cut before white space.
    """
    parts: list[bytes] = []
    rows: list[tuple] = []
    size, carried, full = 0, np.empty(0, np.uint64), min(BLOCK, GATHER)
    for b in batches:
        for *row, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
            rows.append(tuple(row))
            parts.append(_MARK[_BEGIN])
            at = 0
            while len(text) - at > full - size and (gap := _GAP.search(text, at + max(1, full - size))):
                parts.append(text[at : gap.start()].encode("utf-32-le", "surrogatepass"))
                c = Chunk(parts, rows, carried)
                yield c
                at, parts, rows, size, carried = gap.start(), [], [tuple(row)], 0, c.seq[-1:]
            parts += [text[at:].encode("utf-32-le", "surrogatepass"), _MARK[_END]]
            size += len(text) - at + 2
            if size >= full or len(rows) >= MOST_DOCS:
                yield Chunk(parts, rows, carried)
                parts, rows, size, carried = [], [], 0, np.empty(0, np.uint64)
    if rows:
        yield Chunk(parts, rows, carried)


def gathered(batches: Iterator[pa.RecordBatch], of: Callable[[Chunk, int], tuple]) -> Iterator[tuple]:
    """Rows and joined arrays that ``of`` takes from each chunk and its first row's number, for about ``GATHER`` characters at a time."""
    rows: list[tuple] = []
    parts: list[tuple] = []
    size = 0
    for c in chunks(batches):
        if parts and (size >= GATHER or len(rows) + len(c.rows) > MOST_DOCS):
            yield rows, *map(np.concatenate, zip(*parts, strict=True))
            rows, parts, size = [], [], 0
        parts.append(of(c, len(rows)))
        rows, size = rows + c.rows, size + c.size
    if parts:
        yield rows, *map(np.concatenate, zip(*parts, strict=True))


# --- training

_PAIRS = "lang long, key long, a long, b long, n long"


def _rows(schema: str, *columns) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "binary": pa.binary()}
    signed = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(signed, fields, strict=True)], names=[x for x, _ in fields])


def _texts(docs: DataFrame) -> DataFrame:
    """``(k1, k2, lang, text)``: two hashes that name a text in its language, the language's hash."""
    lang, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "text"))
    return docs.select(*_keys(docs), F.xxhash64(lang).alias("lang"), text.alias("text"))


def _keys(docs: DataFrame) -> list[Column]:
    lang, text = (F.coalesce(docs[c].cast("string"), F.lit("")) for c in ("lang", "text"))
    return [F.xxhash64(lang, text).alias("k1"), F.xxhash64(text, lang, F.lit(1)).alias("k2")]


def bigrams(texts: DataFrame, part: int, parts: int) -> DataFrame:
    """``(lang, key, a, b, n)``: how often each bigram of a part of the key range stands in the texts."""

    def of(c: Chunk, start: int) -> tuple:
        at = np.flatnonzero(cell(c.pairs, parts) == part)
        langs = np.array([r[-1] for r in c.rows], np.int64)
        return langs[c.pair_doc[at]], c.pairs[at], c.left[at], c.right[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, langs, pairs, left, right in gathered(batches, of):
            keys, first, n = np.unique(pairs, return_index=True, return_counts=True)
            yield _rows(_PAIRS, langs[first], keys, left[first], right[first], n.astype(np.int64))

    return texts.select("lang", "text").mapInArrow(run, _PAIRS).groupBy("lang", "key", "a", "b").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame, parts: int) -> DataFrame:
    """``(lang, w, total, c1, c2, c3, c4, more, lefts)``: how often a word is a context, of how many bigrams seen once, twice, thrice, four times, thrice or more, and how many different words stand before it."""
    out = None
    for part in range(parts):
        n = F.col("n")
        ends = F.explode(F.array(F.struct(F.col("a").alias("w"), n.alias("n"), F.lit(0).alias("left")), F.struct(F.col("b").alias("w"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("left"))))
        one = bigrams(texts, part, parts).select("lang", ends.alias("x")).select("lang", "x.*")
        is_n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
        one = one.groupBy("lang", "w").agg(F.sum("n").alias("total"), *[is_n(n == i).alias(f"c{i}") for i in (1, 2, 3, 4)], is_n(n >= 3).alias("more"), F.sum("left").alias("lefts"))
        one = materialise(one, "word-parts")
        out = one if out is None else out.unionByName(one)
    return materialise(out.groupBy("lang", "w").agg(*[F.sum(c).alias(c) for c in ("total", "c1", "c2", "c3", "c4", "more", "lefts")]), "words")


def _discount(i: int, ones: Column, twos: Column, here: Column, above: Column) -> Column:
    """The modified discount of count i from the counts of counts; the default where they give none between 0 and i."""
    d = F.when((ones > 0) & (here > 0), i - (i + 1) * ones / (ones + 2 * twos) * above / here)
    return F.when((d > 0) & (d < i), d).otherwise(F.lit(DISCOUNTS[i - 1]))


def language_stats(counts: DataFrame) -> DataFrame:
    """``(lang, d1, d2, d3, e1, e2, e3, handed, total1, even, unknown)``: discounts of bigrams and unigrams, what unigrams hand down, of how much, to what, and the log-probability of an unknown word."""
    lefts = F.col("lefts")
    s = counts.groupBy("lang").agg(
        *[F.sum(f"c{i}").alias(f"n{i}") for i in (1, 2, 3, 4)], *[F.sum(F.when(lefts == i, 1).otherwise(0)).alias(f"m{i}") for i in (1, 2, 3, 4)],
        F.sum(F.when(lefts >= 3, 1).otherwise(0)).alias("more"), F.sum("lefts").alias("total1"), (1.0 / (F.sum(F.when(lefts > 0, 1).otherwise(0)) + 1)).alias("even"),
    )
    for name, m in (("d", "n"), ("e", "m")):
        s = s.withColumns({f"{name}{i}": _discount(i, F.col(f"{m}1"), F.col(f"{m}2"), F.col(f"{m}{i}"), F.col(f"{m}{i + 1}")) for i in (1, 2, 3)})
    s = s.withColumn("handed", F.col("e1") * F.col("m1") + F.col("e2") * F.col("m2") + F.col("e3") * F.col("more"))
    return s.select("lang", "d1", "d2", "d3", "e1", "e2", "e3", "handed", "total1", "even", F.log(F.col("handed") * F.col("even") / F.col("total1")).alias("unknown"))


def _discounted(n: Column, name: str) -> Column:
    return n - F.when(n == 1, F.col(f"{name}1")).when(n == 2, F.col(f"{name}2")).otherwise(F.col(f"{name}3"))


class Model:
    """What training knows of words and languages, and the trusted texts, whose bigrams are counted part by part."""

    def __init__(self, trusted: DataFrame, parts: int):
        self.trusted, self.parts = trusted, parts
        counts = word_counts(trusted, -(-parts // 2))
        self.stats = broadcast_within(materialise(language_stats(counts), "languages"), MAX_LANGS)
        w = counts.join(self.stats, "lang")
        p1 = (F.when(F.col("lefts") > 0, _discounted(F.col("lefts"), "e")).otherwise(0.0) + F.col("handed") * F.col("even")) / F.col("total1")
        down = (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("more")) / F.col("total")
        w = w.select("lang", "w", "total", "unknown", p1.alias("p1"), F.when(F.col("total") > 0, down).alias("down"))
        weight = F.log("p1") - F.col("unknown") + F.coalesce(F.log("down"), F.lit(0.0))
        self.words = materialise(w.select("w", "p1", (F.col("total") * F.col("down")).alias("scale"), weight.alias("weight")), "word-weights")

    def weights(self, part: int) -> DataFrame:
        """``(key, weight)`` of the words and bigrams in one part of the key range."""
        left, right = self.words.select(F.col("w").alias("a"), "scale"), self.words.select(F.col("w").alias("b"), "p1")
        seen = bigrams(self.trusted, part, self.parts).join(left, "a").join(right, "b").join(self.stats.select("lang", "d1", "d2", "d3"), "lang")
        pairs = seen.select("key", F.log1p(_discounted(F.col("n"), "d") / (F.col("scale") * F.col("p1"))).cast("float").alias("weight"))
        high = F.shiftrightunsigned("w", 32)
        own = self.words.filter(F.shiftright(high * self.parts, 32) == part).select(F.col("w").alias("key"), F.col("weight").cast("float").alias("weight"))
        return pairs.unionByName(own)


# --- scoring

_SENT, _ADDED = "bucket int, kind int, key long, weight float, packed binary", "chunk long, at int, k1 long, k2 long, lang long, s double, n long"
_HEAD = "<qqqq"
_HEAD_BYTES = struct.calcsize(_HEAD)


def pack(chunk: int, docs: int, keys: np.ndarray, at: np.ndarray) -> bytes:
    """Number and documents of a chunk, sorted keys and the places of their documents; bytes of one rank stand together, which packs sorted keys well."""
    at = at.astype("<u2")
    body = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() + np.ascontiguousarray(at.view(np.uint8).reshape(-1, 2).T).tobytes()
    return struct.pack(_HEAD, chunk, docs, len(keys), len(body)) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(packed: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    chunk, docs, n, size = struct.unpack_from(_HEAD, packed)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[_HEAD_BYTES:], max_output_size=size), np.uint8)
    keys = np.ascontiguousarray(body[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1)
    return chunk, docs, keys, np.ascontiguousarray(body[8 * n :].reshape(2, n).T).view("<u2").reshape(-1)


def frequent(texts: DataFrame) -> np.ndarray:
    """Sorted keys with a share over 1.5 / ``RARE`` of all words and bigrams, and at most 2 * ``RARE`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys in gathered(batches, lambda c, start: (np.concatenate((c.seq[c.own], c.pairs)),)):
            total = len(keys)
            coarse = (keys >> np.uint64(48)).astype(np.int32)  # only where many keys begin alike can one of them be frequent
            keys, n = np.unique(keys[(np.bincount(coarse, minlength=1 << 16) * RARE >= total)[coarse]], return_counts=True)
            often = n * RARE >= total
            yield _rows("key long, n long, of long", keys[often], n[often].astype(np.int64), np.zeros(int(often.sum()), np.int64))
            yield _rows("key long, n long, of long", [None], [0], [total])

    counted = materialise(texts.select("lang", "text").mapInArrow(run, "key long, n long, of long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("of").alias("of")), "frequent")
    total = counted.agg(F.sum("of")).first()[0] or 0
    often = counted.filter(F.col("key").isNotNull() & (F.col("n") * (2 * RARE) >= total)).select("key").collect()  # at most 2 * RARE rows
    discard(counted)
    return np.sort(np.array([r.key for r in often], np.int64).view(np.uint64))


def _sender(part: int, parts: int, buckets: int, often: np.ndarray, weights: np.ndarray) -> Callable:
    """Chunks to packed rows by bucket, and for each chunk a row of its documents with what the frequent keys add."""

    begins = np.zeros(1 << 16, bool)  # how frequent keys begin: few of the others do
    begins[(often >> np.uint64(48)).astype(np.int32)] = True

    def of(c: Chunk, start: int) -> tuple:
        words, pairs = c.seq[c.own], c.pairs
        some, more = cell(words, parts) == part, cell(pairs, parts) == part
        keys, doc = np.concatenate((words[some], pairs[more])), np.concatenate((c.doc[c.own][some], c.pair_doc[more]))
        direct = np.zeros(len(c.rows))
        if len(often):
            near = np.flatnonzero(begins[(keys >> np.uint64(48)).astype(np.int32)])
            k = np.minimum(np.searchsorted(often, keys[near]), len(often) - 1)
            same = often[k] == keys[near]
            hit = near[same]
            direct += np.bincount(doc[hit], weights[k[same]], len(c.rows))
            rest = np.ones(len(keys), bool)
            rest[hit] = False
            keys, doc = keys[rest], doc[rest]
        n = np.bincount(c.pair_doc, minlength=len(c.rows)).astype(np.int64) if not part else np.zeros(len(c.rows), np.int64)
        return doc + np.int32(start), keys, direct, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, doc, keys, direct, n in gathered(batches, of):
            order = np.argsort(keys)
            keys, doc = keys[order], doc[order]
            names = np.array(rows, np.int64)
            # Chunks of the same texts have the same number, which does no harm: their sums and counts add up alike.
            chunk = xxhash.xxh64_intdigest(names.tobytes()) >> 1
            own = cell(keys, buckets)
            cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(keys)])) if len(keys) else [0]
            packed = [pack(chunk, len(rows), keys[i:j], doc[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            bucket = [int(own[i]) for i in cuts[:-1]] + [buckets * part // parts]
            docs = struct.pack(_HEAD, chunk, len(rows), 0, 0) + names.tobytes() + direct.tobytes() + n.tobytes()
            for i, row in enumerate([*packed, docs]):
                yield _rows(_SENT, [bucket[i]], [1 if i < len(packed) else 2], [None], [None], [row])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, kind): the weights of a bucket, then the packed keys that look for theirs.

    Sums go on over all buckets of a task, so that a document gives a row for a task, not for a bucket.
    """
    now, keys, values, ready = None, [], [], False
    held: dict[int, np.ndarray] = {}
    size = 0

    def summed() -> Iterator[pa.RecordBatch]:
        for number, s in held.items():
            some = np.flatnonzero(s)
            none = [None] * len(some)
            yield _rows(_ADDED, [number] * len(some), some.astype(np.int32), none, none, none, s[some], np.zeros(len(some), np.int64))
        held.clear()

    for b in batches:
        bucket, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.concatenate(([0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(bucket)])) if len(bucket) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if bucket[i] != now:
                now, keys, values, ready = bucket[i], [], [], False
            if kind[i] == 0:
                keys.append(b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                values.append(b.column(3).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.float64))
                continue
            if not ready:
                known = np.concatenate([*keys, np.empty(0, np.uint64)])
                order = np.argsort(known)
                known, worth, ready = known[order], np.concatenate([*values, np.empty(0)])[order], True
                keys, values = [], []
            for packed in b.column(4).slice(i, j - i):
                packed = packed.as_py()
                if kind[i] == 2:
                    chunk, n, _, _ = struct.unpack_from(_HEAD, packed)
                    body = memoryview(packed)[_HEAD_BYTES:]
                    names = np.frombuffer(body[: 24 * n], np.int64).reshape(n, 3)
                    yield _rows(_ADDED, [chunk] * n, np.arange(n, dtype=np.int32), *(names[:, x] for x in range(3)), np.frombuffer(body[24 * n : 32 * n], np.float64), np.frombuffer(body[32 * n :], np.int64))
                    continue
                chunk, docs, asked, at = unpack(packed)
                if not len(known):
                    continue
                k = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = known[k] == asked
                if chunk not in held:
                    if size > HELD_SUMS:
                        yield from summed()
                        size = 0
                    held[chunk], size = np.zeros(docs), size + docs
                held[chunk] += np.bincount(at[hit], worth[k[hit]], docs)
    yield from summed()


def scores(texts: DataFrame, model: Model) -> DataFrame:
    """``(k1, k2, lang, ppl, n)`` of every text ``(k1, k2, lang, text)`` in a language that the model knows; n is its words and its end."""
    spark, parts = texts.sparkSession, model.parts
    known = texts.join(model.stats.select("lang"), "lang", "left_semi").select("k1", "k2", "lang", "text")
    chars = known.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    buckets = parts * max(1, round(2 * chars / WORD_CHARS / BUCKET / parts))
    often, sums = frequent(known), None
    # An Arrow table: rows of a list would pass through Python workers of another kind, which stay on the executors.
    hot = broadcast_within(spark.createDataFrame(pa.table({"key": often.view(np.int64)})), 2 * RARE + 1)
    for part in range(parts):
        weights = materialise(model.weights(part), "weights")
        found = {r.key: r.weight for r in weights.join(hot, "key", "left_semi").collect()}  # at most 2 * RARE rows
        worth = np.array([found.get(k, 0.0) for k in often.view(np.int64).tolist()])
        bucket = F.shiftright(F.shiftrightunsigned("key", 32) * buckets, 32).cast("int")
        sent = weights.select(bucket.alias("bucket"), F.lit(0).alias("kind"), "key", "weight", F.lit(None).cast("binary").alias("packed")).unionByName(known.mapInArrow(_sender(part, parts, buckets, often, worth), _SENT))
        met = sent.repartition(max(TASKS, -(-round(2 * chars / WORD_CHARS) // (parts * TASK_KEYS))), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_added, _ADDED)
        one = met.groupBy("chunk", "at").agg(*[F.max(c).alias(c) for c in ("k1", "k2", "lang")], F.sum("s").alias("s"), F.sum("n").alias("n"))
        one = materialise(one, "sums")
        discard(weights)
        sums = one if sums is None else sums.unionByName(one)
    whole = sums.groupBy("k1", "k2", "lang").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(model.stats.select("lang", "unknown"), "lang")
    return materialise(whole.select("k1", "k2", "lang", F.exp(-F.col("unknown") - F.col("s") / F.col("n")).alias("ppl"), "n"), "scores")


# --- labels and thresholds


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``(doc_id, held)``: documents that a label calls good and none calls toxic or bad, and whether they are held out."""
    t = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return t.filter("doc_id is not null and quality = 1 and toxic = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held"))


def _only(docs: DataFrame, labels: DataFrame, held: bool) -> DataFrame:
    ids = broadcast_within(trusted_ids(labels).filter("held" if held else "not held").select("doc_id"), MAX_LABELS)
    return docs.join(ids, docs["doc_id"].cast("long") == ids["doc_id"], "left_semi")


def _scatter(n: Column) -> Column:
    return F.sqrt(1 + SHORT / n)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, few: int = FEW) -> DataFrame:
    """``(lang, centre, excess)`` from the ``(lang, ppl, n)`` of held-out documents, for ``threshold``."""
    known = scored.filter("ppl is not null").select("lang", F.log("ppl").alias("x"), "n")
    centres = known.groupBy("lang").agg(F.percentile_approx("x", 0.5, 10_000).alias("centre"))
    z = known.join(broadcast_within(centres, MAX_LANGS), "lang").select("lang", "centre", ((F.col("x") - F.col("centre")) / _scatter(F.col("n"))).alias("z"))
    own = z.groupBy("lang", "centre").agg(F.percentile_approx("z", quantile, 10_000).alias("own"), F.count("*").alias("held"))
    pooled = z.agg(F.percentile_approx("z", quantile, 10_000).alias("pooled"))
    return own.crossJoin(F.broadcast(pooled)).select("lang", "centre", F.when(F.col("held") >= few, F.col("own")).otherwise(F.col("pooled")).alias("excess"))


def threshold(n: Column) -> Column:
    """The perplexity that a text of n words, its end among them, may have; sums that differ in their last digits decide nothing."""
    return F.exp(F.col("centre") + F.col("excess") * _scatter(n) + 1e-9)


def judged(docs: DataFrame, labels: DataFrame, parts: int = PASSES) -> DataFrame:
    """``(k1, k2, perplexity, threshold, accepted)`` of the different texts of ``docs`` whose language has a model."""
    small_batches(docs.sparkSession, PACKED_BYTES)
    model = Model(_texts(_only(docs, labels, held=False)).select("lang", "text"), parts)
    scored = scores(_texts(docs), model)
    held = _only(docs, labels, held=True)
    held = held.select(*_keys(held)).join(scored, ["k1", "k2"])
    limits = broadcast_within(materialise(thresholds(held), "thresholds"), MAX_LANGS)
    out = scored.join(limits, "lang", "left").withColumn("threshold", threshold(F.col("n")))
    return materialise(out.select("k1", "k2", F.col("ppl").alias("perplexity"), "threshold", F.coalesce(F.col("ppl") <= F.col("threshold"), F.lit(True)).alias("accepted")), "judged")


def classify(docs: DataFrame, labels: DataFrame, parts: int = PASSES) -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, accepted)`` for every row of ``docs``.

    Null and empty texts are scored by their end mark alone; very long texts are read whole, some of it at a time; a null
    language is the language ''; repeated rows count and are repeated; null doc_ids are scored but never trusted; empty
    tables give no rows or accept everything; further columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = judged(own, labels, parts)
    out = own.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), *_keys(own)).join(found, ["k1", "k2"], "left")
    return out.select("doc_id", "lang", "perplexity", "threshold", F.coalesce("accepted", F.lit(True)).alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame, parts: int = PASSES) -> DataFrame:
    """``docs``, all columns, without the rows whose text the classifier rejects; null, empty, repeated and very long texts as in ``classify``.

    Rows of an empty label table all stay; an empty table gives no rows; further columns, of any name, are kept.  Texts
    move only if more than ``MAX_LABELS`` different ones are rejected.
    """
    out = broadcast_within(judged(docs, labels, parts).filter("not accepted").select("k1", "k2"), MAX_LABELS)
    k1, k2 = _keys(docs)
    return docs.join(out, (k1 == out["k1"]) & (k2 == out["k2"]), "left_anti")
