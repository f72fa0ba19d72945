"""Line dedup through a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared word by word (runs of other characters than space, tab and the like).  Two lines are near if one
becomes the other by at most one edit: a word put in, left out or replaced; lines with fewer than ``MIN_WORDS`` words
only match if they are equal.  A line goes if an earlier line, by (doc_id, hash of the text, line number), equals it or is near to it.

1. Equal lines: a grouped minimum of the position by a 128-bit hash.
2. Which distinct lines can have a near partner at all?  One edit leaves the first or the second half of the shorter
   line as it is.  Each line has four half keys (as the shorter and as the longer partner, first and second half); lines
   that share none with another line are done.  This only spares work: no near pair is lost.
3. Of the others, the deletion neighbourhood is emitted: hashes of the line itself and of the line without its i-th word.
   Lines that agree without their i-th words differ by a replacement; a line that equals another without a word differs
   by an insertion.  Both are found as the smallest position among the rows of a key, so no pairs are emitted, however
   many lines share a key.
4. Each match with the earliest partner is verified on the words, by the lengths of the common beginning and end.

With a ``rate``, a line may also differ by rate times the words of the longer line, where those are two edits or more.

1. k edits cut the untouched words of a line of N words into k + 1 runs at most, so that near lines share a run of
   (N - k) / (k + 1) words.  Of each run of that many words the smallest hash of ``GRAM`` words in a row is a key; both
   lines have the one of the run that they share.  No near pair is lost.
2. Keys that one line alone has fall away, which are nearly all.  Of a pair that shares a key, lengths and the parities
   of the words' counts by hash tell whether it can be near at all.
3. What can be is verified by full edit distance: first with the ``PIVOTS`` earliest lines of each key, which settles large
   groups of near copies; then each line that is still open with all earlier lines of its keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.storage import broadcast_within, discard, materialise

#: Fewest words of a line that may match with an edit.
MIN_WORDS = 8
#: Words of a key for matches with several edits, lines of a key that the others meet first, and how many places of lines may be broadcast.
GRAM, PIVOTS, MAX_SHARED = 3, 2, 2_000_000
#: The first stand-in for a word, and the stand-ins before the surrogates, which are no characters, and in all.
_STAND_IN, _BEFORE_SURROGATES, _STAND_INS = 0x100, 0xD700, 0x10F700
_NO_ID = -(1 << 63)
_OTHER_SPACES = "\t\x0b\x0c\r"


def _plain(line: Column) -> Column:
    """The line's words with one space between; most lines are so already and are only looked at."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for x in ("  ", *_OTHER_SPACES):
        odd = odd | F.contains(line, F.lit(x))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x09\x0B-\x0D\x20]+", " "))).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc_hash, line_no, line)`` of the lines that aren't blank; a null doc_id comes first of all."""
    text = F.col("text").cast("string")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("doc_hash"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return own.filter(F.ltrim("line", F.lit(" " + _OTHER_SPACES)) != "")


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _half_keys(line: Column, n: Column) -> list[Column]:
    """Hashes of the halves, as a line of its own length and as the longer partner of one with a word less."""
    keys = []
    for length in (n, n - 1):
        first = F.floor(length / 2).cast("int")
        begin, end = (F.call_function("substring_index", line, F.lit(" "), count) for count in (first, first - length))
        keys += [F.xxhash64(begin, length * 2), F.xxhash64(end, length * 2 + 1)]
    return keys


def _variants(texts: DataFrame) -> DataFrame:
    """``(first, i, v1, v2)``: hashes of each line (i = 0) and of the line without its i-th word.

    A hash is the XOR over all words of the word's hash with its place, so that those of all shortened lines follow from
    running XORs: the words before i keep their places, those behind it move up by one.
    """
    words = texts.repartition("first").select("first", F.posexplode("words").alias("k", "w"))
    line = Window.partitionBy("first")
    until = line.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for seed in (1, 2):
        words = words.withColumn(f"a{seed}", F.xxhash64("w", "k", F.lit(seed))).withColumn(f"b{seed}", F.xxhash64("w", F.col("k") - 1, F.lit(seed)))
    words = words.drop("w")
    for x in ("a1", "b1", "a2", "b2"):
        words = words.withColumn(f"{x}_until", F.bit_xor(x).over(until)).withColumn(f"{x}_all", F.bit_xor(x).over(line))
    without = [F.col(f"a{s}_until").bitwiseXOR(F.col(f"a{s}")).bitwiseXOR(F.col(f"b{s}_all")).bitwiseXOR(F.col(f"b{s}_until")) for s in (1, 2)]
    rows = [F.struct((F.col("k") + 1).alias("i"), without[0].alias("v1"), without[1].alias("v2"))]
    whole = F.struct(F.lit(0).alias("i"), F.col("a1_all").alias("v1"), F.col("a2_all").alias("v2"))
    return words.select("first", F.explode(F.when(F.col("k") == 0, F.array(whole, *rows)).otherwise(F.array(*rows))).alias("x")).select("first", "x.i", "x.v1", "x.v2")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether word lists differ by one edit at most: the common beginning and end leave one word of the longer."""
    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return _once(at, lambda v: F.when(v == 0, F.size(x)).otherwise(v - 1))

    longer = F.greatest(F.size(a), F.size(b))
    return (a == b) | ((F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x as a lambda's argument: as a column it would be computed anew for each element that f's own lambdas look at."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _stand_in(i: Column) -> Column:
    """A character for each number from 0."""
    point = i + _STAND_IN + F.when(i >= _BEFORE_SURROGATES, 0x800).otherwise(0)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def _drawn(words: Column) -> Column:
    """A character for each word, drawn from its hash: two words may share one, so distances are no greater than by words."""
    return F.array_join(F.transform(words, lambda w: _stand_in(F.pmod(F.xxhash64(w), F.lit(_STAND_INS)))), "")


def _apart(x: Column, y: Column, most: Column) -> Column:
    return F.call_function("levenshtein", x, y, most.cast("int"))


def _looked_up(a: Column, b: Column, most: Column) -> Column:
    """The edits between word lists; -1 if over ``most``.  Each word of the two becomes a character of its own."""
    both = F.array_distinct(F.concat(a, b))
    as_text = lambda x, known: F.array_join(F.transform(x, lambda w: _stand_in(F.array_position(known, w) - 1)), "")
    return _once(both, lambda known: F.when(F.size(known) <= _STAND_INS, _apart(as_text(a, known), as_text(b, known), most)).otherwise(-1))


def _exactly(a: Column, b: Column, drawn_a: Column, drawn_b: Column, most: Column) -> Column:
    """The edits between word lists; -1 if over ``most``.  Words are looked up only where two of them share a drawn character."""
    words, characters = F.size(F.array_distinct(F.concat(a, b))), F.size(F.array_distinct(F.split(F.concat(drawn_a, drawn_b), "")))
    return F.when(words == characters, _apart(drawn_a, drawn_b, most)).otherwise(_looked_up(a, b, most))


def edit_distance(a: Column, b: Column, most: Column) -> Column:
    """The edits between word lists; -1 if over ``most``.  Most pairs that are over are so by drawn characters, which spares looking words up."""
    return F.when(_apart(_drawn(a), _drawn(b), most) >= 0, _looked_up(a, b, most)).otherwise(-1)


def _texts_of(lines: DataFrame, at: Column, wanted: DataFrame) -> DataFrame:
    """``(first, words)`` of the lines at the wanted places ``p``.  Texts move only if too many places are wanted to be sent around."""
    few = broadcast_within(wanted, MAX_SHARED)
    few = few if few is not wanted else wanted.hint("shuffle_hash")
    return lines.withColumn("first", at).join(few, F.col("first") == F.col("p")).select("first", F.split("line", " ").alias("words"))


def shared_runs(rate: float) -> list[tuple[int, int | None, int]]:
    """``(from, to, run)``: a line of so many words shares a run of so many words with each near line where the longer has two edits or more.

    A length may be in two ranges, with runs for shorter and for longer partners; the last range has no end.
    """
    most = lambda n: math.floor(n * rate + 1e-9)
    # The run is shortest where a longer line gains an edit, and these runs grow with the line.
    least = lambda n: min(-(-(m - most(m)) // (most(m) + 1)) for m in range(n, n + math.ceil(2 / rate) + 2))
    at = math.ceil(2 / rate - 1e-9)
    starts = [(at, least(at))]
    while starts[-1][1] < math.ceil((1 - rate) / rate - 1e-9):
        at += 1
        if least(at) > starts[-1][1]:
            starts.append((at, least(at)))
    ends = [n - 1 for n, _ in starts[1:]] + [None]
    return [(n - most(n), end, max(1, run)) for (n, run), end in zip(starts, ends, strict=True)]


def _run_keys(words: Column, rate: float) -> Column:
    """Of each run of words that a near line may share, the smallest hash of ``GRAM`` words in a row."""
    runs = shared_runs(rate)
    gram, n = min(GRAM, *[r for _, _, r in runs]), F.size(words)
    # Spark may look at the keys before the filter on the length, so they are safe for lines of any length.
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - gram, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(gram)]))

    widest = max(1, max(r for _, _, r in runs) - gram + 1)

    def lowest(m: Column, width: int, of: int) -> Column:
        """The minima of ``width`` numbers from those of ``of``, at least half as many, by a second look at them; the last ones are of fewer."""
        return m if width == of else F.zip_with(m, F.slice(m, F.lit(width - of + 1), n), lambda x, y: F.least(x, y))

    def of(known: dict[int, Column], low: int, high: int | None, run: int) -> Column:
        inside = (n >= max(low, run)) & (F.lit(True) if high is None else n <= high)
        width = run - gram + 1
        half = max(w for w in known if w <= width)
        keys = F.slice(lowest(known[half], width, half), F.lit(1), F.greatest(n - run + 1, F.lit(1)))
        return F.when(inside, keys).otherwise(F.array().cast("array<bigint>"))

    def doubled(known: dict[int, Column]) -> Column:
        w = max(known)
        if 2 * w > widest:
            return F.array_distinct(F.concat(*[of(known, *r) for r in runs]))
        return _once(lowest(known[w], 2 * w, w), lambda m: doubled(known | {2 * w: m}))

    return _once(hashes, lambda h: doubled({1: h}))


def _parities(words: Column) -> list[Column]:
    """128 bits: whether the words of a hash are odd in number.  An edit turns two of them at most."""
    def odd(half: int) -> Column:
        def bit(h: Column) -> Column:
            return F.when(F.shiftright(h, 6).bitwiseAND(1) == half, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))

        return F.aggregate(words, F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(bit(F.xxhash64(w))))

    return [odd(0), odd(1)]


def _within_rate(lines: DataFrame, at: Column, rate: float, distinct: DataFrame, settled: DataFrame) -> DataFrame:
    """``(h1, h2, near, edits)``: the lines of ``distinct`` that aren't in ``settled`` and have an earlier line within the rate, with such a line."""
    own = lines.filter(_n_words(F.col("line")) >= min(low for low, _, _ in shared_runs(rate)))
    rows = own.select("h1", F.explode(_once(F.split("line", " "), lambda w: _run_keys(w, rate))).alias("k"))
    by_key = Window.partitionBy("k").orderBy("h1")
    all_of_key = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("k", "h1", F.lag("h1").over(by_key).alias("before"), (F.first("h1").over(all_of_key) != F.last("h1").over(all_of_key)).alias("met"))
    met = materialise(rows.filter("met and (before is null or before <> h1)").select("k", "h1"), "met")

    places = distinct.select("h1", "h2", "first").join(met.select("h1").distinct(), "h1", "left_semi").join(settled.select("h1", "h2", F.lit(True).alias("done")), ["h1", "h2"], "left")
    places = materialise(places.select("h1", "h2", "first", F.coalesce("done", F.lit(False)).alias("done")), "places")
    s1, s2 = _parities(F.col("words"))
    told = _texts_of(lines, at, places.select(F.col("first").alias("p"))).select("first", F.size("words").alias("n"), s1.alias("s1"), s2.alias("s2"))
    told = materialise(told.groupBy("first").agg(*[F.first(c).alias(c) for c in ("n", "s1", "s2")]).join(places, "first"), "told")
    keyed = materialise(met.join(told.drop("h2"), "h1").select("k", "first", "n", "s1", "s2", "done"), "keyed")
    discard(met, places)

    own_n, by_n = F.col("n"), F.col("by.n")
    most = F.floor(F.greatest(own_n, by_n) * rate + 1e-9)
    odd = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"by.{s}"))) for s in ("s1", "s2")), F.lit(0))
    can_be = (F.col("by.first") < F.col("first")) & (F.abs(own_n - by_n) <= most) & (odd <= 2 * most)
    side = F.struct("first", "n", "s1", "s2")

    def verified(pairs: DataFrame) -> DataFrame:
        """``(first, near, edits)`` of pairs ``(first, by)``."""
        pairs = materialise(pairs.distinct(), "pairs")
        wanted = materialise(pairs.select(F.col("first").alias("p")).union(pairs.select("by")).distinct(), "wanted")
        # Characters are drawn once for a line, not for each pair, and words move only for pairs that are near by these.
        texts = materialise(_texts_of(lines, at, wanted).dropDuplicates(["first"]).withColumn("drawn", _drawn(F.col("words"))), "texts")
        most_of = lambda n, m: F.floor(F.greatest(n, m) * rate + 1e-9)
        rough = pairs.join(texts.select("first", "drawn"), "first").join(texts.select(F.col("first").alias("by"), F.col("drawn").alias("by_drawn")), "by")
        rough = rough.filter(_apart(F.col("drawn"), F.col("by_drawn"), most_of(F.length("drawn"), F.length("by_drawn"))) >= 0)
        rough = materialise(rough.select("first", "by"), "rough")
        both = rough.join(texts, "first").join(texts.select(F.col("first").alias("by"), F.col("words").alias("by_words"), F.col("drawn").alias("by_drawn")), "by")
        a, b, drawn = F.col("words"), F.col("by_words"), (F.col("drawn"), F.col("by_drawn"))
        near = both.withColumn("edits", _exactly(a, b, *drawn, most_of(F.size(a), F.size(b)))).filter("edits > 0")
        near = materialise(near.groupBy("first").agg(F.min(F.struct("by", "edits")).alias("x")).select("first", F.col("x.by").alias("near"), "x.edits"), "near")
        discard(pairs, wanted, texts, rough)
        return near

    earliest = keyed.select("k", side.alias("by"), F.row_number().over(Window.partitionBy("k").orderBy("first")).alias("turn")).filter(F.col("turn") <= PIVOTS)
    still = keyed.filter("not done")
    near = verified(still.join(earliest, (still["k"] == earliest["k"]) & can_be).select("first", F.col("by.first").alias("by")))
    # A table of its own, so that the join has a shuffle on both sides and a frequent key can be split.
    left = materialise(still.join(near.select("first"), "first", "left_anti"), "left")
    others = keyed.select("k", side.alias("by"))
    more = verified(left.join(others, (left["k"] == others["k"]) & can_be).select("first", F.col("by.first").alias("by")))
    out = materialise(near.unionByName(more).join(told.select("first", "h1", "h2"), "first").select("h1", "h2", "near", "edits"), "near")
    discard(told, keyed, left, near, more)
    return out


def duplicate_lines(docs: DataFrame, rate: float = 0.0, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, line_no, kept_doc_id, kept_line_no, edits, doc_hash)``: the lines that go, each with an earlier line that it repeats.

    One edit is allowed from ``min_words`` words on, and with a ``rate`` that share of the words of the longer line.
    ``edits`` is 0 for an equal line, else what sets the lines apart; the earlier line is the earliest equal one, else the earliest that the
    neighbourhood yields, which may itself repeat a still earlier line.  Blank lines and null texts have no rows.  Rows
    that share a doc_id come in the order of the XXH64 of their texts, which is ``doc_hash``; rows that share both are one
    document: they don't repeat one another.  A null doc_id is the smallest, and is null in the result.  An empty table gives no rows; further columns are ignored.
    """
    line, n = F.col("line"), F.col("n")
    hashed = _lines(docs).select("doc_id", "doc_hash", "line_no", _plain(line).alias("line")).withColumn("n", _n_words(line))
    hashed = hashed.select(
        "doc_id", "doc_hash", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"),
        *[F.when(n >= min_words, k).alias(f"k{i}") for i, k in enumerate(_half_keys(line, n))],
    )
    flat = materialise(hashed, "lines")
    at = F.struct(F.col("doc_id"), F.col("doc_hash"), F.col("line_no"))
    distinct = materialise(flat.groupBy("h1", "h2", "k0", "k1", "k2", "k3").agg(F.min(at).alias("first"), F.count("*").alias("copies")), "distinct")

    halves = distinct.filter("k0 is not null").select("h1", "h2", "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    met = halves.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    open_lines = materialise(halves.join(met, "k", "left_semi").select("h1", "h2", "first").distinct(), "open")

    texts = open_lines.join(_texts_of(flat, at, open_lines.select(F.col("first").alias("p"))).dropDuplicates(["first"]), "first")
    texts = materialise(texts.select("h1", "h2", "first", "words"), "texts")
    variants = materialise(_variants(texts), "variants")
    # Of each key: the earliest of the whole lines, of all shortened ones, and of those shortened in the same place.
    lowest = variants.groupBy("v1", "v2", "i").agg(F.min("first").alias("low"), F.count("*").alias("n"))
    per_key = Window.partitionBy("v1", "v2")
    lowest = lowest.withColumn("whole", F.min(F.when(F.col("i") == 0, F.col("low"))).over(per_key)).withColumn("short", F.min(F.when(F.col("i") > 0, F.col("low"))).over(per_key))
    # What a row of this key and place can be told by, if it is later: nearly all keys have one row and fall away here.
    lowest = lowest.withColumn("by", F.when(F.col("i") == 0, F.col("short")).otherwise(F.least("low", "whole"))).filter("by is not null and (n > 1 or by <> low)")
    told = variants.join(lowest.select("v1", "v2", "i", "by"), ["v1", "v2", "i"]).filter("by < first").groupBy("first").agg(F.collect_set("by").alias("bys"))
    pairs = told.join(texts, "first").select("h1", "h2", "first", "words", F.explode("bys").alias("by"))
    other = texts.select(F.col("first").alias("by"), F.col("words").alias("by_words"))
    near = pairs.join(other, "by").filter(within_one_edit(F.col("words"), F.col("by_words"))).groupBy("h1", "h2").agg(F.min("by").alias("near")).withColumn("edits", F.lit(1))
    near = materialise(near, "near")
    discard(variants, texts, open_lines)
    if rate:
        near = near.unionByName(_within_rate(flat, at, rate, distinct, near).withColumn("edits", F.col("edits").cast("int")))

    # A table of its own, so that the join with all lines has a shuffle on both sides and a frequent line can be split.
    groups = materialise(distinct.select("h1", "h2", "first", "copies").join(near, ["h1", "h2"], "left").filter("copies > 1 or near is not null"), "groups")
    discard(distinct)
    all_gone = flat.select("doc_id", "doc_hash", "line_no", "h1", "h2").join(groups, ["h1", "h2"]).withColumn("p", at).filter("p <> first or near is not null")
    kept = F.when(F.col("p") != F.col("first"), F.col("first")).otherwise(F.col("near"))
    no_id = lambda c: F.when(c != _NO_ID, c)
    out = all_gone.select("doc_id", "doc_hash", "line_no", kept.alias("kept"), F.when(F.col("p") != F.col("first"), 0).otherwise(F.col("edits")).alias("edits"))
    return out.select(no_id(F.col("doc_id")).alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), no_id(F.col("kept.doc_id")).alias("kept_doc_id"), F.col("kept.line_no").cast("long").alias("kept_line_no"), F.col("edits").cast("long").alias("edits"), "doc_hash")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the repeated lines taken out of the texts; documents left without a word go.

    ``n_chars``, where there is such a column, follows the text.  Documents that have no repeated line stay as they are,
    null and empty texts among them.  Rows that share doc_id and text are one document.  Very long texts and lines are
    read whole; an empty table gives no rows; further columns, of any name, are kept.
    """
    gone = duplicate_lines(docs).groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("doc_hash").alias("hash")).agg(F.collect_set(F.col("line_no").cast("int")).alias("lines"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # nested, so that no name can clash
    text = F.col("row")["text"].cast("string")
    both = rows.join(gone.hint("shuffle_hash"), (F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(_NO_ID)) == F.col("id")) & (F.xxhash64(text) == F.col("hash")), "left")
    cut = F.col("lines").isNotNull()
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("lines"), i)), "\n")
    both = both.select("row", F.when(cut, kept).alias("left")).filter(F.col("left").isNull() | F.col("left").rlike(r"[^\x09-\x0D\x20]"))
    new = {"text": F.col("left"), "n_chars": F.length("left")}
    own = {c: F.col("row")[c] for c in docs.columns}
    return both.select(*[F.when(F.col("left").isNotNull(), new[c].cast(docs.schema[c].dataType)).otherwise(own[c]).alias(c) if c in new else own[c].alias(c) for c in docs.columns])
