"""A stored keyword index: postings in blocks, statistics beside them, upserts and deletions, top-k that skips blocks.

On disk an index is a folder of tables, each in segments, one for each batch of writes:

* ``documents``: ``(num, id, namespace, len)``, one row for each version of a document, by bucket of the id;
* ``terms``: ``(num, tokens)``, the distinct tokens of a version, by bucket of the id: what a deletion takes back;
* ``blocks``: a few postings of one token and namespace with like impact, by bucket of the token, and in each row the
  largest term frequency and the least length in it, which bound the score whatever the statistics have become;
* ``changes``: how document frequencies, the number of documents and their length change, by bucket of the token;
* ``gone``: the numbers of the versions that the segment makes obsolete.

A write reads only the buckets of the ids that it names.  A search reads only the buckets of the tokens that it asks for.
A batch that is repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import index_tokens
from mnemospark.sources.segments import Segmented
from mnemospark.storage import broadcast_within, materialise, scratch

#: BM25's parameters and least idf.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
#: Postings in a block, term frequencies that blocks don't mix.
BLOCK, STEPS = 128, 16
#: Numbers of obsolete versions and long lists that may be broadcast.
MAX_SENT = 200_000

def saturation(tf: Column, length: Column, mean: Column) -> Column:
    """What a term frequency is worth in a document of this length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def rarity(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(MIN_IDF)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (num, namespace, tokens in order): a row for each document and distinct token, with the token's places."""
    for b in batches:
        lists = b.column(2)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        if not len(b) or not sizes.sum():
            continue
        coded = lists.flatten().dictionary_encode()
        code, doc = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(b)), sizes)
        at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((at, code, doc))
        code, doc, at = code[order], doc[order], at[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))))
        ends = np.append(first, len(code)).astype(np.int32)
        own = pa.array(doc[first])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(own), b.column(1).take(own), coded.dictionary.take(pa.array(code[first])), pa.array(sizes[doc[first]].astype(np.int32)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(at))],
            names=["num", "namespace", "token", "len", "tf", "places"],
        )


class KeywordIndex(Segmented):
    """An index in the folder ``path``."""

    TABLES = {
        "documents": "num long, id string, namespace string, len int, bucket int",
        "terms": "num long, tokens array<string>, bucket int",
        "blocks": "namespace string, token string, step int, top_tf int, low_len int, n int, nums array<long>, tfs array<int>, lens array<int>, places array<array<int>>, bucket int",
        "changes": "token string, documents long, tokens long, bucket int",
        "gone": "num long",
    }

    # --- reading

    def _gone(self) -> DataFrame:
        """Numbers of obsolete versions; a first or only segment has none."""
        return broadcast_within(self.read("gone"), MAX_SENT) if len(self.segments()) > 1 else self.spark.createDataFrame([], self.TABLES["gone"])

    def documents(self) -> DataFrame:
        """``(num, id, namespace, len)`` of the documents that count now."""
        return self.read("documents").join(self._gone(), "num", "left_anti")

    def totals(self) -> tuple[int, float]:
        """Number of documents and their mean length, summed from the changes of the segments."""
        r = self.read("changes").filter("token is null").agg(F.sum("documents").alias("n"), F.sum("tokens").alias("length")).first()
        return r.n or 0, (r.length or 0) / r.n if r.n else 0.0

    def _of(self, table: str, column: str, keys: DataFrame) -> DataFrame:
        """Rows whose ``column`` is among the distinct ``k`` of ``keys``, from the buckets of these alone."""
        numbers = [r.b for r in keys.select(self.bucket("k").alias("b")).distinct().collect()]  # no more than BUCKETS
        rows = self.read(table).filter(F.col("bucket").isin(numbers))
        return rows.join(keys.select("k"), rows[column] == F.col("k")).drop("k")

    def frequencies(self, tokens: DataFrame) -> DataFrame:
        """``(token, df)`` of the distinct ``tokens``."""
        return self._of("changes", "token", tokens.select(F.col("token").alias("k"))).groupBy("token").agg(F.sum("documents").alias("df"))

    def blocks(self, tokens: DataFrame) -> DataFrame:
        """The blocks of the distinct ``tokens``."""
        return self._of("blocks", "token", tokens.select(F.col("token").alias("k"))).drop("bucket")

    # --- writing

    def upsert(self, documents: DataFrame, batch: int | None = None) -> bool:
        """Put in ``(id, namespace, content)``, in place of what the ids had; a null or empty content takes the id out.

        Rows without an id do nothing; of rows that share an id one with the greatest content counts.  ``batch``
        numbers the write: one that isn't above those before does nothing, and the answer is False.
        """
        segments = self.look()
        if self.seen(batch):
            return False
        name, place = self.begin()
        with scratch():
            given = documents.filter("id is not null and id <> ''").groupBy("id").agg(F.max(F.struct(F.coalesce("content", F.lit("")).alias("content"), "namespace")).alias("x"))
            numbered = given.select("id", "x.namespace", index_tokens(F.col("x.content")).alias("tokens"), (F.col("x.content") != "").alias("stays")).withColumn("num", F.lit(place << 40) + F.monotonically_increasing_id())
            rows = materialise(numbered.withColumn("bucket", self.bucket("id")), "given")
            fresh = rows.filter("stays")
            gone = terms_gone = None
            if segments:
                old = self._of("documents", "id", rows.select(F.col("id").alias("k")))
                gone = materialise(old.join(self._gone(), "num", "left_anti").select("num", "id", "len"), "gone")
                numbers = [r.b for r in gone.select(self.bucket("id").alias("b")).distinct().collect()]
                known = self.read("terms").filter(F.col("bucket").isin(numbers))
                terms_gone = known.join(gone.select("num"), "num").select(F.explode("tokens").alias("token"))
            self._write(name, fresh, gone, terms_gone)
        self.commit(name, place, batch)
        return True

    def _write(self, name: str, fresh: DataFrame, gone: DataFrame | None, terms_gone: DataFrame | None) -> None:
        sized = fresh.withColumn("len", F.size("tokens"))
        dealt = sized.repartition("bucket", F.pmod("num", F.lit(8)))
        self.put(dealt.select("num", "id", "namespace", "len", "bucket"), "documents", name)
        self.put(dealt.select("num", F.array_distinct("tokens").alias("tokens"), "bucket"), "terms", name)
        posted = materialise(sized.select("num", "namespace", "tokens").mapInArrow(_postings, "num long, namespace string, token string, len int, tf int, places array<int>"), "postings")
        # Postings of a long list meet those of like frequency and length, so that a block's bound is close; whatever is
        # longer than a block is cut by the document's number, so that no list is ever in one task.
        step = F.least(F.col("tf"), F.lit(STEPS)) * 100 + F.floor(3 * F.log2("len")).cast("int")
        posted = posted.withColumn("step", step.cast("int"))
        parts = posted.groupBy("namespace", "token", "step").agg(F.count("*").alias("rows"))
        totals = parts.groupBy(F.col("namespace").alias("ns"), F.col("token").alias("t")).agg(F.sum("rows").alias("total")).filter(F.col("total") > BLOCK)
        long = parts.join(totals, parts.namespace.eqNullSafe(F.col("ns")) & (parts.token == F.col("t"))).select("ns", "t", F.col("step").alias("s"), F.ceil(F.col("rows") / BLOCK).alias("chunks"))
        long = broadcast_within(materialise(long, "long-lists"), MAX_SENT)
        cut = posted.join(long, posted.namespace.eqNullSafe(long.ns) & (posted.token == long.t) & (posted.step == long.s), "left")
        cut = cut.withColumn("step", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.col("step"))).withColumn("chunk", F.pmod(F.xxhash64("num"), F.coalesce("chunks", F.lit(1))))
        row = F.sort_array(F.collect_list(F.struct("num", "tf", "len", "places")))
        blocks = cut.groupBy("namespace", "token", "step", "chunk").agg(F.max("tf").alias("top_tf"), F.min("len").alias("low_len"), F.count("*").cast("int").alias("n"), row.alias("p"))
        blocks = blocks.select("namespace", "token", "step", "top_tf", "low_len", "n", F.col("p.num").alias("nums"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"), F.col("p.places").alias("places"), self.bucket("token").alias("bucket"))
        self.put(blocks.repartition("bucket", F.pmod(F.xxhash64("token", "step", "nums"), F.lit(8))).sortWithinPartitions("bucket", "token"), "blocks", name)
        changes = posted.groupBy("token").agg(F.count("*").alias("documents"))
        total = sized.agg(F.count("*").alias("documents"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"))
        if gone is not None:
            changes = changes.unionByName(terms_gone.groupBy("token").agg((-F.count("*")).alias("documents")))
            total = total.unionByName(gone.agg((-F.count("*")).alias("documents"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("tokens")))
        both = changes.withColumn("tokens", F.lit(0).cast("long")).unionByName(total.select(F.lit(None).cast("string").alias("token"), "documents", "tokens"))
        summed = both.groupBy("token").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).withColumn("bucket", F.coalesce(self.bucket("token"), F.lit(-1)))
        self.put(summed.repartition("bucket").sortWithinPartitions("token"), "changes", name)
        self.put((gone if gone is not None else self.spark.createDataFrame([], self.TABLES["gone"])).select("num"), "gone", name)

    def delete(self, ids: DataFrame, batch: int | None = None) -> bool:
        """Take out the documents with these ``id``s."""
        return self.upsert(ids.select("id", F.lit(None).cast("string").alias("namespace"), F.lit(None).cast("string").alias("content")), batch)

    # --- search

    def search(self, phrases: DataFrame, namespaces: DataFrame, limit: int) -> DataFrame:
        """``(query_id, id, keyword_score)``: at least the best ``limit`` of each query's namespaces, with their whole scores; see ``candidates``."""
        return self.scored(self.candidates(phrases, namespaces, limit))

    def _weighed(self, phrases: DataFrame, namespaces: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        """Asked phrases ``(query_id, namespace, phrase, weight)``, the blocks that answer them, and the mean length.

        A phrase of one token is answered by the token's blocks as they are stored, the others by blocks that are made of
        the places at which all their tokens meet.
        """
        n, mean = self.totals()
        asked = materialise(phrases.withColumn("key", F.array_join("phrase", " ")), "asked")
        keys = asked.select("key", "phrase").distinct()
        tokens = materialise(keys.select(F.explode("phrase").alias("token")).distinct(), "tokens")
        gone, found = self._gone(), self.blocks(tokens)
        single = found.join(keys.filter("size(phrase) = 1").select("key"), found.token == F.col("key")).select("namespace", "key", "top_tf", "low_len", "n", F.arrays_zip("nums", "tfs", "lens").alias("p"))
        single = single.select("namespace", "key", "top_tf", "low_len", "n", F.transform("p", lambda x: F.struct(x["nums"].alias("num"), x["tfs"].alias("tf"), x["lens"].alias("len"))).alias("p"))
        longer = keys.filter("size(phrase) > 1")
        if longer.limit(1).count():
            hits = materialise(self._phrase_hits(found, longer, gone), "phrase-hits")
            chunked = hits.withColumn("step", F.ceil(F.log2("tf"))).withColumn("chunk", F.pmod(F.xxhash64("num"), F.ceil(F.count("*").over(Window.partitionBy("namespace", "key", "step")) / BLOCK)))
            made = chunked.groupBy("namespace", "key", "step", "chunk").agg(F.max("tf").alias("top_tf"), F.min("len").alias("low_len"), F.count("*").cast("int").alias("n"), F.collect_list(F.struct("num", "tf", "len")).alias("p"))
            single = single.unionByName(made.select("namespace", "key", "top_tf", "low_len", "n", "p"))
            df = hits.groupBy("key").agg(F.count("*").alias("df"))
        else:
            df = keys.select("key").limit(0).withColumn("df", F.lit(0).cast("long"))
        df = df.unionByName(self.frequencies(tokens).withColumnRenamed("token", "key").join(keys.filter("size(phrase) = 1").select("key"), "key", "left_semi"))
        weighed = asked.join(df, "key").join(namespaces.select("query_id", "namespace").distinct(), "query_id")
        weighed = weighed.select("query_id", "namespace", "key", (F.col("times") * rarity(F.lit(n), F.col("df"))).alias("weight"))
        blocks = single.withColumn("block", F.monotonically_increasing_id())
        return materialise(weighed, "weighed"), materialise(blocks, "found-blocks"), mean

    def _phrase_hits(self, found: DataFrame, longer: DataFrame, gone: DataFrame) -> DataFrame:
        """``(namespace, key, num, tf, len)``: every token of a phrase votes for the place where the phrase would begin; a place with all votes counts."""
        parts = longer.select("key", F.size("phrase").alias("m"), F.posexplode("phrase").alias("off", "token"))
        met = found.join(parts, "token").select("namespace", "key", "m", "off", F.explode(F.arrays_zip("nums", "lens", "places")).alias("p"))
        places = met.select("namespace", "key", "m", F.col("p.nums").alias("num"), F.col("p.lens").alias("len"), F.explode("p.places").alias("at"), "off")
        starts = places.groupBy("namespace", "key", "m", "num", "len", (F.col("at") - F.col("off")).alias("start")).agg(F.count("*").alias("votes")).filter("votes = m")
        return starts.groupBy("namespace", "key", "num", "len").agg(F.count("*").cast("int").alias("tf")).join(gone, "num", "left_anti")

    def candidates(self, phrases: DataFrame, namespaces: DataFrame, limit: int) -> dict[str, DataFrame]:
        """Which documents can be among a query's best ``limit``; frames by name.

        First each query adds up, for each of its phrases, a few blocks with the highest bounds; the whole scores of the
        best of these documents bound from below what a result must reach.  Then every block is held against that: its own
        bound plus the highest bounds of the query's other phrases in the namespace.  Documents in no block that passes are never
        scored.  ``candidates`` is ``(query_id, num)``; ``weighed``, ``blocks`` and ``mean`` are what scoring needs.
        """
        weighed, blocks, mean = self._weighed(phrases, namespaces)
        heads = blocks.drop("p")
        bound = F.col("weight") * saturation(F.col("top_tf"), F.col("low_len"), F.lit(mean or 1.0))
        bounded = materialise(heads.join(weighed, ["namespace", "key"]).select("query_id", "namespace", "key", "block", "weight", "n", bound.alias("bound")), "bounded")
        tops = bounded.groupBy("query_id", "namespace", "key").agg(F.max("bound").alias("top"))
        best = Window.partitionBy("query_id", "namespace", "key").orderBy(F.desc("bound"), "block")
        few = bounded.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= 2 * limit)
        few = few.withColumn("before", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < 2 * limit)
        seeds = few.select("query_id", "block", "weight")
        opened = blocks.select("block", "p").join(seeds, "block").select("query_id", "weight", F.explode("p").alias("x")).select("query_id", "weight", "x.*")
        partial = opened.join(self._gone(), "num", "left_anti").groupBy("query_id", "num").agg(F.sum(F.col("weight") * saturation(F.col("tf"), F.col("len"), F.lit(mean or 1.0))).alias("part"))
        first = lambda df, by, k: df.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(by))).filter(F.col("r") <= k)
        found = {"weighed": weighed, "blocks": blocks, "mean": mean}
        tried = materialise(first(partial, F.desc("part"), 2 * limit).select("query_id", "num"), "tried")
        least = first(self.scored(found | {"candidates": tried}), F.col("keyword_score"), limit).groupBy("query_id").agg((-F.max("keyword_score")).alias("least"), F.count("*").alias("m"))
        floor = least.select("query_id", F.when(F.col("m") >= limit, F.col("least")).otherwise(0.0).alias("floor"))
        # A phrase is essential if it and those with lower bounds can reach the floor together.
        space = Window.partitionBy("query_id", "namespace")
        plan = tops.withColumn("upto", F.sum("top").over(space.orderBy("top", "key"))).withColumn("others", F.sum("top").over(space) - F.col("top")).join(floor, "query_id", "left").fillna(0.0, ["floor"])
        reaches = lambda c: c * (1 + 1e-9) + 2e-9 >= F.col("floor")
        plan = plan.filter(reaches(F.col("upto"))).select("query_id", "namespace", "key", "others", "floor")
        passing = materialise(bounded.join(plan, ["query_id", "namespace", "key"]).filter(reaches(F.col("bound") + F.col("others"))).select("query_id", "block"), "passing")
        named = blocks.select("block", F.col("p.num").alias("nums")).join(passing, "block").select("query_id", F.explode("nums").alias("num")).distinct()
        return found | {"candidates": materialise(named.join(self._gone(), "num", "left_anti"), "candidates"), "passing": passing, "bounded": bounded}

    def scored(self, found: dict) -> DataFrame:
        """``(query_id, id, keyword_score)`` of the candidates, over all phrases of their queries; negative, lower is better."""
        candidates, weighed, blocks = found["candidates"], found["weighed"], found["blocks"]
        postings = blocks.select("key", F.explode("p").alias("x")).select("key", "x.*")
        asked = weighed.select("query_id", "key", "weight").distinct()
        own = postings.join(candidates, "num").join(asked, ["query_id", "key"])
        score = own.groupBy("query_id", "num").agg((-F.sum(F.col("weight") * saturation(F.col("tf"), F.col("len"), F.lit(found["mean"] or 1.0)))).alias("keyword_score"))
        names = self.read("documents").select("num", "id")
        return score.join(names, "num").select("query_id", "id", "keyword_score")

    # --- upkeep

    def compact(self) -> None:
        """One segment in place of all: what is obsolete goes, and blocks are made anew from the stored postings.

        The old segments' files go when the new one counts; a search that began before must be begun again.
        """
        if len(self.look()) < 2:
            return
        name, place = self.begin()
        own = self.read("blocks").select("token", F.explode(F.arrays_zip("nums", "places")).alias("x")).select("token", F.col("x.nums").alias("num"), F.explode("x.places").alias("at"))
        texts = own.groupBy("num").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens"))
        with scratch():
            rows = self.documents().join(texts, "num", "left").select("num", "id", "namespace", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), self.bucket("id").alias("bucket"))
            self._write(name, materialise(rows, "compacted"), None, None)
        self.replace(name, place)
