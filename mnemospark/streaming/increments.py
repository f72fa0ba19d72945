"""Incremental runs with Structured Streaming: file sources, one-shot triggers, upserts by batch, windowed counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from mnemospark.operators.monitoring import FLOOD
from mnemospark.sources.segments import Segmented


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Whatever has come since the last run, once; the checkpoint remembers how far it went."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunCounts(StreamingQueryListener):
    """What observed streams have counted, batch by batch; the counts come with the run, and nothing is read for them.

    A stream is observed with ``stream.observe(name, ...)``; ``spark.streams.addListener`` takes this listener.  The last
    ``BATCHES`` batches are kept.
    """

    BATCHES = 1000

    def __init__(self) -> None:
        self.rows: deque[tuple[str, int, str, dict]] = deque(maxlen=self.BATCHES)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, metrics in p.observedMetrics.items():
            self.rows.append((str(p.id), p.batchId, name, metrics.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, name: str) -> dict[str, int]:
        """Sums of the counts under a name, each batch of a stream once."""
        batches = {(query, batch): metrics for query, batch, n, metrics in self.rows if n == name}
        return {k: sum(m[k] or 0 for m in batches.values()) for k in {k for m in batches.values() for k in m}}


def counted(writes: DataFrame, name: str = "mirror") -> DataFrame:
    """Writes for the mirror, observed: how many came, and how many of them do nothing."""
    blank = (F.coalesce("id", F.lit("")) == "") | (F.coalesce("text", F.lit("")) == "")
    return writes.observe(name, F.count("*").alias("writes"), F.count_if(blank).alias("blank"))


class Mirror(Segmented):
    """The keyword index's source of truth: a base and the batches since, by bucket of the id.

    Reading meets a base and ``DELTAS`` batches at most, however many there have been.
    """

    TABLES = {"writes": "id string, namespace string, text string, seq long, bucket int"}
    #: Batches that may lie on the base before they become one with it.
    DELTAS = 8

    def batch(self, writes: DataFrame, number: int) -> None:
        """A function for ``foreachBatch``: ``(seq, id, namespace, text)``, of which the last write of an id counts.

        A write without id or text does nothing; with a column ``deleted`` its true rows take the id out.  A batch that
        is repeated changes nothing.
        """
        self.look()
        if self.seen(number):
            return
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in writes.columns else F.lit(False)
        ok = writes.filter("id is not null and id <> ''").withColumn("text", F.when(~deleted, F.col("text"))).filter((F.coalesce("text", F.lit("")) != "") | deleted)
        last = ok.groupBy("id").agg(F.max_by(F.struct("namespace", "text", "seq"), "seq").alias("x")).select("id", "x.*")
        name, place = self.begin()
        self.put(last.withColumn("bucket", self.bucket("id")).repartition("bucket"), "writes", name)
        self.commit(name, place, number)
        if len(self.segments()) > self.DELTAS:
            self.compact()

    def _last(self) -> DataFrame:
        rows, order = self.read("writes", places=True), F.struct("place", "seq")
        return rows.groupBy("id", "bucket").agg(F.max_by(F.struct("namespace", "text", "seq"), order).alias("x")).select("id", "x.*", "bucket").filter("text is not null")

    def compact(self) -> None:
        name, place = self.begin()
        self.put(self._last(), "writes", name)
        self.replace(name, place)

    def rows(self) -> DataFrame:
        """``(id, namespace, text)`` as the writes have left it."""
        return self._last().select("id", "namespace", "text")


def mirror(index_path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the mirror at ``index_path``."""
    return lambda writes, number: Mirror(writes.sparkSession, index_path).batch(writes, number)


def kept(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each batch beside the others; one that is repeated takes its own place."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def mirrored(spark: SparkSession, index_path: str) -> DataFrame:
    """``(id, namespace, text)``: the last write of each id."""
    return Mirror(spark, index_path).rows()


def flood_counts(writes: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "2 hours", threshold: int = FLOOD) -> DataFrame:
    """Writes of a source in sliding windows above the threshold; events later than ``late`` are let go."""
    counts = writes.withWatermark("ts", late).groupBy(F.window("ts", window, slide), F.coalesce("source", F.lit("(unknown)")).alias("source")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > threshold).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "source", "n")
