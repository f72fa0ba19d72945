"""Tables in segments: each batch of writes is a segment of its own, and counts once its row is there.

Batches of a stream have numbers that only grow.  A batch whose number was seen does nothing, also after a compaction, for
the row that takes the place of others keeps their highest number.  Readers take the segments of one look.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.storage import exists, remove

_SEGMENTS = "segment string, place int, batch long"


class Segmented:
    """A folder of tables; ``TABLES`` names them with their schemas, ``bucket`` among the columns where rows are dealt by a key."""

    TABLES: dict[str, str] = {}
    #: Buckets of a key.
    BUCKETS = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._known: list[tuple[str, int, int]] | None = None

    def segments(self) -> list[tuple[str, int, int]]:
        """``(name, place, batch)`` of the segments that count, as of the first look; every write looks anew."""
        if self._known is None:
            stored = f"{self.path}/segments"
            rows = self.spark.read.schema(_SEGMENTS).parquet(stored).collect() if exists(self.spark, stored) else []  # one for each batch since the last compaction
            self._known = sorted((tuple(r) for r in rows), key=lambda r: r[1])
        return self._known

    def look(self) -> list[tuple[str, int, int]]:
        self._known = None
        return self.segments()

    def seen(self, batch: int | None) -> bool:
        return batch is not None and any(b >= batch for _, _, b in self.segments())

    def bucket(self, *key: Column | str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.BUCKETS)).cast("int")

    def read(self, table: str, places: bool = False) -> DataFrame:
        """The rows of a table, with the place of their segment if asked for."""
        known, schema = self.segments(), self.TABLES[table]
        if not known:
            return self.spark.createDataFrame([], schema + (", place int" if places else ""))
        rows = self.spark.read.schema(f"{schema}, segment string").parquet(f"{self.path}/{table}").filter(F.col("segment").isin([s for s, _, _ in known]))
        if places:
            rows = rows.withColumn("place", F.element_at(F.create_map(*[F.lit(x) for s, p, _ in known for x in (s, p)]), F.col("segment")))
        return rows.drop("segment")

    def begin(self) -> tuple[str, int]:
        """Name and place of a new segment."""
        return uuid.uuid4().hex, 1 + max((p for _, p, _ in self.segments()), default=-1)

    def put(self, rows: DataFrame, table: str, segment: str) -> None:
        by = ["bucket"] if "bucket" in self.TABLES[table] else []
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{table}/segment={segment}")

    def commit(self, segment: str, place: int, batch: int | None = None) -> None:
        self.spark.createDataFrame([(segment, place, -1 if batch is None else batch)], _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        self._known = None

    def replace(self, segment: str, place: int) -> None:
        """One segment in place of all that count; their files go.  A reader that looked before has to look anew."""
        old = self.segments()
        self.spark.createDataFrame([(segment, place, max(b for _, _, b in old))], _SEGMENTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/segments")
        self._known = None
        for name, _, _ in old:
            for table in self.TABLES:
                remove(self.spark, f"{self.path}/{table}/segment={name}")
