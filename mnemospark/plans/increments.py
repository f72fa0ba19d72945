"""Near-duplicate groups that are kept from run to run.

What a run needs from earlier ones is stored: the records that it may have to compare with, by group, and the label of
each record that has a duplicate.  A group is dirty if a record of it arrives, whatever time the record claims for itself,
so that a late one isn't missed.  New records are compared with their group; new links are contracted to links between
labels, and only labels that they touch are written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import reconcile as R
from mnemospark.operators.components import connected_components
from mnemospark.sources.segments import Segmented
from mnemospark.storage import materialise, scratch

_KEYS = ["namespace", "subject"]


class DuplicateGroups(Segmented):
    """The state in the folder ``path``; thresholds and judge must stay the same from run to run."""

    TABLES = {
        "records": "id string, namespace string, subject string, content string, why string, claim_type string, supersedes array<string>, vector array<double>, bucket int",
        "labels": "id string, cluster string, bucket int",
    }

    def __init__(self, spark, path: str, threshold: float = R.THRESHOLD, max_group: int | None = R.MAX_GROUP, judge: R.Judge = R.same_skeleton):
        super().__init__(spark, path)
        self.threshold, self.max_group, self.judge = threshold, max_group, judge

    def _labels(self, numbers: list[int] | None = None) -> DataFrame:
        """``(id, cluster, bucket)``: the last label of each id; without one where its group has grown out of bounds."""
        rows = self.read("labels", places=True)
        rows = rows if numbers is None else rows.filter(F.col("bucket").isin(numbers))
        return rows.groupBy("id", "bucket").agg(F.max_by("cluster", "place").alias("cluster")).filter("cluster is not null").select("id", "cluster", "bucket")

    def add(self, records: DataFrame, batch: int | None = None) -> DataFrame | None:
        """Take in records with the columns of ``reconcile.dedup``; the ``(id, head)`` that are new or other than before.

        Records that aren't current or have no subject are left out, and ids that are there already stay as they were.
        A repeated ``batch`` does nothing and gives None.
        """
        self.look()
        if self.seen(batch):
            return None
        name, place = self.begin()
        with scratch() as keep:
            given = R.in_question(records).dropDuplicates(["id"])
            given = given.select(*[F.col(c) for c in ("id", *_KEYS, "content", "why", "claim_type", "supersedes")], F.col("vector").cast("array<double>").alias("vector")).withColumn("bucket", self.bucket(*_KEYS))
            numbers = [r.bucket for r in given.select("bucket").distinct().collect()]  # BUCKETS at most
            stored = self.read("records").filter(F.col("bucket").isin(numbers))
            fresh = materialise(given.join(stored.select("id"), "id", "left_anti"), "fresh")
            dirty = fresh.select(*_KEYS).distinct()
            group = fresh.withColumn("new", F.lit(True)).unionByName(stored.join(dirty, _KEYS, "left_semi").withColumn("new", F.lit(False)))
            group = materialise(group, "dirty")
            inside = R.in_bounds(group, _KEYS, 2, self.max_group)
            links = materialise(self._links(inside), "links")
            labels = materialise(self._labels(numbers), "labels")
            changed = materialise(self._contracted(links, labels, group), "changed")
            outside = group.join(inside.select("id"), "id", "left_anti").join(labels.select("id"), "id", "left_semi").select("id", F.lit(None).cast("string").alias("cluster"), "bucket")
            before = keep(materialise(self.losers(), "losers"))
            self.put(fresh.drop("new"), "records", name)
            self.put(changed.unionByName(outside), "labels", name)
        self.commit(name, place, batch)
        return self.losers().join(before, ["id", "head"], "left_anti")

    def _links(self, inside: DataFrame) -> DataFrame:
        """``(id_a, id_b)`` of duplicates with a new record among them."""
        pairs = R.candidate_pairs(inside, self.threshold, only="new")
        return R.judged(R.guarded(pairs, inside), inside, self.judge).filter("verdict = 'duplicate'").select("id_a", "id_b")

    def _contracted(self, links: DataFrame, labels: DataFrame, group: DataFrame) -> DataFrame:
        """``(id, cluster, bucket)`` of the records whose label is new or other than before."""
        names = labels.select("id", F.col("cluster").alias("label"))
        ends = links
        for side in ("a", "b"):
            ends = ends.join(names.withColumnsRenamed({"id": f"id_{side}", "label": f"label_{side}"}), f"id_{side}", "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", f"id_{side}"))
        comp = materialise(connected_components(ends.select(F.col("label_a").alias("u"), F.col("label_b").alias("v"))), "contracted")
        # Whoever has a label that is joined to others, and the records that stood alone until now.
        held = labels.join(comp, F.col("cluster") == F.col("node")).select("id", F.col("component").alias("cluster"), F.col("cluster").alias("was"), "bucket")
        alone = group.join(names, "id", "left_anti").join(comp, F.col("id") == F.col("node")).select("id", F.col("component").alias("cluster"), F.lit(None).cast("string").alias("was"), "bucket")
        return held.unionByName(alone).filter("was is null or was <> cluster").drop("was")

    def losers(self) -> DataFrame:
        """``(id, head)`` of all records that have gone, as one run over everything would give them."""
        members = self._labels().select("id", "cluster").join(self.read("records"), "id")
        return members.join(R.choose_heads(members), "cluster").filter("id <> head").select("id", "head")

    def compact(self) -> None:
        """One segment in place of all."""
        if len(self.look()) < 2:
            return
        name, place = self.begin()
        for table, rows in (("records", self.read("records")), ("labels", self._labels())):
            self.put(rows, table, name)
        self.replace(name, place)
