"""A lease on the shared file system: one run at a time, over all machines, and none for ever."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from mnemospark.storage import read_text, rename, write_text


class Lease:
    """Held by the one whose file came to stand at ``path``; the file says who that is and until when."""

    def __init__(self, spark: SparkSession, path: str, seconds: float):
        self.spark, self.path, self.seconds, self.holder = spark, path, seconds, uuid.uuid4().hex

    def _draft(self) -> str:
        draft = f"{self.path}.{uuid.uuid4().hex}"
        write_text(self.spark, draft, json.dumps({"holder": self.holder, "until": time.time() + self.seconds}))
        return draft

    def _says(self, path: str) -> dict:
        try:
            return json.loads(read_text(self.spark, path) or "{}")
        except ValueError:
            return {}

    def take(self) -> bool:
        """Whether the lease is ours now.  One that has run out is moved aside, which only one can do, and then taken like a free one."""
        said = self._says(self.path)
        if said and said["until"] <= time.time():
            aside = f"{self.path}.{uuid.uuid4().hex}"
            if rename(self.spark, self.path, aside) and self._says(aside).get("until", 0) > time.time():
                rename(self.spark, aside, self.path)  # somebody has renewed it in between
                return False
        return rename(self.spark, self._draft(), self.path)

    def renew(self) -> bool:
        """Hold on for as long again; False if somebody else has it by now."""
        if self._says(self.path).get("holder") != self.holder:
            return False
        return rename(self.spark, self._draft(), self.path, over=True)

    def release(self) -> None:
        """Give back what is ours; somebody else's lease stays."""
        if self._says(self.path).get("holder") == self.holder:
            rename(self.spark, self.path, f"{self.path}.{uuid.uuid4().hex}")


@contextlib.contextmanager
def only_run(spark: SparkSession, path: str, seconds: float = 6 * 3600) -> Iterator[bool]:
    """True for the holder; False if another run holds the lease, and then nothing is taken or removed."""
    lease = Lease(spark, path, seconds)
    held = lease.take()
    try:
        yield held
    finally:
        if held:
            lease.release()
