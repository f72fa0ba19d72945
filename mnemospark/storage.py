"""Where intermediate tables live, and how lineage is cut.

Everything that must outlive an executor goes to the folder the cluster names in ``spark.checkpoint.dir``.  Only where
that setting is absent and driver and executors are one machine (unit tests, a laptop) is a temporary folder chosen, once
per session.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCOPES = threading.local()

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a durable cut of the lineage.

    The shuffle files of the write go as soon as the table stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    for scope in getattr(_SCOPES, "open", [])[-1:]:
        scope.append(out)
    return out


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getRaw() if fs.getUri().getScheme() == "file" else fs  # no checksum files, which a move would leave behind


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def is_folder(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).getFileStatus(_path(spark, path)).isDirectory()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver."""
    out = _fs(spark, path).create(_path(spark, path), True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    try:
        file = _fs(spark, path).open(_path(spark, path))
    except Exception as e:  # py4j wraps the file system's answer
        if "FileNotFound" in str(e):
            return None
        raise
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def rename(spark: SparkSession, source: str, target: str, over: bool = False) -> bool:
    """Move a file; one that is at the target stays, and the answer is False, unless it is to be replaced, in one step."""
    at, to = (_fs(spark, p).makeQualified(_path(spark, p)).toUri() for p in (source, target))
    try:
        _moved_locally(spark, at, to, over) if to.getScheme() == "file" else _moved(spark, at, to, over)
    except Exception as e:  # py4j wraps the file system's answer
        if any(x in str(e) for x in ("AlreadyExists", "FileNotFound", "NoSuchFile")):
            return False
        raise
    return True


def _array(spark: SparkSession, kind, *values):
    out = spark.sparkContext._gateway.new_array(kind, len(values))
    for i, v in enumerate(values):
        out[i] = v
    return out


def _moved(spark: SparkSession, at, to, over: bool) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    kinds = getattr(hadoop, "Options$Rename")
    how = _array(spark, kinds, kinds.OVERWRITE if over else kinds.NONE)
    hadoop.FileContext.getFileContext(to, spark._jsc.hadoopConfiguration()).rename(hadoop.Path(at), hadoop.Path(to), how)


def _moved_locally(spark: SparkSession, at, to, over: bool) -> None:
    """Hadoop's local file system deletes before it renames; the machine's own calls don't."""
    nio = spark._jvm.java.nio.file
    source, target = nio.Paths.get(at), nio.Paths.get(to)
    if over:
        nio.Files.move(source, target, _array(spark, nio.CopyOption, nio.StandardCopyOption.REPLACE_EXISTING, nio.StandardCopyOption.ATOMIC_MOVE))
    else:
        nio.Files.createLink(target, source)
        nio.Files.delete(source)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    _fs(spark, path).delete(_path(spark, path), True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._written_to)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose tables are deleted at its end, but for those that a frame passed to the yielded function still reads.

    What is kept belongs to the scope around, if there is one.  After an error nothing is deleted: the tables may help.
    """
    scopes = _SCOPES.open = getattr(_SCOPES, "open", [])
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(t._written_to for t in made if any(f"/{t._written_to.rsplit('/', 1)[1]}/" in f for f in files))
        return df

    scopes.append(made)
    try:
        yield keep
    finally:
        scopes.pop()
    discard(*[t for t in made if t._written_to not in kept])
    for scope in scopes[-1:]:
        scope += [t for t in made if t._written_to in kept]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions, as a table of one small file has; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; otherwise ``df`` as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
