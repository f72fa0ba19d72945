"""The project that a file belongs to: by its repository's configuration, remote or name.

Files meet repositories in a join: the folders of all files, each once, are cut into their ancestors, which join the roots
by equality; the longest hit is the nearest root, so nested repositories come out right.  No file is looked at again, and
no folder is walked upwards.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import path_slug
from mnemospark.storage import broadcast_within

#: The file in a root that names its project.
CONFIG = ".project-memory.json"
#: Roots that may be broadcast.
MAX_ROOTS = 100_000


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        configs, remotes = [], []
        for root, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, path = pyarrow.fs.FileSystem.from_uri(root)
            file = f"{path}/{name}"
            configs.append(fs.open_input_stream(file).read().decode("utf-8", "replace") if fs.get_file_info(file).is_file else None)
            try:
                done = subprocess.run(["git", "remote", "get-url", "origin"], cwd=path, capture_output=True, text=True, timeout=5, check=False)
                remotes.append(done.stdout.strip() or None if done.returncode == 0 else None)
            except (OSError, subprocess.TimeoutExpired):
                remotes.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(configs, pa.string()), pa.array(remotes, pa.string())], names=["root", "config", "remote"])


def described(roots: DataFrame, config: str = CONFIG) -> DataFrame:
    """``(root, config, remote)`` of repositories ``(root)``: what their configuration file holds and where they come from; null where there is none."""
    return roots.select("root", F.lit(config).alias("name")).mapInArrow(_described, "root string, config string, remote string")


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def project(root: Column, config: Column, remote: Column) -> Column:
    """The configured project, or else the remote's name, or else the folder's; a configuration that can't be read counts as none."""
    named = F.get_json_object(config, "$.project")
    of_remote = path_slug(F.regexp_replace(_last(F.regexp_replace(F.trim(remote), "/+$", "")), r"\.git$", ""))
    return F.when(F.coalesce(named, F.lit("")) != "", path_slug(named)).otherwise(F.coalesce(of_remote, path_slug(_last(root))))


def projects(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with ``root``, the nearest of ``roots`` ``(root, config, remote)`` above, and ``project``.

    A file under no root has the name of its folder.  Null paths have neither; roots may end in a slash; the first of
    rows that share a root counts, by configuration and remote.
    """
    parent = F.regexp_replace("path", "/[^/]*$", "")
    folders = files.select(parent.alias("folder")).filter("folder is not null").distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root")).filter("root <> ''")
    known = roots.select(F.regexp_replace("root", "/+$", "").alias("root"), "config", "remote").groupBy("root").agg(F.min(F.struct("config", "remote")).alias("x")).select("root", "x.*")
    hit = above.join(broadcast_within(known, MAX_ROOTS), "root").groupBy("folder").agg(F.max_by(F.struct("root", "config", "remote"), F.length("root")).alias("hit"))
    own = files.withColumn("folder", parent).join(hit, "folder", "left")
    found = F.when(F.col("hit").isNotNull(), project(F.col("hit.root"), F.col("hit.config"), F.col("hit.remote"))).otherwise(path_slug(_last(F.col("folder"))))
    return own.select(*files.columns, F.col("hit.root").alias("root"), found.alias("project"))
