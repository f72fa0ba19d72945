"""The mining plan: files to facts to candidates for the write path, incremental by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.parsing import salvaged_items
from mnemospark.functions.text import filled, strip
from mnemospark.sources.files import pending
from mnemospark.storage import materialise

#: Characters of a chunk, shortest text that is mined, shortest fact, calls made for a chunk.
CHUNK, SHORT_TEXT, SHORT_FACT, TRIES = 12_000, 200, 10, 3


def cut(text: Column, size: int = CHUNK) -> Column:
    """The chunks of a text, as an array: one pattern whose matches, laid end to end, are the chunks.

    Tried in this order at each place: all that is left, if it fits; the longest stretch below ``size`` that a line break
    follows; ``size`` characters.  A text that fits is one chunk, as it is; chunks of longer ones are stripped; blank
    chunks drop out.
    """
    text = F.coalesce(text, F.lit(""))
    stretch = rf"(?s).{{1,{size}}}\z|.{{1,{size - 1}}}(?=\n)|.{{{size}}}"
    parts = F.transform(F.regexp_extract_all(text, F.lit(stretch), F.lit(0)), strip)
    return F.filter(F.when(F.length(text) <= size, F.array(text)).otherwise(parts), lambda c: strip(c) != "")


def chunks(texts: DataFrame, key: str, size: int = CHUNK) -> DataFrame:
    """``(key, chunk_no, chunk)``."""
    return texts.select(key, F.posexplode(cut(F.col("text").cast("string"), size)).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


def answers(chunked: DataFrame, extract: Callable[[Column], Column], tries: int = TRIES) -> DataFrame:
    """``chunked`` with ``answer``; a null answer is a failed call, which is made ``tries`` times at most.  Each round is written out, so no call is repeated by a later plan."""
    out = None
    for turn in range(tries):
        asked = materialise(chunked.withColumn("answer", extract(F.col("chunk"))), "answers")
        chunked = asked.filter("answer is null").drop("answer")
        last = turn == tries - 1 or not chunked.limit(1).count()
        kept = asked if last else asked.filter("answer is not null")
        out = kept if out is None else out.unionByName(kept)
        if last:
            break
    return out


def facts(answered: DataFrame) -> DataFrame:
    """Facts of answered chunks: the answer is salvaged as JSON; facts that are too short drop out."""
    rest = [c for c in answered.columns if c not in ("chunk", "answer")]
    items = answered.select(*rest, F.explode(salvaged_items(F.col("answer"))).alias("x"))
    own = items.select(*rest, F.lower(F.coalesce("x.category", F.lit("fact"))).alias("category"), filled(strip(F.col("x.subject"))).alias("subject"), strip(F.coalesce("x.content", F.lit(""))).alias("content"))
    return own.filter(F.length("content") >= SHORT_FACT)


def mine(files: DataFrame, checkpoint: DataFrame, extract: Callable[[Column], Column], tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """Facts of the files ``(path, file_hash, text, source, project)`` that the checkpoint lacks, and the checkpoint's new rows.

    Files with little text are checked off as skipped.  A file of which a chunk fails in every try gives no facts and
    isn't checked off, so that the next run takes it up again; the other files go on.  Facts and checkpoint rows are read
    from the same written answers.
    """
    todo = pending(files, checkpoint)
    asked = answers(chunks(todo.filter(F.length("text") >= SHORT_TEXT), "path"), extract, tries)
    failed = asked.filter("answer is null").select("path").distinct()
    todo = todo.join(failed, "path", "left_anti")
    found = facts(asked.filter("answer is not null")).join(todo.select("path", "project", "source"), "path")
    counts = found.groupBy("path").agg(F.count("*").alias("facts_written"))
    done = todo.select("path", "file_hash", "source").join(counts, "path", "left").select("path", "file_hash", "source", F.coalesce("facts_written", F.lit(0)).alias("facts_written"), F.col("facts_written").isNull().alias("skipped"))
    return found, done
