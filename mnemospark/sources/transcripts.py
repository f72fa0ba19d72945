"""Conversation transcripts: five JSON Lines dialects to plain text, with JSON functions only.

Input is one row a file, ``(path, content)``.  A dialect says which parts a line gives; bad lines give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import path_slug, strip

#: Most characters kept of a user's text, of other texts, and of thoughts; shortest text of some dialects.
USER_CUT, OTHER_CUT, THOUGHT_CUT, SHORT = 2000, 500, 300, 5
_BLOCKS = "array<struct<type:string,text:string,content:string>>"


def read_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """``(path, content, size, mtime)`` of the files below the paths, oldest first by ``mtime`` for whoever sorts."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    df = reader.load(paths)
    return df.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def discover(files: DataFrame, source: str, skip_subagents: bool = False) -> DataFrame:
    """The transcript files among ``files`` with their ``source``."""
    keep = F.lit(True)
    if source == "openclaw":
        keep = ~F.col("path").endswith(".trajectory.jsonl")
    if skip_subagents and source in ("claude", "codex"):
        keep = keep & ~F.contains("path", F.lit("/subagents/"))
    return files.filter(keep).withColumn("source", F.lit(source))


def _texts(blocks: Column, kept: Callable[[Column], Column], text: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(F.filter(blocks, kept), text), lambda t: t.isNotNull() & (t != ""))


def _unstamped(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"^\[.*?\]\s*", ""))


def _labelled(texts: Column, label: Column, cut: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(label, F.lit(": "), F.substring(t, F.lit(1), cut)))


def _claude(line: Column) -> Column:
    plain = F.from_json(line, "type string, message struct<role:string,content:string>")
    blocks = F.from_json(line, f"message struct<content:{_BLOCKS}>")["message"]["content"]
    user = plain["type"] == "user"
    ok = plain["type"].isin("user", "assistant") & (plain["message"]["role"] == plain["type"])
    listed = _texts(blocks, lambda b: b["type"] == "text", lambda b: strip(b["text"]))
    texts = F.when(blocks.isNotNull(), listed).otherwise(F.filter(F.array(strip(plain["message"]["content"])), lambda t: t != ""))
    return F.when(ok, _labelled(texts, F.when(user, "USER").otherwise("CLAUDE"), F.when(user, F.lit(1 << 30)).otherwise(OTHER_CUT)))


def _codex(line: Column) -> Column:
    x = F.from_json(line, f"type string, payload struct<type:string,role:string,content:{_BLOCKS}>")
    user = x["payload"]["role"] == "user"
    text = lambda b: F.coalesce(F.nullif(strip(b["text"]), F.lit("")), strip(b["content"]))
    texts = _texts(x["payload"]["content"], lambda b: F.lit(True), text)
    texts = F.filter(texts, lambda t: (F.length(t) > SHORT) & ~t.startswith("[external_agent_tool_result") & ~t.startswith("[external_agent_tool_call"))
    return F.when((x["type"] == "response_item") & (x["payload"]["type"] == "message"), _labelled(texts, F.when(user, "USER").otherwise("CODEX"), F.when(user, USER_CUT).otherwise(OTHER_CUT)))


def _antigravity(line: Column) -> Column:
    x = F.from_json(line, "source string, type string, content string, thinking string, tool_calls string")
    asked = strip(F.regexp_extract(F.coalesce(x["content"], F.lit("")), r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1))
    calls = F.coalesce(x["tool_calls"], F.lit("")).isin("", "[]", "{}", "null", "false", "0")
    thought = F.when(F.coalesce(x["thinking"], F.lit("")) != "", F.concat(F.lit("THINKING: "), F.substring(strip(x["thinking"]), 1, THOUGHT_CUT)))
    said = F.when((F.coalesce(x["content"], F.lit("")) != "") & calls, F.concat(F.lit("ANTIGRAVITY: "), F.substring(strip(x["content"]), 1, OTHER_CUT)))
    return F.when((x["source"] == "USER_EXPLICIT") & (x["type"] == "USER_INPUT"), F.array_compact(F.array(F.when(asked != "", F.concat(F.lit("USER: "), asked))))).when(
        (x["source"] == "MODEL") & (x["type"] == "PLANNER_RESPONSE"), F.array_compact(F.array(thought, said))
    )


def _blocks_of(label: str, query_tag: bool) -> Callable[[Column], Column]:
    def parse(line: Column) -> Column:
        x = F.from_json(line, f"type string, role string, message struct<role:string,content:{_BLOCKS}>")
        role = x["role"] if query_tag else x["message"]["role"]
        user = F.coalesce(role == "user", F.lit(False))
        long = _texts(x["message"]["content"], lambda b: b["type"] == "text", lambda b: strip(b["text"]))
        texts = F.transform(F.filter(long, lambda t: F.length(t) > SHORT), _unstamped)
        if query_tag:
            texts = F.transform(texts, lambda t: F.when(t.rlike(r"(?s)<user_query>.*?</user_query>"), strip(F.regexp_extract(t, r"(?s)<user_query>(.*?)</user_query>", 1))).otherwise(t))
        texts = F.filter(texts, lambda t: t != "")
        rows = _labelled(texts, F.when(user, "USER").otherwise(label), F.when(user, USER_CUT).otherwise(OTHER_CUT))
        return rows if query_tag else F.when(x["type"] == "message", rows)

    return parse


#: By source: how a line is read, and what stands between parts.
PARSERS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "claude": (_claude, "\n"),
    "codex": (_codex, "\n"),
    "antigravity": (_antigravity, "\n\n"),
    "cursor": (_blocks_of("CURSOR", True), "\n"),
    "openclaw": (_blocks_of("OPENCLAW", False), "\n"),
}


def parse(files: DataFrame, source: str) -> DataFrame:
    """``files`` with ``text`` in place of ``content``; an unknown source is an error."""
    if source not in PARSERS:
        raise ValueError(f"unknown source {source!r}")
    line_parts, between = PARSERS[source]
    lines = F.filter(F.transform(F.split("content", "\r?\n"), strip), lambda x: x != "")
    parts = F.flatten(F.filter(F.transform(lines, line_parts), lambda p: p.isNotNull()))
    return files.withColumn("text", F.array_join(parts, between)).drop("content")


def project_of(path: Column, source: str) -> Column:
    """The project that a path tells of; null where it tells none."""
    parts = F.split(path, "/")
    if source == "claude":
        name = F.regexp_extract(path, r"(?:^|/)\.claude/projects/([^/]+)", 1)
        segments = F.filter(F.split(name, "--"), lambda s: (s != "") & ~s.rlike(r"^\d+$"))
        return path_slug(F.try_element_at(segments, F.lit(-1)))
    if source == "cursor":
        return path_slug(F.regexp_extract(path, r"(?:^|/)\.cursor/projects/([^/]+)", 1))
    if source == "markdown":
        return path_slug(F.try_element_at(parts, F.lit(-2)))
    if source == "git":
        return path_slug(F.try_element_at(parts, F.lit(-1)))
    return F.lit(None).cast("string")
