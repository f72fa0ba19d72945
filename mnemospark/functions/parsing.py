"""Parsers for what models, tools and logs return, as Column expressions that give null instead of raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import strip


def without_thoughts(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", ""))


def gate_verdict(c: Column) -> Column:
    """``store``, ``reject`` or null."""
    answer = F.upper(without_thoughts(c))
    return F.when(answer.startswith("STORE"), "store").when(answer.startswith("REJECT"), "reject")


def pair_verdict(c: Column) -> Column:
    """``duplicate``, ``distinct`` or null from ``{"verdict": ...}``."""
    v = F.lower(strip(F.get_json_object(c, "$.verdict")))
    return F.when(v.isin("duplicate", "distinct"), v)


def choice_verdict(c: Column) -> Column:
    """A, B or TIE: after the last ``FINAL:``, else the last that stands alone, else ``?``."""
    t = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", ""))
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.lit(-1))
    return F.coalesce(last(r"FINAL\s*:\s*(A|B|TIE)\b"), last(r"\b(A|B|TIE)\b"), F.lit("?"))


def threads(raw: Column, ids: Column) -> Column:
    """Lists of 1-based item numbers as lists of ids; other members drop out, as do empty lists; null if there is no list of lists."""
    lists = F.from_json(F.get_json_object(raw, "$.threads"), "array<array<string>>")
    numbers = F.transform(lists, lambda t: F.filter(F.transform(t, lambda x: x.try_cast("int")), lambda n: n.between(1, F.size(ids))))
    return F.filter(F.transform(numbers, lambda t: F.transform(t, lambda n: F.get(ids, n - 1))), lambda t: F.size(t) > 0)


def iso_time(c: Column) -> Column:
    """A timestamp in UTC, naive ones taken as UTC; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def iso_date(c: Column) -> Column:
    """A date from ``YYYY-MM-DD`` only; null otherwise."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c))


def salvaged_items(c: Column) -> Column:
    """The JSON objects of a model's answer: fences dropped; a list, one object, or what stands between the outer brackets."""
    t = F.regexp_replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"```(?:json)?\s*", "")), r"`+\s*$", "")
    items = lambda s: F.from_json(s, "array<struct<category:string,subject:string,content:string>>")
    ok = lambda s: F.try_parse_json(s).isNotNull()
    inner = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    return F.when(ok(t) & t.startswith("["), items(t)).when(ok(t) & t.startswith("{"), items(F.concat(F.lit("["), t, F.lit("]")))).when((inner != "") & ok(inner), items(inner)).otherwise(items(F.lit("[]")))


def tool_texts(raw: Column, unwrap: bool = True) -> Column:
    """The fact texts of a search tool's answer; null if it has none or isn't one."""
    inner = F.coalesce(F.get_json_object(raw, "$.result"), raw) if unwrap else raw
    results = F.from_json(F.get_json_object(inner, "$.results"), "array<struct<memory:string,data:string,text:string>>")
    full = lambda s: F.when(s != "", s)
    return F.transform(results, lambda r: F.coalesce(full(r["memory"]), full(r["data"]), full(r["text"]), F.lit("")))


def flattened(raw: Column) -> Column:
    """The texts on lines of their own, or the raw answer."""
    ts = tool_texts(raw)
    return F.when(F.size(ts) > 0, F.array_join(ts, "\n")).otherwise(raw)


def snippets(raw: Column, n: int = 120) -> Column:
    ts = tool_texts(raw, unwrap=False)
    return F.coalesce(F.transform(ts, lambda t: F.substring(t, 1, n)), F.array(F.substring(raw, 1, n)))
