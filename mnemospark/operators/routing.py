"""Which model answers: a decision table over what is loaded and what has answered, and calls that follow it.

The table is data.  Recorded attempts meet it in a join; live calls walk the same rules row by row in an iterator over
Arrow batches, where each worker keeps a breaker, so that a backend that is down isn't waited for at every row.  Every
failure ends in "skipped": a gate or judge that can't be asked never stops a write.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether the primary is called, by policy and what it has loaded: our model, others only, or nothing (also if it doesn't say).
CALLS_PRIMARY = {("gate", "ours"): True, ("gate", "others"): False, ("gate", "nothing"): False, ("judge", "ours"): True, ("judge", "others"): False, ("judge", "nothing"): True}
LOADED = ("ours", "others", "nothing")
#: What becomes of a call: a verdict, an answer that says none, no answer.
ANSWERS = ("verdict", "unclear", "failed")
#: Failures in a row after which a backend isn't called, and seconds until it is tried again.
BREAK_AFTER, BREAK_SECONDS = 3, 30.0

_KEY = ["policy", "configured", "loaded", "primary", "fallback"]


def second(primary: str | None) -> bool:
    """Whether the fallback is asked after this answer of the primary, None if that wasn't called."""
    return primary in (None, "failed")


def decided(policy: str, configured: bool, loaded: str, primary: str, fallback: str) -> str:
    """The backend whose verdict counts; ``fallback`` is "absent" where there is none."""
    if not configured:
        return "skipped"
    first = primary if CALLS_PRIMARY[policy, loaded] else None
    if first == "verdict":
        return "primary"
    return "fallback" if second(first) and fallback == "verdict" else "skipped"


def decisions(spark: SparkSession) -> DataFrame:
    """The whole table, ``(policy, configured, loaded, primary, fallback, backend)``: 144 rows."""
    every = itertools.product(("gate", "judge"), (True, False), LOADED, ANSWERS, ("absent", *ANSWERS))
    return spark.createDataFrame([(*x, decided(*x)) for x in every], "policy string, configured boolean, loaded string, primary string, fallback string, backend string")


def loaded_state(models: Column, model: Column) -> Column:
    """What a backend has loaded, from the list that it gives; null where it doesn't answer."""
    return F.when(F.coalesce(F.array_contains(models, model), F.lit(False)), "ours").when(F.coalesce(F.size(models), F.lit(0)) > 0, "others").otherwise("nothing")


def routed(attempts: DataFrame) -> DataFrame:
    """``attempts`` with the table's key columns and the ``backend`` that they lead to."""
    return attempts.join(F.broadcast(decisions(attempts.sparkSession)), _KEY, "left")


class _Backend:
    """A call with a breaker."""

    def __init__(self, call: Callable[[str], str] | None, parse: Callable[[str], str | None]):
        self.call, self.parse, self.failures, self.until = call, parse, 0, 0.0

    def ask(self, text: str) -> tuple[str, str | None, str]:
        """``(answer, verdict, raw)``."""
        if self.failures >= BREAK_AFTER and time.monotonic() < self.until:
            return "failed", None, "breaker open"
        try:
            raw = self.call(text)
        except Exception as e:  # whatever a model's client raises: fail open
            self.failures, self.until = self.failures + 1, time.monotonic() + BREAK_SECONDS
            return "failed", None, f"{type(e).__name__}: {e}"
        self.failures = 0
        verdict = self.parse(raw)
        return ("unclear" if verdict is None else "verdict"), verdict, raw


def _loaded(models: Callable[[], list[str]], model: str) -> str:
    try:
        found = models()
    except Exception:  # a backend that doesn't say what it has loaded
        return "nothing"
    return "ours" if model in found else "others" if found else "nothing"


def ask(rows: DataFrame, policy: str, parse: Callable[[str], str | None], primary: Callable[[str], str] | None, models: Callable[[], list[str]], model: str, fallback: Callable[[str], str] | None = None) -> DataFrame:
    """``rows`` with a column ``prompt``, and ``verdict``, ``raw`` and ``backend``.

    ``models`` says what the primary has loaded; it is asked once for each batch of rows.  A null prompt is skipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, other = _Backend(primary, parse), _Backend(fallback, parse)
        for b in batches:
            loaded = _loaded(models, model) if primary else "nothing"
            verdicts, raws, backends = [], [], []
            for prompt in b.column("prompt").to_pylist():
                verdict, raw, backend = _asked(prompt, policy, loaded, first, other)
                verdicts.append(verdict)
                raws.append(raw)
                backends.append(backend)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in (verdicts, raws, backends))], names=[*b.schema.names, "verdict", "raw", "backend"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, verdict string, raw string, backend string")


def _asked(prompt: str | None, policy: str, loaded: str, first: _Backend, other: _Backend) -> tuple[str | None, str, str]:
    if first.call is None or prompt is None:
        return None, "not configured" if first.call is None else "no prompt", "skipped"
    answer, verdict, raw = first.ask(prompt) if CALLS_PRIMARY[policy, loaded] else (None, None, f"primary has {loaded} loaded")
    if not second(answer) or other.call is None:
        return verdict, raw, decided(policy, True, loaded, answer or "failed", "absent")
    again, verdict, said = other.ask(prompt)
    return verdict, said if verdict else f"primary: {raw}; fallback: {said}", decided(policy, True, loaded, answer or "failed", again)
