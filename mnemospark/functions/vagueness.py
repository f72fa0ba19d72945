"""The vagueness detector as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import QUERY_TOKEN, strip, tokens

#: Openings that refer to something unsaid, demonstratives, verbs, and words that begin a clause.
LEADS = ("it", "this", "that", "these", "those", "they", "he", "she", "them", "him", "her", "there", "here", "then", "later", "former", "latter", "one", "ones")
DEMONSTRATIVES = ("this", "that", "these", "those")
VERBS = ("should", "is", "are", "was", "were", "will", "must", "can", "could", "would", "did", "does", "do", "has", "have", "had", "needs", "need", "may", "might", "shall")
CLAUSE_STARTS = ("and", "but", "or", "so", "yet", "because", "while", "then", "thus", "therefore", "however", "although", "since")


def vagueness_flags(content: Column, subject: Column) -> Column:
    """Flags in order: empty; unresolved opening; first dangling demonstrative; subject a pronoun or not in the content."""
    text = F.lower(F.coalesce(content, F.lit("")))
    ts = tokens(text, QUERY_TOKEN)
    first = F.get(ts, F.lit(0))
    opening = F.when(first.isin(*LEADS) & ~first.isin(*DEMONSTRATIVES), F.concat(F.lit("opens with unresolved reference '"), first, F.lit("'")))
    trio = F.zip_with(F.concat(F.array(F.lit("and")), ts), F.zip_with(ts, F.slice(ts, F.lit(2), F.size(ts)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p, x: F.struct(p.alias("p"), x["a"].alias("a"), x["b"].alias("b")))
    hangs = F.get(F.filter(trio, lambda x: x["a"].isin(*DEMONSTRATIVES) & x["b"].isin(*VERBS) & x["p"].isin(*CLAUSE_STARTS)), F.lit(0))
    dangling = F.when(hangs.isNotNull(), F.concat(F.lit("dangling demonstrative '"), hangs["a"], F.lit(" "), hangs["b"], F.lit("'")))
    s = F.lower(strip(subject))
    about = F.when(s.isin(*LEADS), F.lit("subject is a pronoun, not explicit")).when((s != "") & ~F.contains(text, s), F.lit("content does not contain the subject"))
    flags = F.array_compact(F.array(opening, dangling, about))
    return F.when(F.size(ts) == 0, F.array(F.lit("content is empty"))).otherwise(flags)
