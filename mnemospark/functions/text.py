"""Text functions of the retrieval and dedup paths as Column expressions: no UDF, one pass inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns of the keyword query, of word matching, and of subtokens.
QUERY_TOKEN, WORD, SUBTOKEN, RUN = r"[A-Za-z0-9_.:/@-]+", r"[a-z0-9']+", r"[A-Za-z0-9]+", r"[A-Za-z]+|[0-9]+"
#: Punctuation that an identifier may be wrapped in.
BOUNDARY = r"._:/@-"
#: Words that carry no content, for keyword extraction.
STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "nor", "but", "so", "yet", "as", "by", "from", "with", "about", "into", "onto", "over", "under", "than",
    "then", "this", "that", "these", "those", "it", "its", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "doing", "have", "has", "had", "having", "can",
    "could", "should", "would", "will", "shall", "may", "might", "must", "not", "no", "which", "what", "who", "whom", "whose", "how", "when", "where", "why", "any", "all", "each",
    "every", "some", "such", "i", "you", "he", "she", "we", "they", "them", "his", "her", "our", "your", "their",
)
#: Letters with marks and the letters without them, for the keyword index.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.when(c != "", c)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in columns])


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def path_slug(c: Column) -> Column:
    """Like ``slugify`` but keeps ``_``, doesn't join runs, and is null if nothing is left."""
    # Dashes are trimmed, not matched: a pattern for the last ones starts anew at each dash of a long run within.
    return F.nullif(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9_-]", "-"), F.lit("-")), F.lit(""))


def skeleton(c: Column) -> Column:
    """Lower case, digit runs as ``#``, white space runs as one space."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\d+", "#"), r"(?U)\s+", " "))


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)(\d+)"), F.lit(1))


def number_guard(a: Column, b: Column) -> Column:
    """Equal but for their numbers, and the numbers differ."""
    return (skeleton(a) == skeleton(b)) & (digit_runs(a) != digit_runs(b))


def tokens(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def subtokens(c: Column) -> Column:
    return F.transform(tokens(c, SUBTOKEN), F.lower)


def index_tokens(c: Column) -> Column:
    """Tokens of the keyword index: letters and digits of any script, case and marks folded."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _has(pattern: str):
    return lambda t: t.rlike(pattern)


def variants(token: Column) -> Column:
    """Other spellings of a token that mixes letters and digits: its runs apart, and together if that is new."""
    runs = F.regexp_extract_all(token, F.lit(RUN), F.lit(0))
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.size(runs) >= 2)
    apart, together = F.array_join(runs, " "), F.array_join(runs, "")
    none = F.array().cast("array<string>")
    return F.when(mixed, F.when(together != token, F.array(apart, together)).otherwise(F.array(apart))).otherwise(none)


def match_terms(query: Column) -> Column:
    """Phrases that a keyword query looks for, any of them; repeated tokens stay."""
    return F.flatten(F.transform(tokens(query, QUERY_TOKEN), lambda t: F.concat(F.array(t), variants(t))))


def match_query(query: Column) -> Column:
    return F.array_join(F.transform(match_terms(query), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def identifiers(query: Column) -> Column:
    """Tokens that name something: letter-digit mixes, inner ``._:@``, some compounds, long numbers, dotfiles, absolute paths."""

    def bare(raw: Column) -> Column:
        right = F.regexp_replace(raw, rf"[{BOUNDARY}]+$", "")
        path = right.rlike(r"^\.[A-Za-z0-9_][A-Za-z0-9._-]*$") | right.rlike(r"^/[A-Za-z0-9._-][A-Za-z0-9._/-]*$")
        return F.struct(F.when(path, right).otherwise(F.regexp_replace(right, rf"^[{BOUNDARY}]+", "")).alias("t"), path.alias("path"))

    def names(x: Column) -> Column:
        t = x["t"]
        digit, letter, cases = t.rlike("[0-9]"), t.rlike("[A-Za-z]"), t.rlike("[A-Z]") & t.rlike("[a-z]")
        slashes = F.length(t) - F.length(F.translate(t, "/", ""))
        compound = t.rlike("[-/]") & (digit | cases | (slashes >= 2))
        return x["path"] | ((t != "") & ((digit & letter) | t.rlike("[._:@]") | compound | (digit & ~letter & (F.length(t) >= 3))))

    return F.transform(F.filter(F.transform(tokens(query, QUERY_TOKEN), bare), names), lambda x: x["t"])


def spaced_subtokens(text: Column) -> Column:
    """The subtokens with a space before, between and after them."""
    return F.concat(F.lit(" "), F.array_join(subtokens(text), " "), F.lit(" "))


def holds_identifier(spaced: Column, identifier: Column) -> Column:
    """Whether neighbouring subtokens of the text, joined, are the identifier without its punctuation.

    The identifier becomes a pattern that allows a space between any two characters; at most two subtokens more than the
    identifier has may be joined.
    """
    need = subtokens(identifier)
    pattern = F.concat(F.lit("(?<= )"), F.array_join(F.filter(F.split(F.array_join(need, ""), ""), lambda c: c != ""), " ?"), F.lit("(?= )"))
    parts = lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
    return (F.size(need) > 0) & F.exists(F.regexp_extract_all(spaced, pattern, F.lit(0)), lambda m: parts(m) <= F.size(need) + 2)


def token_weight(t: Column) -> Column:
    strong = t.rlike("[0-9./:@_]") | t.rlike("^[A-Z][A-Z0-9_-]{2,}$")
    return F.length(t).cast("double") * F.when(strong, 2.0).otherwise(1.0)


def keyword_coverage(query: Column, text: Column) -> Column:
    """Share of the query's token weight that the text contains."""
    ts, hay = tokens(query, QUERY_TOKEN), F.lower(F.coalesce(text, F.lit("")))
    total = F.aggregate(ts, F.lit(0.0), lambda a, t: a + token_weight(t))
    met = F.aggregate(ts, F.lit(0.0), lambda a, t: a + F.when(F.contains(hay, F.lower(t)), token_weight(t)).otherwise(0.0))
    return F.when(total > 0, met / total).otherwise(0.0)


def has_identifier(query: Column) -> Column:
    """The looser test: any token with a digit or inner punctuation, or a code in capitals."""
    return F.exists(tokens(query, QUERY_TOKEN), lambda t: t.rlike("[0-9./:@_]") | t.rlike("^[A-Z][A-Z0-9_-]{2,}$"))


def keywords(question: Column) -> Column:
    """Distinct words that aren't stopwords."""
    return F.array_distinct(F.array_except(tokens(F.lower(question), WORD), F.array(*[F.lit(w) for w in STOPWORDS])))


def squeezed_prefix(c: Column, n: int = 100) -> Column:
    return F.substring(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), 1, n)


def snippet(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def file_hash(path: Column, size: Column, mtime: Column) -> Column:
    return F.substring(F.sha1(F.concat(path, size.cast("string"), mtime.cast("string"))), 1, 16)
