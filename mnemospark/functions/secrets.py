"""Secret detectors as Column expressions.

Each detector gives a flag or null; the flags of a text are those that aren't null, in order.  Values are cut to their
first four characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import strip

#: Named patterns, with the words of their flags.
PRIVATE_KEY = r"-----BEGIN\s+(?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"
NAMED = (
    ("aws-key-id: AWS access key id detected", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github-token: GitHub token detected", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("vault-token-v2: Vault service token detected", r"\bhvs\.[A-Za-z0-9]{20,}\b"),
    ("vault-token-v1: Vault legacy token detected", r"\bs\.[A-Za-z0-9]{24,}\b"),
    ("slack-token: Slack token detected", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("jwt: JWT / bearer token detected", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
)
#: An assignment to a name that tells of a secret; group 1 is the value.
ASSIGNMENT = r"(?i)\b(?:password|passwd|pwd|secret|api[_-]?key|apikey|token|access[_-]?key|private[_-]?key)\s*[:=]\s*['\"]?(\S+?)['\"]?(?:\s|$|;|,)"
#: Runs that may be random, commit hashes among them, and paths of a secret store.
CANDIDATE, COMMIT, STORE_PATH = r"[A-Za-z0-9+/=_-]{32,}", "^[0-9a-f]{40}$", r"\bsecret/[\w/-]+\b"
#: Marks of a redacted value, and what people write in place of one.
REDACTED = r"(?i)\b[A-Za-z0-9_-]{1,8}\*{4,}\b|<REDACTED>|^\*+$|\*{3,}|<\s*(?:token|secret|key|password)\s*>"
PLACEHOLDERS = (
    "your-api-key", "your_api_key", "yourapikey", "changeme", "change-me", "change_me", "xxxxxxxx", "xxxx", "1234567890", "example", "placeholder", "insert-here", "<token>", "todo",
    "n/a", "none", "your-token", "your_token",
)
#: Shortest assigned value, and bits a character that random runs exceed.
MIN_VALUE, MIN_ENTROPY = 8, 4.0


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    # Sorted, equal characters are runs; a run ends where the next character differs, and its length is its end minus the end before.
    chars = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    n = F.size(chars)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(chars, i) != F.get(chars, i - 1)))
    runs = F.zip_with(ends, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), lambda a, b: (a - b) / n)
    return F.when(n > 0, F.aggregate(runs, F.lit(0.0), lambda a, x: a - x * F.log2(x))).otherwise(0.0)


def is_placeholder(value: Column) -> Column:
    v = F.lower(strip(value))
    return v.isin(*PLACEHOLDERS) | value.rlike(REDACTED) | v.rlike(r"(?s)^(.)\1{3,}$")


def without_store_paths(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), STORE_PATH, "VAULT_PATH_REF")


def redacted(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 4), F.lit("****"))


def entropy_flag(safe: Column) -> Column:
    """The first long run that isn't a commit hash or placeholder and is random enough."""
    runs = F.filter(F.regexp_extract_all(safe, F.lit(CANDIDATE), F.lit(0)), lambda t: ~t.rlike(COMMIT) & ~is_placeholder(t))
    first = F.get(F.filter(F.transform(runs, lambda t: F.struct(t.alias("t"), entropy(t).alias("bits"))), lambda x: x["bits"] > MIN_ENTROPY), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.lit("high-entropy-token: standalone token entropy="), F.format_string("%.2f", first["bits"]), F.lit(" ("), redacted(first["t"]), F.lit(")")))


def secret_flags(text: Column) -> Column:
    """All flags of a text, in the detectors' order; an empty array for a clean or blank one."""
    safe = without_store_paths(text)
    flags = [F.when(safe.rlike(PRIVATE_KEY), F.lit("private-key-block: PEM private key block detected"))]
    for words, pattern in NAMED:
        hit = F.regexp_extract(safe, pattern, 0)
        flags.append(F.when(hit != "", F.concat(F.lit(f"{words} ("), redacted(hit), F.lit(")"))))
    whole = F.regexp_extract_all(safe, F.lit(ASSIGNMENT), F.lit(0))
    value = F.regexp_extract_all(safe, F.lit(ASSIGNMENT), F.lit(1))
    kept = F.filter(F.arrays_zip(whole.alias("whole"), value.alias("value")), lambda x: (F.length(x["value"]) >= MIN_VALUE) & ~is_placeholder(x["value"]))
    first = F.get(kept, F.lit(0))
    name = strip(F.split(F.split(first["whole"], "=")[0], ":")[0])
    flags.append(F.when(first.isNotNull(), F.concat(F.lit("secret-assignment: key='"), name, F.lit("' value="), redacted(first["value"]))))
    named = F.array_compact(F.array(*flags))
    return F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(entropy_flag(safe))))
