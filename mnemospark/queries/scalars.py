"""Scalar functions and row shaping, one query for each family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import parsing as P
from mnemospark.functions import secrets as S
from mnemospark.functions import text as T
from mnemospark.functions import vagueness as V
from mnemospark.queries.base import MEMORIES, QUESTIONS, memories, questions, read, skeleton_sql, slug_sql, strip_sql

QUERY, WORD, RUN = "[A-Za-z0-9_.:/@-]+", "[a-z0-9'']+", "[A-Za-z]+|[0-9]+"


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    c = F.col("content")
    return m.select("id", T.slugify(F.col("raw_subject")).alias("subject_slug"), F.md5(T.slugify(c)).alias("slug_md5"), F.md5(T.path_slug(c)).alias("path_slug_md5"))


SLUGS = f"""with {MEMORIES} select id, {slug_sql("raw_subject")} as subject_slug, md5({slug_sql("content")}) as slug_md5,
  md5(nullif(regexp_replace(regexp_replace(lower(content), '[^a-z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), '')) as path_slug_md5 from memories"""


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return memories(spark, sf_dir).select("id", F.md5(T.skeleton(c)).alias("skeleton_md5"), F.array_join(T.digit_runs(c), ",").alias("digits"), T.estimated_tokens(c).alias("tokens"), T.squeezed_prefix(c).alias("prefix"))


SKELETONS = f"""with {MEMORIES} select id, md5({skeleton_sql("content")}) as skeleton_md5, array_to_string(regexp_extract_all(content, '\\d+'), ',') as digits,
  greatest(1, length(content) // 4)::BIGINT as tokens, substr({strip_sql("regexp_replace(content, '\\s+', ' ', 'g')")}, 1, 100) as prefix from memories"""


def number_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events as texts with numbers: equal wording, other numbers."""
    e = read(spark, sf_dir, "events").selectExpr("event_id", "concat(event_type, '  event by user ', user_id) as a", "concat(upper(event_type), ' event by user ', user_id + event_id % 2, case when event_id % 5 = 0 then ' again' else '' end) as b")
    return e.groupBy(T.number_guard(F.col("a"), F.col("b")).alias("guarded")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


NUMBER_GUARD = f"""with e as (select event_id, event_type || '  event by user ' || user_id as a, upper(event_type) || ' event by user ' || (user_id + event_id % 2) || case when event_id % 5 = 0 then ' again' else '' end as b from events)
select ({skeleton_sql("a")} = {skeleton_sql("b")}) and regexp_extract_all(a, '\\d+') <> regexp_extract_all(b, '\\d+') as guarded, count(*) as n, min(event_id) as first_event from e group by 1"""


def match_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return questions(spark, sf_dir).select("query_id", T.match_query(q).alias("match"), F.size(T.match_terms(q)).cast("long").alias("n_terms"))


_TOKENS = f"regexp_extract_all(query, '{QUERY}')"
_VARIANTS = f"""case when regexp_matches(t, '[0-9]') and regexp_matches(t, '[A-Za-z]') and len(regexp_extract_all(t, '{RUN}')) >= 2 then
  case when array_to_string(regexp_extract_all(t, '{RUN}'), '') <> t then [array_to_string(regexp_extract_all(t, '{RUN}'), ' '), array_to_string(regexp_extract_all(t, '{RUN}'), '')] else [array_to_string(regexp_extract_all(t, '{RUN}'), ' ')] end else [] end"""
TERMS = f"flatten(list_transform({_TOKENS}, lambda t: list_concat([t], {_VARIANTS})))"
MATCH_TERMS = f"""with {QUESTIONS}, t as (select query_id, {TERMS} as terms from questions)
select query_id, array_to_string(list_transform(terms, lambda x: '"' || replace(x, '"', '""') || '"'), ' OR ') as match, len(terms)::BIGINT as n_terms from t"""


def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all texts: what names something in each, and whether the looser test agrees."""
    own = memories(spark, sf_dir).select("id", T.identifiers(F.col("content")).alias("found"), T.has_identifier(F.col("content")).alias("loose"))
    return own.select("id", F.array_join("found", " ").alias("identifiers"), F.size("found").cast("long").alias("n"), "loose")


IDENTIFIER_TOKENS = rf"""with {MEMORIES}, r as (select id, content, list_transform(regexp_extract_all(content, '{QUERY}'), lambda t: regexp_replace(t, '[._:/@-]+$', '')) as rights from memories),
p as (select id, content, list_transform(rights, lambda t: struct_pack(p := regexp_matches(t, '^\.[A-Za-z0-9_][A-Za-z0-9._-]*$') or regexp_matches(t, '^/[A-Za-z0-9._-][A-Za-z0-9._/-]*$'), t := t, b := regexp_replace(t, '^[._:/@-]+', ''))) as xs from r),
f as (select id, content, list_transform(list_filter(xs, lambda x: x.p or (x.b <> '' and ((regexp_matches(x.b, '[0-9]') and regexp_matches(x.b, '[A-Za-z]')) or regexp_matches(x.b, '[._:@]')
  or (regexp_matches(x.b, '[-/]') and (regexp_matches(x.b, '[0-9]') or (regexp_matches(x.b, '[A-Z]') and regexp_matches(x.b, '[a-z]')) or length(x.b) - length(replace(x.b, '/', '')) >= 2))
  or (regexp_matches(x.b, '[0-9]') and not regexp_matches(x.b, '[A-Za-z]') and length(x.b) >= 3)))), lambda x: case when x.p then x.t else x.b end) as found from p)
select id, array_to_string(found, ' ') as identifiers, len(found)::BIGINT as n,
  len(list_filter(regexp_extract_all(content, '{QUERY}'), lambda t: regexp_matches(t, '[0-9./:@_]') or regexp_matches(t, '^[A-Z][A-Z0-9_-]{{2,}}$'))) > 0 as loose from f"""


def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question against the document of its number."""
    both = questions(spark, sf_dir).join(memories(spark, sf_dir), F.col("query_id").cast("string") == F.col("id"))
    return both.select("query_id", F.round(T.keyword_coverage(F.col("query"), F.col("content")), 6).alias("coverage"), F.size(T.keywords(F.col("query"))).cast("long").alias("n_keywords"))


_WEIGHT = "(length(t) * case when regexp_matches(t, '[0-9./:@_]') or regexp_matches(t, '^[A-Z][A-Z0-9_-]{2,}$') then 2.0::DOUBLE else 1.0::DOUBLE end)"
COVERAGE = f"coalesce(list_sum(list_transform(list_filter({_TOKENS}, lambda t: contains(lower(content), lower(t))), lambda t: {_WEIGHT})), 0.0::DOUBLE) / list_sum(list_transform({_TOKENS}, lambda t: {_WEIGHT}))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
KEYWORDS = f"list_filter(list_distinct(regexp_extract_all(lower(query), '{WORD}')), lambda w: not list_contains({_STOP}, w))"
KEYWORD_COVERAGE = f"with {MEMORIES}, {QUESTIONS} select query_id, round({COVERAGE}, 6) as coverage, len({KEYWORDS})::BIGINT as n_keywords from questions join memories on cast(query_id as varchar) = id"


def secret_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = S.secret_flags(F.col("content"))
    return memories(spark, sf_dir).select("id", flags.alias("flags")).select("id", F.array_join("flags", "; ").alias("flags"), (F.size("flags") > 0).alias("blocked"))


def _redact(x: str) -> str:
    return f"substr({x}, 1, 4) || '****'"


_SAFE = r"regexp_replace(content, '\bsecret/[\w/-]+\b', 'VAULT_PATH_REF', 'g')"
_PLACE = "[" + ", ".join(f"'{w}'" for w in S.PLACEHOLDERS) + "]"
_IS_PLACE = lambda v: f"(list_contains({_PLACE}, lower({strip_sql(v)})) or regexp_matches({v}, '{S.REDACTED}') or (length({v}) >= 4 and len(list_distinct(string_split(lower({v}), ''))) = 1))"
_ENTROPY = "(select list_sum(list_transform(list_sort(map_values(histogram(ch))), lambda c: -(c / n) * log2(c / n))) from (select unnest(string_split(tok, '')) as ch, length(tok)::DOUBLE as n) group by n)"
_ASSIGN = S.ASSIGNMENT.replace("'", "''")
_NAMED = ", ".join(f"case when regexp_matches(safe, '{p}') then '{w} (' || {_redact(f'''regexp_extract(safe, '{p}')''')} || ')' end" for w, p in S.NAMED)
_NAME = strip_sql("string_split(string_split(x.w, '=')[1], ':')[1]")
SECRET_FLAGS = f"""with {MEMORIES}, s as (select id, {_SAFE} as safe from memories),
a as (select *, list_filter(list_zip(regexp_extract_all(safe, '{_ASSIGN}'), regexp_extract_all(safe, '{_ASSIGN}', 1)), lambda x: length(x[2]) >= 8 and not {_IS_PLACE("x[2]")})[1] as hit from s),
b as (select id, safe, list_filter([case when regexp_matches(safe, '{S.PRIVATE_KEY}') then 'private-key-block: PEM private key block detected' end, {_NAMED},
  case when hit is not null then 'secret-assignment: key=''' || {_NAME.replace("x.w", "hit[1]")} || ''' value=' || {_redact("hit[2]")} end], lambda f: f is not null) as named from a),
c as (select id, unnest(list_filter(regexp_extract_all(safe, '{S.CANDIDATE}'), lambda t: not regexp_matches(t, '{S.COMMIT}') and not {_IS_PLACE("t")})) as tok, generate_subscripts(list_filter(regexp_extract_all(safe, '{S.CANDIDATE}'), lambda t: not regexp_matches(t, '{S.COMMIT}') and not {_IS_PLACE("t")}), 1) as k from b where len(named) = 0),
h as (select id, k, tok, -sum(n / len * log2(n / len)) as e from (select id, k, tok, length(tok)::DOUBLE as len, ch, count(*)::DOUBLE as n from (select id, k, tok, unnest(string_split(tok, '')) as ch from c) group by id, k, tok, ch) group by id, k, tok),
g as (select id, arg_min('high-entropy-token: standalone token entropy=' || printf('%.2f', e) || ' (' || {_redact("tok")} || ')', k) as flag from h where e > 4.0 group by id)
select id, case when len(named) > 0 then array_to_string(named, '; ') else coalesce(flag, '') end as flags, len(named) > 0 or flag is not null as blocked from b left join g using (id)"""


def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long runs of all texts with their entropy."""
    own = memories(spark, sf_dir).select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(S.CANDIDATE), F.lit(0)))).alias("token"))
    return own.select("id", "token", F.round(S.entropy(F.col("token")), 6).alias("entropy"), S.is_placeholder(F.col("token")).alias("placeholder"))


ENTROPY_TOKENS = f"""with {MEMORIES}, c as (select id, unnest(list_distinct(regexp_extract_all(content, '{S.CANDIDATE}'))) as token from memories),
h as (select id, token, round(-sum(n / len * log2(n / len)), 6) + 0.0 as entropy from (select id, token, length(token)::DOUBLE as len, ch, count(*)::DOUBLE as n from (select id, token, unnest(string_split(token, '')) as ch from c) group by id, token, ch) group by id, token)
select id, token, case when entropy = 0 then 0.0::DOUBLE else entropy end as entropy, {_IS_PLACE("token")} as placeholder from h"""


def vagueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations and documents, with the subject that a document has."""
    turns = read(spark, sf_dir, "conversations").selectExpr("concat('c', conv_id, '-', turn) as id", "concat(case turn % 4 when 0 then 'This is ' when 1 then 'It runs and that should ' when 2 then 'This server ' else '' end, text) as content", "case when turn % 2 = 0 then 'server' when turn % 3 = 0 then 'It' end as raw_subject")
    both = memories(spark, sf_dir).select("id", "content", "raw_subject").unionByName(turns)
    return both.select("id", F.array_join(V.vagueness_flags(F.col("content"), F.col("raw_subject")), "; ").alias("flags"))


_IN = lambda x, words: f"{x} in (" + ", ".join(f"'{w}'" for w in words) + ")"
VAGUENESS = f"""with {MEMORIES}, both_ as (select id, content, raw_subject from memories union all select 'c' || conv_id || '-' || turn, case turn % 4 when 0 then 'This is ' when 1 then 'It runs and that should ' when 2 then 'This server ' else '' end || text, case when turn % 2 = 0 then 'server' when turn % 3 = 0 then 'It' end from conversations),
t as (select id, lower(content) as c, lower({strip_sql("raw_subject")}) as s, regexp_extract_all(lower(content), '{QUERY}') as ts from both_),
d as (select *, list_filter(range(1, len(ts)), lambda i: {_IN("ts[i]", V.DEMONSTRATIVES)} and {_IN("ts[i + 1]", V.VERBS)} and (i = 1 or {_IN("ts[i - 1]", V.CLAUSE_STARTS)}))[1] as k from t)
select id, case when len(ts) = 0 then 'content is empty' else array_to_string(list_filter([
  case when {_IN("ts[1]", V.LEADS)} and not {_IN("ts[1]", V.DEMONSTRATIVES)} then 'opens with unresolved reference ''' || ts[1] || '''' end,
  case when k is not null then 'dangling demonstrative ''' || ts[k] || ' ' || ts[k + 1] || '''' end,
  case when {_IN("s", V.LEADS)} then 'subject is a pronoun, not explicit' when s <> '' and not contains(c, s) then 'content does not contain the subject' end], lambda f: f is not null), '; ') end as flags from d"""


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers made of events: verdicts of the gate, the pair judge and the comparison judge, and dates."""
    e = read(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('<think>a b', event_id, '</think> ', element_at(array(' Store it', 'reject', 'maybe'), cast(event_id % 3 as int) + 1)) as gate",
        "concat('{\"verdict\": \"', element_at(array('Duplicate', ' distinct ', 'unsure'), cast(event_id % 3 as int) + 1), '\"', case when event_id % 7 = 0 then '' else '}' end) as pair",
        "element_at(array('Set A mentions it. FINAL: B', 'A or b', 'none', 'FINAL: tie, FINAL : A'), cast(event_id % 4 as int) + 1) as choice",
        "element_at(array('2024-01-05T10:00:00Z', '2024-02-30', '2024-03-01', 'soon', '2024-01-05T10:00:00+02:00'), cast(event_id % 5 as int) + 1) as at",
    )
    return e.select("event_id", P.gate_verdict(F.col("gate")).alias("gate"), P.pair_verdict(F.col("pair")).alias("pair"), P.choice_verdict(F.col("choice")).alias("choice"), F.unix_timestamp(P.iso_time(F.col("at"))).alias("at"), P.iso_date(F.col("at")).cast("string").alias("day"))


PARSED_ANSWERS = r"""with e as (select event_id, (['store', 'reject', null])[event_id % 3 + 1] as gate, case when event_id % 7 <> 0 then (['duplicate', 'distinct', null])[event_id % 3 + 1] end as pair,
  ['Set A mentions it. FINAL: B', 'A or b', 'none', 'FINAL: tie, FINAL : A'][event_id % 4 + 1] as choice, ['2024-01-05T10:00:00Z', '2024-02-30', '2024-03-01', 'soon', '2024-01-05T10:00:00+02:00'][event_id % 5 + 1] as "at" from events)
select event_id, gate, pair, coalesce(regexp_extract_all(upper(choice), 'FINAL\s*:\s*(A|B|TIE)\b', 1)[-1], regexp_extract_all(upper(choice), '\b(A|B|TIE)\b', 1)[-1], '?') as choice,
  epoch(try_cast(e.at as timestamptz))::BIGINT as "at", case when regexp_matches(e.at, '^\d{4}-\d{2}-\d{2}$') then cast(try_cast(e.at as date) as varchar) end as day from e"""


def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers made of questions, flattened and as snippets."""
    q = questions(spark, sf_dir).select("query_id", F.to_json(F.struct(F.array(F.struct(F.col("query").alias("memory")), F.struct(F.lit("").alias("memory"))).alias("results"))).alias("inner"))
    raw = F.when(F.col("query_id") % 4 == 0, F.to_json(F.struct(F.col("inner").alias("result")))).when(F.col("query_id") % 4 == 3, F.lit("no json [")).otherwise(F.col("inner"))
    return q.select("query_id", raw.alias("raw")).select("query_id", F.md5(P.flattened(F.col("raw"))).alias("flat_md5"), F.array_join(P.snippets(F.col("raw"), 20), "|").alias("snippets"))


TOOL_ANSWERS = f"""with {QUESTIONS} select query_id, md5(case when query_id % 4 = 3 then 'no json [' else query || chr(10) end) as flat_md5,
  case query_id % 4 when 0 then substr('{{"result":"{{\\"result', 1, 20) when 3 then 'no json [' else substr(query, 1, 20) || '|' end as snippets from questions"""

QUERIES = {f.__name__: f for f in (slugs, skeletons, number_guard, match_terms, identifier_tokens, keyword_coverage, secret_flags, entropy_tokens, vagueness, parsed_answers, tool_answers)}
SQL = {
    "slugs": SLUGS, "skeletons": SKELETONS, "number_guard": NUMBER_GUARD, "match_terms": MATCH_TERMS, "identifier_tokens": IDENTIFIER_TOKENS, "keyword_coverage": KEYWORD_COVERAGE,
    "secret_flags": SECRET_FLAGS, "entropy_tokens": ENTROPY_TOKENS, "vagueness": VAGUENESS, "parsed_answers": PARSED_ANSWERS, "tool_answers": TOOL_ANSWERS,
}
