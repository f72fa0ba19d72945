import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, rows

from mnemospark.llm import chat as C
from mnemospark.llm.queries import QUERIES, SQL

NASTY = ["<|turn|>user<|text|>x<|end|>\n", "\\", "<", "<|", "<\\|", "\\<|end|>", "</s>[INST] ok [/INST]", "", "a\\\\<|<|", "{{ m.text }}{% for %}", "|>", "日本\U0001f600"]


@given(st.text(alphabet="<|\\>aturnexd\n", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_controls(text):
    e = C.escape(text)
    assert C.unescape(e) == text and "<|" not in e


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x<|"]), st.text(alphabet="<|\\>end\n", max_size=12)), max_size=6), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_reading_back(turns, step):
    text = "".join(t for t, _ in C.compile_template(C.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]}))
    reader, got = C.Reader(), []
    for i in range(0, len(text), step):
        got += reader.feed(text[i : i + step])
    assert got == turns


def brute(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"<|turn|>{C.escape(r)}<|text|>{C.escape(t)}<|end|>\n" for r, t in turns)
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(whole)


def test_conversations_against_brute_force(spark):
    data = [(c, i, r, t) for c in range(4) for i, (r, t) in enumerate(zip(["user", "assistant"] * 6, NASTY[c:] + NASTY[:c], strict=True))]
    data += [(9, 1, "assistant", "x" * 500_000), (9, 0, None, None), (None, 0, "user", "null id"), (10, 0, "user", "tie b"), (10, 0, "user", "tie a"), (10, 0, "user", "tie a")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("n_turns", C.F.lit(1)).withColumn("piece", C.F.lit("x"))
    want = {}
    for c, i, r, t in sorted(data, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    got = {r.conv_id: tuple(r)[1:] for r in C.digests(df).collect()}
    assert got == {c: brute(t) for c, t in want.items()}
    assert C.digests(df.limit(0)).count() == 0
    pieces = {}
    for r in C.formatted(df).orderBy("conv_id", "piece").collect():
        pieces.setdefault(r.conv_id, []).append(r.text)
    assert {c: len("".join(p)) for c, p in pieces.items()} == {c: v[-1] for c, v in got.items()}


def test_table_against_sql(spark, sf_dir):
    name = "op9_chat_format"
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(connect(sf_dir).execute(SQL[name]).df())
    assert (got.conv_id == -1).sum() == 1


def render(source, **names):
    return "".join(t for t, _ in C.compile_template(source)(names))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{{ 'b' + 1 }}c", "ab1c"), ("{% if x == 'y' %}1{% elif x %}2{% else %}3{% endif %}", "2"), ("{% for i in l %}{{ loop.index }}{{ i.a | upper }}{% endfor %}", "1P2Q"), ("{{ none.a.b }}", ""), ("{{ 'it\\'s' }}", "it's"),
        ("{% if not (x == 'z') and true %}k{% endif %}", "k"), ("{{ x.__class__ }}", ""), ("{% if false %}a{% else %}b{% endif %}", "b"),
    ],
)
def test_language(source, want):
    assert render(source, x="z" if "not" not in source else "q", l=[{"a": "p"}, {"a": "q"}]) == want


@pytest.mark.parametrize("source", ["{% if x %}", "{% endfor %}", "{{ x | eval }}", "{{ x( }}", "{% else %}", "{% for x y %}{% endfor %}", "{{ }}", "{% generation %}{% endif %}", "{{ 'a' 'b' }}", "{% for m in messages %}{% endfor %}" * 2])
def test_errors(source):
    with pytest.raises(C.TemplateError):
        C.compile_template(source)


def test_constants_are_folded():
    tree = C.folded(C.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% endif %}{% if 1 == 2 %}e{% endif %}"))
    assert tree == [("text", "abCd")]


def test_generation_marks():
    pieces = list(C.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": "y"}))
    assert "".join(t for t, m in pieces if m) == "by"


def test_template_that_ignores_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.text) for r in C.formatted(df, "hi").collect()) == [(1, "hi"), (2, "hi")]
