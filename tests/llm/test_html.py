import html
import itertools
import re

import numpy as np
import pytest

from mnemospark.llm import html_crf as H


@pytest.fixture(scope="module")
def field():
    return H.default_field()


def template_text(page):
    """The driver's pages: what stands in <article>, block by block."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.DOTALL)
    parts = re.split(r"</?(?:p|h1)>", inner[1].replace("<br>", " ")) if inner else []
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts)
    return "\n".join(x for x in texts if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r.page_id: template_text(r.html) for r in pages.collect()}
    got = H.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_held_out_pages(field):
    right = whole = total = 0
    for page, text in H.labelled_pages(300, seed=99):
        blocks, labels = H._with_labels(page, text)
        assert sum(labels) == text.count("\n") + 1
        got = field.decode(blocks)
        right, total, whole = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels), whole + (H.main_text(page, field) == text)
    assert right / total > 0.995 and whole > 285


def test_viterbi_against_brute_force(field):
    rng = np.random.default_rng(0)
    for n in range(1, 9):
        f = H.Field({}, np.zeros((0, 2)), rng.normal(size=(2, 2)) * 2)
        s = rng.normal(size=(n, 2))
        f.scores = lambda blocks, s=s: s
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(s[i, y[i]] for i in range(n)) + sum(f.moves[a, b] for a, b in itertools.pairwise(y)))
        assert tuple(f.decode([None] * n)) == best


def test_training_climbs():
    pages = [H._with_labels(*p) for p in H.labelled_pages(40, 3)]
    def right(f):
        return sum(a == b for blocks, labels in pages for a, b in zip(f.decode(blocks), labels, strict=True))

    assert right(H.train(pages, steps=60)) > right(H.train(pages, steps=1)) * 1.02


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a<p>b", ["a", "b"]), ("<p>a<br>b &amp; c</p>", ["a b & c"]), ("<script>var x='<p>no</p>'</script><p>x", ["x"]), ("<!-- <p>no --><p>y", ["y"]), ("<ul><li>1<li>2</ul>z", ["1", "2", "z"]), ("<b><p>bold</p></b>", ["bold"]), ("plain", ["plain"]), ("", []), (None, []),
        ("<div>a<", ["a<"]), ("<table><tr><td>1<td>2</table>", ["1", "2"]), ("<p title='a>b'>q</p>", ["q"]), ("</p></div>k", ["k"]), ("<style>p{}</style>\n\t", []), ("a<hr>b", ["a", "b"]), ("<textarea><p>no</textarea><p>r", ["r"]), ("&eacute;&#233;&nbsp;x", ["éé x"]), ("<script>never closed <p>x", []),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in H.blocks_of(page)] == texts


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>t</title><body><article><h1>H</h1><p>one", ["H", "one"]), ("<head><title>t</title><meta charset=utf-8><p>one", ["one"]), ("<head><title>t</title>plain words", ["plain words"]), ("<head><noscript><p>no</p><body><p>yes", ["yes"]),
        ("<p>See <a href=/x title=it's>this</a> now</p><p>More.</p><p>That's all.", ["See this now", "More.", "That's all."]), ('<p title="x>Unbalanced text</p>', ["Unbalanced text"]), ("<p title='x>One</p><p class='y'>Two", ["One", "Two"]),
        ('<p title="a > b" class=c>q</p>', ["q"]), ('<a href="/x"class="y">link</a>', ["link"]), ("<p data-x = '<b>no</b>' >yes", ["yes"]), ("<p a=b/c>x<br/>y</p>", ["x y"]), ("a</ b>c", ["ac"]), ("<p <b>>x", [">x"]), ("x<p", ["x"]), ("<!-->a<!--->b<!-- c -->d", ["abd"]),
        ("<script>if (a<b) '</scr'</SCRIPT >t", ["t"]), ("<p>1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]), ("<title>a<p>b</title><p>c", ["c"]),
    ],
)
def test_markup_of_the_wild(page, texts):
    assert [b.text for b in H.blocks_of(page)] == texts


@pytest.mark.parametrize("part", ["<p a='x>t", '<p a="x>t', "<p title=it's>t", "<div>t", "<b>t</i>", "<!-- x", "<a href=", "<![CDATA[x", "</p", '<p a="x"b=\'>'])
def test_time_is_linear(part):
    import time

    def seconds(n):
        began = time.process_time()
        H.blocks_of(part * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(16_000) < 12 * max(seconds(4000), 0.02)


def test_edge_cases(spark, field):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<article><p>" + "Long text, here. " * 60_000 + "</article>"), (3, "u", deep), (4, "u", "\x00<<<>>>&&;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", H.F.lit(1)).withColumn("n_chars", H.F.lit("x"))
    got = H.extract(df).collect()
    assert len(got) == 6 and sum(r.text == "" for r in got) >= 3 and max(r.n_chars for r in got) > 1_000_000 - 10
    assert H.extract(df.limit(0)).count() == 0


def test_other_designs(field):
    page = "<body><header class=masthead><a href=/>Home</a></header><div id=cookie-notice><p>We use cookies here.</p></div><main><h1>Title here</h1><p>First words, of some length, that tell a story.</p><div class=ad>Buy now!</div><p>More of it follows.</p></main><section class=comments><p>Nice article, thank you.</p></section><aside><p>Related things</p></aside><footer>&copy; 2024</footer>"
    assert H.main_text(page, field) == "Title here\nFirst words, of some length, that tell a story.\nMore of it follows."
