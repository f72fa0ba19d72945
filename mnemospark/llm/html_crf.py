"""HTML extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: stretches of text between block-level tags, in page order, each with the tags, classes
and ids above it, the share of link text, length and punctuation.  Scripts, styles, templates, comments and the head are
markup and never blocks.  The field has a weight for each feature and label and for each pair of neighbouring labels;
it is trained on labelled pages by gradient ascent on the exact likelihood (forward-backward), and a page is decoded by
Viterbi.  The blocks labelled as main text, joined by newlines, are the result.

The labelled pages are made here, by rule: ``labelled_pages`` lays out invented text in many page designs, with and
without semantic tags, and knows what of each page is the article.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches, to_batch

#: Labelled pages that the field is trained on, the seed they come from, steps and rate of the training, and its penalty.
PAGES, SEED, STEPS, RATE, PENALTY = 1500, 7, 150, 0.2, 1e-5

#: Tag names by their role in HTML.
SKIPPED = frozenset("script style template noscript head title svg iframe object select textarea".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends open elements of the value (up to the nearest element that holds them).
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot div section article aside main nav header footer form body html fieldset blockquote figure details".split())

#: Start tags that may stand in a head; any other one, or text, ends it.
IN_HEAD = frozenset("head title script style meta link base noscript template".split())

_MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"[^\s/>]+")
_NAMED = frozenset(("class", "id", "role"))
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text of a leaf block, what stands above it, its own tag, and how many of its characters are link text."""

    text: str
    above: tuple[str, ...]
    tag: str
    linked: int


@dataclass
class Tag:
    """A start or end tag, the values of its attributes by name, and whether it ends in a slash."""

    name: str
    closing: bool
    attributes: dict[str, str]
    empty: bool


def read_tag(page: str, at: int) -> tuple[Tag | None, int]:
    """The tag whose name begins at ``at`` and where the page goes on; None if the page ends within it.

    Attributes are read as the standard does: a quote only opens a value right after the equals sign, so that other
    quotes are characters like any.  Only an unclosed value, which would swallow text, is read otherwise: if no quote
    follows, or the next one has a ``>`` before it and no end of a value behind it, the value ends at the first ``>``.
    """
    closing = page[at] == "/"
    at += closing
    stop = _NAME_END.search(page, at)
    if not stop:
        return None, len(page)
    tag, i, n = Tag(page[at : stop.start()].lower(), closing, {}, False), stop.start(), len(page)
    while i < n:
        ch = page[i]
        if ch == ">":
            return tag, i + 1
        if ch == "/" or ch.isspace():
            tag.empty = ch == "/" or (tag.empty and ch != "/")
            i += 1
            continue
        tag.empty = False
        word = _ATTRIBUTE.match(page, i)
        equals = page.find("=", i + 1, word.end())
        if equals < 0:
            name, i = word[0].lower(), word.end()
            k = i
            while k < n and page[k].isspace():
                k += 1
            if k >= n or page[k] != "=":
                tag.attributes.setdefault(name, "")
                continue
            i = k + 1
        else:
            name, i = page[i:equals].lower(), equals + 1
        while i < n and page[i].isspace():
            i += 1
        if i < n and page[i] in "\"'":
            shut, over = page.find(page[i], i + 1), page.find(">", i + 1)
            if shut < 0 or (0 <= over < shut and not (page[shut + 1 : shut + 2] in "/>" or page[shut + 1].isspace())):
                shut = over
            if shut < 0:
                return None, n
            tag.attributes.setdefault(name, page[i + 1 : shut])
            i = shut + (page[shut] != ">")
        else:
            k = i
            while k < n and page[k] != ">" and not page[k].isspace():
                k += 1
            tag.attributes.setdefault(name, page[i:k])
            i = k
    return None, n


def tokens_of(page: str) -> Iterator[str | Tag]:
    """Texts and tags of a page, in order and in linear time; comments and declarations are left out.

    What a script, style, text area or title holds is passed over as a whole; so is the rest of the page if such an
    element is never closed.
    """
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            yield page[at:]
            return
        if m.start() > at:
            yield page[at : m.start()]
        at = m.end()
        ch = page[at]
        if page.startswith("!--", at):
            stop = at + 3 if page.startswith(("!-->", "!--->"), at) else page.find("-->", at + 3)
            at = n if stop < 0 else page.find(">", stop) + 1
        elif page.startswith("![CDATA[", at):
            stop = page.find("]]>", at + 8)
            yield page[at + 8 : n if stop < 0 else stop]
            at = n if stop < 0 else stop + 3
        elif ch in "!?" or (ch == "/" and not page[at + 1 : at + 2].isalpha()):
            if ch == "/" and at + 1 >= n:
                yield "</"
                return
            stop = page.find(">", at)
            at = n if stop < 0 else stop + 1
        else:
            tag, at = read_tag(page, at)
            if tag is None:
                return
            yield tag
            if tag.name in RAW and not tag.closing:
                stop = re.compile(rf"</{tag.name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = stop.start() if stop else n


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page; any input gives some list, broken markup included.

    ``body``, any element that can't stand in a head, and text end a head that isn't closed.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: dict[str, int] = {}  # open elements by tag, open block elements in order, and how often a name stands above
    blocks: list[str] = []
    above: dict[str, int] = {}
    buffer: list[str] = []
    linked = skipping = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                out.append(Block(text, tuple(above), blocks[-1] if blocks else "", linked))
            buffer.clear()
        linked = 0

    def drop(k: int) -> None:
        """The element at place k goes; those above it stay."""
        nonlocal skipping
        tag, own = stack.pop(k)
        opened[tag] -= 1
        skipping -= tag in SKIPPED
        if tag in BLOCK:
            blocks.pop()
        for x in own:
            above[x] -= 1
            if not above[x]:
                del above[x]

    def pop(k: int) -> None:
        while len(stack) > k:
            drop(len(stack) - 1)

    def end_head(whole: bool = False) -> None:
        if opened.get("head"):
            k = next(i for i, (t, _) in enumerate(stack) if t == "head")
            if whole or k == len(stack) - 1:
                pop(k)

    for token in tokens_of(page or ""):
        if isinstance(token, str):
            if token.strip():
                end_head()
            if not skipping:
                text = html_lib.unescape(token)
                buffer.append(text)
                if opened.get("a"):
                    linked += len(text.strip())
            continue
        tag = token.name
        if tag not in IN_HEAD and not token.closing:
            end_head(tag == "body")
        if tag in VOID:
            if tag == "br" and not skipping:
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        if token.closing:
            if opened.get(tag):
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if tag not in BLOCK and any(t in BLOCK for t, _ in stack[k + 1 :]):
                    drop(k)  # an inline end across blocks: the inline element alone goes
                else:
                    if any(t in BLOCK for t, _ in stack[k:]):
                        flush()
                    pop(k)
            continue
        if tag in BLOCK:
            flush()
            ends = ENDS.get(tag, {"p"} if tag not in ("td", "th") else set())
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends or stack[i][0] in HOLDERS), -1)
            if k >= 0 and stack[k][0] in ends:
                while k > 0 and stack[k - 1][0] in ends:
                    k -= 1
                pop(k)
        if not token.empty:
            own = tuple(f"c:{x}" for name, value in token.attributes.items() if name in _NAMED for x in _PART.findall(value.lower()))
            stack.append((tag, (f"a:{tag}", *own)))
            opened[tag] = opened.get(tag, 0) + 1
            skipping += tag in SKIPPED
            if tag in BLOCK:
                blocks.append(tag)
            for x in stack[-1][1]:
                above[x] = above.get(x, 0) + 1
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        density = b.linked / max(1, len(b.text))
        marks = sum(b.text.count(x) for x in ".,;:!?")
        f = ["bias", *b.above, f"t:{b.tag}", f"len:{min(7, words.bit_length())}", f"link:{min(3, int(density * 3.999))}", f"marks:{min(3, marks)}", f"end:{b.text[-1] in '.!?…'}"]
        f += [f"pos:{4 * i // n}", "digits" if any(ch.isdigit() for ch in b.text[:40]) else "letters"]
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        out.append(f)
    return out


class Field:
    """Two labels: 0 for the rest of a page, 1 for its main text."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, blocks: list[Block]) -> np.ndarray:
        get = self.index.get
        return np.array([self.weights[[k for k in map(get, f) if k is not None]].sum(axis=0) for f in features(blocks)]).reshape(-1, 2)

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not blocks:
            return []
        s = self.scores(blocks).tolist()
        (aa, ab), (ba, bb) = self.moves.tolist()
        a, b, back = s[0][0], s[0][1], []
        for x, y in s[1:]:
            back.append((int(a + aa < b + ba), int(a + ab < b + bb)))
            a, b = max(a + aa, b + ba) + x, max(a + ab, b + bb) + y
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam; all pages advance together through forward-backward."""
    pages = [p for p in pages if p[0]]
    named = [features(b) for b, _ in pages]
    seen: dict[str, int] = {}
    for page in named:
        for f in page:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    index = {x: i for i, x in enumerate(sorted(k for k, n in seen.items() if n >= 3))}
    n, longest = len(pages), max(len(b) for b, _ in pages)
    rows, cols, cell = [], [], []
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (page, (_, labels)) in enumerate(zip(named, pages, strict=True)):
        gold[i, : len(labels)], mask[i, : len(labels)] = labels, True
        for j, f in enumerate(page):
            own = [index[x] for x in f if x in index]
            cell += [i * longest + j] * len(own)
            cols += own
    cell, cols = np.array(cell), np.array(cols)
    w, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    want = np.zeros((n, longest, 2))
    np.put_along_axis(want, gold[..., None], 1.0, axis=2)
    want *= mask[..., None]
    want_moves = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & mask[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, steps + 1):
        s = np.stack([np.bincount(cell, w[cols, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        forward = np.zeros((n, longest, 2))
        forward[:, 0] = s[:, 0]
        for j in range(1, longest):
            x = np.logaddexp.reduce(forward[:, j - 1, :, None] + moves[None], axis=1) + s[:, j]
            forward[:, j] = np.where(mask[:, j, None], x, forward[:, j - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward = np.zeros((n, longest, 2))
        got_moves = np.zeros((2, 2))
        for j in range(longest - 1, 0, -1):
            on = s[:, j] + backward[:, j]
            both = forward[:, j - 1, :, None] + moves[None] + on[:, None, :] - total[:, None, None]
            got_moves += (np.exp(both) * mask[:, j, None, None]).sum(axis=0)
            x = np.logaddexp.reduce(moves[None] + on[:, None, :], axis=2)
            backward[:, j - 1] = np.where(mask[:, j, None], x, 0.0)
        got = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        gap = (want - got).reshape(-1, 2) / n
        gradient = np.stack([np.bincount(cols, gap[cell, k], len(index)) for k in (0, 1)], axis=1) - penalty * w
        for value, g, m, v in ((w, gradient, state[0], state[1]), (moves, (want_moves - got_moves) / n - penalty * moves, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(index, w, moves)


#: Names that page designs give to their parts.
_REST = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links", "header": "header masthead topbar site-header banner-top branding", "footer": "footer site-footer colophon copyright bottom legal",
    "aside": "sidebar aside side rail widget widgets related recommended trending more-stories", "ad": "ad ads advert advertisement sponsored promo banner adsbox sponsor", "notice": "cookie cookie-notice gdpr consent notice alert privacy-banner newsletter popup modal",
    "comments": "comments comment comment-list discussion replies respond disqus", "form": "form search-form login subscribe signup newsletter-form", "social": "share social sharing follow tags meta toolbar",
}
_MAIN = "content post entry article article-body post-content entry-content story main-content body-text text post-body page-content".split()


def _prose(rng: random.Random, low: int, high: int, ends: bool = True) -> str:
    def word() -> str:
        return "".join(rng.choice(("ra", "lo", "ti", "en", "mé", "sk", "or", "u", "de", "ba", "ch", "ün")) for _ in range(rng.randint(1, 4)))

    words = [word() + rng.choice(("", "", "", "", "", ",", ".")) for _ in range(rng.randint(low, high))]
    text = " ".join(words)
    return (text[:1].upper() + text[1:]).rstrip(",.") + ("." if ends else "")


def labelled_pages(count: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, str]]:
    """``(html, main text)`` of invented pages in many designs."""
    rng = random.Random(seed)

    def wrap(tag: str, names: str | None, inner: str) -> str:
        mark = "" if names is None else f' {rng.choice(("class", "class", "id"))}="{names}"'
        return f"<{tag}{mark}>{inner}</{tag}>"

    def rest(kind: str) -> str:
        name = rng.choice(_REST[kind].split())
        semantic = kind in ("nav", "header", "footer", "aside", "form")
        tag = kind if semantic and rng.random() < 0.6 else rng.choice(("div", "section", "ul") if kind in ("nav", "social", "comments") else ("div", "section"))
        names = None if tag == kind and rng.random() < 0.5 else name
        link = lambda: f'<a href="/{rng.randint(1, 999)}">{_prose(rng, 1, 3, False)}</a>'
        if tag == "ul":
            return wrap(tag, names, "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7))))
        if kind == "nav":
            return wrap(tag, names, "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7))) + "</ul>")
        if kind == "footer":
            return wrap(tag, names, rng.choice(("&copy; ", "© ", "")) + _prose(rng, 2, 14) + (f"<p>{link()}</p>" if rng.random() < 0.3 else ""))
        if kind == "comments":
            return wrap(tag, names, "".join(rng.choice(("<p>{}</p>", '<div class="comment">{}</div>', "<li>{}</li>")).format(_prose(rng, 4, 40)) for _ in range(rng.randint(1, 5))))
        if kind == "form":
            return wrap(tag, names, f"<label>{_prose(rng, 1, 4, False)}</label><input name=q><button>{_prose(rng, 1, 2, False)}</button>")
        if kind in ("aside", "social"):
            return wrap(tag, names, f"<h3>{_prose(rng, 1, 3, False)}</h3>" + "".join(rng.choice(("<p>{}</p>", "<div>{}</div>")).format(rng.choice((link(), _prose(rng, 3, 25)))) for _ in range(rng.randint(1, 4))))
        return wrap(tag, names, rng.choice(("{}", "<p>{}</p>", "<span>{}</span>")).format(_prose(rng, 3, 60, rng.random() < 0.7)))

    for _ in range(count):
        out: list[str] = []
        title = _prose(rng, 2, 9)
        parts = [f"<h1>{title}</h1>"]
        out.append(title)
        for _ in range(rng.choice((0, 1, 2, 4, 8, 14))):
            if rng.random() < 0.1:
                parts.append(rest(rng.choice(("ad", "aside", "social", "form", "notice"))))
            kind, text = rng.random(), _prose(rng, 1, 60, rng.random() < 0.6)
            if rng.random() < 0.1:
                text = text.replace(" ", " | ")
            if kind < 0.7:
                parts.append(rng.choice(("<p>{}</p>", "<p>{}", "<p><b>{}<br></p>", "<p>{}</p>\n", "<p>{}<br></p>")).format(text.replace(" ", rng.choice((" ", "\n  ")), 1)))
            elif kind < 0.8:
                parts.append(f"<h2>{text}</h2>")
            elif kind < 0.9:
                more = _prose(rng, 1, 20)
                parts.append(f"<ul><li>{text}</li><li>{more}</li></ul>")
                out.append(text)
                text = more
            else:
                parts.append(rng.choice(("<blockquote>{}</blockquote>", "<pre>{}</pre>", '<p>{} <a href="/x">' + "</a></p>")).format(text))
            out.append(text)
        inner = "".join(parts)
        design = rng.random()
        if design < 0.45:
            body = wrap("article", rng.choice((None, None, rng.choice(_MAIN))), inner)
        elif design < 0.6:
            body = wrap("main", rng.choice((None, rng.choice(_MAIN))), inner)
        else:
            body = wrap(rng.choice(("div", "div", "section")), rng.choice(_MAIN), inner)
        before = [rest(k) for k in ("nav", "header", "notice", "ad", "aside", "form", "social") if rng.random() < 0.4]
        after = [rest(k) for k in ("comments", "aside", "social", "ad", "form", "nav", "notice") if rng.random() < 0.3] + ([rest("footer")] if rng.random() < 0.85 else [])
        head = f"<head><meta charset=utf-8><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        page = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{rng.choice(('', '<!-- c -->'))}{body}{''.join(after)}</body></html>"
        yield page, "\n".join(_SPACE.sub(" ", html_lib.unescape(x)).strip() for x in out)


def _with_labels(page: str, text: str) -> tuple[list[Block], list[int]]:
    """Blocks with labels: the article's lines, in order, are found among the blocks."""
    blocks, lines, k = blocks_of(page), text.split("\n"), 0
    labels = []
    for b in blocks:
        hit = k < len(lines) and b.text == lines[k]
        labels.append(int(hit))
        k += hit
    return blocks, labels


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on ``PAGES`` invented pages; takes some seconds, once in a process."""
    return train([_with_labels(*p) for p in labelled_pages()])


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, label in zip(blocks, field.decode(blocks), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page.

    Null and empty pages, and those without main text, have an empty text; very long pages are read whole, in linear time,
    one at a time; repeated rows are repeated; null ids and urls are carried through; an empty table gives no rows;
    further columns are ignored.  Rows don't depend on one another.
    """
    small_batches(pages.sparkSession)
    field = field or default_field()
    types = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, field) for h in b.column(2).to_pylist()]
            yield to_batch({"page_id": b.column(0).to_pylist(), "url": b.column(1).to_pylist(), "text": texts, "n_chars": [len(t) for t in texts]}, types)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
