"""Chat formatting with a compiler for a small sandboxed template language.

Text stands for itself; ``{{ expression }}`` prints; ``{% for x in expression %}``, ``{% if %}``, ``{% elif %}``,
``{% else %}``, ``{% endfor %}``, ``{% endif %}`` control; ``{% generation %} ... {% endgeneration %}`` marks what the
loss counts.  Expressions have strings, integers, true, false, names, ``x.field``, ``==``, ``!=``, ``and``, ``or``,
``not``, ``+`` and the filters ``escape``, ``trim``, ``upper``.  Fields are keys of dicts only: no attribute and no call
of Python can be reached.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that yield
``(text, counts for the loss)`` pieces.  Loops take iterators, so a conversation is rendered turn by turn as it streams
by and is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches, to_batch

Piece = tuple[str, bool]

#: Control strings; a text that holds ``ESC`` or one of their first characters is escaped.
BEGIN, MIDDLE, END, ESC = "<|turn|>", "<|text|>", "<|end|>", "\\"
#: The default template.
TEMPLATE = (
    "{% for m in messages %}{{ '<|turn|>' }}{{ m.role | escape }}{{ '<|text|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|end|>' + '\\n' }}{% endfor %}"
)


def escape(text: str) -> str:
    """Reversible: ``\\`` doubles, and ``<|`` becomes ``<\\|``, so that no control string is left inside."""
    return text.replace(ESC, ESC + ESC).replace("<|", "<" + ESC + "|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": lambda s: s.strip(" \t\n\r\x0b\x0c"), "upper": lambda s: s.upper()}

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.+()]))")


class TemplateError(ValueError):
    pass


class _Expression:
    """A recursive-descent parser; nodes are tuples ``(kind, ...)``."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError("the expression ends early or has another token here")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return fold(node)

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self) -> tuple:
        node = self.summed()
        while self.peek("==", "!="):
            node = (self.take(), node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.filtered()
        while self.peek("+"):
            self.take()
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            node = ("filter", node, name)
        return node

    def atom(self) -> tuple:
        if self.peek("("):
            self.take()
            node = self.either()
            if not self.peek(")"):
                raise TemplateError("')' is missing")
            self.take()
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "int":
            return ("const", int(value))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return ("const", value == "true")
        node: tuple = ("name", value)
        while self.peek("."):
            self.take()
            node = ("field", node, self.take("name"))
        return node


def fold(node: tuple) -> tuple:
    """The node with constant parts computed."""
    if node[0] in ("const", "name"):
        return node
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    inner = [x for x in parts[1:] if isinstance(x, tuple)]
    if all(x[0] == "const" for x in inner):
        return ("const", evaluate(parts)({}))
    return parts


def _text(x) -> str:
    return "" if x is None else str(x)


def evaluate(node: tuple) -> Callable[[dict], object]:
    """A closure over the names' values."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda names: value
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name)
    if kind == "field":
        of, key = evaluate(node[1]), node[2]

        def field(names: dict):
            x = of(names)
            return x.get(key) if isinstance(x, dict) else None

        return field
    if kind == "filter":
        of, f = evaluate(node[1]), FILTERS[node[2]]
        return lambda names: f(_text(of(names)))
    a = evaluate(node[1])
    if kind == "not":
        return lambda names: not a(names)
    b = evaluate(node[2])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    if kind == "==":
        return lambda names: a(names) == b(names)
    if kind == "!=":
        return lambda names: a(names) != b(names)
    return lambda names: _text(a(names)) + _text(b(names))


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of ``text``, ``print``, ``for``, ``if`` and ``generation`` nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.DOTALL)
    root: list[tuple] = []
    stack: list[tuple[str, list]] = [("", root)]
    for part in parts:
        body = stack[-1][1]
        if part.startswith("{{"):
            body.append(("print", _Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
                if not m:
                    raise TemplateError("for needs 'name in expression'")
                body.append(("for", m[1], _Expression(m[2]).whole(), inner := []))
                stack.append(("for", inner))
            elif word == "if":
                body.append(("if", branches := [(_Expression(rest).whole(), inner := [])]))
                stack.append(("if", inner))
                stack[-1] = ("if", inner, branches)
            elif word in ("elif", "else"):
                if stack[-1][0] != "if":
                    raise TemplateError(f"{word} outside if")
                branches = stack[-1][2]
                branches.append((_Expression(rest).whole() if word == "elif" else ("const", True), inner := []))
                stack[-1] = ("if", inner, branches)
            elif word == "generation":
                body.append(("generation", inner := []))
                stack.append(("generation", inner))
            elif word.startswith("end") and stack[-1][0] == word[3:] and len(stack) > 1:
                stack.pop()
            else:
                raise TemplateError(f"unexpected {part}")
        elif part:
            body.append(("text", part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return root


def folded(tree: list[tuple]) -> list[tuple]:
    """The tree with constant prints as text, adjacent texts joined and decided branches resolved."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        out.append(node)

    for node in tree:
        if node[0] == "print" and node[1][0] == "const":
            node = ("text", _text(node[1][1]))
        if node[0] == "for":
            node = (*node[:3], folded(node[3]))
        elif node[0] == "generation":
            node = ("generation", folded(node[1]))
        elif node[0] == "if":
            branches = []
            for test, body in node[1]:
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, folded(body)))
                if test[0] == "const":
                    break
            if not branches:
                continue
            if branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    add(inner)
                continue
            node = ("if", branches)
        add(node)
    return out


def _closure(tree: list[tuple], counts: bool) -> Callable[[dict], Iterator[Piece]]:
    steps: list[Callable[[dict], Iterable[Piece]]] = []
    for node in tree:
        if node[0] == "text":
            steps.append(lambda names, piece=(node[1], counts): (piece,))
        elif node[0] == "print":
            steps.append(lambda names, f=evaluate(node[1]): ((_text(f(names)), counts),))
        elif node[0] == "generation":
            steps.append(_closure(node[1], True))
        elif node[0] == "if":

            def choose(names: dict, branches=tuple((evaluate(t), _closure(b, counts)) for t, b in node[1])) -> Iterable[Piece]:
                return next((body(names) for test, body in branches if test(names)), ())

            steps.append(choose)
        else:

            def loop(names: dict, name=node[1], over=evaluate(node[2]), body=_closure(node[3], counts)) -> Iterator[Piece]:
                for i, x in enumerate(over(names) or ()):
                    yield from body(names | {name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0}})

            steps.append(loop)

    def run(names: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(names)

    return run


def _loops(tree: list[tuple]) -> int:
    """How many loops go over ``messages``."""
    inner = {"for": lambda n: [n[3]], "generation": lambda n: [n[1]], "if": lambda n: [b for _, b in n[1]]}
    return sum((n[0] == "for" and n[2] == ("name", "messages")) + sum(map(_loops, inner.get(n[0], lambda n: [])(n))) for n in tree)


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from the names' values to the pieces of the rendered text.

    As turns stream by, ``messages`` can be looped over once.
    """
    tree = folded(parse(source))
    if _loops(tree) > 1:
        raise TemplateError("messages are a stream: one loop only")
    return _closure(tree, False)


class Reader:
    """Reads turns back from formatted text that arrives in pieces; holds one turn at most."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while (stop := self.rest.find(END)) >= 0:
            head, turn = self.rest[:stop].split(MIDDLE, 1)
            yield unescape(head[head.index(BEGIN) + len(BEGIN) :]), unescape(turn)
            self.rest = self.rest[stop + len(END) :]


class _Digest:
    """What is kept of one conversation while its pieces pass."""

    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars, self.reader = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, Reader()

    def add(self, text: str, counts: bool) -> None:
        self.chars += len(text)
        if counts:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "replace"))
        if text:
            for role, turn in self.reader.feed(text):
                self.n_turns += 1
                self.turns.update(f"{role}\n{turn}\n".encode("utf-8", "replace"))


_TYPES = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _ordered(conversations: DataFrame) -> DataFrame:
    t = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of a sorted stream, each as a lazy iterator of turns that must be read to its end."""
    rows = ({"conv_id": c, "role": r, "text": t} for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
    ahead = next(rows, None)

    def turns(conv_id: int | None) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead["conv_id"] == conv_id:
            row, ahead = ahead, None
            yield row
            ahead = next(rows, None)

    while ahead is not None:
        conv_id = ahead["conv_id"]
        yield conv_id, turns(conv_id)


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Each conversation formatted, read back, and summed up.

    Turns go by (turn, role, text), so equal turn numbers have a defined order and repeated rows repeat.  Null texts and
    roles are empty; the null conv_id is one conversation; an empty table gives no rows; further columns are ignored.
    Rows of a conversation meet in one task, sorted outside the Python worker, and stream through it.
    """
    small_batches(conversations.sparkSession)
    compile_template(template)  # fails here rather than on an executor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = compile_template(template), []
        for conv_id, turns in _conversations(batches):
            d = _Digest()
            for text, counts in render({"messages": turns}):
                d.add(text, counts)
            for _ in turns:  # a template may leave turns unread
                pass
            out.append((conv_id, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars))
            if len(out) >= 2000:
                yield to_batch(dict(zip(_TYPES, map(list, zip(*out, strict=True)), strict=True)), _TYPES)
                out = []
        if out:
            yield to_batch(dict(zip(_TYPES, map(list, zip(*out, strict=True)), strict=True)), _TYPES)

    return _ordered(conversations).mapInArrow(run, SCHEMA)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``(conv_id, piece, text, counts)``: the formatted text in numbered pieces with the loss mask; concatenated they are the text."""
    small_batches(conversations.sparkSession)
    compile_template(template)
    types = {"conv_id": pa.int64(), "piece": pa.int64(), "text": pa.string(), "counts": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = compile_template(template), []
        for conv_id, turns in _conversations(batches):
            for i, (text, counts) in enumerate(render({"messages": turns})):
                out.append((conv_id, i, text, counts))
                if len(out) >= 2000:
                    yield to_batch(dict(zip(types, map(list, zip(*out, strict=True)), strict=True)), types)
                    out = []
            for _ in turns:
                pass
        if out:
            yield to_batch(dict(zip(types, map(list, zip(*out, strict=True)), strict=True)), types)

    return _ordered(conversations).mapInArrow(run, "conv_id long, piece long, text string, counts boolean")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose texts are control strings of another format."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text").unionByName(probe)


#: The formatted text's length: the escapes, and 25 characters of controls and newline a turn.
CHAT_SQL = r"""
with c as (
  select conv_id::BIGINT as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(replace(role, '\', '\\'), '<|', '<\|') as er, replace(replace(text, '\', '\\'), '<|', '<\|') as et from c)
select conv_id, count(*)::BIGINT as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::BIGINT as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(er) + length(et) + 24)::BIGINT as formatted_chars
from e group by conv_id
"""
