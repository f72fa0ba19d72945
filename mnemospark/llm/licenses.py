"""License scans by matching template markup.

A template is license wording with markup: ``<<beginOptional>> ... <<endOptional>>`` encloses words that may be left
out, ``<<var;max=N>>`` stands for up to N words of any kind.  A template is compiled into an automaton over words: a
state for each mandatory or optional word, skips over optional regions, and counting states for replaceable ones.  A
text is accepted where all mandatory words follow one another exactly.

Only places where a template's first mandatory word stands are tried, and they are found with one search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches, to_batch

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: What the BSD licenses share, and templates by label.  The wording is that of the licenses, from the first
#: words of the grant to the end; titles and copyright lines stand before it.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<var;max=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<var;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. %s "
    'THIS SOFTWARE IS PROVIDED BY <<var;max=8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "cc-by-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons attribution<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY 4.0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>the<<endOptional>> CC BY-SA 4.0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>the<<endOptional>> CC BY-NC 4.0",
    "cc-by-nd-4.0": "licensed under <<beginOptional>>the<<endOptional>> CC BY-ND 4.0",
    "cc0-1.0": "<<beginOptional>>released under<<endOptional>> CC0 1.0 <<beginOptional>>universal<<endOptional>>",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the free software foundation either<<endOptional>> version 3",
    "gpl-2.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the free software foundation either<<endOptional>> version 2",
    "lgpl-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License version 3",
    "agpl-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Affero General Public License version 3",
    "apache-2.0": "licensed under the Apache License <<beginOptional>>,<<endOptional>> version 2.0 <<beginOptional>>the License you may not use this file except in compliance with the License<<endOptional>>",
    "mpl-2.0": "subject to the terms of the Mozilla Public License <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0",
    "cc-by-4.0-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution 4.0 International <<beginOptional>>Public<<endOptional>> License",
    "gpl-3.0-or-later": "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2.0-or-later": "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _BSD % "",
    "bsd-3-clause": _BSD % "<<var;max=1>> Neither the name of <<var;max=12>> nor the names of <<var;max=4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-notice": "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "copyright-notice": "Copyright <<beginOptional>>c<<endOptional>> <<var;max=8>> All rights reserved",
}

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TO_WORDS = bytes(0x20 if i in _SEPARATORS else (i + 32 if 0x41 <= i <= 0x5A else i) for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()


@dataclass
class Automaton:
    """Nodes by number: ``(word, limit)`` with a word to meet, or None and the most words to skip; ``skips`` leave out regions."""

    nodes: list[tuple[bytes | None, int]] = field(default_factory=list)
    skips: dict[int, list[int]] = field(default_factory=dict)
    mandatory: int = 0

    def closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, seen = list(states), set(states)
        while todo:
            at, used = todo.pop()
            more = [(x, 0) for x in self.skips.get(at, ())]
            if at < len(self.nodes) and self.nodes[at][0] is None:
                more.append((at + 1, 0))
            for x in more:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def longest(self, words: list[bytes], start: int) -> int:
        """Where the longest accepted run that begins at ``start`` ends; -1 if there is none."""
        states, end, i = self.closure({(0, 0)}), -1, start
        while True:
            if any(at == len(self.nodes) for at, _ in states):
                end = i
            if i >= len(words) or not states:
                return end
            w, following = words[i], set()
            for at, used in states:
                if at < len(self.nodes):
                    word, limit = self.nodes[at]
                    if word is None:
                        if used < limit:
                            following.add((at, used + 1))
                    elif word == w:
                        following.add((at + 1, 0))
            states, i = self.closure(following), i + 1

    def first_words(self) -> set[bytes]:
        return {self.nodes[at][0] for at, _ in self.closure({(0, 0)}) if at < len(self.nodes) and self.nodes[at][0] is not None}


def compile_template(template: str) -> Automaton:
    """The automaton of a template; ValueError if regions don't match up or nothing is mandatory."""
    out, opened = Automaton(), []
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<beginOptional>>":
            opened.append(len(out.nodes))
        elif part == "<<endOptional>>":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            out.skips.setdefault(opened.pop(), []).append(len(out.nodes))
        elif m := re.fullmatch(r"<<var;max=(\d+)>>", part):
            out.nodes.append((None, int(m[1])))
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            words = words_of(part)
            out.nodes += [(w, 0) for w in words]
            out.mandatory += 0 if opened else len(words)
    if opened or not out.mandatory:
        raise ValueError("a region is left open" if opened else "no mandatory word")
    return out


class Scanner:
    """All templates, compiled, and one search for the words that may begin them."""

    def __init__(self, templates: dict[str, str]):
        self.automata = {k: compile_template(v) for k, v in templates.items()}
        self.by_first: dict[bytes, list[str]] = {}
        for k, a in self.automata.items():
            for w in a.first_words():
                self.by_first.setdefault(w, []).append(k)
        begin = b"|".join(re.escape(x) for x in sorted(self.by_first, key=len, reverse=True))
        self.begins = re.compile(b"(?<= )(?:" + begin + b")(?= )")

    def matches(self, words: list[bytes], line: bytes) -> list[tuple[str, int, int]]:
        """``(label, start, end)`` in words, at most one for a label and start."""
        out, at, before = [], 0, 0
        for m in self.begins.finditer(line):
            at += line.count(b" ", before, m.start())
            before = m.start()
            for k in self.by_first[m[0]]:
                end = self.automata[k].longest(words, at - 1)
                if end >= 0:
                    out.append((k, at - 1, end))
        return out


def scan_text(text: str | None, scanner: Scanner) -> dict:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    n_base, starts, base = 0, [], set()
    for phrase, label in PHRASES:
        p = b" " + phrase.encode() + b" "
        k = line.find(p)
        while k >= 0:
            n_base += 1
            base.add(label)
            starts.append(k)
            k = line.find(p, k + 1)
    at = [line.count(b" ", 0, k) for k in (min(starts), max(starts))] if starts else [None, None]
    found = scanner.matches(words, line)
    covered = max((min(1.0, scanner.automata[k].mandatory / max(1, end - start)) for k, start, end in found), default=0.5 if base else 0.0)
    return {
        "n_words": len(words), "n_base": n_base, "first_word": at[0], "last_word": at[1], "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {k for k, _, _ in found})), "score": covered, "matches": [{"label": k, "start": s, "stop": e} for k, s, e in found],
    }


_TYPES = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
    "score": pa.float64(), "matches": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])),
}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Base phrases and accepted templates of every row, with the template matches in words.

    The score is the share of the best match that is mandatory wording, 0.5 where only a base phrase stands, else 0.
    Null texts are empty texts; very long ones are read whole; repeated rows are repeated; a null doc_id is carried
    through; an empty table gives no rows; further columns are ignored.  Rows don't depend on one another, so nothing is shuffled.
    """
    wording = dict(TEMPLATES if templates is None else templates)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wording)
        for b in batches:
            found = [scan_text(t, scanner) for t in b.column(1).to_pylist()]
            yield to_batch({"doc_id": b.column(0).to_pylist()} | {k: [x[k] for x in found] for k in list(_TYPES)[1:]}, _TYPES)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:bigint,stop:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
