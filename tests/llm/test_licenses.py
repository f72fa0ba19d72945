import re

import pytest

from mnemospark.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = ["CC BY cc-by CC  BY, all rights reserved. All Rights\nReserved", "cc  bya cc by", "GNU General Public License general public license", "", None, "all all rights reserved", "ñ CC—BY cc by", "İ CC BY \x7f x"]


def check(r, text):
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
    assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_base_against_brute_force(spark):
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS, strict=True):
        check(r, t)


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.scan_licenses(docs).collect():
        check(r, texts[r.doc_id])


@pytest.mark.parametrize(
    ("text", "label", "accepted"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0", True), ("licensed under the terms of the GNU General Public License version 3", "gpl-3.0", True),
        ("licensed under the GNU General Private License, version 3", "gpl-3.0", False), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", True), ("Licensed under CC BY-NC 4.0.", "cc-by-4.0", False),
        ("Copyright (c) 2024 Some Person. All rights reserved.", "copyright-notice", True), ("Copyright " + "x " * 40 + "All rights reserved", "copyright-notice", False), ("licensed under a Creative Commons Attribution CC BY 4.0", "cc-by-4.0", True),
    ],
)
def test_templates(text, label, accepted):
    assert (label in L.scan_text(text, L.Scanner(L.TEMPLATES))["labels"].split(",")) is accepted


def plain(label, holder):
    """A template as a text: optional regions left in, replaceable ones filled."""
    return re.sub(r"<<var;max=1>>", "*", re.sub(r"<<(begin|end)Optional>>", " ", re.sub(r"<<var;max=(?!1>>)\d+>>", holder, L.TEMPLATES[label])))


@pytest.mark.parametrize("label", ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "gpl-3.0-or-later", "gpl-2.0-or-later", "cc-by-4.0-notice"])
def test_whole_wording(label):
    scanner = L.Scanner(L.TEMPLATES)
    labels = lambda text: set(L.scan_text(text, scanner)["labels"].split(","))
    text = plain(label, "the authors")
    assert label in labels("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + text + "\nmore") and label in labels(text.upper())
    words = text.split()
    for i in range(0, len(words), 7):
        if L.words_of(words[i]) and words[i] not in ("the", "authors"):
            assert label not in labels(" ".join([*words[:i], "xyzzy plugh", *words[i + 1 :]])), words[i]
    assert label not in labels(" ".join(words[: len(words) // 2]) + " provided nothing else of it applies")


def brute_accepts(parts, words):
    """Parts: ('w', word), ('o', parts), ('v', n); the set of lengths that a prefix of words may be read in."""
    ends = {0}
    for kind, x in parts:
        if kind == "w":
            ends = {e + 1 for e in ends if e < len(words) and words[e] == x}
        elif kind == "o":
            ends |= {e + k for e in ends for k in brute_accepts(x, words[e:])}
        else:
            ends = {e + k for e in ends for k in range(x + 1) if e + k <= len(words)}
    return ends


def test_automaton_against_brute_force():
    import itertools

    a = L.compile_template("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;max=2>> d")
    parts = [("w", b"a"), ("o", [("w", b"b"), ("o", [("w", b"c")])]), ("v", 2), ("w", b"d")]
    for n in range(1, 7):
        for words in itertools.product([b"a", b"b", b"c", b"d"], repeat=n):
            assert a.longest(list(words), 0) == max(brute_accepts(parts, list(words)), default=-1)


def test_bad_templates():
    for t in ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>", "<<other>> a", ""):
        with pytest.raises(ValueError):
            L.compile_template(t)


def test_edge_cases(docs, no_docs):
    assert L.scan_licenses(docs).count() == docs.count() and L.scan_licenses(no_docs).count() == 0
