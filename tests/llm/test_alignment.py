import collections
import hashlib
import re

import sentencepiece
from tokenizers import Tokenizer

from mnemospark.llm import alignment as A
from mnemospark.llm.queries import QUERIES


def offsets(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def encodings(text, tokenizer, model, of_a):
    """Ids and byte ranges by A and B, or None where the bytes differ."""
    if not text:
        return None
    want = (" " + text).encode()
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    pieces = [model.id_to_piece(i) for i in b]
    bytes_a, bytes_b = [of_a[i] for i in a], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode() for p in pieces]
    return (a, b, offsets(bytes_a), offsets(bytes_b)) if b"".join(bytes_a) == want == b"".join(bytes_b) else None


def links_of(a, b, at_a, at_b):
    """All pairs of tokens whose ranges overlap."""
    out, first = [], 0
    for i, (s, e) in enumerate(at_a):
        while at_b[first][1] <= s:
            first += 1
        j = first
        while j < len(at_b) and at_b[j][0] < e:
            out.append((a[i], b[j]))
            j += 1
    return out


def groups_of(a, b, at_a, at_b):
    out, i, j = [], 0, 0
    for cut in sorted({e for _, e in at_a} & {e for _, e in at_b}):
        n, m = sum(e <= cut for _, e in at_a[i : i + 3000]) + i, sum(e <= cut for _, e in at_b[j : j + 3000]) + j
        out.append(",".join(map(str, a[i:n])) + "|" + ",".join(map(str, b[j:m])))
        i, j = n, m
    return out


def brute(texts):
    path = A.VOCABULARIES
    tokenizer = Tokenizer.from_file(f"{path}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=f"{path}/piece_bpe_32k.model")
    letters = A._byte_letters()
    of_a = {i: bytes(letters[c] for c in t) for t, i in tokenizer.get_vocab().items() if i != 50256}
    found = [encodings(t, tokenizer, model, of_a) for t in texts]
    links = [links_of(*f) if f else [] for f in found]
    counts = collections.Counter(p for x in links for p in x)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for f, x in zip(found, links, strict=True):
        groups = groups_of(*f) if f else []
        sums = sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x)
        out.append((len(f[0]) if f else 0, len(f[1]) if f else 0, len(groups), len(x), *sums, hashlib.sha256(";".join(groups).encode()).hexdigest() if f else ""))
    return out


TEXTS = [
    "The quick brown fox isn't here.", "", None, "a", " ", "  two  spaces\tand\n\nlines ", "na\u00efve caf\u00e9 \u65e5\u672c\u8a9e \U0001f600\U0001f468\u200d\U0001f469", "<|endoftext|> </s> <s> [INST]", "literal \u2581 mark", "\u2581", "\x00\x01 control \ufeff",
    "The quick brown fox isn't here.", "x" * 5000, "\n" * 3000 + "end", "e\u0301 \ufb01 \uff21 \u2126", "1234567890 " * 50, "don't we'll I'VE", "\u00a0\u3000\u2028", "<0x41> <0x0A>",
]


def results(df, head=A.HEAD):
    return sorted(tuple(r) for r in A.align(df, head=head).collect())


def test_texts_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = sorted((i, *w) for i, w in enumerate(brute(TEXTS)))
    assert want[8][1] == 0 and want[7][1] > 0  # the mark of a space isn't given back; strings of special tokens are
    for head in (A.HEAD, 20, 0):  # all pairs sent, some, none
        assert results(df, head) == want


def test_labels_and_spans():
    label = A.labels(A.np.array([1, 2, 3]), A.np.array([3, 1, 2]))
    assert label == b"anxbnx" and A.group_ends(label).tolist() == [3, 6]


def test_the_two_libraries_agree():
    a, _ = A.vocabularies(A.VOCABULARIES)
    for text in filter(None, TEXTS):
        assert a._fast.encode_ordinary(text) == a._slow.encode(text, add_special_tokens=False).ids
        assert a.joined(a.encode(text)) == text.encode()


def test_edge_cases(docs, no_docs):
    """Nulls in every column, repeated rows, long and empty texts, further columns; an empty table."""
    rows = docs.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in A.align(docs).collect()), key=key)
    assert got == sorted(((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]), strict=True)), key=key)
    assert A.align(no_docs).count() == 0


def test_table_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(tuple(r) for r in QUERIES["op11_token_alignment"](spark, sf_dir).collect())
    assert got == sorted((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]), strict=True))
