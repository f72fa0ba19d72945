import hashlib
import zlib

import numpy as np
import pytest

from mnemospark.llm import progressive_jpeg as J


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]


def slow_encode(planes, width, height, quantiser, low=1, split=5):
    """A plain encoder for three full-size components, symbol by symbol: eight-bit codes in order, runs, end-of-band, refinement."""
    symbols = list(range(255))
    table = lambda kind: J._table(kind, symbols, 8)
    out = [b"\xff\xd8", J._segment(0xDB, bytes([0]) + bytes(int(x) for x in quantiser)), J._segment(0xC2, J.struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])), table(0x00), table(0x10)]

    def size_bits(w, v):
        size = abs(v).bit_length()
        return size, (v if v >= 0 else v + (1 << size) - 1)

    def scan(head, w):
        out.extend([J._segment(0xDA, head), J._entropy(np.array(w.bits, np.uint8))])

    blocks = planes[0].shape[0] * planes[0].shape[1]
    flat = [p.reshape(blocks, 64) for p in planes]
    w, before = Writer(), [0, 0, 0]
    for b in range(blocks):
        for i in range(3):
            dc = int(flat[i][b, 0]) >> low
            size, bits = size_bits(w, dc - before[i])
            before[i] = dc
            w.put(size, 8)
            w.put(bits, size)
    scan(bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, low]), w)
    for i in range(3):
        for first, last in ((1, split), (split + 1, 63)):
            w = Writer()
            for b in range(blocks):
                k = first
                vals = [int(np.sign(x)) * (abs(int(x)) >> low) for x in flat[i][b]]
                while k <= last:
                    rest = [j for j in range(k, last + 1) if vals[j]]
                    if not rest:
                        w.put(0x00, 8)
                        break
                    run = rest[0] - k
                    while run > 15:
                        w.put(0xF0, 8)
                        run, k = run - 16, k + 16
                    size, bits = size_bits(w, vals[rest[0]])
                    w.put(run << 4 | size, 8)
                    w.put(bits, size)
                    k = rest[0] + 1
            scan(bytes([1, i + 1, 0x00, first, last, low]), w)
    for step in range(low - 1, -1, -1):
        w = Writer()
        for b in range(blocks):
            for i in range(3):
                w.put(int(flat[i][b, 0]) >> step & 1, 1)
        scan(bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, (step + 1) << 4 | step]), w)
        for i in range(3):
            w = Writer()
            for b in range(blocks):
                k, vals = 1, [int(x) for x in flat[i][b]]
                old = [abs(v) >> (step + 1) for v in vals]
                while k <= 63:
                    new = [j for j in range(k, 64) if not old[j] and abs(vals[j]) >> step == 1]
                    stop = new[0] if new else 64
                    zeros = [j for j in range(k, stop) if not old[j]]
                    if not new:
                        w.put(0x00, 8)
                        for j in range(k, 64):
                            if old[j]:
                                w.put(abs(vals[j]) >> step & 1, 1)
                        break
                    if len(zeros) > 15:
                        w.put(0xF0, 8)
                        last = zeros[15]
                        for j in range(k, last):
                            if old[j]:
                                w.put(abs(vals[j]) >> step & 1, 1)
                        k = last + 1
                        continue
                    w.put(len(zeros) << 4 | 1, 8)
                    w.put(int(vals[stop] > 0), 1)
                    for j in range(k, stop):
                        if old[j]:
                            w.put(abs(vals[j]) >> step & 1, 1)
                    k = stop + 1
            scan(bytes([1, i + 1, 0x00, 1, 63, (step + 1) << 4 | step]), w)
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize(("low", "density"), [(1, 0.3), (2, 0.1), (1, 0.9), (3, 0.02)])
def test_general_scans(low, density):
    rng = np.random.default_rng(low)
    planes = [np.where(rng.random((3, 4, 64)) < density, rng.integers(-40, 41, (3, 4, 64)), 0) for _ in range(3)]
    image = J.decode(slow_encode(planes, 32, 24, np.full(64, 3), low))
    for c, p in zip(image.components, planes, strict=True):
        assert (c.coefficients == p).all()
    assert J.rgb(image).shape == (24, 32, 3)


def test_inverse_transform_against_its_definition():
    rng = np.random.default_rng(1)
    c = J.Component(1, 1, 1, 0, 2, 1, 13, 7, rng.integers(-50, 50, (1, 2, 64)))
    q = rng.integers(1, 9, 64)
    got = J.samples(c, q)
    assert got.shape == (7, 13)
    for y, x in ((0, 0), (6, 12), (3, 9)):
        block = np.zeros(64)
        block[J.ZIGZAG] = c.coefficients[0, x // 8] * q
        want = sum((1 if u else 0.5**0.5) * (1 if v else 0.5**0.5) / 4 * block[8 * v + u] * np.cos((2 * (x % 8) + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
        assert got[y, x] == pytest.approx(want, abs=1e-2)


def test_flat_grey_and_colour():
    planes = [np.zeros((2, 2, 64), int) for _ in range(3)]
    planes[0][..., 0], planes[2][..., 0] = 80, 160
    t = J.rgb(J.decode(slow_encode(planes, 16, 16, np.ones(64, int))))
    assert (t == [128 + 10 + 28, 128 + 10 - 14, 138]).all()


@pytest.mark.parametrize("units", [1, 2, 5, 57, 700])
def test_payload_round_trip(units, monkeypatch):
    p = np.random.default_rng(units).integers(0, 256, 576 * units, dtype=np.uint8).tobytes()
    media = J.encode_payload(p)
    image = J.decode(media)
    assert J.payload_of(image) == p
    if units < 6:  # the general way gives the same

        class Plain(J.Huffman):
            def __init__(self, *a):
                super().__init__(*a)
                self.only = None

        monkeypatch.setattr(J, "Huffman", Plain)
        monkeypatch.setattr(J, "_flat_dc", lambda *a: False)
        for a, b in zip(image.components, J.decode(media).components, strict=True):
            assert (a.coefficients == b.coefficients).all()


def test_chroma_is_repeated():
    t = J.rgb(J.decode(J.encode_payload(bytes(576))))
    assert t.dtype == np.uint8 and t.shape[0] % 16 == 0 and t.shape[1] % 16 == 0


def test_edge_cases(docs, no_docs):
    got = J.digests(docs).collect()
    texts = sorted((r.text or "" for r in docs.collect()), key=lambda t: (len(t.encode()), t))
    assert len(got) == len(texts) and J.digests(no_docs).count() == 0
    want = []
    for t in texts:
        raw = t.encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    same = {(r.payload_sha256, r.media_sha256, r.feature) for r in got}
    assert len(same) == len({r.payload_sha256 for r in got})


def test_columns(spark, docs):
    media = J.media_column(docs)
    t = J.tensors(media.unionByName(spark.createDataFrame([(77, bytearray(b"no image")), (78, None), (79, bytearray(b"\xff\xd8\xff"))], "doc_id long, media binary"))).collect()
    assert len(t) == docs.count() + 3 and sum(r.rgb is None for r in t) == 3
    assert all(len(r.rgb) == 3 * r.height * r.width for r in t if r.rgb is not None)
