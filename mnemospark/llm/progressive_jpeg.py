"""Media columns as progressive JPEG: a codec on coefficient arrays, and payloads stored in coefficients.

Decoding accumulates all scans, spectral selection and successive approximation alike, into one integer array of
coefficients for each component, then dequantises, inverts the transform with two matrix products in numpy, repeats
chroma samples to the full resolution and converts to RGB.

Entropy-coded bits are sequential by nature.  Where a scan's table has a single symbol, every coefficient takes the same
number of bits, and where a refinement meets no coefficient that is still zero, only correction bits remain; such scans
are read and written as arrays.  Any other scan takes the general, slower way, with the same result.

A payload is stored without loss in the format's own unit, the quantised coefficient: byte b is the coefficient b if b
is 128 or more, else b - 255, in the first 48 places of the zigzag order.  A block holds 48 bytes, a unit of 4:2:0 has six
blocks, and two units hold 576 bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches, to_batch

#: Payloads are padded with PAD to a positive multiple of UNIT bytes; bytes of a block and of a unit of six blocks.
UNIT, PAD, PER_BLOCK, BLOCKS = 576, 255, 48, 6
#: Scans of a stored payload's coefficients: the last place of the first and of the second spectral band.
BANDS = ((1, 5), (6, PER_BLOCK))


def zigzag() -> np.ndarray:
    """Row-major position of each place of the zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = zigzag()
_K = np.arange(8)
#: Row u, column x: the cosine basis, scaled.
BASIS = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


class JpegError(ValueError):
    pass


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    across: int = 0
    down: int = 0
    width: int = 0
    height: int = 0
    #: Padded to whole units: (down, across, 64) in zigzag order.
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    payload_bytes: int | None = None


class Huffman:
    """Codes in order of length, as a table segment has them."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = (next(iter(self.codes))[0], symbols[0]) if len(self.codes) == 1 else None
        if self.only and next(iter(self.codes))[1]:
            self.only = None


class Bits:
    """The bits of one entropy-coded segment, stuffing removed."""

    def __init__(self, data: bytes):
        raw = data.replace(b"\xff\x00", b"\xff")
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        self.at = 0
        self._list: list[int] | None = None

    def one(self) -> int:
        if self._list is None:
            self._list = self.bits.tolist()
        if self.at >= len(self._list):
            raise JpegError("the scan ends early")
        self.at += 1
        return self._list[self.at - 1]

    def many(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.one()
        return x

    def block(self, n: int) -> np.ndarray:
        if self.at + n > len(self.bits):
            raise JpegError("the scan ends early")
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise JpegError("no such code")


def _extend(bits: int, size: int) -> int:
    return bits if size and bits >= 1 << (size - 1) else bits - (1 << size) + 1


def _dc_scan(parts: list[Component], tables: list[Huffman | None], image: Image, segments: list[Bits], restart: int, high: int, low: int) -> None:
    """Place 0 of all blocks of the scan's components, unit by unit."""
    if len(parts) > 1:
        h, v = max(c.h for c in image.components), max(c.v for c in image.components)
        across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
        units = [[(i, y * c.v + b, x * c.h + a) for i, c in enumerate(parts) for b in range(c.v) for a in range(c.h)] for y in range(down) for x in range(across)]
    else:
        units = [[(0, y, x)] for y in range(parts[0].down) for x in range(parts[0].across)]
    for s, bits in enumerate(segments):
        own = units[s * restart : (s + 1) * restart] if restart else units
        before = [0] * len(parts)
        for unit in own:
            for i, y, x in unit:
                if high:
                    parts[i].coefficients[y, x, 0] |= bits.one() << low
                else:
                    size = bits.symbol(tables[i])
                    before[i] += _extend(bits.many(size), size)
                    parts[i].coefficients[y, x, 0] = before[i] << low


def _flat_dc(parts: list[Component], tables: list[Huffman | None], segments: list[Bits], high: int) -> bool:
    """True if all bits say that nothing changes; then nothing needs to be done."""
    if high:
        return not any(s.bits[: len(s.bits) - 7].any() or s.bits[len(s.bits) - 8 :].all() for s in segments) and all(_zero_but_fill(s.bits) for s in segments)
    return all(t is not None and t.only and t.only[1] == 0 for t in tables)


def _zero_but_fill(bits: np.ndarray) -> bool:
    """All zero but for a run of ones at the end of the last byte."""
    ones = np.flatnonzero(bits)
    return not len(ones) or (len(bits) - ones[0] < 8 and len(ones) == len(bits) - ones[0])


def _ac_first(c: Component, table: Huffman, segments: list[Bits], restart: int, first: int, last: int, low: int) -> None:
    blocks = c.coefficients[: c.down, : c.across]
    if table.only and not restart and 0 < table.only[1] < 16:
        length, size = table.only
        n = c.down * c.across * (last - first + 1)
        bits = segments[0].block(n * (length + size)).reshape(n, length + size)[:, length:]
        if size <= 8:
            x = np.packbits(bits, axis=1).ravel().astype(np.int32) >> (8 - size)
        else:
            x = bits.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
        x = np.where(x >= 1 << (size - 1), x, x - (1 << size) + 1)
        sign = np.where(x < 0, -1, 1)
        blocks[:, :, first : last + 1] = (sign * (np.abs(x) << low)).reshape(c.down, c.across, -1)
        return
    order = [(y, x) for y in range(c.down) for x in range(c.across)]
    for s, bits in enumerate(segments):
        run = 0
        for y, x in order[s * restart : (s + 1) * restart] if restart else order:
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                symbol = bits.symbol(table)
                skip, size = symbol >> 4, symbol & 15
                if size:
                    k += skip
                    value = _extend(bits.many(size), size)
                    blocks[y, x, k] = value << low if value >= 0 else -(-value << low)
                    k += 1
                elif skip == 15:
                    k += 16
                else:
                    run = (1 << skip) + bits.many(skip) - 1
                    break


def _ac_refine(c: Component, table: Huffman, segments: list[Bits], restart: int, first: int, last: int, low: int) -> None:
    blocks = c.coefficients[: c.down, : c.across]
    band = blocks[:, :, first : last + 1]
    if not restart and band.all():
        flat = band.reshape(-1).copy()
        bits, at, width = segments[0], 0, last - first + 1
        while at < len(flat):
            symbol = bits.symbol(table)
            if symbol & 15 or symbol >> 4 == 15:
                raise JpegError("a new coefficient where none is zero")
            run = (1 << (symbol >> 4)) + bits.many(symbol >> 4)
            n = min(run * width, len(flat) - at)
            step = bits.block(n).astype(np.int32) << low
            flat[at : at + n] += np.where(flat[at : at + n] < 0, -step, step)
            at += n
        blocks[:, :, first : last + 1] = flat.reshape(band.shape)
        return
    order = [(y, x) for y in range(c.down) for x in range(c.across)]
    for s, bits in enumerate(segments):
        run = 0

        def correct(block: np.ndarray, k: int, bits: Bits = bits) -> None:
            if bits.one():
                block[k] += (1 << low) if block[k] > 0 else -(1 << low)

        for y, x in order[s * restart : (s + 1) * restart] if restart else order:
            block, k = blocks[y, x], first
            while k <= last and not run:
                symbol = bits.symbol(table)
                skip, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = (1 << low) if bits.one() else -(1 << low)
                elif skip < 15:
                    run = (1 << skip) + bits.many(skip)
                    break
                while k <= last:
                    if block[k]:
                        correct(block, k)
                    elif skip:
                        skip -= 1
                    else:
                        break
                    k += 1
                if value and k <= last:
                    block[k] = value
                k += 1
            if run:
                for j in range(k, last + 1):
                    if block[j]:
                        correct(block, j)
                run -= 1


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated into coefficients."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG")
    image, huffman, restart, at = Image(), {}, 0, 2
    while True:
        if at + 2 > len(data) or data[at] != 255:
            raise JpegError("a marker is missing")
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at)[0]
        body = data[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                image.quantisers[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]] = Huffman(body[1:17], body[17:n])
                body = body[n:]
        elif marker == 0xC2:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise JpegError("samples of 8 bits only")
            image.components = [Component(i, hv >> 4, hv & 15, t) for i, hv, t in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
            h, v = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.width, c.height = -(-image.width * c.h // h), -(-image.height * c.v // v)
                c.across, c.down = -(-c.width // 8), -(-c.height // 8)
                c.coefficients = np.zeros((-(-image.height // (8 * v)) * c.v, -(-image.width // (8 * h)) * c.h, 64), np.int32)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xE9 and body[:8] == b"payload\0":
            image.payload_bytes = struct.unpack(">Q", body[8:16])[0]
        elif marker == 0xDA:
            n = body[0]
            by_id = {c.ident: c for c in image.components}
            parts = [by_id[body[1 + 2 * i]] for i in range(n)]
            which = [body[2 + 2 * i] for i in range(n)]
            first, last, approximation = body[1 + 2 * n : 4 + 2 * n]
            high, low = approximation >> 4, approximation & 15
            starts, stop = [at], at
            while True:
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    raise JpegError("the scan has no end")
                if data[stop + 1] == 0:
                    stop += 2
                elif 0xD0 <= data[stop + 1] <= 0xD7:
                    starts += [stop, stop + 2]
                    stop += 2
                else:
                    break
            starts.append(stop)
            segments = [Bits(data[a:b]) for a, b in zip(starts[::2], starts[1::2], strict=True)]
            at = stop
            if first == 0:
                tables = [huffman.get(w >> 4) for w in which]
                if not _flat_dc(parts, tables, segments, high):
                    _dc_scan(parts, tables, image, segments, restart, high, low)
            else:
                table = huffman[16 + (which[0] & 15)]
                (_ac_refine if high else _ac_first)(parts[0], table, segments, restart, first, last, low)


def samples(c: Component, quantiser: np.ndarray) -> np.ndarray:
    """The component's samples, not yet shifted or clipped."""
    down, across = c.coefficients.shape[:2]
    flat = np.zeros((down * across, 64), np.float32)
    flat[:, ZIGZAG] = (c.coefficients.reshape(-1, 64) * quantiser).astype(np.float32)
    rows = (flat.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8)
    both = (rows.transpose(0, 2, 1).reshape(-1, 8) @ BASIS).reshape(down, across, 8, 8)  # (.., x, y)
    return both.transpose(0, 3, 1, 2).reshape(down * 8, across * 8)[: c.height, : c.width]


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) bytes at full resolution; chroma samples are repeated."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        p = samples(c, image.quantisers[c.table])
        if (h // c.h, v // c.v) != (1, 1):
            p = np.repeat(np.repeat(p, v // c.v, axis=0), h // c.h, axis=1)
        planes.append(p[: image.height, : image.width])
    out = np.empty((image.height, image.width, 3), np.float32)
    y = planes[0] + np.float32(128)
    cb, cr = (planes[1], planes[2]) if len(planes) == 3 else (np.float32(0), np.float32(0))
    out[..., 0] = y + np.float32(1.402) * cr
    out[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
    out[..., 2] = y + np.float32(1.772) * cb
    np.rint(out, out=out)
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled with ones and stuffed."""
    if len(bits) % 8:
        bits = np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _table(kind: int, symbols: list[int], length: int) -> bytes:
    return _segment(0xC4, bytes([kind, *(len(symbols) if i == length else 0 for i in range(1, 17)), *symbols]))


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG that holds the payload, whose length is a multiple of 288, in its coefficients."""
    units = len(payload) // (PER_BLOCK * BLOCKS)
    across = max(2, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    if across > 4095 or down > 4095:
        raise JpegError("the payload is larger than an image can be")
    data = np.full(across * down * BLOCKS * PER_BLOCK, PAD, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(down, across, BLOCKS, PER_BLOCK)
    luma = data[:, :, :4].reshape(down, across, 2, 2, PER_BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, PER_BLOCK)
    planes = [luma, data[:, :, 4].reshape(-1, PER_BLOCK), data[:, :, 5].reshape(-1, PER_BLOCK)]
    out = [
        b"\xff\xd8", _segment(0xE9, b"payload\0" + struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0] + [1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0x00, [0], 1), _table(0x10, [7], 1), _table(0x11, [r << 4 for r in range(15)], 4),
    ]
    all_three = bytes([3, 1, 0, 2, 0, 3, 0])
    out += [_segment(0xDA, all_three + bytes([0, 0, 0x01])), _entropy(np.zeros(across * down * BLOCKS, np.uint8))]
    for first, last in BANDS:
        for i, p in enumerate(planes, 1):
            # One code bit, then seven bits of magnitude and sign: together one byte, the payload's byte halved.
            out += [_segment(0xDA, bytes([1, i, 0x00, first, last, 0x01])), (p[:, first - 1 : last] >> 1).tobytes()]
    out += [_segment(0xDA, all_three + bytes([0, 0, 0x10])), _entropy(np.zeros(across * down * BLOCKS, np.uint8))]
    for i, p in enumerate(planes, 1):
        low = (p ^ np.where(p < 128, 1, 0).astype(np.uint8)) & 1
        bits, at = [], 0
        while at < len(low):
            n = min(32_767, len(low) - at)
            r = n.bit_length() - 1
            head = [r >> k & 1 for k in (3, 2, 1, 0)] + [(n - (1 << r)) >> k & 1 for k in range(r - 1, -1, -1)]
            bits += [np.array(head, np.uint8), low[at : at + n].ravel()]
            at += n
        out += [_segment(0xDA, bytes([1, i, 0x01, 1, PER_BLOCK, 0x10])), _entropy(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: Image) -> bytes:
    """The payload back from the coefficients."""
    luma, cb, cr = (c.coefficients[:, :, 1 : 1 + PER_BLOCK] for c in image.components)
    down, across = cb.shape[:2]
    units = np.empty((down, across, BLOCKS, PER_BLOCK), np.int32)
    units[:, :, :4] = luma.reshape(down, 2, across, 2, PER_BLOCK).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, PER_BLOCK)
    units[:, :, 4], units[:, :, 5] = cb, cr
    return np.where(units > 0, units, units + 255).astype(np.uint8).tobytes()[: image.payload_bytes]


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8, and those bytes with padding."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes([PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature_of(tensor: np.ndarray) -> str:
    """``height x width : mean of red, green, blue``, from integer sums."""
    h, w, _ = tensor.shape
    total = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{h}x{w}:" + ",".join(f"{100 * int(x) // (h * w) / 100:.2f}" for x in total)


_DIGEST = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _own(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Each text stored, read back from the stored bytes, decoded to RGB and summed up.

    Null texts are empty texts, which are padding only; repeated rows are repeated; a null doc_id is carried through; an
    empty table gives no rows; further columns are ignored.  Rows don't depend on one another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, payload = padded(t)
                media = encode_payload(payload)
                image = decode(media)
                back = payload_of(image)
                rows.append((d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(rgb(image))))
            if rows:
                yield to_batch(dict(zip(_DIGEST, map(list, zip(*rows, strict=True)), strict=True)), _DIGEST)

    return _own(docs).mapInArrow(run, DIGEST)


def media_column(docs: DataFrame) -> DataFrame:
    """``(doc_id, media)``: the stored form of each text."""
    types = {"doc_id": pa.int64(), "media": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                yield to_batch({"doc_id": part.column(0).to_pylist(), "media": [encode_payload(padded(t)[1]) for t in part.column(1).to_pylist()]}, types)

    return _own(docs).mapInArrow(run, "doc_id long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """``(doc_id, height, width, rgb)`` for ``(doc_id, media)``; null for a null or a damaged image."""
    types = {"doc_id": pa.int64(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}
    small_batches(media.sparkSession)

    def pixels(data: bytes | None) -> tuple[int | None, int | None, bytes | None]:
        try:
            t = rgb(decode(data or b""))
        except (JpegError, struct.error, IndexError, KeyError, ValueError):
            return None, None, None
        return t.shape[0], t.shape[1], t.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield to_batch({k: [x] for k, x in zip(types, (d, *pixels(m)), strict=True)}, types)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")
