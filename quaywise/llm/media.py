"""Media columns: baseline JPEG files, written and parsed in numpy.

A payload is stored without loss in the format's own unit, the quantised DCT
coefficient: 64 bytes make a block, three blocks (Y, Cb, Cr, no subsampling) make an
MCU, so 192 bytes each. Byte b is stored as coefficient b-128 (b < 128) or b-127, which
is never zero; quantisation tables are all ones. The number of payload bytes stands in
a comment segment; MCUs past the payload fill the last row of the picture.

The Huffman tables give category s a code of (9-s) bits for AC and (10-s) bits for DC,
so that every AC coefficient takes 9 bits and every DC difference 10: whole scans are
then written and decoded with array operations. Files with other tables (any baseline
JPEG, restart intervals included) go through a symbol-by-symbol decoder.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .store import read_table
from .textbytes import chunks

UNIT = 192
_AC_BITS, _DC_BITS = 9, 10
_BLOCK_BITS = _DC_BITS + 63 * _AC_BITS
_MOST_SIDE = 8191  # MCUs of 8 pixels in 65535


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _codes(widths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length), for symbols listed in order of length."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(widths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


_AC_WIDTHS = {s: _AC_BITS - s for s in range(8, 0, -1)}
_DC_WIDTHS = {s: _DC_BITS - s for s in range(9, -1, -1)}


def _words(codes: dict[int, tuple[int, int]], low: int, high: int) -> np.ndarray:
    """The whole bit word (code and amplitude) of each value from low to high; 0 where there is none."""
    out = np.zeros(high - low + 1, dtype=np.uint16)
    for v in range(low, high + 1):
        s = abs(v).bit_length()
        if s in codes:
            out[v - low] = codes[s][0] << s | (v if v > 0 else v + (1 << s) - 1 if s else 0)
    return out


_AC_WORD = _words(_codes(_AC_WIDTHS), -128, 128)
_DC_WORD = _words(_codes(_DC_WIDTHS), -256, 256)
_TO_COEFFICIENT = np.where(np.arange(256) < 128, np.arange(256) - 128, np.arange(256) - 127).astype(np.int16)
_AC_BY_BYTE = _AC_WORD[_TO_COEFFICIENT + 128]
_AC_ROWS = np.unpackbits(np.stack([_AC_BY_BYTE >> 8, _AC_BY_BYTE & 255], 1).astype(np.uint8), axis=1)[:, 16 - _AC_BITS :]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, widths: dict[int, int]) -> bytes:
    order = sorted(widths.items(), key=lambda x: x[1])
    counts = [sum(n == k for _, n in order) for k in range(1, 17)]
    return bytes([kind, *counts, *(s for s, _ in order)])


_HEAD = (
    b"\xff\xd8"
    + _segment(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0))
    + _segment(0xDB, bytes([0] + [1] * 64))
)
_TABLES = _segment(0xC4, _table(0x00, _DC_WIDTHS)) + _segment(0xC4, _table(0x10, _AC_WIDTHS))
_SCAN = _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def write_jpeg(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the payload (a positive multiple of 192 bytes)."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    wide = max(math.isqrt(units - 1) + 1, -(-units // _MOST_SIDE))
    high = -(-units // wide)
    b = np.zeros(wide * high * UNIT, dtype=np.uint8)
    b[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    b = b.reshape(-1, 64)
    dc = _TO_COEFFICIENT[b[:, 0]].reshape(-1, 3)
    differences = np.diff(dc, axis=0, prepend=np.zeros((1, 3), np.int16)).reshape(-1)
    word = _DC_WORD[differences + 256]
    bits = np.empty((len(b), _BLOCK_BITS), dtype=np.uint8)
    bits[:, :_DC_BITS] = (word[:, None] >> np.arange(_DC_BITS - 1, -1, -1)) & 1
    bits[:, _DC_BITS:] = _AC_ROWS[b[:, 1:]].reshape(len(b), -1)
    flat = bits.reshape(-1)
    scan = np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)]))
    scan = scan.tobytes().replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return _HEAD + _segment(0xFE, b"payload=%d" % len(payload)) + _segment(0xC0, frame) + _TABLES + _SCAN + scan + b"\xff\xd9"


@functools.lru_cache(maxsize=64)
def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: the symbol they begin with and its code's length (0: none)."""
    symbol, length = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    at, k = 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            symbol[at : at + (1 << (16 - n))], length[at : at + (1 << (16 - n))] = symbols[k], n
            at += 1 << (16 - n)
            k += 1
    return symbol, length


@functools.lru_cache(maxsize=64)
def _steady(counts: tuple[int, ...], symbols: tuple[int, ...], dc: bool) -> tuple[int, np.ndarray] | None:
    """(bits, value of each word) if code and amplitude take as many bits for every symbol; AC: no runs, no end of block."""
    widths = [n for n, c in enumerate(counts, 1) for _ in range(c)]
    bits = {n + s for n, s in zip(widths, symbols)}
    if len(bits) != 1 or max(symbols) > 15 or not dc and 0 in symbols:
        return None
    (n,) = bits
    symbol = _lookup(counts, symbols)[0]
    word = np.arange(1 << n)
    s = symbol[word << (16 - n)].astype(int)
    raw = word & ((1 << s) - 1)
    return n, np.where(s == 0, 0, np.where(raw >> np.maximum(s - 1, 0), raw, raw - (1 << s) + 1)).astype(np.int16)


class Jpeg:
    """A parsed baseline JPEG: dimensions and the quantised coefficients of each component in scan order."""

    def __init__(self, data: bytes):
        self.comment, self.interval = b"", 0
        quant, tables, i = {}, {}, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        while True:
            while data[i] == 0xFF and data[i + 1] == 0xFF:
                i += 1
            if data[i] != 0xFF:
                raise ValueError("a marker is expected")
            marker = data[i + 1]
            if marker == 0xD9:
                raise ValueError("no scan")
            (n,) = struct.unpack_from(">H", data, i + 2)
            body = data[i + 4 : i + 2 + n]
            i += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    total = sum(counts)
                    tables[body[0]] = (tuple(counts), tuple(body[17 : 17 + total]))
                    body = body[17 + total :]
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xC0:
                _, self.height, self.width, k = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * j], body[7 + 3 * j] >> 4, body[7 + 3 * j] & 15, body[8 + 3 * j]) for j in range(k)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDA:
                picks = {body[1 + 2 * j]: body[2 + 2 * j] for j in range(body[0])}
                break
        self.quant = [quant[c[3]] for c in self.components]
        scan = data[i : data.rindex(b"\xff\xd9")]
        self.blocks = self._scan(scan, tables, [picks[c[0]] for c in self.components])

    def _scan(self, scan: bytes, tables: dict, picks: list[int]) -> list[np.ndarray]:
        dc = [tables[p >> 4] for p in picks]
        ac = [tables[16 | p & 15] for p in picks]
        single = len(self.components) == 1
        wide, high = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if single:
            wide = high = 1
        per = [1 if single else c[1] * c[2] for c in self.components]
        units = -(-self.width // (8 * wide)) * -(-self.height // (8 * high))
        if len(set(dc)) == len(set(ac)) == 1 and set(per) == {1} and not self.interval:
            steady = _steady(*dc[0], True), _steady(*ac[0], False)
            if None not in steady:
                return self._at_once(scan, *steady, units, len(per))
        return self._one_by_one(scan, [_lookup(*t) for t in dc], [_lookup(*t) for t in ac], units, per)

    @staticmethod
    def _at_once(scan: bytes, dc: tuple[int, np.ndarray], ac: tuple[int, np.ndarray], units: int, k: int) -> list[np.ndarray]:
        (dc_bits, dc_value), (ac_bits, ac_value) = dc, ac
        n, per = units * k, dc_bits + 63 * ac_bits
        bits = np.unpackbits(np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), dtype=np.uint8), count=n * per).reshape(n, per)

        def words(part: np.ndarray) -> np.ndarray:
            out = np.zeros(part.shape[:-1], np.uint16)
            for j in range(part.shape[-1]):
                out <<= 1
                out |= part[..., j]
            return out

        out = np.empty((n, 64), dtype=np.int16)
        first = dc_value[words(bits[:, :dc_bits])]
        out[:, 0] = np.cumsum(first.reshape(units, k), axis=0, dtype=np.int32).reshape(-1)
        out[:, 1:] = ac_value[words(bits[:, dc_bits:].reshape(n, 63, ac_bits))]
        out = out.reshape(units, k, 64)
        return [out[:, j] for j in range(k)]

    def _one_by_one(self, scan: bytes, dc, ac, units: int, per: list[int]) -> list[np.ndarray]:
        import re

        parts = re.split(rb"\xff[\xd0-\xd7]", scan) if self.interval else [scan]
        out = [np.zeros((units * m, 64), np.int16) for m in per]
        unit = 0
        for part in parts:
            raw = part.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
            at, last = 0, [0] * len(per)
            peek = lambda: int.from_bytes(raw[at >> 3 : (at >> 3) + 4], "big") >> (16 - (at & 7)) & 0xFFFF  # noqa: B023, E731

            def amplitude(s: int) -> int:
                nonlocal at
                v = peek() >> (16 - s) if s else 0  # noqa: B023
                at += s
                return v if not s or v >> (s - 1) else v - (1 << s) + 1

            for _ in range(min(self.interval or units, units - unit)):
                for j, m in enumerate(per):
                    for r in range(m):
                        row = out[j][unit * m + r]
                        w = peek()
                        at += int(dc[j][1][w])
                        last[j] += amplitude(int(dc[j][0][w]))
                        row[0], c = last[j], 1
                        while c < 64:
                            w = peek()
                            s, n = int(ac[j][0][w]), int(ac[j][1][w])
                            if not n:
                                raise ValueError("no such Huffman code")
                            at += n
                            if s == 0:
                                break
                            c += s >> 4
                            if s & 15:
                                row[c] = amplitude(s & 15)
                            c += 1
                unit += 1
        return out

    def payload(self) -> bytes:
        """The bytes that ``write_jpeg`` stored."""
        flat = np.stack(self.blocks, 1).reshape(-1)
        flat = flat[: int(self.comment.removeprefix(b"payload="))]
        return np.where(flat < 0, flat + 128, flat + 127).astype(np.uint8).tobytes()

    def thumbnail(self) -> np.ndarray:
        """DC-only luminance: one grey value a block (level shifted, clipped to 0..255), rows of blocks."""
        wide = -(-self.width // 8)
        y = self.blocks[0]
        if len(self.components) > 1 and self.components[0][1:3] != (1, 1):
            h, v = self.components[0][1:3]
            across = -(-self.width // (8 * max(c[1] for c in self.components)))
            y = y.reshape(-1, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, across * h, 64)
        else:
            y = y.reshape(-1, wide, 64)
        grey = y[:, :, 0].astype(np.int32) * int(self.quant[0][0]) / 8 + 128
        return np.clip(np.rint(grey), 0, 255).astype(np.uint8)


def thumbnail_hash(grey: np.ndarray) -> str:
    """64 bits: a 9 x 8 sample of the thumbnail, one bit where a cell is brighter than the next to its right."""
    rows = np.arange(8) * grey.shape[0] // 8
    columns = np.arange(9) * grey.shape[1] // 9
    cell = grey[np.ix_(rows, columns)].astype(np.int16)
    return np.packbits(cell[:, :-1] > cell[:, 1:]).tobytes().hex()


def feature(image: Jpeg) -> str:
    grey = image.thumbnail()
    return f"{image.width}x{image.height}:{thumbnail_hash(grey)}:{hashlib.sha256(grey.tobytes()).hexdigest()[:16]}"


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored as a JPEG file.

    Null text counts as empty, a null doc_id stays null. Texts are stored whole; a file is made
    in one task, which takes some 18 bytes of memory a byte of its text. Rows are independent:
    ties and repeated rows get equal files, an empty table no rows; further columns are ignored,
    whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                files = [write_jpeg(pad(raw[a:b])) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """Reads stored files back: payload digests, size and digest of the file, thumbnail feature.

    A null file gives nulls; bytes that are no baseline JPEG raise ValueError. Rows are
    independent: ties and repeated rows give equal rows, an empty table none; files are read
    whole; columns other than doc_id, n_bytes and media are ignored, whatever their names.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file in batch.column(2):
                data = file.as_py()
                if data is None:
                    out.append((None,) * 8)
                    continue
                image = Jpeg(data)
                stored = image.payload()
                out.append((len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(image), image.width, image.height))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as a JPEG, read back: see media_table and describe_media, also for the odd cases."""
    return describe_media(media_table(read_table(spark, sf_dir, "documents")))
