"""Progressive JPEG columns: a coder and decoder whose coefficient arrays keep any bytes losslessly.

Encoder: three components of 8x8 blocks in 4:4:4, coefficients sent in scans by spectral selection
(DC, then bands of AC) and successive approximation (high bits first, then one bit at a time).
Decoder: baseline-free progressive JPEG (SOF2) of 8-bit samples with any sampling factors, restart
intervals and Huffman tables: scans add up in coefficient arrays, then dequantise, invert the DCT by
matrix products over all blocks at once, upsample chroma and convert to RGB.

A scan whose Huffman table holds a single symbol has records of a known width, so it is read with
array operations; any other scan is read code by code.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 64
#: ITU-T T.81 figure A.6, as a rule: the diagonals in turn, up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: A coefficient that holds byte b is b, or b - TOP for bytes below 128, so all have eight bits, a sign and the same size category.
TOP = 255
#: (first, last, bits left out) of the first AC scans; each bit left out has a scan of its own.
BANDS, LOW = ((1, 5), (6, 63)), 1


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, slot: int, codes: list[tuple[int, int]]) -> bytes:
    """A DHT segment of (length, symbol) pairs, shorter codes first."""
    counts = [sum(n == length for n, _ in codes) for length in range(1, 17)]
    return _segment(0xC4, bytes([kind << 4 | slot, *counts, *[s for _, s in codes]]))


def _scan(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    head = bytes([len(parts), *[x for c, dc, ac in parts for x in (c, dc << 4 | ac)], first, last, high << 4 | low])
    pad = np.ones(-len(bits) % 8, np.uint8)
    return _segment(0xDA, head) + np.packbits(np.concatenate([bits, pad])).tobytes().replace(b"\xff", b"\xff\x00")


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return (values[..., None] >> np.arange(width - 1, -1, -1)).astype(np.uint8) & 1


_DC_CODES = _table(0, 0, [(4, s) for s in range(10)])
#: No zeros before it and so many bits; end of band, so only correction bits follow. With LOW = 1 a first record is one byte.
_AC_CODES = _table(1, 0, [(1, 8 - LOW)]) + _table(1, 1, [(1, 0)])


def encode(coefficients: np.ndarray, columns: int, comment: bytes = b"") -> bytes:
    """A progressive JPEG of (3, blocks, 64) coefficients of magnitude 128 to TOP in zigzag order, ``columns`` blocks wide."""
    v = coefficients.astype(np.int16)
    n = v.shape[1]
    rows, size_of = n // columns, np.abs(v)
    assert rows * columns == n and size_of.min(initial=128) >= 128 and size_of.max(initial=128) <= TOP
    size = b"\x08" + (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big")
    out = [b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\x00" + bytes([1] * 64)), _segment(0xC2, size + b"\x03" + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    # DC: differences of the high bits along each component, interleaved; categories in codes of 4 bits.
    out.append(_DC_CODES)
    dc = v[:, :, 0].astype(np.int64) >> LOW
    diff = np.diff(dc, axis=1, prepend=0).T.ravel()
    width = np.zeros(len(diff), np.int64)
    for s in range(1, 10):
        width[np.abs(diff) >= 1 << (s - 1)] = s
    code = (width << 9) | np.where(diff < 0, diff + (1 << width) - 1, diff)
    grid = np.concatenate([_bits(width, 4), _bits(code & 511, 9)], 1)
    keep = np.concatenate([np.ones((len(diff), 4), bool), np.arange(8, -1, -1)[None, :] < width[:, None]], 1)
    out.append(_scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 0, LOW, grid[keep]))
    out.append(_AC_CODES)
    high = (size_of >> LOW).astype(np.uint8)
    field = np.where(v < 0, high ^ np.uint8((1 << (8 - LOW)) - 1), high)  # after a code of one bit, 0
    for first, last in BANDS:
        for c in range(3):
            out.append(_scan([(c + 1, 0, 0)], first, last, 0, LOW, _bits(field[c, :, first : last + 1], 9 - LOW).ravel()))
    for low in range(LOW - 1, -1, -1):
        out.append(_scan([(c + 1, 0, 0) for c in range(3)], 0, 0, low + 1, low, ((v[:, :, 0] >> low) & 1).astype(np.uint8).T.ravel()))
        for first, last in BANDS:
            for c in range(3):
                part = ((size_of[c, :, first : last + 1] >> low) & 1).astype(np.uint8)
                out.append(_scan([(c + 1, 0, 1)], first, last, low + 1, low, np.concatenate([np.zeros((n, 1), np.uint8), part], 1).ravel()))
    return b"".join([*out, b"\xff\xd9"])


class _Reader:
    """Bits of one entropy-coded stretch, stuffing removed; past its end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data + b"\xff" * 8, 0, 0, 0

    def peek(self, k: int) -> int:
        while self.n < k:
            if self.at + 4 > len(self.data) + 64:
                raise ValueError("a scan ends early")
            self.acc = (self.acc << 32) | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\xff"), "big")
            self.at, self.n = self.at + 4, self.n + 32
        return (self.acc >> (self.n - k)) & ((1 << k) - 1)

    def take(self, k: int) -> int:
        if not k:
            return 0
        x = self.peek(k)
        self.n -= k
        self.acc &= (1 << self.n) - 1
        return x

    def code(self, table: dict) -> int:
        length, symbol = table["look"][self.peek(16)]
        if not length:
            raise ValueError("a code isn't in its table")
        self.take(length)
        return symbol

    def number(self, s: int) -> int:
        x = self.take(s)
        return x if not s or x >> (s - 1) else x - (1 << s) + 1


def _lookup(counts: bytes, symbols: bytes) -> dict:
    look, code, k = [(0, 0)] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            lo = code << (16 - length)
            look[lo : lo + (1 << (16 - length))] = [(length, symbols[k])] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return {"look": look, "single": (next(i + 1 for i in range(16) if counts[i]), symbols[0]) if sum(counts) == 1 else None}


def _records(parts: list[bytes], counts: list[int], width: int) -> np.ndarray:
    """(records, width) bits of restart intervals that hold ``counts`` records each."""
    out = []
    for data, k in zip(parts, counts, strict=True):
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=k * width) if len(data) * 8 >= k * width else None
        if bits is None:
            raise ValueError("a scan ends early")
        out.append(bits.reshape(k, width))
    return np.concatenate(out) if out else np.zeros((0, width), np.uint8)


_LOOKS: dict[bytes, dict] = {}


def decode_coefficients(data: bytes) -> dict:
    """Frame, quantisation, comments and the (rows, columns, 64) coefficient array of each component, in zigzag order."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, out, interval = 2, {}, {}, {"comments": []}, 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return out | {"quant": quant}
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out["comments"].append(body)
        elif marker == 0xDB:
            while body:
                wide, slot = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[slot] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                if body[1:n] not in _LOOKS:
                    if len(_LOOKS) > 64:
                        _LOOKS.clear()
                    _LOOKS[body[1:n]] = _lookup(body[1:17], body[17:n])
                tables[body[0]] = _LOOKS[body[1:n]]
                body = body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
            hm, vm = max(p["h"] for p in parts), max(p["v"] for p in parts)
            mc, mr = -(-w // (8 * hm)), -(-h // (8 * vm))
            for p in parts:
                p["rows"], p["cols"] = -(-(-(-h * p["v"] // vm)) // 8), -(-(-(-w * p["h"] // hm)) // 8)
                p["coef"] = np.zeros((mr * p["v"], mc * p["h"], 64), np.int32)
            out |= {"height": h, "width": w, "parts": parts, "hm": hm, "vm": vm, "mcus": (mr, mc)}
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive JPEGs with Huffman codes are read")
        elif marker == 0xDA:
            stop = at
            while True:
                stop = data.index(b"\xff", stop)
                if data[stop + 1] != 0 and not 0xD0 <= data[stop + 1] <= 0xD7:
                    break
                stop += 2
            raw, at = data[at:stop], stop
            pieces, last = [], 0
            if interval:
                i = raw.find(b"\xff")
                while i >= 0:
                    if raw[i + 1] != 0:
                        pieces.append(raw[last:i])
                        last = i + 2
                    i = raw.find(b"\xff", i + 2)
            pieces = [x.replace(b"\xff\x00", b"\xff") for x in [*pieces, raw[last:]]]
            chosen = [(next(p for p in out["parts"] if p["id"] == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            first, final, bits = body[-3], body[-2], body[-1]
            _read_scan(out, chosen, tables, first, final, bits >> 4, bits & 15, pieces, interval)


def _places(frame: dict, chosen: list) -> tuple[list, int]:
    """(part, row, column) arrays of blocks per unit in scan order: blocks alone, or whole MCUs."""
    if len(chosen) == 1:
        p = chosen[0][0]
        if "grid" not in p:
            p["grid"] = np.divmod(np.arange(p["rows"] * p["cols"]), p["cols"])
        return [(chosen[0], *p["grid"])], p["rows"] * p["cols"]
    mr, mc = frame["mcus"]
    y, x = np.divmod(np.arange(mr * mc), mc)
    return [(t, y * t[0]["v"] + j, x * t[0]["h"] + i) for t in chosen for j in range(t[0]["v"]) for i in range(t[0]["h"])], mr * mc


def _read_scan(frame, chosen, tables, first, last, high, low, pieces, interval) -> None:
    units, n = _places(frame, chosen)
    step = interval or max(n, 1)
    counts = [min(step, n - i) for i in range(0, n, step)]
    if len(pieces) < len(counts):
        raise ValueError("a restart interval is missing")
    pieces = pieces[: len(counts)]
    if first == 0 and high:  # one more bit of each DC
        bits = _records(pieces, counts, len(units))
        for k, ((p, _, _), r, c) in enumerate(units):
            p["coef"][r, c, 0] |= bits[:, k].astype(np.int32) << low
        return
    if first == 0:
        u = 0
        looks = [(p, tables[dc], r.tolist(), c.tolist()) for (p, dc, _), r, c in units]
        for data, k in zip(pieces, counts, strict=True):
            got, before = _Reader(data), {id(p): 0 for (p, _, _), _, _ in units}
            rows = [[] for _ in looks]
            for _ in range(k):
                for which, (p, look, _, _) in enumerate(looks):
                    before[id(p)] += got.number(got.code(look))
                    rows[which].append(before[id(p)])
            for values, ((p, _, _), r, c) in zip(rows, units, strict=True):
                p["coef"][r[u : u + k], c[u : u + k], 0] = np.array(values, np.int32) << low
            u += k
        return
    (p, _, ac), r, c = units[0]
    table, span = tables[16 + ac], last - first + 1
    whole = p["coef"].shape[:2] == (p["rows"], p["cols"])  # then the blocks are a view
    band = p["coef"].reshape(-1, 64)[:, first : last + 1] if whole else p["coef"][r, c, first : last + 1]
    single = table["single"]
    if not high and single and single[1] >> 4 == 0 and single[1] & 15:
        length, s = single
        if length + s == 8:  # a record is a byte
            if any(len(data) < k * span for data, k in zip(pieces, counts, strict=True)):
                raise ValueError("a scan ends early")
            record = np.concatenate([np.frombuffer(data, np.uint8, k * span) for data, k in zip(pieces, counts, strict=True)] or [np.zeros(0, np.uint8)])
            value = (record.reshape(n, span) & ((1 << s) - 1)).astype(np.int32)
        else:
            bits = _records(pieces, counts, span * (length + s)).reshape(n, span, length + s)[:, :, length:]
            value = bits.astype(np.int32) @ (1 << np.arange(s - 1, -1, -1, dtype=np.int32))
        band = np.where(value >> (s - 1), value, value - (1 << s) + 1) << low
    elif high and single and single[1] == 0 and band.all():
        bits = _records(pieces, counts, single[0] + span)[:, single[0] :].astype(np.int32)
        band = band + np.where(band < 0, -1, 1) * (bits << low)
    else:
        u = 0
        for data, k in zip(pieces, counts, strict=True):
            (_refine_ac if high else _first_ac)(_Reader(data), table, band[u : u + k], low)
            u += k
    if whole:
        p["coef"].reshape(-1, 64)[:, first : last + 1] = band
    else:
        p["coef"][r, c, first : last + 1] = band


def _first_ac(got: _Reader, table: dict, band: np.ndarray, low: int) -> None:
    run = 0
    for block in band:
        if run:
            run -= 1
            continue
        k = 0
        while k < len(block):
            r, s = divmod(got.code(table), 16)
            if s:
                k += r
                block[k] = got.number(s) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + got.take(r)
                break


def _refine_ac(got: _Reader, table: dict, band: np.ndarray, low: int) -> None:
    one, run = 1 << low, 0

    def correct(block, k):
        if got.take(1):
            block[k] += one if block[k] > 0 else -one

    for block in band:
        k = 0
        if not run:
            while k < len(block):
                r, s = divmod(got.code(table), 16)
                new = 0
                if s:
                    new = one if got.take(1) else -one
                elif r < 15:
                    run = (1 << r) + got.take(r)
                    break
                while k < len(block):
                    if block[k]:
                        correct(block, k)
                    elif r:
                        r -= 1
                    else:
                        block[k] = new
                        k += 1
                        break
                    k += 1
        if run:
            for j in range(k, len(block)):
                if block[j]:
                    correct(block, j)
            run -= 1


#: The DCT's matrix in fixed point: products of integers in doubles are exact, so results don't depend on the order of sums.
_SHIFT = 11
_DCT = np.array([[round((0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) * (1 << _SHIFT)) for x in range(8)] for u in range(8)], np.float64)


def samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(8 * rows, 8 * columns) samples of a component."""
    rows, cols, _ = coef.shape
    block = np.zeros((rows * cols, 64))
    block[:, ZIGZAG] = coef.reshape(-1, 64) * quant
    half = (block.reshape(-1, 8) @ _DCT).reshape(-1, 8, 8).transpose(0, 2, 1)  # (block, x, v)
    full = (np.ascontiguousarray(half).reshape(-1, 8) @ _DCT).reshape(rows, cols, 8, 8)  # (.., x, y)
    level = np.floor((full + (1 << (2 * _SHIFT - 1))) / (1 << (2 * _SHIFT))) + 128
    return np.clip(level, 0, 255).astype(np.uint8).transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)


def to_rgb(frame: dict) -> np.ndarray:
    """(height, width, 3) samples: chroma repeated to full size, then YCbCr to RGB in fixed point."""
    h, w = frame["height"], frame["width"]
    planes = []
    for p in frame["parts"]:
        s = samples(p["coef"], frame["quant"][p["q"]])
        planes.append(s.repeat(frame["vm"] // p["v"], 0).repeat(frame["hm"] // p["h"], 1)[:h, :w].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)], 2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return to_rgb(decode_coefficients(data))


def pack(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG that holds a payload of a multiple of 192 bytes as coefficients; its comment tells both sizes.

    Blocks stand in columns of up to 8191, the format's largest height; blocks beyond the payload are filler.
    """
    units = len(payload) // 192
    columns = -(-units // 8191)
    rows = -(-units // columns)
    full = np.zeros(rows * columns * 192, np.uint8)
    full[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = full.reshape(-1, 3, 64).transpose(1, 0, 2).astype(np.int16)
    values -= np.int16(TOP) * (values < 128)
    return encode(values, columns, f"bytes={n_bytes} payload={len(payload)}".encode())


def unpack(frame: dict) -> tuple[int, bytes]:
    """(n_bytes, payload) of a decoded frame that pack() made."""
    sizes = dict(x.split(b"=") for x in frame["comments"][0].split())
    c = [p["coef"][: p["rows"], : p["cols"]].reshape(-1, 64) for p in frame["parts"]]
    flat = np.stack(c, 1)
    flat = np.where(flat < 0, flat + TOP, flat).astype(np.uint8).tobytes()
    return int(sizes[b"bytes"]), flat[: int(sizes[b"payload"])]


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", multiple: int = 192) -> DataFrame:
    """(id, media binary): each whole text, null as empty, padded with spaces to a positive multiple of 192 bytes, as a progressive JPEG.

    Repeated rows and ids give a row each; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            keys, held, size = [], [], 0
            for key, t in zip(batch.column(0), batch.column(1), strict=True):
                b = (t.as_py() or "").encode()
                padded = b + b" " * (-len(b) % multiple or (multiple if not b else 0))
                keys.append(key.as_py())
                held.append(pack(padded, len(b)))
                size += len(held[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(held, pa.binary())], ["id", "media"])
                    keys, held, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(held, pa.binary())], ["id", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"id {kind}, media binary")


def read_media(media: DataFrame, tensors: bool = False, digest: bool = False) -> DataFrame:
    """A row per stored JPEG: sizes and digests of the payload read back, of the stored form, and features of its RGB tensor.

    feature is width x height and the mean of R, G and B in thousandths. With ``tensors`` the
    full-resolution tensor follows as height, width and row-major bytes; with ``digest`` comes the SHA-256 of those bytes.
    """
    kind = media.schema["id"].dataType.simpleString()
    spec = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    spec += ", rgb_sha256 string" if digest else ""
    spec += ", height int, width int, rgb binary" if tensors else ""
    names = [x.split()[0] for x in spec.split(", ")]

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for key, cell in zip(batch.column("id"), batch.column("media"), strict=True):
                data = cell.as_py()
                frame = decode_coefficients(data)
                n, payload = unpack(frame)
                rgb = to_rgb(frame)
                means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // max(1, rgb.shape[0] * rgb.shape[1])
                row = [key.as_py(), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(map(str, means))]
                row += [hashlib.sha256(rgb.tobytes()).hexdigest()] if digest else []
                rows.append(row + ([rgb.shape[0], rgb.shape[1], rgb.tobytes()] if tensors else []))
                held += rgb.nbytes
                if held > 1 << 24 or len(rows) >= 1000:
                    yield _batch(rows, names, batch.column("id").type)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names, batch.column("id").type)

    return media.select("id", "media").mapInArrow(run, spec)


def _batch(rows, names, key_type):
    kinds = {"id": key_type, "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string() if n in ("payload_sha256", "media_sha256", "feature", "rgb_sha256") else pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)
