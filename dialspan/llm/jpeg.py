"""Progressive JPEG with numpy: bytes as coefficients, scans, and full-resolution RGB.

A payload of 64-byte units is stored losslessly in the format's own unit: each unit is the 64
quantised coefficients of one 8x8 block, in zigzag order (all quantisers are 1). Blocks fill
MCUs of four Y, one Cb and one Cr block (chroma halved both ways). A comment holds the
number of units.

The scans of each component: DC without its lowest bit, DC's lowest bit, AC 1-5 without the
lowest bit, their lowest bits, and AC 6-63. Every block is a restart interval of its own, so
that all blocks of all pictures of a batch are decoded in lockstep, one coefficient at a time.
The decoder adds each scan to the coefficient arrays; it takes any bands, any
approximation bits and end-of-band runs.
"""

from __future__ import annotations

import struct

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8))))
MCU_UNITS, MOST_ACROSS = 6, 4000
#: (first coefficient, last, high bit, low bit) of the scans of each component.
SCANS = ((0, 0, 0, 1), (0, 0, 1, 0), (1, 5, 0, 1), (1, 5, 1, 0), (6, 63, 0, 0))


def code_lengths(symbols: list[int]) -> tuple[list[int], list[int]]:
    """(codes of each length 1-16, the symbols): the first symbols get short codes, no code is all ones."""
    counts, left, room = [0] * 16, len(symbols), 2
    for length in range(1, 17):
        room = room if length == 1 else room * 2
        rest = 16 - length
        # as many codes of this length as leave room for all others and the unused code of ones
        take = min(left, max(0, room - max(1, -(-(left + 1) >> rest)))) if length < 16 else left
        while take and (room - take) << rest < left - take + 1:
            take -= 1
        counts[length - 1] = take
        left -= take
        room -= take
    return counts, symbols


class Huffman:
    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = counts, symbols
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.look_symbol, self.look_size = np.zeros(65536, np.int16), np.zeros(65536, np.int16)
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                s = symbols[at]
                self.code[s], self.size[s] = code, length
                first = code << (16 - length)
                self.look_symbol[first : first + (1 << (16 - length))] = s
                self.look_size[first : first + (1 << (16 - length))] = length
                code += 1
                at += 1
            code <<= 1

    def segment(self, kind: int) -> bytes:
        body = bytes([kind, *self.counts, *self.symbols])
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


DC_TABLE = Huffman(*code_lengths([6, 5, 7, 4, 3, 2, 1, 0, 8, 9, 10, 11]))
#: Likely sizes of text bytes first, then the rest of run and size, end-of-band runs and sixteen zeros.
AC_TABLE = Huffman(*code_lengths([*(likely := [7, 6, 0, 5, 1, 2, 3, 4, 8]), *(s for s in [*(r << 4 | z for r in range(16) for z in range(11))] if s not in likely)]))


def bit_size(x: np.ndarray) -> np.ndarray:
    """The number of bits of non-negative numbers under 2**15."""
    return _SIZES[x]


_SIZES = np.zeros(1 << 15, np.uint8)
for _b in range(15):
    _SIZES[1 << _b : 2 << _b] = _b + 1


def packed_intervals(value: np.ndarray, size: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit fields (rows of at most ``per_row`` used fields each) as stuffed bytes; every row is padded with ones to a byte.

    Returns (bytes of all rows, their count per row).
    """
    rows, width = value.shape
    size = np.where(np.arange(width) < per_row[:, None], size, 0)
    ends = np.cumsum(size, axis=1)
    total = ends[:, -1]
    n_bytes = (total + 7) // 8
    row_start = np.concatenate([[0], np.cumsum(n_bytes)])
    start = (ends - size + row_start[:-1, None] * 8).ravel()
    value, size = value.ravel(), size.ravel()
    used = size > 0
    start, value, size = start[used], value[used], size[used]
    out = np.zeros(int(row_start[-1]) + 4, np.int64)
    # a field of at most 25 bits touches at most four bytes
    wide = value << (32 - size - (start & 7))
    first = start >> 3
    for k in range(4):
        out += np.bincount(first + k, weights=((wide >> (24 - 8 * k)) & 255), minlength=len(out)).astype(np.int64)[: len(out)]
    out = out[: row_start[-1]].astype(np.uint8)
    pad = n_bytes * 8 - total
    out[row_start[1:][n_bytes > 0] - 1] |= ((1 << pad) - 1)[n_bytes > 0].astype(np.uint8)
    ones = np.flatnonzero(out == 255)
    stuffed = np.insert(out, ones + 1, 0)
    extra = np.bincount(np.searchsorted(row_start, ones, side="right") - 1, minlength=rows)[:rows]
    return stuffed, n_bytes + extra


def scan_fields(blocks: np.ndarray, scan: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit fields (value, size, used fields a row) of one scan of ``blocks`` in zigzag order, one restart interval each."""
    first, last, high, low = scan
    part = blocks[:, first : last + 1].astype(np.int64)
    n, width = part.shape
    if first == 0:  # the prediction is 0 in every interval
        if high:
            return (part >> low) & 1, np.ones((n, 1), np.int64), np.ones(n, np.int64)
        dc = part >> low
        s = bit_size(np.abs(dc)).astype(np.int64)
        bits = np.where(dc < 0, dc + (1 << s) - 1, dc)
        return (DC_TABLE.code[s] << s) | bits, DC_TABLE.size[s] + s, np.ones(n, np.int64)
    size_of = np.abs(part) >> low
    old = (np.abs(part) >> high) > 0 if high else np.zeros(part.shape, bool)
    new = (size_of > 0) & ~old
    s = np.where(new, bit_size(size_of), 0).astype(np.int64)
    bits = np.where(part < 0, (1 << s) - 1 - size_of, size_of) & ((1 << s) - 1)
    # a symbol for each new coefficient with the zeros before it, one for sixteen zeros, one for the end
    order = np.arange(width)
    zero = ~new & ~old
    before = np.cumsum(zero, axis=1)
    base = np.maximum.accumulate(np.where(new, before, 0), axis=1)
    prior = np.concatenate([np.zeros((n, 1), np.int64), base[:, :-1]], axis=1)
    run = before - prior
    if not high and not (run[new] > 15).any():
        value = (AC_TABLE.code[(run << 4 | s) & 255] << s) | bits
        size = np.where(new, AC_TABLE.size[(run << 4 | s) & 255] + s, 0)
        tail = np.where(new, order, -1).max(axis=1) < width - 1
        value = np.concatenate([value, np.full((n, 1), AC_TABLE.code[0])], axis=1)
        size = np.concatenate([size, np.where(tail, AC_TABLE.size[0], 0)[:, None]], axis=1)
        return value, size, np.full(n, width + 1)
    return sequential_fields(part, size_of, old, new, s, bits)


def sequential_fields(part, size_of, old, new, s, bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Fields of a refining scan, or of one with long runs of zeros: all rows step through the band together."""
    n, width = part.shape
    value, size = np.zeros((n, 3 * width + 2), np.int64), np.zeros((n, 3 * width + 2), np.int64)
    used, run, row = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    held = np.zeros((n, width), np.int64)  # correction bits that follow the next symbol
    n_held = np.zeros(n, np.int64)

    def put(at: np.ndarray, v: np.ndarray, z: np.ndarray) -> None:
        value[at, used[at]], size[at, used[at]] = v, z
        used[at] += 1

    def flush(at: np.ndarray) -> None:
        for k in range(int(n_held[at].max(initial=0))):
            have = at[n_held[at] > k]
            put(have, held[have, k], np.ones(len(have), np.int64))
        n_held[at] = 0

    final = np.where(new, np.arange(width), -1).max(axis=1)  # the last new coefficient
    for k in range(width):
        zero = ~new[:, k] & ~old[:, k]
        full = row[zero & (run == 15) & (final > k)]
        run[zero] += 1
        if len(full):
            put(full, AC_TABLE.code[np.full(len(full), 0xF0)], AC_TABLE.size[np.full(len(full), 0xF0)])
            flush(full)
            run[full] = 0
        at = row[old[:, k]]
        held[at, n_held[at]] = size_of[at, k] & 1
        n_held[at] += 1
        at = row[new[:, k]]
        if len(at):
            symbol = run[at] << 4 | s[at, k]
            put(at, AC_TABLE.code[symbol] << s[at, k] | bits[at, k], AC_TABLE.size[symbol] + s[at, k])
            flush(at)
            run[at] = 0
    rest = row[(final < width - 1) & ((run > 0) | (n_held > 0))]
    put(rest, np.full(len(rest), AC_TABLE.code[0]), np.full(len(rest), AC_TABLE.size[0]))
    flush(rest)
    return value, size, used


def geometry(units: int) -> tuple[int, int]:
    """(MCUs across, MCUs down) for so many units."""
    mcus = max(1, -(-units // MCU_UNITS))
    down = -(-mcus // MOST_ACROSS)
    return -(-mcus // down), down


def arranged(units: np.ndarray, across: int, down: int) -> list[np.ndarray]:
    """The blocks of Y, Cb and Cr, each row by row, of units in order of their MCUs."""
    blocks = np.zeros((across * down * MCU_UNITS, 64), np.int16)
    blocks[: len(units)] = units
    blocks = blocks.reshape(down, across, MCU_UNITS, 64)
    luma = blocks[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    return [luma, blocks[:, :, 4].reshape(-1, 64), blocks[:, :, 5].reshape(-1, 64)]


def collected(parts: list[np.ndarray], across: int, down: int) -> np.ndarray:
    """The units in order of their MCUs again."""
    luma = parts[0].reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    chroma = [p.reshape(down, across, 1, 64) for p in parts[1:]]
    return np.concatenate([luma, *chroma], axis=2).reshape(-1, 64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload (a positive multiple of 64 bytes)."""
    sizes = [geometry(len(p) // 64) for p in payloads]
    parts = [arranged(np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16), *g) for p, g in zip(payloads, sizes, strict=True)]
    heads = []
    for p, (across, down) in zip(payloads, sizes, strict=True):
        frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        comment = struct.pack(">Q", len(p) // 64)
        heads.append(b"\xff\xd8\xff\xfe" + struct.pack(">H", 10) + comment + b"\xff\xdb\x00\x43\x00" + b"\x01" * 64 + b"\xff\xc2" + struct.pack(">H", len(frame) + 2) + frame + DC_TABLE.segment(0) + AC_TABLE.segment(0x10) + b"\xff\xdd\x00\x04\x00\x01")
    out = [[h] for h in heads]
    for c in range(3):
        blocks = np.concatenate([p[c] for p in parts])
        edges = np.concatenate([[0], np.cumsum([len(p[c]) for p in parts])])
        for scan in SCANS:
            data, lengths = packed_intervals(*scan_fields(blocks, scan))
            marked, ends = with_restarts(data, lengths, edges)
            head = b"\xff\xda\x00\x08\x01" + bytes([c + 1, 0, scan[0], scan[1], scan[2] << 4 | scan[3]])
            for i, o in enumerate(out):
                o += [head, marked[ends[edges[i]] : ends[edges[i + 1]]].tobytes()]
    return [b"".join([*o, b"\xff\xd9"]) for o in out]


def with_restarts(data: np.ndarray, lengths: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals with restart markers between those of one picture, and where each interval begins."""
    n = len(lengths)
    nth = np.arange(n) - np.repeat(edges[:-1], np.diff(edges))
    marker = np.where(nth > 0, 2, 0)
    ends = np.concatenate([[0], np.cumsum(lengths + marker)])
    out = np.empty(int(ends[-1]), np.uint8)
    body = np.ones(len(out), bool)
    at = ends[:-1][marker > 0]
    body[at] = body[at + 1] = False
    out[at], out[at + 1] = 255, 0xD0 + (nth[marker > 0] - 1) % 8
    out[body] = data
    return out, ends


class Bits:
    """A place in each of many bit streams that stand in one buffer."""

    def __init__(self, data: np.ndarray, start: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        self.at = start.astype(np.int64) * 8

    def peek(self, rows: np.ndarray | slice) -> np.ndarray:
        """The next 16 bits of the rows."""
        at = self.at[rows]
        return (self.words[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    def take(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n (0 to 16) bits of each row."""
        got = self.peek(rows) >> (16 - n).astype(np.uint32)
        self.at[rows] += n
        return got.astype(np.int64)


def decode_scan(bits: Bits, out: np.ndarray, scan: tuple[int, int, int, int], dc: Huffman, ac: Huffman) -> None:
    """Adds one scan to ``out`` (a row a block, each a restart interval of its own, zigzag order)."""
    first, last, high, low = scan
    n = len(out)
    every = np.arange(n)
    if first == 0:
        if high:
            out[:, 0] |= (bits.take(every, np.ones(n, np.int64)) << low).astype(out.dtype)
            return
        look = bits.peek(every)
        bits.at += dc.look_size[look]
        s = dc.look_symbol[look].astype(np.int64)
        v = bits.take(every, s)
        out[:, 0] = np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v) << low
        return
    if not high:
        rows, k = every, np.full(n, first)
        while len(rows):
            look = bits.peek(rows)
            symbol = ac.look_symbol[look].astype(np.int64)
            s, run = symbol & 15, symbol >> 4
            bits.at[rows] += ac.look_size[look]
            v = bits.take(rows, s)
            k = k + run
            some = s > 0
            if some.all():
                out[rows, k] = np.where(v < (1 << (s - 1)), v - (1 << s) + 1, v) << low
                k = k + 1
                going = k <= last
            else:
                at, z, x = rows[some], s[some], v[some]
                out[at, k[some]] = np.where(x < (1 << (z - 1)), x - (1 << z) + 1, x) << low
                k = k + 1
                going = (k <= last) & (some | (run == 15))  # another run of size 0 ends the band of the interval's only block
            if not going.all():
                rows, k = rows[going], k[going]
        return
    refine_scan(bits, out, first, last, low, ac)


def refine_scan(bits: Bits, out: np.ndarray, first: int, last: int, low: int, ac: Huffman) -> None:
    """A refining AC scan: each step a row reads a symbol if it needs one and passes one coefficient."""
    n = len(out)
    need, run, value = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    one = 1 << low
    for k in range(first, last + 1):
        rows = np.flatnonzero(need)
        if len(rows):
            look = bits.peek(rows)
            bits.at[rows] += ac.look_size[look]
            symbol = ac.look_symbol[look].astype(np.int64)
            s, r = symbol & 15, symbol >> 4
            more = np.where((s == 0) & (r < 15), r, 0)
            bits.take(rows, more)  # a run over later blocks, of which the interval has none
            sign = bits.take(rows, (s > 0).astype(np.int64))
            value[rows] = np.where(s > 0, np.where(sign > 0, one, -one), 0)
            run[rows] = np.where((s == 0) & (r < 15), 64, r)
            need[rows] = False
        col = out[:, k]
        old = col != 0
        at = np.flatnonzero(old)
        if len(at):
            up = bits.take(at, np.ones(len(at), np.int64)) > 0
            out[at[up], k] += np.where(out[at[up], k] > 0, one, -one).astype(out.dtype)
        stop = ~old & (run == 0)
        out[stop, k] = value[stop].astype(out.dtype)
        run[~old & ~stop] -= 1
        need |= stop


def unstuffed(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A scan's bytes without stuffing and markers, and where each restart interval begins."""
    ff = np.flatnonzero(body[:-1] == 255)
    follow = body[ff + 1]
    marker = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    drop = np.concatenate([ff[follow == 0] + 1, marker, marker + 1])
    keep = np.ones(len(body), bool)
    keep[drop] = False
    before = np.cumsum(keep)
    return body[keep], np.concatenate([[0], before[marker]])


class Picture:
    """The segments of one progressive JPEG; scans stay bytes until they are decoded."""

    def __init__(self, media: bytes):
        self.scans: list[tuple[int, tuple[int, int, int, int], dict[int, Huffman], np.ndarray]] = []
        data = np.frombuffer(media, np.uint8)
        if media[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        tables: dict[int, Huffman] = {}
        at = 2
        self.units, self.restart = None, 0
        ff = np.flatnonzero(data[:-1] == 255)
        ends = ff[(data[ff + 1] != 0) & ((data[ff + 1] < 0xD0) | (data[ff + 1] > 0xD7))]
        while True:
            kind, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            if kind == 0xD9:
                return
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xFE:
                self.units = struct.unpack(">Q", body)[0]
            elif kind == 0xC2:
                _, self.height, self.width, parts = struct.unpack(">BHHB", body[:6])
                if [body[7 + 3 * i] for i in range(parts)] != [0x22, 0x11, 0x11]:
                    raise ValueError("only three components with chroma of half the width and height are read")
            elif kind == 0xDB:
                if set(body[1:65]) != {1} or len(body) % 65 or any(body[i] >> 4 for i in range(0, len(body), 65)):
                    raise ValueError("only quantisers of one are read")
            elif kind == 0xC4:
                while body:
                    counts = list(body[1:17])
                    n = sum(counts)
                    tables = tables | {body[0]: _table(bytes(body[1 : 17 + n]))}
                    body = body[17 + n :]
            elif kind == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif kind == 0xDA:
                stop = int(ends[np.searchsorted(ends, at)])
                if body[0] != 1 or self.restart != 1:
                    raise ValueError("only scans of one component with a restart interval of one block are read")
                self.scans.append((body[1], (body[3], body[4], body[5] >> 4, body[5] & 15), tables, data[at:stop]))
                at = stop


_TABLES: dict[bytes, Huffman] = {}


def _table(spec: bytes) -> Huffman:
    if spec not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[spec] = Huffman(list(spec[:16]), list(spec[16:]))
    return _TABLES[spec]


def decode(media: list[bytes]) -> list[tuple[np.ndarray, list[np.ndarray], int, int]]:
    """(units, blocks of Y, Cb and Cr, MCUs across, MCUs down) of each picture; scans of one shape are decoded together."""
    pictures = [Picture(m) for m in media]
    shape = [(p.width // 16, p.height // 16) for p in pictures]
    counts = [[a * d * 4, a * d, a * d] for a, d in shape]
    edges = [np.concatenate([[0], np.cumsum([c[k] for c in counts])]) for k in range(3)]
    blocks = [np.zeros((int(e[-1]), 64), np.int16) for e in edges]
    script = [(c, scan) for c, scan, _, _ in pictures[0].scans]
    tables = [t for _, _, t, _ in pictures[0].scans]
    for p in pictures:
        if [(c, scan) for c, scan, _, _ in p.scans] != script or any(x is not y for (_, _, t, _), u in zip(p.scans, tables, strict=True) for x, y in zip(t.values(), u.values(), strict=True)):
            return [decode([m])[0] for m in media] if len(media) > 1 else []
    for k, (component, scan) in enumerate(script):
        body = np.concatenate([np.concatenate([p.scans[k][3], _BETWEEN]) for p in pictures])[:-2]
        data, starts = unstuffed(body)
        decode_scan(Bits(data, starts), blocks[component - 1], scan, tables[k][0], tables[k][0x10])
    out = []
    for i, (p, (across, down)) in enumerate(zip(pictures, shape, strict=True)):
        own = [b[e[i] : e[i + 1]] for b, e in zip(blocks, edges, strict=True)]
        out.append((collected(own, across, down)[: p.units], own, across, down))
    return out


_BETWEEN = np.array([0xFF, 0xD0], np.uint8)
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)], np.float32)


def samples(blocks: np.ndarray, across: int) -> np.ndarray:
    """The samples (0-255) of a component whose blocks stand row by row, ``across`` in a row."""
    table = np.zeros(blocks.shape, np.float32)
    table[:, ZIGZAG] = blocks
    table = table.reshape(-1, 8, 8)
    plain = _COS.T @ table @ _COS
    plain = np.clip(np.rint(plain + 128), 0, 255).astype(np.uint8)
    return plain.reshape(-1, across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, across * 8)


def rgb(parts: list[np.ndarray], across: int) -> np.ndarray:
    """The picture as height x width x 3 bytes; chroma is repeated to full resolution."""
    y = samples(parts[0], across * 2).astype(np.float32)
    cb, cr = (samples(p, across).repeat(2, axis=0).repeat(2, axis=1).astype(np.float32) - 128 for p in parts[1:])
    planes = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(planes), 0, 255).astype(np.uint8)
