"""Lossless WebP (VP8L): reading and writing pixel arrays in numpy.

The decoder takes many pictures at once and moves through them in step, one pixel of each at a time: bits are
fetched, prefix codes looked up and pixels written as vectors over the pictures, so the cost of a step is
shared by all. It reads all of the format: prefix codes with groups by region, back-references, colour cache,
and the predictor, cross-colour, subtract-green and palette transforms.

The writer puts 8-bit samples into the green channel of pictures 64 pixels wide, with prefix codes and
back-references; for tests it can also apply each transform and use the colour cache.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

WIDTH, HEIGHT = 64, 64
#: Order in which lengths of the code-length code are stored: fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distances by code: neighbours left and above, near ones first.
NEAR = sorted([(x, 0) for x in range(1, 9)] + [(x, y) for y in range(1, 8) for x in range(-7, 9)], key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_U = np.uint64
#: Each 16-bit number with its bits in reverse.
_TURNED = (np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, ::-1].astype(np.int64) << np.arange(15, -1, -1)).sum(axis=1)


# ---- prefix codes -------------------------------------------------------------------------------------------


def code_lengths(count: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code for the counts; counts are flattened until no length is over `most`."""
    used = np.flatnonzero(count)
    length = np.zeros(len(count), np.int64)
    if len(used) < 2:
        length[used] = 1
        return length
    weights = count[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for new in range(len(used), 2 * len(used) - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            heapq.heapreplace(heap, (a[0] + b[0], new))
            parent[a[1]] = parent[b[1]] = new
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= most:
            length[used] = depth[: len(used)]
            return length
        weights = [(w + 1) // 2 for w in weights]


def _reversed_codes(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in canonical order and their codes, first bit lowest."""
    used = np.flatnonzero(length)
    symbols = used[np.argsort(length[used], kind="stable")]
    own = length[symbols]
    most = int(own[-1])
    room = (1 << (most - own)).astype(np.int64)
    code = (np.cumsum(room) - room) >> (most - own)
    return symbols, _TURNED[code] >> (16 - own)


def decode_table(length: np.ndarray) -> np.ndarray:
    """symbol << 4 | bits for each value of the next bits; a code of one symbol takes none."""
    return _table(length.tobytes())


@lru_cache(256)
def _table(packed: bytes) -> np.ndarray:
    length = np.frombuffer(packed, np.int64)
    used = np.flatnonzero(length)
    if len(used) == 0:
        raise ValueError("a prefix code has no symbol")
    if len(used) == 1:
        return np.array([int(used[0]) << 4], np.int32)
    symbols, codes = _reversed_codes(length)
    most = int(length[symbols[-1]])
    if int((1 << (most - length[symbols])).sum()) != 1 << most:
        raise ValueError("a prefix code is not complete")
    table = np.empty(1 << most, np.int32)
    for s, c, n in zip(symbols.tolist(), codes.tolist(), length[symbols].tolist(), strict=True):
        table[c :: 1 << n] = s << 4 | n
    return table


# ---- decoder ------------------------------------------------------------------------------------------------


class _Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def bits(self, n: int) -> int:
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("a picture ends early")
        return value & ((1 << n) - 1)


def _read_code(r: _Reader, size: int) -> np.ndarray:
    length = np.zeros(size, np.int64)
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        length[r.bits(8 if wide else 1)] = 1
        if two:
            length[r.bits(8)] = 1
        return length
    own = np.zeros(19, np.int64)
    for i in LENGTH_ORDER[: 4 + r.bits(4)]:
        own[i] = r.bits(3)
    table = decode_table(own).tolist()
    mask = len(table) - 1
    left = size
    if r.bits(1):
        left = 2 + r.bits(2 + 2 * r.bits(3))
    at, before = 0, 8
    data, pos = r.data, r.at
    while at < size and left:
        left -= 1
        byte = pos >> 3
        window = int.from_bytes(data[byte : byte + 4], "little") >> (pos & 7)
        entry = table[window & mask]
        pos += entry & 15
        window >>= entry & 15
        symbol = entry >> 4
        if symbol < 16:
            length[at] = symbol
            at += 1
            before = symbol or before
        elif symbol == 16:
            n = 3 + (window & 3)
            pos += 2
            length[at : at + n] = before
            at += n
        elif symbol == 17:
            at += 3 + (window & 7)
            pos += 3
        else:
            at += 11 + (window & 127)
            pos += 7
    r.at = pos
    if at > size:
        raise ValueError("too many code lengths")
    return length


@dataclass
class _Job:
    """A coded pixel stream: tables of each group's five codes, group of each block, position of the first bit."""

    data: bytes
    at: int
    width: int
    height: int
    cache: int
    groups: list[list[np.ndarray]]
    meta: np.ndarray | None = None
    meta_bits: int = 0


def _value(prefix: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length or distance of a prefix symbol, and the extra bits that it took."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return base + (window.astype(np.int64) & ((1 << extra) - 1)) + 1, extra


def decode_pixels(jobs: list[_Job]) -> tuple[list[np.ndarray], list[int]]:
    """ARGB pixels of each stream, and the position after it."""
    count = np.array([j.width * j.height for j in jobs])
    order = np.argsort(-count, kind="stable")
    jobs = [jobs[i] for i in order]
    count = count[order]
    n = len(jobs)
    starts = np.cumsum([0] + [len(j.data) + 16 for j in jobs])[:-1]
    data = np.zeros(int(starts[-1]) + len(jobs[-1].data) + 2048, np.uint8)  # 64 steps may run over before it is noticed
    for j, s in zip(jobs, starts.tolist(), strict=True):
        data[s : s + len(j.data)] = np.frombuffer(j.data, np.uint8)
    eight = np.ndarray((len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))
    pos = starts * 8 + np.array([j.at for j in jobs])
    limit = starts * 8 + np.array([8 * len(j.data) for j in jobs])
    tables, base, mask, first = [], [], [], []
    size = 0
    for j in jobs:
        first.append(len(base))
        for group in j.groups:
            rows = [], []
            for t in group:
                rows[0].append(size)
                rows[1].append(len(t) - 1)
                tables.append(t)
                size += len(t)
            base.append(rows[0])
            mask.append(rows[1])
    table = np.concatenate(tables)
    base, mask, first = np.array(base), np.array(mask), np.array(first)
    single = np.array([len(j.groups) for j in jobs]) == 1
    plain_job = np.array([all(len(t) == 1 for g in j.groups for t in g[1:4]) and j.cache == 0 and len(j.groups) == 1 for j in jobs])
    fixed = np.array([(int(j.groups[0][3][0]) >> 4) << 24 | (int(j.groups[0][1][0]) >> 4) << 16 | (int(j.groups[0][2][0]) >> 4) for j in jobs], np.uint32)
    width = np.array([j.width for j in jobs])
    cache_bits = np.array([j.cache for j in jobs])
    cache = np.zeros((n, 1 << int(cache_bits.max())), np.uint32) if cache_bits.any() else None
    cached = np.flatnonzero(cache_bits)
    out = np.empty((int(count[0]), n), np.uint32)
    left, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    near = np.array([(0, 0), *NEAR])
    live = np.searchsorted(-count, -np.arange(int(count[0])), "left")  # streams with more than t pixels
    copying = False

    def look(who: np.ndarray | slice, rows: np.ndarray, code: int) -> np.ndarray:
        p = pos[who]
        window = eight[p >> 3] >> (p & 7).astype(_U)
        entry = table[base[rows, code] + (window & mask[rows, code].astype(_U)).astype(np.int64)]
        pos[who] = p + (entry & 15)
        return entry >> 4

    def extra(who: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        p = pos[who]
        value, took = _value(prefix, eight[p >> 3] >> (p & 7).astype(_U))
        pos[who] = p + took
        return value

    green_base, green_mask = base[first, 0], mask[first, 0].astype(_U)
    all_plain = bool(plain_job.all())
    for t in range(int(count[0])):
        na = int(live[t])
        if t & 63 == 63 and (pos > limit).any():
            raise ValueError("a picture ends early")
        if all_plain and not copying:
            p = pos[:na]
            entry = table[green_base[:na] + ((eight[p >> 3] >> (p & 7).astype(_U)) & green_mask[:na]).astype(np.int64)]
            pos[:na] = p + (entry & 15)
            symbol = entry >> 4
            if na and int(symbol.max()) < 256:
                out[t, :na] = fixed[:na] | (symbol.astype(np.uint32) << 8)
                continue
            who = np.arange(na)
            rows = first[:na]
        else:
            who = np.flatnonzero(left[:na] == 0)
            rows = first[who]
            several = np.flatnonzero(~single[who])
            for i in several.tolist():
                j = jobs[who[i]]
                y, x = divmod(t, j.width)
                rows[i] += j.meta[y >> j.meta_bits, x >> j.meta_bits]
            symbol = look(who, rows, 0)
        literal = symbol < 256
        if literal.any():
            w, g = who[literal], rows[literal]
            if all_plain:
                out[t, w] = fixed[w] | (symbol[literal].astype(np.uint32) << 8)
            else:
                red = look(w, g, 1).astype(np.uint32)
                blue = look(w, g, 2).astype(np.uint32)
                alpha = look(w, g, 3).astype(np.uint32)
                out[t, w] = alpha << 24 | red << 16 | symbol[literal].astype(np.uint32) << 8 | blue
        copy = (symbol >= 256) & (symbol < 280)
        if copy.any():
            w, g = who[copy], rows[copy]
            left[w] = extra(w, symbol[copy] - 256)
            code = extra(w, look(w, g, 4))
            short = np.where(code <= 120, code, 0)
            back[w] = np.where(code > 120, code - 120, np.maximum(near[short, 0] + near[short, 1] * width[w], 1))
            if (back[w] > t).any() or (left[w] > count[w] - t).any():
                raise ValueError("a back-reference leaves its picture")
        stored = symbol >= 280
        if stored.any():
            w = who[stored]
            if cache is None or (symbol[stored] - 280 >= 1 << cache_bits[w]).any():
                raise ValueError("a colour is not in the cache")
            out[t, w] = cache[w, symbol[stored] - 280]
        w = np.flatnonzero(left[:na] > 0)
        if len(w):
            out[t, w] = out[t - back[w], w]
            left[w] -= 1
        copying = bool((left[:na] > 0).any())
        if len(cached):
            c = cached[cached < na]
            color = out[t, c]
            cache[c, (np.uint32(0x1E35A7BD) * color) >> (32 - cache_bits[c]).astype(np.uint32)] = color
    if (pos > limit).any():
        raise ValueError("a picture ends early")
    got, ends = [np.zeros(0, np.uint32)] * n, [0] * n
    for k, i in enumerate(order.tolist()):
        got[i] = out[: count[k], k].copy()
        ends[i] = int(pos[k] - starts[k] * 8)
    return got, ends


def _stream(r: _Reader, width: int, height: int, main: bool) -> _Job:
    """Cache size, groups and codes of a pixel stream whose pixels start where the reader then stands."""
    cache = r.bits(4) if r.bits(1) else 0
    meta, bits, groups = None, 0, 1
    if main and r.bits(1):
        bits = r.bits(3) + 2
        w, h = -(-width >> bits), -(-height >> bits)
        meta = (_picture(r, w, h).reshape(h, w) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
        meta = meta.astype(np.int64)
    sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
    codes = [[decode_table(_read_code(r, s)) for s in sizes] for _ in range(groups)]
    return _Job(r.data, r.at, width, height, cache, codes, meta, bits)


def _picture(r: _Reader, width: int, height: int) -> np.ndarray:
    """A small picture inside a stream."""
    got, ends = decode_pixels([_stream(r, width, height, False)])
    r.at = ends[0]
    return got[0]


@dataclass
class _Header:
    width: int
    height: int
    transforms: list[tuple] = field(default_factory=list)
    job: _Job | None = None


def _header(data: bytes) -> _Header:
    r = _Reader(data)
    if r.bits(8) != 0x2F:
        raise ValueError("not a lossless picture")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    out, now = _Header(width, height), width
    while r.bits(1):
        kind = r.bits(2)
        if kind < 2:
            bits = r.bits(3) + 2
            w, h = -(-now >> bits), -(-height >> bits)
            out.transforms.append((kind, now, bits, _picture(r, w, h).reshape(h, w)))
        elif kind == 2:
            out.transforms.append((kind, now))
        else:
            size = r.bits(8) + 1
            table = _picture(r, size, 1).view(np.uint8).reshape(size, 4)
            palette = np.cumsum(table, axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            out.transforms.append((kind, now, pack, palette))
            now = -(-now >> pack)
    out.job = _stream(r, now, height, True)
    return out


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) blue, green, red, alpha."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The fourteen predictors on int vectors of components."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([0, 0, 0, 255])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7):
        return half(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return half(corner if mode == 8 else top, top if mode == 8 else right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + ((mean - corner) / 2).astype(int), 0, 255)
    return np.array([0, 0, 0, 255])


def _undo_predictor(pixels: np.ndarray, bits: int, modes: np.ndarray, forward: bool = False) -> np.ndarray:
    """Adds to each pixel what its neighbours predict; `forward` takes it away (for the writer)."""
    height, width = pixels.shape
    got = _bytes(pixels).astype(int)
    whole = got.copy()  # the true pixels, known before their successors are predicted
    mode = (modes >> 8) & 15
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                p = np.array([0, 0, 0, 255])
            elif y == 0:
                p = whole[0, x - 1]
            elif x == 0:
                p = whole[y - 1, 0]
            else:
                right = whole[y - 1, x + 1] if x + 1 < width else whole[y, 0]
                p = _predict(int(mode[y >> bits, x >> bits]), whole[y, x - 1], whole[y - 1, x], whole[y - 1, x - 1], right)
            if forward:
                got[y, x] = (whole[y, x] - p) & 255
            else:
                whole[y, x] = (got[y, x] + p) & 255
    return (got if forward else whole).astype(np.uint8).reshape(height, -1).view(np.uint32)


def _undo_cross(pixels: np.ndarray, bits: int, factors: np.ndarray, forward: bool = False) -> np.ndarray:
    height, width = pixels.shape
    c = _bytes(pixels).astype(np.int32)
    f = _bytes(factors).view(np.int8).astype(np.int32)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda a: ((a & 255) ^ 128) - 128
    step = lambda a, b: (a * signed(b)) >> 5
    sign = -1 if forward else 1
    red = c[..., 2] + sign * step(f[..., 0], c[..., 1])
    true_red = c[..., 2] if forward else red
    blue = c[..., 0] + sign * (step(f[..., 1], c[..., 1]) + step(f[..., 2], true_red))
    c[..., 2], c[..., 0] = red & 255, blue & 255
    return c.astype(np.uint8).reshape(height, -1).view(np.uint32)


def _undo_green(pixels: np.ndarray, forward: bool = False) -> np.ndarray:
    c = _bytes(pixels).copy()
    change = c[..., 1] * (255 if forward else 1)
    c[..., 2] += change
    c[..., 0] += change
    return c.reshape(pixels.shape[0], -1).view(np.uint32)


def _undo_palette(pixels: np.ndarray, width: int, pack: int, palette: np.ndarray) -> np.ndarray:
    index = (pixels >> 8) & 255
    if pack:
        each = 8 >> pack
        shifts = np.arange(1 << pack) * each
        index = ((index[..., None] >> shifts) & ((1 << each) - 1)).reshape(pixels.shape[0], -1)[:, :width]
    known = np.zeros(256, np.uint32)
    known[: len(palette)] = palette
    return known[index]


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """(height, width) arrays of ARGB as uint32, one for each VP8L stream."""
    if not streams:
        return []
    headers = [_header(s) for s in streams]
    pixels, _ = decode_pixels([h.job for h in headers])
    out = []
    for h, p in zip(headers, pixels, strict=True):
        p = p.reshape(h.height, h.job.width)
        for kind, width, *rest in reversed(h.transforms):
            if kind == 0:
                p = _undo_predictor(p, *rest)
            elif kind == 1:
                p = _undo_cross(p, *rest)
            elif kind == 2:
                p = _undo_green(p)
            else:
                p = _undo_palette(p, width, *rest)
        out.append(p)
    return out


# ---- writer -------------------------------------------------------------------------------------------------


class _Writer:
    """Bits, first lowest: numbers are gathered and packed at the end."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.now: list[int] = []
        self.now_sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.now.append(value)
        self.now_sizes.append(size)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        self.values.append(values)
        self.sizes.append(sizes)

    def _close(self) -> None:
        if self.now:
            self.values.append(np.array(self.now, np.int64))
            self.sizes.append(np.array(self.now_sizes, np.int64))
            self.now, self.now_sizes = [], []

    def bytes(self) -> bytes:
        self._close()
        value, size = np.concatenate(self.values), np.concatenate(self.sizes)
        at = np.cumsum(size) - size
        value = value << (at & 7)
        where, total = at >> 3, int(at[-1] + size[-1] + 7) >> 3
        out = np.zeros(total + 5)
        for k in range(4):  # at most 24 bits and 7 of shift
            part = (value >> (8 * k)) & 255
            out += np.bincount(where + k, weights=part, minlength=total + 5)
        return out[:total].astype(np.uint8).tobytes()


#: A complete code for code lengths, the same for all: 13 symbols of 4 bits and 6 of 5.
_OWN = np.array([4 if s in (0, 17, 18) or 3 <= s <= 12 else 5 for s in range(19)], np.int64)
_OWN_CODE = dict(zip(*(a.tolist() for a in _reversed_codes(_OWN)), strict=True))


def _put_code(w: _Writer, length: np.ndarray) -> None:
    used = np.flatnonzero(length).tolist()
    if len(used) == 1 and used[0] < 256:
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        return
    if not used:
        w.put(1, 4)  # simple, one symbol, one bit, symbol 0
        return
    if len(used) == 1:  # a lone symbol that the simple form can't hold gets a partner
        length = length.copy()
        length[0] = 1
        used = [0, used[0]]
    w.put(0, 1)
    w.put(15, 4)
    for i in LENGTH_ORDER:
        w.put(int(_OWN[i]), 3)
    w.put(0, 1)
    at = 0
    for symbol in [*used, len(length)]:
        gap = symbol - at
        while gap:
            if gap >= 11:
                n = min(gap, 138)
                w.put(_OWN_CODE[18], int(_OWN[18]))
                w.put(n - 11, 7)
            elif gap >= 3:
                n = gap
                w.put(_OWN_CODE[17], int(_OWN[17]))
                w.put(n - 3, 3)
            else:
                n = 1
                w.put(_OWN_CODE[0], int(_OWN[0]))
            gap -= n
        if symbol < len(length):
            n = int(length[symbol])
            w.put(_OWN_CODE[n], int(_OWN[n]))
            at = symbol + 1


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distance codes from 1 on."""
    d = value - 1
    high = np.where(d < 4, 1, np.frexp(np.maximum(d, 1).astype(float))[1] - 1)
    extra = np.where(d < 4, 0, high - 1)
    return np.where(d < 4, d, 2 * high + ((d >> (high - 1)) & 1)), d & ((1 << extra) - 1), extra


def _matches(pixels: np.ndarray, least: int = 12, most: int = 4096) -> list[tuple[int, int, int]]:
    """(at, length, distance) of repeats of at least `least` pixels, left to right, found by the last place with the same
    eight pixels."""
    n = len(pixels) - 7
    if n < least:
        return []
    hashed = np.zeros(n, np.uint64)
    for j in range(8):
        hashed = hashed * _U(0x9E3779B97F4A7C15) + pixels[j : j + n]
    short = ((hashed * _U(0xD6E8FEB86659FD93)) >> _U(48)).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return []
    back = np.zeros(n, np.int64)
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    edge = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1]]))
    end_of = np.repeat(np.append(edge[1:], n), np.diff(np.append(edge, n)))
    places = np.flatnonzero((back > 0) & (end_of - np.arange(n) + 7 >= least)).tolist()
    out, free = [], 0
    for i in places:
        if i < free:
            continue
        length = min(int(end_of[i]) - i + 7, most)
        if length >= least and (pixels[i : i + 8] == pixels[i - back[i] : i - back[i] + 8]).all():
            out.append((i, length, int(back[i])))
            free = i + length
    return out


def _put_pixels(w: _Writer, pixels: np.ndarray, main: bool, cache: int = 0, repeats: bool = True, groups: tuple[int, np.ndarray] | None = None) -> None:
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(int(groups is not None), 1)
        if groups:  # all with the same codes
            w.put(groups[0] - 2, 3)
            _put_pixels(w, groups[1].astype(np.uint32) << np.uint32(8), False)
    flat = pixels.reshape(-1).astype(np.uint32)
    found = _matches(flat) if repeats else []
    literal = np.ones(len(flat), bool)
    for at, length, _ in found:
        literal[at : at + length] = False
    places = np.flatnonzero(literal)
    color = flat[places]
    green = ((color >> 8) & 255).astype(np.int64)
    if cache:
        slot, table = (np.uint32(0x1E35A7BD) * flat) >> np.uint32(32 - cache), {}
        kept = np.zeros(len(flat), bool)
        for i, (s, c) in enumerate(zip(slot.tolist(), flat.tolist(), strict=True)):
            kept[i] = table.get(s, 0) == c
            table[s] = c
        green = np.where(kept[places], 280 + slot[places], green).astype(np.int64)
    size = 280 + ((1 << cache) if cache else 0)
    count = [np.bincount(green, minlength=size)]
    plain = green < 256
    gray = bool(len(color)) and cache == 0 and bool(((color ^ color[0]) & np.uint32(0xFFFF00FF) == 0).all())
    parts: list[np.ndarray] = []
    if gray:
        count += [np.bincount([int(color[0]) >> s & 255], minlength=256) for s in (16, 0, 24)]
    else:
        parts = [np.where(plain, (color >> s) & 255, 0).astype(np.int64) for s in (16, 0, 24)]
        count += [np.bincount(p[plain], minlength=256) for p in parts]
    at, length, distance = (np.array([f[k] for f in found], np.int64) for k in range(3))
    ls = ds = at
    if found:
        ls, lx, ln = _prefixed(length)
        ds, dx, dn = _prefixed(distance + 120)
        count[0] = count[0] + np.bincount(256 + ls, minlength=size)
    count.append(np.bincount(ds, minlength=40))
    codes = []
    lengths = [code_lengths(c) for c in count]
    for bits in lengths * (int(groups[1].max()) + 1 if groups else 1):
        _put_code(w, bits)
    for bits in lengths:
        code = np.zeros(len(bits), np.int64)
        used = np.flatnonzero(bits)
        if len(used) == 1 and used[0] >= 256:
            bits = bits.copy()
            code[used[0]] = 1  # the partner in _put_code has the code 0
        elif len(used) == 1:
            bits = np.zeros_like(bits)
        elif len(used):
            symbols, values = _reversed_codes(bits)
            code[symbols] = values
        codes.append((code, bits))
    if gray and not found:
        w.put_all(codes[0][0][green], codes[0][1][green])
        return
    # Four numbers for each literal (green, red, blue, alpha), four for each repeat (length, extra, distance, extra).
    if gray:
        parts = [np.zeros(len(color), np.int64)] * 3
    if not found:
        lx = ln = dx = dn = at
    first = np.concatenate([places, at])
    values = [np.concatenate([codes[0][0][green], codes[0][0][256 + ls]])]
    sizes = [np.concatenate([codes[0][1][green], codes[0][1][256 + ls]])]
    for k, (v, n) in enumerate(((lx, ln), (codes[4][0][ds], codes[4][1][ds]), (dx, dn))):
        values.append(np.concatenate([np.where(plain, codes[k + 1][0][parts[k]], 0), v]))
        sizes.append(np.concatenate([np.where(plain, codes[k + 1][1][parts[k]], 0), n]))
    order = np.argsort(first, kind="stable")
    w.put_all(np.stack(values, 1)[order].reshape(-1), np.stack(sizes, 1)[order].reshape(-1))


def encode(pixels: np.ndarray, transforms: tuple[tuple, ...] = (), cache: int = 0, repeats: bool = True, groups: tuple[int, np.ndarray] | None = None) -> bytes:
    """A VP8L stream of (height, width) ARGB. `transforms`, in the order of the stream: ("predictor", bits, modes),
    ("cross", bits, factors), ("green",) or ("palette",). `groups`: block size as a power of two, and each block's number."""
    height, width = pixels.shape
    w = _Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    now = np.ascontiguousarray(pixels, np.uint32)
    for name, *rest in transforms:
        w.put(1, 1)
        if name == "palette":
            colors = np.unique(now)
            if len(colors) > 256:
                raise ValueError("more than 256 colours")
            w.put(3, 2)
            w.put(len(colors) - 1, 8)
            table = _bytes(colors)
            _put_pixels(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).reshape(-1).view(np.uint32), False)
            pack = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
            index = np.searchsorted(colors, now).astype(np.uint32)
            wide = -(-now.shape[1] >> pack) << pack
            index = np.pad(index, ((0, 0), (0, wide - now.shape[1]))).reshape(height, -1, 1 << pack)
            now = (index << (np.arange(1 << pack, dtype=np.uint32) * np.uint32(8 >> pack))).sum(axis=2).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
        elif name == "green":
            w.put(2, 2)
            now = _undo_green(now, forward=True)
        else:
            bits, side = rest
            w.put(0 if name == "predictor" else 1, 2)
            w.put(bits - 2, 3)
            _put_pixels(w, side, False)
            now = (_undo_predictor if name == "predictor" else _undo_cross)(now, bits, side, forward=True)
    w.put(0, 1)
    _put_pixels(w, now, True, cache, repeats, groups)
    return w.bytes()


# ---- container ----------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _u24(n: int) -> bytes:
    return struct.pack("<I", n)[:3]


def to_file(streams: list[bytes], sizes: list[tuple[int, int]]) -> bytes:
    """A WebP file: a still picture, or an animation if there are several."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        wide, high = max(s[0] for s in sizes), max(s[1] for s in sizes)
        body = _chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + _u24(wide - 1) + _u24(high - 1)) + _chunk(b"ANIM", bytes(6))
        body += b"".join(_chunk(b"ANMF", bytes(6) + _u24(w - 1) + _u24(h - 1) + _u24(1) + b"\2" + _chunk(b"VP8L", s)) for s, (w, h) in zip(streams, sizes, strict=True))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def streams_of(media: bytes) -> list[bytes]:
    """The VP8L streams of a WebP file, in order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out = []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"VP8L":
                out.append(media[at + 8 : at + 8 + size])
            elif name == b"ANMF":
                walk(at + 24, at + 8 + size)
            at += 8 + size + (size & 1)

    walk(12, len(media))
    return out


def samples_to_file(payload: bytes) -> bytes:
    """8-bit samples, a positive multiple of WIDTH, as the green channel of pictures of at most WIDTH x HEIGHT."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"the number of samples must be a positive multiple of {WIDTH}")
    streams, sizes = [], []
    for at in range(0, len(payload), WIDTH * HEIGHT):
        part = np.frombuffer(payload[at : at + WIDTH * HEIGHT], np.uint8).reshape(-1, WIDTH)
        streams.append(encode(part.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)))
        sizes.append((WIDTH, len(part)))
    return to_file(streams, sizes)


def files_to_samples(files: list[bytes]) -> list[bytes]:
    """The samples of each file, all decoded together."""
    streams = [streams_of(f) for f in files]
    pixels = iter(decode([s for own in streams for s in own]))
    return [b"".join(((next(pixels) >> 8) & 255).astype(np.uint8).tobytes() for _ in own) for own in streams]
