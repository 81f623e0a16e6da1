"""Lossless WebP: texts stored as images and read back.

decode() reads any lossless WebP still image: prefix codes (simple and normal, with groups of them by block),
literals, back-references, the colour cache, and the inverse of all four transforms (predictor, cross-colour,
subtract-green, palette with bundled pixels).

decode_streams() does the same for many images in step, a pixel of each at a time, in numpy; images with several
groups of codes, or very large ones, are left to decode().

store() lays bytes out as rows of 64 RGB pixels and compresses them: prefix codes by frequency, back-references, a
colour cache, and a palette where an estimate says that it makes the file smaller, or predictor or cross-colour
transforms by turns. What is taller than TALLEST rows goes on in further images. store_many() gives the same files for
many texts, with the work on images that take no transform done for all of them together.

Edge cases: a null or empty text is 192 blanks; equal texts give equal bytes; damaged images raise ValueError;
repeated rows are stored each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, texts

WIDE, TALLEST = 64, 64
UNIT = 3 * WIDE
# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: Near pixels in the order of their distance codes: by distance, then by columns, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
BLACK = 0xFF000000


def _reversed(width: int) -> np.ndarray:
    """Numbers of so many bits, with their bits in the other order."""
    k = np.arange(1 << width)
    out = np.zeros_like(k)
    for j in range(width):
        out |= (k >> j & 1) << (width - 1 - j)
    return out


REVERSED = [_reversed(k) for k in range(16)]


class Bits:
    """A bit stream, least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)

    def peek(self) -> int:
        """15 bits, zeros beyond the end."""
        a = self.at
        return int.from_bytes(self.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7) & 0x7FFF


class Code:
    """A prefix code: canonical, from lengths by symbol; table has symbol << 4 | length by the next `most` bits."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths = {s: n for s, n in lengths.items() if n}
        if len(lengths) < 2:
            self.most = 0
            self.table = [next(iter(lengths), 0) << 4]
            return
        self.most = max(lengths.values())
        order = sorted(sorted(lengths), key=lengths.__getitem__)
        size = np.array([lengths[s] for s in order])
        times = 1 << self.most - size
        if times.sum() != 1 << self.most:
            raise ValueError("a prefix code is not complete")
        # Entries of the first bit first, each as often as bits follow its code; then the order of the stream.
        self.table = np.repeat(np.array(order) << 4 | size, times)[REVERSED[self.most]].tolist()

    def read(self, bits: Bits) -> int:
        entry = self.table[bits.peek() & ((1 << self.most) - 1)]
        bits.at += entry & 15
        if bits.at > bits.end:
            raise ValueError("the stream ends too early")
        return entry >> 4


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        found = {first: 1}
        if two:
            found[bits.read(8)] = 1
        if max(found) >= size:
            raise ValueError("a symbol lies beyond its alphabet")
        return Code(found)
    inner = {LENGTH_ORDER[k]: bits.read(3) for k in range(4 + bits.read(4))}
    lengths_code = Code(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    found, at, before = {}, 0, 8
    table, mask, data, place = lengths_code.table, (1 << lengths_code.most) - 1, bits.data, bits.at
    while at < size and left:
        left -= 1
        held = int.from_bytes(data[place >> 3 : (place >> 3) + 3], "little") >> (place & 7)
        n = table[held & mask]
        place += n & 15
        held >>= n & 15
        n >>= 4
        if n < 16:
            if n:
                found[at] = before = n
            at += 1
            continue
        if n == 16:
            times = 3 + (held & 3)
            place += 2
        elif n == 17:
            times = 3 + (held & 7)
            place += 3
        else:
            times = 11 + (held & 127)
            place += 7
        if at + times > size:
            raise ValueError("lengths lie beyond their alphabet")
        if n == 16:
            for k in range(at, at + times):
                found[k] = before
        at += times
    bits.at = place
    if place > bits.end:
        raise ValueError("the stream ends too early")
    return Code(found)


def _image(bits: Bits, wide: int, tall: int, top: bool = False) -> np.ndarray:
    """ARGB pixels of an entropy-coded image, one row after the other."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, which = 0, None
    groups = 1
    if top and bits.read(1):
        block = bits.read(3) + 2
        across = -(-wide >> block)
        which = (_image(bits, across, -(-tall >> block)) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(which.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    sizes = (LITERALS + LENGTH_CODES + cached, LITERALS, LITERALS, LITERALS, DISTANCE_CODES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    n = wide * tall
    out = [0] * n
    cache = [0] * cached
    filled = at = 0
    own = [[x for c in g for x in (c.table, (1 << c.most) - 1)] for g in codes]
    green, mg, red, mr, blue, mb, alpha, ma, distance, md = own[0]
    data, end, next_byte = bits.data, bits.end, bits.at + 7 >> 3
    have = 8 * next_byte - bits.at
    held = bits.read(have) if have else 0
    while at < n:
        if have < 64:  # no token is longer
            held |= int.from_bytes(data[next_byte : next_byte + 8], "little") << have
            next_byte += 8
            have += 64
            if 8 * next_byte - have > end:
                raise ValueError("the stream ends too early")
        if which is not None:
            green, mg, red, mr, blue, mb, alpha, ma, distance, md = own[which[at // wide >> block, at % wide >> block]]
        e = green[held & mg]
        size = e & 15
        held >>= size
        s = e >> 4
        if s < LITERALS:
            e = red[held & mr]
            k = e & 15
            held >>= k
            size += k
            argb = (e >> 4) << 16 | s << 8
            e = blue[held & mb]
            k = e & 15
            held >>= k
            size += k
            argb |= e >> 4
            e = alpha[held & ma]
            k = e & 15
            held >>= k
            have -= size + k
            out[at] = argb | (e >> 4) << 24
            at += 1
        elif s < LITERALS + LENGTH_CODES:
            s -= LITERALS
            if s < 4:
                length = s + 1
            else:
                k = s - 2 >> 1
                length = (2 + (s & 1) << k) + (held & (1 << k) - 1) + 1
                held >>= k
                size += k
            e = distance[held & md]
            k = e & 15
            held >>= k
            size += k
            s = e >> 4
            if s < 4:
                code = s + 1
            else:
                k = s - 2 >> 1
                code = (2 + (s & 1) << k) + (held & (1 << k) - 1) + 1
                held >>= k
                size += k
            have -= size
            if code > len(NEAR):
                back = code - len(NEAR)
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * wide)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            if back >= length:
                out[at : at + length] = out[at - back : at - back + length]
            else:
                out[at : at + length] = (out[at - back : at] * (length // back + 1))[:length]
            at += length
        else:
            have -= size
            while filled < at:
                cache[(CACHE_FACTOR * out[filled] & 0xFFFFFFFF) >> 32 - cache_bits] = out[filled]
                filled += 1
            out[at] = cache[s - LITERALS - LENGTH_CODES]
            at += 1
    bits.at = 8 * next_byte - have
    if bits.at > end:
        raise ValueError("the stream ends too early")
    return np.array(out, np.int64)


def _split(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], -1)


def _argb(parts: np.ndarray) -> np.ndarray:
    a, r, g, b = np.moveaxis(parts.astype(np.int64) & 255, -1, 0)
    return a << 24 | r << 16 | g << 8 | b


def _predicted(mode: int, left, top, right, corner) -> list[int]:
    """A pixel's four channels from those to its left, above, above right and above left."""
    half = lambda p, q: [(x + y) >> 1 for x, y in zip(p, q, strict=True)]
    clamp = lambda x: min(255, max(0, x))
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode <= 4:
        return [left, top, right, corner][mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode <= 9:
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        # The gradient's guess is left + top - corner; take the neighbour that is nearer to it.
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    mean = half(left, top)
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


def _unpredict(pixels: np.ndarray, wide: int, tall: int, block: int, modes: np.ndarray) -> np.ndarray:
    modes = (modes >> 8 & 15).reshape(-1, -(-wide >> block))
    rest = _split(pixels).reshape(tall, wide, 4)
    out = np.zeros_like(rest)
    if (modes == modes.flat[0]).all() and modes.flat[0] in (1, 2):
        # Sums along a row or a column, all at once.
        rest = rest.copy()
        rest[0, 0] += [255, 0, 0, 0]
        if modes.flat[0] == 1:
            rest[:, 0] = np.cumsum(rest[:, 0], 0) & 255
            return _argb(np.cumsum(rest, 1)).reshape(-1)
        rest[0] = np.cumsum(rest[0], 0) & 255
        return _argb(np.cumsum(rest, 0)).reshape(-1)
    flat = rest.reshape(-1, 4).tolist()
    done: list[list[int]] = []
    for at, own in enumerate(flat):
        y, x = divmod(at, wide)
        if y == 0:
            guess = [255, 0, 0, 0] if x == 0 else done[at - 1]
        elif x == 0:
            guess = done[at - wide]
        else:
            guess = _predicted(int(modes[y >> block, x >> block]), done[at - 1], done[at - wide], done[at - wide + 1], done[at - wide - 1])
        done.append([(p + q) & 255 for p, q in zip(own, guess, strict=True)])
    out = np.array(done).reshape(tall, wide, 4)
    return _argb(out).reshape(-1)


def _guesses(mode: int, left, top, right, corner) -> np.ndarray:
    """_predicted() of many pixels: rows of four channels."""
    if mode in (0, 14, 15):
        return np.broadcast_to([255, 0, 0, 0], left.shape)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return (left + right >> 1) + top >> 1
    if mode <= 9:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return a + b >> 1
    if mode == 10:
        return (left + corner >> 1) + (top + right >> 1) >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(1) < np.abs(left - corner).sum(1)
        return np.where(nearer[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = left + top >> 1
    d = mean - corner
    return np.clip(mean + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)


def unpredict_many(images: list[tuple]) -> list[np.ndarray]:
    """_unpredict() of many (pixels, wide, tall, block, modes): along slanted lines, on which no pixel needs another."""
    sizes = [w * h for _, w, h, _, _ in images]
    start = np.cumsum([0, *sizes])
    out = _split(np.concatenate([p for p, *_ in images])).astype(np.int32)
    x, y, mode, wide = (np.empty(start[-1], np.int32) for _ in range(4))
    for k, (_, w, h, block, modes) in enumerate(images):
        yy, xx = (v.reshape(-1) for v in np.indices((h, w), np.int32))
        own = slice(start[k], start[k + 1])
        x[own], y[own], wide[own] = xx, yy, w
        mode[own] = (modes >> 8 & 15).reshape(-1, -(-w >> block))[yy >> block, xx >> block]
    mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, mode))
    line = x + 2 * y
    order = np.lexsort((mode, line))
    key = line[order].astype(np.int64) * 16 + mode[order]
    cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(order)]
    for a, b in zip(cut, cut[1:]):
        p = order[a:b]
        w = wide[p]
        # Neighbours that a mode does not use may lie outside; any pixel stands for them.
        guess = _guesses(int(mode[p[0]]), *(out[np.maximum(p - back, 0)] for back in (1, w, w - 1, w + 1)))
        out[p] = out[p] + guess & 255
    flat = _argb(out)
    return [flat[a:b] for a, b in zip(start, start[1:])]


def _uncross(pixels: np.ndarray, wide: int, tall: int, block: int, factors: np.ndarray) -> np.ndarray:
    across = -(-wide >> block)
    rows, cols = np.arange(tall) >> block, np.arange(wide) >> block
    own = _split(factors.reshape(-1, across)[rows[:, None], cols[None, :]]).reshape(-1, 4).astype(np.int8).astype(np.int64)
    parts = _split(pixels)
    signed = lambda x: (x & 255).astype(np.int8).astype(np.int64)
    green = signed(parts[:, 2])
    parts[:, 1] += own[:, 3] * green >> 5
    parts[:, 3] += (own[:, 2] * green >> 5) + (own[:, 1] * signed(parts[:, 1]) >> 5)
    return _argb(parts)


def _unpalette(pixels: np.ndarray, wide: int, tall: int, packed: int, table: np.ndarray) -> np.ndarray:
    index = (pixels >> 8 & 255).reshape(tall, -1)
    if packed:
        each = 8 >> packed
        shifts = np.arange(1 << packed) * each
        index = (index[:, :, None] >> shifts & (1 << each) - 1).reshape(tall, -1)[:, :wide]
    full = np.zeros(256, np.int64)
    full[: len(table)] = table
    return full[index].reshape(-1)


def decode_one(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(tall x wide x 4 array of A, R, G, B; where the next file begins)."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L" or data[at + 20 : at + 21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    size = struct.unpack_from("<I", data, at + 16)[0]
    bits = Bits(data[at + 21 : at + 20 + size])
    wide, tall = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, across = [], set(), wide
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            own = _image(bits, -(-across >> block), -(-tall >> block))
            undo.append((_uncross if kind else _unpredict, (across, tall, block, own)))
        elif kind == 2:
            undo.append((_ungreen, ()))
        else:
            n = bits.read(8) + 1
            table = _argb(np.cumsum(_split(_image(bits, n, 1)), 0))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((_unpalette, (across, tall, packed, table)))
            across = -(-across >> packed)
    pixels = _image(bits, across, tall, top=True)
    for f, args in reversed(undo):
        pixels = f(pixels, *args)
    return _split(pixels).astype(np.uint8).reshape(tall, wide, 4), end


def _ungreen(pixels: np.ndarray) -> np.ndarray:
    parts = _split(pixels)
    parts[:, 1] += parts[:, 2]
    parts[:, 3] += parts[:, 2]
    return _argb(parts)


def decode(data: bytes) -> np.ndarray:
    """One file's pixels, tall x wide x 4: A, R, G, B."""
    return decode_one(data)[0]


class Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


NONE = 1 << 62


def _lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a Huffman code by symbol, at most so long; 1 for an only symbol."""
    out = np.zeros(len(counts), np.int64)
    symbols = np.flatnonzero(counts)
    n, own = len(symbols), counts[symbols]
    if n < 2:
        out[symbols] = 1
        return out
    while True:
        order = np.argsort(own, kind="stable")
        # Leaves, then inner nodes; what isn't there yet, or no more, is heavier than all.
        weight, made = [*own[order].tolist(), NONE, NONE], [NONE] * (n + 1)
        top = [0] * (2 * n - 1)
        leaf, inner = 0, 0
        for k in range(n - 1):
            total, new = 0, n + k
            for _ in (0, 1):
                one, other = weight[leaf], made[inner]
                if one <= other:
                    top[leaf] = new
                    leaf += 1
                    total += one
                else:
                    top[n + inner] = new
                    inner += 1
                    total += other
            made[k] = total
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[top[k]] + 1
        if max(depth[:n]) <= most:
            out[symbols[order]] = depth[:n]
            return out
        own = own + 1 >> 1


def _code_values(lengths: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Each symbol's code as the stream has it, first bit lowest; of several codes end to end, if their starts are given."""
    out = np.zeros(len(lengths), np.int64)
    symbols = np.flatnonzero(lengths)
    own = lengths[symbols]
    which = np.zeros(len(symbols), np.int64) if start is None else np.searchsorted(start, symbols, "right") - 1
    key = which * 16 + own
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 65536 else key, kind="stable")
    symbols, own, which = symbols[order], own[order], which[order]
    step = np.cumsum(1 << 15 - own)
    # A code of two symbols or more fills 2^15, so that each begins anew at a multiple of it.
    out[symbols] = REVERSED[15][step - (1 << 15 - own) & 0x7FFF]
    return out


MOST = 11  # bits of a written code
#: Lengths are stated by a code of sixteen symbols, four bits each: lengths up to 12 and the three kinds of runs.
STATED = np.array([4 if s <= 12 or s >= 16 else 0 for s in range(19)])


@functools.cache
def _stated() -> tuple[int, int, list[int]]:
    """The bits that state the code of lengths, how many there are, and its symbols' values."""
    w = Writer()
    for x, n in ((0, 1), (len(LENGTH_ORDER) - 4, 4), *((int(STATED[s]), 3) for s in LENGTH_ORDER), (0, 1)):
        w.put(x, n)
    return w.value, w.n, _code_values(STATED).tolist()


@functools.lru_cache(4096)
def _run(own: int, left: int) -> tuple[int, int]:
    """(bits, how many) that state a run of one length."""
    _, _, of = _stated()
    value = n = 0
    if own:
        value, n = of[own], 4
        left -= 1
        while left >= 3:
            k = min(left, 6)
            value |= (of[16] | k - 3 << 4) << n
            n += 6
            left -= k
    else:
        while left >= 3:
            k = min(left, 138)
            value |= (of[18] | k - 11 << 4 if k >= 11 else of[17] | k - 3 << 4) << n
            n += 11 if k >= 11 else 7
            left -= k
    for _ in range(left):
        value |= of[own] << n
        n += 4
    return value, n


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    """States a code: one or two symbols of a byte as they are, others by their lengths, runs cut short."""
    symbols = np.flatnonzero(lengths).tolist() or [0]
    if len(symbols) <= 2 and symbols[-1] < 256:
        for x, n in ((1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)):
            w.put(x, n)
        return
    value, n, _ = _stated()
    at = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    for own, begin, end in zip(lengths[at[:-1]].tolist(), at, at[1:]):
        more, size = _run(own, end - begin)
        value |= more << n
        n += size
    w.put(value, n)


def _bits_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits of numbers of so many bits each, lowest first."""
    end = np.cumsum(sizes)
    within = np.arange(end[-1] if len(end) else 0) - np.repeat(end - sizes, sizes)
    return (np.repeat(values, sizes) >> within & 1).astype(np.uint8)


def _prefix_of(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(prefix, extra bits, how many) of lengths or distances."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1))[1] - 1  # the place of the highest bit
    n = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), np.where(v < 4, 0, v & (1 << n) - 1), n


@functools.cache
def _prefixes() -> tuple[np.ndarray, ...]:
    """_prefix_of() of what images of store() have."""
    return _prefix_of(np.arange(WIDE * TALLEST + len(NEAR) + 1))


def _prefix(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """_prefix_of(), by a table where it reaches."""
    known = _prefixes()
    return tuple(x[values] for x in known) if not len(values) or values.max() < len(known[0]) else _prefix_of(values)


def _before(keys: np.ndarray) -> np.ndarray:
    """Where each key was last, -1 if nowhere."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


LEAST_COPY, LONGEST_COPY = 3, 4096


def _copies(pixels: np.ndarray) -> np.ndarray:
    """Rows of (where, length, distance): greedy copies from where the same three pixels were last."""
    n, out, end = len(pixels), [], 0
    if n > LEAST_COPY:
        p = pixels.astype(np.uint64)
        last = _before(p[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ p[2:] * np.uint64(0x165667B19E3779F9))
        own = pixels.tolist()
        found = np.flatnonzero(last >= 0)
        for i, j in zip(found.tolist(), last[found].tolist(), strict=True):
            if i < end:
                continue
            k, most = 0, min(n - i, LONGEST_COPY)
            while k < most and own[i + k] == own[j + k]:
                k += 1
            if k >= LEAST_COPY:
                out.append((i, k, i - j))
                end = i + k
    return np.array(out, np.int64).reshape(-1, 3)


def _cost(counts: np.ndarray) -> float:
    """About how many bits symbols with these counts take, with their code."""
    c = counts[counts > 0].astype(float)
    n = max(1.0, c.sum())
    return float(n * math.log2(n) - c @ np.log2(c)) + 6 * len(c)


def _near_codes(wide: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """Distance code by distance, for near pixels of an image so wide; 0 for others."""
    if wide not in known:
        out = np.zeros(8 * wide + 9, np.int64)
        for k in range(len(NEAR) - 1, -1, -1):
            x, y = NEAR[k]
            out[max(1, x + y * wide)] = k + 1
        known[wide] = out
    return known[wide]


CACHE_BITS = 7


def _put_image(parts: list[np.ndarray], w: Writer, pixels: np.ndarray, wide: int, top: bool = False) -> Writer:
    """Adds w's bits and those of an entropy-coded image to parts; a new writer for what follows."""
    copies = _copies(pixels)
    covered = np.zeros(len(pixels) + 1, np.int64)
    covered[copies[:, 0]] += 1
    covered[copies[:, 0] + copies[:, 1]] -= 1
    single = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    size, extra, n_extra = _prefix(copies[:, 1])
    near = _near_codes(wide)
    code = near[np.minimum(copies[:, 2], len(near) - 1)]
    code = np.where((code > 0) & (copies[:, 2] < len(near)), code, copies[:, 2] + len(NEAR))
    far, far_extra, n_far = _prefix(code)
    own = pixels[single]
    channels = [own >> s & 255 for s in (8, 16, 0, 24)]
    slot = (CACHE_FACTOR * pixels & 0xFFFFFFFF) >> 32 - CACHE_BITS
    last = _before(slot.astype(np.uint8))  # so few bits are sorted by their digits
    hit = ((last >= 0) & (pixels[last] == pixels))[single]

    cached = bool(8 * np.count_nonzero(hit) > len(single))
    if not cached:
        hit = np.zeros_like(hit)
    w.put(cached, 1)
    if cached:
        w.put(CACHE_BITS, 4)
    if top:
        w.put(0, 1)  # one group of codes
    first = np.where(hit, LITERALS + LENGTH_CODES + slot[single], channels[0])
    others = [c[~hit] for c in channels[1:]] if cached else channels[1:]
    counts = [np.bincount(np.concatenate([first, LITERALS + size]), minlength=LITERALS + LENGTH_CODES + (1 << CACHE_BITS) * cached)]
    counts += [np.bincount(c, minlength=LITERALS) for c in others] + [np.bincount(far, minlength=DISTANCE_CODES)]
    lengths = [_lengths(c, MOST) for c in counts]
    for x in lengths:
        _put_code(w, x)
    lengths = [np.zeros_like(x) if np.count_nonzero(x) < 2 else x for x in lengths]
    start = np.cumsum([0, *map(len, lengths)])
    flat = np.concatenate(lengths)
    values_of = _code_values(flat, start[:-1])
    codes = [values_of[a:b] for a, b in zip(start, start[1:])]
    # A pixel's or copy's codes in one number: four of MOST bits, or two and what goes with them.
    value, taken = codes[0][first], lengths[0][first]
    for of, own, channel in zip(codes[1:4], lengths[1:4], channels[1:], strict=True):
        if own.any():
            more, n = of[channel], own[channel]
            if cached:
                more[hit], n[hit] = 0, 0
            value |= more << taken
            taken += n
    if len(copies):
        more, n = codes[0][LITERALS + size], lengths[0][LITERALS + size]
        for own, bits in ((extra, n_extra), (codes[4][far], lengths[4][far]), (far_extra, n_far)):
            more |= own << n
            n += bits
        order = np.argsort(np.concatenate([single, copies[:, 0]]), kind="stable")
        value, taken = np.concatenate([value, more])[order], np.concatenate([taken, n])[order]
    parts.append(_written(w))
    parts.append(_bits_of(value, taken))
    return Writer()


def _written(w: Writer) -> np.ndarray:
    return np.unpackbits(np.frombuffer(w.value.to_bytes((w.n + 7) // 8, "little"), np.uint8), bitorder="little")[: w.n]


def _cost_of(parts: np.ndarray) -> float:
    return sum(_cost(np.bincount(parts[..., k].reshape(-1) & 255, minlength=256)) for k in range(parts.shape[-1]))


BLOCK = 4  # transforms go by blocks of 16 x 16 pixels
TURNS, PREDICTED, CROSSED, BUSY = 32, 0, 1, 6  # of texts' images, by their CRC, one in TURNS takes each of these transforms
MODES = (1, 2, 11, 12)


def _predict(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what is left of the pixels, mode of each block): each block takes the mode that leaves least."""
    tall, wide, _ = rgb.shape
    left, up, corner = (np.zeros_like(rgb) for _ in range(3))
    left[:, 1:], up[1:], corner[1:, 1:] = rgb[:, :-1], rgb[:-1], rgb[:-1, :-1]
    to_left, to_top = np.abs(up - corner).sum(-1), np.abs(left - corner).sum(-1)
    guesses = [left, up, np.where((to_left < to_top)[..., None], left, up), np.clip(left + up - corner, 0, 255)]
    rows, cols = np.arange(0, tall, 1 << BLOCK), np.arange(0, wide, 1 << BLOCK)
    rests = []
    for g in guesses:
        g[0], g[1:, 0] = left[0], up[1:, 0]  # what every mode does at the border
        rests.append(rgb - g)
    left_over = [np.add.reduceat(np.add.reduceat(np.abs((r + 128 & 255) - 128).sum(-1), rows, 0), cols, 1) for r in rests]
    best = np.argmin(left_over, 0)
    at = best[np.arange(tall)[:, None] >> BLOCK, np.arange(wide)[None, :] >> BLOCK]
    return np.take_along_axis(np.stack(rests), at[None, :, :, None], 0)[0] & 255, np.array(MODES)[best]


def _cross(rgb: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
    """(what is left, (red to blue, green to blue, green to red)), factors by least squares over the image."""
    red, green, blue = np.moveaxis((rgb + 128 & 255) - 128, -1, 0)

    def factor(of: np.ndarray, by: np.ndarray) -> int:
        return int(np.clip(np.rint(32 * (of * by).sum() / max(1, (by * by).sum())), -128, 127))

    to_red, to_blue = factor(red, green), factor(blue, green)
    rest = blue - (to_blue * green >> 5)
    across = factor(rest, red)
    return np.stack([red - (to_red * green >> 5), green, rest - (across * red >> 5)], -1) & 255, (across, to_blue, to_red)


def encode_rgb(pixels: np.ndarray, turn: int | None = None) -> bytes:
    """A file of tall x wide x 3 pixels. Palette, predictor and cross-colour transforms are used where an estimate says
    that they make the file smaller. Samples of less than BUSY bits each are text: no estimate is made of predictors
    and cross-colour then, but of those images turn PREDICTED takes the one and CROSSED the other."""
    tall, wide, _ = pixels.shape
    rgb = pixels.astype(np.int64)
    joined = (rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]).reshape(-1)
    w, parts = Writer(), []
    for value, n in ((wide - 1, 14), (tall - 1, 14), (0, 1), (0, 3)):  # sizes, no alpha, version
        w.put(value, n)
    colours = np.sort(joined)
    colours = colours[np.concatenate([[True], colours[1:] != colours[:-1]])]
    index = np.searchsorted(colours, joined) if len(colours) <= 256 else None
    plain, across, alpha = _cost_of(rgb), wide, BLACK
    if plain > BUSY * rgb.size:
        turn = None
    if index is not None and _cost(np.bincount(index)) + 20 * len(colours) < plain:
        for value, n in ((1, 1), (3, 2), (len(colours) - 1, 8)):
            w.put(value, n)
        table = _split(colours | BLACK)
        w = _put_image(parts, w, _argb(np.diff(table, axis=0, prepend=0)), len(colours))
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        across = -(-wide >> packed)
        held = np.zeros((tall, across << packed), np.int64)
        held[:, :wide] = index.reshape(tall, wide)
        shifts = np.arange(1 << packed) * (8 >> packed)
        joined = (held.reshape(tall, across, -1) << shifts).sum(-1).reshape(-1) << 8
        alpha = 0
    else:
        rest, modes = _predict(rgb) if turn is None or turn == PREDICTED else (rgb, None)
        cost = plain if turn is not None else _cost_of(rest)
        if turn == PREDICTED or cost < 0.95 * plain:
            rgb, plain, alpha = rest, cost, 0
            for value, n in ((1, 1), (0, 2), (BLOCK - 2, 3)):
                w.put(value, n)
            w = _put_image(parts, w, modes.reshape(-1) << 8 | BLACK, modes.shape[1])
        rest, (red_blue, green_blue, green_red) = _cross(rgb) if turn is None or turn == CROSSED else (rgb, (0, 0, 0))
        if turn == CROSSED or (turn is None and _cost_of(rest) < 0.95 * plain):
            rgb = rest
            for value, n in ((1, 1), (1, 2), (BLOCK - 2, 3)):
                w.put(value, n)
            rows, cols = -(-tall >> BLOCK), -(-wide >> BLOCK)
            w = _put_image(parts, w, np.full(rows * cols, BLACK | (red_blue & 255) << 16 | (green_blue & 255) << 8 | green_red & 255), cols)
        joined = (rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]).reshape(-1)
    w.put(0, 1)  # no more transforms
    _put_image(parts, w, joined | alpha, across, top=True)
    return _file_of(b"\x2f" + np.packbits(np.concatenate(parts), bitorder="little").tobytes())


def _file_of(body: bytes) -> bytes:
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def store(payload: bytes) -> bytes:
    """Lossless WebP files, one after the other, of a payload of whole rows. Texts have no gradients, so predictor and
    cross-colour transforms seldom pay; images take them by turns, so that reading back meets them all the same."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDE, 3)
    parts = (rows[k : k + TALLEST] for k in range(0, len(rows), TALLEST))
    return b"".join(encode_rgb(p, zlib.crc32(p) % TURNS) for p in parts)


# Many images at once, as store() writes them: the same steps, each taken for all of them together.

TOGETHER, TOGETHER_PIXELS = 512, 300_000  # images that are written together, and their pixels
CODES, LARGEST = 5, LITERALS + LENGTH_CODES + (1 << CACHE_BITS)  # codes of an image, symbols of the largest
LONG_RUN = 48  # of equal lengths; what states a longer one does not fit into a number


def _by_two(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """The order of two keys below 65,536, sorted by their digits."""
    order = np.argsort(minor.astype(np.uint16), kind="stable")
    return order[np.argsort(major[order].astype(np.uint16), kind="stable")]


def _lengths_many(counts: np.ndarray, most: int) -> np.ndarray:
    """_lengths() of many codes, rows of counts by symbol below 65,536: a node of each tree at a time."""
    out = np.zeros(counts.shape, np.int64)
    n = np.count_nonzero(counts, 1)
    out[n == 1] = counts[n == 1] > 0
    rows = np.flatnonzero(n > 1)
    if not len(rows):
        return out
    rows = rows[np.argsort(-n[rows], kind="stable")]
    n, k, longest = n[rows], len(rows), int(n[rows[0]])
    own = counts[rows]
    row, symbol = np.nonzero(own)
    weight = own[row, symbol]
    order = _by_two(row, weight)
    row, symbol, weight = row[order], symbol[order], weight[order]
    place = (np.arange(len(row)) - (np.cumsum(n) - n)[row]) * k + row
    # Leaves, then inner nodes, each column a tree; what isn't there yet, or no more, is heavier than all.
    inner_at = (longest + 1) * k
    nodes = np.full(inner_at + (longest + 1) * k, NONE)
    nodes[place] = weight
    top = np.zeros(len(nodes), np.int64)
    leaf, inner = np.arange(k), inner_at + np.arange(k)
    open_ = np.searchsorted(-n, -np.arange(1, longest), "left")  # trees that have an inner node j: of more than j + 1 leaves
    for j, a in enumerate(open_.tolist()):
        total = 0
        for _ in (0, 1):
            x, y = leaf[:a], inner[:a]
            one, other = nodes[x], nodes[y]
            take = one <= other
            top[np.where(take, x, y)] = j
            total = total + np.minimum(one, other)
            step = take * k
            x += step
            y += k - step
        nodes[inner_at + j * k : inner_at + j * k + a] = total
    depth = np.zeros((longest, k), np.int64)
    every = np.arange(k)
    for j in range(longest - 3, -1, -1):
        a = int(open_[j + 1])  # the last one is the root
        depth[j, :a] = depth[top[inner_at + j * k : inner_at + j * k + a], every[:a]] + 1
    deep = depth[top[place], row] + 1
    out[rows[row], symbol] = deep
    again = np.unique(rows[row[deep > most]])
    if len(again):
        out[again] = _lengths_many(counts[again] + 1 >> 1, most)
    return out


@functools.cache
def _runs() -> tuple[np.ndarray, np.ndarray]:
    """(bits, how many) by length and run, as _run() has them; 0 bits for long runs."""
    known = [[_run(own, k) if k and (not own or k <= LONG_RUN) else (0, 0) for k in range(LARGEST + 1)] for own in range(MOST + 1)]
    return tuple(np.array([[x[j] for x in line] for line in known]) for j in (0, 1))


def _lay(words: np.ndarray, at: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
    """Puts numbers of up to 63 bits at rising places, in bits, into words."""
    some = np.flatnonzero(sizes)
    if len(some):
        at, v = at[some], values[some].astype(np.uint64)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[start]] |= np.bitwise_or.reduceat(v << shift, start)
        words[word[start] + 1] |= np.bitwise_or.reduceat(v >> np.uint64(1) >> np.uint64(63) - shift, start)


def _within(sizes: np.ndarray, image: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each number begins among those of its image, all bits of each image)."""
    total = np.bincount(image, sizes, count).astype(np.int64)
    return np.cumsum(sizes) - sizes - (np.cumsum(total) - total)[image], total


def _plain_bodies(joined: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """The bit streams of images, WIDE pixels wide, without transforms; none for what has a long run of lengths."""
    count, begin = len(sizes), np.cumsum(sizes) - sizes
    image, pixels = np.repeat(np.arange(count), sizes), joined | BLACK
    found = [_copies(pixels[a : a + n]) for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
    of = np.repeat(np.arange(count), [len(x) for x in found])
    copies = np.concatenate(found)
    copies[:, 0] += begin[of]
    covered = np.zeros(len(pixels) + 1, np.int64)
    covered[copies[:, 0]] = 1
    np.subtract.at(covered, copies[:, 0] + copies[:, 1], 1)
    single = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    size, extra, n_extra = _prefix(copies[:, 1])
    near = _near_codes(WIDE)
    code = near[np.minimum(copies[:, 2], len(near) - 1)]
    code = np.where((code > 0) & (copies[:, 2] < len(near)), code, copies[:, 2] + len(NEAR))
    far, far_extra, n_far = _prefix(code)
    slot = (CACHE_FACTOR * pixels & 0xFFFFFFFF) >> 32 - CACHE_BITS
    last = _before((image << CACHE_BITS | slot).astype(np.uint16))
    hit = ((last >= 0) & (pixels[last] == pixels))[single]
    who = image[single]
    cached = 8 * np.bincount(who[hit], minlength=count) > np.bincount(who, minlength=count)
    hit &= cached[who]
    own = pixels[single]
    channels = [own >> s & 255 for s in (8, 16, 0, 24)]
    channels[0] = np.where(hit, LITERALS + LENGTH_CODES + slot[single], channels[0])
    # Symbols of all codes of all images in one row of numbers.
    counts = np.zeros(count * CODES * LARGEST, np.int64)
    base, copy_base, literal = who * (CODES * LARGEST), of * (CODES * LARGEST), np.flatnonzero(~hit)
    for k in ([base + channels[0], copy_base + LITERALS + size, copy_base + 4 * LARGEST + far] + [base[literal] + j * LARGEST + channels[j][literal] for j in (1, 2, 3)]):
        counts += np.bincount(k, minlength=len(counts))
    lengths = _lengths_many(counts.reshape(-1, LARGEST), MOST)
    kinds = np.count_nonzero(lengths, 1)
    low = np.argmax(lengths > 0, 1)
    high = np.where(kinds > 0, LARGEST - 1 - np.argmax(lengths[:, ::-1] > 0, 1), 0)
    simple = (kinds <= 2) & (high < 256)

    alphabet = np.tile([LARGEST, LITERALS, LITERALS, LITERALS, DISTANCE_CODES], (count, 1))
    alphabet[~cached, 0] = LITERALS + LENGTH_CODES
    alphabet = alphabet.reshape(-1)
    flat = lengths[np.arange(LARGEST) < alphabet[:, None]]
    start = np.cumsum(alphabet) - alphabet
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    new[start] = True
    at = np.flatnonzero(new)
    run, which = np.diff(at, append=len(flat)), np.repeat(np.arange(len(alphabet)), np.add.reduceat(new, start, dtype=np.int64))
    keep = ~simple[which]
    at, run, which = at[keep], run[keep], which[keep]
    value_of, size_of = _runs()
    long = np.bincount(which[(flat[at] > 0) & (run > LONG_RUN)] // CODES, minlength=count) > 0

    # Sizes and switches of each image, then what each code begins with, then its runs.
    stated, n_stated, _ = _stated()
    begins = np.where(simple, 5 | (kinds == 2) << 1 | low << 3 | np.where(kinds == 2, high << 11, 0), stated)
    n_begins = np.where(simple, np.where(kinds == 2, 19, 11), n_stated)
    head = WIDE - 1 | sizes // WIDE - 1 << 14 | np.where(cached, 1 | CACHE_BITS << 1, 0) << 33
    order = np.argsort(np.concatenate([CODES * np.arange(count), np.arange(len(alphabet)), which]).astype(np.uint16), kind="stable")
    value = np.concatenate([head, begins, value_of[flat[at], run]])[order]
    taken = np.concatenate([np.where(cached, 39, 35), n_begins, size_of[flat[at], run]])[order]
    holder = np.concatenate([np.arange(count), np.arange(len(alphabet)) // CODES, which // CODES])[order]

    flat *= np.repeat(kinds > 1, alphabet)
    codes, start = _code_values(flat, start), start.reshape(-1, CODES)
    # A pixel's or copy's codes in one number, as in _put_image(); all alphas are the same, which takes no bits.
    values, bits = np.zeros(len(pixels), np.int64), np.zeros(len(pixels), np.int64)
    k = start[who, 0] + channels[0]
    own, n = codes[k], flat[k]
    for j in (1, 2):
        k = start[who, j] + channels[j]
        own |= np.where(hit, 0, codes[k]) << n
        n += np.where(hit, 0, flat[k])
    values[single], bits[single] = own, n
    k = start[of, 0] + LITERALS + size
    own, n = codes[k], flat[k]
    k = start[of, 4] + far
    for more, n_more in ((extra, n_extra), (codes[k], flat[k]), (far_extra, n_far)):
        own |= more << n
        n += n_more
    values[copies[:, 0]], bits[copies[:, 0]] = own, n

    (place, n_head), (pixel_place, n_pixels) = _within(taken, holder, count), _within(bits, image, count)
    taking = n_head + n_pixels + 7 >> 3
    end = np.cumsum(taking)
    first = 8 * (end - taking)
    words = np.zeros(int(end[-1]) // 8 + 2, "<u8")
    _lay(words, first[holder] + place, value, taken)
    _lay(words, (first + n_head)[image] + pixel_place, values, bits)
    raw = words.tobytes()
    return [None if x else raw[b - t : b] for x, b, t in zip(long.tolist(), end.tolist(), taking.tolist(), strict=True)]


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """encode_rgb() of images of store(), each with its turn: those that surely take no transform together, others by themselves."""
    count, sizes = len(images), np.array([len(x) * WIDE for x in images])
    turns = np.array([zlib.crc32(x) % TURNS for x in images])
    rgb = np.concatenate([x.reshape(-1, 3) for x in images]).astype(np.int64)
    image = np.repeat(np.arange(count), sizes)
    joined = rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    # The estimates of _cost(), of all images.
    times = np.arange(sizes.max() + 1)
    dear = times * np.log2(np.maximum(times, 1))
    plain = 3 * dear[sizes]
    for k in range(3):
        seen = np.bincount(image << 8 | rgb[:, k], minlength=count << 8).reshape(count, 256)
        plain += 6 * np.count_nonzero(seen, 1) - dear[seen].sum(1)
    keys = np.sort(image << 24 | joined)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    of = keys[new] >> 24
    kinds = np.bincount(of, minlength=count)
    palette = dear[sizes] - np.bincount(of, dear[np.diff(new, append=len(keys))], count) + 26 * kinds
    near = 1e-6 * plain  # what is so near to another choice is left to encode_rgb()
    alone = (turns == PREDICTED) | (turns == CROSSED) | (plain + near > 3 * BUSY * sizes) | ((kinds <= 256) & (palette < plain + near))
    bodies: list[bytes | None] = [None] * count
    together = np.flatnonzero(~alone)
    if len(together):
        for k, body in zip(together.tolist(), _plain_bodies(joined[~alone[image]], sizes[together]), strict=True):
            bodies[k] = body
    return [encode_rgb(x, int(t)) if b is None else _file_of(b"\x2f" + b) for x, t, b in zip(images, turns, bodies, strict=True)]


def store_many(payloads: list[bytes]) -> list[bytes]:
    """store() of many payloads, their images written together."""
    held: list[np.ndarray] = []
    whose, files, pixels = [], [], 0
    for k, payload in enumerate(payloads):
        rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDE, 3)
        for a in range(0, len(rows), TALLEST):
            held.append(rows[a : a + TALLEST])
            whose.append(k)
            pixels += held[-1].size // 3
            if len(held) >= TOGETHER or pixels >= TOGETHER_PIXELS:
                files += encode_many(held)
                held, pixels = [], 0
    if held:
        files += encode_many(held)
    out: list[list[bytes]] = [[] for _ in payloads]
    for k, file in zip(whose, files, strict=True):
        out[k].append(file)
    return [b"".join(x) for x in out]


def load(media: bytes) -> np.ndarray:
    """The rows that store() wrote, all files together: rows x 64 x 3."""
    parts, at = [], 0
    while at < len(media):
        pixels, at = decode_one(media, at)
        parts.append(pixels[:, :, 1:])
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


# Many images at once: the same steps as above, each taken for all streams together.

LOCKSTEP_PIXELS, LOCKSTEP_CELLS = 1 << 14, 1 << 26  # of an image and of all code tables that are decoded so


class Streams:
    """Bit streams end to end in one buffer; `at` is each one's place in bits, `end` where it ends."""

    def __init__(self, parts: list[bytes]):
        raw = np.frombuffer(b"".join(parts) + bytes(16), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        self.at, self.end = 8 * (ends - sizes), 8 * ends
        # The eight bytes from each place on, so that a read is one lookup.
        self.words = np.zeros(len(raw) - 7, np.uint64)
        for k in range(8):
            self.words |= raw[k : len(raw) - 7 + k].astype(np.uint64) << np.uint64(8 * k)

    def peek(self, which: np.ndarray) -> np.ndarray:
        """57 bits or more of each of these streams, as signed numbers without a sign."""
        at = self.at[which]
        return (self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (at & 7).astype(np.uint64) & np.uint64(0x1FFFFFFFFFFFFFF)).astype(np.int64)

    def read(self, which: np.ndarray, n) -> np.ndarray:
        out = self.peek(which) & (1 << np.asarray(n, np.int64)) - 1
        self.at[which] += n
        return out

    def check(self, which: np.ndarray) -> None:
        if (self.at[which] > self.end[which]).any():
            raise ValueError("the stream ends too early")


def _tables(lengths: np.ndarray, room: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, start, mask): the tables of many codes, rows of lengths by symbol, in one array of symbol << 4 | length;
    raises Crowded if that is more than `room` cells."""
    count = np.count_nonzero(lengths, 1)
    most = np.where(count > 1, lengths.max(1), 0).astype(np.int64)
    size = 1 << most
    if size.sum() > room:
        raise Crowded
    by_most = np.argsort(most, kind="stable")  # tables of one size lie together
    rank = np.empty_like(by_most)
    rank[by_most] = np.arange(len(by_most))
    start = np.empty_like(most)
    start[by_most] = np.cumsum(size[by_most]) - size[by_most]
    row, symbol = np.nonzero(lengths)
    own = lengths[row, symbol].astype(np.int64)
    none = np.flatnonzero(count == 0)
    row, symbol, own = (np.concatenate(x) for x in ((row, none), (symbol, 0 * none), (own, 0 * none)))
    order = _by_two(rank[row], own) if len(lengths) < 65536 else np.argsort(rank[row] * 16 + own, kind="stable")
    row, symbol, own = row[order], symbol[order], own[order]
    lone = count[row] < 2
    times = np.where(lone, 1, 1 << np.maximum(most[row] - own, 0))
    if (np.bincount(row, times, len(lengths)) != size).any():
        raise ValueError("a prefix code is not complete")
    cells = np.repeat((symbol << 4 | np.where(lone, 0, own)).astype(np.uint16), times)
    # Entries of the first bit first become entries in the order of the stream: places with their bits reversed.
    many, at = np.bincount(most, minlength=16).tolist(), 0
    for k, n in enumerate(many):
        end = at + (n << k)
        if k > 1 and n:
            cells[at:end] = cells[at:end].reshape(n, 1 << k)[:, REVERSED[k]].reshape(-1)
        at = end
    return cells, start, size - 1


def _read_codes(s: Streams, which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code lengths, a row of symbols for each of these streams, of the code that each states next."""
    out = np.zeros((len(which), int(sizes.max())), np.uint8)
    plain = s.read(which, 1) == 1
    k = np.flatnonzero(plain)
    if len(k):
        w = which[k]
        two, wide = s.read(w, 1) == 1, s.read(w, 1) == 1
        first = s.read(w, np.where(wide, 8, 1))
        second = np.where(two, s.peek(w) & 255, first)
        s.at[w] += np.where(two, 8, 0)
        if (np.maximum(first, second) >= sizes[k]).any():
            raise ValueError("a symbol lies beyond its alphabet")
        out[k, first] = 1
        out[k, second] = 1
    k = np.flatnonzero(~plain)
    if not len(k):
        return out
    w = which[k]
    stated = 4 + s.read(w, 4)
    inner = np.zeros((len(k), 19), np.uint8)
    for j in range(int(stated.max())):
        there = np.flatnonzero(j < stated)
        inner[there, LENGTH_ORDER[j]] = s.read(w[there], 3)
    cells, start, mask = _tables(inner)
    left = sizes[k].copy()
    bounded = np.flatnonzero(s.read(w, 1) == 1)
    if len(bounded):
        bits = 2 + 2 * s.read(w[bounded], 3)
        left[bounded] = 2 + s.read(w[bounded], bits)
    at, before = np.zeros(len(k), np.int64), np.full(len(k), 8)
    found = []
    open_ = np.flatnonzero((at < sizes[k]) & (left > 0))
    while len(open_):
        h = s.peek(w[open_])
        e = cells[start[open_] + (h & mask[open_])].astype(np.int64)
        n, symbol = e & 15, e >> 4
        h >>= n
        run = np.ones(len(open_), np.int64)
        again = symbol >= 16
        if again.any():
            extra = np.where(symbol == 16, 2, np.where(symbol == 17, 3, 7))
            run = np.where(again, np.where(symbol == 18, 11, 3) + (h & (1 << extra) - 1), 1)
            n = n + np.where(again, extra, 0)
        value = np.where(symbol < 16, symbol, np.where(symbol == 16, before[open_], 0))
        keep = value > 0
        found.append((open_[keep], at[open_[keep]], run[keep], value[keep]))
        before[open_] = np.where((symbol < 16) & (symbol > 0), symbol, before[open_])
        s.at[w[open_]] += n
        at[open_] += run
        left[open_] -= 1
        if (at[open_] > sizes[k[open_]]).any():
            raise ValueError("lengths lie beyond their alphabet")
        open_ = open_[(at[open_] < sizes[k[open_]]) & (left[open_] > 0)]
    row, begin, run, value = (np.concatenate(x) for x in zip(*found, strict=True))
    each = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
    out[k[np.repeat(row, run)], np.repeat(begin, run) + each] = np.repeat(value, run)
    return out


class Unfit(Exception):
    """Images that decode() has to take one by one."""


class Crowded(Unfit):
    """Too many images at once for their tables."""


def _images(s: Streams, which: np.ndarray, wide: np.ndarray, tall: np.ndarray, top: bool) -> tuple[np.ndarray, np.ndarray]:
    """(pixels, start of each image's): entropy-coded images of these streams, one pixel of every image at a time."""
    total = wide * tall
    order = np.argsort(-total, kind="stable")
    w, wide, total = which[order], wide[order], total[order]
    cached = np.where(s.read(w, 1) == 1, 1, 0)
    bits = np.zeros(len(w), np.int64)
    k = np.flatnonzero(cached)
    if len(k):
        bits[k] = s.read(w[k], 4)
        if (bits > 11).any():
            raise ValueError("the colour cache is too large")
    if top and s.read(w, 1).any():
        raise Unfit  # groups of codes
    slots = np.where(bits > 0, 1 << bits, 0)
    sizes = [LITERALS + LENGTH_CODES + slots, *(np.full(len(w), n) for n in (LITERALS, LITERALS, LITERALS, DISTANCE_CODES))]
    read, room = [], LOCKSTEP_CELLS
    for n in sizes:
        read.append(_tables(_read_codes(s, w, n), room))
        room -= len(read[-1][0])
    s.check(w)
    if total[0] > LOCKSTEP_PIXELS:
        raise Unfit
    (green, g0, gm), (red, r0, rm), (blue, b0, bm), (alpha, a0, am), (far, f0, fm) = read
    # A code of one symbol takes no bits: where all alphas are such, the channel is the same for all pixels of an image.
    still = alpha[a0].astype(np.int64) >> 4 << 24 if not am.any() else None
    ends = np.searchsorted(-total, -np.arange(int(total[0])), "left")  # images that have a pixel t
    offset = np.concatenate([[0], np.cumsum(ends)])
    out = np.zeros(offset[-1], np.int64)
    cache, base = np.zeros(int(slots.sum()), np.int64), np.cumsum(slots) - slots
    shift = 32 - bits
    at, words, last = s.at[w], s.words, len(s.words) - 1
    left, back = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    some_cache, copying = bool(slots.any()), 0
    near = np.array([x + y * 65536 for x, y in NEAR])
    every = np.arange(len(w))
    for t in range(int(total[0])):
        n = int(ends[t])
        d = every[:n] if not copying else np.flatnonzero(left[:n] == 0)
        row = out[offset[t] : offset[t + 1]]
        if len(d):
            p = at[d]
            h = (words[np.minimum(p >> 3, last)] >> (p & 7).astype(np.uint64)).astype(np.int64)
            e = green[g0[d] + (h & gm[d])]
            used = (e & 15).astype(np.int64)
            symbol = e >> 4
            h = h >> used & 0x7FFFFFFFFFF
            plain = symbol < LITERALS
            if plain.all():
                m, hm, um, sm = d, h, used, symbol
            else:
                m = d[plain]
                hm, um, sm = h[plain], used[plain], symbol[plain]
            e1 = red[r0[m] + (hm & rm[m])]
            k1 = (e1 & 15).astype(np.int64)
            hm = hm >> k1
            e2 = blue[b0[m] + (hm & bm[m])]
            k2 = (e2 & 15).astype(np.int64)
            um = um + k1 + k2
            if still is None:  # read anew, since four long codes do not fit into a word
                p = at[m] + um
                e3 = alpha[a0[m] + ((words[np.minimum(p >> 3, last)] >> (p & 7).astype(np.uint64)).astype(np.int64) & am[m])]
                um = um + (e3 & 15)
                high = (e3 >> 4).astype(np.int64) << 24
            else:
                high = still[m]
            at[m] += um
            row[m] = high | (e1 >> 4).astype(np.int64) << 16 | (sm << 8 | e2 >> 4)
            if m is not d:
                length = symbol >= LITERALS
                hit = symbol >= LITERALS + LENGTH_CODES
                length &= ~hit
                if hit.any():
                    m = d[hit]
                    at[m] += used[hit]
                    row[m] = cache[base[m] + symbol[hit] - (LITERALS + LENGTH_CODES)]
                if length.any():
                    m = d[length]
                    at[m] += used[length]
                    size = _extended(at, words, last, m, symbol[length] - LITERALS)
                    p = at[m]
                    e = far[f0[m] + ((words[np.minimum(p >> 3, last)] >> (p & 7).astype(np.uint64)).astype(np.int64) & fm[m])]
                    at[m] += e & 15
                    code = _extended(at, words, last, m, e >> 4)
                    close = near[np.minimum(code, len(near)) - 1]
                    x = (close + 32768 & 0xFFFF) - 32768
                    gap = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, x + (close - x >> 16) * wide[m]))
                    if (gap > t).any() or (t + size > total[m]).any():
                        raise ValueError("a back-reference leaves the image")
                    left[m], back[m] = size, gap
                    copying += len(m)
        if copying:
            c = np.flatnonzero(left[:n])
            row[c] = out[offset[t - back[c]] + c]
            left[c] -= 1
            copying -= int(np.count_nonzero(left[c] == 0))
        if some_cache:
            c = np.flatnonzero(bits[:n])
            cache[base[c] + ((CACHE_FACTOR * row[c] & 0xFFFFFFFF) >> shift[c])] = row[c]
    s.at[w] = at
    s.check(w)
    # From all images' first pixels, second pixels and so on to each image's own.
    begin = np.cumsum(total) - total
    image = np.repeat(every, total)
    mine = out[offset[np.arange(len(image)) - begin[image]] + image]
    start = np.empty(len(w), np.int64)
    start[order] = begin
    return mine, start


def _extended(at: np.ndarray, words: np.ndarray, last: int, m: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The length or distance that a prefix and the bits behind it state; moves those streams on."""
    symbol = symbol.astype(np.int64)
    n = np.where(symbol < 4, 0, symbol - 2 >> 1)
    p = at[m]
    more = (words[np.minimum(p >> 3, last)] >> (p & 7).astype(np.uint64)).astype(np.int64) & (1 << n) - 1
    at[m] += n
    return np.where(symbol < 4, symbol + 1, (2 + (symbol & 1) << n) + more + 1)


def _files(data: bytes) -> list[bytes]:
    """The bit streams of the files that lie one after the other in data."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L" or data[at + 20 : at + 21] != b"\x2f":
            raise ValueError("not a lossless WebP file")
        out.append(data[at + 21 : at + 20 + struct.unpack_from("<I", data, at + 16)[0]])
        at += 8 + struct.unpack_from("<I", data, at + 4)[0]
    return out


def decode_streams(parts: list[bytes]) -> list[np.ndarray]:
    """The ARGB pixels, row by row, of the images that bit streams hold; raises Unfit for what decode() has to take."""
    s = Streams(parts)
    every = np.arange(len(parts))
    wide, tall = s.read(every, 14) + 1, s.read(every, 14) + 1
    s.read(every, 1)
    if s.read(every, 3).any():
        raise ValueError("unknown version")
    across = wide.copy()
    undo: list[list] = [[] for _ in parts]
    seen = np.zeros((len(parts), 4), bool)
    open_ = every
    while len(open_ := open_[s.read(open_, 1) == 1]):
        kind = s.read(open_, 2)
        if seen[open_, kind].any():
            raise ValueError("a transform comes twice")
        seen[open_, kind] = True
        for k in open_[kind == 2].tolist():
            undo[k].append((_ungreen, ()))
        some, kind = open_[kind != 2], kind[kind != 2]
        if not len(some):
            continue
        stated = s.read(some, np.where(kind == 3, 8, 3))
        block = stated + 2
        w = np.where(kind == 3, stated + 1, -(-across[some] >> block))
        h = np.where(kind == 3, 1, -(-tall[some] >> block))
        pixels, start = _images(s, some, w, h, False)
        for j, k in enumerate(some.tolist()):
            own = pixels[start[j] : start[j] + w[j] * h[j]]
            if kind[j] == 3:
                n = int(w[j])
                packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                undo[k].append((_unpalette, (int(across[k]), int(tall[k]), packed, _argb(np.cumsum(_split(own), 0)))))
                across[k] = -(-across[k] >> packed)
            else:
                undo[k].append((_uncross if kind[j] else _unpredict, (int(across[k]), int(tall[k]), int(block[j]), own)))
    pixels, start = _images(s, every, across, tall, True)
    own = [pixels[start[k] : start[k] + across[k] * tall[k]] for k in range(len(parts))]
    # The last transform first; predictors of all images together.
    for depth in range(max(map(len, undo), default=0), 0, -1):
        together = []
        for k, steps in enumerate(undo):
            if len(steps) >= depth:
                f, args = steps[depth - 1]
                if f is _unpredict:
                    together.append((k, args))
                else:
                    own[k] = f(own[k], *args)
        if together:
            for (k, _), done in zip(together, unpredict_many([(own[k], *args) for k, args in together]), strict=True):
                own[k] = done
    return own


def load_many(media: list[bytes]) -> list[np.ndarray]:
    """load() of many, their images decoded together."""
    files = [_files(m) for m in media]
    try:
        flat = decode_streams([p for f in files for p in f])
    except Crowded:
        half = len(media) // 2
        return load_many(media[:half]) + load_many(media[half:]) if half else [load(m) for m in media]
    except Unfit:
        return [load(m) for m in media]
    out, at = [], 0
    for f in files:
        own = np.concatenate(flat[at : at + len(f)]) if len(f) > 1 else flat[at]
        rgb = np.empty((len(own), 3), np.uint8)
        rgb[:, 0], rgb[:, 1], rgb[:, 2] = own >> 16 & 255, own >> 8 & 255, own & 255
        out.append(rgb.reshape(-1, WIDE, 3))
        at += len(f)
    return out


def feature(pixels: np.ndarray) -> str:
    """Size, and mean and spread of each channel, of an array of pixels."""
    flat = pixels.reshape(-1, 3).astype(np.int64)
    n = len(flat)
    total, square = flat.sum(0), (flat * flat).sum(0)
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return f"{pixels.shape[1]}x{pixels.shape[0]} " + " ".join(f"{m:.3f}/{s:.3f}" for m, s in zip(mean, spread, strict=True))


AT_ONCE, AT_LEAST = 12_000_000, 1_000  # bytes of texts whose images are decoded together; what each counts at least


def _grouped(rows):
    """Rows of (key, bytes) in lists of about AT_ONCE bytes; what is short or empty counts too, so that lists end."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += max(len(row[1]), AT_LEAST)
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def stored(docs: DataFrame) -> DataFrame:
    """Per document what its stored and read back image says."""

    def run(rows):
        for held in _grouped(rows):
            stored_ = store_many([padded(text) for _, text in held])
            for (doc_id, text), media, pixels in zip(held, stored_, load_many(stored_), strict=True):
                back = np.ascontiguousarray(pixels).tobytes()
                yield doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)

    return map_rows(texts(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): the stored form of every whole text."""

    def run(rows):
        for held in _grouped(rows):
            yield from zip((doc_id for doc_id, _ in held), store_many([padded(text) for _, text in held]), strict=True)

    return map_rows(texts(docs), run, "doc_id long, media binary")


def pixels(stored_media: DataFrame) -> DataFrame:
    """(doc_id, height, width, pixels array<long> of 0xRRGGBB) from (doc_id, media)."""

    def run(rows):
        for held in _grouped(rows):
            for (doc_id, _), own in zip(held, load_many([m for _, m in held]), strict=True):
                own = own.astype(np.int64)
                yield doc_id, own.shape[0], own.shape[1], (own[:, :, 0] << 16 | own[:, :, 1] << 8 | own[:, :, 2]).reshape(-1)

    return map_rows(stored_media.select("doc_id", "media"), run, "doc_id long, height int, width int, pixels array<long>")
