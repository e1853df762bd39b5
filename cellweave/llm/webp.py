"""The lossless WebP format in numpy: files from pixel arrays and pixel arrays from files."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
SIGNATURE, MOST_SIDE = 0x2F, 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES, LONGEST_CODE = 24, 40, 15
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000

#: Near pixels that short distance codes stand for: by distance, then by column, left ones last.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


def shrunk(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


# prefix codes


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of a prefix code for symbols of these counts, none over `longest`."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = {}, len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = n
            heapq.heappush(heap, (a[0] + b[0], n))
            n += 1
        depth = {n - 1: 0}
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        found = [depth[k] for k in range(len(weights))]
        if max(found) <= longest:
            out[used] = found
            return out
        weights = [(w + 1) // 2 for w in weights]


@lru_cache(LONGEST_CODE + 1)
def _mirror(bits: int) -> np.ndarray:
    """The numbers of `bits` bits, each read backwards."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of these lengths, as they stand in the stream (first bit lowest)."""
    out = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for s in order.tolist():
        n = int(lengths[s])
        code <<= n - last
        last = n
        out[s] = _mirror(n)[code]
        code += 1
    return out


class Code:
    """A prefix code for reading: `table` holds symbol << 4 | length for each window of `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            self.bits, self.table = 0, np.array([int(used[0]) << 4], np.int32)
        else:
            if sum(2.0 ** -int(n) for n in lengths[used]) != 1:
                raise ValueError("incomplete prefix code")
            self.bits = int(lengths.max())
            order = used[np.argsort(lengths[used], kind="stable")]
            straight = np.repeat(order << 4 | lengths[order], 1 << (self.bits - lengths[order]))
            self.table = straight[_mirror(self.bits)].astype(np.int32)
        self.mask = (1 << self.bits) - 1
        self.entries = self.table.tolist()


@lru_cache(256)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8).astype(np.int64))


#: Descriptions of codes read before, by alphabet and first 64 bits: (bits, number of bits, code).
_SEEN: dict[tuple[int, int], tuple[int, int, Code]] = {}


class Reader:
    def __init__(self, raw: bytes):
        self.raw = raw + bytes(8)
        b = np.frombuffer(self.raw, np.uint8).astype(np.uint32)
        self.stream = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        self.words = memoryview(self.stream)  # 32 bits from each byte on
        self.pos, self.end = 0, 8 * len(raw)

    def ahead(self, pos: int, n: int) -> int:
        """n bits from a place on, however many."""
        return int.from_bytes(self.raw[pos >> 3 : (pos + n + 7) >> 3], "little") >> (pos & 7) & (1 << n) - 1

    def bits(self, n: int) -> int:
        out = self.words[self.pos >> 3] >> (self.pos & 7) & (1 << n) - 1
        self.pos += n
        if self.pos > self.end:
            raise ValueError("the file ends early")
        return out

    def symbol(self, code: Code) -> int:
        e = code.entries[self.words[self.pos >> 3] >> (self.pos & 7) & code.mask]
        self.pos += e & 15
        return e >> 4

    def code(self, size: int) -> Code:
        """The code that is described next. Files of one writer share descriptions, so long ones are remembered."""
        start, key = self.pos, (size, self.ahead(self.pos, 64))
        if key in _SEEN:
            bits, n, found = _SEEN[key]
            if start + n <= self.end and self.ahead(start, n) == bits:
                self.pos += n
                return found
        found = _code(self.lengths(size).astype(np.uint8).tobytes())
        if self.pos - start > 64:
            if len(_SEEN) > 1000:
                _SEEN.clear()
            _SEEN[key] = self.ahead(start, self.pos - start), self.pos - start, found
        return found

    def lengths(self, size: int) -> np.ndarray:
        lengths = np.zeros(size, np.int64)
        if self.bits(1):
            two = self.bits(1)
            lengths[self.bits(8 if self.bits(1) else 1)] = 1
            if two:
                lengths[self.bits(8)] = 1
            return lengths
        own = np.zeros(19, np.int64)
        for k in LENGTH_ORDER[: 4 + self.bits(4)]:
            own[k] = self.bits(3)
        read, at, last = _code(own.astype(np.uint8).tobytes()), 0, 8
        left = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else size
        while at < size and left:
            left -= 1
            s = self.symbol(read)
            if s < 16:
                lengths[at] = s
                last = s or last
                at += 1
            else:
                n = 3 + self.bits(2) if s == 16 else 3 + self.bits(3) if s == 17 else 11 + self.bits(7)
                lengths[at : at + n] = last if s == 16 else 0
                at += n
        return lengths

    def number(self, code: int) -> int:
        """The length or distance of a prefix symbol and the bits after it."""
        if code < 4:
            return code + 1
        extra = (code - 2) >> 1
        return ((2 + (code & 1)) << extra) + self.bits(extra) + 1


def _far(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as (height, width) pixels; only the main one may have several groups of codes."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    groups, group_of, tile = 1, None, 0
    if main and r.bits(1):
        tile = r.bits(3) + 2
        group_of = (_read_image(r, shrunk(width, tile), shrunk(height, tile), False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        groups = 1 + max(map(max, group_of))
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    sets = [[r.code(n) for n in sizes] for _ in range(groups)]
    if groups == 1 and sets[0][0].bits and not any(c.bits for c in sets[0][1:4]):
        start, found = r.pos, _read_samples(r, sets[0], cache_bits, width, height)
        if found is not None:
            return found
        r.pos = start
    return _read_pixels(r, sets, group_of, tile, cache_bits, width, height)


class _Chain:
    """The symbols that follow each other in a stream, found for many at once.

    At every bit of a piece of the stream the symbol that would begin there is
    looked up, and so where the next one would begin; doubled three times, eight
    symbols are one step.
    """

    PIECE = 1 << 20

    def __init__(self, r: Reader, code: Code):
        self.r, self.code = r, code
        self.low = self.high = 0

    def _look(self, pos: int) -> None:
        self.low = pos & ~7
        words = self.r.stream[pos >> 3 : (pos + self.PIECE) >> 3]
        self.high = self.low + 8 * len(words) - (64 if (pos + self.PIECE) >> 3 < len(self.r.stream) else 0)
        self.entries = self.code.table[((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(self.code.mask)).ravel()]
        here = np.arange(len(self.entries), dtype=np.int32)
        after = here + (self.entries & 15).astype(np.int32)
        stop = (after >= len(here)) | (self.entries >= 256 << 4) & (self.entries < 256 + LENGTH_CODES << 4)
        self.next = np.where(stop, here, after)
        two = self.next[self.next]
        four = two[two]
        self.eighth = memoryview(four[four])

    def run(self, pos: int, most: int) -> tuple[np.ndarray, int]:
        """Up to `most` symbols from pos on, up to a reference or the end of the piece, and where the one after them begins."""
        if not self.low <= pos < self.high:
            self._look(pos)
        at, eighth, begins = pos - self.low, self.eighth, []
        for _ in range(most // 8 + 1):
            begins.append(at)
            then = eighth[at]
            if then == at:
                break
            at = then
        rows = [np.array(begins, np.int32)]
        for _ in range(7):
            rows.append(self.next[rows[-1]])
        places = np.stack(rows, 1).ravel()
        stays = np.flatnonzero(self.next[places] == places)
        count = min(most, int(stays[0]) if len(stays) else len(places))
        symbols = self.entries[places[:count]] >> 4
        if count == len(places):
            return symbols, self.low + int(self.next[places[-1]])
        return symbols, self.low + int(places[count])


def _read_samples(r: Reader, set_: list[Code], cache_bits: int, width: int, height: int) -> np.ndarray | None:
    """Pixels that differ in green only, many at once; None where a place of the colour cache changes its colour while it is in use."""
    green, distance = set_[0], set_[4]
    fixed = [c.entries[0] >> 4 for c in set_[1:4]]
    base = fixed[0] << 16 | fixed[1] | fixed[2] << 24
    total, n, pos = width * height, 0, r.pos
    out = np.zeros(total, np.uint8)
    chain = _Chain(r, green)
    if cache_bits:
        slot = ((np.arange(256, dtype=np.uint64) << np.uint64(8) | np.uint64(base)) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        slot = slot.astype(np.int64)
        colour, since, mixed, asked = np.zeros(1 << cache_bits, np.int64), np.full(1 << cache_bits, total), np.zeros(1 << cache_bits, bool), np.zeros(1 << cache_bits, bool)
    while n < total:
        symbols, pos = chain.run(pos, total - n)
        if pos > r.end + 16:
            raise ValueError("the file ends early")
        if len(symbols):
            if cache_bits:
                first = np.flatnonzero(symbols < 256)
                value = symbols[first]
                own = slot[value]
                known = since[own] < total
                mixed[own[known & (colour[own] != value)]] = True
                colour[own[::-1]], since[own[~known][::-1]] = value[::-1], n + first[~known][::-1]
                mixed[own[colour[own] != value]] = True
                cached = np.flatnonzero(symbols >= 256)
                place = symbols[cached] - (256 + LENGTH_CODES)
                asked[place] = True
                if (since[place] > n + cached).any() or (mixed & asked).any():
                    return None
                symbols[cached] = colour[place]
            out[n : n + len(symbols)] = symbols
            n += len(symbols)
            continue
        r.pos = pos
        s = r.symbol(green)
        if not 256 <= s < 256 + LENGTH_CODES:
            raise ValueError("the file ends early")
        length = r.number(s - 256)
        back = _far(r.number(r.symbol(distance)), width)
        if back > n or n + length > total:
            raise ValueError("a reference leaves the image")
        if back == 1:
            out[n : n + length] = out[n - 1]
        for k in range(0, length if back > 1 else 0, back):
            step = min(back, length - k)
            out[n + k : n + k + step] = out[n - back : n - back + step]
        n += length
        pos = r.pos
    r.pos = pos
    if pos > r.end:
        raise ValueError("the file ends early")
    return (out.astype(np.uint32) << np.uint32(8) | np.uint32(base)).reshape(height, width)


def _read_pixels(r: Reader, sets: list[list[Code]], group_of, tile: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    out: list[int] = []
    cache, shift, total = [0] * (1 << cache_bits), 32 - cache_bits, width * height
    while len(out) < total:
        at = len(out)
        set_ = sets[group_of[at // width >> tile][at % width >> tile]] if group_of else sets[0]
        s = r.symbol(set_[0])
        if s < 256:
            red, blue, alpha = (r.symbol(c) for c in set_[1:4])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTH_CODES:
            length = r.number(s - 256)
            back = _far(r.number(r.symbol(set_[4])), width)
            if back > at or at + length > total:
                raise ValueError("a reference leaves the image")
            new = (out[at - back : at] * (length // back + 1))[:length]
        else:
            new = [cache[s - 256 - LENGTH_CODES]]
        if cache_bits:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
        out += new
        if r.pos > r.end:
            raise ValueError("the file ends early")
    return np.array(out, np.uint32).reshape(height, width)


# transforms, on (height, width, 4) samples in the order alpha, red, green, blue


def samples(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels, ">u4").view(np.uint8).reshape(*pixels.shape, 4)


def pixels(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts).view(">u4")[..., 0].astype(np.uint32)


def _mean(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, corner, right):
    """The value that a mode predicts from samples left, above, above left and above right; ints or arrays of ints, alpha first."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode == 6:
        return _mean(left, corner)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(corner, top)
    if mode == 9:
        return _mean(top, right)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        by_left = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(by_left, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        half = _mean(left, top)
        return np.clip(half + np.fix((half - corner) / 2).astype(np.int64), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(left))


def _tiles(small: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(small, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def predict_forward(parts: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    x = parts.astype(np.int64)
    height, width, _ = x.shape
    left, top, corner, right = (np.zeros_like(x) for _ in range(4))
    left[:, 1:], top[1:], corner[1:, 1:], right[1:, :-1] = x[:, :-1], x[:-1], x[:-1, :-1], x[:-1, 1:]
    right[1:, -1] = x[1:, 0]
    mode = _tiles(modes, bits, height, width)
    guess = np.zeros_like(x)
    for m in range(14):
        guess = np.where((mode == m)[..., None], _predict(m, left, top, corner, right), guess)
    guess[0, 1:], guess[1:, 0], guess[0, 0] = left[0, 1:], top[1:, 0], (255, 0, 0, 0)
    return ((x - guess) & 255).astype(np.uint8)


def predict_inverse(parts: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Row by row; along a row, runs of modes that don't look left at once, and sums for those that copy it."""
    x = parts.astype(np.int64)
    height, width, _ = x.shape
    x[0, 0] += (255, 0, 0, 0)
    x[0] = np.cumsum(x[0], axis=0) & 255
    for y in range(1, height):
        above, row = x[y - 1], x[y]
        row[0] = (row[0] + above[0]) & 255
        at = 1
        while at < width:
            mode = int(modes[y >> bits, at >> bits])
            end = min(width, ((at >> bits) + 1) << bits)
            right = np.concatenate([above[at + 1 : end + 1], row[:1]])[: end - at]
            if mode in (0, 2, 3, 4, 8, 9):
                row[at:end] = (row[at:end] + _predict(mode, above[at:end], above[at:end], above[at - 1 : end - 1], right)) & 255
            elif mode == 1:
                row[at:end] = (row[at - 1] + np.cumsum(row[at:end], axis=0)) & 255
            else:
                for k in range(at, end):
                    row[k] = (row[k] + _predict(mode, row[k - 1], above[k], above[k - 1], right[k - at])) & 255
            at = end
    return x.astype(np.uint8)


def _cross(parts: np.ndarray, factors: np.ndarray, bits: int, way: int) -> np.ndarray:
    """factors: (rows, columns, 4) samples: unused, red to blue, green to blue, green to red; each signed, in parts of 32."""
    height, width, _ = parts.shape
    x, f = parts.astype(np.int64), _tiles(factors.view(np.int8).astype(np.int64), bits, height, width)
    signed = lambda v: ((v & 255) ^ 128) - 128
    part = lambda a, b: a * b >> 5
    red, green, blue = x[..., 1], x[..., 2], x[..., 3]
    new_red = (red + way * part(f[..., 3], signed(green))) & 255
    plain_red = red if way < 0 else new_red
    new_blue = (blue + way * (part(f[..., 2], signed(green)) + part(f[..., 1], signed(plain_red)))) & 255
    return np.stack([x[..., 0], new_red, green, new_blue], -1).astype(np.uint8)


def cross_forward(parts, factors, bits):
    return _cross(parts, factors, bits, -1)


def cross_inverse(parts, factors, bits):
    return _cross(parts, factors, bits, 1)


def green_forward(parts: np.ndarray) -> np.ndarray:
    out = parts.copy()
    out[..., 1] -= parts[..., 2]
    out[..., 3] -= parts[..., 2]
    return out


def green_inverse(parts: np.ndarray) -> np.ndarray:
    out = parts.copy()
    out[..., 1] += parts[..., 2]
    out[..., 3] += parts[..., 2]
    return out


def bundle_bits(colours: int) -> int:
    """A palette of few colours puts 2 to the power of this many pixels into one."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def palette_forward(index: np.ndarray, colours: int) -> np.ndarray:
    """Indexes (height, width), bundled into the green of as few pixels as the palette allows."""
    b = bundle_bits(colours)
    height, width = index.shape
    wide = np.zeros((height, shrunk(width, b) << b), np.int64)
    wide[:, :width] = index
    step = 8 >> b
    packed = (wide.reshape(height, -1, 1 << b) << (step * np.arange(1 << b))).sum(-1)
    out = np.zeros((*packed.shape, 4), np.uint8)
    out[..., 0], out[..., 2] = 255, packed
    return out


def palette_inverse(parts: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    b = bundle_bits(len(palette))
    step = 8 >> b
    index = (parts[..., 2, None].astype(np.int64) >> (step * np.arange(1 << b)) & (1 << step) - 1).reshape(parts.shape[0], -1)[:, :width]
    known = np.zeros((256, 4), np.uint8)
    known[: len(palette)] = palette
    return known[index]


# files


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """The pixels (alpha, red, green, blue in 32 bits) of a file at the start of `raw`, and the file's length."""
    if raw[:4] != b"RIFF" or raw[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(raw[16:20], "little")
    r = Reader(raw[20 : 20 + size])
    if r.bits(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind == SUBTRACT_GREEN:
            undo.append(green_inverse)
        elif kind == PALETTE:
            n = r.bits(8) + 1
            palette = np.cumsum(samples(_read_image(r, n, 1, False))[0], axis=0, dtype=np.uint8)
            undo.append(lambda p, palette=palette, w=now: palette_inverse(p, palette, w))
            now = shrunk(now, bundle_bits(n))
        else:
            bits = r.bits(3) + 2
            small = samples(_read_image(r, shrunk(now, bits), shrunk(height, bits), False))
            if kind == PREDICTOR:
                undo.append(lambda p, m=small[..., 2] & 15, b=bits: predict_inverse(p, m, b))
            else:
                undo.append(lambda p, f=small, b=bits: cross_inverse(p, f, b))
    parts = samples(_read_image(r, now, height, True))
    for step in reversed(undo):
        parts = step(parts)
    return pixels(parts), 20 + size + (size & 1)


class Writer:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.many(np.array([value]), np.array([n]))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        """All values of up to 16 bits, lowest bit first; the bits of a byte don't meet, so sums put them together."""
        v, n = np.concatenate(self.values).astype(np.int64), np.concatenate(self.sizes).astype(np.int64)
        v, n = v[n > 0], n[n > 0]
        start = np.cumsum(n) - n
        v = v << (start & 7)
        at = start >> 3
        size = (int(n.sum()) + 7) >> 3
        sums = np.bincount(at, v, minlength=size).astype(np.int64)  # of up to 24 bits that begin in each byte
        out = sums & 255
        out[1:] += sums[:-1] >> 8 & 255
        out[2:] += sums[:-2] >> 16
        return out.astype(np.uint8).tobytes()

    def code(self, lengths: np.ndarray) -> np.ndarray:
        """Describe a prefix code; returns its codes, with lengths set to 0 where a single symbol needs no bits."""
        used = np.flatnonzero(lengths)
        if len(used) <= 2 and used.max(initial=0) < 256:
            first = int(used[0]) if len(used) else 0
            self.put(1, 1)
            self.put(len(used) == 2, 1)
            self.put(first > 1, 1)
            self.put(first, 8 if first > 1 else 1)
            if len(used) == 2:
                self.put(int(used[1]), 8)
        else:
            symbols, extras = _runs(lengths)
            own = code_lengths(np.bincount(symbols, minlength=19), 7)
            count = max(4, 19 - next(k for k in range(19) if own[LENGTH_ORDER[18 - k]]))
            self.put(0, 1)
            self.put(count - 4, 4)
            for k in LENGTH_ORDER[:count]:
                self.put(int(own[k]), 3)
            self.put(0, 1)
            bits = codes(own)
            alone = np.count_nonzero(own) == 1
            s = np.array(symbols)
            extra_bits = np.select([s == 16, s == 17, s == 18], [2, 3, 7], 0)
            self.many(np.stack([bits[s], np.array(extras)], 1).ravel(), np.stack([np.zeros_like(s) if alone else own[s], extra_bits], 1).ravel())
        out = codes(lengths)
        if len(used) == 1:
            lengths[:] = 0
        return out


def _runs(lengths: np.ndarray) -> tuple[list[int], list[int]]:
    """Code lengths as symbols 0 to 18 and the numbers after them."""
    symbols, extras, last = [], [], 8
    cut = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    for v, n in zip(lengths[cut[:-1]].tolist(), np.diff(cut).tolist()):
        while n:
            if v == 0 and n >= 3:
                take = min(n, 138)
                symbols.append(17 if take <= 10 else 18)
                extras.append(take - 3 if take <= 10 else take - 11)
            elif v and v == last and n >= 3:
                take = min(n, 6)
                symbols.append(16)
                extras.append(take - 3)
            else:
                take = 1
                symbols.append(v)
                extras.append(0)
                last = v or last
            n -= take
    return symbols, extras


def _prefix(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances from 1, the bits after them and how many."""
    x = n - 1
    extra = np.maximum(0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) - 1)
    small = x < 4
    extra = np.where(small, 0, extra)
    symbol = np.where(small, x, 2 * extra + 2 + (x >> extra & 1))
    return symbol, np.where(small, 0, x & (1 << extra) - 1), extra


@lru_cache(64)
def _near_codes(width: int) -> dict[int, int]:
    """The shortest code of each distance that NEAR holds."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _write_image(w: Writer, parts: np.ndarray, main: bool, references: list[tuple[int, int, int]] = (), cache_bits: int = 0, groups: np.ndarray | None = None, tile: int = 2, longest: int = 11) -> None:
    """An entropy-coded image. references: (place, length, distance) in pixels, in order; groups: the group of codes of each tile."""
    height, width, _ = parts.shape
    flat = parts.reshape(-1, 4).astype(np.int32)
    total = len(flat)
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(groups is not None, 1)
        if groups is not None:
            w.put(tile - 2, 3)
            small = np.zeros((*groups.shape, 4), np.uint8)
            small[..., 0], small[..., 1], small[..., 2] = 255, groups >> 8, groups & 255
            _write_image(w, small, False)
    covered = np.zeros(total + 1, np.int64)
    for place, length, _ in references:
        covered[place + 1 : place + length] = 1
    at = np.flatnonzero(covered[:total] == 0)
    green, second, third, fourth = flat[at, 2], flat[at, 1], flat[at, 3], flat[at, 0]
    literal = np.ones(len(at), bool)
    far = np.zeros(len(at), np.int64)
    extra = np.zeros((2, 2, len(at)), np.int64)  # of lengths and distances: bits and how many
    if references:
        place, length, distance = np.array(references, np.int64).T
        codes_near = _near_codes(width)
        k = np.searchsorted(at, place)
        literal[k] = False
        s, bits, n = _prefix(length)
        green[k], extra[0, 0, k], extra[0, 1, k] = 256 + s, bits, n
        s, bits, n = _prefix(np.array([codes_near.get(d, d + len(NEAR)) for d in distance.tolist()]))
        far[k], extra[1, 0, k], extra[1, 1, k] = s, bits, n
    if cache_bits:
        cache, shift = {}, 32 - cache_bits
        flat = flat.astype(np.int64)
        whole = (flat[:, 0] << 24 | flat[:, 1] << 16 | flat[:, 2] << 8 | flat[:, 3]).tolist()
        where = {p: k for k, p in enumerate(at.tolist())}
        cached = np.zeros(len(at), bool)
        for p, v in enumerate(whole):
            slot = (CACHE_FACTOR * v & 0xFFFFFFFF) >> shift
            k = where.get(p)
            if k is not None and literal[k] and cache.get(slot, 0) == v:
                green[k], cached[k] = 256 + LENGTH_CODES + slot, True
            cache[slot] = v
        literal &= ~cached
    group = np.zeros(len(at), np.int64) if groups is None else groups[at // width >> tile, at % width >> tile].astype(np.int64)
    is_ref = (green >= 256) & (green < 256 + LENGTH_CODES)
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    if groups is None and not cache_bits and all((x == x[0]).all() for x in (second, third, fourth)):
        n = code_lengths(np.bincount(green, minlength=sizes[0]), longest)
        c = w.code(n)
        for x in (second, third, fourth):
            w.code(np.eye(1, 256, int(x[0]), dtype=np.int64)[0])
        d = code_lengths(np.bincount(far[is_ref], minlength=DISTANCE_CODES), longest)
        e = w.code(d)
        at0 = 0
        for k in np.flatnonzero(is_ref).tolist():
            w.many(c[green[at0 : k + 1]], n[green[at0 : k + 1]])
            w.many(np.array([extra[0, 0, k], e[far[k]], extra[1, 0, k]]), np.array([extra[0, 1, k], d[far[k]], extra[1, 1, k]]))
            at0 = k + 1
        w.many(c[green[at0:]], n[green[at0:]])
        return
    values, lengths = np.zeros((len(at), 4), np.int64), np.zeros((len(at), 4), np.int64)
    for g in range(int(group.max(initial=0)) + 1):
        mine = group == g
        for k, (symbols, of) in enumerate(((green, mine), (second, mine & literal), (third, mine & literal), (fourth, mine & literal), (far, mine & is_ref))):
            n = code_lengths(np.bincount(symbols[of], minlength=sizes[k]), longest)
            c = w.code(n)
            column = 2 if k == 4 else k
            values[of, column], lengths[of, column] = c[symbols[of]], n[symbols[of]]
    values[is_ref, 1], lengths[is_ref, 1] = extra[0, 0][is_ref], extra[0, 1][is_ref]
    values[is_ref, 3], lengths[is_ref, 3] = extra[1, 0][is_ref], extra[1, 1][is_ref]
    w.many(values.ravel(), lengths.ravel())


#: How often characters stand in prose, by rank: a code that fits most texts, for files too short to describe their own well.
_COMMON = ((" ", 1500), ("e", 1100), ("tna", 700), ("iorhs", 450), ("dul\u00c3", 220), ("cbgfmpwy.,", 90), ("vkqxzj\n\u00a9", 30), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-'\"!?:;()/", 8))
CACHE_BITS, MOST_CACHED = 10, 128
#: What the common code may take up, as a multiple of an own code's bits: reading and writing it is faster.
SPARE = 1.2


def _slots(bits: int) -> np.ndarray:
    """The place in the colour cache of each grey value, after green is subtracted."""
    colour = np.arange(256, dtype=np.uint64) << np.uint64(8) | np.uint64(OPAQUE)
    return ((colour * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)


@lru_cache(2)
def _common_code(cache_bits: int) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Lengths and codes of the common code, and its description's values and sizes."""
    weights = np.ones(256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), np.int64)
    weights[256 + LENGTH_CODES :] = 0
    of = 256 + LENGTH_CODES + _slots(cache_bits) if cache_bits else np.arange(256)
    weights[of] = 1
    weights[of[128:192]] = 5  # what follows the first byte of a character
    for characters, weight in _COMMON:
        for c in characters.encode("latin-1"):
            weights[of[c]] = max(weights[of[c]], weight)
    if cache_bits:
        weights[:256] = 1
    lengths = code_lengths(weights, 13)
    w = Writer()
    values = w.code(lengths)
    return lengths, values, w.values, w.sizes


def encode_grey(grey: np.ndarray, references: list[tuple[int, int, int]] = ()) -> bytes:
    """A file of a grey image (height, width) of bytes: green is subtracted from red and blue, which leaves one symbol for a pixel.

    Images of up to MOST_CACHED values take repeated ones from the colour cache,
    where no two of them share a place. references: as in _write_image.
    """
    height, width = grey.shape
    flat = grey.ravel()
    counts = np.bincount(flat, minlength=256)
    used = np.flatnonzero(counts)
    w = Writer()
    cache_bits = CACHE_BITS if len(used) <= MOST_CACHED else 0
    head = ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2), (0, 1), (cache_bits > 0, 1), (cache_bits, 4 if cache_bits else 0), (0, 1))
    w.many(*np.array(head, np.int64).T)
    at = np.arange(len(flat))
    far = np.zeros(0, np.int64)
    if references:
        place, length, distance = np.array(references, np.int64).T
        covered = np.zeros(len(flat) + 1, np.int64)
        np.add.at(covered, place + 1, 1)
        np.subtract.at(covered, place + length, 1)
        at = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
        refs = np.searchsorted(at, place)
        size, size_bits, size_n = _prefix(length)
        near = _near_codes(width)
        far, far_bits, far_n = _prefix(np.array([near.get(d, d + len(NEAR)) for d in distance.tolist()]))
    symbols = flat[at].astype(np.int64)
    if cache_bits:
        slot = _slots(cache_bits)
        alone = np.bincount(slot[used], minlength=1 << cache_bits)[slot] == 1
        first = np.full(256, len(at))
        first[symbols[::-1]] = np.arange(len(at))[::-1]
        if references:  # what a reference covers does not come first
            first[symbols[refs]] = np.maximum(first[symbols[refs]], 0)
        cached = alone[symbols] & (np.arange(len(at)) > first[symbols])
        symbols = np.where(cached, 256 + LENGTH_CODES + slot[symbols], symbols)
    if references:
        symbols[refs] = 256 + size
    n = np.bincount(symbols, minlength=256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0))
    lengths, codes_, values, sizes = _common_code(cache_bits)
    p = n[n > 0]
    least = float(-(p * np.log2(p / len(symbols))).sum()) + 5 * len(p) + 100
    if int(n @ lengths) < SPARE * least:
        w.values += values
        w.sizes += sizes
    else:
        lengths = code_lengths(n, 13)
        codes_ = w.code(lengths)
    for k in (0, 0, 255):
        w.many(np.array([1, 0, k > 1, k], np.int64), np.array([1, 1, 1, 8 if k > 1 else 1], np.int64))
    far_lengths = code_lengths(np.bincount(far, minlength=DISTANCE_CODES), 13)
    far_codes = w.code(far_lengths)
    start = 0
    for j in range(len(far)):
        k = int(refs[j])
        w.many(codes_[symbols[start : k + 1]], lengths[symbols[start : k + 1]])
        w.many(np.array([size_bits[j], far_codes[far[j]], far_bits[j]]), np.array([size_n[j], far_lengths[far[j]], far_n[j]]))
        start = k + 1
    w.many(codes_[symbols[start:]], lengths[symbols[start:]])
    return _file(w)


def _file(w: Writer) -> bytes:
    body = w.bytes()
    pad = bytes(len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def encode(image: np.ndarray, palette: bool = False, green: bool = False, modes: np.ndarray | None = None, factors: np.ndarray | None = None, bits: int = 2, **entropy) -> bytes:
    """A file of (height, width) pixels. modes and factors: predictor modes, and cross-colour samples, of tiles of 2 ** bits pixels."""
    height, width = image.shape
    if not (0 < height <= MOST_SIDE and 0 < width <= MOST_SIDE):
        raise ValueError("an image has 1 to 16384 rows and columns")
    w, parts = Writer(), samples(image)
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (bool((image < OPAQUE).any()), 1), (0, 3)):
        w.put(value, n)
    if palette:
        colours, index = np.unique(image, return_inverse=True)
        table = samples(colours[None])
        w.put(1 | PALETTE << 1, 3)
        w.put(len(colours) - 1, 8)
        _write_image(w, np.diff(table, axis=1, prepend=np.zeros((1, 1, 4), np.uint8)), False)
        parts = palette_forward(index.reshape(image.shape), len(colours))
    if green:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        parts = green_forward(parts)
    if modes is not None:
        w.put(1 | PREDICTOR << 1, 3)
        w.put(bits - 2, 3)
        small = np.zeros((*modes.shape, 4), np.uint8)
        small[..., 0], small[..., 2] = 255, modes
        _write_image(w, small, False)
        parts = predict_forward(parts, modes, bits)
    if factors is not None:
        w.put(1 | CROSS_COLOUR << 1, 3)
        w.put(bits - 2, 3)
        _write_image(w, factors, False)
        parts = cross_forward(parts, factors, bits)
    w.put(0, 1)
    _write_image(w, parts, True, **entropy)
    return _file(w)
