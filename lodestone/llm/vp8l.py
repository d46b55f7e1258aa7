"""Lossless WebP (RFC 9649): a writer that chooses a form for each image, and a reader of the whole format.

The reader decodes prefix codes, back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Images whose four channels have only literals
take a faster way through the same prefix codes: a table from (node, next byte) to the symbols
that the byte completes.

The writer weighs two forms of an image. One has literals alone under a fixed prefix code, and is
read fast. The other has prefix codes of its own, back-references, a colour cache where pixels
recur, and the transform that serves the image best (none, palette, predictor from the left or
from above, subtract-green). It is taken where it needs ``WORTH`` of the first form's bytes at most,
and not for images under ``LEAST`` samples, where the description of codes weighs most.
"""

from __future__ import annotations

import heapq
from collections import Counter
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
N_LENGTHS, N_DISTANCES, CACHE_FACTOR = 24, 40, 0x1E35A7BD
#: Near distances: the offsets (x, y) of 120 pixels above and to the left, nearest first; of equally near ones the higher row, then the right one.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


def prefix_codes(lengths: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as sent, first bit lowest; length) of the canonical prefix code."""
    code, out, before = 0, {}, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        out[symbol] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code, before = code + 1, n
    return out


@lru_cache(maxsize=64)
def lookup(lengths: tuple[int, ...]) -> tuple[list[tuple[int, int]], int]:
    """(symbol, length) by the next ``width`` bits. A code of one symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1:
        return [(used[0] if used else 0, 0)], 0
    width = max(lengths)
    table: list = [None] * (1 << width)
    for symbol, (bits, n) in prefix_codes(lengths).items():
        table[bits :: 1 << n] = [(symbol, n)] * (1 << (width - n))
    if None in table:
        raise ValueError("incomplete prefix code")
    return table, width


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the image ends early")
        i = self.at >> 3
        value = int.from_bytes(self.data[i : i + 6], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def symbol(self, code: tuple[list, int]) -> int:
        table, width = code
        if not width:
            return table[0][0]
        i = self.at >> 3
        symbol, n = table[(int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)) & ((1 << width) - 1)]
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return symbol


def _read_code(bits: Bits, size: int) -> tuple[int, ...]:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return tuple(lengths)
    own = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, last = lookup(tuple(own)), 0, 8
    while at < size and left:
        left -= 1
        n = bits.symbol(code)
        if n < 16:
            lengths[at], at, last = n, at + 1, n or last
            continue
        value, times = (last, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if at + times > size:
            raise ValueError("too many code lengths")
        lengths[at : at + times] = [value] * times
        at += times
    return tuple(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


class _Walk:
    """From (channel and node, next byte) to the literals that the byte completes, built as needed."""

    def __init__(self, codes: list[tuple[int, ...]]):
        self.trees, self.first, self.rows, self.ids = [], [], [], {}
        for lengths in codes:
            tree: dict = {}
            for symbol, (bits, n) in prefix_codes(lengths).items():
                for i in range(n):
                    tree[(bits & ((1 << i) - 1), i)] = None
                tree[(bits, n)] = symbol
            self.trees.append(tree)
        self.start = self.state(0, (0, 0))

    def state(self, channel: int, node: tuple[int, int]) -> int:
        key = (channel, node)
        if key not in self.ids:
            self.ids[key] = len(self.rows)
            self.rows.append([None] * 256)
            self.first.append(key)
        return self.ids[key]

    def steps(self, state: int, byte: int, n: int) -> tuple[bytes, int]:
        """Literals and next state (-1: something else than a literal) after the n lowest bits of a byte."""
        channel, (bits, depth) = self.first[state]
        out = bytearray()
        for i in range(n):
            bits, depth = bits | (byte >> i & 1) << depth, depth + 1
            symbol = self.trees[channel].get((bits, depth))
            if symbol is not None:
                if symbol > 255:
                    return bytes(out), -1
                out.append(symbol)
                channel, bits, depth = (channel + 1) & 3, 0, 0
        return bytes(out), self.state(channel, (bits, depth))

    def run(self, data: bytes, at: int, need: int) -> bytes | None:
        """``need`` literals from bit ``at``, or None if others come first."""
        part = -at & 7
        out, state = self.steps(self.start, data[at >> 3] >> (at & 7), part) if part else (b"", self.start)
        parts, rows = [out], self.rows
        if state >= 0:
            add = parts.append
            for byte in data[(at + part) >> 3 :]:
                found = rows[state][byte]
                if found is None:
                    found = rows[state][byte] = self.steps(state, byte, 8)
                add(found[0])
                state = found[1]
                if state < 0:
                    break
        out = b"".join(parts)
        return out[:need] if len(out) >= need else None


@lru_cache(maxsize=8)
def _walk(codes: tuple[tuple[int, ...], ...]) -> _Walk | None:
    return _Walk(list(codes)) if all(sum(n > 0 for n in c) > 1 for c in codes) and not any(codes[0][256:]) else None


_SEEN: dict[tuple[int, ...], list[tuple[int, int, tuple]]] = {}


def _codes_at(bits: Bits, sizes: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """The prefix codes that are sent next. Codes end by themselves, so bits that equal those of known codes mean these codes; the eight met last are known."""
    i, seen = bits.at >> 3, _SEEN.setdefault(sizes, [])
    for k, (n, value, codes) in enumerate(seen):
        if n <= 8 * len(bits.data) - bits.at and (int.from_bytes(bits.data[i : i + (n + 14) // 8], "little") >> (bits.at & 7)) & ((1 << n) - 1) == value:
            bits.at += n
            seen.insert(0, seen.pop(k))
            return codes
    was = bits.at
    codes, n = tuple(_read_code(bits, k) for k in sizes), bits.at - was
    seen.insert(0, (n, (int.from_bytes(bits.data[i : i + (n + 14) // 8], "little") >> (was & 7)) & ((1 << n) - 1), codes))
    del seen[8:]
    return codes


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """height x width pixels as uint32 ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tile, tiles, across = 1, 0, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        tiles = ((_entropy_image(bits, across, -(-height >> tile), False) >> 8) & 0xFFFF).ravel().tolist()
        groups = max(tiles) + 1
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    lengths = [_codes_at(bits, sizes) for _ in range(groups)]
    total = width * height
    if main and groups == 1 and not cache_bits and (walk := _walk(lengths[0][:4])) and (found := walk.run(bits.data, bits.at, 4 * total)):
        g, r, b, a = np.frombuffer(found, np.uint8).reshape(-1, 4).T.astype(np.uint32)
        return (a << 24 | r << 16 | g << 8 | b).reshape(height, width)  # nothing follows the main image
    return np.array(_by_symbol(bits, width, total, [[lookup(x) for x in group] for group in lengths], tile, tiles, across, cache_bits), np.uint32).reshape(height, width)


def _by_symbol(bits: Bits, width: int, total: int, groups: list, tile: int, tiles: list | None, across: int, cache_bits: int) -> list[int]:
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else None
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, far = groups[tiles[(at // width >> tile) * across + (at % width >> tile)] if tiles else 0]
        s = bits.symbol(green)
        if s < 256:
            r, b, a = bits.symbol(red), bits.symbol(blue), bits.symbol(alpha)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 256 + N_LENGTHS:
            n, d = _extended(bits, s - 256), _extended(bits, bits.symbol(far))
            d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width) if d <= len(NEAR) else d - len(NEAR)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            out.append(cache[s - 256 - N_LENGTHS])
        if cache is not None:
            for p in out[at:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """uint32 pixels -> int32 array (..., 4) of alpha, red, green, blue."""
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    mean = lambda p, q: (p + q) >> 1
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(), np.abs(left - top_left).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        d = m - top_left
        return np.clip(m + np.trunc(d / 2).astype(np.int32), 0, 255)
    return (
        np.array([255, 0, 0, 0], np.int32), left, top, top_right, top_left, mean(mean(left, top_right), top), mean(left, top_left), mean(left, top),
        mean(top_left, top), mean(top, top_right), mean(mean(left, top_left), mean(top, top_right)),
    )[mode]


def invert_predictor(argb: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Adds to every pixel what its tile's mode predicts from pixels already known."""
    c = _channels(argb)
    height, width = argb.shape
    mode = ((modes >> 8) & 15).tolist()
    c[0, 0] = (c[0, 0] + [255, 0, 0, 0]) & 255
    kinds = {m for row in mode for m in row}
    if kinds in ({1}, {2}):  # one direction all over the image
        down = kinds == {2}
        first = np.cumsum(c[0] if down else c[:, 0], 0)
        if down:
            c[0] = first
        else:
            c[:, 0] = first
        return _packed(np.cumsum(c, 0 if down else 1))
    c[0, 1:] = np.cumsum(c[0], 0)[1:] & 255
    for y in range(1, height):
        c[y, 0] = (c[y, 0] + c[y - 1, 0]) & 255
        flat = c.reshape(-1, 4)
        for x in range(1, width):
            i = y * width + x
            m = mode[y >> tile][x >> tile]
            flat[i] = (flat[i] + _predict(m if m < 14 else 0, flat[i - 1], flat[i - width], flat[i - width + 1], flat[i - width - 1])) & 255
    return _packed(c)


def invert_cross_colour(argb: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    height, width = argb.shape
    c = _channels(argb)
    f = _channels(factors)[np.arange(height)[:, None] >> tile, np.arange(width)[None] >> tile]
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda factor, colour: (signed(factor) * signed(colour)) >> 5
    green = c[..., 2]
    c[..., 1] = (c[..., 1] + delta(f[..., 3], green)) & 255
    c[..., 3] = (c[..., 3] + delta(f[..., 2], green) + delta(f[..., 1], c[..., 1])) & 255
    return _packed(c)


def invert_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _packed(c)


def invert_palette(argb: np.ndarray, table: np.ndarray, shift: int, width: int) -> np.ndarray:
    index = ((argb >> 8) & 255).astype(np.int64)
    if shift:
        depth = 8 >> shift
        index = (index[..., None] >> (np.arange(1 << shift) * depth) & ((1 << depth) - 1)).reshape(len(index), -1)[:, :width]
    return np.append(table, np.zeros(256, np.uint32))[:256][index]


def decode_stream(data: bytes) -> np.ndarray:
    """A VP8L chunk's bytes -> height x width x 4 uint8 of alpha, red, green, blue."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            part = _entropy_part(bits, -(-across >> tile), -(-height >> tile))
            undo.append((invert_predictor if kind == PREDICTOR else invert_cross_colour, part, tile))
        elif kind == SUBTRACT_GREEN:
            undo.append((invert_subtract_green,))
        else:
            n = bits.read(8) + 1
            table = _packed(np.cumsum(_channels(_entropy_part(bits, n, 1)[0]), 0))
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((invert_palette, table, shift, across))
            across = -(-across >> shift)
    argb = _entropy_image(bits, across, height, True)
    for how, *rest in reversed(undo):
        argb = how(argb, *rest)
    return _channels(argb).astype(np.uint8)


def _entropy_part(bits: Bits, width: int, height: int) -> np.ndarray:
    """An image inside the stream: read by symbols, as what follows begins where it ends."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    codes = [lookup(x) for x in _codes_at(bits, sizes)]
    return np.array(_by_symbol(bits, width, width * height, [codes], 0, None, 0, cache_bits), np.uint32).reshape(height, width)


def riff(stream: bytes) -> bytes:
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def streams(data: bytes) -> list[bytes]:
    """The VP8L chunks of one or more WebP files, one after another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("no WebP file")
        n = int.from_bytes(data[at + 16 : at + 20], "little")
        out.append(data[at + 20 : at + 20 + n])
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    return out


# ------------------------------------------------------------------ writing


def code_lengths(weights: list[int], most: int = 15) -> tuple[int, ...]:
    """Lengths of a Huffman code for symbols of these weights (0: not used); weights are flattened until no length passes ``most``."""
    heap = [(w, i, (i,)) for i, w in enumerate(weights) if w]
    out = [0] * len(weights)
    heapq.heapify(heap)
    if len(heap) == 1:
        out[heap[0][1]] = 1
    while len(heap) > 1:
        (v, i, a), (w, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            out[s] += 1
        heapq.heappush(heap, (v + w, i, a + b))
    return tuple(out) if max(out) <= most else code_lengths([(w + 1) // 2 for w in weights], most)


def text_weights() -> list[int]:
    """How common the bytes of UTF-8 prose are, roughly: the prior that the writer's one prefix code comes from."""
    rank = {c: 1 for c in range(256)}
    rank |= {c: 3 for c in range(0x80, 0xC0)} | {0xC2: 3, 0xC3: 20}
    rank |= {ord(c): 4 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789|*&%$#!"} | {ord(c): 12 for c in ".,\n\0"}
    rank |= {ord(c): 25 for c in "abcdefghijklmnopqrstuvwxyz"} | {ord(c): 90 for c in "etaoinshrd"}
    return [v for _, v in sorted((rank | {ord(" "): 190}).items())]


class _Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n


def put_code(out: _Writer, lengths: tuple[int, ...]) -> None:
    """A prefix code, its lengths sent with runs of zeros."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1:
        symbol = used[0] if used else 0
        out.put(1, 1), out.put(0, 1), out.put(int(symbol > 1), 1), out.put(symbol, 8 if symbol > 1 else 1)
        return
    sent, at = [], 0
    for s in [*used, len(lengths)]:
        zeros, at = s - at, s + 1
        while zeros >= 3:
            run = min(zeros, 138)
            sent.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
            zeros -= run
        sent += [(0, 0, 0)] * zeros
        if s < len(lengths):
            sent.append((lengths[s], 0, 0))
    times = Counter(s for s, _, _ in sent)
    often = [int(10 * times[k] ** 0.5) for k in range(19)]
    if sum(n > 0 for n in often) == 1:  # a code of one symbol would take no bits; give it a neighbour
        often[not often[0]] = often[not often[0]] or 1
        often[1] = often[1] or 1
    own = code_lengths(often, 7)
    out.put(0, 1), out.put(15, 4)
    for k in CODE_LENGTH_ORDER:
        out.put(own[k], 3)
    out.put(0, 1)
    codes = prefix_codes(own)
    for s, extra, n in sent:
        out.put(*codes[s]), out.put(extra, n)


LITERALS = code_lengths(text_weights())
_BITS, _SIZE = (np.array(x) for x in zip(*(prefix_codes(LITERALS)[s] for s in range(256)), strict=True))
_BITS, _SIZE = _BITS.astype(np.uint64), _SIZE.astype(np.int64)


@lru_cache(maxsize=1)
def _preamble() -> tuple[int, int]:
    """What follows the image header in every written stream: no transform, no cache, one group of codes."""
    out = _Writer()
    out.put(0, 3)
    put_code(out, LITERALS + (0,) * N_LENGTHS)
    for _ in range(3):
        put_code(out, LITERALS)
    put_code(out, (0,) * N_DISTANCES)
    return out.value, out.at


def _with_codes(head: int, n: int, code: np.ndarray, size: np.ndarray) -> bytes:
    """The ``n`` bits of ``head``, then codes of these bits and sizes (none of them 0) one after another."""
    at = np.cumsum(size)
    total = (int(at[-1]) if len(at) else 0) + n
    at += n - size
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    words = np.zeros((total + 63) // 64 + 1, np.uint64)
    if len(at):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(code << shift, first)
        over = np.flatnonzero((at & 63) + size > 64)
        words[word[over] + 1] |= code[over] >> (np.uint64(64) - shift[over])
    head_words = np.frombuffer(head.to_bytes(-(-n // 64) * 8, "little"), "<u8")
    words[: len(head_words)] |= head_words
    return words.tobytes()[: (total + 7) // 8]


def _head(width: int, height: int) -> int:
    return 0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36


def literal_stream(pixels: np.ndarray, width: int) -> bytes:
    value, n = _preamble()
    return _with_codes(_head(width, len(pixels) // 4 // width) | value << 40, n + 40, _BITS[pixels], _SIZE[pixels])


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for lengths or distance codes (from 1)."""
    v = values - 1
    n = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2, 0)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), np.where(v < 4, 0, n)


@lru_cache(maxsize=8)
def _near_codes(width: int) -> np.ndarray:
    """The shortest near code of each distance in pixels, 0 where there is none."""
    out = np.zeros(8 * width + 9, np.int64)
    for k, (x, y) in reversed(list(enumerate(NEAR, 1))):
        if x + y * width >= 1:
            out[x + y * width] = k
    return out


def _copies(p: np.ndarray, longest: int = 4096) -> np.ndarray:
    """(start, length, distance) rows of what was there before: greedy, each from the last place that has the same three pixels."""
    out, at = [], 0
    if len(p) > 3:
        wide = p.astype(np.uint64)
        key = wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + wide[2:] * np.uint64(0x94D049BB133111EB)
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        before = np.full(len(key), -1)
        before[order[again + 1]] = order[again]
        starts = np.flatnonzero(before >= 0)
        while (i := np.searchsorted(starts, at)) < len(starts):
            s = int(starts[i])
            j, n = int(before[s]), 0
            for most in (16, longest):
                differ = p[s : s + most] != p[j : j + min(most, len(p) - s)]
                n = int(differ.argmax()) if differ.any() else len(differ)
                if n < most:
                    break
            if n >= 3:
                out.append((s, n, s - j))
            at = s + max(n, 1)
    return np.array(out, np.int64).reshape(-1, 3)


def _cached(argb: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cache slot of each pixel, and whether the slot holds that pixel already."""
    slot = ((argb.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    same = np.diff(slot[order], prepend=-1) == 0
    last = np.where(same, np.roll(argb[order], 1), 0)  # slots begin with zeros
    hit = np.empty(len(argb), bool)
    hit[order] = last == argb[order]
    return slot, hit


def _put_image(out: _Writer, pixels: np.ndarray, width: int, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sends an image's codes; gives the bits and sizes of its symbols. ``pixels``: rows of green, red, blue, alpha."""
    n = len(pixels)
    g, r, b, a = pixels.T.astype(np.uint32)
    argb = a << 24 | r << 16 | g << 8 | b
    copies = _copies(argb) if main else np.zeros((0, 3), np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, copies[:, 0] + 1, 1), np.add.at(edge, copies[:, 0] + copies[:, 1], -1)
    sent = np.flatnonzero(np.cumsum(edge[:n]) == 0)  # pixels inside a copy send nothing
    is_copy = np.zeros(n, bool)
    is_copy[copies[:, 0]] = True
    bits = min(10, max(1, len(np.unique(argb)).bit_length())) if main else 0
    slot, hit = _cached(argb, bits) if bits else (np.zeros(n, np.int64), np.zeros(n, bool))
    hit &= ~is_copy
    if 8 * hit[sent].sum() < (~is_copy)[sent].sum() or not hit[sent].any():
        bits, hit = 0, np.zeros(n, bool)
    sizes = (256 + N_LENGTHS + (1 << bits if bits else 0), 256, 256, 256, N_DISTANCES)
    far = copies[:, 2]
    near = _near_codes(width)[np.minimum(far, 8 * width + 8)]
    length, far = _prefixed(copies[:, 1]), _prefixed(np.where(near > 0, near, far + len(NEAR)))
    whole = ~(hit | is_copy)
    symbol = np.zeros((n, 4), np.int64)
    symbol[whole] = pixels[whole]
    symbol[hit, 0] = 256 + N_LENGTHS + slot[hit]
    symbol[copies[:, 0], 0], symbol[copies[:, 0], 2] = 256 + length[0], far[0]
    symbol, whole = symbol[sent], whole[sent]
    counts = [np.bincount(symbol[:, 0], minlength=sizes[0]), *(np.bincount(symbol[whole, k], minlength=256) for k in (1, 2, 3)), np.bincount(far[0], minlength=N_DISTANCES)]
    if not counts[0][:256].any():
        counts[0][0] = 1  # a code of one symbol is sent for symbols below 256 only
    out.put(int(bits > 0), 1)
    if bits:
        out.put(bits, 4)
    if main:
        out.put(0, 1)
    tables = []
    for count, size in zip(counts, sizes, strict=True):
        lengths = code_lengths(count.tolist(), 11)
        used = [s for s, k in enumerate(lengths) if k]
        put_code(out, lengths)
        table = np.zeros((2, size), np.int64)
        for s, (code, k) in prefix_codes(lengths).items() if len(used) > 1 else ():
            table[:, s] = code, k
        tables.append(table)
    code, size = np.zeros((2, len(sent), 4), np.int64)
    code[:, 0], size[:, 0] = tables[0][:, symbol[:, 0]]
    for k in (1, 2, 3):
        code[whole, k], size[whole, k] = tables[k][:, symbol[whole, k]]
    at = np.flatnonzero(is_copy[sent])
    code[at, 1], size[at, 1] = length[1:]
    code[at, 2], size[at, 2] = tables[4][:, far[0]]
    code[at, 3], size[at, 3] = far[1:]
    code, size = code.ravel(), size.ravel()
    some = size > 0
    return code[some].astype(np.uint64), size[some]


def _put_part(out: _Writer, pixels: np.ndarray, width: int) -> None:
    """An image inside the stream: its codes and symbols."""
    for code, size in zip(*_put_image(out, pixels, width, False), strict=True):
        out.put(int(code), int(size))


def _own_stream(pixels: np.ndarray, width: int, kind: int | None, mode: int = 0) -> bytes:
    """Height x width x 4 samples under codes of their own, after one transform or none."""
    height = len(pixels)
    out, across = _Writer(), width
    out.put(_head(width, height), 40)
    if kind is not None:
        out.put(1, 1), out.put(kind, 2)
    if kind == PREDICTOR:
        out.put(7, 3)
        _put_part(out, np.tile(np.array([[mode, 0, 0, 0]], np.uint8), (-(-height >> 9), 1)), 1)
    elif kind == PALETTE:
        colours, index = np.unique(pixels.reshape(-1, 4), axis=0, return_inverse=True)
        n = len(colours)
        out.put(n - 1, 8)
        _put_part(out, np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)), n)
        shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        across = -(-width >> shift)
        index = np.pad(index.reshape(height, width), ((0, 0), (0, (across << shift) - width))).reshape(height, across, -1)
        pixels = np.zeros((height, across, 4), np.uint8)
        pixels[..., 0] = (index << np.arange(1 << shift) * (8 >> shift)).sum(-1)
    out.put(0, 1)
    code, size = _put_image(out, pixels.reshape(-1, 4), across, True)
    return _with_codes(out.value, out.at, code, size)


def _changed(c: np.ndarray, kind: int, mode: int) -> np.ndarray:
    """What is left of height x width x 4 samples after a transform."""
    out = c.copy()
    if kind == SUBTRACT_GREEN:
        out[..., 1:3] -= c[..., :1]
        return out
    if mode == 1:
        out[:, 1:] -= c[:, :-1]
        out[1:, 0] -= c[:-1, 0]
    else:
        out[1:] -= c[:-1]
        out[0, 1:] -= c[0, :-1]
    out[0, 0, 3:] += 1  # less 255
    return out


def _entropy(c: np.ndarray) -> float:
    """Bits of the samples under the best code of each channel, its description left out."""
    n = np.bincount((c.reshape(-1, 4) + np.arange(4, dtype=np.uint16) * 256).ravel(), minlength=1024)
    n = n[n > 0]
    return float(-(n * np.log2(n / (c.size / 4))).sum())


WORTH, LEAST = 0.5, 1024


def _repeats(pixels: np.ndarray) -> bool:
    """Whether pixels recur so often, alone or in threes, that copies or the cache can spare half of the image."""
    p = np.ascontiguousarray(pixels).view(np.uint32)
    n, n_colours = len(p), len(np.unique(p))
    if 2 * n_colours > n or 8 * n_colours <= n:
        return 2 * n_colours <= n
    wide = p.astype(np.uint64)
    return 2 * len(np.unique(wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + wide[2:])) <= n


def encode_stream(pixels: np.ndarray, width: int) -> bytes:
    """Bytes in the order green, red, blue, alpha of each pixel -> a VP8L stream of that width."""
    plain = literal_stream(pixels, width)
    if len(pixels) < LEAST:
        return plain
    c = pixels.reshape(-1, width, 4)
    forms = {(kind, mode): _changed(c, kind, mode) for kind, mode in ((SUBTRACT_GREEN, 0), (PREDICTOR, 1), (PREDICTOR, 2))}
    bits = {form: _entropy(x) for form, x in forms.items()}
    best, own = min(bits, key=bits.get), _entropy(c)
    tried = []
    if (again := _repeats(pixels)) or own <= WORTH * 8 * len(plain):
        tried.append(_own_stream(c, width, None))
    if bits[best] <= WORTH * min(own, 8 * len(plain)):
        tried.append(_own_stream(forms[best], width, *best))
    if again and len(np.unique(np.ascontiguousarray(pixels).view(np.uint32))) <= 256:
        tried.append(_own_stream(c, width, PALETTE))
    found = min(tried, key=len, default=plain)
    return found if len(found) <= WORTH * len(plain) else plain
